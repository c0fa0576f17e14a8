"""What is said around a moment: the lines that meet its window, and as many neighbours as it takes to be enough."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.joins import nearest, overlapping

#: Lines and characters that are enough, and how far from the moment (seconds) a neighbour may be.
LINES, CHARS, REACH = 3, 18, 6.0


def shown(lines: list[tuple]) -> list[str]:
    """The different texts of lines (.., text, weak) in order, without the weak ones where others are."""
    texts = {t: weak for *_, t, weak in reversed(lines) if t}
    firsts = list(dict.fromkeys(t for *_, t, _ in lines if t))
    strong = [t for t in firsts if not texts[t]]
    return strong if len(firsts) > 1 and strong else firsts


def grown(lines: list[tuple], window: tuple, reach: float, chars: int) -> list[int]:
    """Places of the lines (middle, id, start, end, text, weak; sorted) to show for a window (start, end, at, least, most, earliest, latest), of which some meet it.

    From the outermost of these on, the neighbour on the left or on the right whose middle is nearer to the moment (the left of equals) is added, while both its distance and the chapter
    (earliest to latest) allow it, until there are enough different lines and characters, or two more lines than `most`. A side on which the next line isn't allowed is closed.
    """
    start, end, at, least, most, earliest, latest = window
    chosen = [k for k, x in enumerate(lines) if x[3] > start and x[2] < end]
    left, right = chosen[0] - 1, chosen[-1] + 1
    far = lambda k: abs(lines[k][0] - at)
    allowed = lambda k: 0 <= k < len(lines) and (earliest is None or earliest <= lines[k][0] <= latest) and far(k) <= reach
    while True:
        texts = shown([lines[k] for k in chosen])
        if len(texts) >= max(least, 1) and sum(map(len, texts)) >= chars:
            return chosen
        sides = [k for k in (left, right) if allowed(k)]
        if not sides:
            return chosen
        if min(sides, key=far) == left:
            chosen.insert(0, left)
            left -= 1
        else:
            chosen.append(right)
            right += 1
        if most is not None and len(chosen) >= most + 2:
            return chosen


def expanded(windows: DataFrame, lines: DataFrame, key: str, bin_width: float, reach: float = REACH, chars: int = CHARS, least: int = LINES, most: int | None = None) -> DataFrame:
    """(key, window, lines: ids in order of their middles, met: whether any line met the window) for each window of a key that has lines.

    windows: key, window (id), window_start, window_end, at, and optionally earliest and latest (its chapter; null: none). lines: key, line (id), line_start, line_end, text, weak (boolean).
    A window meets lines that end after its start and start before its end; with a weak one among them three lines are wanted, else `least`, at most `most`. A window that meets no line has the
    nearest alone and grows from there only if its text is empty or too short: then by the same rule, one line wanted.
    Windows meet lines by key and time bin, so a hot key is spread over its bins; a window's own lines are those around it, bounded by how many lines `reach` holds.
    """
    for c in ("earliest", "latest"):
        if c not in windows.columns:
            windows = windows.withColumn(c, F.lit(None).cast("double"))
    w = windows.select(key, "window", "window_start", "window_end", "at", "earliest", "latest")
    middle = (F.col("line_start") + F.col("line_end")) / 2
    said = lines.select(key, "line", "line_start", "line_end", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("weak", F.lit(False)).alias("weak"))
    # a window that meets no line stands at its nearest one: it is as wide as that line's middle
    meets = overlapping(w, said, key, ("window_start", "window_end"), ("line_start", "line_end"), bin_width).select(key, "window").distinct()
    alone = w.join(meets, [key, "window"], "left_anti")
    by = said.select(key, "line", middle.alias("middle"))
    found = nearest(alone, by, key, "window", "at", "line", "middle").where("line is not null").select(key, "window", F.col("line").alias("_line"))
    spot = found.join(said.select(key, F.col("line").alias("_line"), F.col("line_start").alias("_s"), F.col("line_end").alias("_e")), [key, "_line"]).drop("_line")
    every = w.join(meets, [key, "window"]).select("*", F.lit(True).alias("met"), F.lit(None).cast("long").alias("only")).unionByName(
        alone.join(found, [key, "window"]).join(spot, [key, "window"]).select(key, "window", F.col("_s").alias("window_start"), F.col("_e").alias("window_end"), "at", "earliest", "latest", F.lit(False).alias("met"), F.col("_line").alias("only"))
    )
    reached = every.withColumns({"_from": F.least("window_start", F.col("at") - reach) - 1e-6, "_to": F.greatest("window_end", F.col("at") + reach) + 1e-6})
    near = overlapping(reached, said, key, ("_from", "_to"), ("line_start", "line_end"), bin_width)
    line = F.struct(middle.alias("middle"), "line", "line_start", "line_end", "text", "weak")
    around = near.groupBy(key, "window", "window_start", "window_end", "at", "earliest", "latest", "met", "only").agg(F.array_sort(F.collect_list(line)).alias("around"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                own = [tuple(x.values()) for x in r["around"]]
                first = [x for x in own if x[3] > r["window_start"] and x[2] < r["window_end"]]
                if r["met"]:
                    wanted = 3 if any(x[5] for x in first) else least if len(own) > 1 and shown(first) else 1
                    span = (r["window_start"], r["window_end"])
                else:  # the one line, whatever else meets its time
                    wanted, at = 1, next(x for x in own if x[1] == r["only"])
                    own = [x if x is at else (*x[:2], float("inf"), float("-inf"), *x[4:]) for x in own]
                    span = (float("-inf"), float("inf"))
                window = (*span, r["at"], min(wanted, most) if most is not None else wanted, most, r["earliest"], r["latest"])
                out.append([own[k][1] for k in grown(own, window, reach, chars)])
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("window"), pa.array(out, pa.list_(pa.int64())), b.column("met")], names=[key, "window", "lines", "met"])

    return around.mapInArrow(run, f"{key} {dict(windows.dtypes)[key]}, window long, lines array<long>, met boolean")
