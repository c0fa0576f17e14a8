"""Screenshots, chapters and what is said around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import text_of, trimmed
from gleaner.operators.joins import bin_of, nearest, points_in_intervals
from gleaner.operators.order import first_seen
from gleaner.tables import delete, written


def chapter_score(at: Column, start: Column, end: Column, content: Column, visual: Column, words: Column, blur: Column, has_text: Column) -> Column:
    """How well a screenshot stands for a chapter: near its middle, rich, different from the one before, sharp."""
    half = F.greatest(end - start, F.lit(1.0)) / 2
    timing = F.greatest(F.lit(0.0), 1 - F.abs(at - (start + end) / 2) / half)
    sharp = F.when(blur <= 0, 0.0).otherwise(blur / (blur + 800))
    return F.when(has_text, timing * 0.36 + content * 0.24 + visual * 0.14 + words * 0.14 + sharp * 0.12).otherwise(timing * 0.42 + content * 0.30 + visual * 0.16 + sharp * 0.12)


def bind_one_to_one(candidates: DataFrame) -> DataFrame:
    """(video, chapter, shot) from candidates (video, chapter, chapter_start, shot, at, score): each chapter in order takes its best screenshot that no chapter before took; the earlier of equals.

    Chapters don't wait for each other: all ask for their best, a screenshot goes to the earliest that asks, and with it all later chapters lose it; those that lost theirs ask again. As every
    screenshot prefers earlier chapters, that gives what taking turns gives, in as many rounds as chapters in a row push each other on. All steps are aggregates and joins by screenshot.
    """
    spark = candidates.sparkSession
    order = F.struct("chapter_start", "chapter")
    left, left_at = written(candidates.select("video", "shot", order.alias("turn"), F.struct((-F.col("score")).alias("score"), F.col("at"), F.col("shot")).alias("rank")), "candidates")
    while True:
        asked = left.groupBy("video", "turn").agg(F.min_by("shot", "rank").alias("shot"))
        given, given_at = written(asked.groupBy("video", "shot").agg(F.min("turn").alias("best"), F.count("*").alias("n")), "given")
        if given.where("n > 1").isEmpty():
            delete(spark, left_at)
            return given.select("video", F.col("best.chapter").alias("chapter"), "shot")
        rest = left.join(given.select("video", "shot", "best"), ["video", "shot"], "left").where(F.col("best").isNull() | (F.col("turn") <= F.col("best"))).drop("best")
        new, new_at = written(rest, "candidates")
        delete(spark, left_at)
        delete(spark, given_at)
        left, left_at = new, new_at


def representative_segments(chapters: DataFrame, segments: DataFrame, key: str, width: float) -> DataFrame:
    """(key, chapter, segment): of the segments that meet a chapter (closed intervals) the one whose middle is nearest to the chapter's; of all, where none does; the smaller id of equals.

    chapters: key, chapter, chapter_start, chapter_end; segments: key, segment, segment_start, segment_end.
    """
    c = chapters.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("chapter_start"), width), bin_of(F.col("chapter_end"), width))))
    s = segments.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("segment_start"), width), bin_of(F.col("segment_end"), width)))).withColumnRenamed(key, "_key")
    on = (c[key] == s["_key"]) & (c["_bin"] == s["_bin"]) & (F.col("segment_end") >= F.col("chapter_start")) & (F.col("segment_start") <= F.col("chapter_end"))
    apart = F.abs((F.col("segment_start") + F.col("segment_end")) / 2 - (F.col("chapter_start") + F.col("chapter_end")) / 2)
    met = c.join(s, on).groupBy(key, "chapter").agg(F.min_by("segment", F.struct(apart, "segment")).alias("segment"))
    alone = chapters.join(met, [key, "chapter"], "left_anti").select(key, "chapter", ((F.col("chapter_start") + F.col("chapter_end")) / 2).alias("middle"))
    middles = segments.select(key, "segment", ((F.col("segment_start") + F.col("segment_end")) / 2).alias("at"))
    return met.union(nearest(alone, middles, key, "chapter", "middle", "segment", "at").select(key, "chapter", "segment"))


def first_representatives(chapters: DataFrame, segments: DataFrame, key: str, width: float, most: int = 5) -> DataFrame:
    """(key, chapter, segment) for the first chapters of each key, in order of their start, up to `most`; a segment stands for the first of them that it represents alone."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("chapter_start", "chapter"))
    first = chapters.withColumn("_place", place).where(F.col("_place") <= most)
    found = representative_segments(first.drop("_place"), segments, key, width).where("segment is not null")
    return first_seen(found.join(first.select(key, "chapter", "_place"), [key, "chapter"]), [key, "segment"], ["_place"]).select(key, "chapter", "segment")


def key_blocks(blocks: DataFrame, key: str, length: Column, at: Column, middle: Column, block: str) -> DataFrame:
    """Of each chapter the block with the longest text; of equals the one nearest to the chapter's middle."""
    return blocks.groupBy(key).agg(F.max_by(block, F.struct(length, -F.abs(at - middle), -F.col(block))).alias(block))


BLOCK = "path string, alt string, at double, chapter string, window_start double, window_end double, lines array<string>, ocr string"


def merged_by_path(blocks: DataFrame) -> DataFrame:
    """Caption blocks (BLOCK) of one screenshot become one: the widest window, all different lines in order, and place and description of the block that says more (lines, then recognised text) than all before it
    together; chapter and recognised text come from that block, too, or from the first that has any. A screenshot has a block for each chapter that shows it, so its blocks fit in a row."""
    said = F.struct("at", "window_start", "window_end", "alt", text_of("chapter").alias("chapter"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), text_of("ocr").alias("ocr"))
    weight = lambda b: F.struct(F.size(b["lines"]), F.length(trimmed(b["ocr"])))

    def take(all_: Column, b: Column) -> Column:
        more = weight(b) > weight(all_)
        other = lambda c: F.when((b[c] != "") & (more | (all_[c] == "")), b[c]).otherwise(all_[c]).alias(c)
        lead = lambda c: F.when(more, b[c]).otherwise(all_[c]).alias(c)
        lines = F.concat(all_["lines"], F.array_except(b["lines"], all_["lines"]))
        return F.struct(lead("at"), F.least(all_["window_start"], b["window_start"]).alias("window_start"), F.greatest(all_["window_end"], b["window_end"]).alias("window_end"), lead("alt"), other("chapter"), lines.alias("lines"), other("ocr"))

    sorted_ = blocks.groupBy("path").agg(F.array_sort(F.collect_list(said)).alias("b"))
    one = F.aggregate(F.slice("b", F.lit(2), F.size("b")), F.col("b")[0], take)
    return sorted_.select("path", one.alias("x")).select("path", "x.alt", "x.at", "x.chapter", "x.window_start", "x.window_end", "x.lines", "x.ocr")


def paragraph(clauses: Column, most: int = 3, chars: int = 26) -> Column:
    """Clauses joined by commas into sentences of so many clauses or characters, those by full stops."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, c: Column) -> Column:
        now, length = F.concat(acc["now"], F.array(c)), acc["length"] + F.length(c)
        full = (F.size(now) >= most) | (length >= chars)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(F.array_join(now, "，")))).otherwise(acc["done"]).alias("done"), F.when(full, empty).otherwise(now).alias("now"), F.when(full, 0).otherwise(length).alias("length"))

    begin = F.struct(empty.alias("done"), empty.alias("now"), F.lit(0).alias("length"))
    sentences = F.aggregate(clauses, begin, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], "，")))).otherwise(acc["done"]))
    text = F.array_join(sentences, "。")
    return F.when(F.size(clauses) == 0, "暂无匹配字幕。").when(text.rlike("[。！？!?]$"), text).otherwise(F.concat(text, F.lit("。")))


def with_fallback(rows: DataFrame, first: DataFrame, first_key: str, then: DataFrame, then_key: str, value: str) -> DataFrame:
    """value of each row from a table by one key, else from another by another key. Both tables have a key once."""
    a = first.select(F.col(first_key).alias("_a"), F.col(value).alias("_first"))
    b = then.select(F.col(then_key).alias("_b"), F.col(value).alias("_then"))
    return rows.join(a, F.col(first_key) == F.col("_a"), "left").join(b, F.col(then_key) == F.col("_b"), "left").withColumn(value, F.coalesce("_first", "_then")).drop("_a", "_b", "_first", "_then")


def not_rendered(blocks: DataFrame, shown: DataFrame, gap: float = 4.0) -> DataFrame:
    """Blocks (path, chapter, title, at) that no shown one stands for: neither by path, nor by chapter, title and at most `gap` seconds. Two joins by equal keys, no pairs of all."""
    left = blocks.join(shown.select("path").distinct(), "path", "left_anti")
    near = shown.select(F.col("chapter").alias("_c"), F.col("title").alias("_t"), F.col("at").alias("_at")).distinct()
    return left.join(near, (F.col("chapter") == F.col("_c")) & (F.col("title") == F.col("_t")) & (F.abs(F.col("at") - F.col("_at")) <= gap), "left_anti")


def candidates(shots: DataFrame, chapters: DataFrame, key: str, width: float) -> DataFrame:
    """Screenshots (key, shot, at) with the chapters (key, chapter, chapter_start, chapter_end) that hold them."""
    return points_in_intervals(shots, chapters, key, "at", "chapter_start", "chapter_end", width)


def subtitle_choice(entries: DataFrame, languages: list[str], extensions: list[str]) -> DataFrame:
    """Of each video's subtitles (video, automatic, language, ext, url, seq) the one to take: written by people first, then by preferred language (also by its beginning), then by kind of file, then by place; entries without url or kind do not count."""
    low, n = F.lower("language"), F.lit(len(languages))
    rank = F.least(n, *(F.when(low.startswith(x.lower()), k) for k, x in enumerate(languages)))
    kind = F.array_position(F.array(*map(F.lit, extensions)), F.regexp_replace(F.lower("ext"), r"^\.+", ""))
    usable = entries.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("ext", F.lit("")) != ""))
    order = F.struct("automatic", rank, F.when(rank == n, F.col("language_seq")), "language", F.when(kind == 0, len(extensions) + 1).otherwise(kind), "seq")
    return usable.groupBy("video").agg(F.min_by(F.struct("automatic", "language", "ext", "url"), order).alias("x")).select("video", "x.*")
