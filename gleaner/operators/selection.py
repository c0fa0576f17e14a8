"""Choosing rows by position, recency and version, and comparing and spreading lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import text_of
from gleaner.operators.order import first_seen
from gleaner.tables import numbered


def recent(df: DataFrame, order: list[str], most: int, wanted: Column, key: list[str]) -> DataFrame:
    """Of the last `most` rows, the wanted ones, and of those the first of each key. Rows are limited before they are filtered."""
    last = df.orderBy(*(F.desc(c) for c in order)).limit(max(1, most))
    return first_seen(last.where(wanted), key, order)


def ranked_versions(df: DataFrame, group: str, version: str, order: list[str]) -> DataFrame:
    """Each version of a group once, as its last row has it, with its place from the newest: by the first two parts of its id, then by the number in the third (none: 1). Rows without an id go."""
    rest = [c for c in df.columns if c not in (group, version)]
    rows = df.where(text_of(version) != "").groupBy(group, version).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    parts = F.split(version, "-")
    two = F.size(parts) >= 2
    base = F.when(two, F.concat_ws("-", F.slice(parts, 1, 2))).otherwise(F.col(version))
    third = F.get(parts, F.lit(2))
    number = F.when(~two, 0).when(third.rlike(r"^\d+$"), third.try_cast("int")).otherwise(1)
    newest = Window.partitionBy(group).orderBy(base.desc(), number.desc(), F.desc(version))
    return rows.select(group, version, "r.*", F.row_number().over(newest).alias("place"))


def at_positions(df: DataFrame, group: str, order: list[str], chosen: DataFrame) -> DataFrame:
    """Rows at the positions, from 1, that `chosen` (group, positions) lists for their group, in that order; all rows of a group for which none is there. Adds place."""
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    picks = chosen.select(group, F.posexplode("positions").alias("_pick", "_at")).join(rows.groupBy(group).agg(F.count("*").alias("_n")), group).where("_at between 1 and _n")
    found = rows.join(picks.drop("_n"), [group, "_at"])
    rest = rows.join(picks.select(group).distinct(), group, "left_anti").withColumn("_pick", F.col("_at") - 1)
    kept = found.unionByName(rest)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_pick"))).drop("_at", "_pick")


def chapter_count(n: Column, least: int = 3, most: int = 6) -> Column:
    """How many chapters n segments make: half of them, between least and most, but never more than there are."""
    return F.when(n <= 2, F.greatest(n, F.lit(0))).otherwise(F.least(n, F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(n / 2))))).cast("int")


def sampling_points(duration: Column, n: Column) -> Column:
    """n points that cut a duration into equal parts; none of no duration."""
    points = F.transform(F.sequence(F.lit(1), n), lambda i: F.bround(duration / (n + 1) * i, 2))
    return F.when((duration > 0) & (n > 0), points).otherwise(F.array().cast("array<double>"))


def fan_out(df: DataFrame, targets: Column) -> DataFrame:
    """A row for each different target (root, collection) of a row's list."""
    return df.withColumn("_target", F.explode(F.array_distinct(targets))).select("*", "_target.*").drop("_target")


def same_sets(df: DataFrame, group: str, item: str, left: Column, right: Column) -> DataFrame:
    """Whether a group's items on the left are those on the right, with the numbers of different items. No group's items are gathered."""
    items = df.groupBy(group, item).agg(F.max(left).alias("l"), F.max(right).alias("r"))
    return items.groupBy(group).agg(F.count_if("l").alias("n_left"), F.count_if("r").alias("n_right"), F.bool_and(F.col("l") == F.col("r")).alias("same"))


def united(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of several tables, whatever columns each lacks, each key once: its first row in order, of an earlier table before a later one."""
    out = None
    for k, f in enumerate(frames):
        one = f.withColumn("_table", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return first_seen(out, keys, ["_table", *order]).drop("_table")


def new_place(before: DataFrame, after: DataFrame, name: str, at: str) -> DataFrame:
    """One row: of the names that came in, the only one, or the newest of several; if none came in, the newest of all; the greater name of equals. No row without any."""
    fresh = after.join(before.select(name).distinct(), name, "left_anti")
    newest = lambda df: df.agg(F.max_by(name, F.struct(at, name)).alias(name), F.count("*").alias("_n"))
    both = newest(fresh).select(F.col(name).alias("_new"), F.col("_n")).crossJoin(newest(after).select(F.col(name).alias("_any")))  # two single rows
    return both.select(F.coalesce("_new", "_any").alias(name), (F.col("_n") > 0).alias("is_new")).where(F.col(name).isNotNull())


def with_bridges(blocks: DataFrame, key: str, order: list[str], lines: str, goes_on: Column, subject: Column) -> DataFrame:
    """Blocks with the subject of the block before in front of their lines, where the first line only goes on (goes_on, of `first`) and the subject isn't among them.

    subject(s): the block's own subject, from its lines, empty if it has none. The block before is found by one numbering of all blocks, so a key may have any number.
    """
    placed, _ = numbered(blocks.withColumns({"first": F.coalesce(F.get(lines, F.lit(0)), F.lit("")), "_subject": subject}), [key, *order], "_at")
    before = placed.select((F.col("_at") + 1).alias("_at"), F.col(key).alias("_key"), F.col("_subject").alias("_before"))
    met = placed.join(before, "_at", "left").withColumn("_before", F.when(F.col("_key") == F.col(key), F.col("_before")))
    bridge = F.coalesce(goes_on & (F.col("_before") != "") & ~F.array_contains(lines, F.col("_before")), F.lit(False))
    return met.withColumn(lines, F.when(bridge, F.concat(F.array("_before"), F.col(lines))).otherwise(F.col(lines))).drop("_at", "_key", "_before", "_subject", "first")
