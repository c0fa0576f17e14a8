"""Joins on text containment and on time: points in intervals, overlaps, nearest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.tables import numbered

#: Characters of needles that one pass over the texts looks for.
NEEDLE_CHARS = 32_000_000


def contains_join(needles: DataFrame, texts: DataFrame, needle_id: str, needle: str, text_id: str, text: str) -> DataFrame:
    """(needle_id, text_id) of each non-empty needle that a text contains. Needles go out in blocks of bounded size, and one automaton finds all of a block in one pass."""
    spark = needles.sparkSession
    types = dict(needles.dtypes) | dict(texts.dtypes)
    schema = f"{needle_id} {types[needle_id]}, {text_id} {types[text_id]}"
    texts, out = texts.select(text_id, text), None

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton, ids = ahocorasick.Automaton(), {}
            for i, n in shared.value:
                ids.setdefault(n, []).append(i)
            for n in ids:
                automaton.add_word(n, n)
            automaton.make_automaton()
            for b in batches:
                found = [(i, t) for t, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) for n in {n for _, n in automaton.iter(x.as_py() or "")} for i in ids[n]]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], b.schema.field(0).type if k else id_type) for k in (0, 1)], names=[needle_id, text_id])

        return texts.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type, block, held = to_arrow_type(needles.schema[needle_id].dataType), [], 0
    for r in needles.where(F.length(needle) > 0).select(needle_id, needle).toLocalIterator():
        if block and held + len(r[1]) > NEEDLE_CHARS:
            out = search(block) if out is None else out.union(search(block))
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1])
    last = search(block) if block else spark.createDataFrame([], schema)
    return last if out is None else out.union(last)


def bin_of(x: Column, width: float) -> Column:
    return F.floor(x / width)


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the intervals [start, end] of their key that hold them; `left` keeps points without any. Both meet by key and time bin, not by key alone, so a hot key is spread over its bins."""
    p = points.withColumn("_bin", bin_of(F.col(at), width))
    i = intervals.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start), width), bin_of(F.col(end), width)))).withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & (p["_bin"] == i["_bin"]) & F.col(at).between(F.col(start), F.col(end))
    return p.join(i, on, how).drop("_bin", "_key")


def overlapping(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of open intervals of one key that overlap. Each pair is made in one bin alone: that of the later start."""
    def binned(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        return df.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(span[0]), width), bin_of(F.col(span[1]), width))))

    x, y = binned(a, a_span), binned(b, b_span).withColumnRenamed(key, "_key").withColumnRenamed("_bin", "_other")
    on = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_other")) & (F.col(b_span[1]) > F.col(a_span[0])) & (F.col(b_span[0]) < F.col(a_span[1]))
    return x.join(y, on).where(F.col("_bin") == bin_of(F.greatest(F.col(a_span[0]), F.col(b_span[0])), width)).drop("_bin", "_key", "_other")


def nearest(points: DataFrame, targets: DataFrame, key: str, point_id: str, at: str, target_id: str, target_at: str, rows: int = 50_000) -> DataFrame:
    """Each point with the target of its key that is nearest in time (the smaller id of equals), null without targets. Points and targets without a key or a time are left out.

    One sort instead of a join of all pairs. The sorted rows are cut into blocks whatever their key, so a hot key is many blocks; what a block's first and last points miss comes from a table with
    the first and last target of each key and block.
    """
    once = targets.groupBy(key, F.col(target_at).alias("_at")).agg(F.min(target_id).alias("_target"))
    both = points.select(key, F.col(at).alias("_at"), F.col(point_id).alias("_point"), F.lit(None).cast("long").alias("_target")).union(once.select(key, "_at", F.lit(None).cast("long"), "_target"))
    both = both.where(F.col(key).isNotNull() & F.col("_at").isNotNull()).withColumn("_is_point", F.col("_target").isNull())
    placed, _ = numbered(both, [key, "_at", "_is_point"], "_n")  # a target comes before the points of its time
    blocks = placed.withColumns({"_block": F.floor(F.col("_n") / rows), "_here": F.when(~F.col("_is_point"), F.struct(F.col("_at").alias("at"), F.col("_target").alias("id")))})
    in_block = Window.partitionBy("_block", key).orderBy("_n")
    before = F.last("_here", ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_here", ignorenulls=True).over(in_block.rowsBetween(0, Window.unboundedFollowing))
    met = blocks.withColumns({"_before": before, "_after": after}).where("_is_point")
    ends = blocks.groupBy(key, "_block").agg(F.min("_here").alias("_first"), F.max("_here").alias("_last"))
    in_order = Window.partitionBy(key).orderBy("_block")  # one row a block
    carried = ends.select(key, "_block", F.last("_last", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", ignorenulls=True).over(in_order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    rank = lambda x: F.when(x.isNotNull(), F.struct(F.abs(x["at"] - F.col("_at")).alias("distance"), x["id"].alias("id")))
    best = F.least(rank(F.coalesce("_before", "_earlier")), rank(F.coalesce("_after", "_later")))
    return met.join(carried, [key, "_block"]).withColumn("best", best).select(key, F.col("_point").alias(point_id), F.col("best.id").alias(target_id), F.col("best.distance").alias("distance"))
