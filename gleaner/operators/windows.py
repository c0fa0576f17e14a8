"""Windows over time axes: caption windows, even buckets and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.tables import numbered


def caption_windows(shots: DataFrame, chapter: str, at: str, order: list[str], start: Column, end: Column, fallback: float = 4.0, lone: float = 8.0) -> DataFrame:
    """window_start, window_end of each shot: half-way to its neighbours, the chapter's edges at its ends, never beyond them; without a chapter (null edges) as far as to the other neighbour, or `lone` seconds; a few seconds each way where that is empty."""
    w = Window.partitionBy(chapter).orderBy(*order)
    t = F.col(at)
    before, after = F.lag(at).over(w), F.lead(at).over(w)
    a = F.greatest(F.coalesce((before + t) / 2, start, t - (after - t) / 2, t - lone), start)  # greatest and least skip nulls
    b = F.least(F.coalesce((after + t) / 2, end, t + (t - before) / 2, t + lone), end)
    empty = b <= a
    return shots.withColumns({"window_start": F.bround(F.when(empty, F.greatest(F.lit(0.0), t - fallback)).otherwise(a), 2), "window_end": F.bround(F.when(empty, t + fallback).otherwise(b), 2)})


def best_of_buckets(df: DataFrame, key: str, order: list[str], buckets: int, *best: Column) -> DataFrame:
    """The best row of each of so many even buckets of a key; earlier buckets take what doesn't divide."""
    cut = df.withColumn("bucket", F.ntile(buckets).over(Window.partitionBy(key).orderBy(*order)))
    return cut.withColumn("_n", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*best))).where("_n = 1").drop("_n")


def even_sample(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Up to n rows of each key at even distances, the first and the last among them; position half-way goes to the even one. n of 1 takes the middle."""
    w = Window.partitionBy(key)
    placed = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_last": F.count("*").over(w) - 1})
    if n == 1:
        return placed.where(F.col("_i") == F.floor((F.col("_last") + 1) / 2)).drop("_i", "_last")
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * F.col("_last") / (n - 1)).cast("long"))
    return placed.where((F.col("_last") < n) | F.array_contains(picks, F.col("_i"))).drop("_i", "_last")


def best_then_rest(df: DataFrame, key: str, order: list[str], buckets: int, most: int, score: Column) -> DataFrame:
    """Of each key's rows, in order and cut into equal buckets (larger ones first), the best of each bucket, then the best of the rest up to `most` rows; keys with no more rows keep all. Adds bucket (from 0) and filled.

    Ties go to the earlier row. Places come from one numbering of all rows, and each bucket's best and each key's best few are found before rows are shuffled, so a hot key needs no task of its own.
    """
    at, _ = numbered(df.where(F.col(key).isNotNull()), [key, *order], "_at")
    sizes = at.groupBy(key).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    rows = at.join(sizes, key).withColumns({"_k": F.col("_at") - F.col("_first"), "_each": F.floor(F.col("_n") / buckets), "_more": F.col("_n") % buckets, "_score": score})
    wide = F.col("_more") * (F.col("_each") + 1)
    bucket = F.when(F.col("_k") < wide, F.floor(F.col("_k") / (F.col("_each") + 1))).otherwise(F.col("_more") + F.floor((F.col("_k") - wide) / F.greatest(F.col("_each"), F.lit(1))))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    best = rows.groupBy(key, "bucket").agg(F.max_by("_at", F.struct("_score", -F.col("_at"))).alias("_at"))
    chosen, rest = rows.join(best.select("_at"), "_at", "left_semi"), rows.join(best.select("_at"), "_at", "left_anti")
    own = Window.partitionBy(key).orderBy(F.desc("_score"), "_at")
    held = best.groupBy(key).agg(F.count("*").alias("_held"))
    more = rest.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= most).join(held, key).where((F.col("_rank") + F.col("_held") <= most) | (F.col("_n") <= most))
    columns = [*df.columns, "bucket"]
    return chosen.select(*columns, F.lit(False).alias("filled")).unionByName(more.select(*columns, F.lit(True).alias("filled")))
