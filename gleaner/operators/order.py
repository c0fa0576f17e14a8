"""Order-aware distinct, append and ranking. Rows carry their order; no operator trusts the order of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, which combines before it shuffles, so a key with a third of all rows is no hot partition."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(df.columns)


def last_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(df.columns)


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What an append adds: the first row of each key that is not stored yet."""
    return first_seen(incoming, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")


def append_counts(incoming: DataFrame, added: DataFrame) -> DataFrame:
    """added, skipped: one row."""
    both = incoming.agg(F.count("*").alias("n")).crossJoin(added.agg(F.count("*").alias("added")))  # two single rows
    return both.select("added", (F.col("n") - F.col("added")).alias("skipped"))


def top(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
