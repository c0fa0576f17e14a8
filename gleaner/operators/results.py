"""Results of a task: groups in order, filters, subsets, links to try again, steps to take.

A result has status, collection, filepath, warnings (array of code, message, step), stage, links. Items of a group stay rows: a group may hold most results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gleaner.functions.text import first_nonempty, trimmed
from gleaner.operators.order import first_seen

FAILURE, NONE = "failure", "未分类"


def group_key(status: Column, collection: Column, filepath: Column) -> Column:
    """`failure`; else the collection, else the folder that the file is in."""
    parts = F.filter(F.split(trimmed(filepath), r"[/\\]+"), lambda p: p != "")
    folder = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))
    return F.when(F.coalesce(status == "failed", F.lit(False)), FAILURE).otherwise(first_nonempty(collection, folder, F.lit(NONE)))


def result_link(*links: Column | str) -> Column:
    """The first link that is not empty, null without any."""
    return F.nullif(first_nonempty(*links), F.lit(""))


def warning_codes(warnings: Column, comment_code: Column) -> Column:
    """A result's different codes, that of its comments first."""
    codes = F.transform(F.coalesce(warnings, F.array().cast("array<struct<code:string,message:string,step:string>>")), lambda w: trimmed(w["code"]))
    return F.filter(F.array_distinct(F.concat(F.array(trimmed(comment_code)), codes)), lambda c: c != "")


def by_size() -> WindowSpec:
    """The order of groups, of which there is one row each."""
    return Window.orderBy(F.when(F.col("group") == FAILURE, 0).otherwise(1), F.desc("n_items"), F.collate("group", "zh"))


def groups(results: DataFrame) -> DataFrame:
    """group, n_items, n_links, n_warned, place: failures first, then large groups, then by name. One row a group."""
    g = results.groupBy("group").agg(F.count("*").alias("n_items"), F.countDistinct("link").alias("n_links"), F.count_if(F.size("warnings") > 0).alias("n_warned"))
    return g.withColumn("place", F.row_number().over(by_size()))


def in_order(results: DataFrame) -> DataFrame:
    """The results with the place of their group, sorted by it, then (but for failures) by warnings, then by label as Chinese readers expect."""
    sizes = results.groupBy("group").agg(F.count("*").alias("n_items"))
    placed = results.join(sizes.withColumn("group_place", F.row_number().over(by_size())).drop("n_items"), "group")
    weight = F.when(F.col("group") == FAILURE, 0).otherwise(-F.size("warnings"))
    return placed.withColumn("weight", weight).orderBy("group_place", "weight", F.collate("label", "zh"))


def visible(results: DataFrame, group: str = "all", code: str = "", stage: str = "") -> DataFrame:
    """Results that pass all filters: `all`, `warnings` or one group; a warning's code; a stage of failure. Empty filters pass everything."""
    if group == "warnings":
        results = results.where(F.size("warnings") > 0)
    elif group != "all":
        results = results.where(F.col("group") == group)
    if code:
        results = results.where(F.array_contains("codes", code))
    return results.where(F.col("stage") == stage) if stage else results


def needs_retry(status: Column, manual: Column, codes: Column, link: Column) -> Column:
    """Failed, or waiting for somebody's action, or with an incomplete list of comments; and it has a link."""
    comment = F.exists(codes, lambda c: c.startswith("comment_"))
    return link.isNotNull() & F.coalesce((status == "failed") | manual | comment, F.lit(False))


def distinct_links(results: DataFrame, order: list[str]) -> DataFrame:
    return first_seen(results.where("link is not null").select("link", *order), ["link"], order)


def distinct_warnings(results: DataFrame, order: list[str]) -> DataFrame:
    """The different (code, message, step) of all results, with where each was first."""
    each = results.select(*order, F.posexplode("warnings").alias("at", "w"))
    none = F.lit("")
    each = each.select(*order, "at", *(F.coalesce(F.col(f"w.{c}"), none).alias(c) for c in ("code", "message", "step")))
    return first_seen(each, ["code", "message", "step"], [*order, "at"])


def subsets(results: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How many results are in each of several overlapping subsets, in one pass."""
    return results.agg(*(F.count_if(F.coalesce(f, F.lit(False))).alias(name) for name, f in flags.items()))


def next_steps(results: DataFrame, category: Column, steps: list[tuple[str, str]], most: int = 6) -> DataFrame:
    """(place, step) for the categories that results have, in the order of steps; {n} is a category's count; a text counts once and `most` of them stay."""
    counts = results.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
    spark = results.sparkSession
    known = spark.createDataFrame([(k, c, t) for k, (c, t) in enumerate(steps)], "k int, category string, t string")
    texts = known.join(counts, "category").select("k", F.replace("t", F.lit("{n}"), F.col("n").cast("string")).alias("step"))
    return first_seen(texts, ["step"], ["k"]).withColumn("place", F.row_number().over(Window.orderBy("k"))).where(F.col("place") <= most).select("place", "step")


def newest(history: DataFrame, at: list[str], most: int = 8) -> DataFrame:
    """The newest rows of a history; ties by the other columns of `at`."""
    return history.orderBy(*(F.desc(c) for c in at)).limit(most)


def output_folder(results: DataFrame, explicit: str = "", otherwise: str = "") -> DataFrame:
    """One row: the folder that was named, else the only one that results which did not fail are in, else the configured one."""
    folder = F.regexp_extract("filepath", r"^(.*)[/\\][^/\\]*$", 1)
    ends = results.where((F.coalesce(F.col("status"), F.lit("")) != "failed") & (trimmed("filepath") != "")).agg(F.min(folder).alias("a"), F.max(folder).alias("z"))
    return ends.select(F.when(F.lit(explicit) != "", explicit).when(F.col("a") == F.col("z"), F.col("a")).otherwise(otherwise).alias("folder"))
