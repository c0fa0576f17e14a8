"""Pulls of pushes in five modes, with caps on pages and items, and what a sync reports of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import trimmed

MODES = ("latest", "all", "bootstrap", "recent", "window")


def mode_of(name: Column) -> Column:
    """A known mode, else `latest`."""
    return F.when(name.isin(*MODES), name).otherwise("latest")


def positive_integer(x: Column) -> Column:
    """The whole part of a positive number, given as number or text; 0 for all else."""
    n = x.cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (n <= 0) | (F.abs(n) == float("inf")), F.lit(0)).otherwise(F.floor(n)).cast("long")


def since_of(mode: Column, mark: Column, window_since: Column) -> Column:
    """From which second on a mode pulls: the mark, the window's beginning, or everything."""
    return F.when(mode.isin("all", "bootstrap", "recent"), F.lit(0.0)).when(mode == "window", window_since).otherwise(F.coalesce(mark, F.lit(0.0)))


def window_label(preset: Column, value: Column, unit: Column) -> Column:
    """The name of a look-back window; empty for one that is not valid."""
    known, n, unit = F.lower(trimmed(preset)), positive_integer(value), F.lower(trimmed(unit))
    days = F
    for name, label in (("today", "今天"), ("7d", "最近 7 天"), ("30d", "最近 30 天"), ("60d", "最近 60 天"), ("2m", "最近 2 个月")):
        days = days.when(known == name, label)
    for name, label in (("day", " 天"), ("month", " 个月"), ("year", " 年")):
        days = days.when((n > 0) & (unit == name), F.concat(F.lit("最近 "), n.cast("string"), F.lit(label)))
    return days.otherwise("")


#: A pull: its mode, from which second on, and its most pages and items (0: no cap).
PULL = "mode string, since double, max_pages long, max_items long"


def pulled(pushes: DataFrame, pulls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pushes (page, place, modified, url or null) that each of some pulls (PULL; a handful, each mode once) sees, and the pages of each (mode, page, page_no, items before it). All pulls go in one pass.

    A pull's pages are those with a push changed after `since`. They come in order until max_pages are fetched; with max_items a pull ends right after the push that gives the last item. Pages are
    counted one row each; within a page, which the source bounds, pushes are counted in order.
    """
    is_item = F.col("url").isNotNull().cast("long")
    each = pushes.select("page", "place", "modified", "url").join(F.broadcast(pulls), F.col("modified") > F.col("since"))  # a pull is a mode, of which there are five
    in_order = Window.partitionBy("mode").orderBy("page")
    pages = each.groupBy("mode", "page").agg(F.sum(is_item).alias("items"))
    pages = pages.withColumns({"page_no": F.row_number().over(in_order), "before": F.coalesce(F.sum("items").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    here = F.sum(is_item).over(Window.partitionBy("mode", "page").orderBy("place"))
    seen = each.join(pages.select("mode", "page", "page_no", "before"), ["mode", "page"]).where(F.col("page_no") <= F.col("max_pages")).withColumn("_upto", F.col("before") + here)
    return seen.where((F.col("max_items") == 0) | (F.col("_upto") - is_item < F.col("max_items"))).drop("_upto", "before"), pages


def synced(pushes: DataFrame, stored: DataFrame, pulls: DataFrame) -> DataFrame:
    """A row for each pull: what a sync in this mode adds and skips, the next mark, whether the mark moves on, and its warnings.

    The mark is the greatest time of all pushes that were seen, those without a link too. It stays after a truncated pull and in modes that look back. A pull that sees nothing adds nothing and keeps its mark.
    """
    seen, pages = pulled(pushes, pulls)
    fetched = seen.groupBy("mode").agg(F.count("url").alias("total"), F.max("modified").alias("top"), F.max("page_no").alias("fetched"))
    added = seen.where("url is not null").select("mode", "url").distinct().join(stored.select("url").distinct(), "url", "left_anti").groupBy("mode").agg(F.count("*").alias("added"))
    whole = pages.groupBy("mode").agg(F.max("page_no").alias("n_pages"))
    row = pulls.join(fetched, "mode", "left").join(added, "mode", "left").join(whole, "mode", "left").fillna(0, ["total", "fetched", "added", "n_pages"])
    capped = (F.col("max_items") > 0) & (F.col("total") >= F.col("max_items"))
    paged = ~capped & (F.col("n_pages") > F.col("max_pages"))
    warning = F.when(capped, F.concat(F.lit("Pull capped at maxItems="), "max_items", F.lit("."))).when(paged, F.concat(F.lit("Pull reached maxPages="), "max_pages", F.lit("."))).otherwise("")
    truncated = capped | paged
    return row.select(
        "mode", "since", "added", (F.col("total") - F.col("added")).alias("skipped"), "total", F.greatest("since", "top").alias("next_modified"), F.col("fetched").cast("long").alias("pages_fetched"), truncated.alias("truncated"),
        (~truncated & ~F.col("mode").isin("recent", "window")).alias("state_advanced"), warning.alias("warning"), F.when(truncated & (F.col("mode") != "recent"), "Result was truncated, so the mark was not advanced.").otherwise("").alias("state_warning"),
    )
