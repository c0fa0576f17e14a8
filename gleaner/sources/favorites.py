"""Pages of a collection of favorites, resumed where an export stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import first_nonempty, trimmed
from gleaner.functions.urls import detect_source

PAGE = "data array<struct<created_time:double,content:struct<id:string,type:string,url:string,title:string,created_time:double,question:struct<title:string>>>>, paging struct<is_end:boolean,next:string,totals:long>"


def pages_of(raw: DataFrame) -> DataFrame:
    """(page, items, has_more, next_offset, totals) from pages (page, body: JSON). A body that is no JSON has no items."""
    p = raw.select("page", F.from_json("body", PAGE).alias("p"))
    item = lambda x: F.struct(trimmed(x["content"]["id"]).alias("id"), trimmed(x["content"]["type"]).alias("type"), trimmed(x["content"]["url"]).alias("url"), first_nonempty(x["content"]["title"], x["content"]["question"]["title"]).alias("title"), F.coalesce(F.nullif(x["created_time"], F.lit(0.0)), x["content"]["created_time"], F.lit(0.0)).alias("created"))
    offset = F.regexp_extract(trimmed("p.paging.next"), r"[?&]offset=(\d+)", 1).try_cast("long")
    items = F.coalesce(F.transform("p.data", item), F.array().cast("array<struct<id:string,type:string,url:string,title:string,created:double>>"))
    return p.select("page", items.alias("items"), F.coalesce(~F.col("p.paging.is_end"), F.lit(True)).alias("has_more"), F.coalesce(offset, F.lit(0)).alias("next_offset"), F.coalesce("p.paging.totals", F.lit(0)).alias("totals"))


def checked(items: DataFrame) -> DataFrame:
    """Entries (id, url) with their source and what is wrong with them (null: nothing)."""
    i, u = trimmed("id"), trimmed("url")
    source = detect_source(u)
    error = (
        F.when(i == "", "missing favorite item id").when(u == "", F.concat(F.lit("favorite item "), i, F.lit(" is missing url")))
        .when(~source.isin("zhihu_article", "zhihu_answer"), F.concat(F.lit("favorite item "), i, F.lit(" has unsupported url: "), u))
    )
    return items.withColumns({"id": i, "url": u, "source_type": source, "error": error})


def to_export(pages: DataFrame, exported: DataFrame, from_page: int = 0) -> DataFrame:
    """Good entries of the pages from one on, up to the first that has nothing after it, that are not exported yet, each id once."""
    ended = F.coalesce(F.max((~F.col("has_more")).cast("int")).over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a page
    open_ = pages.where(F.col("page") >= from_page).select("page", "items", ended.alias("_ended")).where("_ended = 0")
    good = checked(open_.select("page", F.posexplode("items").alias("place", "x")).select("page", "place", "x.id", "x.url")).where("error is null")
    first = good.groupBy("id").agg(F.min_by(F.struct("page", "place", "url", "source_type"), F.struct("page", "place")).alias("x")).select("id", "x.*")
    return first.join(exported.select("id"), "id", "left_anti")
