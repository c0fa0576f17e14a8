"""The engine's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dates, text, urls
from gleaner.operators import comments, folds, joins, order, reports, selection, status, windows
from gleaner.plans import cases, content, fields, files, rules, runs, shapes, stores  # noqa: F401
from gleaner.streaming import inbox
from gleaner.tables import new_path

KEYWORDS = {"english": ["the", "that", "with", "was", "thing"], "german": ["und", "nicht", "keit", "sch"], "french": ["eau", "ment", "que", "avec"], "spanish": ["cion", "ado", "para", "los"]}
HOUR = 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as inbox items: a user's events of one type have one link."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", dates.epoch(F.col("ts")).alias("timestamp"), F.concat(F.lit("https://inbox.example.com/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("url"), "event_type")


def inbox_dedup(spark, sf_dir):
    return order.first_seen(items(spark, sf_dir), ["url"], ["ts", "event_id"]).select("url", "event_id")


def _two_batches(spark, sf_dir):
    rows, cut = items(spark, sf_dir), F.lit("2024-01-02 00:00:00").cast("timestamp")
    return rows.where(F.col("ts") >= cut), rows.where(F.col("ts") < cut)


def inbox_append_known(spark, sf_dir):
    incoming, stored = _two_batches(spark, sf_dir)
    return order.new_rows(incoming, stored, ["url"], ["ts", "event_id"]).select("url", "event_id")


def inbox_append_counts(spark, sf_dir):
    incoming, stored = _two_batches(spark, sf_dir)
    return order.append_counts(incoming, order.new_rows(incoming, stored, ["url"], ["ts", "event_id"]))


def inbox_sync(spark, sf_dir):
    """The central flow: items of the last ten days, new links alone, by month and type."""
    incoming, stored = _two_batches(spark, sf_dir)
    since = dates.window_since(F.lit("2024-01-12 18:20:00").cast("timestamp"), value=10, unit="day")
    new = order.new_rows(incoming.where(dates.since_filter(F.col("timestamp"), since)), stored, ["url"], ["ts", "event_id"])
    return new.groupBy(dates.month(F.col("ts")).alias("month"), "event_type").agg(F.count("*").alias("added"), F.min("event_id").alias("first_event"))


def window_filter(spark, sf_dir):
    """Two calendar months back from a fixed day."""
    since = dates.window_since(F.lit("2024-03-15 06:30:00").cast("timestamp"), preset="2m")
    return items(spark, sf_dir).where(dates.since_filter(F.col("timestamp"), since)).select("event_id", "event_type")


def month_archive(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy").alias("year"), dates.month(F.col("o_orderdate")).alias("year_month")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def high_water_mark(spark, sf_dir):
    return items(spark, sf_dir).agg(F.max("ts").alias("mark"), F.count("*").alias("n_pulled"))


#: One link of every class, and links that look like one.
NAMED = ["https://www.xiaohongshu.com/explore/abc1", "https://xiaohongshu.com/discovery/item/9?x=1", "https://xiaohongshu.com/user/9", "https://mp.weixin.qq.com/s/Xy", "https://zhuanlan.zhihu.com/p/12345", "https://zhuanlan.zhihu.com/p/x", "https://www.zhihu.com/question/1/answer/2", "https://zhihu.com/collection/77", "https://blog.csdn.net/u/article/details/123", "https://evilzhihu.com/collection/77", "not a link"]


def url_source_detect(spark, sf_dir):
    named = spark.createDataFrame([(-k, u) for k, u in enumerate(NAMED, 1)], "page_id long, url string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").union(named)
    return pages.select("page_id", urls.detect_source(F.col("url")).alias("source"))


def url_distinct(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return order.first_seen(pages, ["host"], ["page_id"])


def html_article(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.page_title(F.col("html")).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?i)<a href="), F.lit(0))).alias("n_links"))


def _matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = joins.contains_join(table(spark, sf_dir, "benchmark"), docs, "item_id", "text", "doc_id", "text")
    return found.join(docs.select("doc_id", "source"), "doc_id").groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "src0").alias("n_total"), F.min("doc_id").alias("first_doc"))


def library_verify(spark, sf_dir):
    """Which passages of `benchmark` are in documents; src0 stands for the library that has everything."""
    c = table(spark, sf_dir, "benchmark").select("item_id").join(_matches(spark, sf_dir), "item_id", "left")
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("n_total", F.lit(0))
    return c.select("item_id", n.alias("match_count"), (t > 0).alias("has_total"), (n > t).alias("has_classified"), "first_doc")


def verify_summary(spark, sf_dir):
    v = library_verify(spark, sf_dir)
    return v.agg(F.count("*").alias("candidates"), F.count_if(F.col("has_total") & F.col("has_classified")).alias("ok_both"), F.count_if(~F.col("has_total")).alias("missing_total"), F.count_if(~F.col("has_classified")).alias("missing_classified"))


def classify_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.best_category(text.text_of("text"), KEYWORDS, "unclassified").alias("category"))


def clean_text(spark, sf_dir):
    t = text.text_of("text")
    line = F.substring_index(t, "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.squeezed(t)).alias("squeezed_md5"), text.safe_name(line, 40).alias("name"), text.clean_date(t).rlike(r"^\d{4}-\d{2}-\d{2}$").alias("has_date"), F.size(text.urls_in(t)).alias("n_urls"))


def term_rank(spark, sf_dir):
    return reports.rank_sentences(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "rank", F.md5("sentence").alias("sentence_md5"), "score")


def status_report(spark, sf_dir):
    t = F.col("event_type")
    return reports.status_counts(table(spark, sf_dir, "events"), t.isin("purchase", "signup"), t == "error")


def warning_histogram(spark, sf_dir):
    """Codes of an event: its type, and `high` for a value over 50; each once."""
    codes = F.array_compact(F.array(F.col("event_type"), F.when(F.col("value") > 50, "high"), F.col("event_type")))
    return reports.code_histogram(table(spark, sf_dir, "events"), codes)


def result_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error").cast("int")
    return e.groupBy("event_type").agg(F.count("*").alias("n_items"), F.countDistinct("user_id").alias("n_links"), F.count_if(F.col("value") > 50).alias("n_warnings"), F.max(failed).alias("is_failure"))


def facets(spark, sf_dir):
    """Counts of one filter's choices under the others: warnings within a group, groups within warnings."""
    warned = F.col("value") > 50
    kinds = ("click", "error", "purchase", "signup", "view")
    return reports.facet_counts(table(spark, sf_dir, "events"), {"all": F.lit(True), "warnings": warned, "error_warnings": warned & (F.col("event_type") == "error")} | {f"warned_{k}": warned & (F.col("event_type") == k) for k in kinds})


def _comments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "user", 0).otherwise(1)
    return c.select(F.col("conv_id").alias("note_id"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.lit("").alias("root_id"), F.when(level > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1)).otherwise("").alias("parent_id"), level.alias("level"), F.col("role").alias("author"), F.col("text").alias("content"), (F.col("role") == "assistant").alias("is_author"))


def comment_select(spark, sf_dir):
    return comments.useful(_comments(spark, sf_dir)).select(F.col("note_id").alias("conv_id"), F.col("seq").alias("turn"), "place")


def comment_threads(spark, sf_dir):
    t = comments.threads(comments.useful(_comments(spark, sf_dir)))
    return t.select(F.col("note_id").alias("conv_id"), "thread", "n_lines", F.md5("lines").alias("lines_md5"))


def comment_merge(spark, sf_dir):
    """The first half of each text of turns up to 4, then the whole text of turns from 2 on, read of one comment."""
    c = _comments(spark, sf_dir)
    early = c.where("seq <= 4").withColumn("content", F.expr("substring(content, 1, cast(length(content) / 2 as int))")).withColumns({"date": F.lit("05-01"), "like_count": F.col("seq"), "reply_count": F.lit(1), "order": F.col("seq")})
    late = c.where("seq >= 2").withColumns({"date": F.lit("2024-05-01"), "like_count": 10 - F.col("seq"), "reply_count": F.lit(0), "order": F.col("seq") + 1000})
    m = comments.merged(early.union(late), order="order")
    return m.select(F.col("note_id").alias("conv_id"), "comment_id", F.md5("content").alias("content_md5"), "date", F.col("like_count").cast("long").alias("like_count"), "reply_count", "is_author", "n_readings")


def _series(spark, sf_dir, kind, name):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{name}_id"), dates.epoch(F.col("ts")).alias(f"{name}_at"), "value")


def _spans(spark, sf_dir, kind, name):
    from pyspark.sql import Window

    s = _series(spark, sf_dir, kind, name)
    end = F.lead(f"{name}_at").over(Window.partitionBy("user_id").orderBy(f"{name}_at", f"{name}_id"))
    return s.select("user_id", f"{name}_id", F.col(f"{name}_at").alias(f"{name}_start"), end.alias(f"{name}_end")).where(f"{name}_end is not null")


def interval_bind(spark, sf_dir):
    """Purchases in the spans between a user's signups; those in none have a null span."""
    j = joins.points_in_intervals(_series(spark, sf_dir, "purchase", "shot").drop("value"), _spans(spark, sf_dir, "signup", "chapter"), "user_id", "shot_at", "chapter_start", "chapter_end", 48 * HOUR, "left")
    return j.select("shot_id", "chapter_id")


def interval_overlap(spark, sf_dir):
    """Spans between views that overlap the two hours around an error."""
    w = _series(spark, sf_dir, "error", "window").select("user_id", "window_id", (F.col("window_at") - HOUR).alias("window_start"), (F.col("window_at") + HOUR).alias("window_end"))
    j = joins.overlapping(w, _spans(spark, sf_dir, "view", "segment"), "user_id", ("window_start", "window_end"), ("segment_start", "segment_end"), 24 * HOUR)
    return j.select("window_id", "segment_id")


def nearest_event(spark, sf_dir):
    j = joins.nearest(_series(spark, sf_dir, "purchase", "shot"), _series(spark, sf_dir, "click", "segment"), "user_id", "shot_id", "shot_at", "segment_id", "segment_at")
    return j.select("shot_id", "segment_id")


def _shots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    edges = e.groupBy("user_id").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return e.where("event_type = 'view'").select("user_id", "event_id", at.alias("at"), "value").join(edges, "user_id")


def caption_window(spark, sf_dir):
    w = windows.caption_windows(_shots(spark, sf_dir), "user_id", "at", ["at", "event_id"], F.col("first"), F.col("last"))
    return w.select("event_id", "window_start", "window_end")


def bucket_best(spark, sf_dir):
    return windows.best_of_buckets(_shots(spark, sf_dir), "user_id", ["at", "event_id"], 4, F.desc("value"), F.col("at"), F.col("event_id")).select("user_id", "bucket", "event_id")


def downsample(spark, sf_dir):
    return windows.even_sample(_shots(spark, sf_dir), "user_id", ["at", "event_id"], 5).select("user_id", "event_id")


def greedy_merge(spark, sf_dir):
    """The words of a conversation's turns stand for the pieces of a transcript."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(text.squeezed("text"), " ")).alias("at", "word"))
    c = c.withColumns({"end": F.col("turn"), "place": F.col("turn") * 1_000_000 + F.col("at")})
    m = folds.merge_segments(c, "conv_id", "place", F.col("word"), "turn", "end", 80, 8)
    return m.select("conv_id", F.col("turn").alias("first_turn"), F.col("end").alias("last_turn"), "n", F.md5("text").alias("text_md5"))


def scene_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    b = e.select(F.col("user_id").alias("chapter"), F.col("event_id").alias("id"), at.alias("at"), F.col("event_type").alias("title"), F.concat("event_type", F.lit(":"), F.floor("value").cast("string")).alias("path"), (at - 60).alias("window_start"), (at + 60).alias("window_end"), F.floor("value").cast("double").alias("score"))
    return folds.scene_cards(b, 12 * HOUR).select("chapter", "title", F.col("at").alias("shown_at"), "window_start", "window_end", "n_blocks")


def latest_version(spark, sf_dir):
    """Of each order's line numbers the last version, then of each order the newest of those."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey")
    versions = order.last_seen(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"])
    newest = F.max_by(F.struct("l_linenumber", "l_partkey"), F.struct("l_shipdate", "l_linenumber")).alias("x")
    return versions.groupBy("l_orderkey").agg(newest, F.count("*").alias("n_versions")).select("l_orderkey", "x.*", "n_versions")


def quality_report(spark, sf_dir):
    return reports.quality(table(spark, sf_dir, "documents"), "source", F.col("text"), F.length("text"), 1500.0)


def stream_dedup(spark, sf_dir):
    """inbox_dedup by a stream that takes in all there is and stores new links alone."""
    at = new_path(spark, "inbox")
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.select("event_id", "ts", F.concat(F.lit("https://inbox.example.com/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("url"))
    inbox.collect_available(rows, f"{at}/items", f"{at}/progress", ["url"], ["ts", "event_id"])
    return inbox.stored(spark, f"{at}/items", rows.schema).select("url", "event_id")


#: What went wrong, one message of every kind, and one of none.
MESSAGES = ["connect ECONNREFUSED 127.0.0.1:9222", "请输入验证码", "code 300011", "login required", "error_code=300031 x", "comment list incomplete", "comment fetch failed", "vision ocr broke", "Summary step FAILED", "No xiaohongshu tab found", "something else", ""]


def _failures(spark, sf_dir):
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", message.alias("message"), F.when(F.col("value") > 90, "captcha").alias("reason"), F.when(F.col("value") < 5, "comment_incomplete").alias("warning"))


def failure_stages(spark, sf_dir):
    f = _failures(spark, sf_dir)
    return f.groupBy(status.failure_stage(F.col("message"), F.col("reason"), F.col("warning")).alias("stage")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def task_errors(spark, sf_dir):
    f = _failures(spark, sf_dir).select("event_id", status.task_error(F.col("message")).alias("e")).select("event_id", "e.*")
    return f.groupBy("code", "retriable", "allow_write", "allow_fallback").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def recent_candidates(spark, sf_dir):
    """The last 500 items, then those of two types, then the first of each link."""
    return selection.recent(items(spark, sf_dir), ["ts", "event_id"], 500, F.col("event_type").isin("purchase", "click"), ["url"]).select("url", "event_id")


def version_places(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    version = F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("-"), F.format_string("%02d", F.day("o_orderdate") % 3), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("-"), (k % 4).cast("string"))))
    v = selection.ranked_versions(o.select("o_custkey", "o_orderkey", version.alias("version")), "o_custkey", "version", ["o_orderkey"])
    return v.select("o_custkey", "version", "o_orderkey", "place")


def review_select(spark, sf_dir):
    """A third of the conversations keep turns two and one, a third has no choice, a third chose what is not there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    k = F.col("conv_id") % 3
    chosen = c.select("conv_id").distinct().select("conv_id", F.when(k == 0, F.array(F.lit(2), F.lit(1))).when(k == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(999))).alias("positions"))
    return selection.at_positions(c, "conv_id", ["turn"], chosen).select("conv_id", "turn", "place")


def sampling_points(spark, sf_dir):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    u = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(at) - F.min(at)).cast("double").alias("duration"), selection.chapter_count(F.count("*")).alias("n"))
    return u.select("user_id", "n", F.posexplode(selection.sampling_points(F.col("duration"), F.col("n"))).alias("at", "point"))


def mirror_targets(spark, sf_dir):
    """Every document goes to a root for all and to one for its language; repeated targets count once."""
    target = lambda root, name: F.struct(F.lit(root).alias("root"), name.alias("collection"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.text_of("lang").alias("lang"))
    return selection.fan_out(docs, F.array(target("all", F.lit("documents")), target("by-language", F.col("lang")), target("all", F.lit("documents")))).select("doc_id", "root", "collection")


def link_sets(spark, sf_dir):
    """Whether a user's kinds of events of high and of low value are the same."""
    high = F.coalesce(F.col("value") > 50, F.lit(False))
    return selection.same_sets(table(spark, sf_dir, "events"), "user_id", "event_type", high, ~high)


def document_urls(spark, sf_dir):
    """The different links of each document, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array_distinct(text.urls_in("text"))).alias("place", "url"))


QUERIES = {
    f.__name__: f
    for f in (
        inbox_sync, inbox_dedup, inbox_append_known, inbox_append_counts, window_filter, month_archive, high_water_mark, url_source_detect, url_distinct, html_article, library_verify, verify_summary, classify_keywords, clean_text, term_rank,
        status_report, warning_histogram, result_groups, facets, comment_select, comment_threads, comment_merge, interval_bind, interval_overlap, nearest_event, caption_window, bucket_best, downsample, greedy_merge, scene_merge, latest_version, quality_report, stream_dedup,
        failure_stages, task_errors, recent_candidates, version_places, review_select, sampling_points, mirror_targets, link_sets, document_urls,
    )
}
QUERIES |= cases.QUERIES
