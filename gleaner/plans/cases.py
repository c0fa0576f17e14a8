"""Queries over results, links, notes and captions, each with its SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import links
from gleaner.functions.dates import epoch
from gleaner.operators import captions, order, results, windows
from gleaner.sources import replies
from gleaner.streaming import sync

QUERIES, SQL = {}, {}
NOW = "2026-01-01 00:00:00"


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# --- sync

MODES = [("latest", 1704153600.0, 6, 0), ("all", 0.0, 8, 0), ("bootstrap", 0.0, 1000000, 0), ("recent", 0.0, 50, 300), ("window", 1704240000.0, 1000000, 0)]


@query(f"""
WITH m(mode, since, max_pages, max_items) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE, {c}, {d})" for a, b, c, d in MODES)}),
e AS (SELECT event_id, event_id // 500 AS page, event_id % 500 AS place, epoch_us(ts) / 1e6 AS modified, CASE WHEN event_type <> 'error' THEN 'https://inbox.example.com/' || user_id || '/' || event_type END AS url FROM events),
p AS (SELECT m.*, e.*, (url IS NOT NULL)::INT AS item, dense_rank() OVER (PARTITION BY mode ORDER BY page) AS page_no FROM e, m WHERE modified > since),
r AS (SELECT *, sum(item) OVER (PARTITION BY mode ORDER BY page, place) AS upto FROM p WHERE page_no <= max_pages),
s AS (SELECT * FROM r WHERE max_items = 0 OR upto - item < max_items),
t AS (SELECT mode, since, max_items, max_pages, count(url) AS total, max(modified) AS top, max(page_no) AS fetched, count(DISTINCT url) FILTER (WHERE url NOT IN (SELECT url FROM e WHERE event_id % 7 = 0 AND url IS NOT NULL)) AS added FROM s GROUP BY ALL),
u AS (SELECT *, (SELECT max(page_no) FROM p WHERE p.mode = t.mode) AS pages, max_items > 0 AND total >= max_items AS capped FROM t),
v AS (SELECT *, capped OR pages > max_pages AS cut FROM u)
SELECT mode, since, added, total - added AS skipped, total, greatest(since, top) AS next_modified, fetched AS pages_fetched, cut AS truncated, NOT cut AND mode NOT IN ('recent', 'window') AS state_advanced,
  CASE WHEN capped THEN 'Pull capped at maxItems=' || max_items || '.' WHEN cut THEN 'Pull reached maxPages=' || max_pages || '.' ELSE '' END AS warning,
  CASE WHEN cut AND mode <> 'recent' THEN 'Result was truncated, so the mark was not advanced.' ELSE '' END AS state_warning
FROM v
""")
def sync_modes(spark, sf_dir):
    """Five syncs of pages of 500 events; errors have no link; every seventh event is stored already."""
    e = events(spark, sf_dir)
    url = F.when(F.col("event_type") != "error", F.concat(F.lit("https://inbox.example.com/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")))
    rows = e.select("event_id", F.floor(F.col("event_id") / 500).alias("page"), (F.col("event_id") % 500).alias("place"), epoch(F.col("ts")).alias("modified"), url.alias("url"))
    return sync.synced(rows, rows.where("event_id % 7 = 0").select("url"), spark.createDataFrame(MODES, sync.PULL))


# --- results


def _results(spark, sf_dir):
    """Events as results: errors failed, an event's type is its folder, its value gives warnings; every eleventh has no link."""
    e, v = events(spark, sf_dir), F.col("value")
    warning = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit("save").alias("step"))
    warned = F.array_compact(F.array(F.when(v > 50, warning("comment_incomplete", "missing")), F.when(v < 5, warning("low", "few")), F.when(v > 90, warning("high", "many"))))
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    path = F.concat(F.lit("/out//"), F.col("event_type"), F.lit("\\"), F.col("event_id").cast("string"), F.lit(".md"))
    link = results.result_link(F.lit(" "), F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string"))))
    rows = e.select("event_id", "value", "user_id", status.alias("status"), results.group_key(status, F.lit(None), path).alias("group"), path.alias("filepath"), warned.alias("warnings"), link.alias("link"), F.concat(F.lit("note "), F.col("user_id").cast("string")).alias("label"))
    return rows.withColumns({"codes": results.warning_codes(F.col("warnings"), F.when(F.col("value") > 95, "comment_login_required")), "stage": F.when(F.col("status") == "failed", F.when(v < 30, "open").otherwise("unknown"))})


RESULTS = """WITH r AS (SELECT event_id, user_id, value, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_type = 'error' THEN 'failure' ELSE event_type END AS grp, event_type,
  CASE WHEN event_id % 11 > 0 THEN 'https://x.example/' || user_id END AS link, coalesce((value > 50)::INT, 0) + coalesce((value < 5)::INT, 0) + coalesce((value > 90)::INT, 0) AS w, CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'open' ELSE 'unknown' END END AS stage FROM events)"""


@query(RESULTS + ", g AS (SELECT grp, count(*) AS n_items, count(DISTINCT link) AS n_links, count(*) FILTER (WHERE w > 0) AS n_warned FROM r GROUP BY 1) SELECT grp AS \"group\", n_items, n_links, n_warned, (row_number() OVER (ORDER BY grp <> 'failure', n_items DESC, grp))::INT AS place FROM g")
def result_group_order(spark, sf_dir):
    return results.groups(_results(spark, sf_dir))


@query(RESULTS + ", g AS (SELECT grp, (row_number() OVER (ORDER BY grp <> 'failure', count(*) DESC, grp))::INT AS group_place FROM r GROUP BY 1) SELECT event_id, group_place, CASE WHEN grp = 'failure' THEN 0 ELSE -w END AS weight FROM r JOIN g USING (grp)")
def result_items_in_order(spark, sf_dir):
    return results.in_order(_results(spark, sf_dir)).select("event_id", "group_place", "weight")


@query(RESULTS + " SELECT event_id, 'high' AS filter FROM r WHERE w > 0 AND value > 90 UNION ALL SELECT event_id, 'open' FROM r WHERE grp = 'failure' AND stage = 'open' UNION ALL SELECT event_id, 'click' FROM r WHERE grp = 'click' AND value > 50")
def result_filters(spark, sf_dir):
    r = _results(spark, sf_dir)
    picks = {"high": ("warnings", "high", ""), "open": ("failure", "", "open"), "click": ("click", "comment_incomplete", "")}
    each = [results.visible(r, *x).select("event_id", F.lit(name).alias("filter")) for name, x in picks.items()]
    return each[0].union(each[1]).union(each[2])


@query(RESULTS + " SELECT link, min(event_id) AS event_id FROM r WHERE link IS NOT NULL AND (status = 'failed' OR value > 50 OR user_id % 10 = 0) GROUP BY link")
def retry_links(spark, sf_dir):
    r = _results(spark, sf_dir)
    return results.distinct_links(r.where(results.needs_retry(F.col("status"), F.col("user_id") % 10 == 0, F.col("codes"), F.col("link"))), ["event_id"])


@query(RESULTS + " SELECT count(*) AS visible, count(*) FILTER (WHERE w > 0) AS analysable, count(*) FILTER (WHERE status = 'failed' AND value < 30) AS browser, count(*) FILTER (WHERE value > 95) AS manual, count(*) FILTER (WHERE link IS NOT NULL AND (status = 'failed' OR value > 50)) AS retryable FROM r")
def action_subsets(spark, sf_dir):
    r = _results(spark, sf_dir)
    login = F.array_contains("codes", "comment_login_required")
    return results.subsets(r, {"visible": F.lit(True), "analysable": F.size("warnings") > 0, "browser": F.col("stage") == "open", "manual": login, "retryable": results.needs_retry(F.col("status"), F.lit(False), F.col("codes"), F.col("link"))})


@query(RESULTS + ", c AS (SELECT (SELECT count(*) FROM r WHERE stage = 'open') AS o, (SELECT count(*) FROM r WHERE stage = 'unknown') AS u, (SELECT count(*) FROM r WHERE stage IS NULL AND value > 90) AS h) SELECT 1 AS place, 'Open ' || o || ' pages again' AS step FROM c UNION ALL SELECT 2, 'Retry' FROM c UNION ALL SELECT 3, 'Read ' || u || ' logs' FROM c UNION ALL SELECT 4, 'Look at ' || h FROM c")
def next_steps(spark, sf_dir):
    steps = [("open", "Open {n} pages again"), ("open", "Retry"), ("gone", "Never"), ("unknown", "Read {n} logs"), ("unknown", "Retry"), ("high", "Look at {n}")]
    return results.next_steps(_results(spark, sf_dir), F.coalesce("stage", F.when(F.col("value") > 90, "high")), steps)


@query("SELECT * FROM (SELECT 'comment_incomplete' AS code, 'missing' AS message, 'save' AS step, min(event_id) FILTER (WHERE value > 50) AS event_id, 0 AS at FROM events UNION ALL SELECT 'low', 'few', 'save', min(event_id) FILTER (WHERE value < 5), 0 FROM events UNION ALL SELECT 'high', 'many', 'save', min(event_id) FILTER (WHERE value > 90), 1 FROM events) WHERE event_id IS NOT NULL")
def distinct_warnings(spark, sf_dir):
    return results.distinct_warnings(_results(spark, sf_dir), ["event_id"]).select("code", "message", "step", "event_id", "at")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def newest_tasks(spark, sf_dir):
    return results.newest(events(spark, sf_dir).select("ts", "event_id", "event_type"), ["ts", "event_id"]).select("event_id", "event_type")


# --- links

@query("SELECT user_id % 50 AS key, min(event_id) AS event_id FROM events GROUP BY 1")
def run_distinct(spark, sf_dir):
    """One row of each note, by its id, whatever its link."""
    e = events(spark, sf_dir)
    url = F.concat(F.when(F.col("event_id") % 2 == 0, "https://www.xiaohongshu.com/explore/").otherwise("https://xiaohongshu.com/discovery/item/"), (F.col("user_id") % 50).cast("string"))
    return order.first_seen(e.select("event_id", links.note_key(url).alias("k")), ["k"], ["event_id"]).select(F.substring("k", 6, 20).cast("long").alias("key"), "event_id")


# --- notes


# --- sources

@query("SELECT conv_id AS note_id, max(turn) + conv_id % 2 AS total, count(*) AS collected, max(turn) + conv_id % 2 <= 0 OR count(*) >= max(turn) + conv_id % 2 AS complete FROM conversations GROUP BY conv_id")
def comment_completeness(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("note_id"), "turn")
    return replies.completeness(c.groupBy("note_id").agg((F.max("turn") + F.col("note_id") % 2).alias("total")), c)


# --- captions


def _spans(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("event_id").alias("chapter"), epoch(F.col("ts")).alias("chapter_start"))
    return e.withColumn("chapter_end", F.lead("chapter_start").over(Window.partitionBy("user_id").orderBy("chapter_start", "chapter"))).where("chapter_end is not null")


SPANS = "WITH c AS (SELECT user_id, event_id AS chapter, epoch_us(ts) / 1e6 AS a, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS z FROM events WHERE event_type = 'signup')"


@query(SPANS + ", s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value FROM events WHERE event_type = 'purchase') SELECT user_id AS video, chapter, arg_max(event_id, round(greatest(0, 1 - abs(t - (a + z) / 2) / (greatest(z - a, 1) / 2)) * 0.42 + coalesce(value, 0) / 100 * 0.30, 9)) AS shot FROM c JOIN s USING (user_id) WHERE z IS NOT NULL AND t BETWEEN a AND z GROUP BY ALL")
def one_to_one_binding(spark, sf_dir):
    """Each span between a user's signups takes the purchase that stands best for it."""
    shots = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("shot"), epoch(F.col("ts")).alias("at"), F.coalesce("value", F.lit(0.0)).alias("value"))
    zero = F.lit(0.0)
    score = captions.chapter_score(F.col("at"), F.col("chapter_start"), F.col("chapter_end"), F.col("value") / 100, zero, zero, zero, F.lit(False))
    met = captions.candidates(shots, _spans(spark, sf_dir), "user_id", 48 * 3600.0)
    return captions.bind_one_to_one(met.select(F.col("user_id").alias("video"), "chapter", "chapter_start", "shot", "at", F.round(score, 9).alias("score")))


@query(SPANS + """, s AS (SELECT user_id, event_id AS segment, epoch_us(ts) / 1e6 AS x, epoch_us(ts) / 1e6 + 600 AS y FROM events WHERE event_type = 'view'),
m AS (SELECT user_id, chapter, segment, x <= z AND y >= a AS meets, abs((x + y) / 2 - (a + z) / 2) AS d FROM c JOIN s USING (user_id) WHERE z IS NOT NULL)
SELECT user_id, chapter, coalesce(arg_min(segment, (d, segment)) FILTER (WHERE meets), arg_min(segment, (d, segment))) AS segment FROM m GROUP BY ALL""")
def representative_segment(spark, sf_dir):
    s = events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("event_id").alias("segment"), epoch(F.col("ts")).alias("segment_start"), (epoch(F.col("ts")) + 600).alias("segment_end"))
    return captions.representative_segments(_spans(spark, sf_dir), s, "user_id", 24 * 3600.0).where("segment is not null")


@query(SPANS + """, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, chapter) AS place FROM c WHERE z IS NOT NULL QUALIFY place <= 5), s AS (SELECT user_id, event_id AS segment, epoch_us(ts) / 1e6 AS x, epoch_us(ts) / 1e6 + 600 AS y FROM events WHERE event_type = 'view'),
m AS (SELECT user_id, chapter, place, segment, x <= z AND y >= a AS meets, abs((x + y) / 2 - (a + z) / 2) AS d FROM f JOIN s USING (user_id)),
r AS (SELECT user_id, chapter, place, coalesce(arg_min(segment, (d, segment)) FILTER (WHERE meets), arg_min(segment, (d, segment))) AS segment FROM m GROUP BY ALL)
SELECT user_id, chapter, segment FROM r QUALIFY row_number() OVER (PARTITION BY user_id, segment ORDER BY place) = 1""")
def chapter_representatives(spark, sf_dir):
    """A segment for each of the first five chapters, none twice."""
    s = events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("event_id").alias("segment"), epoch(F.col("ts")).alias("segment_start"), (epoch(F.col("ts")) + 600).alias("segment_end"))
    return captions.first_representatives(_spans(spark, sf_dir), s, "user_id", 24 * 3600.0)


@query("SELECT conv_id, arg_max(turn, (length(text), -abs(turn - 2), -turn)) AS turn FROM conversations GROUP BY 1")
def key_blocks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return captions.key_blocks(c, "conv_id", F.length("text"), F.col("turn"), F.lit(2), "turn")


@query("""
WITH s AS (SELECT user_id, event_id, epoch(ts)::BIGINT::DOUBLE AS t FROM (SELECT *, date_trunc('second', ts) AS ts0 FROM events) WHERE event_type = 'purchase'),
n AS (SELECT event_id, floor(t) AS t, lag(floor(t)) OVER w AS p, lead(floor(t)) OVER w AS q FROM (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t FROM events WHERE event_type = 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY floor(t), event_id)),
b AS (SELECT *, coalesce((p + t) / 2, t - (q - t) / 2, t - 8) AS a, coalesce((q + t) / 2, t + (t - p) / 2, t + 8) AS z FROM n)
SELECT event_id, CASE WHEN z <= a THEN greatest(0, t - 4) ELSE a END AS window_start, CASE WHEN z <= a THEN t + 4 ELSE z END AS window_end FROM b
""")
def orphan_windows(spark, sf_dir):
    """Windows of screenshots without a chapter."""
    s = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "event_id", F.floor(epoch(F.col("ts"))).cast("double").alias("at"))
    none = F.lit(None).cast("double")
    return windows.caption_windows(s, "user_id", "at", ["at", "event_id"], none, none).select("event_id", "window_start", "window_end")


@query("SELECT a.event_id FROM events a WHERE a.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click' AND (b.event_id % 500 = a.event_id % 500 OR (b.user_id = a.user_id AND floor(b.value) = floor(a.value) AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 36e8 * 4)))")
def unshown_blocks(spark, sf_dir):
    """Views that no click stands for: neither by number, nor by user, value and at most four hours."""
    e = events(spark, sf_dir)
    rows = e.select("event_id", "event_type", (F.col("event_id") % 500).cast("string").alias("path"), F.col("user_id").cast("string").alias("chapter"), F.floor("value").cast("string").alias("title"), (epoch(F.col("ts")) / 3600).alias("at"))
    return captions.not_rendered(rows.where("event_type = 'view'"), rows.where("event_type = 'click'")).select("event_id")
