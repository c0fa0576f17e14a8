"""Queries over rewriting rules, payloads without a known shape, page state, image picks, quotas and versions; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import rules as rewriting
from gleaner.functions import text
from gleaner.operators import comments, windows
from gleaner.plans.cases import events, query
from gleaner.plans.fields import documents, pages, pick, say
from gleaner.sources import payloads, versions
from gleaner.tables import new_path

#: Rules over the tables' words, in order: the third makes what the first would have taken, and the last two take words from the beginning of a text, however many.
TERMS = [rewriting.Rule("the", "THE"), rewriting.Rule("nicht", "NICHT"), rewriting.Rule("ou", "the"), rewriting.Rule(" ([,.])", r"\1")]
PREFIXES = [rewriting.Rule("^(?:the|der|die|das|le|la|les|el|los|and|und|et) ", ""), rewriting.Rule("^[A-Za-zÀ-ÿ]{1,5} ", "")]


@query(r"""
SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, 'the', 'THE'), 'nicht', 'NICHT'), 'ou', 'the'), ' ([,.])', '\1', 'g')) AS text_md5 FROM documents""")
def domain_terms(spark, sf_dir):
    """Whole texts under ordered rules, each once."""
    d = rewriting.rewritten(documents(spark, sf_dir).select("doc_id", "text"), "text", TERMS, "new")
    return d.select("doc_id", F.md5("new").alias("text_md5"))


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '\n', ' ', 'g') AS t, 0 AS passes FROM documents UNION ALL SELECT doc_id, n, passes + 1 FROM (SELECT doc_id, t, passes, regexp_replace(regexp_replace(t, '^(the|der|die|das|le|la|les|el|los|and|und|et) ', ''), '^[A-Za-zÀ-ÿ]{1,5} ', '') AS n FROM d) WHERE n <> t)
SELECT doc_id, md5(arg_max(t, passes)) AS text_md5, CAST(max(passes) AS INTEGER) AS passes FROM d GROUP BY 1""")
def spoken_prefixes(spark, sf_dir):
    """Words are taken from the beginning of a text until none of the rules finds any; one word can bare another."""
    d = documents(spark, sf_dir).select("doc_id", F.replace(text.text_of("text"), F.lit("\n"), F.lit(" ")).alias("text"))
    return rewriting.rewritten(d, "text", PREFIXES, "new", stable=True).select("doc_id", F.md5("new").alias("text_md5"), "passes")


@query(r"""
SELECT conv_id, n, 'c' || conv_id AS cursor, conv_id % 3 = 0 AS has_more, '{"noteId":' || conv_id || ',"userInfo":[{"nickName":"u","deepKey":{"aB":1}}]}' AS renamed FROM (SELECT conv_id, CAST(CASE WHEN conv_id % 9 < 8 THEN count(*) ELSE 0 END AS INTEGER) AS n FROM conversations GROUP BY 1)""")
def comment_payloads(spark, sf_dir):
    """A conversation's turns as a page of comments in one of eight shapes (and one that is none); keys renamed at every depth."""
    k = F.col("conv_id")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("l"))
    more = F.when(k % 3 == 0, pick(k, "true", "1", '"true"')).otherwise(pick(k, "false", "0", '""', "null"))
    inner = lambda name: say('{"', F.lit(name), '": ', "$l", ', "cursor": "c', "$conv_id", '", "has_more": ', more, "}")
    shapes = [say('{"code": 0, "data": ', inner(n), "}") if deep else inner(n) for n, deep in (("comments", True), ("comments", False), ("commentList", True), ("commentList", False), ("items", True), ("items", False), ("list", True), ("list", False), ("others", True))]
    payload = F.element_at(F.array(*shapes), (k % 9 + 1).cast("int"))
    found = turns.select("conv_id", payloads.comment_list(payload).alias("p"), payloads.camel_keys(say('{"note_id": ', "$conv_id", ', "user_info": [{"nick-name": "u", "nickName": "v", "deep_key": {"a_b": 1}}]}')).alias("renamed"))
    return found.select("conv_id", F.coalesce(F.size(F.from_json("p.comments", "array<string>")), F.lit(0)).alias("n"), "p.cursor", "p.has_more", "renamed")


@query(r"""
SELECT page_id, CASE WHEN page_id % 5 < 4 THEN 'n' || page_id END AS id, CASE WHEN page_id % 5 < 4 THEN regexp_extract(html, '<title>([^<]*)', 1) END AS title, CASE WHEN page_id % 5 < 4 THEN 'https://v.example/' || (CASE WHEN page_id % 3 = 0 THEN 'a' WHEN page_id % 3 = 1 THEN 'backup' ELSE 'h265' END) || '/' || page_id END AS video FROM pages""")
def page_states(spark, sf_dir):
    """A state in a page's scripts, with braces and quotes in its strings and undefined values; every fifth page's state doesn't close. Of two codecs the first with an address counts."""
    k = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    quoted = F.regexp_replace(F.to_json(F.struct(title.alias("t"))), r'^\{"t":|\}$', "")
    master = F.when(k % 3 == 0, say('"https://v.example/a/', "$page_id", '"')).otherwise(F.lit("undefined"))
    backup = F.when(k % 3 == 1, say('["https://v.example/backup/', "$page_id", '"]')).otherwise("[]")
    state = say('{"note": {"id": "n', "$page_id", '", "odd": "}{\\"undefined", "title": ', quoted, ', "gone": undefined, "stream": {"h264": [{"masterUrl": ', master, ', "backupUrls": ', backup, '},], "h265": [{"masterUrl": "https://v.example/h265/', "$page_id", '"}]}}', F.when(k % 5 < 4, "}").otherwise(""))
    html = F.concat("html", F.lit("<script>window.__INITIAL_STATE__ = "), state, F.lit(";</script>"))
    s = pages(spark, sf_dir).select("page_id", payloads.page_state("__INITIAL_STATE__")(html).alias("s"))
    at = lambda p: F.get_json_object("s", p)
    return s.select("page_id", at("$.note.id").alias("id"), at("$.note.title").alias("title"), payloads.best_stream(F.col("s"), "$.note.stream", ["h264", "h265"]).alias("video"))


@query("""
WITH RECURSIVE v AS (SELECT user_id, i, list(url ORDER BY s, event_id) AS urls FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS i, CASE event_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS s, event_type || CAST(floor(value / 10) AS BIGINT) AS url FROM events WHERE event_id % 7 > 0) GROUP BY user_id, i),
g AS (SELECT user_id, -1::BIGINT AS i, []::VARCHAR[] AS taken FROM events GROUP BY user_id
  UNION ALL SELECT g.user_id, g.i + 1, CASE WHEN len([u for u in v.urls if NOT list_contains(g.taken, u)]) > 0 THEN list_append(g.taken, [u for u in v.urls if NOT list_contains(g.taken, u)][1]) ELSE g.taken END FROM g JOIN v ON v.user_id = g.user_id AND v.i = g.i + 1)
SELECT user_id, array_to_string(arg_max(taken, i), ',') AS images FROM g GROUP BY user_id""")
def image_picks(spark, sf_dir):
    """A user's events in threes as the variants of an image: of each image the first link, by scene, that no image before has."""
    k = F.col("event_id")
    e = events(spark, sf_dir).where(k % 7 > 0).select("user_id", F.struct("ts", "event_id", pick(k, "x", "first", "second", "y").alias("scene"), F.concat("event_type", F.floor(F.col("value") / 10).cast("string")).alias("url")).alias("e"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("l"))
    # in an image without the scenes variants come by id
    by_id = lambda x: F.array_sort(x, lambda a, b: F.when(a["event_id"] < b["event_id"], -1).otherwise(1))
    items = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3).cast("int")), lambda i: F.transform(by_id(F.slice("l", i * 3 + 1, F.lit(3))), lambda x: F.struct(x["scene"].alias("scene"), x["url"].alias("url"))))
    return rows.select("user_id", F.array_join(payloads.unseen_images(items, ["first", "second"]), ",").alias("images"))


@query("""
WITH e AS (SELECT user_id, event_id, value, ts, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bucket, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, i) = 1 AS best FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, best ORDER BY value DESC, i) AS k FROM b)
SELECT user_id, event_id, CAST(bucket AS INTEGER) AS bucket, NOT best AS filled FROM r WHERE best OR k + least(n, 4) <= 7 OR n <= 7""")
def bucket_quota(spark, sf_dir):
    """Of each user's events the best of four buckets, then the best of the rest up to seven."""
    return windows.best_then_rest(events(spark, sf_dir), "user_id", ["ts", "event_id"], 4, 7, F.col("value")).select("user_id", "event_id", "bucket", "filled")


@query("""
WITH o AS (SELECT *, o_orderkey % 4 AS k FROM orders) SELECT CASE k WHEN 0 THEN '20240115-100000' WHEN 1 THEN '20240115-100000-02' WHEN 2 THEN '20240115-100000-03' ELSE '20240116-090000' END AS version_id, count(*) AS n_rows, min(o_orderkey) AS first_key, CAST(row_number() OVER (ORDER BY CASE WHEN k = 3 THEN 0 ELSE 3 - k END) AS INTEGER) AS place FROM o GROUP BY k""")
def version_store(spark, sf_dir):
    """Four versions of orders, three of them under one time stamp; the newest first, read back from the store."""
    root, orders = new_path(spark, "versions"), spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    for k, base in enumerate(["20240115-100000"] * 3 + ["20240116-090000"]):
        versions.publish(orders.where(F.col("o_orderkey") % 4 == k), root, base)
    out = None
    for place, r in enumerate(versions.manifest(spark, root).collect(), 1):
        one = versions.rows_of(spark, root, r.version_id).agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key")).select(F.lit(r.version_id).alias("version_id"), "n_rows", "first_key", F.lit(place).alias("place"))
        out = one if out is None else out.union(one)
    return out


NOISE = ["蹲", "赞好", "DD", "工具", "没什么特别好说的", "x"]


@query(r"""
WITH c AS (SELECT conv_id % 7 AS note, conv_id * 100 + turn AS seq, role = 'assistant' AS by_author, CASE WHEN conv_id % 7 = 6 AND role = 'user' THEN (['abc def', '来了', 'hello'])[(conv_id + turn) % 3 + 1] || CASE WHEN (conv_id + turn) % 3 = 1 THEN '' ELSE ' ' || turn END WHEN conv_id % 7 = 6 THEN '' WHEN (conv_id + turn) % 2 = 0 THEN (['蹲', '赞好', 'DD', '工具', '没什么特别好说的', 'x'])[(conv_id + turn) // 2 % 6 + 1] ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS t FROM conversations),
n AS (SELECT *, by_author OR contains(t, '工具') OR length(t) >= 18 AS good FROM c WHERE t <> '' AND (by_author OR NOT (t IN ('蹲', '赞好', 'DD', '来了') OR length(t) <= 2))),
m AS (SELECT *, sum(good::INT) OVER (PARTITION BY note) AS k FROM n), s AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY CASE WHEN k > 40 AND NOT by_author THEN 1 ELSE 0 END, seq) AS place FROM m WHERE good OR k = 0)
SELECT note, seq, CAST(place AS INTEGER) AS place FROM s WHERE place <= CASE WHEN k = 0 THEN 20 ELSE 40 END""")
def crowded_comments(spark, sf_dir):
    """Seven notes with hundreds of comments, half of them noise: authors' first, forty at most; one note has nothing but small talk, of which twenty stay."""
    k = F.col("conv_id") + F.col("turn")
    small = F.concat(pick(k, "abc def", "来了", "hello"), F.when(k % 3 == 1, "").otherwise(say(" ", "$turn")))
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    last, user = F.col("conv_id") % 7 == 6, F.col("role") == "user"
    said = F.when(last & user, small).when(last, " ").when(k % 2 == 0, pick(F.floor(k / 2), *NOISE)).otherwise(F.col("text"))
    rows = c.select((F.col("conv_id") % 7).alias("note_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), say("$conv_id", "-", "$turn").alias("comment_id"), F.col("role").alias("author"), said.alias("content"), (F.col("role") == "assistant").alias("is_author"))
    return comments.useful(rows).select(F.col("note_id").alias("note"), "seq", "place")


@query(r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, url FROM (SELECT doc_id, url, min(i) AS i FROM (SELECT doc_id, unnest(['http://a.example/' || lang, 'https://b.example/' || (doc_id % 10), 'http://a.example/' || source]) AS url, generate_subscripts([1, 2, 3], 1) AS i FROM documents) GROUP BY 1, 2)""")
def linked_documents(spark, sf_dir):
    """Links put at the beginning, at the end and around whole texts, one of them twice; punctuation after them goes."""
    t = F.concat(say("see http://a.example/", "$lang", "), and "), text.text_of("text"), say(" or https://b.example/", (F.col("doc_id") % 10).cast("string"), ".; http://a.example/", "$source", ", http://a.example/", "$lang", " "))
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.array_distinct(text.urls_in(t))).alias("place", "url"))


@query(r"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN '2025-' || strftime(ts, '%m-%d') ELSE event_type END AS date, event_id % 4 <> 1 OR ts >= TIMESTAMP '2024-01-15 06:30:00' AS passes FROM events""")
def odd_times(spark, sf_dir):
    """Dates in texts with and without a year; a time filter over times that are missing, zero or negative, which pass, and others."""
    from gleaner.functions import dates

    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    d = F.when(k % 3 == 0, F.concat(F.lit("on "), F.date_format(at, "yyyy-MM-dd"), F.lit(" edited"))).when(k % 3 == 1, F.concat(F.lit(" "), F.date_format(at, "MM-dd"), F.lit(" here"))).otherwise(F.col("event_type"))
    time = F.when(k % 4 == 1, dates.epoch(F.col("ts"))).when(k % 4 == 2, F.lit(0.0)).when(k % 4 == 3, F.lit(-5.0))
    since = dates.window_since(F.lit("2024-03-15 06:30:00").cast("timestamp"), preset="2m")
    return events(spark, sf_dir).select("event_id", text.clean_date(d).alias("date"), dates.since_filter(time, since).alias("passes"))
