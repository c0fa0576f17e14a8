"""Queries over the rules for single fields: links, names, times, tags and messages made from the tables' rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import checks, links, notes, text
from gleaner.operators import boards, captions, results
from gleaner.plans.cases import events, query
from gleaner.streaming import sync


def say(*parts) -> Column:
    """Texts and columns (a text that begins with $ names one) joined."""
    return F.concat(*(p if isinstance(p, Column) else F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts))


def pick(k: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(r"""
WITH t AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN ' ' || url || ' ' ELSE '看 ' || url || '）， https://www.xiaohongshu.com/explore/n' || (page_id % 50) || '?x=1， and https://xiaohongshu.com/discovery/item/n' || (page_id % 50) || ' again ' || upper(url) || '。' END AS t FROM pages),
l AS (SELECT page_id, t, u[i] AS url, i, len(u) AS n FROM (SELECT page_id, t, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT page_id, t, [regexp_replace(x, '[)）】>,，。！？；]+$', '') for x in regexp_extract_all(t, '(?i)https?://[^\s"''<>]+')] AS u FROM t))),
k AS (SELECT *, regexp_extract(url, '(?i)xiaohongshu\.com/(?:explore|discovery/item)/([A-Za-z0-9]+)', 1) AS note FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place FROM k QUALIFY true),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id, CASE WHEN note <> '' THEN 'note:' || note ELSE 'url:' || lower(url) END ORDER BY i) = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS place, url, note AS note_id, CASE WHEN note <> '' THEN 'https://www.xiaohongshu.com/discovery/item/' || note ELSE url END AS canonical, CASE WHEN n = 1 AND url = trim(t) THEN 'url' ELSE 'share_text' END AS kind FROM d""")
def page_notes(spark, sf_dir):
    """Links of shared texts: a page's link twice (once in capitals) and a note under two links; every tenth text is a link alone."""
    note = say("https://www.xiaohongshu.com/explore/n", (F.col("page_id") % 50).cast("string"), "?x=1， and https://xiaohongshu.com/discovery/item/n", (F.col("page_id") % 50).cast("string"))
    shared = F.when(F.col("page_id") % 10 == 0, say(" ", "$url", " ")).otherwise(say("看 ", "$url", "）， ", note, " again ", F.upper("url"), "。"))
    return pages(spark, sf_dir).select("page_id", F.posexplode(links.note_inputs(shared)).alias("place", "x")).select("page_id", "place", "x.*")


@query(r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://ex.example/' || page_id END AS url FROM pages""")
def page_chats(spark, sf_dir):
    """The first good link of two texts: some have theirs in the first, some in the second, some none that can be parsed."""
    k = F.col("page_id") % 3
    a = F.when(k == 0, say("see (", "$url", ")!? and http://later.example")).when(k == 1, "nothing here").otherwise("http:// and ftp://ex.example")
    b = F.when(k == 1, say("or https://ex.example/", "$page_id", ".'")).otherwise("")
    return pages(spark, sf_dir).select("page_id", links.first_chat_link(a, b).alias("url"))


@query("""
SELECT event_id, (['bilibili', 'youtube', 'xiaohongshu', 'unknown'])[event_id % 4 + 1] AS platform,
  CASE event_id % 4 WHEN 0 THEN 'https://www.bilibili.com/video/BV' || user_id || '?p=' || (event_id % 7) WHEN 1 THEN 'https://www.youtube.com/watch?v=' || event_type || '&list=' || user_id WHEN 2 THEN 'https://www.xiaohongshu.com/explore/' || event_id ELSE 'https://v.example/' || event_id || '?b=2&a=' || user_id END AS clean,
  clean || CASE event_id % 4 WHEN 0 THEN '&t=' || CAST(floor(value) AS BIGINT) WHEN 1 THEN '&t=' || CAST(floor(value) AS BIGINT) || 's' WHEN 2 THEN '' ELSE '&t=' || CAST(floor(value) AS BIGINT) END AS timed FROM events""")
def event_videos(spark, sf_dir):
    """Video links of four platforms with keys that stay and keys that go; the same at a time."""
    k = F.col("event_id") % 4
    url = (
        F.when(k == 0, say("https://www.bilibili.com/video/BV", "$user_id", "?spm=2&p=", (F.col("event_id") % 7).cast("string"), "&t=9#part")).when(k == 1, say("https://www.youtube.com/watch?t=5s&v=", "$event_type", "&feature=x&list=", "$user_id"))
        .when(k == 2, say("https://www.xiaohongshu.com/explore/", "$event_id", "?t=2&x=3")).otherwise(say("https://v.example/", "$event_id", "?b=2&t=3&a=", "$user_id"))
    )
    e = events(spark, sf_dir).select("event_id", url.alias("url"), "value")
    p = links.platform(F.col("url"))
    return e.select("event_id", p.alias("platform"), links.video_link(F.col("url"), p).alias("clean"), links.timed_link(F.col("url"), p, F.col("value")).alias("timed"))


@query(r"""
SELECT page_id, CAST(len(kept) AS INTEGER) AS n, array_to_string(kept, ' ') AS links FROM (SELECT page_id, [CASE WHEN starts_with(u, '//') THEN 'https:' || u ELSE regexp_replace(u, '^http://', 'https://') END for u in
  ['//ci.xiaohongshu.com/' || x for x in regexp_extract_all(html, '<a href="/([^"]*)"', 1)] || [' http://sns-img.example/' || page_id] if contains(u, 'the') OR contains(u, 'sns-img')][1:4] AS k FROM pages), LATERAL (SELECT [trim(CASE WHEN starts_with(trim(x), 'http://') THEN 'https://' || substr(trim(x), 8) ELSE x END) for x in k] AS kept)""")
def page_images(spark, sf_dir):
    """The first four image links with a token, all with https; a page's links stand for its images."""
    found = F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda x: F.concat(F.lit("//ci.xiaohongshu.com/"), x))
    urls = F.transform(F.concat(found, F.array(say(" http://sns-img.example/", "$page_id"))), links.image_link)
    return pages(spark, sf_dir).select("page_id", links.content_images(urls, ["the", "sns-img"], 4).alias("k")).select("page_id", F.size("k").alias("n"), F.array_join("k", " ").alias("links"))


SAID = ["", "网页端提示需要登录", "请输入 Captcha", "code 406", "无登录信息", "hello"]


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN ' given ' WHEN event_id % 2 = 0 THEN '' END AS explicit, CASE WHEN event_id % 19 = 0 THEN 'set' END AS reason, (['', '网页端提示需要登录', '请输入 Captcha', 'code 406', '无登录信息', 'hello'])[event_id % 6 + 1] AS m, CASE WHEN event_id % 5 > 0 THEN event_id % 4 END AS total, event_id % 3 AS got FROM events),
c AS (SELECT *, CASE WHEN trim(coalesce(explicit, '')) <> '' THEN 'given' WHEN m = '网页端提示需要登录' THEN 'comment_login_required' WHEN total > 0 AND got < total THEN 'comment_incomplete' WHEN m <> '' THEN 'comment_warning' ELSE '' END AS code FROM e)
SELECT code, CASE WHEN reason IS NOT NULL THEN 'set' WHEN m = '请输入 Captcha' THEN 'captcha' WHEN code = 'comment_login_required' OR m = '无登录信息' THEN 'login_required' WHEN m = 'code 406' THEN 'risk_control' ELSE '' END AS reason, count(*) AS n, min(event_id) AS first_event FROM c GROUP BY ALL""")
def note_states(spark, sf_dir):
    """Warnings of comments and reasons to act, counted; codes, reasons and messages come in every mix."""
    k = F.col("event_id")
    e = events(spark, sf_dir).select("event_id", F.when(k % 17 == 0, " given ").when(k % 2 == 0, "").alias("explicit"), F.when(k % 19 == 0, "set").alias("set"), pick(k, *SAID).alias("m"), F.when(k % 5 > 0, k % 4).alias("total"), (k % 3).alias("got"))
    e = e.withColumn("code", notes.comment_warning("explicit", "m", F.col("total"), F.col("got")))
    return e.groupBy("code", notes.manual_reason("set", "code", "m").alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(r"""
WITH d AS (SELECT doc_id, text, lang, source, regexp_split_to_array(trim(text), '\s+') AS w FROM documents), u AS (SELECT *, list_concat(['小红书'], [lang, source, lang]) AS t FROM d),
v AS (SELECT doc_id, text, source, w, list_filter(t, lambda x, i: x <> '' AND list_position(t, x) = i)[1:5] AS tags FROM u)
SELECT doc_id, md5(substr(CASE WHEN split_part(text, chr(10), 1) <> '' THEN split_part(text, chr(10), 1) ELSE source END, 1, 50)) AS summary_md5, array_to_string(tags || ['笔记' for i in range(0, greatest(0, 3 - len(tags)))], ',') AS tags FROM v""")
def note_tags(spark, sf_dir):
    """Summaries and tags of notes without a model's: the first line, and three to five different tags."""
    tags = F.array("lang", "source", "lang")
    return documents(spark, sf_dir).select("doc_id", F.md5(notes.fallback_summary("source", "text")).alias("summary_md5"), F.array_join(notes.fallback_tags(tags), ",").alias("tags"))


@query(r"""
WITH t AS (SELECT doc_id, '收藏天' || replace(text, 'al', 'Al') || '寡' AS t FROM documents), r AS (SELECT doc_id, t, replace(replace(replace(replace(t, '收藏天', '收藏夹'), 'Al', 'AI'), 'A1', 'AI'), '寡', '的') AS mended FROM t)
SELECT doc_id, md5(mended) AS mended_md5, round(least(1.0, 0.6 * (1 - 4 / length(t)) + 0.3 * (length(t) - length(regexp_replace(t, '[~`!@#$%^&*()_+\-=\[\]{{}};'':"\\|,.<>/?]', '', 'g'))) / length(t)), 6) AS score FROM r""".replace("{{", "{").replace("}}", "}"))
def ocr_texts(spark, sf_dir):
    """Whole texts with what a recogniser reads wrongly put in; four of their characters are Chinese."""
    d = documents(spark, sf_dir).select("doc_id", say("收藏天", F.replace(text.text_of("text"), F.lit("al"), F.lit("Al")), "寡").alias("t"))
    return d.select("doc_id", F.md5(notes.ocr_mended("t")).alias("mended_md5"), F.round(notes.ocr_anomaly("t"), 6).alias("score"))


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS spoken_md5 FROM documents""")
def spoken_texts(spark, sf_dir):
    """Texts between words that only fill: what is left is the text. Every second has them at its start, others before and after a word."""
    t = F.trim(text.text_of("text"))
    filled = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("呃嗯"), t)).otherwise(F.concat(F.lit("啊额"), t))
    return documents(spark, sf_dir).select("doc_id", F.md5(text.trimmed(notes.spoken_cleaned(filled))).alias("spoken_md5"))


@query(r"""
SELECT page_id, md5(regexp_replace(regexp_replace(html, '^\s+', ''), '\s+$', '')) AS body_md5, 'p' || (page_id % 7) || ',x y' AS tags, 'page-' || page_id || '_a_b' AS segment, 'Title ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'A  '[1:2] || page_id || ' b' ELSE '未命名收藏夹' END AS folder, CASE WHEN page_id % 2 = 0 THEN '2024-05-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') ELSE 'later ' || page_id END AS date FROM pages""")
def page_files(spark, sf_dir):
    """A page as a Markdown file with front matter, tags of a description, and the names it would have."""
    i = F.col("page_id").cast("string")
    k = (F.col("page_id") % 7).cast("string")
    title = F.concat(F.lit("Title  "), i, pick(F.col("page_id"), " - 知乎", "｜知乎 - 收藏夹", " · 收藏夹", "_知乎"))
    folder = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("A /"), i, F.lit("? b"))).otherwise('?<>"')
    date = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" on 2024-05-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" or 2024-07-08"))).otherwise(F.concat(F.lit(" later "), i, F.lit(" ")))
    about = F.concat(F.lit("about #p"), k, F.lit("# and #x y[topic]# #p"), k, F.lit("# # #"))
    return pages(spark, sf_dir).select(
        "page_id", F.md5(notes.body_of(say("\ufeff---\nid: ", "$page_id", "\n---\n\n", "$html", "\n"))).alias("body_md5"), F.array_join(notes.description_tags(about), ",").alias("tags"), notes.file_segment(F.concat(F.lit(" page "), i, F.lit("/a?b "))).alias("segment"),
        notes.collection_title(title).alias("title"), notes.folder_title(folder).alias("folder"), notes.first_date(date).alias("date"),
    )


@query("""
SELECT event_id, CASE WHEN event_id % 6 = 5 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS comment, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE 'May ' || event_id END AS published,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '2026-01-01 00:00:00' END AS requested, event_type || '-' || CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'unknown' END || '-' || strftime(ts, '%Y-%m-%dT%H%M%SZ') AS run FROM events""")
def event_times(spark, sf_dir):
    """A time given in milliseconds, seconds, as ISO text, or not at all."""
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    ms, s, iso = F.unix_millis(at).cast("string"), F.unix_seconds(at).cast("string"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    published = F.when(k % 3 == 0, ms).when(k % 3 == 1, F.concat(F.lit(" "), s)).otherwise(F.concat(F.lit("May "), k.cast("string")))
    asked = F.when(k % 4 == 0, ms).when(k % 4 == 1, s).when(k % 4 == 2, iso).otherwise("soon")
    return events(spark, sf_dir).select(
        "event_id", notes.comment_time(F.when(k % 6 == 5, "-5").otherwise(ms)).alias("comment"), notes.published_date(published).alias("published"), day(notes.request_time(asked, F.lit("2026-01-01 00:00:00").cast("timestamp"))).alias("requested"),
        notes.run_id("event_type", F.when(k % 2 == 0, " web ").otherwise(" "), F.concat(iso, F.lit(" :x"))).alias("run"),
    )


@query("""
SELECT user_id, coalesce(arg_min(m, event_id) FILTER (contains(m, '登录') OR contains(m, '账号异常')), arg_max(m, event_id)) AS line FROM (SELECT user_id, event_id, CASE WHEN event_id % 31 = 0 THEN '请先登录 ' || event_id WHEN event_id % 37 = 0 THEN '账号异常' ELSE event_type || ' ' || event_id END AS m FROM events) GROUP BY 1""")
def error_lines(spark, sf_dir):
    """A user's log is what happened to them in order; the telling line is the first about logins, else the last."""
    k = F.col("event_id")
    line = F.when(k % 31 == 0, say("请先登录 ", "$event_id")).when(k % 37 == 0, "账号异常").otherwise(say("$event_type", " ", "$event_id"))
    about, last = F.min_by("m", F.when(F.col("m").rlike("登录|账号异常|无登录"), k)), F.max_by("m", "event_id")
    log = events(spark, sf_dir).select("user_id", "event_id", line.alias("m")).groupBy("user_id").agg(about.alias("about"), last.alias("last"))
    return log.select("user_id", notes.telling_line(F.array_compact(F.array("about", "last")), F.lit("")).alias("line"))


@query("""
SELECT event_id, CASE WHEN t = '' OR length(t) > 12 OR regexp_matches(t, '回复|登录|展开全文|阅读全文|收起') THEN false ELSE regexp_matches(t, '(?i)更多|展开|查看|more|view') END AS more, contains(t, '回复') AND length(t) <= 18 AND regexp_matches(t, '(?i)展开|查看|全部|更多|more|view') AND NOT regexp_matches(t, '登录|展开全文|阅读全文|收起') AS replies, 'u' || user_id || '_' || CASE WHEN event_id % 5 = 0 THEN '000000' ELSE CAST(event_id AS VARCHAR) END AS account, event_id % 3 = 1 AS author
FROM (SELECT *, (['查看 更多', '展开 ' || user_id || ' 条回复', '登录查看更多', '展开全文', 'View ' || event_type, 'more more more', '', '回复'])[event_id % 8 + 1] AS t FROM events)""")
def event_controls(spark, sf_dir):
    """Labels of controls, account keys and author tags."""
    k = F.col("event_id")
    label = F.element_at(F.array(F.lit(" 查看  更多 "), say("展开 ", "$user_id", " 条回复"), F.lit("登录查看更多"), F.lit("展开全文"), say("View ", "$event_type"), F.lit("more more more"), F.lit(None), F.lit("回复")), (k % 8 + 1).cast("int"))
    tags = F.when(k % 3 == 1, F.array(F.lit(None), F.lit("is_Author"))).when(k % 3 == 2, F.array(F.lit("reader")))
    return events(spark, sf_dir).select("event_id", checks.loads_more(label).alias("more"), checks.expands_replies(label).alias("replies"), checks.account_key(say("u", "$user_id", "关注"), F.when(k % 5 > 0, say(" ", "$event_id"))).alias("account"), checks.has_author_tag(tags).alias("author"))


@query(r"""
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'untitled-' || page_id ELSE substr('u-' || (page_id % 5) || ' b ' || regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '-', 'g'), '-+', '-', 'g'), '-$', ''), 1, 120) END AS name, 'the-世界_' || page_id AS slug, substr(url, 1, 12) AS cut, CASE WHEN page_id % 2 = 0 THEN '{"a": {"b": ' || page_id || '}}' END AS held, CASE WHEN page_id % 3 < 2 THEN 'd' || page_id END AS info FROM pages""")
def page_names(spark, sf_dir):
    """Names, a slug, a cut text, the JSON within an answer, and the id of a store's row in two shapes."""
    k, i = F.col("page_id"), F.col("page_id").cast("string")
    title = F.when(k % 9 == 0, '?/:"').otherwise(F.concat(F.lit("u/:"), (k % 5).cast("string"), F.lit("  b "), F.col("url")))
    answer = F.when(k % 2 == 0, F.concat(F.lit('So: {"a": {"b": '), i, F.lit("}} done"))).otherwise("none")
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"doc": {"basic_info": {"docid": "d'), i, F.lit('"}}}'))).when(k % 3 == 1, F.concat(F.lit('{"doc": {"basic_info": null}, "basic_info": {"basic_info": {"docid": "d'), i, F.lit('"}}}'))).otherwise('{"doc": {"basic_info": {}}, "basic_info": {"basic_info": {"docid": "no"}}}')
    return pages(spark, sf_dir).select("page_id", checks.note_file_name(title, i).alias("name"), text.slug(F.concat(F.lit(" The 世界_"), i, F.lit("! "))).alias("slug"), text.truncated("url", 12).alias("cut"), text.json_object_in(answer).alias("held"), checks.basic_info(raw, "doc", "docid").alias("info"))


@query("""
SELECT event_id, (['', 'Invalid task', 'Task type is required', 'Task source is required', 'Task input is required', 'Note save task requires input or current mode', '', 'Task route must be a string', 'Task metadata must be an object'])[event_id % 9 + 1] AS fault, (['', 'Fetched Xiaohongshu note is missing noteId', 'Fetched Xiaohongshu note is missing title and content', 'Fetched article is missing title', 'Fetched article is missing content', ''])[event_id % 6 + 1] AS page FROM events""")
def event_faults(spark, sf_dir):
    """Tasks in JSON and fetched pages with a fault of every kind, made from the event."""
    k, whole = F.col("event_id"), lambda *more: say('{"type": "note-save", "source": "', "$event_type", '", "input": "https://ex.example/', "$event_id", '"', *more, "}")
    task = F.element_at(F.array(
        whole(), say("[", "$event_id", "]"), say('{"type": "", "source": "', "$event_type", '"}'), say('{"type": "x", "source": 0, "input": ', "$event_id", "}"), say('{"type": "x", "source": "', "$event_type", '"}'), say('{"type": "note-save", "source": "', "$event_type", '", "input": ""}'),
        say('{"type": "note-save", "source": "', "$event_type", '", "input": "", "options": {"mode": "current"}}'), whole(', "route": ', "$event_id"), whole(', "metadata": [', "$event_id", "]"),
    ), (k % 9 + 1).cast("int"))
    page = [("xiaohongshu", "$event_id", "$event_type", ""), ("xiaohongshu", " ", "$event_type", ""), ("xiaohongshu", "$event_id", " ", ""), ("zhihu", "", "", "$event_type"), ("zhihu", "", "$event_type", "\n"), ("csdn", "", "$event_type", "$event_type")]
    part = lambda n: F.element_at(F.array(*(say(p[n]) for p in page)), (k % 6 + 1).cast("int"))
    none = lambda c: F.coalesce(c, F.lit(""))
    return events(spark, sf_dir).select("event_id", none(checks.task_fault(task)).alias("fault"), none(checks.page_fault(part(0), part(1), part(2), part(3))).alias("page"))


@query("""
SELECT conv_id, array_to_string(list(conv_id || '/' || turn ORDER BY CASE turn % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, turn) FILTER (turn % 5 <> 4), ',') AS links FROM conversations GROUP BY 1 HAVING count(*) FILTER (turn % 5 <> 4) > 0""")
def image_scenes(spark, sf_dir):
    """A conversation's turns as variants of one image; some have no link."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    image = F.struct(F.col("turn"), F.when(F.col("turn") % 4 == 3, "WB_DFT").when(F.col("turn") % 4 == 1, "WB_PRV").when(F.col("turn") % 4 == 2, "other").alias("imageScene"), F.when(F.col("turn") % 5 != 4, say("$conv_id", "/", "$turn")).alias("url"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(image)).alias("i")).select("conv_id", F.array_join(checks.scene_links(F.col("i")), ",").alias("links")).where("links <> ''")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_type END AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), p AS (SELECT *, coalesce(t, '') AS now, lag(coalesce(t, '')) OVER (PARTITION BY user_id ORDER BY n) AS was FROM e)
SELECT event_id, CAST(CASE WHEN was IS NULL OR was = now THEN 0 WHEN was = '' OR now = '' OR NOT list_has_any(string_split(was, ''), string_split(now, '')) THEN 1 ELSE 2 END AS INTEGER) AS kind FROM p""")
def text_changes(spark, sf_dir):
    """How far a user's text is from the one before: none, all (one side empty), or something between."""
    e = events(spark, sf_dir).select("user_id", "event_id", "ts", F.when(F.col("event_id") % 8 != 0, F.col("event_type")).alias("t"))
    change = F.col("change")
    return boards.text_change(e, "user_id", ["ts", "event_id"], "t").select("event_id", F.when(change == 0, 0).when(change == 1, 1).otherwise(2).alias("kind"))


@query("""
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, string_agg(CASE WHEN i % 3 = 0 OR i = n THEN 't' || turn || '。' ELSE 't' || turn || '，' END, '' ORDER BY i) AS text FROM c GROUP BY 1""")
def narrations(spark, sf_dir):
    """A conversation's turns as clauses, three to a sentence."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return c.select("conv_id", captions.paragraph(F.transform("t", lambda x: F.concat(F.lit("t"), x.cast("string")))).alias("text"))


@query("""
WITH b AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'chapter ' || event_id WHEN event_id % 4 = 1 THEN 'path ' || event_id END AS body FROM events)
SELECT event_id, body FROM b""")
def block_lookup(spark, sf_dir):
    """Bodies by a chapter's title, else by a path."""
    e = events(spark, sf_dir)
    rows = e.select("event_id", say("c", "$event_id").alias("chapter"), say("p", "$event_id").alias("path"))
    by_title = e.where("event_id % 4 = 0").select(say("c", "$event_id").alias("chapter"), say("chapter ", "$event_id").alias("body"))
    by_path = e.where("event_id % 4 < 2").select(say("p", "$event_id").alias("path"), say("path ", "$event_id").alias("body"))
    return captions.with_fallback(rows, by_title, "chapter", by_path, "path", "body").select("event_id", "body")


@query("""
SELECT 1 AS k, '/out/' || min(event_type) AS folder FROM events WHERE event_type = 'view' UNION ALL SELECT 2, '/set' UNION ALL SELECT 3, '/given'""")
def output_folders(spark, sf_dir):
    """The only folder of rows that did not fail, the configured one where there are several, and the one that was named."""
    e = events(spark, sf_dir).select(F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), say("/out/", "$event_type", "/", "$event_id", ".md").alias("filepath"))
    one = e.where((F.col("status") == "failed") | F.col("filepath").contains("/view/"))
    each = [results.output_folder(one, "", "/set"), results.output_folder(e, "", "/set"), results.output_folder(e, "/given", "/set")]
    each = [x.select(F.lit(k).alias("k"), "folder") for k, x in enumerate(each, 1)]
    return each[0].union(each[1]).union(each[2])


@query("""
SELECT label, count(*) AS n, min(event_id) AS first_event, CAST(sum(whole) AS BIGINT) AS whole, min(since) AS since FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '最近 7 天' WHEN event_id % 4 = 1 AND floor(value) > 0 THEN '最近 ' || CAST(floor(value) AS BIGINT) || (CASE WHEN event_id % 3 = 0 THEN ' 天' ELSE ' 个月' END) ELSE '' END AS label, CASE WHEN value >= 1 AND event_id % 7 > 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS whole,
  CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN value ELSE epoch(date_trunc('day', ts)) END AS since FROM events) GROUP BY 1""")
def event_windows(spark, sf_dir):
    """Names of look-back windows, whole positive numbers, and where a mode's pull begins."""
    k = F.col("event_id")
    label = sync.window_label(F.when(k % 4 == 0, " 7D ").otherwise(""), F.when(k % 4 == 1, F.col("value").cast("string")), F.when(k % 3 == 0, "Day").otherwise("month"))
    whole = sync.positive_integer(F.when(k % 7 == 0, "x").otherwise(F.col("value").cast("string")))
    day = F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))).cast("double")
    mode = sync.mode_of(F.when(k % 5 == 0, "all").when(k % 5 == 1, "window").otherwise("other"))
    e = events(spark, sf_dir).select("event_id", label.alias("label"), whole.alias("whole"), sync.since_of(mode, day, F.col("value")).alias("since"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.sum("whole").alias("whole"), F.min("since").alias("since"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '好用,笔记,笔记' ELSE lang || ',' || source || '!,好用,w' || (doc_id % 3) || ',z9' END AS tags FROM documents""")
def cleaned_tags(spark, sf_dir):
    """A model's tags and a fallback's: short, broken and repeated ones go, five stay, three at least are there."""
    k = F.col("doc_id")
    given = F.when(k % 4 > 0, F.array(say(" ", "$lang", " "), F.lit("x"), say("$source", "!"), F.lit("\u0001a"), F.lit("�bc"), F.col("lang"), F.lit("好用"), F.lit("!?")))
    fallback = F.when(k % 4 > 0, F.array(F.lit("好用"), say("w", (k % 3).cast("string")), F.lit("z9"), F.lit("q8"))).otherwise(F.array(F.lit(" 好用 ")))
    return documents(spark, sf_dir).select("doc_id", F.array_join(notes.summary_tags(given, fallback), ",").alias("tags"))
