"""Queries over what lines and notes are worth, cleaned answers, footers, tags, picture points and archives; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import content, notes, text
from gleaner.operators import reports, selection
from gleaner.plans.cases import events, query
from gleaner.plans.fields import documents, pages, pick, say

LINES = "([' 12 。', '这样呢，', event_type || '这个', event_type || ' 更为的', '其实呢 ' || event_type, '然后第二点 ' || user_id, 'ab', event_type || ' and ' || user_id || '。', '', '这个NotebookLM' || event_id])[event_id % 10 + 1]"


@query(f"""
WITH l AS (SELECT event_id, trim({LINES}, '，。！？；;、 ') AS t FROM events), o AS (SELECT *, t = '' OR starts_with(t, '然后第二点') OR starts_with(t, '这个NotebookLM') OR ends_with(t, '这个') OR ends_with(t, '更为的') AS open FROM l)
SELECT event_id, open, open OR length(t) <= 2 OR t IN ('这样', '这样呢') OR contains(t, '其实呢') AS low, length(t) <= 3 OR t = '这样呢' OR starts_with(t, '然后第二点') OR (length(t) <= 10 AND ends_with(t, '这个')) AS quiet FROM o""")
def line_worth(spark, sf_dir):
    """Lines of every kind, made from events: half sentences, numbers, phrases that say nothing, and good ones."""
    k = F.col("event_id")
    lines = [say(" 12 。"), say("这样呢，"), say("$event_type", "这个"), say("$event_type", " 更为的"), say("其实呢 ", "$event_type"), say("然后第二点 ", "$user_id"), say("ab"), say("$event_type", " and ", "$user_id", "。"), F.lit(None), say("这个NotebookLM", "$event_id")]
    line = F.element_at(F.array(*lines), (k % 10 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", content.is_open(line).alias("open"), content.is_low_quality(line).alias("low"), content.is_low_signal(line).alias("quiet"))


@query("""
SELECT event_id, event_id % 4 IN (0, 1) AND (event_id % 3 = 0 OR event_id % 5 = 0) AS video, event_id % 4 = 0 AND event_id % 6 <> 1 AND event_id % 7 <> 2 AND user_id > 0 AND event_id % 50 < user_id AS retry FROM events""")
def note_kinds(spark, sf_dir):
    """Video notes by type or by what they hold, of the source that their type or link tells; notes to fetch again."""
    k = F.col("event_id")
    source = F.when(k % 4 == 0, " xiaohongshu ").when(k % 4 == 2, "zhihu_article").otherwise("")
    url = F.when(k % 4 == 1, say("https://www.xiaohongshu.com/explore/", "$event_id")).otherwise(say("https://ex.example/", "$event_id"))
    video = content.is_video_note(source, url, F.when(k % 3 == 0, "Video"), F.when(k % 5 == 0, True))
    retry = content.needs_retry(source, F.when(k % 6 == 1, True), F.when(k % 7 == 2, "other").otherwise(" comment_incomplete"), F.col("user_id"), k % 50)
    return events(spark, sf_dir).select("event_id", video.alias("video"), retry.alias("retry"))


@query("""
SELECT page_id, '*来源：' || (['微信公众号', '知乎', 'CSDN', '小红书', '知乎'])[page_id % 5 + 1] || ' [' || CASE WHEN page_id % 5 = 3 THEN '@' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN 'A' || page_id ELSE '原文' END || '](' || url || ')*' AS footer FROM pages""")
def page_footers(spark, sf_dir):
    k = F.col("page_id")
    footer = content.source_footer(pick(k, "wechat_article", "zhihu_answer", "", "", ""), pick(k, "", "", "csdn", "other", " zhihu "), F.col("url"), F.when(k % 2 == 0, say(" A", "$page_id")).otherwise(" "))
    return pages(spark, sf_dir).select("page_id", footer.alias("footer"))


@query(r"""
SELECT doc_id, md5('中文' || (doc_id % 9) || '，好 abc 中。' || chr(10) || '- x' || chr(10) || 'dots' || chr(10) || chr(10) || 'end ' || lang) AS cleaned_md5, md5(CASE WHEN doc_id % 6 = 5 THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+\n', chr(10), 'g'), '\s+$', ''), '^\s+', ''), '\n\s*\n', chr(10) || chr(10), 'g') END) AS answer_md5 FROM documents""")
def model_answers(spark, sf_dir):
    """Recognised texts with odd blanks, bullets and dots; whole texts between the lines that models put around them, and answers of such lines alone."""
    k = F.col("doc_id")
    raw = F.concat(F.lit("中  文"), (k % 9).cast("string"), F.lit(" ， 好  abc   中 。\n•  x \n...dots\n\n\n\n  end  "), F.col("lang"), F.lit(" \n"))
    plain = F.regexp_replace(F.regexp_replace(text.text_of("text"), r"[ \t\r]+\n", "\n"), r"\n\s*\n", "\n\n")
    around = F.when(k % 6 == 5, "好的，以下\n\n---\n").otherwise(F.concat(F.lit("好的，这是\n---\n\n## OCR x\n"), plain, F.lit("  \n\n——— \n以上就是全部\n如果需要，我可以\n")))
    return documents(spark, sf_dir).select("doc_id", F.md5(content.ocr_cleaned(F.replace(raw, F.lit(" ， 好"), F.lit("，好")))).alias("cleaned_md5"), F.md5(content.answer_only(around)).alias("answer_md5"))


@query("""
WITH t AS (SELECT event_id, 'one two ' || repeat(event_type || ' ', CAST(event_id % 5 AS INTEGER)) || CASE WHEN event_id % 3 < 2 THEN 'keyword' ELSE 'none' END || ' after, ' || user_id || ' the end of it.' AS t FROM events), p AS (SELECT *, instr(t, 'keyword') AS pos FROM t),
s AS (SELECT *, CASE WHEN pos - 11 <= 0 THEN 0 ELSE (pos - 11) - length(regexp_extract(substr(t, 1, pos - 11), '([^ ，。！？!?:：]*)$', 1)) END AS a FROM p), e AS (SELECT *, least(length(t), a + 20) AS z FROM s)
SELECT event_id, CASE WHEN pos = 0 THEN '' ELSE trim(substr(t, a + 1, z - a) || regexp_extract(substr(t, z + 1), '^([^ ，。！？!?:：]*)', 1), '，。！？；;、 ') END AS window FROM e""")
def keyword_windows(spark, sf_dir):
    """What stands around a keyword, cut between words; every third text has none."""
    k = F.col("event_id")
    t = F.concat(F.lit("one two "), F.expr("repeat(concat(event_type, ' '), cast(event_id % 5 as int))"), F.when(k % 3 < 2, "keyword").otherwise("none"), say(" after, ", "$user_id", " the end of it."))
    return events(spark, sf_dir).select("event_id", content.words_around(t, ["absent", "keyword"], 20).alias("window"))


RULES = [("Deutsch", [["nicht", "UND"], ["sch"]]), ("English", [["The "]]), ("Long", [["que", "that", "keit"], ["a"]])]


@query("""
WITH t AS (SELECT doc_id, lower(text) AS t, [lang, source, 'x' || (doc_id % 3), 'y', 'z', 'v'] AS own FROM documents),
a AS (SELECT doc_id, own || [x for x in [CASE WHEN (contains(t, 'nicht') OR contains(t, 'und')) AND contains(t, 'sch') THEN 'Deutsch' END, CASE WHEN contains(t, 'the ') THEN 'English' END, CASE WHEN (contains(t, 'que') OR contains(t, 'that') OR contains(t, 'keit')) AND contains(t, 'a') THEN 'Long' END] if x IS NOT NULL] AS l FROM t)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ',') AS tags FROM a""")
def document_tags(spark, sf_dir):
    """Tags of documents with those that rules add; no more than eight."""
    tags = F.array(F.col("lang"), F.concat(F.lit(" "), F.col("source")), say("x", (F.col("doc_id") % 3).cast("string")), F.lit("y"), F.lit(""), F.lit("z"), F.lit("v"), F.lit("y"))
    return documents(spark, sf_dir).select("doc_id", F.array_join(content.tags_by_rules(tags, text.text_of("text"), RULES), ",").alias("tags"))


@query("""
WITH s AS (SELECT event_id, value * 2 AS a, value * 2 + CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 400 END AS z, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 400 END AS span FROM events),
n AS (SELECT *, z - a AS w, greatest(5, least(18, CAST(ceil((z - a) / 45.0) AS INTEGER))) AS n FROM s), p AS (SELECT *, least(greatest(w * 0.04, 4.0), 18.0) AS pad, least(greatest(w / 10, 5.0), 36.0) AS half FROM n),
q AS (SELECT *, CASE WHEN z - pad <= a + pad THEN a ELSE a + pad END AS l, CASE WHEN z - pad <= a + pad THEN z ELSE z - pad END AS r, (a + z) / 2 AS mid, w >= 180 OR n > 5 AS wide FROM p),
u AS (SELECT event_id, round_even(CASE WHEN wide THEN l + (r - l) / (n - 1) * i ELSE least(greatest(mid - half + half * 2 / 4 * i, a), z) END, 2) AS point FROM (SELECT *, unnest(range(0, CASE WHEN wide THEN n ELSE 5 END)) AS i FROM q WHERE w > 0)),
c AS (SELECT event_id, CAST(count(DISTINCT point) AS INTEGER) AS n_points, min(point) AS first, max(point) AS last FROM u GROUP BY 1)
SELECT event_id, coalesce(n_points, 0) AS n_points, first, last, CAST(CASE WHEN w <= 0 THEN 0 WHEN w <= 30 THEN 1 WHEN w <= 60 THEN 2 WHEN w <= 90 THEN 3 ELSE greatest(5, least(18, ceil(w / 45.0))) END AS INTEGER) AS pictures FROM q LEFT JOIN c USING (event_id)""")
def picture_plans(spark, sf_dir):
    """Points in chapters of up to 400 seconds, some without a length, and how many pictures each gets."""
    k = F.col("event_id")
    a = F.col("value") * 2
    z = a + F.when(k % 9 == 0, 0).otherwise(k % 400)
    p = events(spark, sf_dir).select("event_id", content.picture_points(a, z).alias("p"), content.picture_count(z - a).alias("pictures"))
    return p.select("event_id", F.size("p").alias("n_points"), F.array_min("p").alias("first"), F.array_max("p").alias("last"), "pictures")


@query("""
SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' END AS iso FROM events""")
def event_stamps(spark, sf_dir):
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    ms = F.when(k % 20 == 0, 0).when(k % 10 != 0, F.unix_millis(at))
    return events(spark, sf_dir).select("event_id", content.file_stamp(at).alias("stamp"), content.iso_stamp(ms).alias("iso"))


@query("""
SELECT conv_id AS note_id, count(*) AS total, '{"noteId":' || conv_id || ',"totalComments":' || count(*) || ',"comments":[' || string_agg('{"seq":' || turn || ',"author":"' || role || '"}', ',' ORDER BY turn) || ']}' AS archive FROM conversations GROUP BY conv_id""")
def comment_archives(spark, sf_dir):
    """A note's comments in one JSON file each."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("note_id"), F.struct(F.col("turn").alias("seq"), F.col("role").alias("author")).alias("c"))
    return reports.archives(c, "note_id", "c")


@query("""
SELECT 'batch' AS name, count(*) AS total, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS failed, md5(string_agg(event_id || ' ' || user_id, chr(10) ORDER BY event_id) FILTER (event_type = 'error' AND value > 60)) AS failures_md5 FROM events""")
def batch_manifests(spark, sf_dir):
    """One row for a batch: its counts, and the list of what failed badly, a line each in order (written as text by partitions; one digest here)."""
    e = events(spark, sf_dir)
    failed = F.col("event_type") == "error"
    m = reports.batch_manifest(e, F.lit("batch"), failed)
    lines = reports.failure_lines(e.where("value > 60"), failed, ["event_id"], say("$event_id", " ", "$user_id"))
    digest = lines.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")).alias("failures_md5"))
    return m.crossJoin(digest)  # two single rows


@query("""
WITH w AS (SELECT CASE WHEN event_id % 6 = 0 THEN 'list ' || user_id END AS m, event_type, value FROM events) SELECT code, message, n, total, successes FROM (SELECT 'favorites_warning' AS code, m AS message, count(*) AS n FROM w WHERE m IS NOT NULL GROUP BY m), (SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS successes FROM events)""")
def favorites_report(spark, sf_dir):
    """Warnings of a collection as rows beside its counts; empty ones go."""
    k = F.col("event_id")
    e = events(spark, sf_dir).select((F.col("event_type") != "error").alias("ok"), F.when(k % 6 == 0, say(" list ", "$user_id")).when(k % 6 == 1, " ").alias("message"))
    return reports.favorites_report(e, "ok", "message")


@query("""
SELECT user_id, event_id, line FROM (SELECT user_id, event_id, unnest(CASE WHEN goes AND s <> '' AND s <> x THEN [s, x] ELSE [x] END) AS line FROM (SELECT *, event_type = 'view' AS goes, 'then ' || event_type AS x, lag(CASE WHEN event_type IN ('purchase', 'signup') THEN 'then ' || event_type ELSE '' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events))""")
def bridged_blocks(spark, sf_dir):
    """A user's events as blocks of a line; a view goes on with what was before, if that was a purchase or a signup."""
    e = events(spark, sf_dir)
    b = e.select("user_id", "event_id", "ts", F.array(say("then ", "$event_type")).alias("lines"))
    subject = F.when(F.get("lines", F.lit(0)).isin("then purchase", "then signup"), F.get("lines", F.lit(0))).otherwise("")
    got = selection.with_bridges(b, "user_id", ["ts", "event_id"], "lines", F.col("first") == "then view", subject)
    return got.select("user_id", "event_id", F.explode("lines").alias("line"))


@query("""
SELECT key, lang, quality FROM (SELECT doc_id AS key, NULL AS lang, quality, 0 AS t FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, lang, NULL, 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT item_id, 'b', NULL, 2 FROM benchmark) QUALIFY row_number() OVER (PARTITION BY key ORDER BY t) = 1""")
def united_rows(spark, sf_dir):
    """Rows of three tables with different columns, each number once, of the first table that has it."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    frames = [read("labels").where("quality = 1").select(F.col("doc_id").alias("key"), "quality"), read("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("key"), "lang"), read("benchmark").select(F.col("item_id").alias("key"), F.lit("b").alias("lang"))]
    return selection.united(frames, ["key"], ["key"]).select("key", "lang", "quality")


@query("""
WITH a AS (SELECT event_type || '/' || user_id AS place, max(ts) AS t FROM events GROUP BY 1), b AS (SELECT event_type || '/' || user_id AS place FROM events WHERE user_id % 2 = 0)
SELECT 1 AS k, arg_max(place, (t, place)) FILTER (place NOT IN (SELECT place FROM b)) AS place, true AS is_new FROM a UNION ALL SELECT 2, arg_max(place, (t, place)), false FROM a""")
def new_places(spark, sf_dir):
    """The newest place that wasn't there before, and the newest of all where nothing is new."""
    e = events(spark, sf_dir).select(say("$event_type", "/", "$user_id").alias("place"), "user_id", "ts")
    after = e.groupBy("place").agg(F.max("ts").alias("at"))
    each = [selection.new_place(b.select("place"), after, "place", "at").select(F.lit(k).alias("k"), "place", "is_new") for k, b in ((1, e.where("user_id % 2 = 0")), (2, e))]
    return each[0].union(each[1])


@query("""
SELECT l.doc_id, l.quality, md5(d.text) AS text_md5 FROM labels l LEFT JOIN documents d USING (doc_id)""")
def note_contents(spark, sf_dir):
    """Labels as notes' basic data, each with its content by one join instead of a look-up a row."""
    notes_, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return notes_.join(docs.select("doc_id", "text"), "doc_id", "left").select("doc_id", "quality", F.md5("text").alias("text_md5"))


@query("""
SELECT required, reason, count(*) AS n FROM (SELECT event_id % 13 = 0 OR event_id % 17 = 0 AS stated, CASE WHEN event_id % 17 = 0 THEN 'set' ELSE '' END AS given, event_id % 5 AS m, event_id % 7 = 0 AS login FROM events) e,
LATERAL (SELECT CASE WHEN m = 1 THEN 'captcha' WHEN login OR m = 2 THEN 'login_required' WHEN m = 3 THEN 'risk_control' ELSE '' END AS found), LATERAL (SELECT stated OR found <> '' AS required, CASE WHEN stated THEN given ELSE found END AS reason) GROUP BY 1, 2""")
def manual_actions(spark, sf_dir):
    """Which notes somebody has to act on, and why: as they say, by a warning, or by messages of every kind."""
    k = F.col("event_id")
    act = notes.manual_action(F.when(k % 13 == 0, True), F.when(k % 17 == 0, " set "), F.when(k % 7 == 0, "comment_login_required"), pick(k, "fine", "请输入验证码", "无登录信息", "code 406", ""))
    return events(spark, sf_dir).select(act.alias("a")).groupBy("a.required", "a.reason").agg(F.count("*").alias("n"))
