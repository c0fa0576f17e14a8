"""Queries over runs of rows whose state goes on from row to row: names, titles, what is kept."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions.text import safe_name, text_of
from gleaner.operators import context, folds, keeping, naming, themes
from gleaner.plans.cases import events, query
from gleaner.sources.readers import items_of
from gleaner.streaming import inbox, pushes
from gleaner.streaming.names import name_batch
from gleaner.tables import new_path


def _files(spark, sf_dir):
    """Documents as files: the first word is the name, that of every seventh ends in -1, every fifth text has front matter."""
    d, t = spark.read.parquet(f"{sf_dir}/documents.parquet"), text_of("text")
    word = F.lower(F.regexp_extract(t, r"\A\s*([^\s]*)", 1))
    base = F.concat(safe_name(word, 40), F.when(F.col("doc_id") % 7 == 0, "-1").otherwise(""))
    return d.select("doc_id", base.alias("base"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---\n\n"), t)).otherwise(t).alias("text"))


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 3, doc_id) AS i, substr(trim(regexp_replace(regexp_replace(lower(regexp_extract(text, '^\s*([^\s]*)', 1)), '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g')), 1, 40) || CASE WHEN doc_id % 7 = 0 THEN '-1' ELSE '' END AS base,
  md5(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS body FROM documents),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::VARCHAR AS name, []::VARCHAR[] AS names, []::VARCHAR[] AS keys
  UNION ALL SELECT i, doc_id, name, CASE WHEN known > 0 THEN names ELSE list_append(names, name) END, CASE WHEN known > 0 THEN keys ELSE list_append(keys, key) END FROM (
    SELECT *, CASE WHEN known > 0 THEN names[known] ELSE base || CASE WHEN k = 0 THEN '' ELSE '-' || k END END AS name FROM (
      SELECT *, [k for k in range(0, len([n for n in names if starts_with(n, base)]) + 1) if NOT list_contains(names, base || CASE WHEN k = 0 THEN '' ELSE '-' || k END)][1] AS k FROM (
        SELECT d.i, d.doc_id, d.base, d.base || '|' || d.body AS key, g.names, g.keys, coalesce(list_position(g.keys, d.base || '|' || d.body), 0) AS known FROM g JOIN d ON d.i = g.i + 1))))
SELECT doc_id, name FROM g WHERE i > 0""")
def output_names(spark, sf_dir):
    """Three batches of files into one registry; a text that was there, whatever its front matter, keeps its name."""
    files, registry, out = _files(spark, sf_dir), new_path(spark, "names"), None
    for k in range(3):
        named = name_batch(files.where(F.col("doc_id") % 3 == k), k, registry, "base", "text", ["doc_id"]).select("doc_id", "name")
        out = named if out is None else out.union(named)
    return out


@query("""
WITH RECURSIVE p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, p_partkey % 50 AS key, p_name || CASE WHEN p_partkey % 9 = 0 THEN '（' || (p_partkey % 50) || '）' WHEN p_partkey % 11 = 0 THEN '（' || (p_partkey % 40) || '-2）' ELSE '' END AS title FROM part),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS p_partkey, NULL::VARCHAR AS name, []::VARCHAR[] AS names
  UNION ALL SELECT i, p_partkey, name, list_append(names, name) FROM (
    SELECT i, p_partkey, names, CASE WHEN k = 0 THEN title WHEN k = 1 THEN title || '（' || key || '）' ELSE title || '（' || key || '-' || k || '）' END AS name FROM (
      SELECT p.*, g.names, [k for k in range(0, len([n for n in g.names if starts_with(n, p.title)]) + 2) if NOT list_contains(g.names, CASE WHEN k = 0 THEN p.title WHEN k = 1 THEN p.title || '（' || p.key || '）' ELSE p.title || '（' || p.key || '-' || k || '）' END)][1] AS k FROM g JOIN p ON p.i = g.i + 1)))
SELECT p_partkey, name FROM g WHERE i > 0""")
def unique_titles(spark, sf_dir):
    """Parts as videos: their names are titles, some of which look like made ones; 50 keys."""
    key = F.col("p_partkey")
    bracket = F.when(key % 9 == 0, F.concat(F.lit("（"), (key % 50).cast("string"), F.lit("）"))).when(key % 11 == 0, F.concat(F.lit("（"), (key % 40).cast("string"), F.lit("-2）"))).otherwise("")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", bracket).alias("title"), (key % 50).alias("key"))
    return naming.unique_titles(rows, "title", "key", ["p_partkey"])[0].select("p_partkey", "name")


def near_values(a: float, b: float) -> float:
    return 1 - abs(a - b) / 1000


@query("""
WITH RECURSIVE r AS (SELECT user_id, event_id, value, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS t, CAST(event_id * 7919 % 1000 AS DOUBLE) AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, i, event_id, value, t, q, 1 AS slot FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, CASE WHEN v = 'skip' THEN g.event_id ELSE r.event_id END, CASE WHEN v = 'skip' THEN g.value ELSE r.value END, CASE WHEN v = 'skip' THEN g.t ELSE r.t END, CASE WHEN v = 'skip' THEN g.q ELSE r.q END, CASE WHEN v = 'keep' THEN g.slot + 1 ELSE g.slot END
  FROM g JOIN r ON r.user_id = g.user_id AND r.i = g.i + 1, LATERAL (SELECT CASE WHEN 1 - abs(g.value - r.value) / 1000 < 0.99 OR g.t <> r.t THEN 'keep' WHEN r.q > g.q THEN 'replace' ELSE 'skip' END AS v))
SELECT user_id, arg_max(event_id, i) AS event_id FROM g GROUP BY user_id, slot""")
def kept_frames(spark, sf_dir):
    """A user's events as pictures (value), with a text that every eleventh lacks; case and blanks of a text don't count."""
    text = F.when(F.col("event_id") % 11 == 0, " ").when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), F.upper("event_type"))).otherwise(F.col("event_type"))
    e = events(spark, sf_dir).select("user_id", "event_id", "ts", "value", text.alias("text"), (F.col("event_id") * 7919 % 1000).cast("double").alias("quality"))
    return keeping.kept(e, "user_id", ["ts", "event_id"], "value", "text", "quality", near_values).select("user_id", "event_id")


def push_rows(spark, sf_dir):
    """Events as pushes in pages of 500; an error has no link."""
    e = events(spark, sf_dir)
    url = F.when(F.col("event_type") != "error", F.concat(F.lit("https://inbox.example.com/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")))
    return e.select(F.floor(F.col("event_id") / 500).alias("page"), (F.col("event_id") % 500).cast("int").alias("place"), F.when(url.isNotNull(), "link").otherwise("note").alias("type"), url.alias("url"), F.lit("").alias("title"), F.lit("").alias("body"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("modified"))


def pull(spark, pages: str, at: str, since: float, max_pages: int) -> dict:
    """One pull of the stream into the table at `at`, each link once; the state after it."""
    stream = items_of(pushes.pushes(spark, pages, since, max_pages))
    query = inbox.collect_available(stream, f"{at}/items", f"{at}/progress", ["url"], ["page", "place"])
    return pushes.pull_state(query.lastProgress) if query.lastProgress else {}


@query("""
WITH p AS (SELECT event_id // 500 AS page, (event_id % 500)::INT AS place, 'https://inbox.example.com/' || user_id || '/' || event_type AS url, epoch_us(ts) / 1e6 AS modified FROM events WHERE event_type <> 'error' AND epoch_us(ts) / 1e6 > 1704153600)
SELECT url, page, place, modified AS timestamp FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY page, place) = 1""")
def stream_pages(spark, sf_dir):
    """The stream of pages from the second day on, stopped between two pages and taken up again until nothing is left."""
    at = new_path(spark, "pushes")
    pushes.store_pages(push_rows(spark, sf_dir), f"{at}/pages")
    for most in (7, 1_000_000):
        pull(spark, f"{at}/pages", at, 1704153600.0, most)
    return inbox.stored(spark, f"{at}/items", "page long, place int, source string, url string, title string, timestamp double").select("url", "page", "place", "timestamp")


H = 3600.0


@query("""
WITH RECURSIVE l AS (SELECT user_id, event_id AS line, a, z, (a + z) / 2 AS m, text, weak, row_number() OVER (PARTITION BY user_id ORDER BY (a + z) / 2, event_id) AS n FROM (
    SELECT user_id, event_id, epoch_us(ts) / 1e6 - 3600 AS a, epoch_us(ts) / 1e6 + 3600 AS z, event_type || ' ' || CAST(floor(value) AS BIGINT) AS text, value < 4 AS weak FROM events WHERE event_type <> 'purchase')),
w AS (SELECT user_id, event_id AS win, epoch_us(ts) / 1e6 AS t, t - 7200 AS a, t + 7200 AS z, floor(t / 172800) * 172800 AS early, early + 172800 AS late FROM events WHERE event_type = 'purchase'),
o AS (SELECT win, list(n ORDER BY n) AS ns, bool_or(l.weak) AS weak FROM w JOIN l ON w.user_id = l.user_id AND l.z > w.a AND l.a < w.z GROUP BY win),
f AS (SELECT win, arg_min(n, (abs(m - t), line)) AS n FROM w JOIN l USING (user_id) WHERE win NOT IN (SELECT win FROM o) GROUP BY win),
s AS (SELECT w.*, coalesce(o.ns, [f.n]) AS ns, o.win IS NOT NULL AS met, CASE WHEN o.win IS NULL THEN 1 ELSE 3 END AS least FROM w LEFT JOIN o USING (win) LEFT JOIN f USING (win) WHERE o.win IS NOT NULL OR f.win IS NOT NULL),
g AS (SELECT user_id, win, t, early, late, ns, met, least, 0 AS step FROM s
  UNION ALL SELECT g.user_id, win, t, early, late, CASE WHEN dl <= dr THEN list_prepend(ns[1] - 1, ns) ELSE list_append(ns, ns[-1] + 1) END, met, least, step + 1 FROM (
    SELECT g.*, CASE WHEN x.m BETWEEN early AND late AND abs(x.m - t) <= 43200 THEN abs(x.m - t) ELSE 1e18 END AS dl, CASE WHEN y.m BETWEEN early AND late AND abs(y.m - t) <= 43200 THEN abs(y.m - t) ELSE 1e18 END AS dr
    FROM g LEFT JOIN l x ON x.user_id = g.user_id AND x.n = g.ns[1] - 1 LEFT JOIN l y ON y.user_id = g.user_id AND y.n = g.ns[-1] + 1) g WHERE least(dl, dr) < 1e18),
x AS (SELECT win, step, text, min(l.n) AS n, arg_min(weak, l.n) AS weak FROM (SELECT win, user_id, step, unnest(ns) AS n FROM g) JOIN l USING (user_id, n) GROUP BY win, step, text),
c AS (SELECT win, step, CASE WHEN count(*) > 1 AND bool_or(NOT weak) THEN count(*) FILTER (NOT weak) ELSE count(*) END AS k, CASE WHEN count(*) > 1 AND bool_or(NOT weak) THEN sum(length(text)) FILTER (NOT weak) ELSE sum(length(text)) END AS chars FROM x GROUP BY win, step),
d AS (SELECT win, coalesce(min(step) FILTER (k >= least AND chars >= 18), max(step)) AS step FROM g JOIN c USING (win, step) GROUP BY win)
SELECT g.user_id, g.win AS window_id, array_to_string(list(l.line ORDER BY l.n), ',') AS lines, any_value(met) AS met FROM (SELECT user_id, win, met, unnest(ns) AS n FROM g JOIN d USING (win, step)) g JOIN l USING (user_id, n) GROUP BY ALL""")
def context_lines(spark, sf_dir):
    """What happened around a purchase: events of two hours, and others within twelve hours and the same two days until three lines and 18 characters are there."""
    e = events(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    early = F.floor(F.col("t") / 172800) * 172800.0
    windows = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("window"), (F.col("t") - 2 * H).alias("window_start"), (F.col("t") + 2 * H).alias("window_end"), F.col("t").alias("at"), early.alias("earliest"), (early + 172800.0).alias("latest"))
    text = F.concat("event_type", F.lit(" "), F.floor("value").cast("string"))
    lines = e.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("line"), (F.col("t") - H).alias("line_start"), (F.col("t") + H).alias("line_end"), text.alias("text"), (F.col("value") < 4).alias("weak"))
    got = context.expanded(windows, lines, "user_id", 24 * H, 12 * H)
    return got.select("user_id", F.col("window").alias("window_id"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), "met")


SENTENCES, CLAUSES = r"[.!?\n]", r"[,.!?\n:;]"
#: Rules over the words of the tables' four languages; two share a keyword, and one has a keyword within another.
THEMES = [themes.Theme("English prose", ("the ", "that", "thing"), 4), themes.Theme("Deutsche Texte", ("nicht", "und", "keit"), 6, "lesen"), themes.Theme("Le français", ("ment", "eau", "eaux", "que"), 3), themes.Theme("Español", ("cion", "para", "que"), 5)]
MARKERS = [themes.Marker(("that", "nicht", "avec", "para"), 6.0), themes.Marker(("with", "keit", "pas"), 2.0), themes.Marker(("thing", "sch"), 3.0)]
THEME_ROWS = "(VALUES (0, 'English prose', 'the ', 4, ''), (0, 'English prose', 'that', 4, ''), (0, 'English prose', 'thing', 4, ''), (1, 'Deutsche Texte', 'nicht', 6, 'lesen'), (1, 'Deutsche Texte', 'und', 6, 'lesen'), (1, 'Deutsche Texte', 'keit', 6, 'lesen'), (2, 'Le français', 'ment', 3, ''), (2, 'Le français', 'eau', 3, ''), (2, 'Le français', 'eaux', 3, ''), (2, 'Le français', 'que', 3, ''), (3, 'Español', 'cion', 5, ''), (3, 'Español', 'para', 5, ''), (3, 'Español', 'que', 5, '')) AS t(r, title, word, priority, goal)"
PARTS = r"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, s FROM (SELECT doc_id, k, trim(regexp_replace(p[k], '\s+', ' ', 'g')) AS s FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '{cut}') AS p FROM documents))) WHERE s <> '')"


@query(f"""
WITH s AS {PARTS.format(cut=SENTENCES)}, t AS (SELECT doc_id, r, title, goal, CAST(sum(length(word) + greatest(0, 5 - i) * 3 + priority) AS DOUBLE) AS score FROM s JOIN {THEME_ROWS} ON contains(s, word) GROUP BY ALL),
c AS (SELECT doc_id, 10 + i AS r, trim(substr([trim(x) for x in regexp_split_to_array(s, '{CLAUSES}') if trim(x) <> ''][1], 1, 18), '') AS title, '' AS goal, CAST(60 - i AS DOUBLE) AS score FROM s WHERE i < 3),
u AS (SELECT * FROM t UNION ALL SELECT doc_id, r, title, goal, score FROM c WHERE title IS NOT NULL UNION ALL SELECT doc_id, 99, 'untitled', '', 1.0 FROM documents),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, title ORDER BY score DESC, r) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, r) AS INTEGER) AS place, title, score, goal FROM d""")
def title_choices(spark, sf_dir):
    """Title candidates of whole documents: themes, first clauses, and one for all."""
    return themes.title_candidates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", THEMES, SENTENCES, CLAUSES, "untitled")


@query(f"""
WITH c AS {PARTS.format(cut=CLAUSES)},
p AS (SELECT doc_id, i, trim(substr(s, 1, 72)) AS point, greatest(0, 6 - i) + CASE WHEN regexp_matches(s, 'that|nicht|avec|para') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(s, 'with|keit|pas') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, 'thing|sch') THEN 3 ELSE 0 END AS score FROM c WHERE length(s) >= 4),
d AS (SELECT doc_id, point, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS o FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, point ORDER BY score DESC, i) = 1),
b AS (SELECT doc_id, point, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS place FROM d QUALIFY place <= 3),
f AS (SELECT doc_id, point, min(i) AS i FROM (SELECT doc_id, i, trim(substr(s, 1, 48)) AS point FROM c) WHERE (doc_id, point) NOT IN (SELECT (doc_id, point) FROM b) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1), m AS (SELECT f.*, coalesce(n, 0) + row_number() OVER (PARTITION BY f.doc_id ORDER BY i) AS place FROM f LEFT JOIN n USING (doc_id))
SELECT doc_id, CAST(place AS INTEGER) AS place, md5(point) AS point_md5 FROM b UNION ALL SELECT doc_id, CAST(place AS INTEGER), md5(point) FROM m WHERE place <= 2""")
def point_choices(spark, sf_dir):
    """Key points of whole documents, up to three, at least two where there are clauses."""
    got = themes.key_points(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", MARKERS, clause=CLAUSES)
    return got.select("doc_id", "place", F.md5("point").alias("point_md5"))


@query(f"""
WITH s AS {PARTS.format(cut=SENTENCES)}, k AS (SELECT doc_id, i, s, 10.0 * (CAST(contains(s, 'that') AS INT) + CAST(contains(s, 'nicht') AS INT) + CAST(contains(s, 'avec') AS INT) + CAST(contains(s, 'para') AS INT) + CAST(contains(s, 'ch') AS INT)) AS m FROM s WHERE length(s) >= 4)
SELECT doc_id, md5(s) AS sentence_md5, CAST(m + greatest(0, 6 - i) AS DOUBLE) AS score FROM k WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1""")
def marked_sentences(spark, sf_dir):
    got = themes.best_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", ("that", "nicht", "avec", "para", "ch"), SENTENCES)
    return got.select("doc_id", F.md5("sentence").alias("sentence_md5"), "score")


@query("""
WITH RECURSIVE r AS (SELECT user_id, event_type AS title, event_id % 6 AS path, epoch_us(ts) / 1e6 AS secs, floor(value) AS score, [event_type, 'v' || CAST(floor(value / 20) AS BIGINT)] AS lines, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, i, 1 AS card, title, path, secs, score, lines FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, CASE WHEN joins THEN g.card ELSE g.card + 1 END, CASE WHEN joins AND r.score < g.score THEN g.title ELSE r.title END, CASE WHEN joins AND r.score < g.score THEN g.path ELSE r.path END, CASE WHEN joins AND r.score < g.score THEN g.secs ELSE r.secs END, CASE WHEN joins THEN greatest(r.score, g.score) ELSE r.score END, CASE WHEN joins THEN list_concat(g.lines, [x for x in r.lines if NOT list_contains(g.lines, x)]) ELSE r.lines END
  FROM g JOIN r ON r.user_id = g.user_id AND r.i = g.i + 1, LATERAL (SELECT r.path = g.path OR (r.title = g.title AND r.secs - g.secs <= 43200) AS joins))
SELECT user_id, card, arg_max(title, i) AS title, array_to_string(arg_max(lines, i), ',') AS lines, count(*) AS n_blocks FROM g GROUP BY user_id, card""")
def near_scenes(spark, sf_dir):
    """Neighbouring events of one path, or of one title within twelve hours, as one card with all their lines; cards are numbered in order."""
    e = events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    lines = F.array(F.col("event_type"), F.concat(F.lit("v"), F.floor(F.col("value") / 20).cast("string")))
    b = e.select(F.col("user_id").alias("chapter"), F.col("event_id").alias("id"), "at", F.col("event_type").alias("title"), (F.col("event_id") % 6).cast("string").alias("path"), F.col("at").alias("window_start"), F.col("at").alias("window_end"), F.floor("value").cast("double").alias("score"), lines.alias("lines"))
    cards = folds.scene_cards(b, 12 * H)
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("window_start"))
    return cards.select(F.col("chapter").alias("user_id"), place.alias("card"), "title", F.array_join("lines", ",").alias("lines"), "n_blocks")
