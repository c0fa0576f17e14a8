"""SQL of the same results, for DuckDB."""

from __future__ import annotations

from gleaner.plans import cases, content, fields, files, rules, runs, shapes, stores  # noqa: F401
from gleaner.plans.queries import NAMED

ITEMS = "(SELECT event_id, ts, epoch(ts) AS timestamp, 'https://inbox.example.com/' || user_id || '/' || event_type AS url, event_type FROM events)"
FIRST = "SELECT url, event_id, ts, event_type FROM {rows} QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts, event_id) = 1"
CUT = "TIMESTAMP '2024-01-02 00:00:00'"
LATER = f"(SELECT * FROM {ITEMS} WHERE ts >= {CUT})"
EARLIER = f"(SELECT url FROM {ITEMS} WHERE ts < {CUT})"
NEW = f"SELECT * FROM ({FIRST.format(rows=LATER)}) WHERE url NOT IN {EARLIER}"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


VERIFY = """
SELECT b.item_id, count(d.doc_id) AS match_count, coalesce(bool_or(d.source = 'src0'), false) AS has_total, coalesce(bool_or(d.source <> 'src0'), false) AS has_classified, min(d.doc_id) AS first_doc
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id"""
SHOTS = """(SELECT user_id, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS secs, value, first, last FROM events JOIN (SELECT user_id, CAST(floor(epoch(min(ts))) AS DOUBLE) AS first, CAST(floor(epoch(max(ts))) AS DOUBLE) AS last FROM events GROUP BY 1) USING (user_id) WHERE event_type = 'view')"""
SPAN = "(SELECT user_id, event_id AS id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS z FROM events WHERE event_type = '{kind}' QUALIFY z IS NOT NULL)"
COMMENTS = r"""(SELECT conv_id, turn, conv_id || '-' || turn AS id, role, role = 'assistant' AS by_author, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS level, trim(regexp_replace(text, '\s+', ' ', 'g')) AS content FROM conversations)"""
#: Stock phrases, and what makes a comment worth keeping.
STOCK = "(?i)^(蹲|dd|mark|来了|确实|好看|不错|厉害|学习了|收藏了|收到)$"
SIGNAL = r"(?i)https?://|www\.|\.com\b|工具|网站|链接|网址|提示词|模型|Gemini|gpt|Claude|Vibe|Dribbble|Excalidraw|复刻|截图|配色|字体|图标|资源站|经验|踩坑|纠错|不是|打错|应该|可以用"
USEFUL = f"""(
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN n > 40 AND NOT by_author THEN 1 ELSE 0 END, turn) AS place FROM (
      SELECT *, sum(CAST(good AS INT)) OVER (PARTITION BY conv_id) AS n FROM (
        SELECT *, by_author OR regexp_matches(content, '{SIGNAL}') OR length(content) >= 18 AS good FROM {COMMENTS}
        WHERE content <> '' AND (by_author OR NOT (regexp_matches(content, '{STOCK}') OR regexp_matches(content, '^[赞好棒强牛]+$') OR length(content) <= 2)))) WHERE good OR n = 0)
  WHERE place <= CASE WHEN n = 0 THEN 20 ELSE 40 END)"""

#: The messages of failures (fixed values) in their own order.
FAILURES = "(SELECT event_id, (['connect ECONNREFUSED 127.0.0.1:9222', '请输入验证码', 'code 300011', 'login required', 'error_code=300031 x', 'comment list incomplete', 'comment fetch failed', 'vision ocr broke', 'Summary step FAILED', 'No xiaohongshu tab found', 'something else', ''])[event_id % 12 + 1] AS message, CASE WHEN value > 90 THEN 'captcha' END AS reason, CASE WHEN value < 5 THEN 'comment_incomplete' END AS warning FROM events)"
STAGE = """CASE WHEN regexp_matches(message, '(?i)9222|econnrefused') THEN 'browser_connection' WHEN reason = 'captcha' OR contains(message, '验证码') THEN 'login_gate' WHEN regexp_matches(message, '300011|406|(?i)rate') THEN 'comment_permission'
  WHEN regexp_matches(message, '(?i)login required|sign in') THEN 'login_gate' WHEN regexp_matches(message, '(?i)300031|no xiaohongshu tab found') THEN 'detail_page' WHEN warning = 'comment_incomplete' OR regexp_matches(message, '(?i)comment.*incomplete') THEN 'comment_loading' ELSE 'unknown' END"""
ERROR = """CASE WHEN contains(message, 'ECONNREFUSED') THEN 'chrome_unavailable' WHEN message = 'login required' THEN 'login_required' WHEN contains(message, 'tab found') THEN 'no_xiaohongshu_tab' WHEN contains(message, '300011') THEN 'account_risk_control' WHEN contains(message, '300031') THEN 'note_unavailable'
  WHEN regexp_matches(message, 'comment.*fail') THEN 'comment_fetch_failed' WHEN starts_with(message, 'vision ocr') THEN 'vision_ocr_failed' WHEN starts_with(message, 'Summary') THEN 'ai_failed' ELSE 'unknown' END"""
SCORES = "(CASE WHEN contains(t, 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'that') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'with') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'was') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'thing') THEN 1 ELSE 0 END) AS english, contains(t, 'und')::INT + contains(t, 'nicht')::INT + contains(t, 'keit')::INT + contains(t, 'sch')::INT AS german, contains(t, 'eau')::INT + contains(t, 'ment')::INT + contains(t, 'que')::INT + contains(t, 'avec')::INT AS french, contains(t, 'cion')::INT + contains(t, 'ado')::INT + contains(t, 'para')::INT + contains(t, 'los')::INT AS spanish"

SQL = {
    "failure_stages": f"SELECT {STAGE} AS stage, count(*) AS n, min(event_id) AS first_event FROM {FAILURES} GROUP BY 1",
    "task_errors": f"SELECT code, code = 'chrome_unavailable' AS retriable, code IN ('comment_fetch_failed', 'vision_ocr_failed', 'ai_failed') AS allow_write, code IN ('comment_fetch_failed', 'vision_ocr_failed', 'ai_failed') AS allow_fallback, count(*) AS n, min(event_id) AS first_event FROM (SELECT event_id, {ERROR} AS code FROM {FAILURES}) GROUP BY ALL",
    "recent_candidates": f"SELECT url, arg_min(event_id, (ts, event_id)) AS event_id FROM (SELECT * FROM {ITEMS} ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE event_type IN ('purchase', 'click') GROUP BY url",
    "version_places": """
WITH v AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey, base, k, base || CASE WHEN k = 0 THEN '' ELSE '-' || k END AS version
  FROM (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y%m') || '-0' || (day(o_orderdate) % 3) AS base, o_orderkey % 4 AS k FROM orders) GROUP BY ALL)
SELECT o_custkey, version, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY base DESC, greatest(k, 1) DESC, version DESC) AS INTEGER) AS place FROM v""",
    "review_select": """
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN conv_id % 3 = 0 AND n > 1 THEN 3 - i ELSE i END AS INTEGER) AS place FROM r WHERE conv_id % 3 <> 0 OR i <= 2""",
    "sampling_points": """
WITH u AS (SELECT user_id, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS DOUBLE) AS d, CAST(CASE WHEN count(*) <= 2 THEN count(*) ELSE least(count(*), greatest(3, least(6, (count(*) + 1) // 2))) END AS INTEGER) AS n FROM events GROUP BY 1)
SELECT user_id, n, CAST(i - 1 AS INTEGER) AS at, round_even(d / (n + 1) * i, 2) AS point FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE d > 0)""",
    "mirror_targets": "SELECT doc_id, 'all' AS root, 'documents' AS collection FROM documents UNION ALL SELECT doc_id, 'by-language', coalesce(lang, '') FROM documents",
    "link_sets": """
SELECT user_id, count(DISTINCT event_type) FILTER (high) AS n_left, count(DISTINCT event_type) FILTER (NOT high) AS n_right, coalesce(list_sort(list_distinct(list(event_type) FILTER (high))), []) = coalesce(list_sort(list_distinct(list(event_type) FILTER (NOT high))), []) AS same
FROM (SELECT user_id, event_type, coalesce(value > 50, false) AS high FROM events) GROUP BY 1""",
    "document_urls": r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, url FROM (SELECT doc_id, url, min(i) AS i
FROM (SELECT doc_id, regexp_replace(unnest(u), '[),.;]+$', '') AS url, generate_subscripts(u, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, 'https?://[^\s]+') AS u FROM documents)) GROUP BY 1, 2)""",
    "inbox_sync": f"SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS added, min(event_id) AS first_event FROM ({FIRST.format(rows=f'(SELECT * FROM {LATER} WHERE timestamp >= epoch(TIMESTAMP {chr(39)}2024-01-02 18:20:00{chr(39)}))')}) WHERE url NOT IN {EARLIER} GROUP BY 1, 2",
    "inbox_dedup": f"SELECT url, event_id FROM ({FIRST.format(rows=ITEMS)})",
    "inbox_append_known": f"SELECT url, event_id FROM ({NEW})",
    "inbox_append_counts": f"SELECT (SELECT count(*) FROM ({NEW})) AS added, (SELECT count(*) FROM {LATER}) - (SELECT count(*) FROM ({NEW})) AS skipped",
    "window_filter": "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15 06:30:00'",
    "month_archive": "SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2",
    "high_water_mark": "SELECT max(ts) AS mark, count(*) AS n_pulled FROM events",
    "url_source_detect": f"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT -(row_number() OVER ()), unnest FROM unnest([{sql_list(NAMED)}])), p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM u)
SELECT page_id, CASE
  WHEN regexp_matches(host, '(^|\\.)xiaohongshu\\.com$') AND regexp_matches(path, '^/(discovery/item|explore)/') THEN 'xiaohongshu'
  WHEN host = 'mp.weixin.qq.com' AND starts_with(path, '/s') THEN 'wechat_article'
  WHEN host = 'zhuanlan.zhihu.com' AND regexp_matches(path, '^/p/\\d+') THEN 'zhihu_article'
  WHEN regexp_matches(host, '(^|\\.)zhihu\\.com$') AND regexp_matches(path, '^/question/\\d+/answer/\\d+') THEN 'zhihu_answer'
  WHEN regexp_matches(host, '(^|\\.)zhihu\\.com$') AND regexp_matches(path, '^/collection/\\d+') THEN 'zhihu_collection'
  WHEN regexp_matches(host, '(^|\\.)csdn\\.net$') AND regexp_matches(path, '/article/details/\\d+') THEN 'csdn_article'
  ELSE 'generic_web' END AS source FROM p""",
    "url_distinct": "SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, min(page_id) AS page_id FROM pages GROUP BY 1",
    "html_article": r"""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<meta[^>]+name="title"[^>]+content="([^"]*)"', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')) AS title, CAST(len(regexp_extract_all(html, '(?i)<a href=')) AS INTEGER) AS n_links FROM pages""",
    "library_verify": VERIFY,
    "verify_summary": f"SELECT count(*) AS candidates, count(*) FILTER (has_total AND has_classified) AS ok_both, count(*) FILTER (NOT has_total) AS missing_total, count(*) FILTER (NOT has_classified) AS missing_classified FROM ({VERIFY})",
    "classify_keywords": f"SELECT doc_id, CASE WHEN greatest(english, german, french, spanish) = 0 THEN 'unclassified' WHEN english >= greatest(german, french, spanish) THEN 'english' WHEN german >= greatest(french, spanish) THEN 'german' WHEN french >= spanish THEN 'french' ELSE 'spanish' END AS category FROM (SELECT doc_id, {SCORES} FROM (SELECT doc_id, lower(text) AS t FROM documents))",
    "clean_text": r"""
SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{FEFF}]+', ' ', 'g'))) AS squeezed_md5, substr(trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g')), 1, 40) AS name,
  regexp_matches(text, '\d{4}-\d{2}-\d{2}') OR regexp_matches(text, '\d{2}-\d{2}') AS has_date, CAST(len(regexp_extract_all(text, 'https?://[^\s]+')) AS INTEGER) AS n_urls FROM documents""",
    "term_rank": r"""
WITH s AS (SELECT doc_id, i, trim(regexp_replace(s, '\s+', ' ', 'g')) AS sentence FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?\n]+'), 1) AS i FROM documents)),
r AS (SELECT * FROM s WHERE sentence <> ''), w AS (SELECT doc_id, i, unnest(string_split(sentence, ' ')) AS word FROM r), f AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2),
c AS (SELECT doc_id, i, sum(n) AS score FROM w JOIN f USING (doc_id, word) GROUP BY 1, 2), u AS (SELECT doc_id, sentence, min(i) AS i FROM r GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS INTEGER) AS rank, md5(sentence) AS sentence_md5, CAST(score AS BIGINT) AS score FROM u JOIN c USING (doc_id, i) QUALIFY rank <= 3""",
    "status_report": "SELECT count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'signup')) AS success, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN success = 0 THEN 'failed' WHEN success = total THEN 'success' ELSE 'partial' END AS status FROM events",
    "warning_histogram": "SELECT code, count(*) AS n FROM (SELECT event_type AS code FROM events UNION ALL SELECT 'high' FROM events WHERE value > 50) GROUP BY 1",
    "result_groups": "SELECT event_type, count(*) AS n_items, count(DISTINCT user_id) AS n_links, count(*) FILTER (value > 50) AS n_warnings, CAST(max(CAST(event_type = 'error' AS INT)) AS INT) AS is_failure FROM events GROUP BY 1",
    "facets": "SELECT 'all' AS facet, count(*) AS n FROM events UNION ALL SELECT 'warnings', count(*) FROM events WHERE value > 50 UNION ALL SELECT 'error_warnings', count(*) FROM events WHERE value > 50 AND event_type = 'error' UNION ALL SELECT 'warned_' || k, (SELECT count(*) FROM events WHERE value > 50 AND event_type = k) FROM unnest(['click', 'error', 'purchase', 'signup', 'view']) AS t(k)",
    "comment_select": f"SELECT conv_id, turn, CAST(place AS INTEGER) AS place FROM {USEFUL}",
    "comment_threads": f"""
SELECT conv_id, thread, count(*) AS n_lines, md5(string_agg(line, '<br>' ORDER BY level, place)) AS lines_md5
FROM (SELECT conv_id, CASE WHEN level > 0 THEN conv_id || '-' || (turn - 1) ELSE id END AS thread, level, place, CASE WHEN level > 0 THEN '↳ ' ELSE '' END || replace(content, '|', chr(92) || '|') AS line FROM {USEFUL}) GROUP BY 1, 2""",
    "comment_merge": """
SELECT conv_id, conv_id || '-' || turn AS comment_id, md5(CASE WHEN turn >= 2 THEN text ELSE substr(text, 1, CAST(floor(length(text) / 2) AS INT)) END) AS content_md5, CASE WHEN turn >= 2 THEN '2024-05-01' ELSE '05-01' END AS date,
  CASE WHEN turn < 2 THEN turn WHEN turn > 4 THEN 10 - turn ELSE greatest(turn, 10 - turn) END AS like_count, CAST(CASE WHEN turn <= 4 THEN 1 ELSE 0 END AS INT) AS reply_count, role = 'assistant' AS is_author, CAST(CASE WHEN turn BETWEEN 2 AND 4 THEN 2 ELSE 1 END AS BIGINT) AS n_readings FROM conversations""",
    "interval_bind": f"SELECT p.event_id AS shot_id, s.id AS chapter_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN {SPAN.format(kind='signup')} s ON p.user_id = s.user_id AND p.ts BETWEEN s.a AND s.z",
    "interval_overlap": f"SELECT w.event_id AS window_id, s.id AS segment_id FROM (SELECT * FROM events WHERE event_type = 'error') w JOIN {SPAN.format(kind='view')} s ON w.user_id = s.user_id AND s.z > w.ts - INTERVAL 1 HOUR AND s.a < w.ts + INTERVAL 1 HOUR",
    "nearest_event": "SELECT p.event_id AS shot_id, arg_min(c.event_id, (abs(epoch_us(c.ts) - epoch_us(p.ts)), c.event_id)) AS segment_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id GROUP BY 1",
    "caption_window": f"""
WITH w AS (SELECT event_id, secs, greatest(coalesce((lag(secs) OVER k + secs) / 2, first), first) AS a, least(coalesce((lead(secs) OVER k + secs) / 2, last), last) AS z FROM {SHOTS} WINDOW k AS (PARTITION BY user_id ORDER BY secs, event_id))
SELECT event_id, CASE WHEN z <= a THEN greatest(0.0, secs - 4) ELSE a END AS window_start, CASE WHEN z <= a THEN secs + 4 ELSE z END AS window_end FROM w""",
    "bucket_best": f"SELECT user_id, CAST(bucket AS INTEGER) AS bucket, event_id FROM (SELECT *, ntile(4) OVER (PARTITION BY user_id ORDER BY secs, event_id) AS bucket FROM {SHOTS}) QUALIFY row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, secs, event_id) = 1",
    "downsample": f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY secs, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) - 1 AS last FROM {SHOTS}) WHERE last < 5 OR i IN (0, round_even(last / 4, 0), round_even(last / 2, 0), round_even(3 * last / 4, 0), last)",
    "greedy_merge": r"""
WITH RECURSIVE w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS words FROM conversations),
r AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, j) AS i FROM (SELECT conv_id, turn, unnest(words) AS t, generate_subscripts(words, 1) AS j FROM w) WHERE t <> ''),
g AS (SELECT conv_id, i, turn, t, 1 AS grp, length(t) AS chars, 1 AS n FROM r WHERE i = 1
  UNION ALL SELECT r.conv_id, r.i, r.turn, r.t, CASE WHEN done THEN g.grp + 1 ELSE g.grp END, CASE WHEN done THEN length(r.t) ELSE g.chars + length(r.t) END, CASE WHEN done THEN 1 ELSE g.n + 1 END
  FROM (SELECT *, chars >= 80 OR n >= 8 OR regexp_matches(t, '[。！？.!?]$') AS done FROM g) g JOIN r ON r.conv_id = g.conv_id AND r.i = g.i + 1)
SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, md5(string_agg(t, ' ' ORDER BY i)) AS text_md5 FROM g GROUP BY conv_id, grp""",
    "scene_merge": """
WITH RECURSIVE r AS (SELECT user_id, event_type AS title, event_type || ':' || CAST(floor(value) AS BIGINT) AS path, CAST(floor(epoch(ts)) AS DOUBLE) AS secs, CAST(floor(value) AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
g AS (SELECT user_id, i, secs AS block, 1 AS card, title, path, secs, score FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, r.secs, CASE WHEN joins THEN card ELSE card + 1 END, CASE WHEN joins AND r.score < top THEN head ELSE r.title END, CASE WHEN joins AND r.score < top THEN head_path ELSE r.path END, CASE WHEN joins AND r.score < top THEN head_at ELSE r.secs END, CASE WHEN joins THEN greatest(r.score, top) ELSE r.score END
  FROM (SELECT g.user_id, g.i, g.card, g.title AS head, g.path AS head_path, g.secs AS head_at, g.score AS top FROM g) g JOIN r ON r.user_id = g.user_id AND r.i = g.i + 1, LATERAL (SELECT r.path = head_path OR (r.title = head AND r.secs - head_at <= 43200) AS joins))
SELECT user_id AS chapter, arg_max(title, i) AS title, arg_max(secs, i) AS shown_at, min(block) - 60 AS window_start, max(block) + 60 AS window_end, count(*) AS n_blocks FROM g GROUP BY user_id, card""",
    "latest_version": """
WITH v AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) = 1)
SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS n_versions FROM v QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1""",
    "quality_report": """
WITH i AS (SELECT source, text, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT source, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, count(*) FILTER (n > 1) AS n_repeated, round_even(sum(n * length(text)) / sum(n), 2) AS average, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS greatest FROM i GROUP BY 1)
SELECT *, concat_ws(',', CASE WHEN n_repeated > 0 THEN 'duplicate-items' END, CASE WHEN average < 1500 THEN 'items-too-short' END) AS warnings FROM r""",
    "stream_dedup": f"SELECT url, event_id FROM ({FIRST.format(rows=ITEMS)})",
}
SQL |= cases.SQL
