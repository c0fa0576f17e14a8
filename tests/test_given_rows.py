"""Rules over given rows, with the rows expected of them."""

import json

import pytest
from oracle import differences
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import checks, links, notes, text
from gleaner.operators import boards, captions, results
from gleaner.sources import articles, favorites, ingress, replies
from gleaner.streaming import sync

QUERIES, SQL = {}, {}
NOW = "2026-01-01 00:00:00"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def expected(columns: str, *rows: tuple) -> str:
    """SQL of given rows; a column may have a type after a colon."""
    quote = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    typed = [c.partition(":") for c in columns.split(", ")]
    names, kept = ", ".join(f'"{c}"' for c, _, _ in typed), ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' if t else f'"{c}"' for c, _, t in typed)
    return f"SELECT {kept} FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({names})"


def given(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@query(expected("k, since, label, n:BIGINT", (1, 0.0, "今天", 0), (2, 77.0, "最近 3 个月", 3), (3, 50.0, "", 0), (4, 50.0, "最近 7 天", 7), (5, 0.0, "最近 2 年", 2), (6, 50.0, "", 0)))
def sync_windows(spark, sf_dir):
    rows = given(spark, "k int, mode string, preset string, value string, unit string", (1, "all", "Today", "", ""), (2, "window", "", "3.9", "month"), (3, "odd", "", "x", "day"), (4, "latest", " 7D ", "7", ""), (5, "recent", None, "2", "YEAR"), (6, None, "9d", "-4", "day"))
    since = sync.since_of(sync.mode_of(F.col("mode")), F.lit(50.0), F.lit(77.0))
    return rows.select("k", since.alias("since"), sync.window_label(F.col("preset"), F.col("value"), F.col("unit")).alias("label"), sync.positive_integer(F.col("value")).alias("n"))


@query(expected("k, folder", (1, "/a/b"), (2, "/set"), (3, "/given")))
def output_folders(spark, sf_dir):
    r = given(spark, "status string, filepath string", ("success", "/a/b/x.md"), (None, "/a/b/y.md"), ("failed", "/z/q.md"), ("success", " "))
    more = r.union(given(spark, "status string, filepath string", ("success", "/c/x.md")))
    each = [results.output_folder(r, "", "/set"), results.output_folder(more, "", "/set"), results.output_folder(more, "/given", "/set")]
    each = [x.select(F.lit(k).alias("k"), "folder") for k, x in enumerate(each, 1)]
    return each[0].union(each[1]).union(each[2])


TEXTS = [
    (1, "看 https://www.xiaohongshu.com/explore/abc12?x=1， 再 https://xiaohongshu.com/discovery/item/abc12） 和 http://A.example/Q", ""),
    (2, "https://www.xiaohongshu.com/explore/zz9", ""),
    (3, "no link", "see (https://ex.example/a,b). and http://two.example"),
    (4, None, "http:// https://ok.example/x!?"),
]


@query(expected("k, place, url, note_id, canonical, kind", (1, 0, "https://www.xiaohongshu.com/explore/abc12?x=1", "abc12", "https://www.xiaohongshu.com/discovery/item/abc12", "share_text"), (1, 1, "http://A.example/Q", "", "http://A.example/Q", "share_text"), (2, 0, "https://www.xiaohongshu.com/explore/zz9", "zz9", "https://www.xiaohongshu.com/discovery/item/zz9", "url")))
def note_links(spark, sf_dir):
    return given(spark, "k int, a string, b string", *TEXTS).select("k", F.posexplode(links.note_inputs("a")).alias("place", "x")).select("k", "place", "x.*")


@query(expected("k, url", (1, "https://www.xiaohongshu.com/explore/abc12?x=1"), (2, "https://www.xiaohongshu.com/explore/zz9"), (3, "https://ex.example/a,b"), (4, "https://ok.example/x")))
def chat_links(spark, sf_dir):
    return given(spark, "k int, a string, b string", *TEXTS).select("k", links.first_chat_link("a", "b").alias("url"))


VIDEOS = [(1, "https://www.bilibili.com/video/BV1?spm=2&p=3&t=9"), (2, "https://www.youtube.com/watch?t=5s&v=ab&feature=x&list=L"), (3, "https://www.xiaohongshu.com/explore/1?t=2&x=3"), (4, "https://v.example/1?b=2&t=3&a=1#part"), (5, "https://youtu.be/ab")]


@query(expected("k, platform, clean, timed", (1, "bilibili", "https://www.bilibili.com/video/BV1?p=3", "https://www.bilibili.com/video/BV1?p=3&t=75"), (2, "youtube", "https://www.youtube.com/watch?v=ab&list=L", "https://www.youtube.com/watch?v=ab&list=L&t=75s"), (3, "xiaohongshu", "https://www.xiaohongshu.com/explore/1", "https://www.xiaohongshu.com/explore/1"), (4, "unknown", "https://v.example/1?b=2&a=1", "https://v.example/1?b=2&a=1&t=75"), (5, "youtube", "https://youtu.be/ab", "https://youtu.be/ab?t=75s")))
def video_links(spark, sf_dir):
    u, p = F.col("url"), links.platform(F.col("url"))
    return given(spark, "k int, url string", *VIDEOS).select("k", p.alias("platform"), links.video_link(u, p).alias("clean"), links.timed_link(u, p, F.lit(75.9)).alias("timed"))


@query(expected("k, n, first", (1, 2, "https://ci.xiaohongshu.com/a"), (2, 0, None)))
def note_images(spark, sf_dir):
    rows = given(spark, "k int, urls array<string>", (1, ["//ci.xiaohongshu.com/a", "http://ads.example/b", "https://sns-img.example/c", "http://ci.xiaohongshu.com/d"]), (2, ["https://ads.example/"]))
    kept = links.content_images(F.transform("urls", links.image_link), ["ci.xiaohongshu", "sns-img"], 2)
    return rows.select("k", F.size(kept).alias("n"), F.get(kept, F.lit(0)).alias("first"))


@query(expected("k, code, reason", (1, "given", ""), (2, "comment_login_required", "login_required"), (3, "comment_incomplete", ""), (4, "comment_warning", "captcha"), (5, "", "set"), (6, "comment_warning", "risk_control"), (7, "", "")))
def note_warnings(spark, sf_dir):
    rows = given(spark, "k int, explicit string, reason string, message string, total int, got int", (1, " given ", None, "", 5, 1), (2, "", "", "网页端提示需要登录", 5, 1), (3, None, "", "", 5, 1), (4, "", "", "请输入 Captcha", 2, 2), (5, "", "set", "", 0, 0), (6, "", "", "code 406", None, None), (7, "", "", None, 3, 9))
    code = notes.comment_warning("explicit", "message", F.col("total"), F.col("got"))
    return rows.select("k", code.alias("code"), notes.manual_reason("reason", code, "message").alias("reason"))


@query(expected("k, summary, tags, cleaned", (1, "first", "小红书,a,b", "好用,tips,笔记"), (2, "title", "小红书,笔记,笔记", "好用,笔记,笔记"), (3, "x" * 50, "小红书,1,2,3,4", "aa,bb,cc,dd,ee")))
def note_summaries(spark, sf_dir):
    rows = given(spark, "k int, title string, content string, tags array<string>, ai array<string>", (1, "title", "first\nsecond", ["a", "b", "a"], [" 好用 ", "x", "tips"]), (2, "title", "", None, ["\u0001a"]), (3, None, "x" * 80, ["1", "2", "3", "4", "5"], ["aa", "bb", "cc", "dd", "ee", "ff"]))
    join = lambda x: F.array_join(x, ",")
    return rows.select("k", notes.fallback_summary("title", "content").alias("summary"), join(notes.fallback_tags(F.col("tags"))).alias("tags"), join(notes.summary_tags(F.col("ai"), F.array(F.lit("好用")).cast("array<string>"))).alias("cleaned"))


@query(expected("k, mended, score, spoken", (1, "小红书收藏夹AI的", 0.133333, "小红书收藏天Al寡"), (2, "", 0.0, ""), (3, "ab!!", 0.75, "ab!!"), (4, "呃你好嗯  ok啊", 0.266667, "你好 ok")))
def ocr_texts(spark, sf_dir):
    rows = given(spark, "k int, t string", (1, "小红书收藏天Al寡"), (2, None), (3, "ab!!"), (4, "呃你好嗯  ok啊"))
    return rows.select("k", notes.ocr_mended("t").alias("mended"), F.round(notes.ocr_anomaly("t"), 6).alias("score"), notes.spoken_cleaned("t").alias("spoken"))


@query(expected("k, body, tags, segment, title, folder, date", (1, "text", "a,b c", "My-List_", "Title", "Title - 知乎", "2024-05-06"), (2, "--- open", "", "group", "List", "List · 收藏夹", "later"), (3, "plain\n---\nmore", "x", "a_b", "A C", "A C｜知乎 - 收藏夹", "x 2024-5-6")))
def note_texts(spark, sf_dir):
    rows = given(
        spark, "k int, md string, about string, name string, title string, date string", (1, "﻿---\na: 1\n---\n\ntext\n", "#a##b c[话题]# #a#", "My  List?", "Title - 知乎", "on 2024-05-06 or 2024-07-08"), (2, "--- open", "# ", " ", "List · 收藏夹", " later "),
        (3, "plain\n---\nmore", "z #x# y", "a/b", "A C｜知乎 - 收藏夹", "x 2024-5-6"),
    )
    return rows.select("k", notes.body_of("md").alias("body"), F.array_join(notes.description_tags("about"), ",").alias("tags"), notes.file_segment("name").alias("segment"), notes.collection_title("title").alias("title"), notes.folder_title("title").alias("folder"), notes.first_date("date").alias("date"))


@query(expected("k, comment, published, requested, run", (1, "2024-05-06 07:08", "2024-05-06", "2024-05-06 07:08:09", "save-web-2024-05-06T070809Z"), (2, "", None, NOW, "task-unknown-"), (3, "", "May 2024", NOW, "task-web-2024"), (4, "1970-01-01 00:00", "2001-09-09", "2001-09-09 01:46:40", "task-web-1")))
def note_times(spark, sf_dir):
    rows = given(spark, "k int, ms string, published string, at string, kind string, source string, stamp string", (1, "1714979289000", "1714979289000", "2024-05-06T07:08:09Z", "save", "web", "2024-05-06T07:08:09Z"), (2, "x", " ", "", None, "", None), (3, "-5", "May 2024", "soon", " ", "web", "May 2024"), (4, "1", "1000000000", "1000000000", "task", "web", "1"))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return rows.select("k", notes.comment_time("ms").alias("comment"), notes.published_date("published").alias("published"), stamp(notes.request_time("at", F.lit(NOW).cast("timestamp"))).alias("requested"), notes.run_id("kind", "source", "stamp").alias("run"))


@query(expected("k, line", (1, "请先登录"), (2, "last"), (3, "broke"), (4, "Internal Server Error")))
def error_lines(spark, sf_dir):
    rows = given(spark, "k int, logs array<string>, message string", (1, ["start", "请先登录", "账号异常"], "m"), (2, ["start", "last"], "m"), (3, [], "broke"), (4, None, None))
    return rows.select("k", notes.telling_line(F.coalesce("logs", F.array().cast("array<string>")), "message").alias("line"))


COMMENTS = [
    (1, [{"id": "a", "userInfo": {"nickname": "A"}, "content": " hi  there ", "createTime": 1714979289000, "likeCount": "3", "subCommentCount": 2, "showTags": ["is_author"], "subComments": [{"id": "b", "content": "x", "subComments": [{"comment_id": "c", "text": "deep", "time": 0}]}, {"content": "no id"}]}]),
    (2, [{"commentId": "d", "user": {"name": "D"}, "rootCommentId": "r", "desc": "y"}, "odd"]),
    (3, None),
]


@query(expected("note_id:BIGINT, seq, comment_id, root_id, parent_id, author, content, date, level, like_count:BIGINT, reply_count:BIGINT, is_author", (1, 0, "a", "a", "", "A", "hi there", "2024-05-06 07:08", 0, 3, 2, True), (1, 1, "b", "a", "a", "", "x", "", 1, 0, 0, False), (1, 2, "c", "a", "b", "", "deep", "", 2, 0, 0, False), (2, 0, "d", "r", "", "D", "y", "", 0, 0, 0, False)))
def nested_replies(spark, sf_dir):
    pages = given(spark, "note_id long, comments string", *((i, json.dumps(c) if c else "no list") for i, c in COMMENTS))
    return replies.flattened(pages).withColumn("time", notes.comment_time("time")).withColumnRenamed("time", "date")


@query(expected("k, ok, message", (1, True, ""), (2, False, "comments blocked by 300011"), (3, False, "comments blocked by unknown"), (4, True, "")))
def comment_pages(spark, sf_dir):
    rows = given(spark, "k int, status int, success boolean, code string", (1, 200, None, "0"), (2, 200, True, "300011"), (3, 500, True, None), (4, 204, True, "ok"))
    a = (F.col("status"), F.col("success"), F.col("code"))
    return rows.select("k", replies.page_succeeded(*a).alias("ok"), replies.blocked_message(*a).alias("message"))


FAVORITES = [
    (0, {"data": [{"content": {"id": 1, "url": "https://zhuanlan.zhihu.com/p/12", "title": " T "}}, {"content": {"id": "2", "url": ""}}, {"content": {"id": "3", "url": "https://ex.example/"}}], "paging": {"next": "http://x/items?offset=20&limit=20", "totals": 5}}),
    (1, {"data": [{"content": {"id": "4", "url": "https://www.zhihu.com/question/1/answer/2", "question": {"title": "Q"}}}, {"content": {"id": "1", "url": "https://zhuanlan.zhihu.com/p/12"}}, {"content": {"url": "x"}}], "paging": {"is_end": True}}),
    (2, {"data": [{"content": {"id": "9", "url": "https://zhuanlan.zhihu.com/p/99"}}]}),
]


def _favorites(spark):
    return favorites.pages_of(given(spark, "page int, body string", *((k, json.dumps(b)) for k, b in FAVORITES)))


@query(expected("page, n, has_more, next_offset:BIGINT, totals:BIGINT, first_title", (0, 3, True, 20, 5, "T"), (1, 3, False, 0, 0, "Q"), (2, 1, True, 0, 0, "")))
def favorite_pages(spark, sf_dir):
    return _favorites(spark).select("page", F.size("items").alias("n"), "has_more", "next_offset", "totals", F.col("items")[0]["title"].alias("first_title"))


@query(expected("id, error", ("1", None), ("2", "favorite item 2 is missing url"), ("3", "favorite item 3 has unsupported url: https://ex.example/"), ("4", None), ("1", None), ("", "missing favorite item id"), ("9", None)))
def favorite_checks(spark, sf_dir):
    return favorites.checked(_favorites(spark).select(F.explode("items").alias("x")).select("x.id", "x.url")).select("id", "error")


@query(expected("id, page, source_type, start", ("1", 0, "zhihu_article", 0), ("1", 1, "zhihu_article", 1)))
def favorites_to_export(spark, sf_dir):
    """From the first page, and from the second; number 4 is exported already."""
    done = given(spark, "id string", ("4",))
    each = [favorites.to_export(_favorites(spark), done, k).select("id", "page", "source_type", F.lit(k).alias("start")) for k in (0, 1)]
    return each[0].union(each[1])


HTML = [
    (1, "https://mp.weixin.qq.com/s/1", "wechat_article", '<meta property="og:url" content="https://mp.weixin.qq.com/s/real"><h1 id="activity-name"> Ti<b>tle</b> </h1><a id="js_name" href="/me">Me</a><em id="publish_time">2024-05-06</em><div id="js_content"><p>Hello<br>you</p><img data-src=" https://i/1 " src="x"><img></div><p>foot</p>'),
    (2, " https://zhuanlan.zhihu.com/p/2 ", "zhihu_article", '<body><h1>Head</h1><a class="x UserLink-link" href="people/a">Ann</a><span class="ContentItem-time">posted 2024-01-02 10:00</span><div class="Post-RichTextContainer">Text<img src="s" data-original="o"></div></body>'),
    (3, "https://blog.csdn.net/a/article/details/3", "csdn_article", "<body><h1 class='title-article'>C</h1><span class='time'>long ago</span>All <i>text</i></body>"),
    (4, "https://ex.example/", "generic_web", "<h1>no</h1>"),
]


@query(expected("page_id:BIGINT, canonical_url, title, author, author_link, date, content, image", (1, "https://mp.weixin.qq.com/s/real", "Title", "Me", "/me", "2024-05-06", "Helloyou", "https://i/1"), (2, "https://zhuanlan.zhihu.com/p/2", "Head", "Ann", "https://www.zhihu.com/people/a", "2024-01-02", "Text", "o"), (3, "https://blog.csdn.net/a/article/details/3", "C", "", "", "long ago", "Clong agoAll text", None)))
def article_pages(spark, sf_dir):
    a = articles.articles(given(spark, "page_id long, url string, source_type string, html string", *HTML))
    return a.select("page_id", "canonical_url", "title", "author", "author_link", "date", "content", F.get("images", F.lit(0)).alias("image"))


REQUESTS = [(1, {"url": "https://ex.example/a", "title": " T ", "requested_at": "2024-05-06T07:08:09Z", "delivery_mode": "queue"}), (2, {"link": "HTTPS://ex.example/b", "metadata": {"page_title": "M"}, "source": " ", "requestedAt": "never"}), (3, {"url": "ftp://ex.example"}), (4, None)]


@query(expected("id, url, source, route, delivery_mode, at, title, error", (1, "https://ex.example/a", "external", "local", "queue", "2024-05-06 07:08:09", "T", None), (2, "HTTPS://ex.example/b", "external", "local", "immediate", NOW, "M", None), (3, None, "external", "local", "immediate", NOW, "", "Invalid url"), (4, None, "external", "local", "immediate", NOW, "", "Invalid url")))
def ingress_requests(spark, sf_dir):
    r = ingress.requests(given(spark, "id int, body string", *((k, json.dumps(b)) for k, b in REQUESTS)), F.lit(NOW).cast("timestamp"))
    return r.withColumn("requested_at", F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss")).withColumnRenamed("requested_at", "at")


CHATS = [(1, {"token": "k", "event": {"message": {"content": json.dumps({"text": "see https://ex.example/c!"}), "create_time": "1714979289000"}}}), (2, {"token": "k", "text": "none here", "content": "but https://ex.example/d"}), (3, {"header": {"token": "k"}, "text": "nothing"}), (4, {"token": "bad", "url": "https://ex.example/e"})]


@query(expected("id, url, route, at, error", (1, "https://ex.example/c", "cloud", "2024-05-06 07:08:09", None), (2, "https://ex.example/d", "cloud", NOW, None), (3, None, "cloud", NOW, "Webhook message does not contain url"), (4, None, "cloud", NOW, "Invalid webhook token")))
def chat_requests(spark, sf_dir):
    r = ingress.chat_requests(given(spark, "id int, body string", *((k, json.dumps(b)) for k, b in CHATS)), F.lit(NOW).cast("timestamp"), "k")
    return r.select("id", "url", "route", F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "error")


@query(expected("video, automatic, language, ext, url", (1, False, "zh-CN", "vtt", "u3"), (2, True, "en", "srt", "u5"), (3, False, "fr", "ass", "u7")))
def subtitle_choices(spark, sf_dir):
    rows = given(
        spark, "video int, automatic boolean, language string, language_seq int, ext string, url string, seq int", (1, True, "zh", 0, "vtt", "u1", 0), (1, False, "en", 0, "vtt", "u2", 0), (1, False, "zh-CN", 1, ".VTT", "u3", 1), (1, False, "zh-CN", 1, "json3", "u4", 0),
        (2, True, "en", 0, "srt", "u5", 0), (2, False, "zh", 0, "vtt", "", 0), (3, False, "fr", 0, "ass", "u7", 0), (3, False, "de", 1, "vtt", "u8", 0),
    )
    return captions.subtitle_choice(rows, ["zh", "en"], ["vtt", "srt"]).withColumn("ext", F.regexp_replace(F.lower("ext"), r"^\.", ""))


@query(expected("video:BIGINT, chapter:BIGINT, shot:BIGINT", (1, 10, 2), (1, 11, 3), (2, 20, 5)))
def shared_shots(spark, sf_dir):
    """A screenshot on the edge of two chapters goes to the first that wants it; a chapter without any left gets none."""
    rows = given(spark, "video long, chapter long, chapter_start double, shot long, at double, score double", (1, 11, 10.0, 2, 10.0, 0.9), (1, 11, 10.0, 3, 12.0, 0.1), (1, 10, 0.0, 2, 10.0, 0.5), (1, 10, 0.0, 1, 5.0, 0.4), (2, 20, 0.0, 5, 1.0, 0.3), (2, 20, 0.0, 6, 2.0, 0.3), (2, 21, 1.0, 5, 1.0, 0.3))
    return captions.bind_one_to_one(rows)


@query(expected("path, alt, at, chapter, window_start, window_end, lines, ocr", ("a", "second", 5.0, "C", 1.0, 9.0, "x,y,z,w", "text"), ("b", "only", 1.0, "", 0.0, 2.0, "", "")))
def caption_blocks(spark, sf_dir):
    rows = given(spark, captions.BLOCK, ("a", "first", 3.0, "", 2.0, 6.0, ["x", "y"], ""), ("a", "second", 5.0, "C", 4.0, 9.0, ["y", "z", "w"], ""), ("a", "third", 7.0, "D", 1.0, 7.0, ["x", "z", "w"], "text"), ("b", "only", 1.0, None, 0.0, 2.0, [], None))
    return captions.merged_by_path(rows).withColumn("lines", F.array_join("lines", ","))


@query(expected("k, text", (1, "一，二，三。四。"), (2, "a" * 26 + "。b！"), (3, "暂无匹配字幕。")))
def narration(spark, sf_dir):
    rows = given(spark, "k int, clauses array<string>", (1, ["一", "二", "三", "四"]), (2, ["a" * 26, "b！"]), (3, []))
    return rows.select("k", captions.paragraph(F.col("clauses")).alias("text"))


@query(expected("k, body", (1, "by title"), (2, "by path"), (3, None)))
def block_lookup(spark, sf_dir):
    rows = given(spark, "k int, chapter string, path string", (1, "A", "p1"), (2, "B", "p2"), (3, "C", "p3"))
    return captions.with_fallback(rows, given(spark, "chapter string, body string", ("A", "by title")), "chapter", given(spark, "path string, body string", ("p1", "other"), ("p2", "by path")), "path", "body").select("k", "body")


TASK = {"type": "note-save", "source": "web", "input": "https://ex.example/"}


TASKS = [
    TASK, None, {**TASK, "type": ""}, {**TASK, "source": 0}, {**TASK, "input": None}, {**TASK, "input": ""}, {**TASK, "input": "", "options": {"mode": "current"}},
    {**TASK, "route": 5}, {**TASK, "deliveryMode": None}, {**TASK, "metadata": []}, {**TASK, "metadata": {}, "route": ""}, {**TASK, "type": "list", "input": False}, [],
]


@query(expected("k, fault", (0, None), (1, "Invalid task"), (2, "Task type is required"), (3, "Task source is required"), (4, "Task input is required"), (5, "Note save task requires input or current mode"), (6, None), (7, "Task route must be a string"), (8, "Task deliveryMode must be a string"), (9, "Task metadata must be an object"), (10, None), (11, None), (12, "Invalid task"), (13, "Invalid task")))
def task_faults(spark, sf_dir):
    rows = [(k, json.dumps(t)) for k, t in enumerate(TASKS)] + [(len(TASKS), "{broken")]
    return given(spark, "k int, task string", *rows).select("k", checks.task_fault("task").alias("fault"))


@query(expected("k, fault", (1, None), (2, "Fetched Xiaohongshu note is missing noteId"), (3, "Fetched Xiaohongshu note is missing title and content"), (4, "Fetched article is missing title"), (5, "Fetched article is missing content"), (6, None), (7, None)))
def page_faults(spark, sf_dir):
    rows = given(spark, "k int, s string, n string, t string, c string", (1, "xiaohongshu", "a", "t", None), (2, "xiaohongshu", " ", "t", "c"), (3, "xiaohongshu", "a", " ", ""), (4, "zhihu", None, None, "c"), (5, "zhihu", None, "t", "\n"), (6, "csdn", None, "t", "c"), (7, "xiaohongshu", "a", "", "c"))
    return rows.select("k", checks.page_fault(*(F.col(c) for c in "sntc")).alias("fault"))


@query(expected("k, more, replies", (1, True, False), (2, False, True), (3, False, False), (4, False, False), (5, True, False), (6, False, False), (7, False, False), (8, False, False)))
def comment_controls(spark, sf_dir):
    rows = given(spark, "k int, c string", (1, " 查看  更多 "), (2, "展开 3 条回复"), (3, "登录查看更多"), (4, "展开全文"), (5, "View all"), (6, "more more more"), (7, None), (8, "回复"))
    return rows.select("k", checks.loads_more("c").alias("more"), checks.expands_replies("c").alias("replies"))


@query(expected("k, account, author", (1, "Me_u1", True), (2, "unknown_000000", False), (3, "a_b_9", True), (4, "x y_000000", False)))
def account_keys(spark, sf_dir):
    rows = given(spark, "k int, n string, u string, tags array<string>", (1, "Me关注", " u1 ", ["Author"]), (2, None, None, None), (3, "a/b 关注", "9", [None, "作者"]), (4, "x  y", "", []))
    return rows.select("k", checks.account_key("n", "u").alias("account"), checks.has_author_tag(F.col("tags")).alias("author"))


@query(expected("k, name", (1, "a-b c"), (2, "untitled-7"), (3, "untitled-7"), (4, "x" * 120), (5, "a")))
def note_file_names(spark, sf_dir):
    rows = given(spark, "k int, t string", (1, 'a/:b  c?'), (2, None), (3, "??"), (4, "x" * 130), (5, "--a-"))
    return rows.select("k", checks.note_file_name("t", F.lit("7")).alias("name"))


@query(expected("k, id, title", (1, "d1", "T"), (2, "d2", None), (3, None, None), (4, None, None)))
def store_rows(spark, sf_dir):
    raw = [{"doc": {"basic_info": {"docid": "d1", "title": "T"}}}, {"doc": {"basic_info": None}, "basic_info": {"basic_info": {"docid": "d2"}}}, {"doc": {"basic_info": {}}, "basic_info": {"basic_info": {"docid": "no"}}}, {}]
    rows = given(spark, "k int, raw string", *((k, json.dumps(r)) for k, r in enumerate(raw, 1)))
    return rows.select("k", checks.basic_info("raw", "doc", "docid").alias("id"), checks.basic_info("raw", "doc", "title").alias("title"))


@query(expected("k, links", (1, "d,p,x,y"), (2, "")))
def image_scenes(spark, sf_dir):
    rows = given(spark, "k int, i array<struct<imageScene:string,url:string>>", (1, [("a", "x"), ("WB_PRV", "p"), (None, "y"), ("WB_DFT", "d"), ("b", None)]), (2, []))
    return rows.select("k", F.array_join(checks.scene_links(F.col("i")), ",").alias("links"))


@query(expected("k, change", (1, 0.0), (2, 0.25), (3, 1.0), (4, 0.0), (5, 1.0), (6, 0.0)))
def text_changes(spark, sf_dir):
    rows = given(spark, "k int, v int, t string", (1, 1, "abcd"), (2, 1, "bcde"), (3, 1, None), (4, 1, ""), (5, 1, "q"), (6, 2, "z"))
    return boards.text_change(rows, "v", ["k"], "t").select("k", "change")


@query(expected("k, slug, cut, held", (1, "hello-世界_a", "Hello", '{"a": {"b": 1}}'), (2, "", "", None)))
def names_and_answers(spark, sf_dir):
    rows = given(spark, "k int, t string, a string", (1, "Hello, 世界_a!", 'So: {"a": {"b": 1}} done'), (2, None, "none"))
    return rows.select("k", text.slug("t").alias("slug"), text.truncated("t", 5).alias("cut"), text.json_object_in("a").alias("held"))


@pytest.mark.parametrize("name", QUERIES)
def test_given_rows(spark, name):
    assert differences(spark, QUERIES[name], SQL[name], "") == ""
