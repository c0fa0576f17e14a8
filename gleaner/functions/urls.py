"""Links: hosts, kinds of source, note links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import trimmed

#: Source class, host pattern, path pattern; the first that fits counts.
SOURCES = [
    ("xiaohongshu", r"(^|\.)xiaohongshu\.com$", r"^/(discovery/item|explore)/"),
    ("wechat_article", r"^mp\.weixin\.qq\.com$", r"^/s"),
    ("zhihu_article", r"^zhuanlan\.zhihu\.com$", r"^/p/\d+"),
    ("zhihu_answer", r"(^|\.)zhihu\.com$", r"^/question/\d+/answer/\d+"),
    ("zhihu_collection", r"(^|\.)zhihu\.com$", r"^/collection/\d+"),
    ("csdn_article", r"(^|\.)csdn\.net$", r"/article/details/\d+"),
]
GENERIC = "generic_web"


def host(url: Column) -> Column:
    """Lower-case host, null if the link can't be parsed."""
    return F.lower(F.try_parse_url(trimmed(url), F.lit("HOST")))


def detect_source(url: Column) -> Column:
    at, path = host(url), F.coalesce(F.try_parse_url(trimmed(url), F.lit("PATH")), F.lit(""))
    out = F
    for name, h, p in SOURCES:
        out = out.when(at.rlike(h) & path.rlike(p), name)
    return out.otherwise(GENERIC)


def page_title(html: Column) -> Column:
    """og:title, meta title, first h1 or title element of a page, whichever is first not empty."""
    tries = [r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', r'(?is)<meta[^>]+name="title"[^>]+content="([^"]*)"', r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>"]
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit("")) for p in tries))
