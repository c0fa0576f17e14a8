"""What is said of a note: comment warnings, actions to take, tags, summaries, recognised text, names, dates."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import clean_tags, first_nonempty, text_of, trimmed

#: Messages that ask for a login, for somebody, or tell of limits.
LOGIN = r"登录查看全部评论内容|网页端提示.*登录|先在当前 Chrome 会话中登录后重试"
LOGIN_ACTION = r"登录查看全部评论内容|无登录信息|先在当前 Chrome 会话中登录后重试|登录后查看"
CAPTCHA, RISK = r"(?i)验证码|captcha", r"(?i)300011|406|账号异常|风控|频率|限流|rate"
#: What recognisers read wrongly, in the order of mending.
OCR_RULES = [("收藏天", "收藏夹"), ("收蔵", "收藏"), ("小红书收矛夹", "小红书收藏夹"), ("小红书收藏天", "小红书收藏夹"), ("Al", "AI"), ("A1", "AI"), ("寡问一问", "问一问"), ("寡", "的")]
FILLER, PLAIN = "小红书", "笔记"
#: What a subtitle loses, in this order.
SPOKEN = [r"^(?:呃|嗯|额|啊)+", r"(?:呃|嗯|额)(?=[\u4e00-\u9fffA-Za-z0-9])", r"(?<=[\u4e00-\u9fffA-Za-z0-9])(?:呃|嗯|额)(?=\s)", r"(?<=[\u4e00-\u9fffA-Za-z0-9])(?:呃|嗯|额|啊)+$"]
#: What a collection's title loses, in this order; what its folder's name can't have, and the name without any.
TITLE_TAILS = [r"\s*[-|｜_·]\s*知乎(?:\s*[-|｜_·].*)?$", r"\s*[-|｜_·]\s*收藏夹$"]
REFUSED, UNNAMED = r'[\\/:*?"<>|]', "未命名收藏夹"
#: Signs that recognised text is wrong, as a pattern, and what each share weighs; for the first it is the share that is missing.
ANOMALIES = {"chinese": (r"[\u4e00-\u9fff]", 0.6), "symbols": (r"[~`!@#$%^&*()_+\-=\[\]{};':\"\\|,.<>/?]", 0.3), "garbled": (r"[�□■]", 0.1)}


def comment_warning(explicit: Column | str, message: Column | str, total: Column, collected: Column) -> Column:
    """A given code; else that a login is wanted, that comments are missing, that there is some message; else empty."""
    given, said = trimmed(explicit), trimmed(message)
    missing = F.coalesce((total > 0) & (collected < total), F.lit(False))
    return F.when(given != "", given).when(said.rlike(LOGIN), "comment_login_required").when(missing, "comment_incomplete").when(said != "", "comment_warning").otherwise("")


def manual_reason(explicit: Column | str, code: Column | str, message: Column | str) -> Column:
    """Why somebody has to act: as given; else captcha, then login, then limits; else empty."""
    given, said = trimmed(explicit), trimmed(message)
    return F.when(given != "", given).when(said.rlike(CAPTCHA), "captcha").when((text_of(code) == "comment_login_required") | said.rlike(LOGIN_ACTION), "login_required").when(said.rlike(RISK), "risk_control").otherwise("")


def fallback_summary(title: Column | str, content: Column | str) -> Column:
    """The content's first line, else the title, up to 50 characters."""
    line = F.substring_index(text_of(content), "\n", 1)
    return F.substring(F.when(line != "", line).otherwise(text_of(title)), 1, 50)


def padded(tags: Column) -> Column:
    """Three to five tags."""
    five = F.slice(tags, 1, 5)
    return F.concat(five, F.array_repeat(F.lit(PLAIN), F.greatest(F.lit(0), 3 - F.size(five))))


def fallback_tags(tags: Column) -> Column:
    return padded(F.filter(F.array_distinct(F.concat(F.array(F.lit(FILLER)), F.coalesce(tags, F.array().cast("array<string>")))), lambda t: F.coalesce(t, F.lit("")) != ""))


def summary_tags(given: Column, fallback: Column) -> Column:
    """A model's tags and the fallback's, cleaned, each once."""
    none = F.array().cast("array<string>")
    return padded(clean_tags(F.concat(F.coalesce(given, none), F.coalesce(fallback, none))))


def ocr_mended(text: Column | str) -> Column:
    out = text_of(text)
    for wrong, right in OCR_RULES:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def ocr_anomaly(text: Column | str) -> Column:
    """0 (nothing odd, or no text) to 1: few Chinese characters, many symbols, broken ones."""
    t = text_of(text)
    share = {kind: F.regexp_count(t, F.lit(pattern)) / F.length(t) for kind, (pattern, _) in ANOMALIES.items()}
    share["chinese"] = 1 - share["chinese"]
    score = sum((weight * share[kind] for kind, (_, weight) in ANOMALIES.items()), F.lit(0.0))
    return F.when(t == "", 0.0).otherwise(F.least(F.lit(1.0), score))


def body_of(markdown: Column | str) -> Column:
    """A Markdown text without byte order mark and front matter; trimmed."""
    t = trimmed(markdown)
    cut = F.regexp_replace(t, r"(?s)\A---.*?\n---\s*", "")
    return F.when(t.startswith("---"), trimmed(cut)).otherwise(t)


def without(text: Column, patterns: list[str]) -> Column:
    return functools.reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def spoken_cleaned(text: Column | str) -> Column:
    """A subtitle's text without words that only fill."""
    return F.trim(F.regexp_replace(without(F.trim(text_of(text)), SPOKEN), r"\s+", " "))


def description_tags(text: Column | str) -> Column:
    """Tags written as #tag# or #tag[kind]#, each once, in order."""
    found = F.regexp_extract_all(text_of(text), F.lit(r"#([^#\[]+)(?:\[[^\]]+\])?#"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, trimmed)), lambda t: t != "")


def file_segment(value: Column | str, otherwise: str = "group") -> Column:
    return first_nonempty(F.regexp_replace(F.regexp_replace(trimmed(value), r'[<>:"/\\|?*\x00-\x1F]', "_"), r"\s+", "-"), F.lit(otherwise))


def run_id(kind: Column | str, source: Column | str, requested_at: Column | str) -> Column:
    """kind-source-stamp, the same for the same request."""
    return F.concat_ws("-", first_nonempty(kind, F.lit("task")), first_nonempty(source, F.lit("unknown")), F.regexp_replace(trimmed(requested_at), r"[^0-9TZ-]", ""))


def telling_line(logs: Column, message: Column | str) -> Column:
    """Of an error's log the first line about logins, else the last; without a log its message."""
    about = F.get(F.filter(logs, lambda x: x.rlike("登录|账号异常|无登录")), F.lit(0))
    last = F.nullif(F.get(logs, F.size(logs) - 1), F.lit(""))
    return F.coalesce(about, last, F.nullif(text_of(message), F.lit("")), F.lit("Internal Server Error"))


def collection_title(value: Column | str) -> Column:
    """A collection's title without the site's name and its kind after dashes."""
    return F.trim(without(F.regexp_replace(text_of(value), r"\s+", " "), TITLE_TAILS))


def folder_title(value: Column | str) -> Column:
    """A title as the name of a folder."""
    return first_nonempty(F.regexp_replace(F.regexp_replace(text_of(value), REFUSED, " "), r"\s+", " "), F.lit(UNNAMED))


def first_date(text: Column | str) -> Column:
    """The first ISO date in a text, else the trimmed text."""
    t = trimmed(text)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), t)


def comment_time(milliseconds: Column | str) -> Column:
    """yyyy-MM-dd HH:mm of a time in milliseconds, empty if it is none."""
    n = text_of(milliseconds).try_cast("double")
    return F.when(F.coalesce(n > 0, F.lit(False)), F.date_format(F.timestamp_millis(n.cast("long")), "yyyy-MM-dd HH:mm")).otherwise("")


def published_date(raw: Column | str) -> Column:
    """The date of a time in seconds or milliseconds; other texts as they are; null for none."""
    t = trimmed(raw)
    n = F.when(t.rlike(r"^\d+$"), t.cast("double"))
    day = F.date_format(F.timestamp_seconds(F.when(n > 1e10, n / 1000).otherwise(n)), "yyyy-MM-dd")
    return F.when(t == "", F.lit(None)).otherwise(F.coalesce(day, t))


def request_time(text: Column | str, now: Column) -> Column:
    """A time given as ISO text, or as seconds or milliseconds (a number over 1e12); `now` for anything else."""
    t = trimmed(text)
    n = t.try_cast("double")
    parsed = F.when(F.coalesce(n > 0, F.lit(False)), F.timestamp_seconds(F.when(n > 1e12, n / 1000).otherwise(n))).otherwise(F.try_to_timestamp(F.nullif(t, F.lit(""))))
    return F.coalesce(parsed, now)


def manual_action(required: Column, explicit: Column | str, code: Column | str, message: Column | str) -> Column:
    """(required, reason) of a fetched note: as it says itself, else by its message and its comments' warning."""
    given = trimmed(explicit)
    stated = F.coalesce(required, F.lit(False)) | (given != "")
    found = manual_reason(F.lit(""), code, message)
    return F.struct((stated | (found != "")).alias("required"), F.when(stated, given).otherwise(found).alias("reason"))
