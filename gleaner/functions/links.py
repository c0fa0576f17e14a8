"""Links in texts, by four rules; note links; video links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import trimmed
from gleaner.functions.urls import host

#: What ends a link, and the marks that are cut from its end.
CHAT, CHAT_TAIL = r"(?i)(https?://[^\s<>\"']+)", r"[)\],.!?;:'\"”，。、；！？]+$"
NOTE, NOTE_TAIL = r"(?i)(https?://[^\s\"'<>]+)", r"[)）】>,，。！？；]+$"


def chat_links(text: Column | str) -> Column:
    """Links of a chat message that can be parsed."""
    found = F.transform(F.regexp_extract_all(trimmed(text), F.lit(CHAT), F.lit(1)), lambda u: F.regexp_replace(u, CHAT_TAIL, ""))
    return F.filter(found, lambda u: host(u).isNotNull())


def first_chat_link(*texts: Column | str) -> Column:
    """The first link of the first text that has one, null without any."""
    return F.get(F.flatten(F.array(*map(chat_links, texts))), F.lit(0))


def share_links(text: Column | str) -> Column:
    """Links of a shared text."""
    found = F.transform(F.regexp_extract_all(trimmed(text), F.lit(NOTE), F.lit(1)), lambda u: F.regexp_replace(u, NOTE_TAIL, ""))
    return F.filter(found, lambda u: u != "")


def note_id(url: Column | str) -> Column:
    """The id in a note's link, empty in others."""
    return F.regexp_extract(trimmed(url), r"(?i)xiaohongshu\.com/(?:explore|discovery/item)/([A-Za-z0-9]+)", 1)


def note_key(url: Column) -> Column:
    """What makes two links one: the note's id, else the link in lower case."""
    return F.when(note_id(url) != "", F.concat(F.lit("note:"), note_id(url))).otherwise(F.concat(F.lit("url:"), F.lower(url)))


def canonical_note(url: Column) -> Column:
    return F.when(note_id(url) != "", F.concat(F.lit("https://www.xiaohongshu.com/discovery/item/"), note_id(url))).otherwise(url)


def note_inputs(text: Column | str) -> Column:
    """The different links of a text in order, as (url, note_id, canonical, kind)."""
    links = share_links(text)
    single = (F.size(links) == 1) & (F.get(links, F.lit(0)) == trimmed(text))
    kind = F.when(single, "url").otherwise("share_text")
    keyed = F.transform(links, lambda u: F.struct(u.alias("url"), note_id(u).alias("note_id"), canonical_note(u).alias("canonical"), kind.alias("kind"), note_key(u).alias("key")))
    fresh = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.transform(fresh, lambda x: x.dropFields("key"))


#: Parts of hosts of video platforms, and the query keys that their links keep (None: all but the time).
PLATFORMS = [("bilibili", ("bilibili.com", "b23.tv")), ("youtube", ("youtube.com", "youtu.be")), ("xiaohongshu", ("xiaohongshu.com", "xhslink.com"))]
KEPT = {"bilibili": ["p"], "youtube": ["v", "list", "index"], "xiaohongshu": []}


def platform(url: Column) -> Column:
    at, out = F.coalesce(host(url), F.lit("")), F
    for name, parts in PLATFORMS:
        found = F.lit(False)
        for p in parts:
            found = found | at.contains(p)
        out = out.when(found, name)
    return out.otherwise("unknown")


def video_link(url: Column, name: Column) -> Column:
    """The link with the query keys that its platform keeps, in their order."""
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: p != "")
    key = lambda p: F.substring_index(p, "=", 1)

    def of(keys: list[str]) -> Column:
        return F.filter(pairs, lambda p: F.array_contains(F.array(*map(F.lit, keys)).cast("array<string>"), key(p)))

    kept = F
    for n, keys in KEPT.items():
        kept = kept.when(name == n, of(keys))
    kept = kept.otherwise(F.filter(pairs, lambda p: key(p) != "t"))
    base = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def timed_link(url: Column, name: Column, seconds: Column) -> Column:
    """The same link at a time of the video."""
    link, t = video_link(url, name), F.floor(seconds).cast("string")
    t = F.when(name == "youtube", F.concat(t, F.lit("s"))).otherwise(t)
    return F.when(name == "xiaohongshu", link).otherwise(F.concat(link, F.when(link.contains("?"), "&t=").otherwise("?t="), t))


def image_link(url: Column | str) -> Column:
    """An image's link with https."""
    u = trimmed(url)
    return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(F.regexp_replace(u, "^http://", "https://"))


def content_images(urls: Column, tokens: list[str], most: int = 0) -> Column:
    """Image links that have one of the tokens; the first `most` of them, or all."""
    has = lambda u: F.exists(F.array(*map(F.lit, tokens)), lambda t: u.contains(t))
    kept = F.filter(urls, has)
    return F.slice(kept, 1, most) if most else kept
