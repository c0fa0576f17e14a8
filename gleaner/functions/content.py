"""What a line or a note is worth, how its text is cleaned and cut, and what stands under it; in built-in expressions. A null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import let, text_of, trimmed
from gleaner.functions.urls import detect_source

#: Marks around a line; lines, beginnings and ends that say nothing; phrases of low quality; words that leave a line open.
MARKS = "，。！？；;、 "
EMPTY_LINES = ["这样", "这样呢", "一个", "这个NotebookLM呢", "你新来的文字", "然后并且能够帮助我们", "第二点我是觉得说", "然后第二点我是觉得说", "你会发现他的回答会更为的"]
EMPTY_STARTS = ["这样呢", "然后第二点", "然后并且", "这个NotebookLM呢", "你新来的文字", "你会发现他的回答会更为的"]
LOW_LINES = ["这样", "这样呢", "一个", "这个", "那个"]
LOW_PHRASES = ["其实呢", "你新来的文字", "然后并且能够帮助我们", "回答会更为的"]
OPEN_STARTS, OPEN_ENDS = ["这个NotebookLM", "第二点我是觉得说", "然后第二点"], ["更为的", "这个", "那个", "这样", "这样的", "的话"]
#: Chinese signs and their punctuation; the lines that a model puts before and after what it read; where a window of words may be cut.
CJK, WIDE, PUNCTUATION = "[一-鿿]", "[一-鿿　-〿＀-￯]", "[，。；：！？”'（）「」『』【】《》\"“]"
BEFORE = r"^(可以|好的|以下|我先|当然|从图片中识别到的文字|OCR 识别结果)|^[-—]{3,}$|^##\s*OCR"
AFTER = r"^(如果你愿意|如果需要|我还可以|以上就是|以上为)|^[-—]{3,}$"
BREAKS = " ，。！？!?:："


def _bare(line: Column | str) -> Column:
    return F.btrim(text_of(line), F.lit(MARKS))


def _any(values: list[str], test) -> Column:
    return F.exists(F.array(*map(F.lit, values)), test)


def _open(t: Column) -> Column:
    return (t == "") | _any(OPEN_STARTS, lambda x: t.startswith(x)) | _any(OPEN_ENDS, lambda x: t.endswith(x))


def is_open(line: Column | str) -> Column:
    """Whether a line ends or begins as half a sentence does."""
    return let(_bare(line), _open)


def is_low_quality(line: Column | str) -> Column:
    """Empty, a number, up to two characters, a line or phrase that says nothing, or half a sentence."""
    return let(_bare(line), lambda t: (F.length(t) <= 2) | t.rlike(r"\A\d+\z") | t.isin(LOW_LINES) | _any(LOW_PHRASES, lambda x: F.contains(t, x)) | _open(t))


def is_low_signal(line: Column | str) -> Column:
    """Whether a spoken line is no reason to show it: up to three characters, a line or beginning that says nothing, or short and open."""
    return let(_bare(line), lambda t: (F.length(t) <= 3) | t.isin(EMPTY_LINES) | _any(EMPTY_STARTS, lambda x: t.startswith(x)) | (F.length(t) <= 10) & (t.endswith("这个") | t.endswith("这样")))


def is_video_note(source_type: Column | str, url: Column | str, note_type: Column | str, has_video: Column) -> Column:
    """A note of the one source (by its type, else by its link) that is a video or has one."""
    source = F.coalesce(F.nullif(trimmed(source_type), F.lit("")), detect_source(trimmed(url)))
    return (source == "xiaohongshu") & (F.lower(trimmed(note_type)).contains("video") | F.coalesce(has_video, F.lit(False)))


def needs_retry(source_type: Column | str, manual: Column, warning: Column | str, total: Column, collected: Column) -> Column:
    """A note whose comments are known to be incomplete, where nobody has to act first."""
    known = F.coalesce((total > 0) & (collected >= 0) & (collected < total), F.lit(False))
    return (trimmed(source_type) == "xiaohongshu") & ~F.coalesce(manual, F.lit(False)) & (trimmed(warning) == "comment_incomplete") & known


def platform_label(source_type: Column | str, platform: Column | str) -> Column:
    s, p = trimmed(source_type), trimmed(platform)
    return F.when((s == "wechat_article") | (p == "wechat"), "微信公众号").when(s.isin("zhihu_article", "zhihu_answer") | (p == "zhihu"), "知乎").when((s == "csdn_article") | (p == "csdn"), "CSDN").otherwise("小红书")


def source_footer(source_type: Column | str, platform: Column | str, url: Column | str, author: Column | str) -> Column:
    """The line of Markdown that says where a text is from."""
    label, name = platform_label(source_type, platform), F.coalesce(F.nullif(trimmed(author), F.lit("")), F.lit("原文"))
    return F.concat(F.lit("*来源："), label, F.lit(" ["), F.when(label == "小红书", "@").otherwise(""), name, F.lit("]("), text_of(url), F.lit(")*"))


def ocr_cleaned(text: Column | str) -> Column:
    """Recognised text without blanks between Chinese signs, with one between them and Latin words, dashes for bullets, and no dots, blanks or empty lines to spare."""
    t = F.regexp_replace(text_of(text), rf"(?<={WIDE})\s+(?={WIDE})|(?<={CJK})\s+(?={PUNCTUATION})|(?<={PUNCTUATION})\s+(?={CJK})", "")
    t = F.regexp_replace(t, rf"(?<={CJK})\s+(?=[a-zA-Z][a-zA-Z])|(?<=[a-zA-Z][a-zA-Z])\s+(?={CJK})", " ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?m)^•\s*", "- "), r"(?m)^\.+", ""), " {2,}", " ")
    return trimmed(F.array_join(F.transform(F.split(F.regexp_replace(t, r"\n{3,}", "\n\n"), "\n"), trimmed), "\n"))


def answer_only(text: Column | str) -> Column:
    """A model's answer without the lines that it puts before and after; lines between are kept as they are, but for blanks at their ends."""
    bare = lambda lines: F.transform(lines, trimmed)
    own = lambda pattern: lambda x: (x != "") & ~x.rlike(pattern)  # noqa: E731  of a bare line: whether it belongs to the answer

    def between(lines: Column, plain: Column) -> Column:
        first = F.array_position(F.transform(plain, own(BEFORE)), F.lit(True))
        return let(first, lambda k: F.when(k > 0, last_cut(F.slice(lines, F.greatest(k, F.lit(1)), F.size(lines)), F.slice(plain, F.greatest(k, F.lit(1)), F.size(plain)))).otherwise(""))

    def last_cut(lines: Column, plain: Column) -> Column:
        after = F.array_position(F.reverse(F.transform(plain, own(AFTER))), F.lit(True))
        return let(after, lambda k: F.when(k > 0, trimmed(F.array_join(F.slice(lines, F.lit(1), F.size(lines) - k + 1), "\n"))).otherwise(""))

    lines = F.transform(F.split(text_of(text), r"\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return let(lines, lambda x: let(bare(x), lambda y: between(x, y)))


def words_around(text: Column | str, words: list[str], most: int) -> Column:
    """The window around the first of the words (in their order) that gives one: from ten characters before it, `most` characters long, at both ends as far as to the next break; empty without any."""

    def cut(t: Column, start: Column) -> Column:
        end = F.least(F.length(t), start + most)
        tail = F.regexp_extract(F.substring(t, end + 1, F.length(t)), f"^([^{BREAKS}]*)", 1)
        return F.btrim(F.concat(F.substring(t, start + 1, end - start), tail), F.lit(MARKS))

    def from_place(t: Column, at: Column) -> Column:
        start = let(F.substring(t, F.lit(1), F.greatest(at - 11, F.lit(0))), lambda head: F.length(head) - F.length(F.regexp_extract(head, f"([^{BREAKS}]*)$", 1)))
        return F.when(at > 0, let(let(start, lambda s: cut(t, s)), lambda found: F.when(~is_low_quality(found), found)))

    return let(trimmed(text), lambda t: F.coalesce(*(let(F.instr(t, w), lambda at: from_place(t, at)) for w in words), F.lit("")))


def tags_by_rules(tags: Column, text: Column, rules: list[tuple[str, list[list[str]]]], most: int = 8) -> Column:
    """Tags, each once, then the tag of each rule whose groups of words all have one in the text, whatever its case; the first `most`."""
    low, none = F.lower(text), F.array().cast("array<string>")
    made = F
    added = []
    for tag, groups in rules:
        hit = F.lit(True)
        for words in groups:
            hit = hit & _any([w.lower() for w in words], lambda w: F.contains(low, w))
        added.append(F.when(hit, tag))
    clean = F.filter(F.transform(F.coalesce(tags, none), trimmed), lambda t: t != "")
    return F.slice(made.array_distinct(F.concat(clean, F.array_compact(F.array(*added)))), 1, most)


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def iso_stamp(milliseconds: Column) -> Column:
    """ISO 8601 with milliseconds; empty for no time or zero."""
    return F.when(F.coalesce(milliseconds, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_millis(milliseconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


#: Seconds between pictures, from which length on a chapter is sampled over its whole span, the most pictures, and how many short chapters get.
SPACING, LONG, MOST_PICTURES, BANDS = 45.0, 180.0, 18, [(30.0, 1), (60.0, 2), (90.0, 3)]


def picture_count(span: Column, base: int = 5) -> Column:
    """How many pictures a chapter of a length gets."""
    out = F.when(F.coalesce(span <= 0, F.lit(True)), 0)
    for limit, n in BANDS:
        out = out.when(span <= limit, min(base, n))
    return out.otherwise(F.greatest(F.lit(base), F.least(F.lit(MOST_PICTURES), F.ceil(span / SPACING)))).cast("int")


def picture_points(start: Column, end: Column, probes: int = 5) -> Column:
    """Times in a chapter at which to look: over its whole span if it is long or needs more than `probes`, else close to its middle; rounded to two places, each once."""
    span = end - start
    n = F.greatest(F.lit(probes), F.least(F.lit(MOST_PICTURES), F.ceil(span / SPACING))).cast("int")
    pad = F.least(F.greatest(span * 0.04, F.lit(4.0)), F.lit(18.0))
    narrow = end - pad <= start + pad
    a, z = F.when(narrow, start).otherwise(start + pad), F.when(narrow, end).otherwise(end - pad)
    middle, half = (start + end) / 2, F.least(F.greatest(span / 10, F.lit(5.0)), F.lit(36.0))
    steps = lambda count, of: F.transform(F.sequence(F.lit(0), count - 1), of)
    wide = F.when(n == 1, F.array((a + z) / 2)).otherwise(steps(n, lambda i: a + (z - a) / F.greatest(n - 1, F.lit(1)) * i))
    close = steps(F.lit(probes), lambda i: F.least(F.greatest(middle - half + half * 2 / max(probes - 1, 1) * i, start), end)) if probes > 1 else F.array(middle)
    points = F.when((span >= LONG) | (n > probes) | F.lit(probes <= 3), wide).otherwise(close)
    return F.when(F.coalesce(span > 0, F.lit(False)) & F.lit(probes > 0), F.array_distinct(F.transform(points, lambda x: F.bround(x, 2)))).otherwise(F.array().cast("array<double>"))
