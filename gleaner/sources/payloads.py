"""JSON whose shape isn't known beforehand: lists found by trying paths in order, keys renamed at every depth, and state within a page's scripts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Where interfaces keep a page's comments, its cursor and whether there are more; the first that is there counts.
LISTS = ["$.data.comments", "$.comments", "$.data.commentList", "$.commentList", "$.data.items", "$.items", "$.data.list", "$.list"]
CURSORS = ["$.data.cursor", "$.cursor", "$.data.nextCursor", "$.nextCursor"]
MORE = ["$.data.hasMore", "$.hasMore", "$.data.has_more", "$.has_more"]


def first_at(payload: Column, paths: list[str], kind: str) -> Column:
    """JSON text of the first of the paths whose value is of a kind (a beginning of Spark's name of the type), null if none is. Text that is no JSON has none."""
    v = F.try_parse_json(payload)
    at = lambda p: F.try_variant_get(v, p, "variant")
    return F.coalesce(*(F.when(F.coalesce(F.schema_of_variant(at(p)).startswith(kind), F.lit(False)), F.to_json(at(p))) for p in paths))


def comment_list(payload: Column | str) -> Column:
    """(comments: JSON text of the list, cursor, has_more) of a page in any of eight shapes; a cursor may be a number, has_more a number or text."""
    p = F.col(payload) if isinstance(payload, str) else payload
    v = F.try_parse_json(p)
    text = lambda paths: F.coalesce(*(F.nullif(F.try_variant_get(v, q, "string"), F.lit("")) for q in paths))
    more = F.lower(text(MORE)).isin("true", "1")
    return F.struct(first_at(p, LISTS, "ARRAY").alias("comments"), F.coalesce(text(CURSORS), F.lit("")).alias("cursor"), F.coalesce(more, F.lit(False)).alias("has_more"))


def _camel(key: str) -> str:
    return re.sub(r"[_-]+([A-Za-z0-9])", lambda m: m[1].upper(), key)


def _renamed(value):
    if isinstance(value, dict):
        out: dict = {}
        for k, v in value.items():
            out.setdefault(_camel(k), _renamed(v))
        return out
    return [_renamed(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def camel_keys(text: pd.Series) -> pd.Series:
    """JSON text with the keys of all objects, however deep, in camelCase; of keys that become one the first stays. Text that is no JSON gives null."""

    def one(t):
        try:
            return None if t is None else json.dumps(_renamed(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(one)


def literal_after(text: str, name: str) -> str | None:
    """The object literal that a script assigns to a name: from its first brace to the one that closes it, strings and escapes within taken as such. None if it doesn't close."""
    found = re.search(re.escape(name) + r"\s*=\s*(?=\{)", text)
    if not found:
        return None
    depth, at, quote = 0, found.end(), ""
    for m in re.finditer(r"\\.|[{}\"'`]", text[at:], re.S):
        c = m[0]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[at : at + m.end()]
    return None


def as_json(literal: str) -> str:
    """A script's literal as JSON: undefined, NaN and void 0 outside strings are null, and commas before a closing bracket go."""
    parts = re.split(r'("(?:\\.|[^"\\])*")', literal, flags=re.S)  # strings are every second part
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r",\s*(?=[}\]])", "", re.sub(r"\bundefined\b|\bNaN\b|\bvoid 0\b", "null", parts[k]))
    return "".join(parts)


def page_state(name: str):
    """A function of a column of HTML that gives the state assigned to a name in its scripts as JSON text; null without one, or if it is no JSON even then."""

    @F.pandas_udf(StringType())
    def state(html: pd.Series) -> pd.Series:
        def one(t):
            literal = literal_after(t or "", name)
            try:
                return None if literal is None else json.dumps(json.loads(as_json(literal)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return html.map(one)

    return state


def best_stream(state: Column, root: str, codecs: list[str]) -> Column:
    """The address of a video in a state, from the first of the codecs that has a stream with one: its master address, else its first backup."""
    of = lambda codec: F.coalesce(F.nullif(F.get_json_object(state, f"{root}.{codec}[0].masterUrl"), F.lit("")), F.nullif(F.get_json_object(state, f"{root}.{codec}[0].backupUrls[0]"), F.lit("")))
    return F.coalesce(*map(of, codecs))


def unseen_images(items: Column, scenes: list[str]) -> Column:
    """Of each item's variants (an array of arrays of scene, url) the first, best scenes first, whose link no item before took; items whose links are all taken give none."""

    def ranked(variants: Column) -> Column:
        rest = F.filter(variants, lambda v: ~F.coalesce(v["scene"].isin(*scenes), F.lit(False)))
        of_scene = lambda scene: F.filter(variants, lambda v: v["scene"] == scene)
        return F.filter(F.transform(F.concat(*map(of_scene, scenes), rest), lambda v: v["url"]), lambda u: F.coalesce(u, F.lit("")) != "")

    def take(taken: Column, variants: Column) -> Column:
        free = F.get(F.filter(ranked(variants), lambda u: ~F.array_contains(taken, u)), F.lit(0))
        return F.when(free.isNull(), taken).otherwise(F.concat(taken, F.array(free)))

    return F.aggregate(items, F.array().cast("array<string>"), take)

