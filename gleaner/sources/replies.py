"""Comments as an interface gives them: nested replies become rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "note_id long, seq int, comment_id string, root_id string, parent_id string, author string, content string, time string, level int, like_count long, reply_count long, is_author boolean"


def _text(*values) -> str:
    return next((t for v in values if v is not None and (t := " ".join(str(v).split()))), "")


def _number(*values) -> int:
    for v in values:
        try:
            if v and float(v):
                return int(float(v))
        except (TypeError, ValueError):
            pass
    return 0


def _flat(items: list, level: int = 0, root: str = "", parent: str = "") -> Iterator[tuple]:
    for item in items if isinstance(items, list) else []:
        own = _text(item.get("id"), item.get("commentId"), item.get("comment_id")) if isinstance(item, dict) else ""
        if not own:
            continue
        user = next((u for u in (item.get("userInfo"), item.get("user")) if isinstance(u, dict)), {})
        top = _text(root, item.get("rootId"), item.get("rootCommentId"), item.get("root_comment_id"), own)
        above = _text(parent, item.get("parentId"), item.get("parent_comment_id"), item.get("targetCommentId"), top) if level else ""
        labels = [_text(t.get("name"), t.get("text"), t.get("type")) if isinstance(t, dict) else _text(t) for t in item.get("showTags") or []]
        yield (
            own, top, above, _text(user.get("nickname"), user.get("name"), item.get("author")), _text(item.get("content"), item.get("text"), item.get("desc")), _text(item.get("createTime"), item.get("time")), level,
            _number(item.get("likeCount")), _number(item.get("subCommentCount"), item.get("replyCount")), any("作者" in x or "author" in x.lower() for x in labels),
        )
        yield from _flat(item.get("subComments"), level + 1, top if level else own, own)


def flattened(pages: DataFrame) -> DataFrame:
    """Rows (ROW) of pages (note_id, comments: a JSON list); a comment comes before its replies. Entries without an id go; text that is no list gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for note, text in zip(b.column("note_id").to_pylist(), b.column("comments").to_pylist(), strict=True):
                try:
                    items = json.loads(text or "[]")
                except ValueError:
                    items = []
                rows += [(note, k, *r) for k, r in enumerate(_flat(items))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    names = [c.split()[0] for c in ROW.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.string()] * 6, pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    return pages.select("note_id", "comments").mapInArrow(run, ROW)


def page_succeeded(status: Column, success: Column, code: Column) -> Column:
    """Whether a page of comments is good: its HTTP status, its flag, and its code if that is a number."""
    n = F.trim(F.coalesce(code.cast("string"), F.lit(""))).try_cast("double")
    return F.coalesce(status.isin(0, 200, 204), F.lit(False)) & F.coalesce(success, F.lit(True)) & F.coalesce(n == 0, F.lit(True))


def blocked_message(status: Column, success: Column, code: Column) -> Column:
    label = F.coalesce(F.nullif(F.trim(code.cast("string")), F.lit("")), F.lit("unknown"))
    return F.when(page_succeeded(status, success, code), "").otherwise(F.concat(F.lit("comments blocked by "), label))


def completeness(notes: DataFrame, comments: DataFrame) -> DataFrame:
    """Each note's (note_id, total) number of comments that were collected, and whether that is all."""
    got = comments.groupBy("note_id").agg(F.count("*").alias("collected"))
    n = F.coalesce("collected", F.lit(0))
    return notes.join(got, "note_id", "left").select("note_id", "total", n.alias("collected"), ((F.col("total") <= 0) | (n >= F.col("total"))).alias("complete"))
