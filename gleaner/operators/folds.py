"""Greedy merges of neighbouring rows: which rows belong together is a fold over blocks (blocks.py), so a key of any size is spread; what they come to is an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.blocks import folded

SENTENCE_END = r"[。！？.!?]$"


def merge_segments(df: DataFrame, key: str, order: str, text: Column, start: str, end: str, chars: int = 80, most: int = 8) -> DataFrame:
    """(key, start, end, text, n): segments are joined until they have so many characters, so many are together, or one ends a sentence. Empty ones, and those without a key, are left out."""
    rows = df.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(start).alias("a"), F.col(end).alias("z"), text.alias("t")).where("t <> ''")
    rows = rows.withColumns({"first": F.col("o"), "chars": F.length("t").cast("long"), "n": F.lit(1).cast("long"), "ends": F.col("t").rlike(SENTENCE_END)})

    def join(group, row):
        if group is None or group[1] >= chars or group[2] >= most or group[3]:
            return row, str(row[0])
        return (group[0], group[1] + row[1], group[2] + row[2], row[3]), str(group[0])

    together, _ = folded(rows, "k", ["o"], ["first", "chars", "n", "ends"], join)
    parts = F.array_sort(F.collect_list(F.struct("o", "t")))  # `most` at the most
    merged = together.groupBy("k", "verdict").agg(F.min_by("a", "o").alias(start), F.max_by("z", "o").alias(end), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"), F.count("*").alias("n"))
    return merged.select(F.col("k").alias(key), start, end, "text", "n")


def scene_cards(blocks: DataFrame, gap: float) -> DataFrame:
    """Cards from blocks (chapter, id, at, title, path, window_start, window_end, score): a block joins the card before it in its chapter if they have one path, or one title and at most `gap` seconds
    between the card's time and the block's. A card takes title, path and time of its best block (the later of equals), the widest window, and counts its blocks; where blocks have `lines`, it has all
    different ones in order."""
    rows = blocks.withColumns({"_first": F.col("id"), "_at": F.col("at")})

    def join(card, row):
        title, path, at, score, _ = row
        if card is None or not (card[1] == path or (card[0] == title and at - card[2] <= gap)):
            return row, str(row[4])
        head = (title, path, at, score) if score >= card[3] else card[:4]
        return (*head, card[4]), str(card[4])

    together, _ = folded(rows, "chapter", ["at", "id"], ["title", "path", "_at", "score", "_first"], join)
    best = F.max_by(F.struct("title", "path", "at"), F.struct("score", "at", "id")).alias("head")
    lines = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "lines"))), lambda b: b["lines"]))).alias("lines")] if "lines" in blocks.columns else []
    cards = together.groupBy("chapter", "verdict").agg(best, *lines, F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), F.max("score").alias("score"), F.count("*").alias("n_blocks"))
    return cards.select("chapter", "head.*", "window_start", "window_end", "score", "n_blocks", *(["lines"] if lines else []))
