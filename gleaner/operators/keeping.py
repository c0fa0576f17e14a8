"""Which rows of a run stay when each is compared with the last one that was kept: keep, replace or skip."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.blocks import Fold, folded
from gleaner.tables import numbered

#: From which likeness on two pictures and two texts are the same, and the shares of sharpness and content in a picture's quality.
SAME_PICTURE, SAME_TEXT, SHARPNESS, CONTENT = 0.99, 0.95, 0.6, 0.4


def plain(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def compare(likeness) -> Fold:
    """A fold over rows (picture, text, quality) for a likeness of two pictures from 0 to 1. Rows of no text on either side count by their pictures alone."""

    def fold(last, row):
        if last is None or likeness(last[0], row[0]) < SAME_PICTURE:
            return row, "keep"
        a, b = plain(last[1]), plain(row[1])
        if (a or b) and not (a and b and difflib.SequenceMatcher(None, a, b).ratio() >= SAME_TEXT):
            return row, "keep"
        return (row, "replace") if row[2] > last[2] else (last, "skip")

    return fold


def kept(df: DataFrame, key: str, order: list[str], picture: str, text: str, quality: str, likeness, rows: int = 20_000) -> DataFrame:
    """The rows that stay: each that was kept or replaced the last one, unless the next that isn't skipped replaces it. A null quality counts as 0."""
    judged, _ = folded(df.withColumn(quality, F.coalesce(F.col(quality).cast("double"), F.lit(0.0))), key, order, [picture, text, quality], compare(likeness), rows)
    # of the rows that aren't skipped, numbered over all keys, the next one by its number
    stay, _ = numbered(judged.where("verdict <> 'skip'"), [key, *order], "_at")
    following = stay.select((F.col("_at") - 1).alias("_at"), F.col(key).alias("_key"), F.col("verdict").alias("_next"))
    ended = F.col("_next").isNull() | (F.col("_key") != F.col(key)) | (F.col("_next") == "keep")
    return stay.join(following, "_at", "left").where(ended).drop("_at", "_key", "_next", "verdict")
