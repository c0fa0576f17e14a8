"""Notes on boards, accounts, and rows against the one before them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gleaner.functions.checks import NO_ACCOUNT
from gleaner.operators.order import new_rows


def boards_united(stored: DataFrame, found: DataFrame, note: str, order: list[str]) -> DataFrame:
    """The stored notes, and of the found ones with an id those that no board has yet; a note found on several boards goes to the first."""
    return stored.unionByName(new_rows(found.where(F.col(note).isNotNull() & (F.col(note).cast("string") != "")), stored, [note], order))


def board_totals(notes: DataFrame, board: str) -> DataFrame:
    """Notes of each board, and of all of them in a row without a board."""
    return notes.rollup(board).agg(F.count("*").alias("n_notes"))


def default_account(notes: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row: the first account key that is not empty."""
    first = F.min_by(key, F.struct(*order))
    return notes.where(key != "").agg(F.coalesce(first, F.lit(NO_ACCOUNT)).alias("account"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def text_change(frames: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """change: how far a row's text differs from that of the row before it in its key, 0 to 1; 1 if one alone is empty, 0 if both are or none is before. A key's rows are sorted in one task, but stream through it."""
    now, before = F.coalesce(text, F.lit("")), F.coalesce(F.col("_before"), F.lit(""))
    rows = frames.withColumn("_before", F.lag(F.coalesce(text, F.lit("")), 1).over(Window.partitionBy(key).orderBy(*order)))
    same = F.col("_before").isNull() | (now == before)
    one = (now == "") | (before == "")
    return rows.withColumn("change", F.when(same, 0.0).when(one, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - _ratio(before, now))))).drop("_before")
