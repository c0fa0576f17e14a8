"""Ordered rewriting rules over texts: once each in order, or again and again until nothing changes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Rule(NamedTuple):
    pattern: str
    replacement: str


class Table:
    """Compiled rules in order. A text that no pattern of the table is in, as one search tells, is left as it is without trying each."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(re.compile(r.pattern), r.replacement) for r in rules]
        # patterns with flags or references of their own can't be joined to one
        plain = rules and not any(re.search(r"\(\?[aiLmsux-]|\\[1-9]|\(\?P=", r.pattern) for r in rules)
        self.any = re.compile("|".join(f"(?:{r.pattern})" for r in rules)) if plain else None

    def once(self, text: str) -> str:
        """Each rule in its turn, over what those before it left. One pass may make matches for an earlier rule; these stay."""
        if self.any is not None and not self.any.search(text):
            return text
        for pattern, replacement in self.rules:
            text = pattern.sub(replacement, text)
        return text

    def until_stable(self, text: str) -> tuple[str, int]:
        """The text after passes until one changes nothing, and the passes that changed it.

        It ends: a pass goes on only while it makes the text shorter, so there are at most as many as characters. A pass that changes a text without making it shorter is the last (rules
        that grow texts, or turn one into another and back, would have no end).
        """
        passes = 0
        while True:
            new = self.once(text)
            if new == text:
                return text, passes
            passes += 1
            if len(new) >= len(text):
                return new, passes
            text = new


def rewritten(df: DataFrame, text: str, rules: list[Rule], column: str, stable: bool = False) -> DataFrame:
    """df with the rewritten text in a column, in Arrow batches; a null text counts as empty. With `stable` also `passes`."""
    types = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    names = [*df.columns, column, *(["passes"] if stable else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(rules)
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            if stable:
                done = [table.until_stable(t) for t in texts]
                more = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())]
            else:
                more = [pa.array([table.once(t) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=names)

    return df.mapInArrow(run, f"{types}, `{column}` string" + ", passes int" * stable)
