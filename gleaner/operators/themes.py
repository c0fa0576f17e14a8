"""Themes, title candidates and key points of texts by weighted keywords and the place of sentences.

All keywords of all rules are one automaton, so a sentence is read once however many rules there are; rules are a parameter and
go to the tasks with the function. Each text is worked on by itself, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Theme(NamedTuple):
    title: str
    keywords: tuple[str, ...]
    priority: int
    goal: str = ""


class Marker(NamedTuple):
    words: tuple[str, ...]
    weight: float


#: How much an early place counts for themes (three for each of the first five sentences) and key points (six less the place), the score of a first clause, and the lengths of a title and of points.
EARLY, EACH, POINTS_EARLY, CLAUSE, TITLE, POINT, FILLED = 5, 3, 6, 60.0, 18, 72, 48


def pieces_of(text: str, pattern: re.Pattern) -> list[str]:
    return [s for s in (" ".join(p.split()) for p in pattern.split(text)) if s]


def keywords_in(words: dict[str, list[int]]) -> Callable[[str], set[str]]:
    """Which of the words a sentence holds."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    if not words:
        return lambda s: set()
    automaton.make_automaton()
    return lambda s: {w for _, w in automaton.iter(s)}


def by_keyword(groups) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, words in enumerate(groups):
        for w in words:  # a word that a rule names twice counts twice
            out.setdefault(w, []).append(k)
    out.pop("", None)
    return out


def title_candidates(df: DataFrame, key: str, text: str, rules: list[Theme], sentence: str = r"[。！？!?\n]", clause: str = r"[，。！？!?\n:：]", fallback: str = "") -> DataFrame:
    """(key, place from 1, title, score, goal): a text's title candidates, the best first, each title once; among equal scores themes in their order, then clauses in theirs.

    A theme scores, for each of its keywords in each sentence, the keyword's length, its priority and three for every place the sentence is before the sixth. The first clauses of the first three
    sentences are candidates of 60, 59 and 58. `fallback`, if not empty, is one of 1. A null text is empty and has the fallback alone.
    """
    split, cut = re.compile(sentence), re.compile(clause)
    schema = f"{key} {dict(df.dtypes)[key]}, place int, title string, score double, goal string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = by_keyword(r.keywords for r in rules)
        held = keywords_in(words)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sentences, scores = pieces_of(t or "", split), [0.0] * len(rules)
                for i, s in enumerate(sentences):
                    for w in held(s):
                        for r in words[w]:
                            scores[r] += len(w) + max(0, EARLY - i) * EACH + rules[r].priority
                found = [(x, r.title, r.goal) for x, r in zip(scores, rules, strict=True) if x > 0]
                for i, s in enumerate(sentences[:3]):
                    if first := next(iter(pieces_of(s, cut)), ""):
                        found.append((CLAUSE - i, first[:TITLE], ""))
                if fallback:
                    found.append((1.0, fallback, ""))
                best: dict[str, tuple] = {}
                for x, title, goal in sorted(found, key=lambda f: -f[0]):
                    best.setdefault(title, (x, goal))
                for place, (title, (x, goal)) in enumerate(best.items(), 1):
                    for column, v in zip(out, (k, place, title, x, goal), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.string())], names=[key, "place", "title", "score", "goal"])

    return df.select(key, text).mapInArrow(run, schema)


def key_points(df: DataFrame, key: str, text: str, markers: list[Marker], most: int = 3, least: int = 2, clause: str = r"[，。！？!?\n:：]", short: int = 4) -> DataFrame:
    """(key, place from 1, point): of a text's clauses the best by place and markers, each once, at most `most`; texts with fewer than `least` are filled up with clauses in order.

    A clause scores six less its place from 0 (0 at the least) and the weight of each marker that it has a word of. Scored clauses are cut to 72 characters, those that fill up to 48; a clause of fewer
    than `short` characters isn't scored but may fill up.
    """
    cut = re.compile(clause)
    schema = f"{key} {dict(df.dtypes)[key]}, place int, point string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = by_keyword(m.words for m in markers)
        held = keywords_in(words)
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                clauses, scored = pieces_of(t or "", cut), []
                for i, c in enumerate(clauses):
                    if len(c) >= short:
                        hit = {m for w in held(c) for m in words[w]}
                        scored.append((max(0, POINTS_EARLY - i) + sum(markers[m].weight for m in hit), c[:POINT].strip()))
                points = list(dict.fromkeys(p for _, p in sorted(scored, key=lambda s: -s[0])))[:most]
                for c in clauses:
                    if len(points) >= least:
                        break
                    if (p := c[:FILLED].strip()) not in points:
                        points.append(p)
                for place, p in enumerate(points[:most], 1):
                    for column, v in zip(out, (k, place, p), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=[key, "place", "point"])

    return df.select(key, text).mapInArrow(run, schema)


def best_sentences(df: DataFrame, key: str, text: str, words: tuple[str, ...], sentence: str = r"[。！？!?\n]", short: int = 4) -> DataFrame:
    """(key, sentence, score): of a text's sentences with any of the words the one with the most of them and the earliest place: ten a word and six less the place; the first of equals. Texts without one have no row."""
    split = re.compile(sentence)
    schema = f"{key} {dict(df.dtypes)[key]}, sentence string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = keywords_in({w: [0] for w in words})
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                scored = [(10.0 * n + max(0, POINTS_EARLY - i), -i, s) for i, s in enumerate(pieces_of(t or "", split)) if len(s) >= short and (n := len(held(s)))]
                if scored:
                    x, _, s = max(scored)
                    for column, v in zip(out, (k, s, x), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=[key, "sentence", "score"])

    return df.select(key, text).mapInArrow(run, schema)
