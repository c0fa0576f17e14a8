"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (from its code point alone, so all tasks agree). A trigram is bound from its
letters' vectors, permuted by place: rotate(a, 2) * rotate(b, 1) * c, where a run of anything but letters is one gap that has
a vector too. A document's profile bundles (adds) the vectors of all its trigrams; a language's prototype bundles the
profiles, scaled to length one, of its training documents. A document is given the language whose prototype has the greatest
cosine with its profile; ties go to the first name in order. Scaled profiles are added as whole numbers, so that the order of
tasks cannot change a prototype; only languages x dimensions numbers come to the driver.

A null text, or one without a letter, is `und` with score 0; so is every text if nothing could be learned. Rows without a
language are not learned from. Texts of any length are read whole. Repeated rows count again. A table without rows gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import remainder

DIMENSIONS, SEED, SCALE = 512, 11, 1 << 20
#: Letters and documents that are worked on together.
CHUNK_CHARS, CHUNK_DOCS = 600_000, 256
UNKNOWN = "und"


@functools.cache
def is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@functools.lru_cache(200_000)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng((SEED, code)).integers(0, 2, dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)


def profiles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of `dimensions` numbers for each text; zero if it has no letter."""
    out = np.zeros((len(texts), dimensions), np.float32)
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    code = np.where(is_letter()[code], code, 0)
    keep = np.append(True, (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1]))  # a gap is one symbol
    code, owner = code[keep], owner[keep]
    letters, small = np.unique(code, return_inverse=True)
    inside = owner[2:] == owner[:-2]
    grams = ((small[:-2].astype(np.int64) * len(letters) + small[1:-1]) * len(letters) + small[2:])[inside]
    owner = owner[2:][inside]
    if not len(grams):
        return out
    if len(letters) ** 3 <= 1 << 22:
        there = np.flatnonzero(np.bincount(grams))
        place = np.zeros(there[-1] + 1, np.int64)
        place[there] = np.arange(len(there))
        column = place[grams]
    else:
        there, column = np.unique(grams, return_inverse=True)
    counts = np.bincount(owner * len(there) + column, minlength=len(texts) * len(there)).reshape(len(texts), -1).astype(np.float32)
    vector = np.stack([letter_vector(int(c), dimensions) for c in letters])
    a, b, c = there // len(letters) ** 2, there // len(letters) % len(letters), there % len(letters)
    bound = np.roll(vector, 2, axis=1)[a] * np.roll(vector, 1, axis=1)[b] * vector[c]
    np.matmul(counts, bound.astype(np.float32), out=out)
    has = np.bincount(owner, minlength=len(texts)) > 0
    out[~has] = 0
    return out


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Position of the first, texts: bounded groups of neighbouring texts."""
    at, group, held = 0, [], 0
    for k, t in enumerate(texts):
        t = t or ""
        if group and (held + len(t) > CHUNK_CHARS or len(group) == CHUNK_DOCS):
            yield at, group
            at, group, held = k, [], 0
        group.append(t)
        held += len(t)
    if group:
        yield at, group


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def prototypes(training: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Per language the bundle of the training documents' scaled profiles (text, lang)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for at, group in chunks(texts):
                p = profiles(group, dimensions)
                p = np.rint(p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9) * SCALE).astype(np.int64)
                own = np.array(langs[at : at + len(group)])
                for lang in set(own.tolist()):
                    sums[lang] = sums.get(lang, 0) + p[own == lang].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    rows = training.select("text", "lang").mapInArrow(add, "lang string, v array<long>")
    total = rows.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in total:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["pos"]] = r["v"] / SCALE
    return dict(sorted(out.items()))


def identify(df: DataFrame, known: dict[str, np.ndarray], *more: str) -> DataFrame:
    """The columns named in more, then lang_pred and score (the cosine, at least 0)."""
    spark = df.sparkSession
    names = list(known)
    table = np.stack(list(known.values())) if known else np.zeros((0, DIMENSIONS))
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(((table / np.maximum(norms, 1e-9)).T.astype(np.float32), names))
    types = dict(df.dtypes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        towards, names = shared.value
        for b in batches:
            langs, scores = [], []
            for _, group in chunks(b.column("_text").to_pylist()):
                p = profiles(group)
                cosine = p @ towards / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
                for k, text in enumerate(group):
                    if names and has_letter(text):
                        best = int(cosine[k].argmax())
                        langs.append(names[best])
                        scores.append(float(min(1.0, max(0.0, cosine[k, best]))))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in more), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*more, "lang_pred", "score"])

    return df.select(*more, F.col("text").cast("string").alias("_text")).mapInArrow(predict, ", ".join([*(f"`{c}` {types[c]}" for c in more), "lang_pred string", "score double"]))


def learn(df: DataFrame, folds: int = 5) -> dict[str, np.ndarray]:
    """Prototypes from text and lang of the documents outside fold 0."""
    return prototypes(df.where((remainder("doc_id", folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", remainder("doc_id", 5) == 0)
    return identify(held, learn(docs), "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")
