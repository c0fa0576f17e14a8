"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. On each level, runs of one symbol become one symbol; then deterministic coin tossing gives every
symbol a small label from the lowest bit in which it differs from its left neighbour, and again from those labels, four times;
symbols whose label is greater than both neighbours' begin a phrase, and a hash of a phrase's symbols is a symbol of the next
level. A boundary depends on a few neighbours only; so equal substrings are parsed alike but for their ends, wherever they
stand. The fingerprint holds the least hash of phrase names in each of 64 bins, over all levels from FIRST on (phrases of about 27
characters, 81, 243 and so on, up to the whole text). The likeness of two fingerprints is the share of bins with equal values among those that
either has, which estimates the share of common phrases.

Null texts count as empty; an empty text's fingerprint is all zeros, and two such have likeness 1. Equal texts have equal fingerprints. Documents are in order of doc_id (null
first), those of one id in order of a hash of the text; the last one's next is the first, and a single document is its own next. A
table without rows gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents

BINS, FIRST, LEVELS, ROUNDS = 64, 3, 40, 4
CHUNK_CHARS = 1_500_000
#: Fixed values of the mixing function.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(MIX[0])
    x = (x ^ x >> np.uint64(27)) * np.uint64(MIX[1])
    return x ^ x >> np.uint64(31)


def toss(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Labels of one byte; neighbours' labels differ wherever neighbours' symbols do. begins: where texts begin."""
    x = symbols
    for _ in range(ROUNDS):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[begins] = ~x[begins]
        differ = x ^ left
        low = np.bitwise_count((differ & -differ) - differ.dtype.type(1)).astype(np.uint8)
        x = (low << 1) | ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)
    return x


def grouped(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One name for each group of names that begins at starts."""
    place = np.arange(len(names), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(names)))).astype(np.uint64)
    return mix(np.add.reduceat(mix(names + place * np.uint64(MIX[2])), starts))


def next_level(names: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level and where texts begin among them."""
    first = np.zeros(len(names), bool)
    first[begins] = True
    same = np.append(False, names[1:] == names[:-1]) & ~first
    if same.any():  # runs of one symbol
        starts = np.flatnonzero(~same)
        length = np.diff(np.append(starts, len(names)))
        names = np.where(length > 1, mix(names[starts] + length.astype(np.uint64) * np.uint64(MIX[2])), names[starts])
        first = first[starts]
        begins = np.flatnonzero(first)
    label = toss(names, begins).astype(np.int8)
    left = np.append(np.int8(127), label[:-1])
    right = np.append(label[1:], np.int8(127))
    right[:-1][first[1:]] = 127
    cut = first | ((label > left) & (label > right))
    starts = np.flatnonzero(cut)
    return grouped(names, starts), np.flatnonzero(first[starts])


def sketches(texts: list[str]) -> np.ndarray:
    """BINS values of 16 bits for each text; 0: empty."""
    out = np.zeros((len(texts), BINS), np.uint16)
    filled = [k for k, t in enumerate(texts) if t]
    if not filled:
        return out
    sizes = np.array([len(texts[k]) for k in filled])
    begins = np.cumsum(sizes) - sizes
    names = mix(np.frombuffer("".join(texts[k] for k in filled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    owner = np.array(filled)
    keys = []
    for level in range(1, LEVELS):
        names, begins = next_level(names, begins)
        if level >= FIRST:
            own = np.repeat(owner, np.diff(np.append(begins, len(names))))
            keys.append((own.astype(np.uint64) * np.uint64(BINS) + (names & np.uint64(BINS - 1))) << np.uint64(16) | (names >> np.uint64(20)) % np.uint64(65535))
            alone = np.diff(np.append(begins, len(names))) == 1
            if alone.all():
                break
            if alone.any():  # texts that are one phrase by now are done
                keep = ~np.repeat(alone, np.diff(np.append(begins, len(names))))
                first = np.zeros(len(names), bool)
                first[begins] = True
                names, begins, owner = names[keep], np.flatnonzero(first[keep]), owner[~alone]
    key = np.unique(np.concatenate(keys))
    slot = key >> np.uint64(16)
    least = np.append(True, slot[1:] != slot[:-1])
    out.reshape(-1)[slot[least].astype(np.int64)] = (key[least] & np.uint64(0xFFFF)).astype(np.uint16) + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(either == 0, 1.0, ((a == b) & (a > 0)).sum(axis=1) / np.maximum(either, 1))


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """The results of all rows but the last, which is there as a neighbour."""
    own = [t for _, t in rows]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, own[1:], strict=False)]
    s, e = sketches(own), sketches(edited)
    columns = [
        pa.array([i for i, _ in rows[:-1]], pa.int64()),
        pa.array([len(t) for t in own[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([as_text(x) for x in s[:-1]]),
        pa.array([as_text(x) for x in e]),
        pa.array(likeness(s[:-1], e)),
        pa.array(likeness(s[:-1], s[1:])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes buckets in order, each with its documents in order and then a copy of the document after its last one."""
    rows: list[tuple[int | None, str]] = []
    held, bucket, ended = 0, None, False
    for b in batches:
        for own, look, doc, text in zip(b.column("bucket").to_pylist(), b.column("look").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            if own != bucket:
                rows, held, bucket, ended = [], 0, own, False
            if ended:
                continue
            rows.append((doc, text.as_py()))
            held += len(rows[-1][1])
            if look or held > CHUNK_CHARS and len(rows) > 1:
                yield compared(rows)
                rows, held, ended = rows[-1:], len(rows[-1][1]), look


def fingerprint_documents(df: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and likenesses to the edited text and to the next document."""
    spark, docs = df.sparkSession, documents(df)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    cuts = np.array(docs.agg(F.percentile_approx("place", shares, 20 * buckets).alias("p")).first()["p"] or [0], np.int64)

    @F.pandas_udf("int")
    def bucket_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(), side="left").astype(np.int32))

    firsts = sorted((r["bucket"], r["place"]) for r in docs.select(bucket_of("place").alias("bucket"), "place").groupBy("bucket").agg(F.min("place").alias("place")).collect())  # one for each bucket
    before = {place: firsts[k - 1][0] for k, (_, place) in enumerate(firsts)}

    @F.pandas_udf("array<struct<bucket:int,look:boolean>>")
    def goes_to(place: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, place.to_numpy(), side="left")
        return pd.Series([[{"bucket": int(b), "look": False}] + ([{"bucket": before[p], "look": True}] if p in before else []) for b, p in zip(own, place, strict=True)])

    sent = docs.withColumn("go", F.explode(goes_to("place"))).select("go.*", "doc_id", "place", F.xxhash64("text").alias("tie"), "text")
    return sent.repartitionByRange(buckets, "bucket").sortWithinPartitions("bucket", "look", "place", "tie").drop("place", "tie").mapInArrow(with_next, COLUMNS)


def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
