"""SimHash fingerprints of word shingles, linked within two differing bits through Golay-code fuzzy keys.

Two fingerprints at most two bits apart, cut into segments A (23 bits), B (23) and C (18), have at least one segment without an
error, and at most two errors in the segment after it. A word of 23 bits gets as keys the indices of all codewords of the
binary Golay code within distance 4: one, or six if its nearest codeword is three bits away. The code is perfect with radius 3:
the word half-way between two words at distance 2 has a codeword within 3, which is within 4 of both; so they share a key.
A key is one exact segment and one index of the next segment, 35 bits or 30. Fingerprints (distinct ones, each with the
smallest id of its documents) that share a key are joined and verified: in groups up to SMALL bit by bit; in larger ones by
balls, as two fingerprints are within two bits exactly if some value is within one bit of both, and no ball has more than 65
members. So no group is ever expanded into all pairs and none is capped. Components follow from minimum labels.

Null and empty texts have fingerprint zero and are linked like any other; texts with fewer words than a shingle have one
shingle, the whole sequence. Texts of any length are read whole. Repeated rows share a component. A table without rows gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import delete, documents, per_batch, written
from gleaner.llm.components import components

#: The generator polynomial of the binary Golay code of length 23, and the segments (lowest bit, bits).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
SMALL = 128
BATCH = 8192


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64 bits: bit k is 1 if over half of the shingles' hashes have it. Upper-case A-Z count as lower case."""
    words = text.encode().lower().split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    shingles = zip(*(words[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
    digest, join = xxhash.xxh64_digest, b" ".join
    hashes = np.frombuffer(b"".join([digest(join(s), seed) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[k : k + BATCH], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(hashes), BATCH))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(rows: dict) -> dict:
        fps = np.array([fingerprint(t, width) for t in rows["text"]], np.uint64)
        return {"doc_id": rows["doc_id"], "fp": fps.view(np.int64)}

    return per_batch(documents(df), run, "doc_id long, fp long")


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word, and the errors of weight up to 4 of each syndrome (-1: no more)."""

    def syndrome(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word

    bit = np.array([syndrome(1 << k) for k in range(23)], np.int64)
    tables = np.zeros((3, 256), np.int64)
    for part in range(3):
        for value in range(256):
            for k in range(8):
                if value >> k & 1 and 8 * part + k < 23:
                    tables[part, value] ^= bit[8 * part + k]
    errors, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    wave = [(0, 0, 0)]  # error, its syndrome, the next bit to set
    for _ in range(5):
        for e, s, _at in wave:
            errors[s, filled[s]] = e
            filled[s] += 1
        wave = [(e | 1 << k, s ^ int(bit[k]), k + 1) for e, s, at in wave for k in range(at, 23)]
    return tables, errors


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of 23 bits the 12-bit indices of the codewords within distance 4: positions in words, indices."""
    tables, errors = golay()
    s = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16 & 127]
    e = errors[s]
    at, which = np.nonzero(e >= 0)
    return at, (words[at] ^ e[at, which]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in fps and keys: which segment is exact, its bits, and an index of the next segment."""
    parts = [(fps.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1) for low, bits in SEGMENTS]
    out = []
    for k in range(3):
        at, index = codeword_indices(parts[(k + 1) % 3])
        out.append((at, k << 40 | parts[k][at] << 12 | index))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct values fp that give the same components as all pairs within two bits."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            at, key = fuzzy_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at])], names=["key", "fp"])

    keyed, keyed_at = written(distinct.select("fp").mapInArrow(keys, "key long, fp long"), "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in b.column("fps"):
                v = np.array(row.as_py(), np.int64)
                i, j = np.nonzero(np.triu(np.bitwise_count((v[:, None] ^ v[None, :]).view(np.uint64)) <= 2, 1))
                a_all.append(v[i])
                b_all.append(v[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_all)), pa.array(np.concatenate(b_all))], names=["a", "b"])

    near = met.where(f"n <= {SMALL}").groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(verify, "a long, b long")
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    many = met.where(f"n > {SMALL}").select("fp").distinct()
    balls = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    balls = balls.groupBy("centre").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
    stars = balls.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    out, _ = written(near.union(stars).distinct(), "links")
    delete(distinct.sparkSession, keyed_at)
    return out


def near_duplicates(df: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable), one row per document."""
    docs, _ = written(fingerprints(df, width), "fingerprints")
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(distinct))
    roots = distinct.join(joined.withColumnRenamed("node", "fp"), "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    linked = joined.join(roots, "label").select(F.col("node").alias("fp"), "component_id")
    # a table of its own: Spark splits a fingerprint that many documents have only where both sides come from their exchanges
    classes, _ = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return docs.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
