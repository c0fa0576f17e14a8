"""Best-fit packing of token sequences, bulk-synchronously over size classes.

Every document becomes pieces of at most `capacity` tokens: only longer ones are cut, and only their first piece may be shorter.
Pieces are dealt by (length, salt) and ranked, so that a length that a third of all pieces have is still spread over many
tasks. Lengths and gaps are whole numbers up to `capacity`; so the range-sorted lists of pieces and gaps are held as runs of
equal values, with ranks standing for the rows. One superstep takes the longest length left: a successor sweep over the gap
runs finds the smallest gap that fits, pieces and gaps of a run are matched by rank (piece rank j gets gap rank j, so no two
claim one gap), the gaps are updated, and the next step follows. The runs depend on `capacity` alone, at most a few thousand,
whatever the number of documents. Then each piece finds its run by rank, in parallel, and so its sequence and offset. The
result is that of best-fit decreasing.

Null texts count as empty; an empty text still has its end token. Repeated rows are packed each by itself. A table without rows
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.bpe import SPECIAL, SPLIT
from gleaner.llm.common import documents, written

SALTS = 128


@functools.lru_cache(2)
def token_ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def begins_with_blank(ranks_path: str) -> np.ndarray:
    """By id, whether a token's first byte is a blank; the special one's is not."""
    ranks = token_ranks(ranks_path)
    out = np.zeros(len(ranks) + 1, bool)
    out[[i for t, i in ranks.items() if t[:1] == b" "]] = True
    return out


@functools.lru_cache(2)
def token_ids(ranks_path: str):
    """The ids of a text by the public ranks; the special string is one token."""
    import tiktoken

    ranks = token_ranks(ranks_path)
    encoding = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """start and length of each piece; all but the first are full."""
    first = len(ids) % capacity or min(len(ids), capacity)
    return [(0, first), *((s, capacity) for s in range(first, len(ids), capacity))]


def token_pieces(df: DataFrame, ranks_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(ranks_path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                data = memoryview(ids.tobytes())
                rows += [(doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(ids, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(df).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The supersteps over runs: (length, first rank, first sequence, pieces a sequence, offset of the first piece).

    From its first rank on, until the next entry of the same length, piece rank j goes to sequence first + j // pieces.
    """
    gaps: dict[int, deque] = defaultdict(deque)  # gap: runs of (first sequence, sequences)
    out, opened = [], 0
    for length in range(capacity, 0, -1):
        left, rank = counts.get(length, 0), 0
        gap = length
        while left:
            while gap <= capacity and not gaps[gap]:  # the successor sweep
                gap += 1
            if gap <= capacity:
                first, n = gaps[gap].popleft()
                width = gap
            else:
                width, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = width // length
            out.append((length, rank, first, each, capacity - width))
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
            if full:
                gaps[width - each * length].append((first, full))
            if rest:
                gaps[width - rest * length].append((first + full, 1))
            if (untouched := n - full - (rest > 0)) > 0:
                gaps[width].appendleft((first + full + (rest > 0), untouched))
            left -= full * each + rest
            rank += full * each + rest
    return out


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to capacity)."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")).cast("long") - 1)
    ranked, _ = written(ranked, "pieces")
    counts = np.zeros((capacity + 1, SALTS), np.int64)  # of fixed size, whatever the number of pieces
    for r in ranked.groupBy("length", "_salt").count().collect():
        counts[r["length"], r["_salt"]] = r["count"]
    before = np.cumsum(counts, axis=1) - counts
    runs = np.array(fit_runs({k: int(v) for k, v in enumerate(counts.sum(axis=1)) if v}, capacity) or [(capacity + 1, 0, 0, 1, 0)], np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast((before, runs))
    names = [c for c in ranked.columns if c[0] != "_"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = shared.value
        keys = runs[:, 0] << 48 | runs[:, 1]
        for b in batches:
            length, salt, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_salt", "_rank"))
            rank = rank + before[length, salt]
            run = runs[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            rank = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(run[:, 2] + rank // run[:, 3]), pa.array(run[:, 4] + rank % run[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, ranks_path: str, capacity: int = 1024) -> DataFrame:
    return pack(token_pieces(df, ranks_path, capacity), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
