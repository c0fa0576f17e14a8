"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what they link on.

Candidates come in two ways. The first is simhash.py's: 64-bit fingerprints of the shingles, joined by Golay keys within two bits (and those that are
equal). Two bits reach few of the pairs near 0.8: such a pair differs in some 10 bits of 64, and Golay keys that allow for so many errors
would be thousands for each text. So the rest meet by minima of their shingles.

A text's words are as in simhash.py (parted by \\x20 and \\x09-\\x0D, A-Z count as a-z); a text with fewer than five has one shingle, all
of its words, and texts without words are one group. Texts with the same set are one node. Candidates of the second way share one of BANDS keys, each
of ROWS minima of the shingles' hashes: two texts of similarity 0.8 share none with probability (1 - 0.8**6)**32, 6 in 100,000, and less above.
Each candidate pair is checked on its whole sets before it links, but for those that are in one component already. This goes in rounds: in each key
whose nodes are in several components, all are checked against the most central node (the one whose keys have most nodes; in a group of
edited copies mostly the original), which then leaves the key. A round makes one pair a row. What is left after ROUNDS of them is compared in blocks of
nodes by matrix products, without a row for a pair. So no candidate goes unchecked, and a key all of whose nodes are linked costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import delete, written
from gleaner.llm.components import components
from gleaner.llm.simhash import links

WIDTH, BANDS, ROWS = 5, 32, 6
#: The least similarity, as a fraction.
SHARE, OF = 4, 5
#: Rounds of central nodes; nodes of a block; columns of a matrix.
ROUNDS, BLOCK, COLUMNS = 3, 128, 8192
#: Shingles whose minima are taken together; their arrays stay in the cache.
TOGETHER = 512
MULTIPLIER, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(11)
FLIPS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
FACTORS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)] if words else [], np.uint64)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w, 42) for w in words]), np.uint64)
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    for k in range(width):
        s = (s ^ h[k : k + n]) * MULTIPLIER
        s ^= s >> np.uint64(32)
    s *= FINISH
    return np.unique(s ^ s >> np.uint64(29))


def band_keys(s: np.ndarray) -> np.ndarray:
    if not len(s):
        return np.zeros(0, np.int64)
    half = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(half), TOGETHER):
        np.minimum(least, ((half[k : k + TOGETHER] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * MULTIPLIER
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fingerprint(s: np.ndarray) -> int:
    """64 bits as a signed number: a bit is 1 if over half of the hashes have it."""
    ones = sum(np.unpackbits(s[k : k + TOGETHER].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(s), TOGETHER))
    return int(np.packbits(2 * ones > len(s)).view(np.int64)[0]) if len(s) else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if SHARE * len(b) > OF * len(a):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return OF * both >= SHARE * (len(a) + len(b) - both)


def numbered(df: DataFrame) -> DataFrame:
    """The rows of df with a number of their own (rid), their node, its number of shingles (kinds), its fingerprint and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for b in batches:
            node, kinds, fp, keys = [], [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py() or "")
                node.append(xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63))
                kinds.append(len(s))
                fp.append(fingerprint(s))
                keys.append(band_keys(s))
            more = [pa.array(range(at, at + b.num_rows), pa.int64()), pa.array(node, pa.int64()), pa.array(kinds, pa.int32()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "rid", "node", "kinds", "fp", "keys"])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "rid long, node long, kinds int, fp long, keys array<long>"]))


def texts_of(rows: DataFrame, firsts: DataFrame, named: DataFrame) -> DataFrame:
    """node, held: the set of shingles of each named node, of the first text that has it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(t.as_py() or "").tobytes() for t in b.column("text")], pa.binary())], names=["node", "held"])

    texts = rows.select("rid", "node", "text").join(firsts.join(named, "node").select("rid"), "rid", "left_semi").select("node", "text")
    return texts.mapInArrow(sets, "node long, held binary")


def verified(rows: DataFrame, firsts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (a, b) of nodes that have the similarity, and where they are written."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held, held_at = written(texts_of(rows, firsts, named), "sets")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    out = written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near")
    delete(rows.sparkSession, held_at)
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share: products of 0-1 matrices over the shingles that several of them have, some columns at a time."""
    kinds, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((count > 1).sum()), COLUMNS):
        own = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[own], column[own] - low] = 1
        total += m @ m.T
    return total.astype(np.int64)


def compared(rows: DataFrame, firsts: DataFrame, mixed: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (a, b) of similar nodes of one key (key, node, label, n) that are in different components, and where they are written. A key's nodes are dealt into blocks of some BLOCK, and each two blocks meet in a group of their own, so no group grows with the key."""
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = mixed.select("key", "node", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "label", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    held, held_at = written(texts_of(rows, firsts, mixed.select("node").distinct()), "sets")

    def compare(table: pa.Table) -> pa.Table:
        node, label, own, low, high = (table.column(c).to_numpy() for c in ("node", "label", "own", "low", "high"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("held")]
        if not sum(map(len, sets)):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size, both = np.array([len(x) for x in sets]), overlaps(sets)
        near = OF * both >= SHARE * (size[:, None] + size[None, :] - both)
        near &= (label[:, None] != label[None, :]) & ((own[:, None] != own[None, :]) | (low[0] == high[0])) & (node[:, None] < node[None, :])
        i, j = np.nonzero(near)
        return pa.table({"a": node[i], "b": node[j]})

    out = written(dealt.join(held, "node").groupBy("key", "low", "high").applyInArrow(compare, "a long, b long").distinct(), "near")
    delete(rows.sparkSession, held_at)
    return out


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: each node with the least one of its fingerprint, and the least ones of fingerprints within two bits."""
    least, least_at = written(rows.groupBy("fp").agg(F.min("node").alias("a"), F.max("node").alias("last")), "fingerprints")
    same = rows.select("fp", "node").join(least.where("a <> last"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    near = links(least.select("fp"))
    near = near.join(least.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    out, _ = written(same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).where("a <> b").distinct(), "pairs")
    delete(rows.sparkSession, least_at)
    return out


def fitting(x: str, y: str) -> Column:
    """Whether sets of so many shingles can have the similarity."""
    return F.lit(SHARE) * F.greatest(x, y) <= F.lit(OF) * F.least(x, y)


def groups(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df with their number (rid), and the label of each number's group of near copies."""
    spark = df.sparkSession
    rows, _ = written(numbered(df), "rows")
    firsts, firsts_at = written(rows.groupBy("node").agg(F.min("rid").alias("rid")), "firsts")
    keyed, keyed_at = written(rows.select("node", "kinds", F.explode("keys").alias("key")).distinct(), "keyed")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met, met_at = written(keyed.join(sizes, "key"), "met")
    delete(spark, keyed_at)
    central = met.groupBy("node").agg(F.sum("n").alias("central"))
    left, left_at = written(met.join(central, "node").select("key", "node", "kinds", "central"), "left")
    pairs, pairs_at = written(fingerprint_pairs(rows), "pairs")
    edges, edges_at = verified(rows, firsts, pairs)
    paths = [firsts_at, met_at, pairs_at, edges_at]
    labels = components(edges)
    for k in range(ROUNDS + 1):
        now = left.join(labels, "node", "left").select("key", "node", "kinds", "central", F.coalesce("label", "node").alias("label"))
        of_key = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"), F.max_by(F.struct("node", "kinds", "label"), F.struct("central", -F.col("node"))).alias("p")).where("x <> y")
        mixed, mixed_at = written(now.join(of_key.select("key", "n", "p"), "key"), "mixed")
        delete(spark, left_at)
        if k < ROUNDS:
            fresh = mixed.where((F.col("label") != F.col("p.label")) & fitting("kinds", "p.kinds")).select("node", F.col("p.node").alias("to"))
            pairs, pairs_at = written(fresh.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct(), "pairs")
            more, more_at = verified(rows, firsts, pairs)
            paths.append(pairs_at)
            left, left_at = written(mixed.where(F.col("node") != F.col("p.node")).select("key", "node", "kinds", "central"), "left")
        else:
            more, more_at = compared(rows, firsts, mixed)
        edges = edges.union(more)
        paths += [more_at, mixed_at]
        if more.limit(1).count():
            labels = components(edges)
    found, _ = written(rows.select("rid", "node").join(labels, "node", "left").select("rid", F.coalesce("label", "node").alias("label")), "labels")
    for path in paths:
        delete(spark, path)
    return rows.select(*df.columns, "rid"), found
