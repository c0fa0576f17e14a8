"""Removal of every byte that lies in a long string which also starts elsewhere, by induced sorting of sharded suffixes.

Sharding. Equal strings of `length` bytes must meet. Each start of such a string (a window) is sent where its anchor goes: the
leftmost least hash among its grams (64 bytes or 8 words), which depends on the window alone. Neighbouring starts with one anchor
form a run, whose units (bytes, or words where passages of words are sought) are a segment of at most 2 * length units. An anchor that occurs once in the corpus ends there: none of
its windows can be repeated. Equal segments of an anchor are counted before they move (copies of a text cost one segment) and
all their windows are repeated. Where an anchor has several different segments, they go, by anchor, to shards of `shard_bytes`. A shard leaves
out what has no long gram about its anchor in common with another segment, and so no window; the suffixes of all others are sorted by induction with prefix values, see induced.py, spilling
its queues. An anchor with over HOT different segments, such as that of a passage which a third of all documents have, would
be one large group: its windows are counted one by one, each by its own 128-bit hash, in an aggregate that combines before it shuffles.

The removed spans return to their documents by id and text hash, so equal texts with any ids are right. Null texts count as
empty. Texts shorter than the string keep all bytes. Repeated rows count as occurrences of each other. A table without rows gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import arrow_schema, delete, documents, free_shuffles, per_batch, written
from gleaner.llm.induced import repeated_starts

#: Segments of one anchor that a task sorts together, under 5 MB; beyond that an anchor is hot.
HOT = 6000
#: A segment is compared with others by so many long grams about its anchor before it is sorted.
STEPS = 16
#: Windows of a long text are taken from at most so many bytes or words at once, and those of short texts together from so many, which a processor's cache holds.
BLOCK, GROUP = 1 << 20, 1 << 18
#: Fixed values of the rolling hash: odd multipliers.
MULTIPLIER, FINISH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Rolling:
    """Hashes of all grams of an array of bytes or of words' codes, from prefix sums of values times powers, modulo 2**64."""

    def __init__(self, most: int):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.append(np.uint64(1), np.full(most, MULTIPLIER, np.uint64)), dtype=np.uint64)
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(most, pow(MULTIPLIER, -1, 1 << 64), np.uint64)), dtype=np.uint64)
        self.value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.value[data] if data.dtype == np.uint8 else data) * self.power[: len(data)], out=out[1:])
        return out

    def grams(self, sums: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of all places, or of those at which a gram begins."""
        h = (sums[size:] - sums[:-size]) * self.inverse[: len(sums) - size] if at is None else (sums[at + size] - sums[at]) * self.inverse[at]
        return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(FINISH)
    h ^= h >> np.uint64(32)
    return h


#: Masks of the first 0 to 8 bytes of eight.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


_rolling: list[Rolling] = []


def rolling() -> Rolling:
    if not _rolling:
        _rolling.append(Rolling(BLOCK + (1 << 16)))
    return _rolling[0]


def leftmost_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.append(keys, np.full(-n % width, np.iinfo(keys.dtype).max, keys.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(padded, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def units_of_word(word: bytes) -> list[bytes]:
    """A word, or the characters of one of over LONG bytes: so text without blanks has passages, too."""
    return [word] if len(word) <= LONG else [c.encode() for c in word.decode()]


LONG = 60


class Bytes:
    """Texts as bytes."""

    gram, size = 64, 1

    @staticmethod
    def units(data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint8)

    codes = units

    @classmethod
    def codes_of(cls, texts: list[bytes]) -> list[np.ndarray]:
        return [cls.codes(t) for t in texts]

    @staticmethod
    def symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The parts as one text of symbols with a 0 after each, the parts' first positions, how many symbols there are, and how many stand for a unit."""
        text = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8).astype(np.uint16) + np.uint16(1)
        at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        text[at[1:] - 1] = 0
        return text, at, 257, 1


class Words:
    """Texts as words, each a 64-bit code; blanks between them do not count."""

    gram, size, digits = 8, 8, 3

    @staticmethod
    def units(data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint64)

    @classmethod
    def codes(cls, data: bytes) -> np.ndarray:
        return cls.codes_of([data])[0]

    @classmethod
    def codes_of(cls, texts: list[bytes]) -> list[np.ndarray]:
        """The words' codes of each text; short texts are taken together, with a blank between them."""
        out: list[np.ndarray] = []
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // GROUP, prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(texts)], strict=True):
            data = b" ".join(texts[a:z])
            first, end = cls.places(data).T
            size, codes = end - first, (end - first).astype(np.uint64)
            eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # at each place the eight bytes from it on
            left, k = np.arange(len(size)), 0
            while len(left):
                codes[left] = mixed((codes[left] * np.uint64(MULTIPLIER)) ^ (eights[first[left] + k] & FIRST_BYTES[np.minimum(size[left] - k, 8)]))
                k += 8
                left = left[size[left] > k]
            out += np.split(codes, np.searchsorted(first, np.cumsum(sizes[a : z - 1])))
        return out

    @staticmethod
    def places(data: bytes) -> np.ndarray:
        """First byte and end of each unit."""
        codes = np.frombuffer(data, np.uint8)
        blank = (codes == 32) | (codes - np.uint8(9) < 5)
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        long = np.flatnonzero(end - first > LONG)
        if len(long):
            inner = [a + 1 + np.flatnonzero(codes[a + 1 : z] & 0xC0 != 0x80) for a, z in zip(first[long].tolist(), end[long].tolist(), strict=True)]  # where a character begins
            first, end = (np.sort(np.concatenate([x, *inner])) for x in (first, end))
        return np.stack([first, end], axis=1)

    @classmethod
    def symbols(cls, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int, int]:
        """As of Bytes. The shard's own words are numbered; a number has three digits, of three alphabets, so that no match begins within a word."""
        sizes = np.array([len(p) // cls.size for p in parts], np.int64)
        kinds, number = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_inverse=True)
        base = max(1, int(np.ceil(len(kinds) ** (1 / 3))))
        base += base**3 < len(kinds)
        at = np.append(0, np.cumsum(cls.digits * sizes + 1))
        text = np.zeros(at[-1], np.uint16)
        first = np.arange(len(number)) * cls.digits + np.repeat(np.arange(len(parts)), sizes)
        for k, digit in enumerate((number // base**2, number // base % base, number % base)):
            text[first + k] = digit + 1 + k * base
        return text, at, cls.digits * base + 1, cls.digits


def anchored_runs(data: np.ndarray, length: int, gram: int, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """First start, number of starts and anchor hash of each run among the valid starts of data (at most BLOCK units or so)."""
    h = rolling().grams(rolling().sums(data), gram)
    position_bits = np.uint64(24)
    keys = (h >> position_bits << position_bits) | np.arange(len(h), dtype=np.uint64)
    anchor = (leftmost_least(keys, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.flatnonzero(valid)
    own = anchor[starts]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)))
    return starts[new], np.diff(np.append(new, len(starts))), h[own[new]].view(np.int64)


def alike(parts: list[np.ndarray], anchors: np.ndarray, whole: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which segments may have a window in common with another one, where either is not whole yet.

    Every window holds one of STEPS grams of nearly its length that begin at fixed distances before its anchor; segments with a window in common have such a gram in common.
    """
    step = (length - gram) // STEPS + 1
    size, sizes = length - step + 1, np.array([len(p) for p in parts], np.int64)
    keys, owners = [], []
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (BLOCK >> 1), prepend=-1))
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(parts)], strict=True):
        ends = np.cumsum(sizes[a:z])
        first, owner = ends - sizes[a:z], np.repeat(np.arange(z - a), sizes[a:z])
        sums = rolling().sums(np.concatenate(parts[a:z]))
        h = rolling().grams(sums, gram).view(np.int64)
        at = np.flatnonzero(h == anchors[a:z][owner[: len(h)]])
        at = at[np.append(True, np.diff(owner[at]) > 0)]  # the leftmost one is the anchor
        for begin in range(0, length - gram + 1, step):
            there = np.flatnonzero((at - begin >= first) & (at - begin + size <= ends))
            keys.append(rolling().grams(sums, size, at[there] - begin))
            owners.append(there + a)
    own = np.concatenate(owners)
    _, key, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    useful = (n > 1) & (np.bincount(key, ~whole[own]) > 0)
    out = np.zeros(len(parts), bool)
    out[own[useful[key]]] = True
    return out


def text_runs(texts: list[np.ndarray], length: int, form: type) -> Iterator[list[np.ndarray]]:
    """Columns of runs: which text, first start, starts, anchor, and two halves of the segment's hash; starts are counted in units."""
    group: list[int] = []
    held = 0

    def runs(data: np.ndarray, valid: np.ndarray) -> list[np.ndarray]:
        first, count, anchor = anchored_runs(data, length, form.gram, valid)
        view, digest = memoryview(data.tobytes()), xxhash.xxh3_128_digest
        ends = (first + count + length - 1) * form.size
        halves = np.frombuffer(b"".join([digest(view[a:z]) for a, z in zip((first * form.size).tolist(), ends.tolist(), strict=True)]), ">i8").astype(np.int64).reshape(-1, 2)
        return [first, count, anchor, halves[:, 0], halves[:, 1]]

    def flush() -> list[np.ndarray]:
        data = np.concatenate([texts[k] for k in group])
        sizes = np.array([len(texts[k]) for k in group])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(group)), sizes)[: len(data) - length + 1]
        first, *rest = runs(data, np.arange(len(owner)) + length <= ends[owner])
        k = owner[first]
        return [np.array(group)[k], first - (ends - sizes)[k], *rest]

    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        if held + len(t) > GROUP and group:
            yield flush()
            group, held = [], 0
        if len(t) > BLOCK:
            for at in range(0, len(t) - length + 1, BLOCK // 2):
                part = t[at : at + BLOCK // 2 + length - 1]
                first, *rest = runs(part, np.ones(len(part) - length + 1, bool))
                yield [np.full(len(first), k), first + at, *rest]
        else:
            group.append(k)
            held += len(t)
    if group:
        yield flush()


#: For written tables whose columns are hashes, of which dictionaries are tried in vain.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("anchor", "s1", "s2", "bytes")}

RUN = "doc_id long, text_hash long, at int, n int, anchor long, s1 long, s2 long"


def halves(digest: int) -> tuple[int, int]:
    signed = digest.to_bytes(16, "big")
    return int.from_bytes(signed[:8], "big", signed=True), int.from_bytes(signed[8:], "big", signed=True)


def runs_of(docs: DataFrame, length: int, form: type) -> DataFrame:
    arrow = arrow_schema(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for which, *columns in text_runs(form.codes_of(b.column("text").to_pylist()), length, form):
                columns = [*(b.column(c).take(pa.array(which)) for c in ("doc_id", "text_hash")), *columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, safe=False) if isinstance(c, np.ndarray) else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.where(F.octet_length("text") >= length).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(run, RUN)


def ranges_of(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


RESULT = "s1 long, s2 long, ranges array<struct<first:int,n:int>>"


def sorted_shards(segments: DataFrame, length: int, shards: int, form: type) -> DataFrame:
    """Repeated starts of segments (anchor, s1, s2, whole, n, bytes), which meet by anchor in one of so many shards."""
    arrow = arrow_schema(RESULT)

    def sort(table: pa.Table) -> pa.Table:
        anchor, s1, s2, whole, n = (table.column(c).to_numpy() for c in ("anchor", "s1", "s2", "whole", "n"))
        once = np.unique(np.stack([s1, s2], axis=1), axis=0, return_index=True)[1]  # rows of one id and text are cut twice
        values = table.column("bytes").take(pa.array(once)).to_pylist()
        near = np.flatnonzero(alike([form.units(v) for v in values], anchor[once], whole[once], length, form.gram))
        found, ranges, own = [], [], once[near]
        if len(near):
            text, at, symbols, each = form.symbols([values[k] for k in near.tolist()])
            hit = repeated_starts(text, length * each, symbols)
            for a, k in zip(at.tolist(), own.tolist()):  # at ends with the text's length
                if not whole[k] and (r := ranges_of(hit[a : a + n[k] * each : each])):
                    found.append(k)
                    ranges.append(r)
        return pa.Table.from_arrays([pa.array(s1[found]), pa.array(s2[found]), pa.array(ranges, arrow.field("ranges").type)], schema=arrow)

    return segments.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(sort, RESULT)


def counted_windows(segments: DataFrame, length: int, form: type) -> tuple[DataFrame, str]:
    """The same for the segments of hot anchors: every window is counted by its hash. Also where the windows are written."""

    def windows(rows: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("s1", "s2", "whole", "i", "w1", "w2")}
        for s1, s2, whole, n, data in zip(*(rows[c] for c in ("s1", "s2", "whole", "n", "bytes")), strict=True):
            for i in range(n):
                for c, v in zip(out, (s1, s2, whole, i, *halves(xxhash.xxh3_128_intdigest(data[i * form.size : (i + length) * form.size]))), strict=True):
                    out[c].append(v)
        return out

    once = segments.select("s1", "s2", "whole", "n", "bytes").dropDuplicates(["s1", "s2"])
    every, at = written(per_batch(once, windows, "s1 long, s2 long, whole boolean, i int, w1 long, w2 long"), "windows")
    twice = every.groupBy("w1", "w2").agg((F.count("*") + F.max(F.col("whole").cast("int"))).alias("c")).where("c > 1").select("w1", "w2")
    met = every.where("not whole").join(twice, ["w1", "w2"]).groupBy("s1", "s2").agg(F.collect_list("i").alias("starts"))  # at most `length` starts
    return met.select("s1", "s2", F.transform("starts", lambda i: F.struct(i.alias("first"), F.lit(1).alias("n"))).alias("ranges")), at


def repeated_spans(docs: DataFrame, length: int, shard_bytes: int, form: type = Bytes) -> tuple[DataFrame, str]:
    """doc_id, text_hash, spans (from, to) of documents that have something to remove, one row for an id and text, spans counted in units; and where they are written."""
    runs, runs_at = written(runs_of(docs, length, form), "runs", PLAIN)
    segment = ["s1", "s2"]  # equal segments have one anchor
    place = ["anchor", "doc_id", "text_hash", "at", "n"]
    segments, segments_at = written(runs.groupBy(*segment).agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in place)), "segments", PLAIN)  # where any one of them is
    anchors = segments.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("c").alias("all")).where("all > 1").select("anchor", "kinds")
    met, met_at = written(segments.join(anchors, "anchor").withColumn("whole", F.col("c") > 1), "met", PLAIN)
    delete(docs.sparkSession, segments_at)
    found = met.where("whole").select(*segment, F.array(F.struct(F.lit(0).alias("first"), F.col("n"))).alias("ranges"))

    several = met.where("kinds > 1")
    size = several.where(f"kinds <= {HOT}").agg(F.sum((F.col("n") + length) * form.size)).first()[0] or 0
    parts = ["anchor", *segment, "whole", "n", "at", "kinds"]
    wanted = several.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*parts)).alias("parts"))  # runs of one document
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = texts.where(F.octet_length("text") >= length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, flat = b.column("parts"), b.column("parts").flatten()
            first = flat.field("at").to_numpy() * form.size
            end = first + (flat.field("n").to_numpy() + length - 1) * form.size
            values, k = [], 0
            for codes, many in zip(form.codes_of(b.column("text").to_pylist()), held.value_lengths().to_pylist(), strict=True):
                data = codes.tobytes()
                values += [data[a:z] for a, z in zip(first[k : k + many].tolist(), end[k : k + many].tolist(), strict=True)]
                k += many
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in kept), pa.array(values, pa.binary())], [*kept, "bytes"])

    kept = [c for c in parts if c != "at"]
    same = [texts["doc_id"].eqNullSafe(wanted["doc_id"]), texts["text_hash"] == wanted["text_hash"]]
    cut_out = texts.join(wanted, same).select(F.col("text").cast("binary").alias("text"), "parts").mapInArrow(cut, "anchor long, s1 long, s2 long, whole boolean, n int, kinds long, bytes binary")
    cut_out, cut_at = written(cut_out, "segments", PLAIN)
    found = found.union(sorted_shards(cut_out.where(f"kinds <= {HOT}"), length, max(1, -(-size // shard_bytes)), form))
    hot, hot_at = counted_windows(cut_out.where(f"kinds > {HOT}"), length, form)
    found = found.union(hot)
    spans = runs.join(found, segment).select("doc_id", "text_hash", F.transform("ranges", lambda r: F.struct((F.col("at") + r["first"]).alias("from"), (F.col("at") + r["first"] + r["n"] + F.lit(length - 1)).alias("to"))).alias("spans"))
    spans, spans_at = written(spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")  # of one document
    for path in (runs_at, met_at, cut_at, hot_at):
        delete(docs.sparkSession, path)
    free_shuffles(docs.sparkSession)
    return spans, spans_at


def merged(column: pa.ListArray, gap: int) -> list[list[tuple[int, int]]]:
    """The spans of each row, ascending, and one where less than `gap` units lie between them (1: they touch, 0: they overlap); none for null."""
    flat, count = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(column)) << 32, count)
    first, end = (flat.field(c).to_numpy() + row for c in ("from", "to"))
    order = np.argsort(first)
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, first[1:] >= end[:-1] + gap)[: len(first)])
    last = np.append(new[1:], len(first))[: len(new)] - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    for k, a, z in zip((first[new] >> 32).tolist(), (first[new] & 0xFFFFFFFF).tolist(), (end[last] & 0xFFFFFFFF).tolist(), strict=True):
        out[k].append((a, z))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    keep, at = [], 0
    for a, b in spans:
        keep.append(data[at:a])
        at = b
    return b"".join([*keep, data[at:]])


def word_spans(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of bytes for spans of words, of which blanks between two spans are no part."""
    places = Words.places(data)
    return [(int(places[a, 0]), int(places[z - 1, 1])) for a, z in spans]


def rows_with_spans(b: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Each row's text as bytes, and its spans and passages, both in bytes."""
    for text, spans, passages in zip(b.column("text"), merged(b.column("spans"), 1), merged(b.column("passages"), 0), strict=True):
        data = text.as_py()
        yield data, spans, word_spans(data, passages) if passages else []


def cleaned(df: DataFrame, *more: str, length: int = 0, words: int = 0, shard_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, the columns named in more, text as bytes, spans, passages (null: nothing to remove): each document beside its repeated strings of `length` bytes and passages of so many words (0: not sought)."""
    docs = documents(df)
    spans = df.sparkSession.createDataFrame([], "_id long, _hash long, kind string, spans array<struct<from:int,to:int>>")
    for kind, least, form in (("spans", length, Bytes), ("passages", words, Words)):
        if least:
            found, _ = repeated_spans(docs, least, shard_bytes, form)
            spans = spans.union(found.select("doc_id", "text_hash", F.lit(kind), "spans"))
    spans = spans.groupBy("_id", "_hash").agg(*(F.first(F.when(F.col("kind") == k, F.col("spans")), True).alias(k) for k in ("spans", "passages")))
    whole = documents(df, *more).withColumn("_text_hash", F.xxhash64("text"))
    return whole.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left").drop("_id", "_hash", "_text_hash").withColumn("text", F.col("text").cast("binary"))


def remove_repeats(df: DataFrame, *more: str, length: int = 400, words: int = 0, shard_bytes: int = 1 << 20) -> DataFrame:
    """The documents without their repeated strings of `length` bytes and passages of so many words (0: not sought); what remains of a cut character goes too."""

    types = dict(df.dtypes)
    result = ", ".join(["doc_id long", "text string", *(f"`{c}` {types[c]}" for c in more)])
    arrow = arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for data, spans, passages in rows_with_spans(b):
                cut: list[tuple[int, int]] = []
                for a, z in sorted([*spans, *passages]):
                    a = max(a, cut[-1][1]) if cut else a
                    cut += [(a, z)] if z > a else []
                texts.append(without(data, cut).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), *(b.column(c) for c in more)], schema=arrow)

    return cleaned(df, *more, length=length, words=words, shard_bytes=shard_bytes).mapInArrow(run, result)


def removal_digests(df: DataFrame, length: int = 400, words: int = 51, shard_bytes: int = 1 << 20) -> DataFrame:
    """What removing the repeated strings of `length` bytes does to each document; beside it n_passage_bytes, the bytes in passages of so many words that also start elsewhere, whatever their bytes."""

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"
    arrow = arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, spans, passages in rows_with_spans(b):
                kept = without(data, spans) if spans else data
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), sum(z - a for a, z in passages)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return cleaned(df, length=length, words=words, shard_bytes=shard_bytes).mapInArrow(run, result)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
