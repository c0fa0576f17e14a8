"""Byte-level BPE by a minimal acyclic transducer of frequent words, with exact merges for all other words.

The words that are frequent in the whole corpus are compiled, with their token ids as output, into a minimal acyclic
automaton: states with the same continuations are one state, so suffixes are shared, and each edge carries how many words
come before it, so that the sum along a path is the word's row in the table of outputs. The compiled bytes are broadcast
(their size is bounded by `words`), written to an unlinked file by each Python worker and memory-mapped. A word that the
automaton does not hold is merged by rank, which gives the same ids; the automaton changes speed alone. The new words of a
group of texts go through the automaton together, a byte of every word at a time, and so do the merges of the words it does
not hold.

Null texts count as empty and empty texts have no tokens. Repeated rows and repeated ids stay as they are. Extra columns are
ignored. A text's words of any length are merged in O(n log n).
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, most_frequent, per_batch

#: Fixed values of the public vocabulary: its split pattern, and the string that is one token wherever it stands.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPLIT = CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: Texts whose characters are all below this are split by the standard library's faster engine.
NARROW = 0x250
#: More than any rank and id packed in one number.
NEVER = 1 << 60
#: Words of more bytes are merged one by one; texts are worked on in groups of about this many characters.
SHORT, GROUP_CHARS = 48, 1_000_000


def narrow_pattern() -> re.Pattern:
    """SPLIT for characters below NARROW, with the classes spelled out from the Unicode categories."""
    kind = {k: "".join(re.escape(chr(c)) for c in range(NARROW) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    letter, digit, space = kind["L"], kind["N"], r"\t-\r \x85\xa0"
    return re.compile(f"{CONTRACTIONS}| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


@functools.lru_cache(None)
def splitters():
    return narrow_pattern().findall, regex.compile(SPLIT).findall, re.compile(f"[^\\x00-{chr(NARROW - 1)}]").search


def split_words(text: str) -> list[str]:
    """The words of a text, the special string apart; they join to the text."""
    narrow, wide, is_wide = splitters()
    find = wide if is_wide(text) else narrow
    if SPECIAL not in text:
        return find(text)
    out: list[str] = []
    for k, part in enumerate(text.split(SPECIAL)):
        out += [SPECIAL] * (k > 0)
        out += find(part)
    return out


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable bytes are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id and merge ranks by pair of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        ids = model["model"]["vocab"]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.start = [ids[next(c for c, b in letters.items() if b == k)] for k in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b]))
        pairs = sorted(self.merges)
        self.pairs = np.array([*pairs, NEVER])
        self.packed = np.array([*(rank << 20 | i for rank, i in map(self.merges.get, pairs)), NEVER])
        self.start_ids = np.array(self.start)
        self.names = {i: str(i) for i in self.bytes}
        self.by_name = {n: self.bytes[i] for i, n in self.names.items()}

    def merge(self, word: str) -> list[int]:
        """The ids of one word: again and again the lowest-ranked neighbouring pair, leftmost first, becomes one."""
        return [self.special[word]] if word in self.special else self._merge_long([self.start[b] for b in word.encode()])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and new id of neighbours in one number; NEVER where they do not merge."""
        key = a << 20 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.packed[at], NEVER)

    def merge_together(self, flat: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(which word, its ids) for words of `size` bytes that follow each other in flat; in a step every word makes its next merge."""
        which, ids = np.arange(len(size)), self.start_ids[flat]
        first = np.cumsum(size) - size
        value = np.full(len(ids), NEVER)
        value[:-1] = self.ranks(ids[:-1], ids[1:])
        value[first + size - 1] = NEVER
        while len(which):
            best = np.minimum.reduceat(value, first)
            done = best == NEVER
            if done.any():
                for w, a, n in zip(which[done].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                    yield w, ids[a : a + n].tolist()
                stays = np.repeat(~done, size)
                which, size, best, ids, value = which[~done], size[~done], best[~done], ids[stays], value[stays]
                first = np.cumsum(size) - size
                if not len(which):
                    break
            hits = np.flatnonzero(value == np.repeat(best, size))
            owner = np.searchsorted(first, hits, "right") - 1
            at = hits[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each word
            ids[at] = best & 0xFFFFF
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, value = ids[kept], value[kept]
            at -= np.arange(len(at))  # each word before lost one
            size = size - 1
            first = np.cumsum(size) - size
            last = first + size - 1
            value[at] = NEVER
            own = at[at < last]
            value[own] = self.ranks(ids[own], ids[own + 1])
            own = at[at > first]
            value[own - 1] = self.ranks(ids[own - 1], ids[own])

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(f[0], k, ids[k], ids[k + 1], f[1]) for k in range(n - 1) if (f := get(ids[k] << 20 | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j >= 0 and (f := get(ids[i] << 20 | ids[j])):
                    heapq.heappush(heap, (f[0], i, ids[i], ids[j], f[1]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of the entries, as bytes that can be memory-mapped.

    Words are added in order; the part of the last word that the next one does not share is frozen from its end, and a frozen
    state that equals an earlier one gives way to it.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[list] = [[False, []]]  # final, [(byte, state)] with the last edge still open below
    last = b""
    for word in sorted(entries):
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            state = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], state))
    root = freeze(path[0])

    size: list[int] = []  # words below each state; children are always frozen first
    first, target, skip, labels = array.array("I"), array.array("I"), array.array("I"), bytearray()
    for final, edges in states:
        first.append(len(labels))
        before = int(final)
        for byte, state in edges:
            labels.append(byte)
            target.append(state)
            skip.append(before)
            before += size[state]
        size.append(before)
    first.append(len(labels))
    ends = bytearray(int(final) for final, _ in states)
    offsets, ids = array.array("I", [0]), array.array("I")
    for word in sorted(entries):
        ids.extend(entries[word])
        offsets.append(len(ids))
    parts = [first.tobytes(), target.tobytes(), skip.tobytes(), offsets.tobytes(), ids.tobytes(), bytes(labels), bytes(ends)]
    return struct.pack("<8I", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon, memory-mapped from a file without a name, which goes with the process."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *lengths = struct.unpack_from("<8I", self.map)
        view, at, parts = memoryview(self.map), 32, []
        for n in lengths:
            parts.append((at, view[at : at + n]))
            at += n
        first, self.target, self.skip, self.offsets, self.ids = (np.frombuffer(v, np.uint32) for _, v in parts[:5])
        labels, self.final = np.frombuffer(parts[5][1], np.uint8), np.frombuffer(parts[6][1], np.uint8)
        self.n_states = len(self.final)
        #: State and byte of each edge, in order: states are numbered, and a state's edges come by byte.
        self.edges = np.append(np.repeat(np.arange(self.n_states), np.diff(first)) << 8 | labels, NEVER)

    def rows(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The row of outputs of each of the words of `size` bytes that follow each other in flat, -1 for a word that is not held."""
        start, out = np.cumsum(size) - size, np.full(len(size), -1)
        state, row, on, k = np.full(len(size), self.root), np.zeros(len(size), np.int64), np.arange(len(size)), 0
        while len(on):
            at_end = size[on] == k
            ends, on = on[at_end], on[~at_end]
            out[ends] = np.where(self.final[state[ends]] == 1, row[ends], -1)
            key = state[on] << 8 | flat[start[on] + k]
            e = np.searchsorted(self.edges, key)
            there = self.edges[e] == key
            on, e, k = on[there], e[there], k + 1
            row[on] += self.skip[e]
            state[on] = self.target[e]
        return out

    def outputs(self, row: int) -> list[int]:
        return self.ids[self.offsets[row] : self.offsets[row + 1]].tolist()

    def get(self, word: bytes) -> list[int] | None:
        row = self.rows(np.frombuffer(word, np.uint8).astype(np.int64), np.array([len(word)]))[0]
        return self.outputs(row) if row >= 0 else None


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts; recent words stay in a table that is emptied when it holds `remembered` words."""

    def __init__(self, path: str, blob: bytes, remembered: int = 600_000):
        self.vocabulary, self.lexicon, self.remembered = vocabulary(path), Lexicon(blob), remembered
        self.seen: dict[str, str] = {}
        self.texts: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> None:
        """Adds new words to the table."""
        v, seen = self.vocabulary, self.seen
        raw, short = [], []
        for w in words:
            b = w.encode()
            if len(b) <= SHORT and w not in v.special:
                raw.append(b)
                short.append(w)
            else:
                seen[w] = ",".join(map(v.names.__getitem__, v.merge(w)))
        if not raw:
            return
        flat, size = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.array(list(map(len, raw)))
        rows = self.lexicon.rows(flat, size)
        for k in np.flatnonzero(rows >= 0).tolist():
            seen[short[k]] = ",".join(map(v.names.__getitem__, self.lexicon.outputs(rows[k])))
        new = np.flatnonzero(rows < 0)
        for k, ids in v.merge_together(flat[np.repeat(rows < 0, size)], size[new]) if len(new) else ():
            seen[short[new[k]]] = ",".join(map(v.names.__getitem__, ids))

    def encode(self, texts: list[str]) -> Iterator[list[str]]:
        """For each text a string of decimal ids joined by commas for each word."""
        if len(self.seen) > self.remembered:
            self.seen.clear()
        split = [split_words(t) for t in texts]
        self.learn(list(set().union(*split).difference(self.seen)))
        for words in split:
            yield list(map(self.seen.__getitem__, words))

    def decode(self, words: list[str]) -> str:
        if len(self.texts) > self.remembered:
            self.texts.clear()
        out = []
        get, token = self.texts.get, self.vocabulary.by_name.__getitem__
        for w in words:
            b = get(w)
            if b is None:
                b = self.texts[w] = b"".join(map(token, w.split(",")))
            out.append(b)
        return b"".join(out).decode("utf-8", "replace")


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of GROUP_CHARS characters or one text at least."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, key: str, blob) -> Encoder:
    """One encoder a worker process, for the lexicon that a broadcast holds."""
    if (path, key) not in _encoders:
        _encoders.clear()
        _encoders[path, key] = Encoder(path, blob.value)
    return _encoders[path, key]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in all texts. Words that a batch of documents has once are left out: the counts only choose what to compile."""

    def count(batches):
        for b in batches:
            c: Counter = Counter()
            for t in b.column("text"):
                c.update(split_words(t.as_py()))
            kept = [(w, n) for w, n in c.items() if n > 1 and len(w) <= 64]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, path: str, words: int = 50_000) -> bytes:
    """Compiles the `words` most frequent words or so, the fixed bound of what comes to the driver."""
    top = most_frequent(count_words(docs), words).select("word").collect()
    v = vocabulary(path)
    return compile_lexicon({r.word.encode(): v.merge(r.word) for r in top})


def encode_documents(df: DataFrame, path: str, words: int = 50_000, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids (array) and decoded."""
    spark, docs = df.sparkSession, documents(df)
    blob = frequent_lexicon(docs, path, words)
    key, shared = hashlib.sha256(blob).hexdigest(), spark.sparkContext.broadcast(blob)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(rows: dict) -> dict:
        e = encoder(path, key, shared)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for parts in (parts for group in groups(rows["text"]) for parts in e.encode(group)):
            ids, decoded = ",".join(parts), e.decode(parts)
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                out["ids"].append([int(i) for i in ids.split(",")] if ids else [])
                out["decoded"].append(decoded)
        return out | {"doc_id": rows["doc_id"]}

    return per_batch(docs, run, schema)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
