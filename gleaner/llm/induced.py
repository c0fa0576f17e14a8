"""Induced sorting of the suffixes of one shard, with common-prefix values carried along.

Suffixes are S-type if smaller than their right neighbour and L-type otherwise; an S-type suffix after an L-type one is a
seed. Seeds are sorted by a first induction (which sorts their substrings up to the next seed), naming, and a shorter string of
names; then all L-type suffixes follow in ascending order from the seeds, and all S-type ones in descending order from those.
Each induction is a scan of a priority queue whose key is the first symbol and then arrival; what it takes out in bulk, all
suffixes of a symbol that are there, puts their left neighbours in again. Two consecutive arrivals in a queue's bucket have one
symbol more in common than the least common prefix between the places they came from; so prefix values are carried
through without comparing text. Buckets beyond the memory limit go to an unlinked file and come back when they are scanned.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

FAR = np.int32(1 << 30)


class Queue:
    """Buckets of (position, common prefix with the arrival before it); the oldest parts go to disk once `limit` bytes are held."""

    def __init__(self, symbols: int, limit: int = 256 << 20):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.limit, self.file = 0, limit, None

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        part = np.stack([at, lcp])
        self.parts[symbol].append(part)
        self.held += part.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for bucket in self.parts:
            for k, part in enumerate(bucket):
                if isinstance(part, np.ndarray):
                    bucket[k] = (self.file.tell(), part.shape[1])
                    self.file.write(part.tobytes())
        self.held = 0

    def take(self, symbol: int) -> list[np.ndarray]:
        """All parts of a bucket in order of arrival; the bucket is empty then."""
        out = []
        for part in self.parts[symbol]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), np.int32).reshape(2, -1)
            else:
                self.held -= part.nbytes
            out.append(part)
        self.parts[symbol] = []
        return out


class Shard:
    """A text of uint16 symbols below `symbols` with what both inductions need to know of it."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text, self.symbols, n = text, symbols, len(text)
        change = np.flatnonzero(text[1:] != text[:-1])
        ends = np.append(change, n - 1)  # last position of each run of one symbol
        starts = np.append(0, change + 1)
        rising = np.append(text[ends[:-1] + 1] > text[ends[:-1]], False)  # the last run counts as falling: the end is least
        lengths = ends - starts + 1
        self.s_type = np.repeat(rising, lengths)
        self.run = (np.repeat(ends, lengths) - np.arange(n) + 1).astype(np.int32)
        self.seeds = starts[1:][rising[1:] & ~rising[:-1]].astype(np.int32)  # starts of rising runs after falling ones


class Arrivals:
    """Turns scanned suffixes into arrivals at buckets; with prefix values if asked for."""

    def __init__(self, shard: Shard, queue: Queue, s_pass: bool, with_lcp: bool):
        self.shard, self.queue, self.s_pass, self.with_lcp = shard, queue, s_pass, with_lcp
        self.least = np.full(shard.symbols, -1, np.int64)  # least prefix scanned since the last arrival; -1: no arrival yet

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Takes suffixes in scan order; lcp[k] is what suffix k has in common with the one scanned before it."""
        if not len(at):
            return
        text, before = self.shard.text, at - 1
        ok = before >= 0
        ok[ok] = self.shard.s_type[before[ok]] == self.s_pass
        came = np.flatnonzero(ok)
        symbol = text[before[came]]
        order = np.argsort(symbol, kind="stable")
        came, symbol = came[order], symbol[order]
        cuts = np.append(np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])), len(came)) if len(came) else np.zeros(1, int)
        if self.with_lcp:
            padded = np.append(lcp, FAR)
            total = lcp.min()
            there = self.least >= 0
            fresh = self.least.copy()
            fresh[there] = np.minimum(fresh[there], total)
        for k in range(len(cuts) - 1):
            c, idx = int(symbol[cuts[k]]), came[cuts[k] : cuts[k + 1]]
            if self.with_lcp:
                mins = np.minimum.reduceat(padded, idx + 1)
                common = np.empty(len(idx), np.int32)
                common[1:] = mins[:-1] + 1
                common[0] = 1 + min(int(self.least[c]), int(lcp[: idx[0] + 1].min())) if self.least[c] >= 0 else 0
                fresh[c] = mins[-1]
            else:
                common = np.zeros(len(idx), np.int32)
            self.queue.put(c, before[idx], common)
        if self.with_lcp:
            self.least = fresh


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int32)
    return both[0], both[1]


def _lead(shard: Shard, last: int, at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """lcp with its first value set for a step between the L-part and the S-part of a bucket: there the common part is the shorter run."""
    lcp = lcp.copy()
    if len(lcp):
        lcp[0] = min(shard.run[last], shard.run[at[0]]) if last >= 0 else 0
    return lcp


def induce(shard: Shard, seeds: np.ndarray, seed_lcp: np.ndarray, with_lcp: bool, limit: int = 256 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From sorted seeds, per symbol from the last to the first: symbol, L-part and its prefix values (ascending), S-part and its values (descending).

    A value belongs to a suffix and the one before it in the part; the first value of a part is 0.
    """
    text, n = shard.text, len(shard.text)
    queue, store = Queue(shard.symbols, limit), Queue(shard.symbols, limit)
    up = Arrivals(shard, queue, False, with_lcp)
    up.scan(np.array([n], np.int32), np.zeros(1, np.int32))  # the empty suffix is least
    first = text[seeds]
    bounds = np.searchsorted(first, np.arange(shard.symbols + 1))
    for c in range(shard.symbols):
        last = -1
        while parts := queue.take(c):
            at, lcp = joined(parts)
            store.put(c, at, lcp)
            up.scan(at, lcp)
            last = int(at[-1])
        own = slice(bounds[c], bounds[c + 1])
        if own.stop > own.start:
            at = seeds[own]
            up.scan(at, _lead(shard, last, at, seed_lcp[own]))
    down = Arrivals(shard, queue, True, with_lcp)
    for c in range(shard.symbols - 1, -1, -1):
        s_parts, last = [], -1
        while parts := queue.take(c):
            at, lcp = joined(parts)
            down.scan(at, lcp)
            s_parts.append(np.stack([at, lcp]))
            last = int(at[-1])
        l_at, l_lcp = joined(store.take(c))
        if len(l_at):
            back = l_at[::-1]
            down.scan(back, _lead(shard, last, back, np.append(np.int32(0), l_lcp[:0:-1])))
        yield c, l_at, l_lcp, *joined(s_parts)


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether text[a : a + length] equals text[b : b + length], for arrays of pairs."""
    out = np.ones(len(a), bool)
    live, step = np.arange(len(a)), 0
    while len(live):
        live = live[length[live] > step]
        same = text[a[live] + step] == text[b[live] + step]
        out[live[~same]] = False
        live, step = live[same], step + 1
    return out


def common_part(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols text has in common at a and at b, up to most."""
    n, out = len(text), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for step in range(most):
        live = live[np.maximum(a[live], b[live]) + step < n]
        live = live[text[a[live] + step] == text[b[live] + step]]
        if not len(live):
            break
        out[live] += 1
    return out


def first_places(new: np.ndarray) -> np.ndarray:
    """At each place the last one up to it that is new; the first one is."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def shared_places(ranks: np.ndarray) -> np.ndarray:
    """Places of sorted ranks that a neighbour has, too."""
    same = np.concatenate([[False], ranks[1:] == ranks[:-1], [False]])
    return np.flatnonzero(same[1:] | same[:-1])


def sorted_seeds(shard: Shard, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in order of their suffixes, exact for the first `depth` symbols, and their common prefixes, exact up to depth."""
    text, seeds, n = shard.text, shard.seeds, len(shard.text)
    if not len(seeds):
        return seeds, np.zeros(0, np.int32)
    index = np.full(n + 1, -1, np.int32)
    index[seeds] = np.arange(len(seeds))
    start = seeds[np.argsort(text[seeds], kind="stable")]
    order = []
    for _, _, _, at, _ in induce(shard, start, np.zeros(len(start), np.int32), False, limit):
        order.append(index[at[index[at] >= 0]])
    order = np.concatenate(order)[::-1]
    # names: seeds whose substrings up to and with the next seed are equal get one name
    length = np.append(seeds[1:] - seeds[:-1] + 1, n - seeds[-1]).astype(np.int64)
    a, b = order[:-1], order[1:]
    whole = np.append(np.ones(len(seeds) - 1, bool), False)  # the last one ends with the text and equals no other
    equal = (length[a] == length[b]) & whole[a] & whole[b]
    at = np.flatnonzero(equal)
    equal[at] = same_bytes(text, seeds[a[at]], seeds[b[at]], length[a[at]])
    rank = np.empty(len(seeds), np.int32)
    rank[order] = first_places(np.append(True, ~equal))
    # the string of names: ranks of 1, 2, 4 ... names, until all differ or cover depth; a seed whose rank no other has, or whose names cover depth, keeps its place
    ranks, h = [rank], 1
    shared = shared_places(rank[order])
    while True:
        own = order[shared]
        shared = shared[seeds[np.minimum(own + h, len(seeds) - 1)] - seeds[own] < depth]
        if not len(shared):
            break
        own = order[shared]
        key = rank[own] * np.int64(len(seeds) + 1)
        inside = own + h < len(seeds)
        key[inside] += rank[own[inside] + h] + 1
        by_key = np.argsort(key)
        own, key = own[by_key], key[by_key]  # those of one rank stay together, so each has a place of the same ones
        order[shared] = own
        rank = rank.copy()
        rank[own] = shared[first_places(np.append(True, key[1:] != key[:-1]))]
        shared, h = shared[shared_places(rank[own])], h * 2
        ranks.append(rank)
    # common prefixes: as many equal names as the ranks tell, then symbols within the first name that differs
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        ok = np.maximum(a, b) < len(seeds)
        ok[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        a[ok] += 1 << k
        b[ok] += 1 << k
    inside = np.maximum(a, b) < len(seeds)
    lcp = np.full(len(order), 0, np.int64)
    known = seeds[np.minimum(a, len(seeds) - 1)] - seeds[order[:-1]]
    lcp[1:][inside] = known[inside] + common_part(text, seeds[a[inside]], seeds[b[inside]], depth)
    lcp[1:][~inside] = common_part(text, seeds[order[:-1]][~inside], seeds[order[1:]][~inside], depth)
    return seeds[order], np.minimum(lcp, FAR).astype(np.int32)


def repeated_starts(text: np.ndarray, depth: int, symbols: int = 257, limit: int = 256 << 20) -> np.ndarray:
    """For each position whether the `depth` symbols from it on also start elsewhere."""
    out = np.zeros(len(text), bool)
    if not len(text):
        return out
    shard = Shard(text, symbols)
    seeds, lcp = sorted_seeds(shard, depth, limit)
    for _, l_at, l_lcp, s_at, s_lcp in induce(shard, seeds, lcp, True, limit):
        for at, common in ((l_at, l_lcp), (s_at, s_lcp)):
            hit = np.flatnonzero(common >= depth)
            out[at[hit]] = True
            out[at[hit - 1]] = True
        if len(l_at) and len(s_at) and min(shard.run[l_at[-1]], shard.run[s_at[-1]]) >= depth:
            out[l_at[-1]] = out[s_at[-1]] = True
    return out
