"""SentencePiece merge-type encoding by backtracking, and decoding.

The merge rule (again and again the neighbours whose joined piece scores highest become one, leftmost first) has one result for
each text, and a sequence of pieces is that result exactly if each piece alone comes out as itself and no merge would cross the
border of any two neighbours. So a text is encoded from left to right: an Aho-Corasick automaton of the reversed pieces, run over
the reversed text, gives the longest piece that starts at each place; it is taken if it is compatible with the piece before,
else the next shorter one is tried; a place where none fits is marked in a bitfield as failed for good, since there is only one
way to reach any place, and the last piece is taken back. Two pieces are compatible if merging them anew, by their own recorded
merges, never joins pieces across their border; pairs that were compared are remembered.

No piece of the model has a space after another character (this is checked; otherwise a text is one word), so merges never
cross the start of a run of spaces and a text is encoded by words. The new words of a group of texts go together, each in its
own step of its own search; longer ones go one by one. Recent words are remembered in a table of bounded size. Characters that
no piece has are their UTF-8 bytes.

Null texts count as empty; an empty text has the end id alone. Repeated rows and ids stay as they are. Extra columns are
ignored. A word of any length takes time and memory in proportion to it.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.automaton import LongestMatches
from gleaner.llm.bpe import groups
from gleaner.llm.common import documents, per_batch

SPACE = "▁"
#: Words of more characters go one by one and are not remembered (failed places of others are bits of one number); no more words than these are.
LONGEST, WORDS = 62, 500_000
#: Pairs are remembered in so many places (a power of two), each holding the last that fell there.
PLACES = 1 << 20
#: A character that stands between words, and one's id where no piece is that character: BARE and its number.
BETWEEN, BARE = (1 << 20) + (1 << 16) - 1, 1 << 20
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2


class Pieces:
    """A merge-type model: pieces with scores, their automaton, and what was learned about pairs of them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != MERGE_TYPE or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: not a merge-type model with byte fallback and texts as they are")
        self.prefix, self.names = SPACE * norm.add_dummy_prefix, [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.end = next((k for k, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == train.eos_piece), None)
        self.byte_of = {k: int(p.piece[3:5], 16) for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = {b: k for k, b in self.byte_of.items()}
        self.unknown = train.unk_surface
        whole = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.split = (lambda t: [t] if t else []) if whole else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.automaton = LongestMatches(self.ids)
        self.records: dict[str, tuple | None] = {}
        self.shorter = np.full(len(self.names), -1)
        self.sizes = np.array([len(n) for n in self.names])
        for p, k in self.ids.items():
            if len(p) > 1:
                self.shorter[k] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), BARE + ord(p[0]))
        self.pair_keys, self.pair_fits = np.full(PLACES, -1), np.zeros(PLACES, bool)
        self.known: dict[int, tuple[str, str]] = {}

    def record(self, piece: str) -> tuple[list, list] | None:
        """How a piece comes about from its characters: (score, leftmost part) and (score, rightmost part) after each merge. None if its characters become something else."""
        if piece in self.records:
            return self.records[piece]
        parts, left, right = list(piece), [], []
        while len(parts) > 1:
            score, at = max(((self.scores.get(parts[k] + parts[k + 1], float("-inf")), -k) for k in range(len(parts) - 1)), default=(float("-inf"), 0))
            if score == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            left.append((score, parts[0]))
            right.append((score, parts[-1]))
        self.records[piece] = found = (left, right) if len(parts) == 1 else None
        return found

    def piece(self, unit: int) -> str:
        return "" if unit < 0 else self.names[unit] if unit < BARE else chr(unit - BARE)

    def fits(self, last: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Whether units can follow those before them (-1: none); remembered by pair."""
        key = (last + 1) << 22 | unit
        place = (key ^ key >> 23) * 0x9E3779B1 >> 24 & (PLACES - 1)
        out, new = self.pair_fits[place], self.pair_keys[place] != key
        if new.any():
            which = np.flatnonzero(new)
            own, first, where = np.unique(key[which], return_index=True, return_inverse=True)
            found = np.array([self.compatible(self.piece((k >> 22) - 1), self.piece(k & 0x3FFFFF)) for k in own.tolist()])
            out[which] = found[where]
            _, one = np.unique(place[which][first], return_index=True)  # of new pairs that fall on one place one is remembered
            self.pair_keys[place[which][first][one]], self.pair_fits[place[which][first][one]] = own[one], found[one]
        return out

    def compatible(self, a: str, b: str) -> bool:
        """Whether the characters of a and b together come out as a and b; with an empty a, whether those of b come out as b."""
        return self.record(b) is not None and (not a or self._stays_apart(a, b))

    def _stays_apart(self, a: str, b: str) -> bool:
        own_a, own_b = self.record(a)[1], self.record(b)[0]
        i, j, edge_a, edge_b, never = 0, 0, a[-1], b[0], float("-inf")
        while True:
            next_a = own_a[i][0] if i < len(own_a) else never
            next_b = own_b[j][0] if j < len(own_b) else never
            across = self.scores.get(edge_a + edge_b, never)
            if across > next_a and across >= next_b:  # of equal scores the leftmost goes first: within a, across, within b
                return False
            if next_a == never and next_b == never:
                return True
            if next_a >= next_b:
                edge_a, i = own_a[i][1], i + 1
            else:
                edge_b, j = own_b[j][1], j + 1

    def encode_long(self, word: str) -> list[int]:
        """The units of one word of any length: ids of pieces, and BARE characters."""
        chars = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        longest = self.automaton.starting_at(chars)
        longest = np.where(longest < 0, BARE + chars, longest).tolist()
        failed, out, at, last, n = bytearray(len(word) // 8 + 1), [], 0, -1, len(word)
        seen: dict[tuple[int, int], bool] = {}
        unit = longest[0]
        while at < n:
            while unit >= 0:
                end = at + (int(self.sizes[unit]) if unit < BARE else 1)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = seen.get((last, unit))
                    if fits is None:
                        if len(seen) >= PLACES:
                            seen.clear()
                        fits = seen[last, unit] = self.compatible(self.piece(last), self.piece(unit))
                    if fits:
                        break
                unit = int(self.shorter[unit]) if unit < BARE else -1
            if unit >= 0:
                out.append(unit)
                at, last = end, unit
                unit = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                out.pop()
                at -= len(self.piece(last))
                unit, last = int(self.shorter[last]) if last < BARE else -1, out[-1] if out else -1
        return out

    def encode_together(self, words: list[str]) -> Iterator[list[int]]:
        """The units of each of many words of LONGEST characters at most."""
        if not words:
            return iter(())
        size = np.array(list(map(len, words)))
        chars = np.frombuffer((chr(BETWEEN).join(words) + chr(BETWEEN)).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(size + 1) - size - 1
        longest = self.automaton.starting_at(chars)
        longest = np.where(longest < 0, BARE + chars, longest)
        taken, back = np.full(len(chars), -1), np.zeros(len(chars), np.int64)  # the unit that starts at a place; where the one that ends there starts
        failed = np.zeros(len(words), np.int64)
        on, at, last, unit = np.arange(len(words)), start.copy(), np.full(len(words), -1), longest[start]
        while len(on):
            bare = unit >= BARE
            known = np.where(bare | (unit < 0), 0, unit)
            end = at + np.where(bare, 1, self.sizes[known])
            good = (unit >= 0) & (failed[on] >> np.maximum(end - start[on], 0) & 1 == 0)
            ask = np.flatnonzero(good)
            good[ask] = self.fits(last[ask], unit[ask])
            out = unit < 0
            # taken back: the place failed, and the unit before it gives way to its next shorter one
            who, place = on[out], at[out]
            failed[who] |= 1 << (place - start[who])
            before = back[place]
            # not taken: the next shorter one
            less = np.where(bare | out, -1, self.shorter[known])
            had = taken[before]
            less[out] = np.where(had >= BARE, -1, self.shorter[np.where(had >= BARE, 0, had)])
            taken[before] = -1
            # taken: the longest that starts at its end
            taken[at[good]] = unit[good]
            back[end[good]] = at[good]
            at = np.where(good, end, at)
            at[out] = before
            last = np.where(good, unit, last)
            last[out] = np.where(before > start[who], taken[back[before]], -1)
            unit = np.where(good, longest[at], less)
            more = at < start[on] + size[on]
            on, at, last, unit = on[more], at[more], last[more], unit[more]
        where = np.flatnonzero(taken >= 0)
        units, first = taken[where].tolist(), np.searchsorted(where, start).tolist()
        first.append(len(units))
        return (units[a:b] for a, b in zip(first[:-1], first[1:], strict=True))

    def ids_of(self, unit: int) -> list[int]:
        return [unit] if unit < BARE else [self.byte_ids[b] for b in chr(unit - BARE).encode()]

    def look_up(self, units: list[int]) -> tuple[str, str]:
        """The decimal ids of units, joined by spaces, and the text of these ids."""
        known, found = self.known, []
        for u in units:
            own = known.get(u)
            if own is None:
                ids = self.ids_of(u)
                own = " ".join(map(str, ids)), self.text_of(ids)
                if len(known) < WORDS:
                    known[u] = own
            found.append(own)
        return " ".join([f[0] for f in found]), "".join([f[1] for f in found])

    def words(self, text: str) -> list[str]:
        return self.split(self.prefix + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str, end: bool = True) -> list[int]:
        words = self.words(text)
        short = [w for w in words if len(w) <= LONGEST]
        together = self.encode_together(short)
        units = (u for w in words for u in (next(together) if len(w) <= LONGEST else self.encode_long(w)))
        return [i for u in units for i in self.ids_of(u)] + [self.end] * end

    def text_of(self, ids: list[int]) -> str:
        """Ids as text: runs of bytes as UTF-8, control ids as nothing."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
            if self.kind[i] != CONTROL:
                out.append(self.unknown if self.kind[i] == UNKNOWN else self.names[i].replace(SPACE, " "))
        return "".join(out) + utf8(bytes(run))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts before a text."""
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        text = self.text_of(ids)
        return text[1:] if self.prefix and first is not None and self.kind[first] == NORMAL and self.names[first].startswith(SPACE) else text


def utf8(raw: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes a replacement character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """One model a worker process."""
    return Pieces(path)


class Coder:
    """Encodes and decodes texts by words, with a table of recent words."""

    def __init__(self, path: str):
        self.model = pieces(path)
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def code(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its decimal ids joined by spaces, the end id last, and the text decoded from them."""
        m, ids, decoded = self.model, self.ids, self.texts
        if len(ids) > WORDS:
            ids.clear()
            decoded.clear()
        split = list(map(m.words, texts))
        new = set().union(*split).difference(ids)
        short, long = [w for w in new if len(w) <= LONGEST], [w for w in new if len(w) > LONGEST]
        for w, units in chain(zip(short, m.encode_together(short), strict=True), ((w, m.encode_long(w)) for w in long)):
            ids[w], decoded[w] = m.look_up(units)
        for words in split:
            text = "".join(map(decoded.__getitem__, words))
            yield " ".join([*map(ids.__getitem__, words), str(m.end)]), text[1:] if m.prefix and text.startswith(" ") else text
        for w in long:
            del ids[w], decoded[w]


@functools.lru_cache(1)
def coder(path: str) -> Coder:
    return Coder(path)


def encode_documents(df: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes every text, with the end id, and decodes it: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids (array) and decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(rows: dict) -> dict:
        c = coder(path)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for ids, decoded in (x for group in groups(rows["text"]) for x in c.code(group)):
            out["n_tokens"].append(ids.count(" ") + 1)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                out["ids"].append([int(i) for i in ids.split(" ")])
                out["decoded"].append(decoded)
        return out | {"doc_id": rows["doc_id"]}

    return per_batch(documents(df), run, schema)


def op13_sentencepiece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
