"""An Aho-Corasick automaton that finds the longest piece starting at each place, for many places at once."""

from __future__ import annotations

import numpy as np

#: Bits of a character in an edge's key; characters of a window besides its overlap.
CHAR_BITS, WINDOW = 21, 112


class LongestMatches:
    """The automaton of the reversed pieces. A text is read backwards, so the longest piece that ends at a place of the reading starts there in the text.

    The text is cut into windows that overlap by the longest piece, and one step reads one character of every window.
    """

    def __init__(self, pieces: dict[str, int]):
        below: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, value in pieces.items():
            state = 0
            for c in map(ord, reversed(piece)):
                to = below[state].get(c)
                if to is None:
                    to = below[state][c] = len(below)
                    below.append({})
                    ends.append(-1)
                state = to
            ends[state] = value
        fail, queue = [0] * len(below), list(below[0].values())
        for state in queue:  # grows as it is read: nearest to the root first
            if ends[state] < 0:
                ends[state] = ends[fail[state]]
            for c, to in below[state].items():
                back = fail[state]
                while back and c not in below[back]:
                    back = fail[back]
                fail[to] = below[back].get(c, 0)
                queue.append(to)
        edges = sorted((s << CHAR_BITS | c, to) for s, row in enumerate(below) for c, to in row.items())
        self.keys = np.array([*(k for k, _ in edges), np.iinfo(np.int64).max])
        self.targets = np.array([*(t for _, t in edges), 0])
        self.fail, self.ends = np.array(fail), np.array(ends)
        self.overlap = max(map(len, pieces), default=1)

    def advance(self, state: np.ndarray, chars: np.ndarray) -> np.ndarray:
        out, on, state = np.zeros(len(state), np.int64), np.arange(len(state)), state.copy()
        while len(on):
            key = state << CHAR_BITS | chars
            e = np.searchsorted(self.keys, key)
            there = self.keys[e] == key
            out[on[there]] = self.targets[e[there]]
            rest = ~there & (state > 0)
            on, chars, state = on[rest], chars[rest], self.fail[state[rest]]
        return out

    def starting_at(self, chars: np.ndarray) -> np.ndarray:
        """For each place the value of the longest piece that starts there, -1 if none does."""
        n = len(chars)
        windows = -(-n // WINDOW)
        padded = np.full(windows * WINDOW + self.overlap, (1 << CHAR_BITS) - 1)
        padded[:n] = chars
        first, state = np.arange(windows) * WINDOW, np.zeros(windows, np.int64)
        out = np.empty((WINDOW, windows), np.int64)
        for k in range(WINDOW + self.overlap - 1, -1, -1):
            state = self.advance(state, padded[first + k])
            if k < WINDOW:
                out[k] = self.ends[state]
        return out.T.ravel()[:n]
