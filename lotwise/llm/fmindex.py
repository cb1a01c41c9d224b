"""A bidirectional FM-index over delimited words, searched for many patterns at once with numpy.

The text is ``$w1$w2$...$``. A pattern's occurrences are an interval of suffix ranks in the text and one in its mirror,
of one size; a symbol added on the left narrows the first by counting it in the Burrows-Wheeler column, and moves the
second by how many smaller symbols stand in the interval, on the right the other way round. A wavelet matrix gives both
counts in one descent, and all symbols that occur in an interval by descending into both halves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

END, DELIMITER, FIRST = 0, 1, 2


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; what is beyond the end is less than any symbol."""
    rank, n, width = text.astype(np.int64) + 1, len(text), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - width, 0)] = rank[width:]
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:
            return order
        width *= 2


class Wavelet:
    """Counts of symbols, and of smaller ones, in any range of a sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, self.zeros = [], []
        now = sequence.astype(np.int32)
        depth = max(1, int(symbols - 1).bit_length())
        self.shifts = range(depth - 1, -1, -1)
        for s in self.shifts:
            bit = (now >> s) & 1
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.levels.append(before)
            self.zeros.append(int(before[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        counts = np.bincount(sequence, minlength=symbols)[:symbols]
        every = np.arange(symbols)
        self.first = np.zeros(symbols, np.int64)  # where a symbol's run begins on the last level
        self.first = self.narrowed(every, np.zeros(symbols, np.int64), np.zeros(symbols, np.int64), raw=True)[0]
        self.smaller = np.concatenate([[0], np.cumsum(counts)])[:-1]

    def narrowed(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, raw: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(new lo, size, how many smaller symbols) of each range narrowed to its symbol."""
        less = np.zeros(len(lo), np.int64)
        for before, zeros, s in zip(self.levels, self.zeros, self.shifts):
            one = ((c >> s) & 1).astype(bool)
            a, b = before[lo].astype(np.int64), before[hi].astype(np.int64)
            less += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return (lo, hi - lo, less) if raw else (self.smaller[c] + lo - self.first[c], hi - lo, less)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(range, symbol, new lo, size, how many smaller symbols) of every symbol that occurs in each range."""
        row, code, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for before, zeros in zip(self.levels, self.zeros):
            a, b = before[lo].astype(np.int64), before[hi].astype(np.int64)
            zero, one = b > a, hi - lo > b - a
            row, code, less, lo, hi = (
                np.concatenate([row[zero], row[one]]), np.concatenate([code[zero] * 2, code[one] * 2 + 1]), np.concatenate([less[zero], less[one] + (b - a)[one]]),
                np.concatenate([a[zero], (zeros + lo - a)[one]]), np.concatenate([b[zero], (zeros + hi - b)[one]]),
            )
        return row, code, self.smaller[code] + lo - self.first[code], hi - lo, less


class Index:
    """Of distinct words without the delimiter; ``encoded`` turns patterns into the index's symbols."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        letters = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(letters)
        length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.start = np.concatenate([[0], np.cumsum(length + 1)])  # where each word's delimiter is
        text = np.full(int(self.start[-1]) + 2, DELIMITER, np.int64)
        place = np.ones(len(text), bool)
        place[self.start] = False
        place[-1] = False
        text[place] = np.searchsorted(self.alphabet, letters) + FIRST
        text[-1] = END
        symbols = len(self.alphabet) + FIRST
        self.suffixes = suffix_ranks(text)
        self.left = Wavelet(text[self.suffixes - 1], symbols)
        mirror = np.concatenate([text[-2::-1], [END]])
        self.right = Wavelet(mirror[suffix_ranks(mirror) - 1], symbols)
        self.size = len(text)

    def encoded(self, patterns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all patterns one after the other, where each begins, and the end); END stands for letters that no word has."""
        letters = np.frombuffer("".join(patterns).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, letters), max(len(self.alphabet) - 1, 0))
        known = self.alphabet[at] == letters if len(self.alphabet) else np.zeros(len(letters), bool)
        return np.where(known, at + FIRST, END), np.concatenate([[0], np.cumsum([len(p) for p in patterns], dtype=np.int64)])

    def extended(self, leftwards: bool, c: np.ndarray, lo: np.ndarray, mirrored: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (lo, lo in the mirror, size) with one symbol more at an end; END gives empty ones."""
        if leftwards:
            a, n, less = self.left.narrowed(c, lo, lo + size)
            out = a, mirrored + less, n
        else:
            a, n, less = self.right.narrowed(c, mirrored, mirrored + size)
            out = lo + less, a, n
        return out[0], out[1], np.where(c == END, 0, out[2])


def one_error(index: Index, patterns: Sequence[str], cut: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word) numbers of the words that begin with the first ``cut`` letters of a pattern and are one insertion, deletion or replacement behind them away from it.

    The first part is matched from its end leftwards up to the delimiter, then extended to the right: at each place
    the exact part branches into the letters that occur there, and each branch goes on without another error. Of equal
    words made at several places of a run of one letter, the last place makes it, so no pair comes twice.
    """
    flat, begin = index.encoded(patterns)
    length, cut = np.diff(begin), np.asarray(cut, np.int64)
    q = np.arange(len(patterns))
    lo, mirrored, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.size, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def narrowed(state, leftwards: bool, c):
        out = (state[0], *index.extended(leftwards, c, *state[1:]))
        keep = out[3] > 0
        return tuple(x[keep] for x in out), keep

    state, at = (q, lo, mirrored, size), cut.copy()
    done = []
    while len(state[0]):
        ready = at[state[0]] == 0
        done.append(tuple(x[ready] for x in state))
        state = tuple(x[~ready] for x in state)
        at[state[0]] -= 1
        state, _ = narrowed(state, True, flat[begin[state[0]] + at[state[0]]])
    state = tuple(np.concatenate(x) for x in zip(*done)) if done else state
    state, _ = narrowed(state, True, np.full(len(state[0]), DELIMITER))

    def finished(state, pos) -> None:
        """Branches that have had their error: the rest without another, then the delimiter."""
        while len(state[0]):
            over = pos == length[state[0]]
            if over.any():
                ended, _ = narrowed(tuple(x[over] for x in state), False, np.full(int(over.sum()), DELIMITER))
                found.append((ended[0], np.searchsorted(index.start, index.suffixes[ended[1]])))
                state, pos = tuple(x[~over] for x in state), pos[~over]
            if len(state[0]):
                state, keep = narrowed(state, False, flat[begin[state[0]] + pos])
                pos = pos[keep] + 1

    at = cut.copy()
    while len(state[0]):
        q, lo, mirrored, size = state
        pos, over = at[q], at[q] == length[q]
        own = np.where(over, -1, flat[np.minimum(begin[q] + pos, len(flat) - 1)])
        row, c, new, n, less = index.right.children(mirrored, mirrored + size)
        keep = (c >= FIRST) & (c != own[row])
        row, branch = row[keep], (q[row][keep], lo[row][keep] + less[keep], new[keep], n[keep])
        finished(branch, pos[row])  # an inserted letter
        inside = ~over[row]
        finished(tuple(x[inside] for x in branch), pos[row][inside] + 1)  # a replaced one
        following = np.where(pos + 1 < length[q], flat[np.minimum(begin[q] + pos + 1, len(flat) - 1)], -1)
        # Letters that no word has are all END: each may be the one that is left out.
        gone = ~over & ((own != following) | (own == END))
        finished(tuple(x[gone] for x in state), pos[gone] + 1)  # a deleted one
        state = tuple(x[~over] for x in state)
        at[state[0]] += 1
        state, _ = narrowed(state, False, own[~over])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))
