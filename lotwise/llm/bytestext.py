"""Vectorised text kernels over Arrow string buffers: words, their hashes, and rolling hashes of byte windows.

A whole batch of texts is one byte buffer with offsets; nothing here loops over rows or bytes in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: An odd base and its inverse modulo 2**64, for prefix sums of polynomial hashes.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: How many text bytes are worked on at once; the arrays of a step take some 40 times that.
STEP_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers.get("up", ())) < n:
        m = max(n, STEP_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(m, base, dtype=U64)
            x[0] = 1
            np.cumprod(x, out=x)
            _powers[name] = x
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets, from zero; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(batches: Iterable[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows into pieces of about ``most`` text bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased, of every row of a column.

    start, end: byte positions in ``low``; row: the row of each word; first: the index of each row's first word, with
    one more entry for the end.
    """

    def __init__(self, column: pa.Array):
        raw, offs = buffers(column)
        self.offsets, self.low = offs, LOWER[raw]
        solid = ~SPACE[raw]
        n = len(raw)
        edge = offs[:-1][np.diff(offs) > 0]
        before = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            before[edge] = False
        after = np.empty(n, bool)
        if n:
            after[-1], after[:-1] = False, solid[1:]
            after[edge[1:] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self._solid, self._before = solid, before

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return segment_hashes(self.low, self.start, self.end)

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes in which the words of a row follow each other by one 0x20; the words' starts and ends there."""
        if not len(self.low):
            return b"", self.start, self.end
        keep = self._solid | self._before
        at = np.cumsum(keep) - 1
        out = np.where(self._solid, self.low, np.uint8(0x20))[keep]
        return out.tobytes(), at[self.start], at[self.end - 1] + 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    x = data.astype(U64)
    x += U64(1)
    x *= up[:-1]
    np.cumsum(x, out=sums[1:])
    return sums


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair."""
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    return mixed((sums[end] - sums[start]) * down[start])


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each data[i:i+width]."""
    if len(data) < width:
        return np.zeros(0, U64)
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    h = sums[width:] - sums[:-width]
    h *= down[: len(h)]
    return mixed(h)


def sliding(x: np.ndarray, width: int, how: np.ufunc, pad) -> np.ndarray:
    """how.reduce(x[i:i+width]) for each i up to len(x) - width, in three passes whatever the width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    y = np.full(rows * width, pad, dtype=x.dtype)
    y[: len(x)] = x
    y = y.reshape(rows, width)
    ahead = how.accumulate(y, axis=1).ravel()
    back = how.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return how(back[:n], ahead[width - 1 : width - 1 + n])
