"""Token ids in packed rows: best-fit-decreasing with a segment tree over free capacities; nothing is cut off."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bytestext import buffers, segment_hashes, steps

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
#: Tokens that are packed together; a longer text is packed with what came before it.
BLOCK_TOKENS = 4_000_000
#: Pieces of text that a task remembers the ids of.
REMEMBERED = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: How the public byte-level vocabularies split text before they merge: a fixed value of theirs.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def follows_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space, or what may be its last byte, is before each place; so it is for the first three places.

    Characters of more than one byte that are white space end in C2 85, C2 A0, E1 9A .., E2 80 .., E2 81 .. or E3 80 ..
    """
    out = np.ones(len(at), bool)
    some = np.flatnonzero(at >= 3)
    one, two, three = (data[at[some] - k] for k in (1, 2, 3))
    white = (one < 0x21) | (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    out[some] = white | (three >= 0xE1) & (three <= 0xE3) & (two <= 0x9A) & (one >= 0x80)
    return out


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places where the text can be cut with no change to its ids: row starts, and spaces after other than white space.

    The pattern lets a space begin a token or be among white space only, so a space after anything else begins one.
    What follows a byte that may end white space is left uncut.
    """
    space = np.flatnonzero(data == 0x20)
    space = space[~follows_white(data, space)]
    cut = np.zeros(len(data) + 1, bool)
    cut[space] = True
    cut[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(cut[: len(data)])


def alike(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of one of each kind of piece, each piece's kind): pieces of one kind have the same bytes.

    They are met by hash and compared byte by byte; one that only shares a hash is a kind of its own.
    """
    _, first, at = np.unique(segment_hashes(data, start, end), return_index=True, return_inverse=True)
    size = end - start
    model = first[at]
    same = size == size[model]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))  # eight bytes from each place
    left = np.flatnonzero(same & (start != start[model]))
    for i in left[size[left] > 64].tolist():
        same[i] = padded[start[i] : end[i]].tobytes() == padded[start[model[i]] : end[model[i]]].tobytes()
    left = left[size[left] <= 64]
    a, b, n = start[left], start[model[left]], size[left]
    while len(left):
        mask = np.uint64(2**64 - 1) >> (8 * np.maximum(8 - n, 0)).astype(np.uint64)
        differ = (words[a] ^ words[b]) & mask != 0
        same[left[differ]] = False
        more = ~differ & (n > 8)
        left, a, b, n = left[more], a[more] + 8, b[more] + 8, n[more] - 8
    if not same.all():
        other = np.flatnonzero(~same)
        at[other] = len(first) + np.arange(len(other))
        first = np.concatenate([first, other])
    return first, at


class Ids:
    """Token ids of many texts at once: each distinct piece of a batch is encoded once, or taken from what is remembered.

    New pieces are encoded as one text, and told apart by the bytes that their tokens stand for.
    """

    def __init__(self, path: str, pattern: str, most: int = REMEMBERED):
        encoding = _encoding(path, pattern)
        self.encode, self.most = encoding.encode_ordinary, most
        self.width = np.zeros(encoding.n_vocab, np.int64)
        for token, i in encoding._mergeable_ranks.items():
            self.width[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}

    def _one(self, piece: bytes) -> bytes:
        return np.array(self.encode(piece.decode("utf-8", "replace")), dtype="<i4").tobytes()

    def _joined(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that may follow each other: each begins with a space, and none ends in white space."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            try:
                ids = np.array(self.encode(b"".join(some).decode()), dtype="<i4")
            except UnicodeDecodeError:  # what stands for bytes that aren't text has another length
                out += map(self._one, some)
                continue
            cut = 4 * np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(x) for x in some]), "left") + 4
            raw, start = ids.tobytes(), 0
            for end in cut.tolist():
                out.append(raw[start:end])
                start = end
        return out

    def of(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many in each row)."""
        rows = len(offs) - 1
        start = piece_starts(data, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        end = np.append(start[1:], len(data))
        first, at = alike(data, start, end)
        if len(self.known) > self.most:
            self.forget()
        known, whole = self.known, data.tobytes()
        pieces = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        coded = [known.get(x) for x in pieces]
        regular = ((data[start[first]] == 0x20) & ~follows_white(data, end[first])).tolist()
        new = [i for i, ids in enumerate(coded) if ids is None and regular[i]]
        for i, ids in zip(new, self._joined([pieces[i] for i in new])):
            coded[i] = ids
        for i, ids in enumerate(coded):
            if ids is None:
                coded[i] = self._one(pieces[i])
                new.append(i)
        for i in new:
            if len(pieces[i]) <= 64:
                known[pieces[i]] = coded[i]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, begin = np.frombuffer(b"".join(coded), "<i4"), np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) + np.repeat(begin[at] - (ends - n), n)
        ids = flat[place]
        done = np.concatenate(([0], ends))
        return ids, np.diff(done[np.searchsorted(start, offs)])


class CapacityTree:
    """The bins by free capacity; finds the least free capacity of at least n in steps of log(capacity).

    Leaves are capacities 0..capacity, each with its open bins; an inner node knows whether any bin is below it.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        at = free + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """Removes and returns (free, bin) of a bin that fits n most tightly, the last opened of several."""
        count, at = self.count, n + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, until there is something to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:  # down, always to the left where it can be
                at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.size
        bin_ = self.bins[free].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return free, bin_


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of places in ``lengths`` (1 to capacity each); longest first, equal ones in their order."""
    tree, bins = CapacityTree(capacity), []
    n = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        got = tree.take(n[i])
        if got is None:
            bins.append([i])
            free = capacity - n[i]
            if free:
                tree.add(free, len(bins) - 1)
        else:
            bins[got[1]].append(i)
            if got[0] > n[i]:
                tree.add(got[0] - n[i], got[1])
    return bins


def _pack(path: str, pattern: str, capacity: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = Ids(path, pattern)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        made = 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        keys: list[pa.Array] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            key = pa.concat_arrays(keys)
            length = np.concatenate(lengths)
            pieces = -(-length // capacity)
            doc = np.repeat(np.arange(len(length)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(length[doc] - piece * capacity, capacity)
            start = (np.cumsum(length) - length)[doc] + piece * capacity
            flat = np.concatenate(ids)
            for x in (ids, lengths, keys):
                x.clear()
            bins = best_fit_decreasing(size, capacity)
            for at in range(0, len(bins), 256):
                some = bins[at : at + 256]
                order = np.array([i for b in some for i in b], np.int64)
                n = size[order]
                ends = np.cumsum(n)
                inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
                token = flat[np.repeat(start[order], n) + inside]
                many = np.array([len(b) for b in some])
                cut = np.concatenate(([0], np.cumsum(many)))
                filled = np.concatenate(([0], ends[cut[1:] - 1]))
                lists = pa.ListArray.from_arrays
                total = np.insert(ends - np.repeat(filled[:-1], many), cut[:-1], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.int64(part) << 32) + made + np.arange(len(some))),
                        pa.array(np.diff(filled).astype(np.int32)),
                        pa.array(many.astype(np.int32)),
                        lists(cut.astype(np.int32), key.take(pa.array(doc[order]))),
                        lists(cut.astype(np.int32), pa.array(piece[order].astype(np.int32))),
                        lists((cut + np.arange(len(cut))).astype(np.int32), pa.array(total)),
                        lists(filled.astype(np.int32), pa.array(token.astype(np.int32))),
                        lists(filled.astype(np.int32), pa.array(inside.astype(np.int32))),
                    ],
                    NAMES,
                )
                made += len(some)

        held = 0
        for b in steps(batches, "t"):
            keys.append(b.column(0))
            got, n = coder.of(*buffers(b.column(1)))
            ids.append(got)
            lengths.append(n)
            held += len(got)
            if held >= block:
                yield from flush()
                held = 0
        if ids:
            yield from flush()

    return run


NAMES = ["pack_id", "n_tokens", "n_segments", "keys", "pieces", "cu_seqlens", "input_ids", "position_ids"]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, pattern: str = PATTERN, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packs of at most ``capacity`` tokens: (pack_id, n_tokens, n_segments, keys, pieces, cu_seqlens, input_ids, position_ids).

    Segment i of a pack is piece ``pieces[i]`` of the text with key ``keys[i]``, its tokens input_ids[cu_seqlens[i] :
    cu_seqlens[i + 1]]; position_ids start from zero in each segment. A text of more tokens than fit is cut into pieces
    of ``capacity`` and a rest; joined by piece they are its ids again. Texts that are null or empty have no tokens
    and are in no pack. Repeated rows are packed each. Each task packs its own rows, ``block_tokens`` at a time: no
    shuffle, bounded memory, and a lost task makes the same packs from the same split.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_pack(vocabulary, pattern, capacity, block_tokens), f"pack_id long, n_tokens int, n_segments int, keys array<{kind}>, pieces array<int>, cu_seqlens array<int>, input_ids array<int>, position_ids array<int>")


BINARY = "pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens binary"


def write_binary(packs: DataFrame, path: str, capacity: int = CAPACITY, pad: int = 0) -> None:
    """Writes packs as Parquet rows of binary little-endian int32: the ids and positions of a pack are a row of
    ``capacity`` numbers, filled up with ``pad`` and zeros, so that a file's rows joined are a matrix; cu_seqlens has
    the cumulative lengths of its segments, from zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(0), b.column(1)]
            for column, fill in ((b.column(2), pad), (b.column(3), 0)):
                values, offs = column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64)
                n = np.diff(offs)
                matrix = np.full((len(n), capacity), fill, "<i4")
                matrix[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(offs[:-1] - offs[0], n)] = values
                out.append(pa.array([x.tobytes() for x in matrix], pa.binary()))
            values, offs = b.column(4).flatten().to_numpy().astype("<i4"), b.column(4).offsets.to_numpy()
            out.append(pa.array([values[s:e].tobytes() for s, e in zip(offs[:-1] - offs[0], offs[1:] - offs[0])], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens"])

    packs.select("pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens").mapInArrow(run, BINARY).write.parquet(path)


def op3_bestfit_packing(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts are in no pack, repeated rows in one each; a null doc_id is a key like any other."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("keys", "doc_ids")
