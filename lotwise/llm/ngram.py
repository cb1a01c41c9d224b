"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark and memory-mapped by the workers that score.

Counting: a task reduces its texts to distinct pairs with counts and sends them, coded against the words they hold, to
shards; shards add them up, write one sorted array of hashes each to the shared folder, and send on what they know of
each single word (occurrences, distinct words before it, how many words follow it once, twice, more often); word
shards add that up and write their arrays. Scoring reads the arrays through memory maps, so a worker reads the pages
it looks up and holds no copy.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bytestext import Words, mixed, steps
from lotwise.llm.shared import new_dir, posix_path

U64 = np.uint64
#: Hashes of what stands before a text and of its end.
BEGIN, END = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)
#: Bytes of training text to a shard, and how many shards there are at least and at most.
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 16 << 20, 8, 20_000
#: Tokens whose pairs a task holds before it sends them on.
HELD_TOKENS = 5_000_000
#: An entry of a pair array: a hash but for its low 8 bits, which hold the count, or this if it is in the file of large counts.
LARGE = 255
LOW = U64(255)
NUMBERS = ["n", "cont", "one", "two", "more"]


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed((mixed(before + U64(0x632BE59BD9B4E019)) * U64(0x9E3779B97F4A7C15)) ^ word) | LOW


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def pair_shard(before: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """Pairs with one second word meet in a thirty-second of the shards at most: few sums to a word, none too large."""
    spread = -(-shards // 32)
    return (shard_of(word, shards) + shard_of(mixed(before.copy()), spread)) % shards


def pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash before, hash, tokens of each row): each row's words and then one end, the first after BEGIN."""
    words = Words(column)
    count = np.diff(words.first) + 1
    ends = np.cumsum(count) - 1
    token = np.full(int(count.sum()), END, dtype=U64)
    is_word = np.ones(len(token), bool)
    is_word[ends] = False
    token[is_word] = words.hashes()
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - count + 1] = BEGIN
    return before, token, count


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(where a row of each distinct key is, sums of the values), by key."""
    by = np.argsort(key, kind="stable")
    k = key[by]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return (by[first], *[np.add.reduceat(v[by], first) if len(first) else v[:0] for v in values])


def _bytes_apart(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones...: what is mostly zero compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _pack(*columns: np.ndarray) -> bytes:
    """Compressed columns; hashes as places in the sorted list of those that occur."""
    out = [np.array([len(columns[0])], "<i8").tobytes()]
    for x in columns:
        if x.dtype == U64:
            known, at = np.unique(x, return_inverse=True)
            out += [np.array([len(known)], "<i8").tobytes(), _bytes_apart(np.diff(known, prepend=U64(0))), _bytes_apart(at.astype("<u4"))]
        else:
            out.append(_bytes_apart(x.astype("<u4")))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes, hashes: int, counts: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    at = 8
    n = int(raw[:8].view("<i8")[0])

    def take(m: int, kind: str) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        x = np.ascontiguousarray(raw[at : at + m * width].reshape(width, m).T).view(kind).ravel()
        at += m * width
        return x

    out = []
    for _ in range(hashes):
        m = int(raw[at : at + 8].view("<i8")[0])
        at += 8
        known = np.cumsum(take(m, "<u8"), dtype=U64)
        out.append(known[take(n, "<u4")])
    return out + [take(n, "<u4").astype(np.int64) for _ in range(counts)]


def _row(kind: int, shard: int, blob: bytes | None, *stats: int) -> pa.RecordBatch:
    stats = (*stats, *[0] * (7 - len(stats)))
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), *[pa.array([x], pa.int64()) for x in stats]], ["kind", "shard", "blob", *[f"s{i}" for i in range(7)]])


ROW = "kind int, shard int, blob binary, s0 long, s1 long, s2 long, s3 long, s4 long, s5 long, s6 long"


def _count_pairs(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            before, word = (np.concatenate(x) for x in zip(*held))
            held.clear()
            at, count = _summed(pair_hash(before, word), np.ones(len(word), np.int64))
            before, word = before[at], word[at]
            shard = pair_shard(before, word, shards)
            by = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[by], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                own = by[cut[s] : cut[s + 1]]
                own = own[np.argsort(word[own], kind="stable")]
                yield _row(0, s, _pack(word[own], before[own], count[own]))

        for b in steps(batches, "t"):
            held.append(pairs_of(b.column(0))[:2])
            if sum(len(x[1]) for x in held) >= HELD_TOKENS:
                yield from send()
        if held:
            yield from send()

    return run


def _save(folder: str, name: str, x: np.ndarray) -> None:
    """A whole file or none, whatever becomes of the task; run again it writes the same bytes."""
    with open(part := f"{folder}/{name}.{uuid.uuid4().hex}", "wb") as f:
        np.save(f, x)
    os.replace(part, f"{folder}/{name}.npy")


def _by_shard(batches: Iterator[pa.RecordBatch], keep_kind: int) -> Iterator[tuple[int, list[bytes]] | pa.RecordBatch]:
    """The blobs of each shard together (rows are sorted by it); rows of other kinds as they are."""
    shard, blobs = -1, []
    for b in batches:
        for i, (kind, s, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
            if kind != keep_kind:
                yield b.slice(i, 1)
                continue
            if s != shard and blobs:
                yield shard, blobs
                blobs = []
            shard = s
            blobs.append(x)
    if blobs:
        yield shard, blobs


def _add_pairs(folder: str, shards: int):
    """Writes a pair array; sends kind 1, numbers of words, and kind 2, how many pairs have the counts 1 to 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in _by_shard(batches, 0):
            word, before, count = (np.concatenate(x) for x in zip(*[_unpack(x, 2, 1) for x in blobs]))
            h = pair_hash(before, word)
            at, count = _summed(h, count)
            word, before, h = word[at], before[at], h[at]
            _save(folder, f"pairs-{shard:06d}", (h ^ LOW) | np.minimum(count, LARGE).astype(U64))
            if (large := np.flatnonzero(count >= LARGE)).size:
                _save(folder, f"large-{shard:06d}", np.stack([h[large], count[large].astype(U64)]))
            yield _row(2, 0, None, *[int((count == i).sum()) for i in range(1, 5)])
            ones = np.ones(len(word), np.int64)
            a, n, cont = _summed(word, count, ones)
            b, one, two, more = _summed(before, *[f.astype(np.int64) for f in (count == 1, count == 2, count > 2)])
            key = np.concatenate([word[a], before[b]])
            zero_a, zero_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            at, *numbers = _summed(key, np.concatenate([n, zero_b]), np.concatenate([cont, zero_b]), np.concatenate([zero_a, one]), np.concatenate([zero_a, two]), np.concatenate([zero_a, more]))
            key = key[at]
            cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                p = slice(cut[s], cut[s + 1])
                yield _row(1, s, _pack(key[p], *[x[p] for x in numbers]))

    return run


def _add_words(folder: str):
    """Writes a word array; yields the sums that all texts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _by_shard(batches, 1):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            shard, blobs = got
            key, *numbers = (np.concatenate(x) for x in zip(*[_unpack(x, 1, 5) for x in blobs]))
            at, *numbers = _summed(key, *numbers)
            table = np.empty(len(at), dtype=[("h", "<u8"), *[(x, "<u4") if x != "n" else (x, "<u8") for x in NUMBERS]])
            table["h"] = key[at]
            for name, x in zip(NUMBERS, numbers):
                table[name] = x
            _save(folder, f"words-{shard:06d}", table)
            n, cont = numbers[0], numbers[1]
            yield _row(3, 0, None, int((n > 0).sum()), int(n.sum()), int(cont.sum()), *[int((cont == i).sum()) for i in range(1, 5)])

    return run


@dataclass(frozen=True)
class Model:
    """Where the arrays are and what all texts share."""

    folder: str
    shards: int
    tokens: int
    types: int
    starts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_counts: tuple[int, int, int, int]  # distinct pairs; words with 1, 2, more distinct words before them


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Those of counts 1, 2 and more, from the counts of counts 1 to 4; where one of these is zero, the least that keeps them in order."""
    if not n1:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d1 = min(max(1 - 2 * y * n2 / n1, 0.01), 1.0)
    d2 = min(max(2 - 3 * y * n3 / n2, d1), 2.0) if n2 else d1
    d3 = min(max(3 - 4 * y * n4 / n3, d2), 3.0) if n3 else d2
    return (d1, d2, d3)


def train(texts: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Counts the whole of ``texts`` and writes the arrays to the shared folder; nothing is pruned or sampled.

    The driver gets one row of sums. Counts of one pair must stay under 2**32 in a shard. There are as many shards as
    the text's bytes ask for, so what a task adds up is the same at any size (up to MOST_SHARDS).
    """
    spark = texts.sparkSession
    if not shards:
        size = texts.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
        shards = min(max(-(-size // SHARD_BYTES), LEAST_SHARDS), MOST_SHARDS)
    folder = posix_path(new_dir(spark, "ngram"))
    os.makedirs(folder, exist_ok=True)
    column = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    pairs = column.mapInArrow(_count_pairs(shards), ROW).repartition(shards, "shard").sortWithinPartitions("shard")
    words = pairs.mapInArrow(_add_pairs(folder, shards), ROW).repartition(shards, "shard").sortWithinPartitions("kind", "shard")
    stats = words.mapInArrow(_add_words(folder), ROW)
    sums = {r[0]: [int(x) for x in r[1:]] for r in stats.groupBy("kind").agg(*[F.sum(f"s{i}") for i in range(7)]).collect()}
    pair_counts, (types, tokens, distinct, *word_counts) = sums.get(2, [0] * 7)[:4], sums.get(3, [0] * 7)
    n1, n2 = word_counts[0], word_counts[1]
    starts = _lookup_words(folder, shards, np.array([END]))["n"][0] if tokens else 0
    return Model(folder, shards, tokens, types, int(starts), discounts(*pair_counts), discounts(*word_counts), (distinct, n1, n2, types - n1 - n2))


@lru_cache(maxsize=4 * MOST_SHARDS)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _lookup_words(folder: str, shards: int, h: np.ndarray) -> np.ndarray:
    """The rows of sorted hashes ``h``; zeros for those that aren't there."""
    out = np.zeros(len(h), dtype=[(x, "<i8") for x in NUMBERS])
    cut = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)).tolist():
        if (table := _mapped(f"{folder}/words-{s:06d}.npy")) is None:
            continue
        own = h[cut[s] : cut[s + 1]]
        at = np.minimum(np.searchsorted(table["h"], own), len(table) - 1)
        rows = table[at]
        hit = np.flatnonzero(rows["h"] == own)
        for x in NUMBERS:
            out[x][cut[s] + hit] = rows[x][hit]
    return out


def _lookup_pairs(folder: str, shards: int, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    h, shard = pair_hash(before, word), pair_shard(before, word, shards)
    by = np.lexsort((h, shard))
    cut = np.searchsorted(shard[by], np.arange(shards + 1))
    out = np.zeros(len(h), np.int64)
    for s in np.flatnonzero(np.diff(cut)).tolist():
        if (table := _mapped(f"{folder}/pairs-{s:06d}.npy")) is None:
            continue
        own = by[cut[s] : cut[s + 1]]
        key = h[own]
        found = table[np.minimum(np.searchsorted(table, key ^ LOW), len(table) - 1)]
        hit = np.flatnonzero((found | LOW) == key)
        n = (found[hit] & LOW).astype(np.int64)
        if (n == LARGE).any():
            large = _mapped(f"{folder}/large-{s:06d}.npy")
            full = n == LARGE
            n[full] = large[1][np.searchsorted(large[0], key[hit][full])].astype(np.int64)
        out[own[hit]] = n
    return out


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0)


def probabilities(model: Model, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of each word's probability after the one before it, each word's occurrences in training)."""
    known, at = np.unique(np.concatenate([word, before]), return_inverse=True)
    rows = _lookup_words(model.folder, model.shards, known)
    rows["n"][known == BEGIN] = 0
    w, b = rows[at[: len(word)]], rows[at[len(word) :]]
    distinct, one, two, more = model.word_counts
    e, d = model.word_discounts, model.pair_discounts
    left = (e[0] * one + e[1] * two + e[2] * more) / distinct if distinct else 1.0
    single = _discounted(w["cont"], e) / max(distinct, 1) + left / (model.types + 1)
    total = np.where(before == BEGIN, model.starts, b["n"])
    pair = _discounted(_lookup_pairs(model.folder, model.shards, before, word), d)
    gamma = d[0] * b["one"] + d[1] * b["two"] + d[2] * b["more"]
    p = np.where(total > 0, (pair + gamma * single) / np.maximum(total, 1), single)
    return np.log10(p), w["n"]


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "t"):
            before, word, count = pairs_of(b.column(2))
            log, n = probabilities(model, before, word)
            base = np.log10((n + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
            first = np.cumsum(count) - count
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(count.astype(np.int64)), pa.array(np.add.reduceat((n > 0).astype(np.int64), first)), pa.array(np.full(b.num_rows, model.tokens, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log, first))],
                ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, model: Model, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, by its whole text.

    A null or empty text is one token, its end. ``score`` is the log10 probability of all tokens; perplexity is
    10 ** (-score / n_tokens).
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), held_out.alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    out = rows.mapInArrow(_score(model), f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("k", key)


def op2_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """A null doc_id counts as training: its remainder is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return score(docs, train(docs.filter(~held_out)), held_out)
