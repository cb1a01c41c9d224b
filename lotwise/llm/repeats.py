"""Repeated-substring removal by enhanced suffix arrays and their common-prefix interval trees.

Suffixes are sparse: winnowing picks from every window of ``length`` bytes the anchor of ``gram`` bytes with the least
hash, so two equal windows pick the same anchor at the same place. Anchors whose gram occurs once anywhere are dropped
by a count. Of the others, those whose surroundings, all bytes that a window around them can reach, occur again as a
whole are settled by that; only where surroundings differ, one of each kind is sent with its bytes. Those with one
gram meet in one task, which sorts their right sides (a suffix array), takes the common prefixes of neighbours, and scans them with a stack
into the interval tree. Within an interval the left sides are sorted: where neighbours' left sides differ the repeat
can't be extended to the left, and what they share with the interval's prefix is a maximal repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.bytestext import buffers, mixed, segment_hashes, sliding, steps, window_hashes

LENGTH, GRAM = 200, 64
#: Distinct surroundings of anchors that one sort takes, unless one gram has more.
BLOCK = 30_000


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in ``data`` and their grams' hashes; every window of ``length`` bytes has one."""
    width = length - gram + 1
    h = window_hashes(data, gram)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    np.maximum(h, np.uint64(1), out=h)
    inside = np.zeros(len(data) + 1, np.int32)  # windows that lie within one row
    whole = np.flatnonzero(np.diff(offs) >= length)
    inside[offs[whole]] += 1
    np.subtract.at(inside, offs[whole + 1] - length + 1, 1)
    starts = np.cumsum(inside[: len(data) - length + 1]) > 0
    least = sliding(h, width, np.minimum, np.uint64(2**64 - 1))[: len(starts)]
    least[~starts] = 0
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    best = sliding(padded, width, np.maximum, np.uint64(0))[: len(h)]
    at = np.flatnonzero(best == h)
    return at, h[at]


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width), n


def _common(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows a and b."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 8192):
        x, y = a[at : at + 8192], b[at : at + 8192]
        differ = m[x] != m[y]
        k = differ.argmax(axis=1)
        k[~differ.any(axis=1)] = m.shape[1]
        out[at : at + 8192] = np.minimum(k, np.minimum(n[x], n[y]))
    return out


def intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the tree with a prefix of ``least`` or more, inner ones first.

    prefix[i] is the common prefix of places i and i + 1 of the suffix array.
    """
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefix, 0]):
        begin = i
        while stack and stack[-1][0] > p:
            top, begin = stack.pop()
            yield top, begin, i
        if p >= least and (not stack or stack[-1][0] < p):
            stack.append((p, begin))


def maximal_repeats(left: list[bytes], right: list[bytes], length: int, gram: int) -> Iterator[tuple[list[int], int, int]]:
    """(occurrences, bytes to the left, bytes to the right) of each maximal repeat of ``length`` bytes or more.

    left: the bytes before each anchor, last one first; right: the bytes from it on. All occurrences that share the
    repeat are given, not only neighbours; a repeat within which neither side can be told apart any further, as the
    surroundings end there, counts as maximal.
    """
    if len(right) < 2:
        return
    rm, rn = _matrix(right, length)
    lm, ln = _matrix(left, length - gram)
    order = np.array(sorted(range(len(right)), key=right.__getitem__))
    prefix = _common(rm, rn, order[:-1], order[1:])
    pair = _common(lm, ln, order[:-1], order[1:]).tolist()
    rank = np.empty(len(left), np.int64)
    rank[sorted(range(len(left)), key=left.__getitem__)] = np.arange(len(left))
    places = order.tolist()
    for p, first, last in intervals(prefix.tolist(), gram):
        need = max(0, length - p)
        if last == first + 1:
            if pair[first] >= need:
                yield [places[first], places[last]], pair[first], p
            continue
        own = order[first : last + 1]
        own = own[np.argsort(rank[own], kind="stable")]
        shared = _common(lm, ln, own[:-1], own[1:]).tolist()
        members = own.tolist()
        # Left-extension diversity: each interval of the left sides is a repeat that no byte to the left is common to.
        found = list(intervals([s + 1 for s in shared], need + 1))
        for q, lo, hi in found:
            yield members[lo : hi + 1], q - 1, p


def reach(left: list[bytes], right: list[bytes], copies: list[int], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeats around each anchor reach to the left and right; -1 where there is none.

    Both sides of a repeat hold the anchor, so the union of all repeats of an anchor is one run of bytes, and its ends
    are those of the repeats that reach farthest.
    """
    to_left, to_right = np.full(len(left), -1, np.int64), np.full(len(left), -1, np.int64)
    for i, n in enumerate(copies):
        if n > 1 and len(left[i]) + len(right[i]) >= length:
            to_left[i], to_right[i] = len(left[i]), len(right[i])
    for members, q, p in maximal_repeats(left, right, length, gram):
        if len(members) == 2:
            for i in members:
                if q > to_left[i]:
                    to_left[i] = q
                if p > to_right[i]:
                    to_right[i] = p
        else:
            m = np.array(members)
            to_left[m] = np.maximum(to_left[m], q)
            to_right[m] = np.maximum(to_right[m], p)
    return to_left, to_right


def _emit_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "t"):
            data, offs = buffers(b.column(1))
            at, h = anchors(data, offs, length, gram)
            row = np.searchsorted(offs, at, "right") - 1
            lo, hi = np.maximum(offs[row], at - (length - gram)), np.minimum(offs[row + 1], at + length)
            around = mixed(segment_hashes(data, lo, hi) ^ (at - lo).astype(np.uint64))
            uid = b.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), uid, pa.array((at - offs[row]).astype(np.int32))], ["h", "c", "uid", "pos"])

    return run


def _emit_surroundings(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "t"):
            data, offs = buffers(b.column(1))
            whole = data.tobytes()
            found = b.column(2)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64))
            flat = found.flatten()
            pos = flat.field("pos").to_numpy().astype(np.int64)
            begin, end = offs[row], offs[row + 1]
            at = begin + pos
            lo, hi = np.maximum(begin, at - (length - gram)), np.minimum(end, at + length)
            left = [whole[x:y][::-1] for x, y in zip(lo.tolist(), at.tolist())]
            right = [whole[x:y] for x, y in zip(at.tolist(), hi.tolist())]
            for k in range(0, len(left), 20_000):
                part = slice(k, k + 20_000)
                yield pa.RecordBatch.from_arrays([flat.field(x)[part] for x in ("h", "c", "n")] + [pa.array(left[part], pa.binary()), pa.array(right[part], pa.binary())], ["h", "c", "n", "l", "r"])

    return run


def _emit_reach(length: int, gram: int):
    def block(table: pa.Table) -> pa.RecordBatch:
        left, right = table.column("l").to_pylist(), table.column("r").to_pylist()
        x, y = reach(left, right, table.column("n").to_pylist(), length, gram)
        keep = np.flatnonzero(x >= 0)
        return pa.RecordBatch.from_arrays([table.column("h").combine_chunks().take(pa.array(keep)), table.column("c").combine_chunks().take(pa.array(keep)), pa.array(x[keep].astype(np.int32)), pa.array(y[keep].astype(np.int32))], ["h", "c", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < BLOCK:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            other = np.flatnonzero(h != h[-1])
            if len(other):
                cut = int(other[-1]) + 1
                yield block(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "t"):
        data, offs = buffers(b.column(1))
        spans = b.column(2)
        rows = []
        for i in range(b.num_rows):
            text = data[offs[i] : offs[i + 1]].tobytes()
            runs: list[list[int]] = []
            for s in sorted((max(x["s"], 0), min(x["e"], len(text))) for x in spans[i].as_py() or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            sha, at, gone = hashlib.sha256(), 0, 0
            for s, e in runs:
                sha.update(text[at:s])
                at, gone = e, gone + e - s
            sha.update(text[at:])
            rows.append((len(text), gone, len(runs), sha.hexdigest(), [{"s": s, "e": e} for s, e in runs]))
        cols = list(zip(*rows))
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], kind)], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans): what repeated strings of ``length`` bytes cover.

    Texts are UTF-8 bytes, null ones empty; matches don't cross documents. ``spans`` are the maximal runs removed, in
    bytes. Rows repeated as a whole are occurrences of their own, so both lose what they share; a null key is a key.
    Text is shuffled once, by row; an anchor is 28 bytes. Bytes are sent for one of each kind of surroundings only, so
    a passage or a text copied any number of times costs its edges.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.xxhash64(F.col(key), F.col(text).cast("string")).alias("uid"), F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    found = rows.select("uid", "t").mapInArrow(_emit_anchors(length, gram), "h long, c long, uid long, pos int")
    # The same filter for every use, as joins would push it below the exchange for some; so one exchange serves all.
    found = found.filter(F.col("h").isNotNull() & F.col("c").isNotNull()).repartition("h")
    alike = Window.partitionBy("h", "c").orderBy("uid", "pos")
    found = found.withColumns({"i": F.row_number().over(alike), "n": F.count("*").over(alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    found = found.withColumn("all", F.count("*").over(Window.partitionBy("h"))).filter("all > 1")
    # One of each kind of surroundings, where a gram has several.
    needed = found.filter("i = 1 and n < all").groupBy("uid").agg(F.collect_list(F.struct("pos", "h", "c", F.least(F.col("n"), F.lit(2)).alias("n"))).alias("found"))
    dealt = rows.repartition("uid")
    # All columns in both uses: the documents are shuffled once.
    around = dealt.join(needed, "uid").select("k", "t", "found").mapInArrow(_emit_surroundings(length, gram), "h long, c long, n long, l binary, r binary")
    around = around.repartition("h").sortWithinPartitions("h")
    far = around.select("h", "c", "l", "r", "n").mapInArrow(_emit_reach(length, gram), "h long, c long, x int, y int")
    settled = found.filter("n > 1").select("uid", (F.col("pos") - (length - gram)).alias("s"), (F.col("pos") + length).alias("e"))
    reached = found.filter("n = 1 and n < all").join(far, ["h", "c"]).select("uid", (F.col("pos") - F.col("x")).alias("s"), (F.col("pos") + F.col("y")).alias("e"))
    spans = settled.unionByName(reached).groupBy("uid").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    out = dealt.join(spans, "uid", "left").select("k", "t", "spans")
    return out.mapInArrow(_cut, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>").withColumnRenamed("k", key)


def op7_repeat_intervals(spark, sf_dir: str) -> DataFrame:
    """A row a document: null texts are empty, repeated rows lose what they share, a null doc_id is a key like any other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs).drop("spans")
