"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bytestext import Words, steps
from lotwise.llm.shared import components, written

#: Fingerprints of one tree at most. A larger shard is held as several trees.
TREE_SIZE = 4096
#: Fingerprints that look through the trees of one shard in one task at most.
CHUNK_SIZE = 65536


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """The SimHash of each row's whole text; zero for a text without words."""
    words = Words(column)
    joined, start, end = words.spaced()
    count = np.diff(words.first)
    grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    have = np.flatnonzero(grams)
    out = np.zeros(len(count), np.uint64)
    if not len(have):
        return out
    n = grams[have]
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    first = np.repeat(words.first[have] - begin, n) + np.arange(n.sum())
    last = first + np.repeat(np.minimum(count[have], shingle), n) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(start[first].tolist(), end[last].tolist())], dtype=np.uint64)
    for at in range(0, len(have), 4096):  # bounds the unpacked bits
        part = slice(at, at + 4096)
        lo, hi = begin[part][0], begin[part][-1] + n[part][-1]
        bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin[part] - lo, axis=0, dtype=np.int32)
        out[have[part]] = np.packbits(2 * ones > n[part][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp long): one row per document. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1), shingle).view(np.int64))], ["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


class BKTree:
    """Keys under their integer Hamming distance to the parent; a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        values, children = self.values, self.children
        values.append(value)
        children.append({})
        at = 0
        while len(values) > 1:
            d = (values[at] ^ value).bit_count()
            to = children[at].setdefault(d, len(values) - 1)
            if to == len(values) - 1:
                return
            at = to

    def within(self, value: int, radius: int) -> list[int]:
        """The positions of all values at most ``radius`` away."""
        if not self.values:
            return []
        values, children, found, todo = self.values, self.children, [], [0]
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo += [to for edge, to in below.items() if d - radius <= edge <= d + radius]
            else:
                todo += [below[edge] for edge in range(max(0, d - radius), d + radius + 1) if edge in below]
        return found


def _links(trees: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``trees``, and from ``queries`` to them: (value, root)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    tree = BKTree()
    for own, value in [(True, v) for v in trees] + [(False, v) for v in queries]:
        for at in tree.within(value, radius):
            a, b = find(value), find(tree.values[at])
            if a != b:
                parent[max(a, b)] = min(a, b)
        if own:
            tree.add(value)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray | None] = {"rest": None}

        def done(rows: np.ndarray) -> pa.RecordBatch | None:
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            edges: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)]):
                if hi - lo < 2:
                    continue
                if hi - lo == 2:
                    a, b = (int(x) & (2**64 - 1) for x in rows[lo:hi, 4])
                    if not rows[lo, 3] and (a ^ b).bit_count() <= radius and a != b:
                        edges.append((max(a, b), min(a, b)))
                    continue
                own = rows[lo:hi, 3] == 0
                values = [int(x) & (2**64 - 1) for x in rows[lo:hi, 4]]
                edges += _links([v for v, o in zip(values, own) if o], [v for v, o in zip(values, own) if not o], radius)
            if not edges:
                return None
            e = np.array(edges, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            if held["rest"] is not None:
                rows = np.concatenate([held["rest"], rows])
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            held["rest"] = rows[cut:]
            if cut and (out := done(rows[:cut])) is not None:
                yield out
        if held["rest"] is not None and (out := done(held["rest"])) is not None:
            yield out

    return run


def fingerprint_links(fps: DataFrame, radius: int = 3, tree_size: int = TREE_SIZE, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """(a, b): links that connect all ``fps(fp)`` (distinct) at most ``radius`` bits apart, not every pair.

    Two fingerprints within the radius agree on one of radius + 1 blocks of bits, so each block value is a shard with
    its own BK-tree, and the shard's fingerprints search it. A shard of more than ``tree_size`` is several trees, and
    of more than ``chunk_size`` several chunks of searchers, to each of which the trees are sent; so what one task
    holds is bounded whatever the shard, and no link is lost. Fingerprints are met once per shard, links once per
    component and shard.
    """
    if not 0 <= radius <= 15:
        raise ValueError("radius must be from 0 to 15")
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]

    def value(lo: int, hi: int):
        part = F.shiftrightunsigned("fp", lo) if lo else F.col("fp")
        return part.bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < 64 else part

    shards = F.array(*[F.struct(F.lit(i).alias("block"), value(lo, hi).alias("v")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    rows = fps.select("fp", F.explode(shards).alias("s")).select(F.col("s.block").cast("long").alias("block"), F.col("s.v").alias("v"), "fp")
    sizes = rows.groupBy("block", "v").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["block", "v"])
    trees = F.ceil(F.col("n") / tree_size)
    chunks = F.ceil(F.col("n") / chunk_size)
    rows = rows.select("block", "v", "fp", trees.alias("trees"), chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), trees).alias("tree"), F.pmod(F.xxhash64("fp", F.lit(1)), chunks).alias("chunk"))
    # A tree goes to every chunk; a fingerprint of a chunk searches its own tree as it is built (chunk 0) and the later ones.
    own = rows.select("block", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "tree", "fp").withColumn("role", F.lit(0).cast("long"))
    others = rows.filter("trees > 1 and tree < trees - 1").select("block", "v", "chunk", F.explode(F.sequence(F.col("tree") + 1, F.col("trees") - 1)).alias("tree"), "fp").withColumn("role", F.lit(1).cast("long"))
    work = own.unionByName(others).select("block", "v", (F.col("chunk") * 2**31 + F.col("tree")).alias("place"), "role", "fp")
    work = work.repartition("block", "v", "place").sortWithinPartitions("block", "v", "place", "role", "fp")
    return work.mapInArrow(_search(radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links of at most ``radius`` bits.

    Texts that are null or without words have fingerprint zero and are linked like any other. Repeated rows give
    repeated rows. A null key takes part but names no component unless all keys of its component are null.
    Other columns of ``docs`` are not read. No shuffle carries texts: a document becomes 16 bytes in the first step.
    """
    marked = written(with_fingerprint(docs, text, key, shingle), "fingerprints")
    by_fp = written(marked.groupBy("fp").agg(F.min(key).alias("low")), "distinct-fingerprints")
    linked = components(fingerprint_links(by_fp.select("fp"), radius), "fingerprint-links")
    rooted = by_fp.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def op1_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts have fingerprint zero and are linked; each repeated row has its row; a null doc_id names no component but its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hexadecimal().alias("fingerprint"), "component_id")
