"""Near copies by the exact Jaccard similarity of five-word shingles: SimHash near-dedup with a second search.

A text becomes its set of shingles; equal sets are one node. Nodes get SimHash fingerprints, and the sharded BK-trees
of ``simhash`` give the links of few differing bits; each is confirmed by the exact similarity. Trees alone cannot give
all pairs of similarity 0.8: these differ in 9.7 +- 2.9 of 64 bits, and at a radius that holds them a tree follows
nearly all its edges (figures in the README). So what the trees leave apart is met a second time, by bands of minima of
the same shingle hashes: sets that agree on all rows of a band share a bucket. Within a bucket each set is first
compared with the smallest; of what these links leave apart, all but the largest component are compared with the rest,
where the bucket's sets are, in tiles of a bounded size. So each pair that shares a bucket is either compared or already
in one component, and what is sent is in proportion to the buckets' rows, not to their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bytestext import Words, mixed, steps
from lotwise.llm.shared import components, sent, written
from lotwise.llm.simhash import fingerprint_links

U64 = np.uint64
SHINGLE, SIMILARITY = 5, 0.8
#: Sets of either side that a task compares at a time.
TILE = 2000
#: Differing bits that the trees search.
RADIUS = 3
#: Sets of similarity 0.8 share none of 48 bands of 8 rows with probability 0.00015, of 0.85 with 0.0000002. Eight rows
#: keep texts apart that share half of their shingles: a band in 256 of theirs is the same.
BANDS, ROWS = 48, 8
_FACTORS = np.random.default_rng(20260721).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)


def sets_of(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets of the rows): the distinct shingles of each row's whole text, in order.

    A text of fewer words than a shingle is one shingle of all of them; a text without words has none.
    """
    words = Words(column)
    w, count = words.hashes(), np.diff(words.first)
    grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), grams)
    first = np.repeat(words.first[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(len(row))
    h = np.zeros(len(row), U64)
    for i in range(shingle):
        have = np.flatnonzero(count[row] > i)
        h[have] = mixed((h[have] + U64(0x632BE59BD9B4E019)) * U64(0x9E3779B97F4A7C15) ^ w[first[have] + i])
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(count) + 1))


def sketches_of(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each set, the bands of each set); both zero for empty sets."""
    have = np.flatnonzero(np.diff(offs))
    node, bands = np.zeros(len(offs) - 1, U64), np.zeros((len(offs) - 1, BANDS), U64)
    if len(have):
        at = offs[have]
        node[have] = mixed(np.add.reduceat(mixed(h.copy()), at) + np.diff(offs)[have].astype(U64))
        for b in range(BANDS):
            x = np.full(len(have), b, U64)
            for f in _FACTORS[b * ROWS : (b + 1) * ROWS]:
                x = mixed(x * U64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(h * f, at))
            bands[have, b] = x
    return node, bands


def _links_of(asks: list[tuple], asked: list[tuple], least: float) -> Iterator[tuple[int, int]]:
    """(node, a node of another component that is alike), one for each such component. Rows: (node, root, in the main component, set)."""
    size = np.array([len(x[3]) for x in asked])
    flat, begin = np.concatenate([x[3] for x in asked]), np.cumsum(size) - size
    node, root, main = (np.array([x[i] for x in asked]) for i in range(3))
    for own, own_root, _, s in asks:
        shared = np.add.reduceat(np.isin(flat, s), begin)
        alike = (shared >= least * (size + len(s) - shared)) & (root != own_root) & (main | (node < own))
        found = np.flatnonzero(alike)
        for i in found[np.unique(root[found], return_index=True)[1]].tolist():
            yield own, int(node[i])


def _meet(least: float):
    """Compares the sets of each tile of a bucket, rows of which follow each other, those that are asked first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked, asks = None, [], []

        def done() -> list[tuple[int, int]]:
            out = list(_links_of(asks, asked, least)) if asks and asked else []
            asked.clear()
            asks.clear()
            return out

        for b in batches:
            h, ca, cb, kind, node, root, main = (b.column(i).to_pylist() for i in range(7))
            s, links = b.column(7), []
            flat, offs = s.flatten().to_numpy(), s.offsets.to_numpy()
            offs = offs - offs[0]
            for i in range(b.num_rows):
                if (h[i], ca[i], cb[i]) != tile:
                    links += done()
                    tile = (h[i], ca[i], cb[i])
                (asks if kind[i] else asked).append((node[i], root[i], main[i], flat[offs[i] : offs[i + 1]].copy()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
        if last := done():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*last)], ["a", "b"])

    return run


def fingerprints_of(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if it is set in over half of the shingles' hashes; zero for empty sets."""
    have = np.flatnonzero(np.diff(offs))
    out = np.zeros(len(offs) - 1, U64)
    for part in np.split(have, np.arange(4096, len(have), 4096)):  # bounds the unpacked bits
        if len(part):
            lo, hi = offs[part[0]], offs[part[-1] + 1]
            bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, offs[part] - lo, axis=0, dtype=np.int32)
            out[part] = np.packbits(2 * ones > np.diff(offs)[part][:, None], axis=1, bitorder="little").view(U64).ravel()
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "t"):
        h, offs = sets_of(b.column(1))
        node, bands = sketches_of(h, offs)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
        fp = fingerprints_of(h, offs)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node.view(np.int64)), pa.array(np.diff(offs)), pa.array(fp.view(np.int64)), listed], ["k", "node", "n", "fp", "bands"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "t"):
        h, offs = sets_of(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(h.view(np.int64)))], ["node", "s"])


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, exactly."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _tree_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): nodes of one fingerprint with the smallest of it, and the smallest of fingerprints that the trees link."""
    own = nodes.filter("n > 0").select("node", "fp")
    first = written(own.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("_n")), "fingerprints")
    same = own.join(first.filter("_n > 1"), "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = written(fingerprint_links(first.select("fp"), radius).distinct(), "tree-links")
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_node")) for x in "ab")
    return same.unionByName(links.join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, component_id): component_id is the smallest key reachable over links of similarity ``least`` or more.

    Texts that are null or without words are copies of each other. Repeated rows give repeated rows; keys are not null.
    Texts are read twice; only those that share a bucket with another are sent, as their shingles.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    marked = written(rows.mapInArrow(_sketch, f"k {kind}, node long, n long, fp long, bands array<long>"), "sketches")
    nodes = written(marked.groupBy("node").agg(F.min("k").alias("low"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bands").alias("bands")), "sets")
    tree = written(_tree_pairs(nodes, radius), "tree-pairs")

    buckets = nodes.filter("n > 0").select("node", "n", F.explode("bands").alias("h"))
    firsts = buckets.groupBy("h").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    buckets = written(buckets.join(firsts.select("h", "first"), "h"), "buckets")

    some = buckets.select("node").unionByName(tree.select(F.col("a").alias("node"))).unionByName(tree.select(F.col("b").alias("node"))).distinct()
    wanted = written(nodes.join(some, "node", "left_semi").select(F.col("low").alias("k"), "node"), "wanted")
    sets = rows.join(sent(wanted), "k").select("node", "t").mapInArrow(_shingles, "node long, s array<long>")
    sets = written(sets.dropDuplicates(["node"]), "shingles")  # rows of one key are the same text

    sizes = nodes.select(F.col("node").alias("first"), F.col("n").alias("first_n"))
    star = buckets.filter("node <> first").select("node", "n", "first").distinct().join(sizes, "first").filter(F.least("n", "first_n") >= least * F.greatest("n", "first_n"))  # else the sizes differ too much
    tried = star.select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(tree).distinct()
    links = written(_alike(tried, sets, least), "near-links")

    roots = components(links, "near-components").select("node", "root")
    placed = buckets.select("h", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "near-placed")
    # Of a bucket's components all but the largest meet the others: what is one component already is not paired.
    shares = placed.groupBy("h", "root").agg(F.count("*").alias("m"))
    main = shares.groupBy("h").agg(F.max(F.struct("m", "root")).alias("x"), F.count("*").alias("apart"), F.sum("m").alias("all")).filter("apart > 1")
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    main = main.select("h", F.col("x.root").alias("main"), tiles(F.col("all") - F.col("x.m")).alias("la"), tiles(F.col("all")).alias("lb"))
    apart = placed.join(main, "h")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = apart.filter("root <> main").select("h", F.pmod(F.xxhash64("node"), F.col("la")).cast("int").alias("ca"), every("lb").alias("cb"), F.lit(1).alias("asks"), "node", "root", (F.col("root") == F.col("main")).alias("main"))
    asked = apart.select("h", every("la").alias("ca"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("lb")).cast("int").alias("cb"), F.lit(0).alias("asks"), "node", "root", (F.col("root") == F.col("main")).alias("main"))
    met = asks.unionByName(asked).join(sets, "node").select("h", "ca", "cb", "asks", "node", "root", "main", "s")
    met = met.repartition("h", "ca", "cb").sortWithinPartitions("h", "ca", "cb", "asks")
    links = links.unionByName(met.mapInArrow(_meet(least), "a long, b long"))

    linked = components(links, "near-links")
    rooted = nodes.select("node", "low").join(linked, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("node", "component_id")
    return marked.select(F.col("k").alias(key), "node").join(named, "node").select(key, "component_id")
