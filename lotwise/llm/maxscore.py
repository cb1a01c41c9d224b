"""Exact top-k by inner product with MaxScore over the components of integer vectors.

Each component of a query is a term, and a block of candidates has a posting list for it: the candidates' values. A
term's contribution lies between two bounds that the block's least and greatest value give; measured from the lower
one it is non-negative, as MaxScore needs. With the current k-th best score as the threshold, terms of small spread
whose bounds cannot together lift a candidate over it are non-essential: essential lists are traversed for the whole
block, and the others probed, largest first, for candidates that are still competitive. A block whose bounds cannot
reach the threshold is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.shared import new_dir, written

#: Queries that are sent to all tasks at once, and candidates of a block.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096


def quantized(ids: pa.Array, vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, floor(scale * x)) of the vectors without a null or non-finite component; short ones end in zeros.

    Whole numbers are int64, or Python's where one is beyond that.
    """
    good = np.asarray(pc.and_(pc.is_valid(vectors), pc.is_valid(ids)).to_numpy(zero_copy_only=False), bool)
    n = np.where(good, pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    dims = int(n.max(initial=0))
    row = np.repeat(np.arange(len(n)), n)
    flat = pc.list_flatten(vectors.filter(pa.array(good)))
    x = np.asarray(pc.fill_null(pc.cast(flat, pa.float64()), np.nan).to_numpy(zero_copy_only=False))
    bad = np.unique(row[~np.isfinite(x)])
    good[bad] = False
    x = np.floor(np.where(np.isfinite(x), x, 0) * scale)
    wide = len(x) and np.abs(x).max() >= 2.0**62  # beyond a long: whole numbers of any size
    out = np.zeros((len(n), dims), object if wide else np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = [int(v) if np.isfinite(v) else int(np.sign(v)) << 1024 for v in x.tolist()] if wide else x
    keep = np.flatnonzero(good)
    return pc.cast(ids, pa.int64()).take(pa.array(keep)).to_numpy(zero_copy_only=False), out[keep]


class Best:
    """The k best (score, id) of each query so far: highest score, then least id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.of: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def threshold(self, q: int) -> float:
        return -self.of[q][-1][0] if len(self.of[q]) == self.k else -np.inf

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= kth
            scores, ids = scores[keep], ids[keep]
            if len(scores) > 4 * self.k:
                keep = np.lexsort((ids, -scores))[: self.k]
                scores, ids = scores[keep], ids[keep]
        self.of[q] = sorted(self.of[q] + [(-int(s), int(i)) for s, i in zip(scores, ids)])[: self.k]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, best: Best) -> int:
    """Offers a block of candidates (rows of ``block``) to all queries; returns how many component values it read."""
    width = max(queries.shape[1], block.shape[1])
    q_all = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    lists = np.ascontiguousarray(np.pad(block, ((0, 0), (0, width - block.shape[1]))).T)
    most = int(np.abs(q_all).max(initial=0)) * int(np.abs(lists).max(initial=0)) * width
    # Doubles hold all sums exactly, or longs do, or else Python's whole numbers.
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    q_all, lists = q_all.astype(kind), lists.astype(kind)
    low, high = lists.min(axis=1), lists.max(axis=1)
    read = 0
    for q, (own, terms) in enumerate(zip(query_ids.tolist(), q_all)):
        a, b = terms * low, terms * high
        least, spread = np.minimum(a, b), np.abs(b - a)
        threshold = best.threshold(q)
        floor = least.sum() if width else 0
        if floor + spread.sum() < threshold:
            continue
        order = np.argsort(-spread, kind="stable")
        rest = np.concatenate((np.cumsum(spread[order][::-1])[::-1], [0]))  # the most that terms from here on add
        essential = min(width, int(np.searchsorted(-(floor + rest), -threshold, "right"))) if np.isfinite(threshold) else width
        first = order[:essential]
        # Measured from the lower bounds of the terms not read yet.
        partial = terms[first] @ lists[first] + least[order[essential:]].sum()
        read += essential * len(ids)
        live = np.flatnonzero((partial + rest[essential] >= threshold) & (ids != own))
        partial = partial[live]
        for at in range(essential, width, 8):
            if not len(live):
                break
            some = order[at : at + 8]
            partial = partial + terms[some] @ lists[np.ix_(some, live)] - least[some].sum()
            read += len(some) * len(live)
            keep = partial + rest[min(at + 8, width)] >= threshold
            live, partial = live[keep], partial[keep]
        if len(live):
            best.offer(q, np.clip(partial, -(2**63), 2**63 - 1).astype(np.int64) if kind is object else partial.astype(np.int64), ids[live])
    return read


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query with all rows but those of its own id.

    Vectors that are null, or hold a null or non-finite component, and rows without id take no part. Of repeated ids
    each row is a candidate; such a query is asked once, with the least of its vectors. Empty vectors score zero.
    A score beyond a long counts as the nearest long. Queries go to the tasks in blocks of a bounded size, one after
    the other, each with one pass over the candidates: the driver and a task hold one block. A task keeps the k best of
    each query, and the tasks' lists, which are written, are merged by a window of k rows for each task and query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = vectors.filter(is_query).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = written(asked.filter(F.col("id").isNotNull() & sound).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // query_block))
    at = new_dir(spark, "best")
    kinds = "query_id long, vec_id long, score long"
    for i in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        one = got.to_batches()[0] if got.num_rows else None
        block = quantized(one.column(0), one.column(1), scale) if one is not None else (np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
        shared = spark.sparkContext.broadcast(block)
        rows.mapInArrow(_search(shared, k, scale, candidate_block), kinds).write.mode("append").parquet(at)
        shared.destroy()
    out = spark.read.schema(kinds).parquet(at)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(shared, k: int, scale: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best = Best(len(query_ids), k)
        for b in batches:
            for at in range(0, b.num_rows, size):
                ids, block = quantized(b.column(0).slice(at, size), b.column(1).slice(at, size), scale)
                if len(ids):
                    search_block(query_ids, queries, ids, block, best)
        rows = [(int(q), i, -s) for q, found in zip(query_ids, best.of) for s, i in found]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def op4_maxscore(spark, sf_dir: str) -> DataFrame:
    """Rows without vec_id and vectors that are null or hold null or non-finite components take no part; see ``top_k`` for repeats."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
