"""Spelling variants: words one insertion, deletion or replacement apart, found by search schemes over an FM-index.

A word that differs by one letter agrees with its neighbour on one half: either the halves before the middle are equal
and the error is behind it, or the other way round. Each case is one search: the exact half is matched, and the other
one is gone over with one error allowed. The first case looks for words with a given beginning, so the vocabulary is cut
into ranges of its order, each with an index, and a word goes to those whose range can hold its half: one, but for
short halves that many words begin with. The second case is the first one of the mirrored words.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import fmindex
from lotwise.llm.shared import sent, written

RUN = re.compile("[a-zÀ-ÿ]+")
#: The least length and number of a word, and how many times as frequent its form has to be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Words and letters that one index has at most, and words that one task looks for in it.
SHARD_WORDS, SHARD_LETTERS, CHUNK = 16_384, 262_144, 65_536
#: Distinct words and letters that a task holds before it hands on its counts.
HELD_WORDS, HELD_LETTERS = 200_000, 4_000_000


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n): the maximal runs of Latin letters, A-Z lower-cased, of ``least_length`` code points that are there ``least_count`` times.

    Null texts have none; repeated rows count each. ``change(key, run)`` may alter a run, by the key as text (empty for
    null). Tasks hand on counts, not occurrences.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        letters = 0

        def counts() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if not t:
                    continue
                for w, n in Counter(RUN.findall(t.lower().decode("utf-8", "replace"))).items():
                    if len(w) >= least_length and (w := change(k, w) if change else w) and len(w) >= least_length:
                        if w not in held:
                            letters += len(w)
                        held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS or letters > HELD_LETTERS:
                    yield counts()
                    letters = 0
        if held:
            yield counts()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _ranges(vocabulary: DataFrame, parts: int) -> DataFrame:
    """(shard, key, n): the keys in ranges of their order, of ``SHARD_WORDS`` words and ``SHARD_LETTERS`` letters at most or one longer word."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words, letters = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            out = []
            for w in b.column(0).to_pylist():
                if words and (words == SHARD_WORDS or letters + len(w) > SHARD_LETTERS):
                    shard, words, letters = shard + 1, 0, 0
                words, letters = words + 1, letters + len(w)
                out.append(shard)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *b.columns], ["shard", "key", "n"])

    return vocabulary.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(numbered, "shard long, key string, n long")


def _routed(shards: DataFrame, cut: Callable[[int], int]) -> DataFrame:
    """(shard, key, n): every word for each shard whose range can hold words with its first ``cut`` letters.

    The bounds of the shards, two words each, come to the driver and go to the tasks.
    """
    bounds = sorted((r["low"], r["high"], r["shard"]) for r in shards.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())
    lows = [b[0] for b in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, to = [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                half = w[: cut(len(w))]
                for s in range(max(bisect_right(lows, half) - 1, 0), bisect_right(lows, half + "\U0010ffff")):
                    if bounds[s][1] >= half:
                        at.append(i)
                        to.append(bounds[s][2])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *[c.take(pa.array(at, pa.int64())) for c in b.columns]], ["shard", "key", "n"])

    return shards.select("key", "n").mapInArrow(route, "shard long, key string, n long")


def _half(mirrored: bool) -> Callable[[int], int]:
    """How many letters of a (mirrored) word of some length are matched exactly."""
    return (lambda m: m - m // 2) if mirrored else (lambda m: m // 2)


def near_pairs(patterns: list[str], words: list[str], mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word) numbers of one search; of the mirrored one without the pairs that the other search has."""
    half = _half(mirrored)
    a, b = fmindex.one_error(fmindex.Index(words), patterns, [half(len(p)) for p in patterns])
    if mirrored:
        other = np.fromiter((not words[j].endswith(patterns[i][half(len(patterns[i])) :]) for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
        a, b = a[other], b[other]
    return a, b


def _searched(vocabulary: DataFrame, mirrored: bool, parts: int, pairs: bool) -> DataFrame:
    turned = (lambda w: w[::-1]) if mirrored else (lambda w: w)
    keys = vocabulary.select((F.reverse("word") if mirrored else F.col("word")).alias("key"), "n")
    shards = written(_ranges(keys, parts), "ranges")
    queries = written(_routed(shards, _half(mirrored)), "routed")
    chunks = sent(queries.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    asked = queries.join(chunks, "shard").select("shard", F.pmod(F.xxhash64("key"), "chunks").cast("int").alias("chunk"), "key", "n")
    held = shards.join(chunks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "key", "n")
    kinds = "word string, near string" if pairs else "word string, n_near long, best_n long, best string"

    def search(q: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        patterns, words, n = q["key"].tolist(), w["key"].tolist(), w["n"].tolist()
        a, b = near_pairs(patterns, words, mirrored) if patterns and words else ([], [])
        if pairs:
            return pd.DataFrame([(turned(patterns[i]), turned(words[j])) for i, j in zip(a, b)], columns=["word", "near"])
        best: dict[int, tuple[int, int, str]] = {}
        for i, j in zip(a.tolist(), b.tolist()) if len(a) else ():
            count, x, y = best.get(i, (0, 0, ""))
            best[i] = (count + 1, *min((x, y), (-n[j], turned(words[j]))))
        return pd.DataFrame([(turned(p), *((c := best[i])[0], -c[1], c[2])) if i in best else (turned(p), 0, None, None) for i, p in enumerate(patterns)], columns=["word", "n_near", "best_n", "best"]).astype({"best_n": "Int64"})

    # A search is long for its bytes: by bytes, adaptive execution would put many into one task.
    n = max(2 * vocabulary.sparkSession.sparkContext.defaultParallelism, parts)
    by = ("shard", "chunk")
    return asked.repartition(n, *by).groupBy(*by).cogroup(held.repartition(n, *by).groupBy(*by)).applyInPandas(search, kinds)


def _parts(vocabulary: DataFrame) -> int:
    return max(1, -(-vocabulary.count() // SHARD_WORDS))


def pairs_of(vocabulary: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of the distinct words that are one error apart."""
    parts = _parts(vocabulary)
    return _searched(vocabulary, False, parts, True).unionByName(_searched(vocabulary, True, parts, True))


def variants(vocabulary: DataFrame, times: int = TIMES, most_rounds: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary(word, n) of distinct words.

    A word's form is the most frequent one of the words near it, the first in order of equal ones, if it is ``times`` as
    frequent; the root is where forms lead. Each form is more frequent by that factor, so chains are short, and roots
    come by pointer doubling. What is sent on of a word is its number of near words and the best of them, not pairs.
    An empty vocabulary has no rows.
    """
    vocabulary = written(vocabulary, "vocabulary")
    parts = _parts(vocabulary)
    found = _searched(vocabulary, False, parts, False).unionByName(_searched(vocabulary, True, parts, False))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))).alias("b"))
    is_form = -F.col("b.m") >= times * F.col("n")
    forms = vocabulary.join(best, "word").select("word", "n", "n_near", F.when(is_form, F.col("b.w")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n"))
    forms = written(forms, "forms")
    roots = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    else:
        raise RuntimeError(f"roots did not settle within {most_rounds} rounds")
    return forms.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_slips(key: str, run: str) -> str:
    """A run that lacks a code point where a hash of key and run says so."""
    h = zlib.crc32(f"{key}:{run}".encode())
    return run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """A row a word. Null texts have no words, a null id is empty text before the colon, repeated rows count each."""
    return variants(counted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), change=with_slips))


OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT)] || CAST(range(8) AS BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS tab),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
o AS (SELECT k, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY k, w),
h AS (SELECT w, n, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(k || ':' || w)), '..'), lambda s: CAST(CAST('0x' || s AS INTEGER) AS BIGINT)), lambda a, s: xor(a >> 8, tab[(xor(a, s) & 255) + 1])), 4294967295) AS h FROM o, crc),
c AS (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d AS a JOIN d AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d AS a JOIN v AS b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM d AS a JOIN v AS b ON a.rest = b.word),
q AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
b AS (SELECT p.word, min(near) AS near, any_value(q.m) AS m FROM p JOIN q ON p.word = q.word AND p.m = q.m GROUP BY p.word),
f AS (SELECT v.word, v.n, CAST(coalesce(q.n_near, 0) AS BIGINT) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.near END AS form, CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n FROM v LEFT JOIN q ON q.word = v.word LEFT JOIN b ON b.word = v.word),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""
