"""Benchmark decontamination by SimHash of item-sized windows; DataFrame functions only.

A window of a document as long as an item is fingerprinted over its word shingles, and fingerprints meet the items' in
multi-index Hamming blocks: of radius + 1 blocks of bits two fingerprints within the radius agree on one, so an equality
join on (block, value) finds them all, for every window among all items of its size. What is joined are places and
fingerprints; the shingles of the pairs within the radius are fetched afterwards, and each pair is verified by their
exact weighted Jaccard similarity, weights being occurrences. Windows are built wherever an item can be: similarity s
of a window and an item of a and b shingles takes s (a + b) / (1 + s) shared ones, so only starts from which a window
has as many of some item's shingles, at any places, are built, and all of these are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shared import sent, written

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints may differ. Shingle sets of similarity 0.8 have a cosine of 0.89, an angle of 0.476 and
#: so 9.7 +- 2.9 differing bits of 64: more than 23 differ with probability 0.000002. Windows of fewer than 9 shingles
#: are of that similarity only if they are the item's own, with the same fingerprint.
RADIUS = 23
#: Rows of a side up to which it is sent to all tasks; beyond, both sides are shuffled.
SMALL_ROWS = 200_000
#: Windows of one document that are in one row before they are parted.
CHUNK = 1000


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; signs are left out, and null is no word."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """64-bit hashes of each k words in a row; of the whole if there are fewer; none without words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """A bit is 1 if it is set in over half of the hashes, repeats included."""
    def bit(b: Column) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("bigint")).cast("int"))
        return F.when(ones * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles: shared occurrences over all occurrences of either."""
    def occurrences(x: Column, s: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == s))

    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.array_intersect(a, b)
    both = F.when(once, F.size(shared)).otherwise(F.aggregate(shared, F.lit(0), lambda acc, s: acc + F.least(occurrences(a, s), occurrences(b, s))))
    return both / (F.size(a) + F.size(b) - both)


def _mask(block: int, blocks: int) -> int:
    lo, hi = 64 * block // blocks, 64 * (block + 1) // blocks
    m = ((1 << (hi - lo)) - 1) << lo
    return m - (1 << 64) if m >= 1 << 63 else m


def _blocks(fp: Column, blocks: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), fp.bitwiseAND(F.lit(_mask(i, blocks)).cast("bigint")).alias("value")) for i in range(blocks)]))


def _first_shared(a: Column, b: Column, blocks: int) -> Column:
    """The first block on which two fingerprints agree: a pair counts there only."""
    cases = F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(_mask(0, blocks)).cast("bigint")) == 0, 0)
    return reduce(lambda c, i: c.when(a.bitwiseXOR(b).bitwiseAND(F.lit(_mask(i, blocks)).cast("bigint")) == 0, i), range(1, blocks), cases)


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(key, item_key, start_word, n_words, distance, similarity): each document's best window for each item of similarity ``least`` or more.

    Items without words match nothing, as do documents without; items of fewer than ``shingle`` words are one shingle
    of all of them. A document shorter than an item is one window. Ties go to the first window. Repeated rows of
    documents are one row of the result, null keys are kept, and repeated items count each under its key. The
    shingles of the items and the list of documents that share one are broadcast only after a count of them.
    """
    it = items.select(F.col(item_key).alias("item"), words_of(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    it = it.select("item", F.size("w").alias("n"), F.least(F.size("w"), F.lit(shingle)).alias("k"), "w")
    short = [r[0] for r in it.filter(F.col("k") < shingle).select("k").distinct().collect()]  # fewer than ``shingle`` values
    sizes = sorted({*short, shingle})

    def per_size(make) -> Column:
        return reduce(lambda c, k: c.when(F.col("k") == k, make(k)), sizes[1:], F.when(F.col("k") == sizes[0], make(sizes[0])))

    it = written(it.withColumn("s", per_size(lambda k: shingles_of(F.col("w"), k))).select("item", "n", "k", "s", simhash(F.col("s")).alias("fp")), "items")
    one_per_key = it.select("item", "n", "k", F.size("s").alias("m")).distinct().withColumn("kind", F.xxhash64("item", "n", "k"))
    grams = written(it.select(F.xxhash64("item", "n", "k").alias("kind"), "k", F.explode("s").alias("h")).distinct(), "item-shingles")
    kinds = written(one_per_key.groupBy("kind").agg(F.first("item").alias("item"), F.first("n").alias("n"), F.first("k").alias("k"), F.min("m").alias("m")), "item-sizes")

    base = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), F.col(text).cast("string")).alias("uid"), F.col(text).alias("t"))
    worded = base.select("uid", words_of(F.col("t")).alias("w"))
    hits = None
    for k in sizes:
        # Outer, as of others the optimizer also asks whether they are empty, by doing the work twice.
        found = worded.select("uid", F.size("w").alias("words"), F.posexplode_outer(shingles_of(F.col("w"), k)).alias("pos", "h"))
        found = found.join(sent(grams.filter(F.col("k") == k).drop("k"), small_rows), "h").select("uid", "kind", "words", "pos")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("uid", "kind").agg(F.first("words").alias("words"), F.sort_array(F.collect_set("pos")).alias("p")).join(sent(kinds, small_rows), "kind")
    span = F.least("words", "n")
    hits = hits.withColumn("size", F.when(span >= F.col("k"), span - F.col("k") + 1).otherwise(1))  # shingles of a window
    hits = hits.withColumn("need", F.ceil(least * (F.col("m") + F.col("size")) / (1 + least) - 1e-9).cast("int")).filter(F.size("p") >= F.col("need"))

    def starts_at(i: Column) -> Column:
        first, last = F.get("p", i), F.get("p", i + F.col("need") - 1)
        some = F.sequence(F.greatest(last - F.col("size") + 1, F.lit(0)), F.least(first, F.greatest(F.col("words") - F.col("n"), F.lit(0))))
        return F.when(last - first < F.col("size"), some).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), starts_at)))
    # A start that several items of a size ask for is one window.
    hits = hits.select("uid", "n", "k", "size", starts.alias("starts")).filter(F.size("starts") > 0)
    hits = written(hits.groupBy("uid", "n", "k", "size").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "windows")
    per_doc = hits.groupBy("uid").agg(F.collect_list(F.struct("n", "k", "size", "starts")).alias("wanted"))

    near = base.join(sent(per_doc, small_rows), "uid")
    near = near.select("doc", "uid", words_of(F.col("t")).alias("w"), F.explode_outer("wanted").alias("x")).select("doc", "uid", "w", "x.*")
    near = near.withColumn("s", per_size(lambda k: shingles_of(F.col("w"), k))).drop("w")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("starts") - 1) / CHUNK).cast("int")), lambda c: F.slice("starts", c * CHUNK + 1, CHUNK))
    near = near.select("doc", "uid", "n", "k", "size", "s", F.explode_outer(chunks).alias("chunk"))
    cut = F.transform("chunk", lambda x: F.struct(x.alias("start"), F.slice("s", x + 1, F.col("size")).alias("a")))
    near = near.select("doc", "uid", "n", "k", F.explode_outer(cut).alias("x")).select("doc", "uid", "n", "k", "x.*")
    near = written(near.withColumn("window_fp", simhash(F.col("a"))), "fingerprints")

    blocks, window = radius + 1, ["uid", "n", "k", "start"]
    left = near.select(*window, "window_fp").distinct().select("*", _blocks(F.col("window_fp"), blocks).alias("b")).select(*window, "window_fp", "b.*")
    right = it.select("item", "n", "k", "fp").distinct().select("*", _blocks(F.col("fp"), blocks).alias("b")).select("item", "n", "k", "fp", "b.*")
    pairs = left.join(sent(right, small_rows), ["n", "k", "block", "value"])
    pairs = pairs.filter(_first_shared(F.col("window_fp"), F.col("fp"), blocks) == F.col("block"))
    pairs = pairs.withColumn("distance", F.bit_count(F.col("window_fp").bitwiseXOR(F.col("fp")))).filter(F.col("distance") <= radius)
    pairs = written(pairs.select(*window, "item", "fp", "distance"), "within-radius")
    whole = it.select(F.col("item").alias("_item"), F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("fp").alias("_fp"), F.col("s").alias("b"))
    pairs = near.drop("window_fp").join(sent(pairs, small_rows), window)
    pairs = pairs.join(sent(whole, small_rows), F.col("item").eqNullSafe(F.col("_item")) & (F.col("n") == F.col("_n")) & (F.col("k") == F.col("_k")) & (F.col("fp") == F.col("_fp")))
    pairs = pairs.withColumn("similarity", similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n", "distance")).alias("best")
    out = pairs.groupBy("uid", "doc", "item").agg(best)
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), (-F.col("best.s")).alias("start_word"), F.col("best.n").alias("n_words"), F.col("best.distance").cast("int").alias("distance"), F.col("best.similarity").alias("similarity"))


def op6_simhash_windows(spark, sf_dir: str) -> DataFrame:
    """A row for each document and item that match; null and empty texts match nothing, repeated rows give one row, a null doc_id is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
