"""The operators as stages of one pipeline: each takes and returns documents, the last one returns packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, mixing, nearcopies, neighbours, packing
from lotwise.llm.shared import sent, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; others that a table may have are left out."""
    return df.select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """A key that tells rows of one id and rows without id apart, smallest id first."""
    return docs.withColumn("_key", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h")))


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under the threshold go. Labels of the held-out part are not learnt from.

    Null and empty texts are scored as the share of good examples; repeated rows fare alike; without labels all go.
    """
    docs = _documents(docs)
    scored = neighbours.classify(docs, neighbours.fit_quality(spark, docs.select("doc_id", "text"), sf_dir), list(COLUMNS))
    return _documents(scored.filter(F.col("score") >= neighbours.THRESHOLD))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of repeated rows one does.

    Near duplicates are linked by an exact Jaccard similarity of 0.8 over five-word shingles, unlike those of op1.
    """
    keyed = _keyed(_documents(docs))
    grouped = written(nearcopies.near_copies(keyed.select("_key", "text"), key="_key"), "near-copies")
    # Only the keys that go, and those of several rows, are met by the documents' rows.
    gone = grouped.filter(F.col("_key") != F.col("component_id")).select("_key").distinct()
    several = grouped.filter(F.col("_key") == F.col("component_id")).groupBy("_key").count().filter("count > 1").select("_key")
    gone, several = sent(written(gone, "gone")), sent(written(several, "repeated"))
    left = keyed.join(gone, "_key", "left_anti")
    once = left.join(several, "_key", "left_anti")
    return _documents(once.unionByName(left.join(several, "_key", "left_semi").dropDuplicates(["_key"])))


def decontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that matches a benchmark item go."""
    keyed = _keyed(_documents(docs))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = written(decontaminate.matches(keyed.select("_key", "text"), items, key="_key").select("_key").distinct(), "contaminated")
    return _documents(keyed.join(sent(found), "_key", "left_anti"))


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budgets of their domain, language and source take them.

    The last document of a leaf is cut to the words that its budget still takes, and is left out if these are none.
    Documents without words go where whole epochs of their leaf are taken or they stand before its end.
    """
    out = mixing.mix(mixing.with_tree(_documents(docs)))
    cut = F.col("take_tokens") < F.col("n_tokens")
    text = F.when(cut, mixing.first_tokens(F.col("text"), F.col("take_tokens"))).otherwise(F.col("text"))
    return _documents(out.withColumn("text", text).withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of all documents, each row as often as it is there; null and empty texts have none."""
    return packing.pack(_documents(docs).select("doc_id", "text")).withColumnRenamed("keys", "doc_ids")
