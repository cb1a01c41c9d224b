"""Documents to packed token ids: quality, near duplicates, decontamination, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.llm import stages
from lotwise.llm.shared import written

#: Each function takes (spark, docs, sf_dir); what it returns is written and read again as the next one's docs.
STAGES = [
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontaminated),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

#: Fingerprints, latent-semantic votes and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
