"""Intermediate tables in the folder that driver and executors share: lineage is cut, and a lost executor costs nothing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local run that names none gets a temporary folder of this machine, a cluster has to name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lotwise-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def removed(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _remove_all() -> None:
    for spark, at in _made:
        try:
            removed(spark, at)
        except Exception:  # the JVM may have ended before this
            return


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written now and read back; the table goes when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lotwise-{tag}-{uuid.uuid4().hex}"
    _made.append((spark, at))
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def new_dir(spark: SparkSession, tag: str) -> str:
    """A folder of files that workers map into memory, as its path; it goes when the driver ends. The shared folder has to be a mounted one."""
    at = f"{shared_dir(spark)}/lotwise-{tag}-{uuid.uuid4().hex}"
    parts = urlparse(at)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped tiles need spark.checkpoint.dir on a mounted file system, not {parts.scheme}://")
    _made.append((spark, at))
    os.makedirs(parts.path)
    return parts.path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over all cores, for groups whose work is out of proportion to their bytes: adaptive execution, which goes by bytes, would put them into few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
