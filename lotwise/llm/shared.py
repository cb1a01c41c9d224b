"""What the operators share on the Spark side: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local run (tests) names none, a temporary folder of this machine is set instead; a cluster has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lotwise-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared one; it is removed when the driver ends."""
    at = f"{shared_dir(spark)}/lotwise-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def posix_path(uri: str) -> str:
    """The mounted path of a shared folder, for files that workers map into memory."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need spark.checkpoint.dir on a mounted file system, not {parts.scheme}://")
    return parts.path


@atexit.register
def _remove_written() -> None:
    for spark, at in _written:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may have ended before this
            return


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    at = new_dir(spark, tag)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def sent(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` to be sent to all tasks if a count finds at most ``most`` rows, else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges(a, b)`` of any orderable type, in any direction, repeats and loops allowed. Returns ``(node, root)`` for
    every node that has an edge to another, root being the smallest node of its component. Each round is two
    aggregations with map-side combine and two joins that adaptive execution may split; the edge table is written to
    the shared folder after each round.
    """

    def star(both: DataFrame, keep_larger: bool) -> DataFrame:
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(low, "a").filter(F.col("b") > F.col("a") if keep_larger else F.lit(True))
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not keep_larger:
            out = out.unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, tag)
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = written(star(large, False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
        if (after := state(now)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    root = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
