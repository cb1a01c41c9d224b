"""Results by content on any file system that Spark reads: digests made in tasks, notes and tables committed by rename (K3, K6)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task hashes, and that it holds at once.
PART, CHUNK = 64 << 20, 1 << 20
#: Schemes whose files tasks can open by themselves, in ranges; others are read by Spark, a file at a time.
OPENED = ("", "file", "hdfs", "s3", "gs")


def digest(df: DataFrame) -> str:
    """Of a frame's schema and rows, in any order and partitioning, repeats counted: one aggregate, no sort.

    Rows are hashed twice over all columns; the number, the sum and the exclusive or of the hashes are digested. The
    same rows written again have the same digest, so what depends on them is not run again.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    row = df.select(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols, F.lit(3)).alias("b"))
    r = row.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("s"), F.bit_xor("b").alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("t")).first()
    return hashlib.sha256(f"{df.schema.json()}:{r['n']}:{r['s']}:{r['x']}:{r['t']}".encode()).hexdigest()


def _open(path: str):
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")
    return where.open_input_file(at)


def _listed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, bytes), by the file list alone, which leaves empty files out."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))


def _unquoted(path: str) -> str:
    """Spark gives local paths as file:/a/b."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def file_hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, bytes, sha256, md5) of files: streamed in tasks, a file a task, a chunk at a time and of any length.

    Files of schemes that tasks can't open are read by Spark, whole, which bounds them to 2 GiB.
    """
    first = next(iter([paths] if isinstance(paths, str) else paths))
    if urlparse(str(first)).scheme not in OPENED:
        b = spark.read.format("binaryFile").load(paths)
        return b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))

    def hashed(batches):
        for g in batches:
            out = []
            for path, n in zip(g["path"], g["bytes"]):
                sha, md5 = hashlib.sha256(), hashlib.md5()
                with _open(_unquoted(path)) as f:
                    while part := f.read(CHUNK):
                        sha.update(part)
                        md5.update(part)
                out.append((path, n, sha.hexdigest(), md5.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "bytes", "sha256", "md5"])

    listed = _listed(spark, paths)
    return listed.repartition(max(1, min(listed.count(), 10_000)), "path").mapInPandas(hashed, "path string, bytes long, sha256 string, md5 string")


def tree_hashes(spark: SparkSession, paths: str | Sequence[str], part: int = PART) -> DataFrame:
    """(path, bytes, parts, root): the sha256 of the sha256s of a file's parts in their order, so that many tasks hash one file."""

    def hashed(batches):
        for g in batches:
            out = []
            for path, n, at in zip(g["path"], g["bytes"], g["at"]):
                h, left = hashlib.sha256(), part
                with _open(_unquoted(path)) as f:
                    f.seek(int(at))
                    while left and (some := f.read(min(CHUNK, left))):
                        h.update(some)
                        left -= len(some)
                out.append((path, n, at, h.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "bytes", "at", "sha256"])

    ranges = _listed(spark, paths).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(part).cast("long"))))
    parts = ranges.repartition("path", "at").mapInPandas(hashed, "path string, bytes long, at long, sha256 string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "sha256"))), lambda x: x["sha256"])
    return parts.groupBy("path", "bytes").agg(F.count("*").alias("parts"), F.sha2(F.array_join(ordered, ""), 256).alias("root"))


class Store:
    """Notes and tables under a folder of any Hadoop file system. What is there is whole: it is written aside and renamed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def _commit(self, aside: str, name: str) -> None:
        target = self._path(self.at(name))
        self.fs.mkdirs(target.getParent())
        if self.fs.exists(target):
            self.fs.delete(target, True)
        if not self.fs.rename(self._path(aside), target):
            raise OSError(f"could not commit {target}")

    def write_text(self, name: str, text: str) -> None:
        aside = self.at(f"_aside-{uuid.uuid4().hex}")
        out = self.fs.create(self._path(aside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._commit(aside, name)

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_table(self, name: str, df: DataFrame) -> DataFrame:
        """The frame as it is read back."""
        aside = self.at(f"_aside-{uuid.uuid4().hex}")
        df.write.parquet(aside)
        self._commit(aside, name)
        return self.read_table(name)

    def read_table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at(name))

    def table_digest(self, name: str) -> str | None:
        return digest(self.read_table(name)) if self.exists(name) else None
