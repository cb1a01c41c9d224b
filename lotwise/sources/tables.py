"""Typed readers of measurement tables, and the synthetic tables mapped to them.

``traces``: one row for each sample, (experiment_key, lot_number, t, signals). ``dense``: one row for each wafer and
coordinate. ``sparse``: the second tool's points. ``spectra``: one array of intensities for each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DENSE_SCHEMA = T.StructType([
    T.StructField("experiment_key", T.StringType()), T.StructField("lot_number", T.IntegerType()), T.StructField("wafer_number", T.IntegerType()),
    *[T.StructField(x, T.DoubleType()) for x in ("X", "Y", "stepheight", "oxide_etch", "si_etch", "postox_thickness", "postox_thickness_nan")],
])
SPARSE_SCHEMA = T.StructType([
    T.StructField("experiment_key", T.StringType()), T.StructField("lot_number", T.IntegerType()),
    *[T.StructField(x, T.DoubleType()) for x in ("X", "Y", "stepheight", "oxide_etch", "si_etch")],
])
SIGNALS = ("rf", "gas_long", "gas_short")


def read_dense_csv(spark: SparkSession, path: str) -> DataFrame:
    """Point maps with a header; columns by name, typed, bad numbers fail the read."""
    return spark.read.schema(DENSE_SCHEMA).option("enforceSchema", "false").option("mode", "FAILFAST").csv(path, header=True)


def read_sparse_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPARSE_SCHEMA).option("enforceSchema", "false").option("mode", "FAILFAST").csv(path, header=True)


def _keyed(wafer: Column) -> list[Column]:
    lot = (wafer % 5 + 1).cast("int")
    return [lot.alias("lot_number"), F.concat(F.lit("2024-01-0"), lot.cast("string"), F.lit("_"), F.lpad(wafer.cast("string"), 6, "0")).alias("experiment_key")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces: a user is a wafer, time in hours."""
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("wafer"), *_keyed(F.col("user_id")),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("t"),
        F.col("value").alias("rf"),
        F.get_json_object("props", "$.k").cast("double").alias("gas_long"),
        (F.col("event_id") % 97).cast("double").alias("gas_short"),
    )


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1).cast("double")
    return li.select(F.col("l_suppkey").alias("wafer"), *_keyed(F.col("l_suppkey")), (F.col("l_linenumber") - 4).cast("double").alias("x"), y.alias("y"), "l_extendedprice", "l_quantity", "l_discount")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as point maps: a supplier is a wafer with 21 coordinates. Averages are rounded to 9 places, so ranks agree anywhere."""
    g = _points(spark, sf_dir).groupBy("wafer", "lot_number", "experiment_key", "x", "y")
    r = lambda c: F.round(c, 9)
    d = g.agg(
        r(F.avg("l_extendedprice") / 1000).alias("stepheight"), r(F.avg("l_quantity")).alias("oxide_etch"), r(F.avg("l_discount")).alias("postox_thickness"),
        F.count("*").alias("_n"),
    )
    return d.withColumn("postox_thickness_nan", F.when(F.col("_n") % 17 != 0, F.col("postox_thickness"))).withColumn("si_etch", r(F.col("stepheight") - F.col("postox_thickness"))).drop("_n")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second tool: medians at three columns of coordinates; every 13th wafer has no key."""
    p = _points(spark, sf_dir).filter(F.col("x").isin(-3.0, 0.0, 3.0))
    r = lambda c: F.round(c, 9)
    s = p.groupBy("wafer", "lot_number", "experiment_key", "x", "y").agg(r(F.median("l_extendedprice") / 1000).alias("stepheight"), r(F.median("l_quantity")).alias("oxide_etch"), r(F.median("l_discount")).alias("_p"))
    return s.withColumn("experiment_key", F.when(F.col("wafer") % 13 != 0, F.col("experiment_key"))).withColumn("si_etch", r(F.col("stepheight") - F.col("_p"))).drop("_p")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra: (wafer, lot_number, experiment_key, t, intensity array<double>), t spread over 700 hours."""
    from pyspark.sql import Window

    e = _table(spark, sf_dir, "embeddings")
    own = Window.partitionBy("label")
    t = (F.row_number().over(own.orderBy("vec_id")) - 1) * F.lit(700.0) / F.count("*").over(own)
    wafer = F.col("label").cast("long")
    return e.select(wafer.alias("wafer"), *_keyed(wafer), t.alias("t"), F.transform("embedding", lambda x: F.lit(1.0) + x.cast("double")).alias("intensity"))
