"""Folds, bootstraps, enumerations (G1-G14). Draws come from md5, so they are the same on any engine and partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform_index(n: Column, *parts: Column) -> Column:
    """A draw from 0 to n - 1 by the md5 of the parts."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def uniform(*parts: Column) -> Column:
    """A draw from [0, 1) by the md5 of the parts."""
    return uniform_index(F.lit(1 << 32), *parts) / F.lit(float(1 << 32))


def leave_one_out(rows: DataFrame, lot: str = "lot_number") -> DataFrame:
    """Each row once for every lot that is held out, with held_out_lot and is_train. For statistics that cannot be subtracted."""
    folds = rows.select(F.col(lot).alias("held_out_lot")).distinct()
    return rows.crossJoin(F.broadcast(folds)).withColumn("is_train", F.col(lot) != F.col("held_out_lot"))


def nested_folds(lots: DataFrame, lot: str = "lot_number") -> DataFrame:
    """(outer, inner): every ordered pair of different lots."""
    a, b = lots.select(F.col(lot).alias("outer")).distinct(), lots.select(F.col(lot).alias("inner")).distinct()
    return a.join(F.broadcast(b), F.col("outer") != F.col("inner"))


def expanding_window(rows: DataFrame, least: int = 3, lot: str = "lot_number") -> DataFrame:
    """Rows of every earlier lot and of the test lot itself, for each lot that follows at least ``least`` others."""
    ranked = rows.select(F.col(lot).alias("test_lot")).distinct().withColumn("_rank", F.dense_rank().over(Window.orderBy("test_lot")))
    folds = ranked.filter(F.col("_rank") > least).drop("_rank")
    return rows.join(F.broadcast(folds), F.col(lot) <= F.col("test_lot")).withColumn("is_train", F.col(lot) < F.col("test_lot"))


def fit_calibrate_test(rows: DataFrame, least_fit: int = 2, lot: str = "lot_number") -> DataFrame:
    """Rows with test_lot and role: 'test', 'calibration' (the lot just before) or 'fit' (all before that)."""
    ranked = rows.select(lot).distinct().withColumn("_rank", F.dense_rank().over(Window.orderBy(lot)))
    tests = ranked.select(F.col(lot).alias("test_lot"), F.col("_rank").alias("_test")).filter(F.col("_test") > least_fit + 1)
    r = rows.join(F.broadcast(ranked), lot).join(F.broadcast(tests), F.col("_rank") <= F.col("_test"))
    role = F.when(F.col("_rank") == F.col("_test"), "test").when(F.col("_rank") == F.col("_test") - 1, "calibration").otherwise("fit")
    return r.withColumn("role", role).drop("_rank", "_test")


def expanding_mean(partials: DataFrame, by: Sequence[str], lot: str = "lot_number") -> Column:
    """The mean over earlier lots of frames of partials (_s, _n): a running sum, not a join."""
    past = Window.partitionBy(*by).orderBy(lot).rowsBetween(Window.unboundedPreceding, -1)
    return F.sum("_s").over(past) / F.sum("_n").over(past)


def cluster_bootstrap(lots: DataFrame, seed: int, replicates: int, numerator: str, denominator: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, replicate, statistic): in each replicate as many lots as there are, drawn with replacement.

    The statistic is the mean of ``numerator``, or with ``denominator`` the ratio of the sums of both over the lots
    drawn. ``lots`` has a row for each lot and group; lots are numbered by lot_number.
    """
    spark = lots.sparkSession
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    numbered = lots.withColumns({"_i": F.row_number().over(own.orderBy("lot_number")) - 1, "_n": F.count("*").over(own)})
    sizes = numbered.select(*by, "_n").distinct()
    draws = sizes.crossJoin(spark.range(replicates).select(F.col("id").alias("replicate"))).withColumn("_draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    draws = draws.withColumn("_i", uniform_index(F.col("_n"), F.lit(seed), F.col("replicate"), F.col("_draw"))).drop("_n", "_draw")
    drawn = draws.join(F.broadcast(numbered.drop("_n")), [*by, "_i"])
    stat = F.avg(numerator) if denominator is None else F.sum(numerator) / F.sum(denominator)
    return drawn.groupBy(*by, "replicate").agg(stat.alias("statistic"))


def bootstrap_interval(samples: DataFrame, by: Sequence[str] = (), value: str = "statistic") -> DataFrame:
    """(by, bootstrap_mean, p025, p975, probability_negative)."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    g = samples.groupBy(*by).agg(F.avg(value).alias("bootstrap_mean"), q.alias("_q"), F.avg((F.col(value) < 0).cast("double")).alias("probability_negative"))
    return g.select(*by, "bootstrap_mean", F.col("_q")[0].alias("p025"), F.col("_q")[1].alias("p975"), "probability_negative")


def simplex_grid(spark, components: int, denominator: int = 4) -> DataFrame:
    """(grid_index, weights): all tuples of non-negative multiples of 1/denominator that sum to one, in order."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("w"))
    for _ in range(components):
        rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(denominator)))).select(F.concat("w", F.array("x")).alias("w"))
        rows = rows.filter(F.aggregate("w", F.lit(0), lambda s, x: s + x) <= denominator)
    rows = rows.filter(F.aggregate("w", F.lit(0), lambda s, x: s + x) == denominator)
    return rows.select((F.row_number().over(Window.orderBy("w")) - 1).alias("grid_index"), F.transform("w", lambda x: x / F.lit(float(denominator))).alias("weights"))


def rankings(spark, size: int) -> DataFrame:
    """(permutation, position, item): every order of ``size`` items (8 at most)."""
    if not 1 <= size <= 8:
        raise ValueError("exact permutation analysis is restricted to at most 8 wafers")
    rows = [(i, list(p)) for i, p in enumerate(permutations(range(size)))]
    return spark.createDataFrame(rows, "permutation int, p array<int>").select("permutation", F.posexplode("p").alias("position", "item"))
