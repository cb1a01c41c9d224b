"""Split-conformal bounds and their coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_of(n: Column, nominal: Column) -> Column:
    return F.ceil((n + 1) * nominal).cast("int")


def bounds(scores: DataFrame, by: Sequence[str], score: str, nominals: Sequence[float]) -> DataFrame:
    """(by, nominal_coverage, bound, rank, attainable, resolution): the order statistic ceil((n + 1) c) of each group, n at most."""
    if not all(0 < c < 1 for c in nominals):
        raise ValueError("nominal_coverage must be in (0, 1)")
    g = scores.groupBy(*by).agg(F.array_sort(F.collect_list(score)).alias("_s")).withColumn("nominal_coverage", F.explode(F.array(*[F.lit(float(c)) for c in nominals])))
    n = F.size("_s")
    raw = rank_of(n, F.col("nominal_coverage"))
    g = g.withColumn("rank", F.least(raw, n)).withColumn("attainable", raw <= n).withColumn("resolution", 1.0 / (n + 1))
    return g.withColumn("bound", F.element_at("_s", F.col("rank"))).drop("_s")


def wafer_scores(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score): a wafer's largest absolute error, for bounds that hold for a whole map."""
    return points.groupBy(*keys).agg(F.max(F.abs(F.col("predicted") - F.col("observed"))).alias("score"))


def coverage(test_points: DataFrame, point_bounds: DataFrame, map_bounds: DataFrame, fold: str = "test_lot") -> DataFrame:
    """(fold, nominal_coverage, point_coverage, simultaneous_coverage, point_width, simultaneous_width) of a fold's test wafers."""
    e = F.abs(F.col("predicted") - F.col("observed"))
    p = test_points.join(point_bounds.select(fold, "x", "y", "nominal_coverage", F.col("bound").alias("_p")), [fold, "x", "y"])
    p = p.join(map_bounds.select(fold, "nominal_coverage", F.col("bound").alias("_m")), [fold, "nominal_coverage"])
    w = p.groupBy(fold, "nominal_coverage", "experiment_key").agg(F.avg((e <= F.col("_p")).cast("double")).alias("c"), F.bool_and(e <= F.col("_m")).alias("all"), F.avg(2 * F.col("_p")).alias("w"), F.first(2 * F.col("_m")).alias("mw"), F.count("*").alias("n"))
    return w.groupBy(fold, "nominal_coverage").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("point_coverage"), F.avg(F.col("all").cast("double")).alias("simultaneous_coverage"), (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("point_width"), F.avg("mw").alias("simultaneous_width"))


def gate(lots: DataFrame, tolerance: float = 0.05, stable: float = 0.7, fold: str = "test_lot") -> DataFrame:
    """(nominal_coverage, mean_point_coverage, stable_lot_fraction, passes): lots within the tolerance of their nominal coverage."""
    ok = F.col("point_coverage") >= F.col("nominal_coverage") - tolerance
    g = lots.groupBy("nominal_coverage").agg(F.avg("point_coverage").alias("mean_point_coverage"), F.avg(ok.cast("double")).alias("stable_lot_fraction"))
    return g.withColumn("passes", (F.col("mean_point_coverage") >= F.col("nominal_coverage") - tolerance) & (F.col("stable_lot_fraction") >= stable))


def uncertainty_gate(lots: DataFrame, bounds: DataFrame, baseline: DataFrame, shortfall: float = 0.05, most_width: float = 1.0, stable: float = 0.7, fold: str = "test_lot") -> DataFrame:
    """One row with the four checks of the intervals, at every nominal level, and PASS if all hold.

    Coverage of points and of whole maps falls short by at most ``shortfall``, on average and in the share ``stable`` of
    the lots; half the points' width is at most ``most_width`` of the baseline's error; every bound's rank is there.
    lots: see ``coverage``; bounds(nominal_coverage, attainable): of points and maps; baseline(fold, baseline_mae).
    """
    c = F.col("nominal_coverage") - shortfall
    within = (F.col("point_coverage") >= c) & (F.col("simultaneous_coverage") >= c)
    levels = lots.join(baseline.select(fold, "baseline_mae"), fold).groupBy("nominal_coverage").agg(
        F.avg("point_coverage").alias("point_coverage"), F.avg("simultaneous_coverage").alias("simultaneous_coverage"), F.avg(within.cast("double")).alias("stable"), F.avg(F.col("point_width") / 2 / F.col("baseline_mae")).alias("width"))
    reached = bounds.agg(F.bool_and("attainable").alias("levels_attainable"))
    checks = levels.agg(F.bool_and(within).alias("coverage_within_tolerance"), F.bool_and(F.col("width") <= most_width).alias("half_width_below_baseline"), F.bool_and(F.col("stable") >= stable).alias("stable_across_lots")).crossJoin(reached)
    names = ("coverage_within_tolerance", "half_width_below_baseline", "stable_across_lots", "levels_attainable")
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    return checks.select(*names, F.when(every, "PASS").otherwise("FAIL").alias("gate"))
