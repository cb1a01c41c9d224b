"""Leave-one-lot-out templates and what is left of maps: shifts, residuals, calibrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.stats import r_squared

TARGETS = ("stepheight", "oxide_etch", "si_etch")


def mean_of_others(by: Sequence[str], own: str, sum_alias: str = "_s", count_alias: str = "_n") -> Column:
    """The mean over the groups of ``by`` without the row's ``own``; NULL if nothing else is there.

    For frames of partials (by, own, sum, count), a row for each of ``own``: the rows before and the rows after are
    added up, so nothing is subtracted and a large value of the row itself doesn't show in the mean of the others.
    """
    sides = [Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(own), F.desc(own))]
    total = lambda c: sum((F.coalesce(F.sum(c).over(w), F.lit(0)) for w in sides[1:]), F.coalesce(F.sum(c).over(sides[0]), F.lit(0)))
    return total(sum_alias) / F.when(total(count_alias) > 0, total(count_alias))


def with_targets(dense: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """One row for each point and target: (keys, target, observed)."""
    ids = [c for c in dense.columns if c not in targets]
    return dense.unpivot(ids, list(targets), "target", "observed")


def decompose(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds to points(experiment_key, lot_number, x, y, target, observed) the leave-one-lot-out template and its residual.

    template_prediction is the mean of the coordinate over the other lots, global_prediction that of all their points;
    mean_shift is the wafer's mean difference from the template, residual what is left. A coordinate that no other lot
    covers has a NULL template; ``require_coverage`` raises for it. All targets go through one job, and lots are
    aggregated first, so the cost does not grow with the number of lots.
    """
    by_xy = points.groupBy("target", x, y, "lot_number").agg(F.sum("observed").alias("_s"), F.count("observed").alias("_n"))
    template = by_xy.withColumn("template_prediction", mean_of_others(["target", x, y], "lot_number")).drop("_s", "_n")
    by_lot = by_xy.groupBy("target", "lot_number").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    overall = by_lot.withColumn("global_prediction", mean_of_others(["target"], "lot_number")).drop("_s", "_n")
    d = points.join(template, ["target", "lot_number", x, y]).join(overall, ["target", "lot_number"])
    wafer = Window.partitionBy("target", "experiment_key")
    d = d.withColumn("mean_shift", F.avg(F.col("observed") - F.col("template_prediction")).over(wafer))
    d = d.withColumn("template_plus_true_mean_shift", F.col("template_prediction") + F.col("mean_shift"))
    return d.withColumns({"residual": F.col("observed") - F.col("template_plus_true_mean_shift"), "outer_test_lot": F.col("lot_number")})


def require_coverage(decomposed: DataFrame) -> None:
    bad = decomposed.filter(F.col("template_prediction").isNull()).select("lot_number").first()
    if bad:
        raise ValueError(f"training lots do not cover all coordinates for held-out lot {bad[0]}")


def with_filled_flag(decomposed: DataFrame, raw: str = "postox_thickness_nan") -> DataFrame:
    return decomposed.withColumn("postox_value_was_filled", F.col(raw).isNull())


def wafer_summaries(decomposed: DataFrame) -> DataFrame:
    """One row for each target and wafer; needs postox_value_was_filled."""
    r = F.col("residual")
    return decomposed.groupBy("target", "experiment_key", "lot_number", "outer_test_lot").agg(
        F.avg("observed").alias("observed_mean"), F.avg("template_prediction").alias("template_mean"), F.first("mean_shift").alias("mean_shift"),
        F.avg(F.abs(r)).alias("residual_mae"), F.sqrt(F.avg(r * r)).alias("residual_rmse"), F.max(F.abs(r)).alias("maximum_absolute_residual"),
        F.sum(F.col("postox_value_was_filled").cast("long")).alias("postoxide_filled_points"),
    )


def lot_summaries(wafers: DataFrame) -> DataFrame:
    """One row for each target and lot; a deviation of a single wafer is 0."""
    return wafers.groupBy("target", "lot_number").agg(
        F.countDistinct("experiment_key").alias("wafers"), F.avg("mean_shift").alias("mean_shift_mean"), F.coalesce(F.stddev_samp("mean_shift"), F.lit(0.0)).alias("mean_shift_std"),
        F.avg("residual_rmse").alias("residual_rmse_mean"), F.coalesce(F.stddev_samp("residual_rmse"), F.lit(0.0)).alias("residual_rmse_std"),
        F.max("maximum_absolute_residual").alias("maximum_absolute_residual"), F.sum("postoxide_filled_points").alias("postoxide_filled_points"),
    )


def decomposition_summary(decomposed: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row for each target: R2 of the stages, errors by row, lot and wafer, and whether the template dominates."""
    e, s = F.abs(F.col("observed") - F.col("template_prediction")), F.abs(F.col("residual"))
    rows = decomposed.groupBy("target").agg(
        F.count("*").alias("rows"), F.countDistinct("experiment_key").alias("wafers"), F.countDistinct("lot_number").alias("lots"),
        r_squared("observed", "global_prediction").alias("global_r2"), r_squared("observed", "template_prediction").alias("template_r2"),
        r_squared("observed", "template_plus_true_mean_shift").alias("true_mean_shift_oracle_r2"),
        F.avg(e).alias("template_mae"), F.avg(s).alias("true_mean_shift_oracle_mae"), F.sum(F.col("postox_value_was_filled").cast("long")).alias("postoxide_filled_rows"),
    )
    lots = decomposed.groupBy("target", "lot_number").agg(F.avg(e).alias("e"), F.avg(s).alias("s")).groupBy("target").agg(F.avg("e").alias("template_lot_macro_mae"), F.avg("s").alias("true_mean_shift_oracle_lot_macro_mae"))
    wafers = decomposed.groupBy("target", "experiment_key").agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("rmse"), F.first("mean_shift").alias("shift"))
    wafers = wafers.groupBy("target").agg(F.avg("rmse").alias("wafer_residual_rmse_mean"), F.median("rmse").alias("wafer_residual_rmse_median"), F.stddev_samp("shift").alias("mean_shift_standard_deviation"))
    out = rows.join(lots, "target").join(wafers, "target")
    return out.withColumn("template_dominant", F.coalesce(F.col("template_r2") >= threshold, F.lit(False))).withColumn("template_dominance_threshold", F.lit(threshold))


def audit_r2(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(target, template_r2, oracle_r2) with the audit's oracle: the wafer's own mean plus the centred template."""
    d = decompose(points, x, y)
    own = Window.partitionBy("target", "experiment_key")
    d = d.withColumn("oracle", F.avg("observed").over(own) + F.col("template_prediction") - F.avg("template_prediction").over(own))
    return d.groupBy("target").agg(r_squared("observed", "template_prediction").alias("template_r2"), r_squared("observed", "oracle").alias("oracle_r2"))


def paired_tools(sparse: DataFrame, dense: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Points that both tools measured: (experiment_key, lot_number, x, y, target, sparse_value, dense_value)."""
    on = ["experiment_key", "x", "y"]
    s = sparse.filter(F.col("experiment_key").isNotNull()).unpivot(on, list(targets), "target", "sparse_value")
    d = dense.unpivot([*on, "lot_number"], list(targets), "target", "dense_value")
    return d.join(s, [*on, "target"])


def tool_bias(paired: DataFrame) -> DataFrame:
    """(target, paired_points, bias, mae, pearson) of sparse against dense."""
    diff = F.col("sparse_value") - F.col("dense_value")
    return paired.groupBy("target").agg(F.count("*").alias("paired_points"), F.avg(diff).alias("bias"), F.avg(F.abs(diff)).alias("mae"), F.corr("sparse_value", "dense_value").alias("pearson"))


def medians_of_others(values: DataFrame, by: Sequence[str], value: str, lot: str = "lot_number", order: str = "experiment_key") -> DataFrame:
    """(by, lot, offset): for each lot the median of the other lots' values; NULL values don't count, lots alone in a group are left out.

    One sort a group numbers the values, and those of each lot. The k-th of the others is at place k + j, j being the
    lot's own values before it: those that have fewer than k others before them. Two places a lot are looked up.
    """
    v = values.filter(F.col(value).isNotNull())
    group, own = Window.partitionBy(*by), Window.partitionBy(*by, lot)
    ordered = v.select(*by, lot, F.col(value).cast("double").alias("_v"), F.row_number().over(group.orderBy(value, lot, order)).alias("_p"), F.count("*").over(group).alias("_n"))
    ranked = ordered.withColumns({"_i": F.row_number().over(own.orderBy("_p")), "_m": F.count("*").over(own)})
    others = F.col("_n") - F.col("_m")
    ranked = ranked.filter(others > 0).withColumns({"_lo": F.floor((others + 1) / 2), "_hi": F.floor((others + 2) / 2)})
    ahead = F.col("_p") - F.col("_i")
    at = ranked.groupBy(*by, lot).agg(*[(F.first(k) + F.count_if(ahead < F.col(k))).alias(k) for k in ("_lo", "_hi")])
    places = at.select(*by, lot, F.explode(F.array("_lo", "_hi")).alias("_p"))
    return places.join(ordered.select(*by, "_p", "_v"), [*by, "_p"]).groupBy(*by, lot).agg(F.avg("_v").alias("offset"))


def median_calibration(paired: DataFrame) -> DataFrame:
    """(target, raw_lot_macro_mae, calibrated_lot_macro_mae, lots_improved, lots): each lot corrected by the coordinate
    medians of the other lots."""
    p = paired.withColumn("diff", F.col("sparse_value") - F.col("dense_value"))
    offset = medians_of_others(p, ["target", "x", "y"], "diff")
    c = p.join(offset, ["target", "lot_number", "x", "y"])
    lots = c.groupBy("target", "lot_number").agg(F.avg(F.abs("diff")).alias("raw"), F.avg(F.abs(F.col("diff") - F.col("offset"))).alias("calibrated"))
    return lots.groupBy("target").agg(F.avg("raw").alias("raw_lot_macro_mae"), F.avg("calibrated").alias("calibrated_lot_macro_mae"), F.count_if(F.col("calibrated") < F.col("raw")).alias("lots_improved"), F.count("*").alias("lots"))


def coordinate_zones(coordinates: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``zone``: center, middle or edge by thirds of the largest radius."""
    radius = F.sqrt(F.col(x) ** 2 + F.col(y) ** 2)
    top = coordinates.agg(F.max(radius).alias("_max"))
    share = F.when(F.col("_max") > 0, radius / F.col("_max")).otherwise(0.0)
    zone = F.when(share <= 1 / 3, "center").when(share <= 2 / 3, "middle").otherwise("edge")
    return coordinates.crossJoin(F.broadcast(top)).withColumn("zone", zone).drop("_max")
