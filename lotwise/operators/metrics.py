"""Errors of maps, wafers and lots (A1-A25): two-level aggregates of point facts (keys, family, stage, x, y, observed, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.stats import safe_divide

KEYS = ("family", "stage", "experiment_key", "lot_number")


def error() -> Column:
    return F.col("predicted") - F.col("observed")


def wafer_errors(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """MAE, RMSE and mean error of each wafer and stage."""
    e = error()
    return points.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_error"))


def spatial_metrics(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fifteen metrics of each wafer and stage; points need ``zone``. A correlation of a constant map is NULL."""
    w = Window.partitionBy(*keys)
    p = points.withColumns({"_o": F.col("observed") - F.avg("observed").over(w), "_p": F.col("predicted") - F.avg("predicted").over(w), "_e": error()})
    c = F.col("_p") - F.col("_o")
    e, z = F.col("_e"), F.col("zone")
    zone = {n: F.avg(F.when(z == n, e)) for n in ("center", "middle", "edge")}
    so, sp = F.stddev_pop("observed"), F.stddev_pop("predicted")
    return p.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_error"), F.abs(F.avg(e)).alias("mean_shift_absolute_error"),
        F.avg(F.abs(c)).alias("residual_profile_mae"), F.sqrt(F.avg(c * c)).alias("residual_profile_rmse"),
        F.when((so > 1e-12) & (sp > 1e-12), F.corr("_p", "_o")).alias("profile_correlation"),
        *[x.alias(f"{n}_mean_error") for n, x in zone.items()], (zone["center"] - zone["edge"]).alias("center_edge_error"),
        (sp - so).alias("standard_deviation_error"), ((F.max("predicted") - F.min("predicted")) - (F.max("observed") - F.min("observed"))).alias("range_error"),
        F.max(F.abs(e)).alias("worst_point_error"), F.percentile(F.abs(e), F.lit(0.95)).alias("p95_absolute_error"),
    )


def residual_profiles(points: DataFrame, by: Sequence[str] = ("ablation",), key: str = "experiment_key") -> DataFrame:
    """(by, wafers, residual_profile_mae, residual_profile_rmse): means over wafers of how far a predicted map less its mean is from the observed one less its."""
    w = Window.partitionBy(*by, key)
    c = (F.col("predicted") - F.avg("predicted").over(w)) - (F.col("observed") - F.avg("observed").over(w))
    wafers = points.withColumn("_c", c).groupBy(*by, key).agg(F.avg(F.abs("_c")).alias("a"), F.sqrt(F.avg(F.col("_c") ** 2)).alias("r"))
    return wafers.groupBy(*by).agg(F.count("*").alias("wafers"), F.avg("a").alias("residual_profile_mae"), F.avg("r").alias("residual_profile_rmse"))


def coordinate_mae(points: DataFrame, by: Sequence[str] = ("family", "stage")) -> DataFrame:
    return points.groupBy(*by, "x", "y").agg(F.avg(F.abs(error())).alias("coordinate_mae"))


def stage_summary(wafers: DataFrame, values: Sequence[str], by: Sequence[str] = ("family", "stage")) -> DataFrame:
    """Wafer-macro means of ``values`` and lot-macro means, which are means of lot means."""
    wafer = wafers.groupBy(*by).agg(F.count("*").alias("wafers"), *[F.avg(v).alias(f"wafer_macro_{v}") for v in values])
    lots = wafers.groupBy(*by, "lot_number").agg(*[F.avg(v).alias(v) for v in values]).groupBy(*by).agg(F.count("*").alias("lots"), *[F.avg(v).alias(f"lot_macro_{v}") for v in values])
    return wafer.join(lots, list(by))


def best_lot_counts(wafers: DataFrame, family: str = "family", value: str = "mae") -> DataFrame:
    """(family, best_lots): in how many lots each has the least mean error; ties go to the first name, none is 0."""
    lots = wafers.groupBy(family, "lot_number").agg(F.avg(value).alias("_v"))
    wins = lots.groupBy("lot_number").agg(F.min_by(family, F.struct("_v", family)).alias(family)).groupBy(family).agg(F.count("*").alias("best_lots"))
    return wafers.select(family).distinct().join(wins, family, "left").select(family, F.coalesce("best_lots", F.lit(0)).alias("best_lots"))


def top_capture(wafers: DataFrame, error_: str, score: str, share: float = 0.2, by: Sequence[str] = (), key: str = "experiment_key") -> DataFrame:
    """(by, k, capture): which share of the k rows with the largest errors is among the k largest scores; ties by key."""
    w = Window.partitionBy(*by)
    k = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.count("*").over(w))).cast("int")
    r = wafers.withColumns({"_k": k, "_e": F.row_number().over(w.orderBy(F.desc(error_), key)), "_s": F.row_number().over(w.orderBy(F.desc(score), key))})
    both = (F.col("_e") <= F.col("_k")) & (F.col("_s") <= F.col("_k"))
    return r.groupBy(*by).agg(F.first("_k").alias("k"), (F.count_if(both) / F.first("_k")).alias("capture"))


def interval_coverage(points: DataFrame, std: str = "predicted_std", by: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    return points.groupBy(*by).agg(F.avg((F.abs(error()) <= z * F.col(std)).cast("double")).alias("raw_interval_coverage"))


def paired_improvements(lots: DataFrame, better: str, than: str, stage: str = "stage", value: str = "mae") -> DataFrame:
    """(lots, improved, relative_gain) of a stage over another, lot by lot."""
    p = lots.groupBy("lot_number").pivot(stage, [better, than]).agg(F.avg(value))
    return p.agg(F.count("*").alias("lots"), F.count_if(F.col(better) < F.col(than)).alias("improved"), (1 - safe_divide(F.avg(better), F.avg(than))).alias("relative_gain"))


def gain_gate(gain: Column, low: Column, lots: Column, least_gain: float = 0.05, least_lots: int = 7) -> Column:
    return F.when((gain >= least_gain) & (low > 0) & (lots >= least_lots), "PASS").when(gain <= 0, "FAIL").otherwise("QUALIFIED")


def lot_failure(points: DataFrame, lot: int, family: str) -> DataFrame:
    """One row for each wafer of a lot: means, true and predicted shifts against the template, errors by stage, their order."""
    p = points.filter((F.col("lot_number") == lot) & (F.col("family") == family))
    if not p.limit(1).count():
        raise ValueError(f"no predictions for lot {lot} and family {family}")
    at = lambda s, x: F.avg(F.when(F.col("stage") == s, x))
    g = p.groupBy("experiment_key").agg(
        at("template", F.col("observed")).alias("observed_mean"), at("template", F.col("predicted")).alias("template_mean"), at("mean_shift", F.col("predicted")).alias("_shifted"),
        *[at(s, F.abs(error())).alias(f"{s}_mae") for s in ("template", "mean_shift", "full_map")],
    )
    return g.select("experiment_key", F.element_at(F.split("experiment_key", "_"), -1).cast("int").alias("wafer_order"), "observed_mean", "template_mean", (F.col("observed_mean") - F.col("template_mean")).alias("true_shift"), (F.col("_shifted") - F.col("template_mean")).alias("predicted_shift"),
                    "template_mae", "mean_shift_mae", "full_map_mae", (F.col("template_mae") - F.col("full_map_mae")).alias("full_map_gain"))


def out_of_lot_z(features: DataFrame, keys: DataFrame, top: int = 12, key: str = "experiment_key") -> DataFrame:
    """(key, feature, z, rank): features of the given wafers against all others, the ``top`` with the largest |z|; a constant one has no z."""
    inside, outside = features.join(keys.select(key), key, "left_semi"), features.join(keys.select(key), key, "left_anti")
    s = outside.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = inside.join(s, "feature").withColumn("z", (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")))
    ranked = z.groupBy("feature").agg(F.max(F.abs("z")).alias("_a")).filter("_a is not null").orderBy(F.desc("_a"), "feature").limit(top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_a"), "feature")))
    return z.join(F.broadcast(ranked), "feature").select(key, "feature", "z", "rank")


def cumulative(errors: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "cumulative_error") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return errors.withColumn(out, F.sum(value).over(w))


def wafer_ordinal(wafers: DataFrame, lot: str = "lot_number", key: str = "experiment_key", out: str = "wafer_order") -> DataFrame:
    return wafers.withColumn(out, F.row_number().over(Window.partitionBy(lot).orderBy(key)))


def representative(wafers: DataFrame, value: str, key: str = "experiment_key") -> DataFrame:
    """(median_key, best_key, worst_key) by a value.

    The median row is looked for between approximate quantiles around it only: a thousandth of the rows are sorted.
    """
    quantiles = F.percentile_approx(value, F.array(F.lit(0.4995), F.lit(0.5005)), F.lit(10_000))
    ends = wafers.agg(F.count("*").alias("_n"), quantiles.alias("_q"), F.min_by(key, F.struct(value, key)).alias("best_key"), F.max_by(key, F.struct(value, key)).alias("worst_key"))
    ends = ends.select("_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), "best_key", "worst_key")
    near = wafers.select(F.col(value).alias("_v"), F.col(key).alias("_k")).crossJoin(ends.select("_lo", "_hi"))
    below = near.agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    r = near.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).withColumn("_r", F.row_number().over(Window.orderBy("_v", "_k")) - 1)
    r = r.crossJoin(below).crossJoin(ends.select("_n"))
    median = r.agg(F.max(F.when(F.col("_r") + F.col("_below") == F.floor(F.col("_n") / 2), F.col("_k"))).alias("median_key"))
    return median.crossJoin(ends.select("best_key", "worst_key"))


def stability_rollup(stability: DataFrame, top: int = 18) -> DataFrame:
    """(feature, feature_group, top_20_frequency, median_importance, positive_sign_fraction) of the features most often among the top."""
    g = stability.groupBy("feature", "feature_group").agg(F.avg(F.col("top_20").cast("double")).alias("top_20_frequency"), F.median("importance").alias("median_importance"), F.avg((F.col("coefficient_sign") > 0).cast("double")).alias("positive_sign_fraction"))
    return g.orderBy(F.desc("top_20_frequency"), F.desc("median_importance"), "feature").limit(top)


def symmetric_correlations(pairs: DataFrame, a: str = "score_a", b: str = "score_b", value: str = "spearman") -> DataFrame:
    """(score_a, score_b, mean): means over folds, both ways round."""
    both = pairs.select(a, b, value).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), value))
    return both.groupBy(a, b).agg(F.avg(value).alias("mean"))
