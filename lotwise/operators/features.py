"""Fixed-width features of segmented traces and of spectra, kept long."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.stats import mean_if, strict_pivot, unpivot
from lotwise.operators.segment import TraceSpec

STATISTICS = ("active_mean", "active_std", "active_range", "active_slope", "early_late_delta", "long_phase_mean", "short_phase_mean", "phase_difference", "cycle_mean_std", "cycle_mean_slope")
#: Which statistics a group of features holds.
FEATURE_GROUPS = {
    "G1_level": ("active_mean", "active_std", "active_range"),
    "G2_temporal_drift": ("active_slope", "early_late_delta"),
    "G3_bosch_phase": ("long_phase_mean", "short_phase_mean", "phase_difference"),
    "G4_cycle_behavior": ("cycle_mean_std", "cycle_mean_slope"),
}


def index_slope(value: str, order: Window, whole: Window) -> dict[str, Column]:
    """Columns for a least-squares slope over evenly spaced places from 0 to 1: aggregate with ``regr_slope(value, _x)``."""
    n = F.count(value).over(whole)
    return {"_x": (F.row_number().over(order) - 1) / F.when(n > 1, n - 1).cast("double")}


def trace_features(regions: DataFrame, signals: Sequence[str], spec: TraceSpec = TraceSpec()) -> DataFrame:
    """(key, feature, value), ten statistics of each signal named '<signal>__<statistic>'.

    Signals are rows, so any number of them is one plan: an aggregate by (trace, signal), and one more by cycle.
    """
    t, key = F.col(spec.time), spec.key
    keep = ["active", "long_phase", "short_phase", "cycle_index", "active_start", "active_end", spec.time]
    long = unpivot(regions.filter(F.col("active")), [key, *keep], list(signals), "signal", "value")
    span = F.col("active_end") - F.col("active_start")
    v = F.col("value")
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.95)))
    x = (t - F.col("active_start")) / F.when(span > 0, span)
    g = long.withColumn("_x", x).groupBy(key, "signal").agg(
        F.avg(v).alias("active_mean"), F.stddev_pop(v).alias("active_std"), q.alias("_q"), F.coalesce(F.regr_slope("value", "_x"), F.lit(0.0)).alias("active_slope"),
        (mean_if(v, t >= F.col("active_end") - 0.1 * span) - mean_if(v, t <= F.col("active_start") + 0.1 * span)).alias("early_late_delta"),
        mean_if(v, F.col("long_phase")).alias("long_phase_mean"), mean_if(v, F.col("short_phase")).alias("short_phase_mean"),
    )
    g = g.withColumns({"active_range": F.col("_q")[1] - F.col("_q")[0], "phase_difference": F.col("long_phase_mean") - F.col("short_phase_mean")}).drop("_q")
    c = long.filter("cycle_index >= 0").groupBy(key, "signal", "cycle_index").agg(F.avg(v).alias("m"))
    w = Window.partitionBy(key, "signal")
    c = c.withColumns(index_slope("m", w.orderBy("cycle_index"), w)).groupBy(key, "signal").agg(F.stddev_pop("m").alias("cycle_mean_std"), F.coalesce(F.regr_slope("m", "_x"), F.lit(0.0)).alias("cycle_mean_slope"))
    wide = g.join(c, [key, "signal"], "left")
    return wide.unpivot([key, "signal"], list(STATISTICS), "statistic", "value").select(key, F.concat_ws("__", "signal", "statistic").alias("feature"), "value")


def trace_diagnostics(regions: DataFrame, spec: TraceSpec = TraceSpec()) -> DataFrame:
    """One row for each trace: samples, steps and gaps, active duration, cycles, shares of the phases."""
    order = Window.partitionBy(spec.key).orderBy(spec.time)
    active_order = Window.partitionBy(spec.key, "active").orderBy(spec.time)
    t = F.col(spec.time)
    d = regions.withColumns({"_step": t - F.lag(spec.time).over(order), "_active_step": F.when(F.col("active"), t - F.lag(spec.time).over(active_order))})
    a = F.col("active")
    return d.groupBy(spec.key).agg(
        F.count("*").alias("samples"), F.median("_step").alias("median_step_seconds"), F.max("_step").alias("maximum_gap_seconds"), F.max("_active_step").alias("active_maximum_gap_seconds"),
        (F.first("active_end") - F.first("active_start")).alias("active_duration_seconds"), F.first("cycle_count").cast("long").alias("detected_cycles"),
        F.avg(F.when(a, F.col("long_phase").cast("double"))).alias("long_phase_sample_fraction"), F.avg(F.when(a, F.col("short_phase").cast("double"))).alias("short_phase_sample_fraction"),
    )


def wide_features(features: DataFrame, names: Sequence[str], key: str = "experiment_key") -> DataFrame:
    """One column for each feature; ValueError for repeated cells."""
    return strict_pivot(features, [key], "feature", "value", names)


def feature_vectors(features: DataFrame, key: str = "experiment_key") -> DataFrame:
    """(key, x array<double>) in the order of the feature names."""
    return features.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("x"))


def feature_group(name: Column) -> Column:
    """The group of a feature's statistic, what follows the last '__'; NULL for others."""
    pairs = F.create_map(*chain.from_iterable((F.lit(s), F.lit(g)) for g, stats in FEATURE_GROUPS.items() for s in stats))
    return F.try_element_at(pairs, F.substring_index(name, "__", -1))


def group_of(name: str) -> str | None:
    """As ``feature_group``, of one name."""
    return next((g for g, stats in FEATURE_GROUPS.items() if name.rsplit("__", 1)[-1] in stats), None)


#: Parts of lower-case signal names, and the family that the first one found stands for.
SENSOR_FAMILIES = (
    ("gas", "gas_or_backside_flow"), ("heliumbpflow", "gas_or_backside_flow"), ("pressure", "pressure"), ("heater", "heater_temperature"),
    ("rf", "rf_power_matching_electrical"), ("dcbias", "rf_power_matching_electrical"),
)
OTHER_FAMILY = "remaining_process_signals"


def sensor_family(name: Column, families: Sequence[tuple[str, str]] = SENSOR_FAMILIES) -> Column:
    """The family of a feature's signal, by the first part that occurs in what precedes the first '__'; else the rest."""
    low = F.lower(F.substring_index(name, "__", 1))
    out = None
    for part, family in families:
        out = F.when(low.contains(part), family) if out is None else out.when(low.contains(part), family)
    return out.otherwise(OTHER_FAMILY)


def family_of(name: str, families: Sequence[tuple[str, str]] = SENSOR_FAMILIES) -> str:
    """As ``sensor_family``, of one name."""
    low = name.split("__", 1)[0].lower()
    return next((family for part, family in families if part in low), OTHER_FAMILY)


def select_groups(features: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The features of some groups; ValueError for a group that is not there."""
    unknown = sorted(set(groups) - set(FEATURE_GROUPS))
    if unknown:
        raise ValueError(f"unknown feature groups: {unknown}")
    return features.filter(feature_group(F.col("feature")).isin(*groups))


def fuse(features: DataFrame, more: DataFrame, prefix: str) -> DataFrame:
    """Both feature sets as one, the second's names after ``prefix``."""
    return features.unionByName(more.withColumn("feature", F.concat(F.lit(prefix), F.col("feature"))))


def spectral_features(spectra: DataFrame, statistics: str = "raw", key: str = "experiment_key", values: str = "intensity") -> DataFrame:
    """(key, channel, statistics) of aligned spectra (active, early, late, long_phase, short_phase, cycle_index).

    'raw': active_mean, active_std, early_late_delta, long_phase_mean, short_phase_mean, phase_difference, cycle_mean_slope.
    'shape': each row over its sum first; active, early, late, long_phase, short_phase, cycle_slope.
    """
    d = spectra.filter("active")
    if statistics == "shape":
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
        d = d.withColumn("_t", F.greatest(total, F.lit(1e-12))).withColumn(values, F.transform(values, lambda x: x / F.col("_t")))
    flags = ["early", "late", "long_phase", "short_phase", "cycle_index"]
    e = d.select(key, *flags, F.posexplode(values).alias("channel", "v"))
    v = F.col("v")
    g = e.groupBy(key, "channel").agg(F.avg(v).alias("active_mean"), F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0))).alias("active_std"), *[mean_if(v, F.col(x)).alias(f"_{x}") for x in flags[:4]])
    c = e.filter("cycle_index >= 0").groupBy(key, "channel", "cycle_index").agg(F.avg(v).alias("m"))
    w = Window.partitionBy(key, "channel")
    c = c.withColumns(index_slope("m", w.orderBy("cycle_index"), w)).groupBy(key, "channel").agg(F.coalesce(F.regr_slope("m", "_x"), F.lit(0.0)).alias("_slope"))
    j = g.join(c, [key, "channel"], "left")
    if statistics == "shape":
        return j.select(key, "channel", F.col("active_mean").alias("active"), F.col("_early").alias("early"), F.col("_late").alias("late"), F.col("_long_phase").alias("long_phase"), F.col("_short_phase").alias("short_phase"), F.col("_slope").alias("cycle_slope"))
    return j.select(key, "channel", "active_mean", "active_std", (F.col("_late") - F.col("_early")).alias("early_late_delta"), F.col("_long_phase").alias("long_phase_mean"), F.col("_short_phase").alias("short_phase_mean"), (F.col("_long_phase") - F.col("_short_phase")).alias("phase_difference"), F.col("_slope").alias("cycle_mean_slope"))


def binned_channels(spectra: DataFrame, bin_size: int = 16, key: Sequence[str] = ("experiment_key", "t"), values: str = "intensity") -> DataFrame:
    """(key, bin, mean, center): channels averaged in bins; a ragged tail is dropped."""
    e = spectra.select(*key, F.size(values).alias("_n"), F.posexplode(values).alias("channel", "v")).filter(F.col("channel") < F.col("_n") - F.col("_n") % bin_size)
    return e.groupBy(*key, F.floor(F.col("channel") / bin_size).cast("int").alias("bin")).agg(F.avg("v").alias("mean"), F.avg(F.col("channel").cast("double")).alias("center"))


def preview(spectra: DataFrame, maximum_rows: int = 600, key: str = "experiment_key", time: str = "t", values: str = "intensity") -> DataFrame:
    """Every n-th row of each series, at most ``maximum_rows``, with its mean over channels (broadband)."""
    if maximum_rows < 1:
        raise ValueError("maximum_rows must be positive")
    w = Window.partitionBy(key)
    stride = F.ceil(F.count("*").over(w) / maximum_rows)
    d = spectra.withColumns({"_i": F.row_number().over(w.orderBy(time)) - 1, "_stride": stride}).filter("_i % _stride = 0")
    return d.drop("_i", "_stride").withColumn("broadband", F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def mean_spectrum(spectra: DataFrame, key: str = "experiment_key", values: str = "intensity") -> DataFrame:
    return spectra.select(key, F.posexplode(values).alias("channel", "v")).groupBy(key, "channel").agg(F.avg("v").alias("mean"))
