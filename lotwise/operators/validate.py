"""Integrity predicates and audits (S2-S5, S7, V1-V14). Violations are counted in one pass and raised together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_finite(c: str) -> Column:
    x = F.col(c)
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def dense_violations(dense: DataFrame, targets: Sequence[str], key: str = "experiment_key", lot: str = "lot_number", x: str = "x", y: str = "y") -> DataFrame:
    """One row of counts: rows, null ids, repeated (wafer, x, y), non-finite values, distinct point counts, wafers of several lots."""
    missing = [c for c in (key, lot, x, y, *targets) if c not in dense.columns]
    if missing:
        raise ValueError(f"dense measurements are missing columns: {missing}")
    wrong = None
    for c in (x, y, *targets):
        wrong = not_finite(c) if wrong is None else wrong | not_finite(c)
    points = dense.groupBy(key, x, y).agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull() | F.col(lot).isNull()).alias("null_ids"), F.count_if(wrong).alias("non_finite"), F.min(lot).alias("lo"), F.max(lot).alias("hi"))
    wafers = points.groupBy(key).agg(F.sum("n").alias("rows"), F.sum("null_ids").alias("null_ids"), F.sum("non_finite").alias("non_finite"), F.sum(F.col("n") - 1).alias("repeated"), F.count("*").alias("points"), (F.min("lo") != F.max("hi")).alias("several"))
    return wafers.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("null_ids"), F.lit(0)).alias("null_ids"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated_points"),
        F.coalesce(F.sum("non_finite"), F.lit(0)).alias("non_finite"), F.countDistinct("points").alias("point_counts"), F.count_if("several").alias("wafers_in_several_lots"),
    )


def validate_dense(dense: DataFrame, targets: Sequence[str], **names: str) -> None:
    """ValueError for an empty table, null ids, repeated points, non-finite values, unequal point counts."""
    v = dense_violations(dense, targets, **names).first()
    for bad, what in ((not v["rows"], "dense measurements are empty"), (v["null_ids"], "dense measurements contain null identifiers"), (v["repeated_points"], "dense measurements contain duplicate coordinates"), (v["non_finite"], "dense measurements contain non-finite values"), (v["point_counts"] > 1, "wafers have different coordinate counts"), (v["wafers_in_several_lots"], "a wafer belongs to several lots")):
        if bad:
            raise ValueError(what)


def validate_features(features: DataFrame, key: str = "experiment_key", feature: str = "feature", value: str = "value") -> None:
    """ValueError for long features that are empty, have null or repeated keys, or non-finite values."""
    g = features.groupBy(key, feature).agg(F.count("*").alias("n"), F.count_if(not_finite(value)).alias("bad"))
    v = g.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("bad").alias("bad")).first()
    for bad, what in ((not v["rows"], "feature table has no columns"), (v["nulls"], "feature table contains null keys"), (v["repeated"], "feature table contains duplicate keys"), (v["bad"], "feature table contains non-finite values")):
        if bad:
            raise ValueError(what)


def ordered_maps(dense: DataFrame, keys: DataFrame, value: str, key: str = "experiment_key", lot: str = "lot_number", x: str = "x", y: str = "y") -> DataFrame:
    """(key, lot, map, coordinates): each wafer's values by (y, x), for the wafers of ``keys``; ValueError for repeated, missing or mixed points."""
    d = dense.join(keys.select(key).distinct(), key, "left_semi")
    rows = F.array_sort(F.collect_list(F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.col(value).alias("v"))))
    m = d.groupBy(key).agg(F.min(lot).alias(lot), F.max(lot).alias("_hi"), rows.alias("_p"))
    m = m.withColumn("map", F.transform("_p", lambda p: p["v"])).withColumn("coordinates", F.transform("_p", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    bad = m.agg(F.count_if(F.col(lot) != F.col("_hi")).alias("lots"), F.count_if(F.size(F.array_distinct("coordinates")) != F.size("coordinates")).alias("repeated"), F.countDistinct("coordinates").alias("grids")).first()
    if bad["lots"]:
        raise ValueError("a wafer belongs to several lots")
    if bad["repeated"]:
        raise ValueError("dense measurements contain duplicate coordinates")
    if bad["grids"] > 1:
        raise ValueError("wafer maps are incomplete")
    return m.drop("_hi", "_p")


def validate_traces(traces: DataFrame, signals: Sequence[str], key: str = "experiment_key", time: str = "t") -> None:
    """ValueError for missing signals, traces of fewer than two samples, and times that do not increase."""
    missing = sorted(set(signals) - set(traces.columns))
    if missing:
        raise ValueError(f"trace is missing phase-detection signals: {missing}")
    step = F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(time))
    bad = traces.withColumn("_s", step).groupBy(key).agg(F.count("*").alias("n"), F.min("_s").alias("s")).filter("n < 2 or s <= 0").first()
    if bad:
        raise ValueError("trace timestamps must be strictly increasing")


def reject_duplicates(df: DataFrame, key: str) -> None:
    bad = df.groupBy(key).count().filter("count > 1").first()
    if bad:
        raise ValueError(f"duplicate experiment key: {bad[0]}")


def measurement_audit(dense: DataFrame, sparse: DataFrame, key: str = "experiment_key") -> DataFrame:
    """(metric, value): rows, wafers, rows without key, paired wafers and rows, coordinates of either tool and those of sparse only, missing raw values."""
    keyed = sparse.filter(F.col(key).isNotNull())
    xy = ["x", "y"]
    only = sparse.select(*xy).distinct().join(dense.select(*xy).distinct(), xy, "left_anti")
    paired = keyed.join(dense.select(key, *xy), [key, *xy])
    d = dense.agg(F.count("*").alias("dense_rows"), F.countDistinct(key).alias("dense_wafers"), F.countDistinct(*xy).alias("dense_coordinates"), F.count_if(F.col("postox_thickness_nan").isNull()).alias("missing_raw_postoxide"), F.count_if(F.col("postox_thickness").isNull()).alias("missing_filled_postoxide"))
    s = sparse.agg(F.count("*").alias("sparse_rows"), F.countDistinct(key).alias("sparse_wafers"), F.count_if(F.col(key).isNull()).alias("sparse_rows_without_key"), F.countDistinct(*xy).alias("sparse_coordinates"))
    p = paired.agg(F.count("*").alias("paired_rows"), F.countDistinct(key).alias("paired_wafers"))
    o = only.agg(F.count("*").alias("coordinates_of_sparse_only"))
    wide = d.crossJoin(s).crossJoin(p).crossJoin(o)
    return wide.unpivot([], wide.columns, "metric", "value")


def formula_audit(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(tool, maximum_absolute_difference) of the step-height formula of each tool."""
    a = dense.agg(F.max(F.abs(F.col("stepheight") - F.col("postox_thickness") - F.col("si_etch"))).alias("maximum_absolute_difference")).withColumn("tool", F.lit("dense"))
    b = sparse.agg(F.max(F.abs(F.col("stepheight") - F.col("oxide_etch") - F.col("si_etch"))).alias("maximum_absolute_difference")).withColumn("tool", F.lit("sparse"))
    return a.unionByName(b).select("tool", "maximum_absolute_difference")


def process_audit(traces: DataFrame, signals: Sequence[str], key: str = "experiment_key", time: str = "t") -> DataFrame:
    """One row for each trace: samples, features, median and largest step, whether all values are finite."""
    wrong = None
    for c in signals:
        wrong = not_finite(c) if wrong is None else wrong | not_finite(c)
    d = traces.withColumn("_step", F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(time)))
    return d.groupBy(key).agg(F.count("*").alias("samples"), F.lit(len(signals)).cast("long").alias("features"), F.median("_step").alias("median_step_seconds"), F.max("_step").alias("maximum_gap_seconds"), (F.count_if(wrong) == 0).alias("all_finite"))


def wafers_by_date(traces: DataFrame, key: str = "experiment_key") -> DataFrame:
    return traces.select(key).distinct().groupBy(F.substring_index(key, "_", 1).alias("date")).agg(F.count("*").alias("wafers"))


def parsed_keys(groups: DataFrame, name: str) -> DataFrame:
    """Adds experiment_key, 'yyyy-MM-dd_WW' of 'Day_yyyy_MM_dd_Wafer_WW'; NULL for other names, see ``require_parsed``."""
    pattern = "^Day_(\\d{4})_(\\d{2})_(\\d{2})_Wafer_(\\d+)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return groups.withColumn("experiment_key", F.when(F.col(name).rlike(pattern), F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit("_"), part(4))))


def require_parsed(parsed: DataFrame, name: str) -> None:
    bad = parsed.filter(F.col("experiment_key").isNull()).select(name).first()
    if bad:
        raise ValueError(f"unexpected process group name: {bad[0]}")


def spectral_keys(groups: DataFrame, path: str, name: str) -> DataFrame:
    """Adds experiment_key of a day file 'Day_yyyy_MM_dd.*' and its group 'Wafer_WW'."""
    day, wafer = "Day_(\\d{4})_(\\d{2})_(\\d{2})(?:\\.[^/]*)?$", "^Wafer_(\\d+)$"
    ok = F.col(path).rlike(day) & F.col(name).rlike(wafer)
    date = F.concat_ws("-", *[F.regexp_extract(path, day, i) for i in (1, 2, 3)])
    return groups.withColumn("experiment_key", F.when(ok, F.concat(date, F.lit("_"), F.regexp_extract(name, wafer, 1))))


def decode(codes: DataFrame, dictionary: DataFrame, code: str = "code", value: str = "value") -> DataFrame:
    """Adds ``value`` to ``codes``; a code without entry gives NULL, see ``decode_violations``."""
    return codes.join(dictionary.select(code, value), code, "left")


def decode_violations(decoded: DataFrame, value: str = "value") -> DataFrame:
    """(rows, missing, non_finite) of a decoded table."""
    x = F.col(value)
    return decoded.agg(F.count("*").alias("rows"), F.count_if(x.isNull()).alias("missing"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("non_finite"))


def decode_array(codes: Column, dictionary: Column) -> Column:
    """Element-wise lookup of codes in an array of values; raises for a code outside of it."""
    return F.transform(codes, lambda c: F.element_at(dictionary, (c + 1).cast("int")))


def common_features(pairs: DataFrame, group: str = "group", feature: str = "feature") -> DataFrame:
    """(feature): those of every group, in order."""
    n = pairs.agg(F.countDistinct(group).alias("_groups"))
    g = pairs.groupBy(feature).agg(F.countDistinct(group).alias("_n"))
    return g.crossJoin(F.broadcast(n)).filter("_n = _groups").select(feature).orderBy(feature)


def schema_drift(pairs: DataFrame, group: str = "group", feature: str = "feature") -> DataFrame:
    """(feature, groups, is_common): how many groups have each feature."""
    n = pairs.agg(F.countDistinct(group).alias("_groups"))
    g = pairs.groupBy(feature).agg(F.countDistinct(group).alias("groups"))
    return g.crossJoin(F.broadcast(n)).select(feature, "groups", (F.col("groups") == F.col("_groups")).alias("is_common"))


def feature_set_sizes(pairs: DataFrame, group: str = "group", feature: str = "feature") -> DataFrame:
    """(features, groups): how many groups have so many features."""
    return pairs.groupBy(group).agg(F.countDistinct(feature).alias("features")).groupBy("features").agg(F.count("*").alias("groups"))


def lot_of_date(dense: DataFrame, traces: DataFrame, key: str = "experiment_key", lot: str = "lot_number") -> DataFrame:
    """(key, lot) of each trace by its date; ValueError if a date has several lots or none."""
    date = F.substring_index(key, "_", 1)
    m = dense.select(date.alias("date"), lot).distinct().groupBy("date").agg(F.min(lot).alias(lot), F.count("*").alias("n"))
    if m.filter("n > 1").limit(1).count():
        raise ValueError("a process date maps to several lots")
    out = traces.select(key, date.alias("date")).distinct().join(m.drop("n"), "date", "left")
    if out.filter(F.col(lot).isNull()).limit(1).count():
        raise ValueError("missing lot numbers for process wafers")
    return out.select(key, lot)


def missing_keys(a: DataFrame, b: DataFrame, key: str = "experiment_key") -> DataFrame:
    """(side, key): keys of one source that the other lacks."""
    one, two = a.select(key).distinct(), b.select(key).distinct()
    return one.join(two, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(two.join(one, key, "left_anti").select(F.lit("right").alias("side"), key))


def regular_duration(times: DataFrame, key: str = "experiment_key", time: str = "t") -> DataFrame:
    """(key, regular_duration): up to the last sample that follows within five median steps, so an isolated tail is left out."""
    order, w = Window.partitionBy(key).orderBy(time), Window.partitionBy(key)
    d = times.withColumn("_step", F.col(time) - F.lag(time).over(order))
    d = d.withColumn("_m", F.median("_step").over(w))
    return d.groupBy(key).agg((F.coalesce(F.max(F.when(F.col("_step") <= 5 * F.col("_m"), F.col(time))), F.min(time)) - F.min(time)).alias("regular_duration"))


def spectral_gate(spectra: DataFrame, trace_summary: DataFrame, expected_channels: int, key: str = "experiment_key", time: str = "t", values: str = "intensity", tolerance: float = 2.0) -> DataFrame:
    """One row for each spectrum series: times, rate, gaps, value range, coverage of the trace's active window, and whether all checks hold.

    trace_summary: (key, active_start, active_end, duration), times from the series' own start.
    """
    order = Window.partitionBy(key).orderBy(time)
    d = spectra.withColumn("_step", F.col(time) - F.lag(time).over(order))
    g = d.groupBy(key).agg(
        F.count("*").alias("time_count"), F.min(F.size(values)).alias("channels"), F.max(F.size(values)).alias("_channels"), F.min(F.array_min(values)).alias("minimum_value"), F.max(F.array_max(values)).alias("maximum_value"),
        F.median("_step").alias("median_step_seconds"), F.max("_step").alias("maximum_gap_seconds"), F.min("_step").alias("_least"), (F.max(time) - F.min(time)).alias("duration"),
    )
    j = g.join(trace_summary.select(key, F.col("duration").alias("trace_duration"), "active_start", "active_end"), key, "left")
    j = j.withColumns({
        "sampling_hertz": 1.0 / F.when(F.col("median_step_seconds") > 0, F.col("median_step_seconds")), "duration_difference": F.abs(F.col("duration") - F.col("trace_duration")),
        "channels_match": (F.col("channels") == expected_channels) & (F.col("_channels") == expected_channels), "active_window_covered": (F.col("active_start") >= -tolerance) & (F.col("active_end") <= F.col("duration") + tolerance),
    })
    ok = F.col("channels_match") & F.col("active_window_covered") & (F.col("duration_difference") <= tolerance) & (F.col("_least") > 0)
    return j.withColumn("passes_integrity_gate", F.coalesce(ok, F.lit(False))).drop("_channels", "_least")


def spacing_stats(axis: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """(key, median, minimum and maximum spacing) of an axis."""
    d = axis.withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(position)))
    return d.groupBy(key).agg(F.median("_d").alias("median_spacing"), F.min("_d").alias("minimum_spacing"), F.max("_d").alias("maximum_spacing"))


def with_target_flag(audit: DataFrame, dense: DataFrame, key: str = "experiment_key", out: str = "has_direct_89_point_target") -> DataFrame:
    """``audit`` with whether a wafer has a dense map: a semi-join's worth of keys is met, each once."""
    keys = dense.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return audit.join(keys, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))
