"""Segmentation of traces: active windows, phases, runs, edges, cycles, and what they tell of a detector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.stats import robust_absolute_z, with_quantiles
from lotwise.sources.shared import spread

DETECTORS = ("quantile", "complementary", "duration_filtered", "period_constrained")


@dataclass(frozen=True)
class TraceSpec:
    """Columns of a trace table and the parameters of detection, in units of ``time``."""

    key: str = "experiment_key"
    time: str = "t"
    power: str = "rf"
    long_gas: str = "gas_long"
    short_gas: str = "gas_short"
    minimum_phase: float = 0.5
    expected_period: float = 6.0
    edge_spacing: float = 3.0


def threshold(low: str, high: str) -> Column:
    """Half way between two quantiles."""
    return F.col(low) + 0.5 * (F.col(high) - F.col(low))


def normalized(x: Column, low: str, high: str) -> Column:
    """Between two quantiles as 0 to 1; 0 where they are the same."""
    scale = F.col(high) - F.col(low)
    return F.when(scale <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col(low)) / F.when(scale > 1e-12, scale))))


def with_active(traces: DataFrame, spec: TraceSpec = TraceSpec()) -> DataFrame:
    """Adds active_start, active_end and active: from the first to the last sample over the power threshold, all between included."""
    w = Window.partitionBy(spec.key)
    # Traces over all cores: the sorts of all windows that follow share a task's memory, and adaptive execution would join tasks by their bytes.
    d = with_quantiles(spread(traces, spec.key), spec.power, [spec.key], ["_low", "_high"])  # 5 % and 95 %
    d = d.withColumn("_hot", F.col(spec.power) > threshold("_low", "_high")).drop("_low", "_high")
    at = F.when(F.col("_hot"), F.col(spec.time))
    d = d.withColumns({"active_start": F.min(at).over(w), "active_end": F.max(at).over(w)}).drop("_hot")
    return d.withColumn("active", F.coalesce(F.col(spec.time).between(F.col("active_start"), F.col("active_end")), F.lit(False)))


def with_runs(df: DataFrame, flag: str, out: str, key: Sequence[str], time: str) -> DataFrame:
    """Adds a number for each run of equal ``flag`` in time order (gaps and islands)."""
    order = Window.partitionBy(*key).orderBy(time)
    change = F.when(F.col(flag) == F.lag(flag).over(order), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(order)).drop("_change")


def without_short_runs(df: DataFrame, flag: str, least: float, key: Sequence[str], time: str) -> DataFrame:
    """Clears runs whose last less first time is under ``least``."""
    d = with_runs(df, flag, "_run", key, time)
    w = Window.partitionBy(*key, "_run")
    return d.withColumn(flag, F.col(flag) & ((F.max(time).over(w) - F.min(time).over(w)) >= least)).drop("_run")


def with_phases(active: DataFrame, detector: str, spec: TraceSpec = TraceSpec()) -> DataFrame:
    """Adds long_phase and short_phase by one of the detectors."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown process-region detector: {detector}")
    gas, other = F.col(spec.long_gas), F.col(spec.short_gas)
    ends = ["_ll", "_lh", "_sl", "_sh"]
    d = with_quantiles(with_quantiles(active, spec.long_gas, [spec.key], ends[:2]), spec.short_gas, [spec.key], ends[2:])
    if detector == "quantile":
        return d.withColumns({"long_phase": F.col("active") & (gas > threshold("_ll", "_lh")), "short_phase": F.col("active") & (other > threshold("_sl", "_sh"))}).drop(*ends)
    d = d.withColumn("_longer", normalized(gas, "_ll", "_lh") >= normalized(other, "_sl", "_sh")).drop(*ends)
    d = d.withColumns({"long_phase": F.col("active") & F.col("_longer"), "short_phase": F.col("active") & ~F.col("_longer")})
    if detector in ("duration_filtered", "period_constrained"):
        for flag in ("long_phase", "short_phase"):
            d = without_short_runs(d, flag, spec.minimum_phase, [spec.key], spec.time)
        d = d.withColumn("_open", F.col("active") & ~F.col("long_phase") & ~F.col("short_phase"))
        d = d.withColumns({"long_phase": F.col("long_phase") | F.col("_open") & F.col("_longer"), "short_phase": F.col("short_phase") | F.col("_open") & ~F.col("_longer")}).drop("_open")
    return d.drop("_longer")


def debounced(edges: Column, spacing: float | Column) -> Column:
    """Of sorted times those more than ``spacing`` after the last one kept."""
    gap = spacing if isinstance(spacing, Column) else F.lit(spacing)
    empty = F.array().cast("array<double>")
    return F.aggregate(edges, empty, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.try_element_at(kept, F.lit(-1)) > gap), F.concat(kept, F.array(x))).otherwise(kept))


def with_kept_edges(df: DataFrame, edge: str, spacing: float, spec: TraceSpec = TraceSpec(), out: str = "kept_edge") -> DataFrame:
    """Adds whether a rising edge (``edge``: a boolean) stays when those not more than ``spacing`` after the last one kept go.

    An edge further than that from the edge before it always stays, so it starts a burst that is debounced by itself; a
    row meets the edges of its own burst up to itself, no row those of its trace. A trace whose edges all follow each
    other within ``spacing`` is one burst: its time, not its memory, then grows with the square of its edges.
    """
    mine = [spec.key, "_rises"]
    d = df.withColumn("_rises", F.coalesce(F.col(edge) & F.col(spec.time).isNotNull(), F.lit(False)))
    order = Window.partitionBy(*mine).orderBy(spec.time)
    start = F.col("_rises") & F.coalesce(F.col(spec.time) - F.lag(spec.time).over(order) > spacing, F.lit(True))
    d = d.withColumn("_start", start.cast("int")).withColumn("_burst", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = Window.partitionBy(*mine, "_burst").orderBy(spec.time).rowsBetween(Window.unboundedPreceding, 0)
    burst = F.collect_list(F.when(F.col("_rises"), F.col(spec.time).cast("double"))).over(upto)
    # The last time kept, and whether that is the time looked at now.
    none = F.struct(F.lit(None).cast("double").alias("last"), F.lit(False).alias("stays"))
    step = lambda s, x: F.when(s["last"].isNull() | (x - s["last"] > spacing), F.struct(x.alias("last"), F.lit(True).alias("stays"))).otherwise(F.struct(s["last"].alias("last"), F.lit(False).alias("stays")))
    return d.withColumn("_upto", burst).withColumn(out, F.col("_rises") & F.aggregate("_upto", none, step)["stays"]).drop("_rises", "_start", "_burst", "_upto")


def kept_times(spec: TraceSpec = TraceSpec()) -> Column:
    """The aggregate of a trace's kept edges: an array of times in order."""
    return F.array_sort(F.collect_list(F.when(F.col("kept_edge"), F.col(spec.time))))


def with_cycles(phased: DataFrame, detector: str, spec: TraceSpec = TraceSpec()) -> DataFrame:
    """Adds kept_edge (a rising edge that is kept starts a cycle here), cycle_count and cycle_index (-1 outside).

    All windows share the trace's partition; a sample holds no array of the trace's edges.
    """
    order, w = Window.partitionBy(spec.key).orderBy(spec.time), Window.partitionBy(spec.key)
    rising = F.col("long_phase") & ~F.lag("long_phase", 1, False).over(order)
    spacing = 0.5 * spec.expected_period if detector == "period_constrained" else spec.edge_spacing
    d = with_kept_edges(phased.withColumn("_edge", rising), "_edge", spacing, spec)
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    one = F.col("kept_edge").cast("int")
    d = d.withColumns({"_at": (F.sum(one).over(upto) - 1).cast("int"), "cycle_count": F.sum(one).over(w).cast("int")})
    return d.withColumn("cycle_index", F.when(F.col("active") & (F.col("_at") >= 0), F.col("_at")).otherwise(-1)).drop("_at", "_edge")


def detect_regions(traces: DataFrame, detector: str = "quantile", spec: TraceSpec = TraceSpec()) -> DataFrame:
    """The samples with active, phases, edges and cycles. All windows share one shuffle, by trace."""
    return with_cycles(with_phases(with_active(traces, spec), detector, spec), detector, spec)


def require_cycles(regions: DataFrame, spec: TraceSpec = TraceSpec()) -> None:
    """ValueError for a trace without an active window or with fewer than two cycles."""
    bad = regions.groupBy(spec.key).agg(F.max(F.col("active").cast("int")).alias("a"), F.max("cycle_count").alias("c")).filter("a = 0 or a is null or c < 2").first()
    if bad:
        raise ValueError("no active window was detected" if not bad["a"] else "fewer than two cycles were detected")


def phase_runs(regions: DataFrame, flag: str, spec: TraceSpec = TraceSpec()) -> DataFrame:
    """(key, run_start, run_end, duration) of each run of a phase; duration is last less first plus the trace's median step."""
    order = Window.partitionBy(spec.key).orderBy(spec.time)
    d = with_runs(regions, flag, "_run", [spec.key], spec.time).withColumn("_step", F.col(spec.time) - F.lag(spec.time).over(order))
    d = d.withColumn("_median", F.median("_step").over(Window.partitionBy(spec.key)))
    runs = d.filter(F.col(flag)).groupBy(spec.key, "_run").agg(F.min(spec.time).alias("run_start"), F.max(spec.time).alias("run_end"), F.first("_median").alias("_median"))
    return runs.withColumn("duration", F.col("run_end") - F.col("run_start") + F.col("_median")).drop("_run", "_median")


def run_summary(runs: DataFrame, prefix: str, key: str, value: str = "duration") -> DataFrame:
    """(key, prefix_count, _median_seconds, _p05_seconds, _p95_seconds); groups without rows are not there, see ``cycle_diagnostics``."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    g = runs.groupBy(key).agg(F.count(value).alias(f"{prefix}_count"), F.median(value).alias(f"{prefix}_median_seconds"), q.alias("_q"))
    return g.select(key, f"{prefix}_count", f"{prefix}_median_seconds", F.col("_q")[0].alias(f"{prefix}_p05_seconds"), F.col("_q")[1].alias(f"{prefix}_p95_seconds"))


def cycle_diagnostics(traces: DataFrame, detector: str, spec: TraceSpec = TraceSpec(), lot: str = "lot_number") -> DataFrame:
    """One row for each trace: the detector's overlaps and gaps, steps, edges and durations. A count without runs is 0, its quantiles NULL."""
    r = detect_regions(traces, detector, spec)
    t, order = F.col(spec.time), Window.partitionBy(spec.key).orderBy(spec.time)
    ci = F.when(F.col("cycle_index") >= 0, F.col("cycle_index"))
    d = r.withColumns({"_step": t - F.lag(spec.time).over(order), "_back": ci < F.last(ci, True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    both, none = F.col("long_phase") & F.col("short_phase"), F.col("active") & ~F.col("long_phase") & ~F.col("short_phase")
    n = F.count_if("active")
    base = d.groupBy(spec.key, lot).agg(
        F.first("active_start").alias("active_start_seconds"), F.first("active_end").alias("active_end_seconds"), F.first("cycle_count").cast("long").alias("detected_cycle_count"),
        F.count_if(both).alias("phase_overlap_samples"), (F.count_if(both) / n).alias("phase_overlap_fraction"),
        F.count_if(none).alias("uncovered_active_samples"), (F.count_if(none) / n).alias("uncovered_active_fraction"),
        F.max("_step").alias("maximum_timestamp_gap_seconds"), F.median("_step").alias("median_timestamp_step_seconds"),
        kept_times(spec).alias("edges"), (F.count_if("_back") == 0).alias("cycle_index_monotonic"),
    )
    first, last = F.try_element_at("edges", F.lit(1)), F.try_element_at("edges", F.lit(-1))
    inside = lambda e: e.between(F.col("active_start_seconds"), F.col("active_end_seconds"))
    base = base.withColumns({
        "active_duration_seconds": F.col("active_end_seconds") - F.col("active_start_seconds"), "first_edge_seconds": first, "last_edge_seconds": last,
        "first_edge_inside_active": inside(first), "last_edge_inside_active": inside(last), "detector": F.lit(detector),
        "_periods": F.when(F.size("edges") > 1, F.zip_with(F.slice("edges", F.lit(2), F.size("edges") - 1), F.slice("edges", F.lit(1), F.size("edges") - 1), lambda a, b: a - b)),
    })
    periods = base.select(spec.key, F.explode("_periods").alias("duration"))
    out = base.drop("edges", "_periods")
    for runs, prefix in ((phase_runs(r, "long_phase", spec), "long_phase"), (phase_runs(r, "short_phase", spec), "short_phase"), (periods, "cycle_period")):
        out = out.join(run_summary(runs, prefix, spec.key), spec.key, "left").withColumn(f"{prefix}_count", F.coalesce(f"{prefix}_count", F.lit(0)))
    return out


def detector_summary(diagnostics: DataFrame, detectors: Sequence[str] = DETECTORS, expected: int = 100, low: int = 95, high: int = 105) -> DataFrame:
    """One row for each detector; ``detector_order`` is its place in ``detectors``."""
    c = F.col("detected_cycle_count")
    order = F.array_position(F.array(*map(F.lit, detectors)), F.col("detector")) - 1
    return diagnostics.groupBy("detector").agg(
        F.count("*").alias("wafer_count"), F.median(c).alias("median_cycle_count"), F.min(c).alias("minimum_cycle_count"), F.max(c).alias("maximum_cycle_count"),
        F.count_if(~c.between(low, high)).alias("outside_95_105"), F.median(F.abs(c - expected)).alias("median_absolute_cycle_deviation"),
        F.avg("phase_overlap_fraction").alias("mean_phase_overlap_fraction"), F.avg("uncovered_active_fraction").alias("mean_uncovered_active_fraction"),
    ).withColumn("detector_order", order)


def selected_detector(summary: DataFrame) -> DataFrame:
    """(selected_detector): least in five keys, in their order."""
    keys = ("outside_95_105", "median_absolute_cycle_deviation", "mean_phase_overlap_fraction", "mean_uncovered_active_fraction", "detector_order")
    return summary.agg(F.min_by("detector", F.struct(*keys)).alias("selected_detector"))


def with_suspicion(diagnostics: DataFrame, low: int = 95, high: int = 105, anomaly: float = 3.5) -> DataFrame:
    """Adds phase_duration_anomaly_score (the larger robust |z| of the phases' median durations) and suspicious."""
    d = robust_absolute_z(robust_absolute_z(diagnostics, "long_phase_median_seconds", "_zl"), "short_phase_median_seconds", "_zs")
    d = d.withColumn("phase_duration_anomaly_score", F.greatest("_zl", "_zs")).drop("_zl", "_zs")
    flags = [~F.col("detected_cycle_count").between(low, high), F.col("phase_duration_anomaly_score") > anomaly, F.col("phase_overlap_fraction") > 0, F.col("uncovered_active_fraction") > 0, ~F.col("cycle_index_monotonic"), ~F.col("first_edge_inside_active"), ~F.col("last_edge_inside_active")]
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return d.withColumn("suspicious", out)


def lot_cycle_summary(suspect: DataFrame, lot: str = "lot_number") -> DataFrame:
    c = "detected_cycle_count"
    return suspect.groupBy(lot).agg(
        F.count("*").alias("wafer_count"), F.median(c).alias("median_cycle_count"), F.min(c).alias("minimum_cycle_count"), F.max(c).alias("maximum_cycle_count"),
        F.median("long_phase_median_seconds").alias("median_long_phase_seconds"), F.median("short_phase_median_seconds").alias("median_short_phase_seconds"),
        F.median("cycle_period_median_seconds").alias("median_cycle_period_seconds"), F.count_if("suspicious").alias("suspicious_wafers"),
    )


def exemplar_keys(suspect: DataFrame, key: str = "experiment_key") -> DataFrame:
    """(typical, fewest, most, anomalous): keys nearest to the median count, with the least and most cycles, and the largest anomaly; ties to the first key."""
    c = F.col("detected_cycle_count")
    d = suspect.crossJoin(F.broadcast(suspect.agg(F.median(c).alias("_m"))))
    return d.agg(
        F.min_by(key, F.struct(F.abs(c - F.col("_m")), F.col(key))).alias("typical"), F.min_by(key, F.struct(c, F.col(key))).alias("fewest"),
        F.min_by(key, F.struct(-c, F.col(key))).alias("most"), F.min_by(key, F.struct(-F.col("phase_duration_anomaly_score"), F.col(key))).alias("anomalous"),
    )
