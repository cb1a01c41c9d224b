"""Queries over traces and spectra: segmentation, features, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import asof, features, segment
from lotwise.operators import validate as V
from lotwise.queries.registry import DENSE, SPECTRA, TRACES, big, dr6, query, r6, sql
from lotwise.sources import tables

SPEC = segment.TraceSpec()
SIGNALS = list(tables.SIGNALS)

ACTIVE = TRACES + """, q AS (SELECT experiment_key, quantile_cont(rf, 0.05) AS rl, quantile_cont(rf, 0.95) AS rh, quantile_cont(gas_long, 0.05) AS ll, quantile_cont(gas_long, 0.95) AS lh, quantile_cont(gas_short, 0.05) AS sl, quantile_cont(gas_short, 0.95) AS sh FROM traces GROUP BY experiment_key),
w AS (SELECT experiment_key, min(t) AS active_start, max(t) AS active_end FROM traces JOIN q USING (experiment_key) WHERE rf > rl + 0.5 * (rh - rl) GROUP BY experiment_key),
active AS (SELECT traces.*, active_start, active_end, coalesce(t BETWEEN active_start AND active_end, false) AS active, ll, lh, sl, sh,
  CASE WHEN lh - ll <= 1e-12 THEN 0 ELSE greatest(0, least(1, (gas_long - ll) / (lh - ll))) END >= CASE WHEN sh - sl <= 1e-12 THEN 0 ELSE greatest(0, least(1, (gas_short - sl) / (sh - sl))) END AS longer FROM traces JOIN q USING (experiment_key) LEFT JOIN w USING (experiment_key))"""
PHASES = {
    "quantile": ACTIVE + ", phases AS (SELECT *, active AND gas_long > ll + 0.5 * (lh - ll) AS long_phase, active AND gas_short > sl + 0.5 * (sh - sl) AS short_phase FROM active)",
    "complementary": ACTIVE + ", phases AS (SELECT *, active AND longer AS long_phase, active AND NOT longer AS short_phase FROM active)",
}


def _filtered(flag: str, source: str, out: str) -> str:
    return f"""{out}_r AS (SELECT *, sum(CASE WHEN {flag} = prev THEN 0 ELSE 1 END) OVER (PARTITION BY experiment_key ORDER BY t) AS run FROM (SELECT *, lag({flag}) OVER (PARTITION BY experiment_key ORDER BY t) AS prev FROM {source})),
{out} AS (SELECT * EXCLUDE (run, prev, {flag}), {flag} AND max(t) OVER (PARTITION BY experiment_key, run) - min(t) OVER (PARTITION BY experiment_key, run) >= 0.5 AS {flag} FROM {out}_r)"""


PHASES["duration_filtered"] = PHASES["complementary"].replace("phases AS", "both_phases AS") + ", " + _filtered("long_phase", "both_phases", "f1") + ", " + _filtered("short_phase", "f1", "f2") + """,
phases AS (SELECT * EXCLUDE (long_phase, short_phase), long_phase OR (active AND NOT long_phase AND NOT short_phase AND longer) AS long_phase, short_phase OR (active AND NOT long_phase AND NOT short_phase AND NOT longer) AS short_phase FROM f2)"""
PHASES["period_constrained"] = PHASES["duration_filtered"]


def cycles(detector: str) -> str:
    """The SQL of detect_regions: debouncing is a fold over the edges of a trace."""
    return PHASES[detector] + """, edge AS (SELECT experiment_key, t FROM (SELECT *, lag(long_phase, 1, false) OVER (PARTITION BY experiment_key ORDER BY t) AS prev FROM phases) WHERE long_phase AND NOT prev),
edges AS (SELECT experiment_key, list_reduce(list_prepend([]::DOUBLE[], list_transform(list(t ORDER BY t), lambda v: [v])), lambda a, v: CASE WHEN len(a) = 0 OR v[1] - a[-1] > 3.0 THEN a || v ELSE a END) AS edges FROM edge GROUP BY experiment_key),
regions AS (SELECT *, CASE WHEN active THEN len(list_filter(coalesce(edges, []), lambda e: e <= t)) - 1 ELSE -1 END AS cycle_index, len(coalesce(edges, [])) AS cycle_count FROM phases LEFT JOIN edges USING (experiment_key))"""


@query("active_window", sql(ACTIVE, f"SELECT experiment_key, {dr6('any_value(active_start)', 'active_start')}, {dr6('any_value(active_end)', 'active_end')}, count(*) FILTER (active) AS active_samples, count(*) AS samples FROM active GROUP BY experiment_key"))
def active_window(spark, sf):
    d = segment.with_active(tables.traces(spark, sf))
    return d.groupBy("experiment_key").agg(r6(F.first("active_start"), "active_start"), r6(F.first("active_end"), "active_end"), F.count_if("active").alias("active_samples"), F.count("*").alias("samples"))


def _phase_query(detector: str) -> None:
    @query(f"phase_masks_{detector}", sql(PHASES[detector], f"SELECT experiment_key, {dr6('t')}, active, long_phase, short_phase FROM phases"))
    def phase_masks(spark, sf):
        return segment.with_phases(segment.with_active(tables.traces(spark, sf)), detector).select("experiment_key", r6("t"), "active", "long_phase", "short_phase")

    @query(f"cycle_assignment_{detector}", sql(cycles(detector), f"SELECT experiment_key, {dr6('t')}, CAST(cycle_index AS BIGINT) AS cycle_index, CAST(cycle_count AS BIGINT) AS cycle_count FROM regions"))
    def cycle_assignment(spark, sf):
        return segment.detect_regions(tables.traces(spark, sf), detector).select("experiment_key", r6("t"), big("cycle_index"), big("cycle_count"))


for _d in segment.DETECTORS:
    _phase_query(_d)


@query("edge_debounce", sql(cycles("complementary"), f"SELECT experiment_key, CAST(len(edges) AS BIGINT) AS kept, {dr6('edges[1]', 'first_edge')}, {dr6('edges[-1]', 'last_edge')}, {dr6('list_sum(edges)', 'edge_sum')} FROM edges"))
def edge_debounce(spark, sf):
    d = segment.detect_regions(tables.traces(spark, sf), "complementary").filter("cycle_count > 0").groupBy("experiment_key").agg(segment.kept_times(SPEC).alias("e"))
    return d.select("experiment_key", big(F.size("e"), "kept"), r6(F.col("e")[0], "first_edge"), r6(F.element_at("e", -1), "last_edge"), r6(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), "edge_sum"))


def _runs(flag: str, name: str) -> str:
    return f"""{name}_m AS (SELECT experiment_key, median(s) AS m FROM (SELECT experiment_key, t - lag(t) OVER (PARTITION BY experiment_key ORDER BY t) AS s FROM regions) GROUP BY experiment_key),
{name}_i AS (SELECT *, sum(CASE WHEN {flag} = prev THEN 0 ELSE 1 END) OVER (PARTITION BY experiment_key ORDER BY t) AS run FROM (SELECT experiment_key, t, {flag}, lag({flag}) OVER (PARTITION BY experiment_key ORDER BY t) AS prev FROM regions)),
{name} AS (SELECT experiment_key, min(t) AS run_start, max(t) AS run_end, max(t) - min(t) + any_value(m) AS duration FROM {name}_i JOIN {name}_m USING (experiment_key) WHERE {flag} GROUP BY experiment_key, run)"""


@query("phase_run_durations", sql(cycles("complementary") + ", " + _runs("long_phase", "r"), f"SELECT experiment_key, {dr6('run_start')}, {dr6('run_end')}, {dr6('duration')} FROM r"))
def phase_run_durations(spark, sf):
    r = segment.phase_runs(segment.detect_regions(tables.traces(spark, sf), "complementary"), "long_phase")
    return r.select("experiment_key", r6("run_start"), r6("run_end"), r6("duration"))


def _summary(table: str, prefix: str) -> str:
    return f"SELECT experiment_key, count(*) AS {prefix}_count, median(duration) AS {prefix}_median_seconds, quantile_cont(duration, 0.05) AS {prefix}_p05_seconds, quantile_cont(duration, 0.95) AS {prefix}_p95_seconds FROM {table} GROUP BY experiment_key"


def diagnostics_sql(detector: str) -> str:
    return cycles(detector) + ", " + _runs("long_phase", "lr") + ", " + _runs("short_phase", "sr") + f""", pr AS (SELECT experiment_key, unnest(list_transform(range(2, len(edges) + 1), lambda i: edges[i] - edges[i - 1])) AS duration FROM edges),
ls AS ({_summary("lr", "long_phase")}), ss AS ({_summary("sr", "short_phase")}), ps AS ({_summary("pr", "cycle_period")}),
b AS (SELECT experiment_key, lot_number, any_value(active_start) AS active_start_seconds, any_value(active_end) AS active_end_seconds, any_value(active_end) - any_value(active_start) AS active_duration_seconds, CAST(any_value(cycle_count) AS BIGINT) AS detected_cycle_count,
  count(*) FILTER (long_phase AND short_phase) AS phase_overlap_samples, count(*) FILTER (long_phase AND short_phase) / count(*) FILTER (active) AS phase_overlap_fraction,
  count(*) FILTER (active AND NOT long_phase AND NOT short_phase) AS uncovered_active_samples, count(*) FILTER (active AND NOT long_phase AND NOT short_phase) / count(*) FILTER (active) AS uncovered_active_fraction,
  max(step) AS maximum_timestamp_gap_seconds, median(step) AS median_timestamp_step_seconds, any_value(edges)[1] AS first_edge_seconds, any_value(edges)[-1] AS last_edge_seconds, true AS cycle_index_monotonic
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY experiment_key ORDER BY t) AS step FROM regions) GROUP BY experiment_key, lot_number),
diagnostics AS (SELECT b.*, '{detector}' AS detector, first_edge_seconds BETWEEN active_start_seconds AND active_end_seconds AS first_edge_inside_active, last_edge_seconds BETWEEN active_start_seconds AND active_end_seconds AS last_edge_inside_active,
  coalesce(long_phase_count, 0) AS long_phase_count, long_phase_median_seconds, long_phase_p05_seconds, long_phase_p95_seconds, coalesce(short_phase_count, 0) AS short_phase_count, short_phase_median_seconds, short_phase_p05_seconds, short_phase_p95_seconds,
  coalesce(cycle_period_count, 0) AS cycle_period_count, cycle_period_median_seconds, cycle_period_p05_seconds, cycle_period_p95_seconds FROM b LEFT JOIN ls USING (experiment_key) LEFT JOIN ss USING (experiment_key) LEFT JOIN ps USING (experiment_key))"""


_DIAG = ["active_start_seconds", "active_end_seconds", "active_duration_seconds", "phase_overlap_fraction", "uncovered_active_fraction", "maximum_timestamp_gap_seconds", "median_timestamp_step_seconds", "first_edge_seconds", "last_edge_seconds", *[f"{p}_{s}_seconds" for p in ("long_phase", "short_phase", "cycle_period") for s in ("median", "p05", "p95")]]
_DIAG_N = ["detected_cycle_count", "phase_overlap_samples", "uncovered_active_samples", "long_phase_count", "short_phase_count", "cycle_period_count"]
_DIAG_B = ["first_edge_inside_active", "last_edge_inside_active", "cycle_index_monotonic"]


@query("cycle_diagnostics", sql(diagnostics_sql("quantile"), "SELECT experiment_key, lot_number, detector, " + ", ".join([*map(dr6, _DIAG), *[f"CAST({c} AS BIGINT) AS {c}" for c in _DIAG_N], *_DIAG_B]) + " FROM diagnostics"))
def cycle_diagnostics(spark, sf):
    d = segment.cycle_diagnostics(tables.traces(spark, sf), "quantile")
    return d.select("experiment_key", "lot_number", "detector", *map(r6, _DIAG), *map(big, _DIAG_N), *_DIAG_B)


def all_diagnostics(spark, sf):
    t = tables.traces(spark, sf)
    out = None
    for d in segment.DETECTORS:
        one = segment.cycle_diagnostics(t, d)
        out = one if out is None else out.unionByName(one)
    return out


_SUMMARY = f"SELECT detector, count(*) AS wafer_count, {dr6('median(detected_cycle_count)', 'median_cycle_count')}, min(detected_cycle_count) AS minimum_cycle_count, max(detected_cycle_count) AS maximum_cycle_count, count(*) FILTER (NOT detected_cycle_count BETWEEN 95 AND 105) AS outside_95_105, {dr6('median(abs(detected_cycle_count - 100))', 'median_absolute_cycle_deviation')}, {dr6('avg(phase_overlap_fraction)', 'mean_phase_overlap_fraction')}, {dr6('avg(uncovered_active_fraction)', 'mean_uncovered_active_fraction')} FROM ({{}}) GROUP BY detector"


@query("detector_comparison", " UNION ALL ".join(_SUMMARY.format(sql(diagnostics_sql(d), "SELECT * FROM diagnostics")) for d in segment.DETECTORS))
def detector_comparison(spark, sf):
    s = segment.detector_summary(all_diagnostics(spark, sf))
    return s.select("detector", "wafer_count", r6("median_cycle_count"), "minimum_cycle_count", "maximum_cycle_count", "outside_95_105", r6("median_absolute_cycle_deviation"), r6("mean_phase_overlap_fraction"), r6("mean_uncovered_active_fraction"))


_KEYS = "count(*) FILTER (NOT detected_cycle_count BETWEEN 95 AND 105) AS a, median(abs(detected_cycle_count - 100)) AS b, avg(phase_overlap_fraction) AS c, avg(uncovered_active_fraction) AS d"


@query("selected_detector", "SELECT arg_min(detector, (a, b, c, d, place)) AS selected_detector FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS detector, {i} AS place, {_KEYS} FROM ({sql(diagnostics_sql(d), 'SELECT * FROM diagnostics')})" for i, d in enumerate(segment.DETECTORS)) + ")")
def selected_detector(spark, sf):
    return segment.selected_detector(segment.detector_summary(all_diagnostics(spark, sf)))


def _z(c: str) -> str:
    return f"CASE WHEN (SELECT median(abs({c} - (SELECT median({c}) FROM diagnostics))) FROM diagnostics) <= 1e-12 THEN 0.0 ELSE abs({c} - (SELECT median({c}) FROM diagnostics)) / (1.4826 * (SELECT median(abs({c} - (SELECT median({c}) FROM diagnostics))) FROM diagnostics)) END"


SUSPECT = diagnostics_sql("complementary") + f", z AS (SELECT *, greatest({_z('long_phase_median_seconds')}, {_z('short_phase_median_seconds')}) AS phase_duration_anomaly_score FROM diagnostics), suspect AS (SELECT *, coalesce(NOT detected_cycle_count BETWEEN 95 AND 105, false) OR coalesce(phase_duration_anomaly_score > 3.5, false) OR coalesce(phase_overlap_fraction > 0, false) OR coalesce(uncovered_active_fraction > 0, false) OR coalesce(NOT first_edge_inside_active, false) OR coalesce(NOT last_edge_inside_active, false) AS suspicious FROM z)"


def suspect(spark, sf):
    return segment.with_suspicion(segment.cycle_diagnostics(tables.traces(spark, sf), "complementary"))


@query("suspicious_traces", sql(SUSPECT, f"SELECT experiment_key, lot_number, detected_cycle_count, {dr6('phase_duration_anomaly_score')}, suspicious FROM suspect"))
def suspicious_traces(spark, sf):
    return suspect(spark, sf).select("experiment_key", "lot_number", "detected_cycle_count", r6("phase_duration_anomaly_score"), "suspicious")


@query("lot_cycle_summary", sql(SUSPECT, f"SELECT lot_number, count(*) AS wafer_count, {dr6('median(detected_cycle_count)', 'median_cycle_count')}, min(detected_cycle_count) AS minimum_cycle_count, max(detected_cycle_count) AS maximum_cycle_count, {dr6('median(long_phase_median_seconds)', 'median_long_phase_seconds')}, {dr6('median(short_phase_median_seconds)', 'median_short_phase_seconds')}, {dr6('median(cycle_period_median_seconds)', 'median_cycle_period_seconds')}, count(*) FILTER (suspicious) AS suspicious_wafers FROM suspect GROUP BY lot_number"))
def lot_cycle_summary(spark, sf):
    s = segment.lot_cycle_summary(suspect(spark, sf))
    return s.select("lot_number", "wafer_count", r6("median_cycle_count"), "minimum_cycle_count", "maximum_cycle_count", r6("median_long_phase_seconds"), r6("median_short_phase_seconds"), r6("median_cycle_period_seconds"), "suspicious_wafers")


@query("exemplar_keys", sql(SUSPECT, "SELECT arg_min(experiment_key, (abs(detected_cycle_count - (SELECT median(detected_cycle_count) FROM suspect)), experiment_key)) AS typical, arg_min(experiment_key, (detected_cycle_count, experiment_key)) AS fewest, arg_min(experiment_key, (-detected_cycle_count, experiment_key)) AS most FROM suspect"))
def exemplar_keys(spark, sf):
    return segment.exemplar_keys(suspect(spark, sf)).drop("anomalous")


@query("process_audit_steps", sql(TRACES + ", s AS (SELECT *, t - lag(t) OVER (PARTITION BY experiment_key ORDER BY t) AS step FROM traces)", f"SELECT experiment_key, count(*) AS samples, CAST(3 AS BIGINT) AS features, {dr6('median(step)', 'median_step_seconds')}, {dr6('max(step)', 'maximum_gap_seconds')}, true AS all_finite FROM s GROUP BY experiment_key"))
def process_audit_steps(spark, sf):
    return V.process_audit(tables.traces(spark, sf), SIGNALS).select("experiment_key", "samples", "features", r6("median_step_seconds"), r6("maximum_gap_seconds"), "all_finite")


@query("wafers_by_date", sql(TRACES, "SELECT split_part(experiment_key, '_', 1) AS date, count(DISTINCT experiment_key) AS wafers FROM traces GROUP BY 1"))
def wafers_by_date(spark, sf):
    return V.wafers_by_date(tables.traces(spark, sf))


def _pairs(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("group"), F.col("event_type").alias("feature")).distinct()


@query("schema_common_signals", "WITH g AS (SELECT event_type AS feature, count(DISTINCT user_id) AS groups FROM events GROUP BY 1) SELECT feature, groups, groups = (SELECT count(DISTINCT user_id) FROM events) AS is_common FROM g")
def schema_common_signals(spark, sf):
    return V.schema_drift(_pairs(spark, sf))


@query("schema_feature_set_sizes", "SELECT features, count(*) AS groups FROM (SELECT user_id, count(DISTINCT event_type) AS features FROM events GROUP BY 1) GROUP BY 1")
def schema_feature_set_sizes(spark, sf):
    return V.feature_set_sizes(_pairs(spark, sf))


@query("key_parse", "WITH g AS (SELECT DISTINCT concat('Day_', replace(CAST(CAST(ts AS DATE) AS VARCHAR), '-', '_'), CASE WHEN user_id % 7 = 0 THEN '_Lot_' ELSE '_Wafer_' END, CAST(user_id % 25 AS VARCHAR)) AS name FROM events) SELECT name, CASE WHEN regexp_full_match(name, 'Day_[0-9]{4}_[0-9]{2}_[0-9]{2}_Wafer_[0-9]+') THEN concat(substr(name, 5, 4), '-', substr(name, 10, 2), '-', substr(name, 13, 2), '_', regexp_extract(name, 'Wafer_([0-9]+)$', 1)) END AS experiment_key FROM g")
def key_parse(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    name = F.concat(F.lit("Day_"), F.date_format("ts", "yyyy_MM_dd"), F.when(F.col("user_id") % 7 == 0, "_Lot_").otherwise("_Wafer_"), (F.col("user_id") % 25).cast("string"))
    return V.parsed_keys(e.select(name.alias("name")).distinct(), "name")


@query("lot_of_date", sql(DENSE + ", " + TRACES + ", m AS (SELECT DISTINCT split_part(experiment_key, '_', 1) AS date, lot_number FROM dense)", "SELECT DISTINCT t.experiment_key, m.lot_number FROM traces t JOIN m ON split_part(t.experiment_key, '_', 1) = m.date"))
def lot_of_date(spark, sf):
    return V.lot_of_date(tables.dense(spark, sf), tables.traces(spark, sf))


@query("missing_keys", sql(DENSE + ", " + TRACES, "SELECT 'left' AS side, experiment_key FROM (SELECT experiment_key FROM traces EXCEPT SELECT experiment_key FROM dense) UNION ALL SELECT 'right', experiment_key FROM (SELECT experiment_key FROM dense EXCEPT SELECT experiment_key FROM traces)"))
def missing_keys(spark, sf):
    return V.missing_keys(tables.traces(spark, sf), tables.dense(spark, sf))


@query("regular_duration", sql(TRACES + ", s AS (SELECT *, t - lag(t) OVER (PARTITION BY experiment_key ORDER BY t) AS step FROM traces), m AS (SELECT experiment_key, median(step) AS m FROM s GROUP BY 1)", f"SELECT experiment_key, {dr6('coalesce(max(t) FILTER (step <= 5 * m), min(t)) - min(t)', 'regular_duration')} FROM s JOIN m USING (experiment_key) GROUP BY 1"))
def regular_duration(spark, sf):
    return V.regular_duration(tables.traces(spark, sf)).select("experiment_key", r6("regular_duration"))


FEATURES = cycles("complementary") + """, fl AS (SELECT experiment_key, t, active_start AS a, active_end AS b, long_phase, short_phase, cycle_index, signal, value FROM (SELECT experiment_key, t, active_start, active_end, long_phase, short_phase, cycle_index, rf, gas_long, gas_short FROM regions WHERE active) UNPIVOT (value FOR signal IN (rf, gas_long, gas_short))),
fa AS (SELECT experiment_key, signal, avg(value) AS active_mean, stddev_pop(value) AS active_std, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS active_range, coalesce(regr_slope(value, (t - a) / nullif(b - a, 0)), 0) AS active_slope,
  avg(value) FILTER (t >= b - 0.1 * (b - a)) - avg(value) FILTER (t <= a + 0.1 * (b - a)) AS early_late_delta, avg(value) FILTER (long_phase) AS long_phase_mean, avg(value) FILTER (short_phase) AS short_phase_mean, avg(value) FILTER (long_phase) - avg(value) FILTER (short_phase) AS phase_difference FROM fl GROUP BY ALL),
fm AS (SELECT experiment_key, signal, cycle_index, avg(value) AS m FROM fl WHERE cycle_index >= 0 GROUP BY ALL),
fc AS (SELECT experiment_key, signal, stddev_pop(m) AS cycle_mean_std, coalesce(regr_slope(m, x), 0) AS cycle_mean_slope FROM (SELECT *, (row_number() OVER (PARTITION BY experiment_key, signal ORDER BY cycle_index) - 1) / nullif(count(*) OVER (PARTITION BY experiment_key, signal) - 1, 0) AS x FROM fm) GROUP BY ALL),
features AS (SELECT experiment_key, signal || '__' || statistic AS feature, value FROM (SELECT * FROM fa LEFT JOIN fc USING (experiment_key, signal)) UNPIVOT (value FOR statistic IN (active_mean, active_std, active_range, active_slope, early_late_delta, long_phase_mean, short_phase_mean, phase_difference, cycle_mean_std, cycle_mean_slope)))"""


def long_features(spark, sf, detector: str = "complementary"):
    return features.trace_features(segment.detect_regions(tables.traces(spark, sf), detector), SIGNALS)


@query("trace_features_long", sql(FEATURES, f"SELECT experiment_key, feature, {dr6('value')} FROM features"))
def trace_features_long(spark, sf):
    return long_features(spark, sf).filter("value is not null").select("experiment_key", "feature", r6("value"))


@query("trace_diagnostics", sql(cycles("complementary") + ", s AS (SELECT *, t - lag(t) OVER (PARTITION BY experiment_key ORDER BY t) AS step, CASE WHEN active THEN t - lag(t) OVER (PARTITION BY experiment_key, active ORDER BY t) END AS astep FROM regions)", f"SELECT experiment_key, count(*) AS samples, {dr6('median(step)', 'median_step_seconds')}, {dr6('max(step)', 'maximum_gap_seconds')}, {dr6('max(astep)', 'active_maximum_gap_seconds')}, {dr6('any_value(active_end) - any_value(active_start)', 'active_duration_seconds')}, CAST(any_value(cycle_count) AS BIGINT) AS detected_cycles, {dr6('avg(CAST(long_phase AS INTEGER)) FILTER (active)', 'long_phase_sample_fraction')}, {dr6('avg(CAST(short_phase AS INTEGER)) FILTER (active)', 'short_phase_sample_fraction')} FROM s GROUP BY experiment_key"))
def trace_diagnostics(spark, sf):
    d = features.trace_diagnostics(segment.detect_regions(tables.traces(spark, sf), "complementary"))
    return d.select("experiment_key", "samples", *map(r6, ("median_step_seconds", "maximum_gap_seconds", "active_maximum_gap_seconds", "active_duration_seconds")), "detected_cycles", r6("long_phase_sample_fraction"), r6("short_phase_sample_fraction"))


_PIVOT = ["rf__active_mean", "gas_long__long_phase_mean", "gas_short__cycle_mean_slope"]


@query("feature_pivot", sql(FEATURES, "SELECT experiment_key, " + ", ".join(f"floor(max(value) FILTER (feature = '{f}') * 1e6 + 0.4997) / 1e6 AS {f}" for f in _PIVOT) + " FROM features GROUP BY experiment_key"))
def feature_pivot(spark, sf):
    f = features.wide_features(long_features(spark, sf).filter(F.col("feature").isin(_PIVOT)), _PIVOT)
    return f.select("experiment_key", *map(r6, _PIVOT))


@query("feature_groups", sql(FEATURES, """SELECT feature_group, sensor_family, count(*) AS n FROM (SELECT CASE WHEN feature LIKE '%\\_\\_active_mean' ESCAPE '\\' OR feature LIKE '%active_std' OR feature LIKE '%active_range' THEN 'G1_level' WHEN feature LIKE '%active_slope' OR feature LIKE '%early_late_delta' THEN 'G2_temporal_drift' WHEN feature LIKE '%phase_mean' OR feature LIKE '%phase_difference' THEN 'G3_bosch_phase' ELSE 'G4_cycle_behavior' END AS feature_group,
  CASE WHEN feature LIKE 'gas%' THEN 'gas_or_backside_flow' ELSE 'rf_power_matching_electrical' END AS sensor_family FROM features) GROUP BY ALL"""))
def feature_groups(spark, sf):
    f = long_features(spark, sf).filter("value is not null")
    return f.select(features.feature_group(F.col("feature")).alias("feature_group"), features.sensor_family(F.col("feature")).alias("sensor_family")).groupBy("feature_group", "sensor_family").agg(F.count("*").alias("n"))


ASOF = TRACES + ", " + SPECTRA + """, ref AS (SELECT experiment_key, t - min(t) OVER (PARTITION BY experiment_key) AS e, rf FROM traces), probe AS (SELECT experiment_key, wafer, t - min(t) OVER (PARTITION BY experiment_key) AS e FROM spectra),
b AS (SELECT p.experiment_key, p.e, r.e AS be, r.rf AS brf FROM probe p ASOF LEFT JOIN ref r ON p.experiment_key = r.experiment_key AND p.e >= r.e),
n AS (SELECT b.*, r.e AS ae, r.rf AS arf FROM b ASOF LEFT JOIN ref r ON b.experiment_key = r.experiment_key AND b.e <= r.e)"""


def _asof_sides(spark, sf):
    ref = asof.rezeroed(tables.traces(spark, sf), "experiment_key", "t").select("experiment_key", "elapsed", "rf")
    return asof.rezeroed(tables.spectra(spark, sf).drop("intensity"), "experiment_key", "t").select("experiment_key", "elapsed"), ref


@query("asof_nearest", sql(ASOF, f"SELECT experiment_key, {dr6('e', 'elapsed')}, {dr6('CASE WHEN be IS NULL OR (ae IS NOT NULL AND ae - e < e - be) THEN ae ELSE be END', 'ref_elapsed')}, {dr6('CASE WHEN be IS NULL OR (ae IS NOT NULL AND ae - e < e - be) THEN arf ELSE brf END', 'ref_rf')} FROM n"))
def asof_nearest(spark, sf):
    d = asof.asof_nearest(*_asof_sides(spark, sf), "experiment_key", "elapsed", ["rf"])
    return d.select("experiment_key", r6("elapsed"), r6("ref_elapsed"), r6("ref_rf"))


@query("asof_backward", sql(ASOF, f"SELECT experiment_key, {dr6('e', 'elapsed')}, {dr6('be', 'ref_elapsed')}, {dr6('brf', 'ref_rf')} FROM n"))
def asof_backward(spark, sf):
    d = asof.asof_backward(*_asof_sides(spark, sf), "experiment_key", "elapsed", ["rf"])
    return d.select("experiment_key", r6("elapsed"), r6("ref_elapsed"), r6("ref_rf"))


ALIGNED = cycles("complementary") + ", " + SPECTRA + """, ref AS (SELECT experiment_key, t - min(t) OVER (PARTITION BY experiment_key) AS e, t, active, long_phase, short_phase, cycle_index, active_start AS a, active_end AS z FROM regions), probe AS (SELECT experiment_key, intensity, t - min(t) OVER (PARTITION BY experiment_key) AS e FROM spectra),
sb AS (SELECT p.experiment_key, p.e, p.intensity, r.e AS be, r.t AS bt, r.active AS ba, r.long_phase AS bl, r.short_phase AS bs, r.cycle_index AS bc, r.a AS bb, r.z AS bz FROM probe p ASOF LEFT JOIN ref r ON p.experiment_key = r.experiment_key AND p.e >= r.e),
sn AS (SELECT sb.*, r.e AS ae, r.t AS at_, r.active AS aa, r.long_phase AS al, r.short_phase AS as_, r.cycle_index AS ac, r.a AS ab, r.z AS az FROM sb ASOF LEFT JOIN ref r ON sb.experiment_key = r.experiment_key AND sb.e <= r.e),
al AS (SELECT experiment_key, e, intensity, CASE WHEN k THEN ae ELSE be END AS re, CASE WHEN k THEN aa ELSE ba END AS active, CASE WHEN k THEN al ELSE bl END AS long_phase, CASE WHEN k THEN as_ ELSE bs END AS short_phase, CASE WHEN k THEN ac ELSE bc END AS cycle_index,
  CASE WHEN k THEN at_ <= ab + 0.1 * (az - ab) ELSE bt <= bb + 0.1 * (bz - bb) END AS early, CASE WHEN k THEN at_ >= az - 0.1 * (az - ab) ELSE bt >= bz - 0.1 * (bz - bb) END AS late FROM (SELECT *, be IS NULL OR (ae IS NOT NULL AND ae - e < e - be) AS k FROM sn))"""


def aligned(spark, sf):
    """Spectra with the regions of the nearest trace sample, both clocks from the wafer's start."""
    r = asof.rezeroed(segment.detect_regions(tables.traces(spark, sf), "complementary"), "experiment_key", "t")
    carry = ["t", "active", "long_phase", "short_phase", "cycle_index", "active_start", "active_end"]
    p = asof.rezeroed(tables.spectra(spark, sf), "experiment_key", "t").select("experiment_key", "elapsed", "intensity")
    reference = r.select("experiment_key", "elapsed", *[F.col(c).alias(f"r_{c}") for c in carry])
    d = asof.asof_nearest(p, reference, "experiment_key", "elapsed", [f"r_{c}" for c in carry], prefix="near_")
    d = d.select("experiment_key", "elapsed", "intensity", *[F.col(f"near_r_{c}").alias(f"r_{c}") for c in carry])
    span = F.col("r_active_end") - F.col("r_active_start")
    return d.select("experiment_key", "elapsed", "intensity", F.col("r_active").alias("active"), F.col("r_long_phase").alias("long_phase"), F.col("r_short_phase").alias("short_phase"), F.col("r_cycle_index").alias("cycle_index"),
                    (F.col("r_t") <= F.col("r_active_start") + 0.1 * span).alias("early"), (F.col("r_t") >= F.col("r_active_end") - 0.1 * span).alias("late"))


def _spectral_sql(shape: bool) -> str:
    v = "list_transform(intensity, lambda v: v / greatest(list_sum(intensity), 1e-12))" if shape else "intensity"
    return ALIGNED + f""", ex AS (SELECT experiment_key, early, late, long_phase, short_phase, cycle_index, unnest({v}) AS v, unnest(range(len(intensity))) AS channel FROM al WHERE active),
sa AS (SELECT experiment_key, channel, avg(v) AS m, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) AS sd, avg(v) FILTER (early) AS e, avg(v) FILTER (late) AS l, avg(v) FILTER (long_phase) AS lp, avg(v) FILTER (short_phase) AS sp FROM ex GROUP BY ALL),
sc AS (SELECT experiment_key, channel, coalesce(regr_slope(m, x), 0) AS slope FROM (SELECT *, (row_number() OVER (PARTITION BY experiment_key, channel ORDER BY cycle_index) - 1) / nullif(count(*) OVER (PARTITION BY experiment_key, channel) - 1, 0) AS x FROM (SELECT experiment_key, channel, cycle_index, avg(v) AS m FROM ex WHERE cycle_index >= 0 GROUP BY ALL)) GROUP BY ALL)"""


def _place(c: str, scale: str = "") -> str:
    return f"CAST({c} AS INTEGER) AS channel"


@query("spectral_stats", sql(_spectral_sql(False), f"SELECT experiment_key, {_place('channel')}, {dr6('m', 'active_mean')}, {dr6('l - e', 'early_late_delta')}, {dr6('lp', 'long_phase_mean')}, {dr6('sp', 'short_phase_mean')}, {dr6('lp - sp', 'phase_difference')}, {dr6('slope', 'cycle_mean_slope')} FROM sa LEFT JOIN sc USING (experiment_key, channel)"))
def spectral_stats(spark, sf):
    f = features.spectral_features(aligned(spark, sf))
    return f.select("experiment_key", "channel", *map(r6, ("active_mean", "early_late_delta", "long_phase_mean", "short_phase_mean", "phase_difference", "cycle_mean_slope")))


@query("spectral_shape_stats", sql(_spectral_sql(True), f"SELECT experiment_key, {_place('channel')}, {dr6('m', 'active')}, {dr6('e', 'early')}, {dr6('l', 'late')}, {dr6('lp', 'long_phase')}, {dr6('sp', 'short_phase')}, {dr6('slope', 'cycle_slope')} FROM sa LEFT JOIN sc USING (experiment_key, channel)"))
def spectral_shape_stats(spark, sf):
    f = features.spectral_features(aligned(spark, sf), "shape")
    return f.select("experiment_key", "channel", *map(r6, ("active", "early", "late", "long_phase", "short_phase", "cycle_slope")))


@query("spectral_bin16", sql(SPECTRA + ", e AS (SELECT experiment_key, t, len(intensity) AS n, unnest(intensity) AS v, unnest(range(len(intensity))) AS c FROM spectra)", f"SELECT experiment_key, {dr6('t')}, CAST(c // 16 AS INTEGER) AS bin, {dr6('avg(v)', 'mean')}, {dr6('avg(c)', 'center')} FROM e WHERE c < n - n % 16 GROUP BY experiment_key, t, c // 16"))
def spectral_bin16(spark, sf):
    return features.binned_channels(tables.spectra(spark, sf)).select("experiment_key", r6("t"), "bin", r6("mean"), r6("center"))


@query("spectral_preview", sql(SPECTRA + ", p AS (SELECT *, row_number() OVER (PARTITION BY experiment_key ORDER BY t) - 1 AS i, ceil(count(*) OVER (PARTITION BY experiment_key) / 20) AS s FROM spectra)", f"SELECT experiment_key, {dr6('t')}, {dr6('list_sum(intensity) / len(intensity)', 'broadband')} FROM p WHERE i % s = 0"))
def spectral_preview(spark, sf):
    return features.preview(tables.spectra(spark, sf), 20).select("experiment_key", r6("t"), r6("broadband"))


@query("spectral_gate", sql(ACTIVE + ", " + SPECTRA + """, tr AS (SELECT experiment_key, any_value(active_start) - min(t) AS a, any_value(active_end) - min(t) AS z, max(t) - min(t) AS d FROM active GROUP BY 1),
s AS (SELECT *, t - lag(t) OVER (PARTITION BY experiment_key ORDER BY t) AS step FROM spectra), g AS (SELECT experiment_key, count(*) AS time_count, min(len(intensity)) AS channels, min(list_min(intensity)) AS lo, max(list_max(intensity)) AS hi, median(step) AS m, max(step) AS x, max(t) - min(t) AS dur FROM s GROUP BY 1)""",
    f"SELECT experiment_key, time_count, CAST(channels AS BIGINT) AS channels, {dr6('lo', 'minimum_value')}, {dr6('hi', 'maximum_value')}, {dr6('m', 'median_step_seconds')}, {dr6('abs(dur - d)', 'duration_difference')}, coalesce(channels = 64 AND a >= -25 AND z <= dur + 25 AND abs(dur - d) <= 25, false) AS passes_integrity_gate FROM g LEFT JOIN tr USING (experiment_key)"))
def spectral_gate(spark, sf):
    a = segment.with_active(tables.traces(spark, sf))
    s = a.groupBy("experiment_key").agg((F.first("active_start") - F.min("t")).alias("active_start"), (F.first("active_end") - F.min("t")).alias("active_end"), (F.max("t") - F.min("t")).alias("duration"))
    g = V.spectral_gate(tables.spectra(spark, sf), s, 64, tolerance=25.0)
    return g.select("experiment_key", "time_count", big("channels"), r6("minimum_value"), r6("maximum_value"), r6("median_step_seconds"), r6("duration_difference"), "passes_integrity_gate")
