"""Queries over wafer errors: metrics, risk scores, policies, bootstraps, conformal bounds, replays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.functions import stats
from lotwise.operators import conformal, metrics, resample, risk, template
from lotwise.queries import traces
from lotwise.queries.registry import DECOMPOSED, dr6, query, r6, sql
from lotwise.sources import tables

BUDGETS = (0.1, 0.2, 0.3, 0.5)
NOMINALS = (0.8, 0.9, 0.95)
SEED = 20260721

# Wafers of one target: error is the template's, score the size of the residual; both rounded so that ranks agree.
FACTS = DECOMPOSED + """, facts AS (SELECT *, CAST(row_number() OVER (PARTITION BY lot_number ORDER BY experiment_key) AS INTEGER) AS wafer_order FROM (
  SELECT experiment_key, lot_number, round(avg(abs(observed - template_prediction)), 9) AS error, round(sqrt(avg(residual * residual)), 9) AS score, round(any_value(mean_shift), 9) AS shift FROM decomposed WHERE target = 'stepheight' GROUP BY ALL))"""


def facts(spark, sf):
    d = template.decompose(template.with_targets(tables.dense(spark, sf), ["stepheight"]))
    g = d.groupBy("experiment_key", "lot_number").agg(
        F.round(F.avg(F.abs(F.col("observed") - F.col("template_prediction"))), 9).alias("error"), F.round(F.sqrt(F.avg(F.col("residual") ** 2)), 9).alias("score"), F.round(F.first("mean_shift"), 9).alias("shift"))
    return metrics.wafer_ordinal(g)


# Points of the template and of the template with the wafer's true shift, as two stages.
POINTS2 = DECOMPOSED + """, pts AS (SELECT 'template' AS stage, experiment_key, lot_number, x, y, observed, template_prediction AS predicted FROM decomposed WHERE target = 'stepheight' UNION ALL SELECT 'mean_shift', experiment_key, lot_number, x, y, observed, shifted FROM decomposed WHERE target = 'stepheight'),
zs AS (SELECT x, y, sqrt(x * x + y * y) / max(sqrt(x * x + y * y)) OVER () AS s FROM (SELECT DISTINCT x, y FROM dense)), zones AS (SELECT x, y, CASE WHEN s <= 1.0 / 3 THEN 'center' WHEN s <= 2.0 / 3 THEN 'middle' ELSE 'edge' END AS zone FROM zs)"""


def points(spark, sf):
    d = template.decompose(template.with_targets(tables.dense(spark, sf), ["stepheight"]))
    stages = F.explode(F.array(F.struct(F.lit("template").alias("stage"), F.col("template_prediction").alias("predicted")), F.struct(F.lit("mean_shift").alias("stage"), F.col("template_plus_true_mean_shift").alias("predicted"))))
    return d.select("experiment_key", "lot_number", "x", "y", "observed", stages.alias("s")).select("experiment_key", "lot_number", "x", "y", "observed", "s.stage", "s.predicted")


_K = ["stage", "experiment_key", "lot_number"]
_E = "predicted - observed"
ERRORS = POINTS2 + f", werr AS (SELECT stage, experiment_key, lot_number, avg(abs({_E})) AS mae, sqrt(avg(({_E}) * ({_E}))) AS rmse, avg({_E}) AS mean_error FROM pts GROUP BY ALL)"


def wafer_errors_df(spark, sf):
    return metrics.wafer_errors(points(spark, sf), _K)


@query("wafer_error_metrics", sql(ERRORS, f"SELECT stage, experiment_key, lot_number, {dr6('mae')}, {dr6('rmse')}, {dr6('mean_error')} FROM werr"))
def wafer_error_metrics(spark, sf):
    return wafer_errors_df(spark, sf).select(*_K, r6("mae"), r6("rmse"), r6("mean_error"))


_SPATIAL = ("residual_profile_mae", "residual_profile_rmse", "profile_correlation", "center_mean_error", "middle_mean_error", "edge_mean_error", "center_edge_error", "standard_deviation_error", "range_error", "worst_point_error", "p95_absolute_error")


@query("wafer_spatial_metrics", sql(POINTS2 + f""", c AS (SELECT pts.*, zone, {_E} AS e, predicted - avg(predicted) OVER w AS cp, observed - avg(observed) OVER w AS co FROM pts JOIN zones USING (x, y) WINDOW w AS (PARTITION BY stage, experiment_key)),
m AS (SELECT stage, experiment_key, lot_number, avg(abs(cp - co)) AS residual_profile_mae, sqrt(avg((cp - co) * (cp - co))) AS residual_profile_rmse, CASE WHEN stddev_pop(observed) > 1e-12 AND stddev_pop(predicted) > 1e-12 THEN corr(cp, co) END AS profile_correlation,
  avg(e) FILTER (zone = 'center') AS center_mean_error, avg(e) FILTER (zone = 'middle') AS middle_mean_error, avg(e) FILTER (zone = 'edge') AS edge_mean_error, avg(e) FILTER (zone = 'center') - avg(e) FILTER (zone = 'edge') AS center_edge_error,
  stddev_pop(predicted) - stddev_pop(observed) AS standard_deviation_error, (max(predicted) - min(predicted)) - (max(observed) - min(observed)) AS range_error, max(abs(e)) AS worst_point_error, quantile_cont(abs(e), 0.95) AS p95_absolute_error FROM c GROUP BY ALL)""",
    "SELECT stage, experiment_key, lot_number, " + ", ".join(map(dr6, _SPATIAL)) + " FROM m"))
def wafer_spatial_metrics(spark, sf):
    zones = template.coordinate_zones(tables.dense(spark, sf).select("x", "y").distinct())
    return metrics.spatial_metrics(points(spark, sf).join(F.broadcast(zones), ["x", "y"]), _K).select(*_K, *map(r6, _SPATIAL))


@query("coordinate_mae", sql(POINTS2, f"SELECT stage, x, y, {dr6(f'avg(abs({_E}))', 'coordinate_mae')} FROM pts GROUP BY stage, x, y"))
def coordinate_mae(spark, sf):
    return metrics.coordinate_mae(points(spark, sf), ["stage"]).select("stage", "x", "y", r6("coordinate_mae"))


@query("stage_summary", sql(ERRORS + ", l AS (SELECT stage, lot_number, avg(mae) AS mae, avg(rmse) AS rmse FROM werr GROUP BY ALL), a AS (SELECT stage, count(*) AS lots, avg(mae) AS lm, avg(rmse) AS lr FROM l GROUP BY stage)", f"SELECT stage, count(*) AS wafers, {dr6('avg(mae)', 'wafer_macro_mae')}, {dr6('avg(rmse)', 'wafer_macro_rmse')}, any_value(lots) AS lots, {dr6('any_value(lm)', 'lot_macro_mae')}, {dr6('any_value(lr)', 'lot_macro_rmse')} FROM werr JOIN a USING (stage) GROUP BY stage"))
def stage_summary(spark, sf):
    s = metrics.stage_summary(wafer_errors_df(spark, sf), ["mae", "rmse"], ["stage"])
    return s.select("stage", "wafers", r6("wafer_macro_mae"), r6("wafer_macro_rmse"), "lots", r6("lot_macro_mae"), r6("lot_macro_rmse"))


@query("best_lot_counts", sql(ERRORS + ", l AS (SELECT stage, lot_number, avg(mae) AS v FROM werr GROUP BY ALL), b AS (SELECT arg_min(stage, (v, stage)) AS stage FROM l GROUP BY lot_number)", "SELECT s.stage, (SELECT count(*) FROM b WHERE b.stage = s.stage) AS best_lots FROM (SELECT DISTINCT stage FROM werr) s"))
def best_lot_counts(spark, sf):
    return metrics.best_lot_counts(wafer_errors_df(spark, sf), "stage")


@query("paired_improvements", sql(ERRORS + ", l AS (SELECT lot_number, avg(mae) FILTER (stage = 'mean_shift') AS b, avg(mae) FILTER (stage = 'template') AS a FROM werr GROUP BY lot_number)", f"SELECT count(*) AS lots, count(*) FILTER (b < a) AS improved, {dr6('1 - avg(b) / nullif(avg(a), 0)', 'relative_gain')} FROM l"))
def paired_improvements(spark, sf):
    return metrics.paired_improvements(wafer_errors_df(spark, sf), "mean_shift", "template").select("lots", "improved", r6("relative_gain"))


@query("top20_capture", sql(FACTS + ", r AS (SELECT *, greatest(1, ceil(0.2 * count(*) OVER (PARTITION BY lot_number))) AS k, row_number() OVER (PARTITION BY lot_number ORDER BY error DESC, experiment_key) AS e, row_number() OVER (PARTITION BY lot_number ORDER BY score DESC, experiment_key) AS s FROM facts)", f"SELECT lot_number, CAST(any_value(k) AS INTEGER) AS k, {dr6('count(*) FILTER (e <= k AND s <= k) / any_value(k)', 'capture')} FROM r GROUP BY lot_number"))
def top20_capture(spark, sf):
    return metrics.top_capture(facts(spark, sf), "error", "score", by=["lot_number"]).select("lot_number", "k", r6("capture"))


@query("spearman_scores", sql(FACTS + ", r AS (SELECT lot_number, rank() OVER (PARTITION BY lot_number ORDER BY error) + (count(*) OVER (PARTITION BY lot_number, error) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lot_number ORDER BY score) + (count(*) OVER (PARTITION BY lot_number, score) - 1) / 2.0 AS b FROM facts)", f"SELECT lot_number, count(*) AS n, {dr6('CASE WHEN count(*) >= 3 THEN corr(a, b) END', 'spearman')} FROM r GROUP BY lot_number"))
def spearman_scores(spark, sf):
    return stats.spearman(facts(spark, sf), "error", "score", ["lot_number"]).select("lot_number", "n", r6("spearman"))


@query("score_correlations", sql(FACTS + ", s AS (SELECT lot_number, experiment_key, score AS n, v FROM (SELECT lot_number, experiment_key, error, score AS spread, shift FROM facts) UNPIVOT (v FOR score IN (error, spread, shift))), prs AS (SELECT a.lot_number, a.n AS score_a, b.n AS score_b, a.v AS va, b.v AS vb FROM s a JOIN s b ON a.lot_number = b.lot_number AND a.experiment_key = b.experiment_key AND a.n < b.n), r AS (SELECT *, rank() OVER (PARTITION BY lot_number, score_a, score_b ORDER BY va) + (count(*) OVER (PARTITION BY lot_number, score_a, score_b, va) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lot_number, score_a, score_b ORDER BY vb) + (count(*) OVER (PARTITION BY lot_number, score_a, score_b, vb) - 1) / 2.0 AS y FROM prs)", f"SELECT lot_number, score_a, score_b, count(*) AS n, {dr6('CASE WHEN count(*) >= 3 THEN corr(x, y) END', 'spearman')} FROM r GROUP BY ALL"))
def score_correlations(spark, sf):
    s = stats.unpivot(facts(spark, sf).withColumnRenamed("score", "spread"), ["lot_number", "experiment_key"], ["error", "spread", "shift"], "score")
    return risk.score_correlations(s, ["lot_number"]).select("lot_number", "score_a", "score_b", "n", r6("spearman"))


@query("empirical_percentile", sql(FACTS, f"SELECT f.experiment_key, f.lot_number, {dr6('(SELECT count(*) FROM facts r WHERE r.lot_number <> 1 AND r.score <= f.score) / (SELECT count(*) FROM facts r WHERE r.lot_number <> 1)', 'percentile')} FROM facts f WHERE lot_number = 1"))
def empirical_percentile(spark, sf):
    f = facts(spark, sf)
    return risk.empirical_percentile(f.filter("lot_number = 1"), f.filter("lot_number <> 1"), "score").select("experiment_key", "lot_number", r6("percentile"))


_CHANGE = FACTS + """, o AS (SELECT experiment_key, lot_number, wafer_order, [score, shift] AS x FROM facts), c AS (SELECT [avg(score), avg(shift)] AS c FROM facts)"""


def _ewma_sql(alpha: str) -> str:
    return _CHANGE.replace("WITH ", "") + f""", e AS (SELECT experiment_key, lot_number, wafer_order, x, x AS run, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS w FROM o WHERE wafer_order = 1
  UNION ALL SELECT o.experiment_key, o.lot_number, o.wafer_order, o.x, [{alpha} * o.x[1] + (1 - {alpha}) * e.run[1], {alpha} * o.x[2] + (1 - {alpha}) * e.run[2]], sqrt((o.x[1] - e.x[1]) ** 2 + (o.x[2] - e.x[2]) ** 2), sqrt((o.x[1] - e.run[1]) ** 2 + (o.x[2] - e.run[2]) ** 2) FROM e JOIN o ON o.lot_number = e.lot_number AND o.wafer_order = e.wafer_order + 1)"""


def change(spark, sf, alpha=0.3):
    f = facts(spark, sf)
    c = f.agg(F.array(F.avg("score"), F.avg("shift")).alias("centroid"))
    return risk.change_scores(f.withColumn("x", F.array("score", "shift")).crossJoin(F.broadcast(c)), alpha)


@query("change_scores", "WITH RECURSIVE " + _ewma_sql("0.3") + f" SELECT experiment_key, lot_number, {dr6('sqrt((x[1] - c[1]) ** 2 + (x[2] - c[2]) ** 2)', 'initial_state')}, {dr6('d', 'wafer_delta')}, {dr6('w', 'ewma_distance')} FROM e CROSS JOIN c")
def change_scores(spark, sf):
    return change(spark, sf).select("experiment_key", "lot_number", r6("initial_state"), r6("wafer_delta"), r6("ewma_distance"))


@query("ewma_alpha_sensitivity", " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_ewma_sql(a)} SELECT {a} AS alpha, count(w) AS n, {dr6('avg(w)', 'mean_distance')}, {dr6('median(w)', 'median_distance')} FROM e)" for a in ("CAST(0.1 AS DOUBLE)", "CAST(0.3 AS DOUBLE)", "CAST(0.5 AS DOUBLE)")))
def ewma_alpha_sensitivity(spark, sf):
    out = None
    for a in (0.1, 0.3, 0.5):
        one = change(spark, sf, a).agg(F.lit(a).alias("alpha"), F.count("ewma_distance").alias("n"), r6(F.avg("ewma_distance"), "mean_distance"), r6(F.median("ewma_distance"), "median_distance"))
        out = one if out is None else out.unionByName(one)
    return out


_RANKED = FACTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY lot_number ORDER BY score DESC, wafer_order) AS rn, count(*) OVER (PARTITION BY lot_number) AS n FROM facts)"
_BUDGET = "(SELECT CAST(unnest([0.1, 0.2, 0.3, 0.5]) AS DOUBLE) AS b)"


@query("policy_curve", sql(_RANKED + f", k AS (SELECT r.*, b, CAST(least(round_even(b * n, 0), n - 1) AS BIGINT) AS k FROM r CROSS JOIN {_BUDGET})", f"SELECT lot_number, b AS requested_budget, any_value(k) AS selected_wafers, {dr6('any_value(k) / any_value(n)', 'actual_metrology_fraction')}, {dr6('avg(error) FILTER (rn > k)', 'retained_mae')} FROM k GROUP BY lot_number, b"))
def policy_curve(spark, sf):
    return risk.policy_curve(facts(spark, sf), BUDGETS).select("lot_number", "requested_budget", "selected_wafers", r6("actual_metrology_fraction"), r6("retained_mae"))


_PERIODIC = "list_distinct(list_transform(range(CAST({k} AS BIGINT)), lambda i: round_even(i * (n - 1) / CAST(CASE WHEN {k} > 1 THEN {k} - 1 ELSE 1 END AS DOUBLE), 0)))"


@query("periodic_selection", sql(_RANKED + f", k AS (SELECT r.*, b, {_PERIODIC.format(k='least(round_even(b * n, 0), n - 1)')} AS p FROM r CROSS JOIN {_BUDGET})", f"SELECT lot_number, b AS requested_budget, CAST(len(any_value(p)) AS BIGINT) AS selected_wafers, {dr6('len(any_value(p)) / any_value(n)', 'actual_metrology_fraction')}, {dr6('avg(error) FILTER (NOT list_contains(p, wafer_order - 1))', 'retained_mae')} FROM k GROUP BY lot_number, b"))
def periodic_selection(spark, sf):
    return risk.periodic_curve(facts(spark, sf), BUDGETS).select("lot_number", "requested_budget", "selected_wafers", r6("actual_metrology_fraction"), r6("retained_mae"))


_AURC = "CASE WHEN count(*) > 1 THEN (sum(risk) - (sum(risk) FILTER (rn = 1) + sum(risk) FILTER (rn = n)) / 2) / (count(*) - 1) ELSE any_value(risk) END"


@query("aurc", sql(_RANKED + ", s AS (SELECT *, avg(error) OVER (PARTITION BY lot_number ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM r)", f"SELECT lot_number, {dr6(_AURC, 'aurc')} FROM s GROUP BY lot_number"))
def aurc(spark, sf):
    return risk.aurc(facts(spark, sf)).select("lot_number", r6("aurc"))


@query("periodic_aurc", sql(_RANKED + f", k AS (SELECT lot_number, n, c, avg(error) FILTER (NOT list_contains({_PERIODIC.format(k='c')}, wafer_order - 1)) AS risk FROM (SELECT *, unnest(range(n)) AS c FROM r) GROUP BY ALL)", f"SELECT lot_number, {dr6('CASE WHEN any_value(n) > 1 THEN (sum(risk) - (sum(risk) FILTER (c = 0) + sum(risk) FILTER (c = n - 1)) / 2) / (any_value(n) - 1) ELSE any_value(risk) END', 'aurc')} FROM k GROUP BY lot_number"))
def periodic_aurc(spark, sf):
    return risk.periodic_aurc(facts(spark, sf)).select("lot_number", r6("aurc"))


_POLICIES = FACTS + """, pol AS (SELECT *, unnest(['combined', 'oracle', 'random']) AS policy FROM facts), ps AS (SELECT *, CASE policy WHEN 'combined' THEN score WHEN 'oracle' THEN error ELSE ('0x' || substr(md5(concat_ws('-', 7, experiment_key)), 1, 8))::BIGINT % 4294967296 / 4294967296.0 END AS s FROM pol),
pr AS (SELECT *, row_number() OVER (PARTITION BY lot_number, policy ORDER BY s DESC, wafer_order) AS rn, count(*) OVER (PARTITION BY lot_number, policy) AS n FROM ps), pa AS (SELECT *, avg(error) OVER (PARTITION BY lot_number, policy ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM pr),
lots AS (SELECT lot_number, policy, """ + _AURC + """ AS aurc FROM pa GROUP BY lot_number, policy)"""


def lot_policies(spark, sf):
    p = facts(spark, sf).withColumn("policy", F.explode(F.array(*map(F.lit, ("combined", "oracle", "random")))))
    s = F.when(F.col("policy") == "combined", F.col("score")).when(F.col("policy") == "oracle", F.col("error")).otherwise(resample.uniform(F.lit(7), F.col("experiment_key")))
    return risk.aurc(p.withColumn("_score", s), "_score", by=["lot_number", "policy"])


@query("policy_influence", sql(_POLICIES + ", b AS (SELECT l.*, r.aurc AS base FROM lots l JOIN lots r ON l.lot_number = r.lot_number AND r.policy = 'random'), rem AS (SELECT NULL AS gone, 'none' AS removed_lot UNION ALL SELECT DISTINCT lot_number, CAST(lot_number AS VARCHAR) FROM lots), m AS (SELECT policy, median(aurc - base) AS med FROM b GROUP BY policy)", f"SELECT policy, removed_lot, {dr6('avg(aurc)', 'macro_aurc')}, {dr6('avg(base)', 'macro_random_aurc')}, {dr6('1 - avg(aurc) / nullif(avg(base), 0)', 'relative_reduction_vs_random')}, {dr6('max(aurc)', 'worst_lot_aurc')}, count(*) FILTER (aurc > base) AS lots_worse_than_random, {dr6('any_value(med)', 'median_policy_minus_random')} FROM b JOIN rem ON gone IS NULL OR gone <> lot_number JOIN m USING (policy) WHERE policy <> 'oracle' OR removed_lot = removed_lot GROUP BY policy, removed_lot"))
def policy_influence(spark, sf):
    i = risk.policy_influence(lot_policies(spark, sf))
    return i.select("policy", "removed_lot", r6("macro_aurc"), r6("macro_random_aurc"), r6("relative_reduction_vs_random"), r6("worst_lot_aurc"), "lots_worse_than_random", r6("median_policy_minus_random"))


_REPS = 10_000


def _draws(table: str, n: str, reps: int = _REPS) -> str:
    return f"draws AS (SELECT rep, ('0x' || substr(md5(concat_ws('-', {SEED}, rep, d)), 1, 8))::BIGINT % n AS i FROM (SELECT count(*) AS n FROM {table}) CROSS JOIN (SELECT unnest(range({reps})) AS rep) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS d))"


_INTERVAL = f"SELECT {dr6('avg(s)', 'bootstrap_mean')}, {dr6('quantile_cont(s, 0.025)', 'p025')}, {dr6('quantile_cont(s, 0.975)', 'p975')}, {dr6('avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END)', 'probability_negative')} FROM boot"


def _interval(samples):
    i = resample.bootstrap_interval(samples)
    return i.select(*[r6(c) for c in i.columns])


@query("lot_cluster_bootstrap", sql(_POLICIES + ", diff AS (SELECT lot_number, sum(CASE policy WHEN 'combined' THEN aurc WHEN 'random' THEN -aurc ELSE 0 END) AS d FROM lots GROUP BY lot_number), num AS (SELECT *, row_number() OVER (ORDER BY lot_number) - 1 AS i FROM diff), " + _draws("diff", "n") + ", boot AS (SELECT rep, avg(d) AS s FROM draws JOIN num USING (i) GROUP BY rep)", _INTERVAL))
def lot_cluster_bootstrap(spark, sf):
    d = lot_policies(spark, sf).groupBy("lot_number").agg(F.sum(F.when(F.col("policy") == "combined", F.col("aurc")).when(F.col("policy") == "random", -F.col("aurc")).otherwise(0.0)).alias("d"))
    return _interval(resample.cluster_bootstrap(d, SEED, _REPS, "d"))


@query("wafer_weighted_bootstrap", sql(FACTS + ", lot AS (SELECT lot_number, sum(score) AS a, sum(error) AS b FROM facts GROUP BY lot_number), num AS (SELECT *, row_number() OVER (ORDER BY lot_number) - 1 AS i FROM lot), " + _draws("lot", "n") + ", boot AS (SELECT rep, 1 - sum(a) / sum(b) AS s FROM draws JOIN num USING (i) GROUP BY rep)", _INTERVAL))
def wafer_weighted_bootstrap(spark, sf):
    lots = facts(spark, sf).groupBy("lot_number").agg(F.sum("score").alias("a"), F.sum("error").alias("b"))
    s = resample.cluster_bootstrap(lots, SEED, _REPS, "a", "b")
    return _interval(s.withColumn("statistic", 1 - F.col("statistic")))


@query("random_policy_mc", sql(FACTS + ", m AS (SELECT f.*, rep, ('0x' || substr(md5(concat_ws('-', 11, rep, experiment_key)), 1, 8))::BIGINT % 4294967296 / 4294967296.0 AS s FROM facts f CROSS JOIN (SELECT unnest(range(10000)) AS rep)), r AS (SELECT *, row_number() OVER (PARTITION BY lot_number, rep ORDER BY s DESC, wafer_order) AS rn, count(*) OVER (PARTITION BY lot_number, rep) AS n FROM m), s AS (SELECT *, avg(error) OVER (PARTITION BY lot_number, rep ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM r), a AS (SELECT lot_number, rep, " + _AURC + " AS aurc FROM s GROUP BY lot_number, rep)", f"SELECT lot_number, {dr6('avg(aurc)', 'mean_aurc')}, {dr6('quantile_cont(aurc, 0.025)', 'random_p025')}, {dr6('quantile_cont(aurc, 0.975)', 'random_p975')} FROM a GROUP BY lot_number"))
def random_policy_mc(spark, sf):
    p = risk.random_policy(facts(spark, sf), 10_000, 11)
    return p.select("lot_number", r6("aurc", "mean_aurc"), r6("random_p025"), r6("random_p975"))


# Lots are cut into runs of five wafers, so that there are small ones at any size.
_SMALL = FACTS + """, cutup AS (SELECT lot_number * 100000 + (wafer_order - 1) // 5 AS lot_number, error, (wafer_order - 1) % 5 + 1 AS wafer_order FROM facts),
sized AS (SELECT lot_number, wafer_order, error, count(*) OVER (PARTITION BY lot_number) AS n FROM cutup), small AS (SELECT * FROM sized WHERE n <= 8),
lined AS (SELECT DISTINCT lot_number, n, CAST([] AS BIGINT[]) AS used, CAST([] AS DOUBLE[]) AS v FROM small UNION ALL SELECT o.lot_number, o.n, list_append(used, wafer_order), list_append(v, error) FROM lined o JOIN small s ON s.lot_number = o.lot_number AND NOT list_contains(used, wafer_order)),
whole AS (SELECT lot_number, n, list_transform(range(1, n + 1), lambda i: list_avg(v[i:])) AS risk FROM lined WHERE len(used) = n),
q AS (SELECT lot_number, CASE WHEN n > 1 THEN (list_sum(risk) - (risk[1] + risk[n]) / 2) / (n - 1) ELSE risk[1] END AS aurc FROM whole)"""


@query("small_lot_permutations", "WITH RECURSIVE " + _SMALL.replace("WITH ", "") + (f" SELECT lot_number, count(*) AS ranking_permutations, count(DISTINCT round(aurc, 9)) AS unique_aurc_values, {dr6('min(aurc)', 'best_aurc')}, {dr6('max(aurc)', 'worst_aurc')} FROM q GROUP BY lot_number"))
def small_lot_permutations(spark, sf):
    """All orders of measuring the wafers of runs of five of a lot."""
    first = F.col("wafer_order") - 1
    runs = facts(spark, sf).select((F.col("lot_number") * 100_000 + F.floor(first / 5).cast("int")).alias("lot_number"), (first % 5 + 1).alias("wafer_order"), "error")
    a = risk.every_order(runs)
    return a.groupBy("lot_number").agg(F.count("*").alias("ranking_permutations"), F.countDistinct(F.round("aurc", 9)).alias("unique_aurc_values"), r6(F.min("aurc"), "best_aurc"), r6(F.max("aurc"), "worst_aurc"))


_GRID3 = "SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INTEGER) AS grid_index, a / 4.0 AS w1, b / 4.0 AS w2, c / 4.0 AS w3 FROM (SELECT unnest(range(5)) AS a) CROSS JOIN (SELECT unnest(range(5)) AS b) CROSS JOIN (SELECT unnest(range(5)) AS c) WHERE a + b + c = 4"


@query("simplex_grid", sql(FACTS + f", grid3 AS ({_GRID3}), pr AS (SELECT percent_rank() OVER (PARTITION BY lot_number ORDER BY score) AS a, percent_rank() OVER (PARTITION BY lot_number ORDER BY abs(shift)) AS b, percent_rank() OVER (PARTITION BY lot_number ORDER BY error) AS c FROM facts)", f"SELECT grid_index, w1, w2, w3, {dr6('max(w1 * a + w2 * b + w3 * c)', 'largest_risk')}, {dr6('avg(w1 * a + w2 * b + w3 * c)', 'mean_risk')} FROM grid3 CROSS JOIN pr GROUP BY ALL"))
def simplex_grid(spark, sf):
    """Every weighting of three percentiles, and the largest and mean risk that it gives the wafers."""
    w = Window.partitionBy("lot_number")
    p = facts(spark, sf).select(F.percent_rank().over(w.orderBy("score")).alias("a"), F.percent_rank().over(w.orderBy(F.abs("shift"))).alias("b"), F.percent_rank().over(w.orderBy("error")).alias("c"))
    g = resample.simplex_grid(spark, 3).select(F.col("grid_index").cast("int").alias("grid_index"), *[F.col("weights")[i].alias(f"w{i + 1}") for i in range(3)])
    risk_of = F.col("w1") * F.col("a") + F.col("w2") * F.col("b") + F.col("w3") * F.col("c")
    return p.crossJoin(F.broadcast(g)).groupBy("grid_index", "w1", "w2", "w3").agg(r6(F.max(risk_of), "largest_risk"), r6(F.avg(risk_of), "mean_risk"))


@query("weight_selection", sql(FACTS + """, pc AS (SELECT lot_number, experiment_key, error, percent_rank() OVER (PARTITION BY lot_number ORDER BY score) AS a, percent_rank() OVER (PARTITION BY lot_number ORDER BY abs(shift)) AS b FROM facts), gr AS (SELECT row_number() OVER (ORDER BY i) - 1 AS gi, i / 4.0 AS w1, (4 - i) / 4.0 AS w2 FROM (SELECT unnest(range(5)) AS i)),
s AS (SELECT h.lot_number AS held_out_lot, pc.*, gi, w1, w2, row_number() OVER (PARTITION BY h.lot_number, gi, pc.lot_number ORDER BY w1 * a + w2 * b DESC, experiment_key) AS rn, count(*) OVER (PARTITION BY h.lot_number, gi, pc.lot_number) AS n FROM (SELECT DISTINCT lot_number FROM facts) h JOIN pc ON pc.lot_number <> h.lot_number CROSS JOIN gr),
k AS (SELECT *, avg(error) OVER (PARTITION BY held_out_lot, gi, lot_number ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM s), l AS (SELECT held_out_lot, gi, w1, w2, lot_number, """ + _AURC + " AS aurc FROM k GROUP BY ALL), m AS (SELECT held_out_lot, gi, w1, w2, avg(aurc) AS aurc FROM l GROUP BY ALL)", f"SELECT held_out_lot, arg_min(w1, (aurc, gi)) AS w1, arg_min(w2, (aurc, gi)) AS w2, {dr6('min(aurc)', 'aurc')} FROM m GROUP BY held_out_lot"))
def weight_selection(spark, sf):
    f = facts(spark, sf)
    w = Window.partitionBy("lot_number")
    p = f.withColumns({"a": F.percent_rank().over(w.orderBy("score")), "b": F.percent_rank().over(w.orderBy(F.abs("shift")))})
    s = risk.weight_selection(resample.leave_one_out(p).filter("is_train"), resample.simplex_grid(spark, 2), ["a", "b"])
    return s.select("held_out_lot", F.col("weights")[0].alias("w1"), F.col("weights")[1].alias("w2"), r6("aurc"))


# Conformal bounds of the template's residuals: lot i is tested, lot i - 1 calibrates.
_CONF = DECOMPOSED + """, pt AS (SELECT * FROM decomposed WHERE target = 'stepheight'), f AS (SELECT lot_number AS test_lot, lag(lot_number) OVER (ORDER BY lot_number) AS cal FROM (SELECT DISTINCT lot_number FROM pt)),
cal AS (SELECT test_lot, pt.experiment_key, x, y, abs(observed - template_prediction) AS e FROM pt JOIN f ON pt.lot_number = f.cal), nom AS (SELECT CAST(unnest([0.8, 0.9, 0.95]) AS DOUBLE) AS c),
pb AS (SELECT test_lot, x, y, c, list_sort(list(e))[CAST(least(ceil((count(*) + 1) * c), count(*)) AS BIGINT)] AS bound, CAST(least(ceil((count(*) + 1) * c), count(*)) AS INTEGER) AS rank, ceil((count(*) + 1) * c) <= count(*) AS attainable, 1.0 / (count(*) + 1) AS resolution FROM cal CROSS JOIN nom GROUP BY test_lot, x, y, c),
ms AS (SELECT test_lot, experiment_key, max(e) AS s FROM cal GROUP BY ALL), mb AS (SELECT test_lot, c, list_sort(list(s))[CAST(least(ceil((count(*) + 1) * c), count(*)) AS BIGINT)] AS bound FROM ms CROSS JOIN nom GROUP BY test_lot, c)"""


def _conformal(spark, sf):
    d = template.decompose(template.with_targets(tables.dense(spark, sf), ["stepheight"])).withColumn("predicted", F.col("template_prediction"))
    folds = resample.fit_calibrate_test(d, least_fit=0)
    cal = folds.filter("role = 'calibration'").withColumn("score", F.abs(F.col("predicted") - F.col("observed")))
    return folds.filter("role = 'test'"), cal


@query("conformal_bounds", sql(_CONF, f"SELECT test_lot, x, y, c AS nominal_coverage, {dr6('bound')}, rank, attainable, {dr6('resolution')} FROM pb"))
def conformal_bounds(spark, sf):
    b = conformal.bounds(_conformal(spark, sf)[1], ["test_lot", "x", "y"], "score", NOMINALS)
    return b.select("test_lot", "x", "y", "nominal_coverage", r6("bound"), "rank", "attainable", r6("resolution"))


_COVER = _CONF + """, tt AS (SELECT pt.lot_number AS test_lot, pt.experiment_key, nom.c, abs(observed - template_prediction) <= pb.bound AS ok, abs(observed - template_prediction) <= mb.bound AS mok, 2 * pb.bound AS w, 2 * mb.bound AS mw FROM pt CROSS JOIN nom JOIN pb ON pb.test_lot = pt.lot_number AND pb.x = pt.x AND pb.y = pt.y AND pb.c = nom.c JOIN mb ON mb.test_lot = pt.lot_number AND mb.c = nom.c),
wf AS (SELECT test_lot, c, experiment_key, bool_and(mok) AS a FROM tt GROUP BY ALL), wm AS (SELECT test_lot, c, avg(CAST(a AS INTEGER)) AS sc FROM wf GROUP BY ALL)"""


@query("conformal_coverage", sql(_COVER, f"SELECT test_lot, c AS nominal_coverage, {dr6('avg(CAST(ok AS INTEGER))', 'point_coverage')}, {dr6('any_value(sc)', 'simultaneous_coverage')}, {dr6('avg(w)', 'point_width')}, {dr6('any_value(mw)', 'simultaneous_width')} FROM tt JOIN wm USING (test_lot, c) GROUP BY test_lot, c"))
def conformal_coverage(spark, sf):
    test, cal = _conformal(spark, sf)
    pb = conformal.bounds(cal, ["test_lot", "x", "y"], "score", NOMINALS)
    mb = conformal.bounds(conformal.wafer_scores(cal, ["test_lot", "experiment_key"]), ["test_lot"], "score", NOMINALS)
    c = conformal.coverage(test, pb, mb)
    return c.select("test_lot", "nominal_coverage", *map(r6, ("point_coverage", "simultaneous_coverage", "point_width", "simultaneous_width")))


@query("uncertainty_gate", sql(_COVER + """, cl AS (SELECT test_lot, c, avg(CAST(ok AS INTEGER)) AS pc, any_value(sc) AS sc, avg(w) AS w FROM tt JOIN wm USING (test_lot, c) GROUP BY test_lot, c), base AS (SELECT lot_number AS test_lot, avg(abs(observed - template_prediction)) AS mae FROM pt GROUP BY ALL),
lv AS (SELECT c, avg(pc) AS pc, avg(sc) AS sc, avg(CASE WHEN pc >= c - 0.05 AND sc >= c - 0.05 THEN 1.0 ELSE 0.0 END) AS st, avg(w / 2 / mae) AS wd FROM cl JOIN base USING (test_lot) GROUP BY c),
reached AS (SELECT bool_and(attainable) AS a FROM (SELECT attainable FROM pb UNION ALL SELECT ceil((count(*) + 1) * c) <= count(*) FROM ms CROSS JOIN nom GROUP BY test_lot, c)),
ck AS (SELECT bool_and(pc >= c - 0.05 AND sc >= c - 0.05) AS coverage_within_tolerance, bool_and(wd <= 1.0) AS half_width_below_baseline, bool_and(st >= 0.7) AS stable_across_lots, any_value(a) AS levels_attainable FROM lv CROSS JOIN reached)""", "SELECT *, CASE WHEN coverage_within_tolerance AND half_width_below_baseline AND stable_across_lots AND levels_attainable THEN 'PASS' ELSE 'FAIL' END AS gate FROM ck"))
def uncertainty_gate(spark, sf):
    test, cal = _conformal(spark, sf)
    pb = conformal.bounds(cal, ["test_lot", "x", "y"], "score", NOMINALS)
    mb = conformal.bounds(conformal.wafer_scores(cal, ["test_lot", "experiment_key"]), ["test_lot"], "score", NOMINALS)
    base = test.groupBy("test_lot").agg(F.avg(F.abs(metrics.error())).alias("baseline_mae"))
    some = pb.select("nominal_coverage", "attainable").unionByName(mb.select("nominal_coverage", "attainable"))
    return conformal.uncertainty_gate(conformal.coverage(test, pb, mb), some, base)


@query("fit_cal_test_roles", sql(FACTS + ", d AS (SELECT DISTINCT lot_number, dense_rank() OVER (ORDER BY lot_number) AS k FROM facts)", "SELECT t.lot_number AS test_lot, CASE WHEN f.k = t.k THEN 'test' WHEN f.k = t.k - 1 THEN 'calibration' ELSE 'fit' END AS role, count(*) AS wafers FROM d t JOIN d f ON f.k <= t.k JOIN facts USING (lot_number) WHERE t.k > 3 GROUP BY ALL".replace("JOIN facts USING (lot_number)", "JOIN facts ON facts.lot_number = f.lot_number")))
def fit_cal_test_roles(spark, sf):
    return resample.fit_calibrate_test(facts(spark, sf)).groupBy("test_lot", "role").agg(F.count("*").alias("wafers"))


@query("expanding_window_template", sql(DECOMPOSED + ", e AS (SELECT lot_number, x, y, sum(s) OVER w AS s, sum(n) OVER w AS n FROM p WHERE target = 'stepheight' WINDOW w AS (PARTITION BY x, y ORDER BY lot_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", f"SELECT lot_number, x, y, {dr6('s / n', 'template')} FROM e WHERE lot_number > 3"))
def expanding_window_template(spark, sf):
    p = tables.dense(spark, sf).groupBy("x", "y", "lot_number").agg(F.sum("stepheight").alias("_s"), F.count("*").alias("_n"))
    return p.withColumn("t", resample.expanding_mean(p, ["x", "y"])).filter("lot_number > 3").select("lot_number", "x", "y", r6("t", "template"))


_STD = traces.FEATURES + ", lots AS (SELECT DISTINCT experiment_key, CAST(substr(experiment_key, 10, 1) AS INTEGER) AS lot_number FROM traces), fo AS (SELECT f.*, lot_number, held FROM features f JOIN lots USING (experiment_key) CROSS JOIN (SELECT DISTINCT lot_number AS held FROM lots) WHERE feature LIKE '%active_mean' OR feature LIKE '%cycle_mean_std'), st AS (SELECT held, feature, avg(value) AS m, stddev_pop(value) AS s, var_pop(value) AS v FROM fo WHERE lot_number <> held GROUP BY ALL HAVING var_pop(value) > 1e-12), zz AS (SELECT held AS held_out_lot, fo.experiment_key, lot_number, feature, (value - m) / s AS z FROM fo JOIN st USING (held, feature))"


def _standardized(spark, sf):
    f = traces.long_features(spark, sf).filter(F.col("feature").endswith("active_mean") | F.col("feature").endswith("cycle_mean_std")).withColumn("lot_number", F.substring("experiment_key", 10, 1).cast("int"))
    return risk.standardized(f)


@query("fold_standardize", sql(_STD, f"SELECT held_out_lot, experiment_key, feature, {dr6('z')} FROM zz"))
def fold_standardize(spark, sf):
    return _standardized(spark, sf).select("held_out_lot", "experiment_key", "feature", r6("z"))


@query("nearest_neighbor_ood", sql(_STD + ", dd AS (SELECT a.held_out_lot, a.experiment_key, b.experiment_key AS k, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM zz a JOIN zz b ON a.held_out_lot = b.held_out_lot AND a.feature = b.feature AND a.experiment_key <> b.experiment_key AND b.lot_number <> b.held_out_lot GROUP BY ALL)", f"SELECT held_out_lot, experiment_key, {dr6('min(d)', 'ood_distance')} FROM dd GROUP BY ALL"))
def nearest_neighbor_ood(spark, sf):
    z = _standardized(spark, sf).groupBy("held_out_lot", "experiment_key", "is_train").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "z"))), lambda s: s["z"]).alias("x"))
    return risk.nearest_training_distance(z).select("held_out_lot", "experiment_key", r6("ood_distance"))


@query("out_of_lot_z_scores", sql(traces.FEATURES + ", ins AS (SELECT * FROM features WHERE substr(experiment_key, 10, 1) = '2'), outs AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM features WHERE substr(experiment_key, 10, 1) <> '2' GROUP BY feature), z AS (SELECT experiment_key, feature, (value - m) / nullif(s, 0) AS z FROM ins JOIN outs USING (feature)), t AS (SELECT feature, row_number() OVER (ORDER BY max(abs(z)) DESC, feature) AS rank FROM z WHERE z IS NOT NULL GROUP BY feature)", f"SELECT experiment_key, feature, {dr6('z')}, CAST(rank AS INTEGER) AS rank FROM z JOIN t USING (feature) WHERE rank <= 12"))
def out_of_lot_z_scores(spark, sf):
    f = traces.long_features(spark, sf).filter("value is not null")
    keys = f.filter(F.substring("experiment_key", 10, 1) == "2").select("experiment_key").distinct()
    return metrics.out_of_lot_z(f, keys).select("experiment_key", "feature", r6("z"), "rank")


@query("lot_failure", sql(POINTS2 + f", w AS (SELECT experiment_key, avg(observed) FILTER (stage = 'template') AS o, avg(predicted) FILTER (stage = 'template') AS t, avg(predicted) FILTER (stage = 'mean_shift') AS s, avg(abs({_E})) FILTER (stage = 'template') AS a, avg(abs({_E})) FILTER (stage = 'mean_shift') AS b FROM pts WHERE lot_number = 3 GROUP BY 1)", f"SELECT experiment_key, CAST(split_part(experiment_key, '_', 2) AS INTEGER) AS wafer_order, {dr6('o', 'observed_mean')}, {dr6('t', 'template_mean')}, {dr6('o - t', 'true_shift')}, {dr6('s - t', 'predicted_shift')}, {dr6('a', 'template_mae')}, {dr6('b', 'mean_shift_mae')} FROM w"))
def lot_failure(spark, sf):
    f = metrics.lot_failure(points(spark, sf).withColumn("family", F.lit("oracle")), 3, "oracle")
    return f.select("experiment_key", "wafer_order", *map(r6, ("observed_mean", "template_mean", "true_shift", "predicted_shift", "template_mae", "mean_shift_mae")))


@query("cumulative_error", sql(FACTS, f"SELECT experiment_key, lot_number, wafer_order, {dr6('sum(error) OVER (ORDER BY lot_number, wafer_order ROWS UNBOUNDED PRECEDING)', 'cumulative_error')} FROM facts"))
def cumulative_error(spark, sf):
    c = metrics.cumulative(facts(spark, sf).withColumn("policy", F.lit("none")), ["policy"], ["lot_number", "wafer_order"], "error")
    return c.select("experiment_key", "lot_number", "wafer_order", r6("cumulative_error"))


@query("wafer_ordinal", sql(FACTS, "SELECT experiment_key, lot_number, wafer_order FROM facts"))
def wafer_ordinal(spark, sf):
    return facts(spark, sf).select("experiment_key", "lot_number", "wafer_order")


@query("representative_wafers", sql(FACTS + ", r AS (SELECT *, row_number() OVER (ORDER BY error, experiment_key) - 1 AS i, count(*) OVER () AS n FROM facts)", "SELECT max(experiment_key) FILTER (i = n // 2) AS median_key, arg_min(experiment_key, (error, experiment_key)) AS best_key, arg_max(experiment_key, (error, experiment_key)) AS worst_key FROM r"))
def representative_wafers(spark, sf):
    return metrics.representative(facts(spark, sf), "error")


# The online controller as a recursion over the wafers of a lot and budget.
_SCORED = FACTS + ", sc AS (SELECT lot_number, wafer_order, experiment_key, error, shift, score / (max(score) OVER (PARTITION BY lot_number)) AS s, CAST(count(*) OVER (PARTITION BY lot_number) AS INTEGER) AS n FROM facts)"
_QUOTA = _SCORED + """, bs AS (SELECT sc.*, b, CAST(least(round_even(b * n, 0), n) AS INTEGER) AS total FROM sc CROSS JOIN """ + _BUDGET + """),
q AS (SELECT lot_number, b, 0 AS i, 0 AS c, false AS measured FROM (SELECT DISTINCT lot_number, b FROM bs) UNION ALL
  SELECT q.lot_number, q.b, q.i + 1, q.c + CAST((q.c < total AND (q.c < total - (n - q.i - 1) OR (s >= 1 - q.b AND q.c < least(total, ceil(q.b * (q.i + 1)))))) AS INTEGER), (q.c < total AND (q.c < total - (n - q.i - 1) OR (s >= 1 - q.b AND q.c < least(total, ceil(q.b * (q.i + 1))))))
  FROM q JOIN bs ON bs.lot_number = q.lot_number AND bs.b = q.b AND bs.wafer_order = q.i + 1),
sel AS (SELECT bs.*, q.measured FROM bs JOIN q ON bs.lot_number = q.lot_number AND bs.b = q.b AND bs.wafer_order = q.i)"""


def scored(spark, sf):
    w = Window.partitionBy("lot_number")
    return facts(spark, sf).withColumn("score", F.col("score") / F.max("score").over(w))


def selected(spark, sf):
    return risk.causal_selection(scored(spark, sf), BUDGETS)


@query("causal_quota", "WITH RECURSIVE " + _QUOTA + " SELECT lot_number, b AS budget, wafer_order, experiment_key, measured FROM sel")
def causal_quota(spark, sf):
    return selected(spark, sf).select("lot_number", "budget", "wafer_order", "experiment_key", "measured")


@query("causal_replay_direct", "WITH RECURSIVE " + _QUOTA + f" SELECT lot_number, b AS budget, count(*) FILTER (measured) AS measured_wafers, {dr6('avg(CASE WHEN measured THEN 0 ELSE error END)', 'total_system_mae')} FROM sel GROUP BY lot_number, b")
def causal_replay_direct(spark, sf):
    s = selected(spark, sf).withColumn("system", F.when(F.col("measured"), 0.0).otherwise(F.col("error")))
    return s.groupBy("lot_number", "budget").agg(F.count_if("measured").alias("measured_wafers"), r6(F.avg("system"), "total_system_mae"))


_STREAM = _QUOTA + """, st AS (SELECT lot_number, b, wafer_order, error, measured, CASE WHEN measured THEN 0 ELSE error END AS sys, n, (SELECT quantile_cont(error, 0.6) FROM facts) AS lim, row_number() OVER (PARTITION BY lot_number, b ORDER BY error DESC, wafer_order) AS worst FROM sel),
su AS (SELECT *, min(wafer_order) FILTER (error > lim) OVER (PARTITION BY lot_number, b) AS onset FROM st)"""


@query("stream_metrics", "WITH RECURSIVE " + _STREAM + f""" SELECT lot_number, b AS budget, {dr6('avg(sys)', 'total_system_mae')}, {dr6('avg(error) FILTER (NOT measured)', 'unmeasured_wafer_mae')}, {dr6('avg(CAST(measured AS INTEGER))', 'measured_fraction')}, {dr6('count(*) FILTER (measured AND worst <= greatest(1, ceil(0.2 * n))) / greatest(1, ceil(0.2 * any_value(n)))', 'high_error_capture')}, {dr6('quantile_cont(sys, 0.95)', 'p95_system_error')},
  {dr6('sum(sys)', 'cumulative_system_error')}, count(*) FILTER (measured) AS measured_wafers, CAST(any_value(onset) AS BIGINT) AS drift_onset_wafer_order, CAST(CASE WHEN any_value(onset) IS NOT NULL THEN coalesce(min(wafer_order) FILTER (wafer_order > onset AND error <= lim) - any_value(onset), any_value(n) - any_value(onset) + 1) END AS BIGINT) AS recovery_wafer_count FROM su GROUP BY lot_number, b""")
def stream_metrics(spark, sf):
    f = facts(spark, sf)
    s = selected(spark, sf).crossJoin(F.broadcast(f.agg(F.percentile("error", F.lit(0.6)).alias("limit"))))
    s = s.withColumns({"true_error": F.col("error"), "system_error": F.when(F.col("measured"), 0.0).otherwise(F.col("error"))})
    m = risk.stream_metrics(s, F.col("limit"), ["lot_number", "budget"])
    return m.select("lot_number", "budget", *map(r6, ("total_system_mae", "unmeasured_wafer_mae", "measured_fraction", "high_error_capture", "p95_system_error", "cumulative_system_error")), "measured_wafers", "drift_onset_wafer_order", "recovery_wafer_count")


@query("feedback_bias_f1", "WITH RECURSIVE " + _QUOTA + f", fb AS (SELECT lot_number, b, 1 AS i, CAST(0 AS DOUBLE) AS bias FROM (SELECT DISTINCT lot_number, b FROM sel) UNION ALL SELECT fb.lot_number, fb.b, fb.i + 1, CASE WHEN measured THEN CAST(0.3 AS DOUBLE) * shift + (1 - CAST(0.3 AS DOUBLE)) * fb.bias ELSE fb.bias END FROM fb JOIN sel ON sel.lot_number = fb.lot_number AND sel.b = fb.b AND sel.wafer_order = fb.i) SELECT sel.lot_number, sel.b AS budget, wafer_order, {dr6('bias')} FROM sel JOIN fb ON sel.lot_number = fb.lot_number AND sel.b = fb.b AND sel.wafer_order = fb.i")
def feedback_bias_f1(spark, sf):
    return risk.bias_feedback(selected(spark, sf), 0.3).select("lot_number", "budget", "wafer_order", r6("bias"))


@query("ranking_only_selection", sql(_RANKED + f", k AS (SELECT r.*, b FROM r CROSS JOIN {_BUDGET})", f"SELECT lot_number, b AS budget, {dr6('avg(CASE WHEN rn <= least(round_even(b * n, 0), n) THEN 0 ELSE error END)', 'total_system_mae')} FROM k GROUP BY lot_number, b"))
def ranking_only_selection(spark, sf):
    s = risk.top_selection(facts(spark, sf), BUDGETS)
    return s.groupBy("lot_number", "budget").agg(r6(F.avg(F.when(F.col("measured"), 0.0).otherwise(F.col("error"))), "total_system_mae"))
