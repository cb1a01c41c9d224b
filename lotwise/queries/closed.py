"""Model queries whose fits have a closed form in SQL: one latent component, ridge on two features, stages without a model.

The job is that of the nested evaluation with fewer candidates or features, so what SQL confirms here is its folds,
standardisation, templates, shifts, choices and summaries; components of residuals have no closed form and are tested
on their kernels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import metrics, risk, template
from lotwise.plans import analyses, models
from lotwise.queries.models import NAMES, _errors, _placed, rows
from lotwise.queries.policies import _draws
from lotwise.queries.registry import DENSE, dr6, query, r6, sql
from lotwise.queries.traces import FEATURES

ONE = {"pls": (1,)}
#: Two features that differ, and what is fitted on them.
TWO = ("gas_long__active_mean", "rf__active_std")
ALPHAS = models.PARAMETERS["ridge"]
_PLACES = {"two": [sorted(NAMES).index(n) for n in TWO]}

# Wafers with a map: v at each place, and features. A fold (f, tested) learns from the lots that ``learns`` keeps.
_BASE = FEATURES + ", " + DENSE + """, ft AS (SELECT experiment_key, feature, value FROM features WHERE value IS NOT NULL),
pt AS (SELECT experiment_key, lot_number AS lot, x, y, stepheight AS v FROM dense WHERE experiment_key IN (SELECT experiment_key FROM ft)),
wf AS (SELECT DISTINCT experiment_key, lot FROM pt), fv AS (SELECT ft.*, lot FROM ft JOIN wf USING (experiment_key)), lots AS (SELECT DISTINCT lot FROM wf)"""


def _folds(p: str, folds: str, learns: str, some: str = "true") -> str:
    """CTEs after ``_BASE``, their names with prefix p: template, shifts and standard features of folds(f, tested, ..)."""
    return f""", {p}fo AS ({folds}), {p}tp AS (SELECT f, x, y, avg(v) AS t FROM pt JOIN {p}fo ON {learns} GROUP BY ALL), {p}lv AS (SELECT f, avg(t) AS level FROM {p}tp GROUP BY f),
{p}sh AS (SELECT f, experiment_key, lot, avg(v) - any_value(level) AS s, bool_and({learns}) AS tr, any_value(tested) AS tested FROM pt JOIN {p}fo ON ({learns}) OR lot = tested JOIN {p}lv USING (f) GROUP BY f, experiment_key, lot),
{p}std AS (SELECT f, feature, avg(value) AS m, stddev_pop(value) AS d FROM fv JOIN {p}fo ON {learns} WHERE {some} GROUP BY ALL HAVING var_pop(value) > 1e-12),
{p}z AS (SELECT f, experiment_key, feature, (value - m) / d AS z, s, tr FROM fv JOIN {p}std USING (feature) JOIN {p}sh USING (f, experiment_key))"""


def _pls(p: str) -> str:
    """The one latent component: weights are the features' sums with the shift; {p}pr has the predicted shift of every wafer of a fold."""
    return f""", {p}w AS (SELECT f, feature, sum(z * s) AS w FROM {p}z WHERE tr GROUP BY ALL), {p}ti AS (SELECT f, experiment_key, sum(z * w) AS t FROM {p}z JOIN {p}w USING (f, feature) GROUP BY ALL),
{p}q AS (SELECT f, sum(t * s) / sum(t * t) AS q FROM {p}ti JOIN {p}sh USING (f, experiment_key) WHERE tr GROUP BY f), {p}pr AS (SELECT f, experiment_key, t * q AS shift FROM {p}ti JOIN {p}q USING (f))"""


def _errors_sql(p: str, pr: str, out: str) -> str:
    """(f, experiment_key, lot, mae, rmse) of the tested lot's wafers by template and predicted shift."""
    return f""", {out} AS (SELECT f, experiment_key, pt.lot, avg(abs(t + shift - v)) AS mae, sqrt(avg((t + shift - v) * (t + shift - v))) AS rmse FROM {p}sh JOIN {pr} USING (f, experiment_key) JOIN pt USING (experiment_key) JOIN {p}tp USING (f, x, y) WHERE NOT tr GROUP BY f, experiment_key, pt.lot)"""


_LOLO, _NOT_HELD = "SELECT lot AS f, lot AS tested FROM lots", "lot <> tested"


def _shift(facts):
    return _errors(facts).filter("stage = 'mean_shift'")


@query("lolo_stages_without_model", sql(_BASE + _folds("a", _LOLO, _NOT_HELD) + ", st AS (SELECT 'template' AS stage, f, experiment_key, 0 AS shift FROM ash UNION ALL SELECT 'oracle_zero_residual', f, experiment_key, s FROM ash)" + """,
e AS (SELECT stage, experiment_key, pt.lot, avg(abs(t + shift - v)) AS mae, sqrt(avg((t + shift - v) * (t + shift - v))) AS rmse FROM ash JOIN st USING (f, experiment_key) JOIN pt USING (experiment_key) JOIN atp USING (f, x, y) WHERE NOT tr GROUP BY ALL),
l AS (SELECT stage, lot, avg(mae) AS mae, avg(rmse) AS rmse FROM e GROUP BY ALL), m AS (SELECT stage, count(*) AS lots, avg(mae) AS a, avg(rmse) AS b FROM l GROUP BY stage)""",
    f"SELECT stage, count(*) AS wafers, {dr6('avg(mae)', 'wafer_macro_mae')}, {dr6('avg(rmse)', 'wafer_macro_rmse')}, any_value(lots) AS lots, {dr6('any_value(a)', 'lot_macro_mae')}, {dr6('any_value(b)', 'lot_macro_rmse')} FROM e JOIN m USING (stage) GROUP BY stage"))
def lolo_stages_without_model(spark, sf):
    """The template and the true shift, as the nested evaluation gives them."""
    e = _errors(models.evaluate_folds(rows(spark, sf), ("pls",), ONE)).filter("stage IN ('template', 'oracle_zero_residual')")
    s = metrics.stage_summary(e, ["mae", "rmse"], ["stage"])
    return s.select("stage", "wafers", r6("wafer_macro_mae"), r6("wafer_macro_rmse"), "lots", r6("lot_macro_mae"), r6("lot_macro_rmse"))


_PLS = _BASE + _folds("a", _LOLO, _NOT_HELD) + _pls("a") + _errors_sql("a", "apr", "ae")


@query("lolo_pls_shift", sql(_PLS, f"SELECT experiment_key, lot AS lot_number, {dr6('mae')}, {dr6('rmse')} FROM ae"))
def lolo_pls_shift(spark, sf):
    """One latent component for the shift, leave-one-lot-out: each wafer's errors."""
    return _shift(models.evaluate_folds(rows(spark, sf), ("pls",), ONE)).select("experiment_key", "lot_number", r6("mae"), r6("rmse"))


_FORWARD = "SELECT lot AS f, lot AS tested FROM (SELECT lot, row_number() OVER (ORDER BY lot) AS k FROM lots) WHERE k > 3"


@query("forward_pls_shift", sql(_PLS + _folds("b", _FORWARD, "lot < tested") + _pls("b") + _errors_sql("b", "bpr", "be") + """, a1 AS (SELECT lot, avg(mae) AS lolo FROM ae GROUP BY lot), b1 AS (SELECT lot, avg(mae) AS ch FROM be GROUP BY lot), j AS (SELECT * FROM a1 JOIN b1 USING (lot)),
u AS (SELECT 'lot' AS scope, lot AS lot_number, lolo, ch FROM j UNION ALL SELECT 'macro', NULL, avg(lolo), avg(ch) FROM j)""", f"SELECT scope, 'pls' AS family, lot_number, {dr6('lolo', 'lolo_mae')}, {dr6('ch', 'chronological_mae')}, {dr6('ch / nullif(lolo, 0) - 1', 'relative_degradation')} FROM u"))
def forward_pls_shift(spark, sf):
    """Earlier lots only against leave-one-lot-out, by lot and as means of lots."""
    r = rows(spark, sf)
    c = models.compare(_shift(models.evaluate_folds(r, ("pls",), ONE, forward=True)), _shift(models.evaluate_folds(r, ("pls",), ONE)))
    return c.select("scope", "family", "lot_number", r6("lolo_mae"), r6("chronological_mae"), r6("relative_degradation"))


@query("pls_shift_stability", sql(_PLS + """, n2 AS (SELECT f, count(*) AS p, sum(w * w) AS n FROM aw GROUP BY f), im AS (SELECT f, feature, sqrt(p * w * w / n) AS importance, sign(w * q) AS sg FROM aw JOIN n2 USING (f) JOIN aq USING (f)),
rk AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY importance DESC, feature) <= 5 AS top FROM im)""", f"SELECT feature, {dr6('avg(CAST(top AS INTEGER))', 'top_frequency')}, {dr6('median(importance)', 'median_importance')}, {dr6('avg(CASE WHEN sg > 0 THEN 1.0 ELSE 0.0 END)', 'positive_sign_fraction')} FROM rk GROUP BY feature"))
def pls_shift_stability(spark, sf):
    """Importance in projection and sign of every feature over the folds, and how often it is among the first five."""
    s = models.stability(models.evaluate_folds(rows(spark, sf), ("pls",), ONE), NAMES, top=5)
    return metrics.stability_rollup(s, top=len(NAMES)).select("feature", r6("top_20_frequency", "top_frequency"), r6("median_importance"), r6("positive_sign_fraction"))


_SUBSET = " UNION ALL ".join(f"SELECT '{name}' AS ablation, unnest([{', '.join(repr(s) for g in groups for s in models.FEATURE_GROUPS[g])}]) AS st" for name, groups in models.CUMULATIVE.items())


@query("ablation_pls_shift", sql(_BASE + _folds("a", _LOLO, _NOT_HELD) + f""", ksb AS ({_SUBSET}), az2 AS (SELECT az.*, ablation FROM az JOIN ksb ON split_part(feature, '__', 2) = st),
kw AS (SELECT ablation, f, feature, sum(z * s) AS w FROM az2 WHERE tr GROUP BY ALL), kt AS (SELECT ablation, f, experiment_key, any_value(s) AS s, bool_and(tr) AS tr, sum(z * w) AS t FROM az2 JOIN kw USING (ablation, f, feature) GROUP BY ALL),
kq AS (SELECT ablation, f, sum(t * s) / sum(t * t) AS q FROM kt WHERE tr GROUP BY ALL), ke AS (SELECT ablation, experiment_key, pt.lot, avg(abs(atp.t + kt.t * kq.q - v)) AS mae FROM kt JOIN kq USING (ablation, f) JOIN pt USING (experiment_key) JOIN atp USING (f, x, y) WHERE NOT tr GROUP BY ALL),
kl AS (SELECT ablation, lot, avg(mae) AS mae FROM ke GROUP BY ALL), kg AS (SELECT *, lag(ablation) OVER (PARTITION BY lot ORDER BY ablation) AS prev, lag(mae) OVER (PARTITION BY lot ORDER BY ablation) AS before FROM kl)""",
    f"SELECT ablation, max(prev) AS previous, count(*) AS lots, count(*) FILTER (mae < before) AS lots_improved, {dr6('avg(mae)', 'lot_macro_mae')}, {dr6('1 - avg(mae) / avg(before)', 'relative_gain')} FROM kg GROUP BY ablation"))
def ablation_pls_shift(spark, sf):
    """Cumulative feature groups with one latent component: all of one moment matrix, each against the one before."""
    e = _shift(models.evaluate_folds(rows(spark, sf), ("pls",), ONE, subsets=models.ablation_subsets(NAMES, families=False)))
    return models.ablation_steps(e).select("ablation", "previous", "lots", "lots_improved", r6("lot_macro_mae"), r6("relative_gain"))


# Ridge on two standard features: with n wafers and their product r, (n + a) r; r (n + a) is solved by its determinant.
_TWO = f"feature IN {TWO!r}"


def _ridge(p: str, alphas: str) -> str:
    """{p}pr has the predicted shift of every wafer of a fold for each alpha."""
    return f""", {p}pv AS (SELECT f, experiment_key, any_value(s) AS s, bool_and(tr) AS tr, max(z) FILTER (feature = '{TWO[0]}') AS za, max(z) FILTER (feature = '{TWO[1]}') AS zb FROM {p}z GROUP BY ALL),
{p}mo AS (SELECT f, count(*) AS n, sum(za * zb) AS r, sum(za * s) AS ca, sum(zb * s) AS cb FROM {p}pv WHERE tr GROUP BY f), {p}co AS (SELECT f, a, ((n + a) * ca - r * cb) / ((n + a) * (n + a) - r * r) AS wa, ((n + a) * cb - r * ca) / ((n + a) * (n + a) - r * r) AS wb FROM {p}mo CROSS JOIN ({alphas})),
{p}rr AS (SELECT f, a, experiment_key, tr, s, za * wa + zb * wb AS shift FROM {p}pv JOIN {p}co USING (f))"""


_LABELS = "SELECT CAST(unnest([" + ", ".join(map(str, ALPHAS)) + "]) AS DOUBLE) AS a, unnest([" + ", ".join(f"'{a:g}'" for a in ALPHAS) + "]) AS label"


@query("nested_ridge_two_features", sql(_BASE + _folds("a", _LOLO, _NOT_HELD, _TWO) + _ridge("a", _LABELS.split(", unnest(['")[0]) + _folds("i", "SELECT 1000 * o.lot + n.lot AS f, n.lot AS tested, o.lot AS held FROM lots o JOIN lots n ON o.lot <> n.lot", "lot <> tested AND lot <> held", _TWO) + _ridge("i", _LABELS.split(", unnest(['")[0]) + f""",
ie AS (SELECT f, a, avg(abs(shift - s)) AS e FROM irr WHERE NOT tr GROUP BY ALL), ch AS (SELECT f // 1000 AS f, a, label, avg(e) AS e FROM ie JOIN ({_LABELS}) USING (a) GROUP BY ALL), best AS (SELECT f, arg_min(a, (e, label)) AS a, arg_min(label, (e, label)) AS label, min(e) AS e FROM ch GROUP BY f),
pr AS (SELECT f, experiment_key, shift FROM arr JOIN best USING (f, a))""" + _errors_sql("a", "pr", "oe"), f"SELECT best.f AS held_out_lot, label AS mean_parameter, {dr6('best.e', 'mean_inner_lot_macro_mae')}, {dr6('avg(mae)', 'mae')}, {dr6('avg(rmse)', 'rmse')} FROM best JOIN oe USING (f) GROUP BY best.f, label, best.e"))
def nested_ridge_two_features(spark, sf):
    """Ridge on two features: the penalty that inner folds choose, its inner error, and the outer errors."""
    facts = models.evaluate_folds(rows(spark, sf), ("ridge",), subsets=_PLACES).cache()
    e = _shift(facts).groupBy(F.col("lot_number").alias("held_out_lot")).agg(r6(F.avg("mae"), "mae"), r6(F.avg("rmse"), "rmse"))
    return models.folds(facts).select("held_out_lot", "mean_parameter", r6("mean_inner_lot_macro_mae")).join(e, "held_out_lot")


_BOTH = _BASE + _folds("a", _LOLO, _NOT_HELD, _TWO) + _pls("a") + _ridge("a", "SELECT 10.0 AS a") + _errors_sql("a", "apr", "pe") + _errors_sql("a", "arr", "re").replace("JOIN arr USING (f, experiment_key)", "JOIN (SELECT f, experiment_key, shift FROM arr) USING (f, experiment_key)")
_PAIR = {"pls": (1,), "ridge": (10.0,)}


def _pair(spark, sf):
    """Facts of both families on two features; what the shift predicts stands as the full map."""
    facts = models.evaluate_folds(rows(spark, sf), ("pls", "ridge"), _PAIR, subsets=_PLACES)
    return facts.filter("stage = 'mean_shift'").withColumn("stage", F.lit("full_map"))


@query("disagreement_two_features", sql(_BOTH, f"SELECT lot AS lot_number, experiment_key, {dr6('abs(apr.shift - arr.shift)', 'model_disagreement')} FROM ash JOIN apr USING (f, experiment_key) JOIN arr USING (f, experiment_key) WHERE NOT ash.tr"))
def disagreement_two_features(spark, sf):
    """How far the shifts of one latent component and of ridge are apart."""
    p = models.points(_pair(spark, sf)).withColumns({"x": F.col("place"), "y": F.lit(0)})
    return risk.model_disagreement(p).select("lot_number", "experiment_key", r6("model_disagreement"))


_E2 = _BOTH + ", e AS (SELECT 'pls' AS family, * FROM pe UNION ALL SELECT 'ridge', * FROM re), l AS (SELECT family, lot, avg(mae) AS mae, avg(rmse) AS rmse FROM e GROUP BY ALL)"


def _benchmark(spark, sf):
    facts = _pair(spark, sf)
    e = metrics.wafer_errors(models.points(facts), ["family", "stage", "experiment_key", "lot_number"])
    return analyses.model_benchmark(e, models.points(facts), other="ridge", seed=20260721)


@query("benchmark_two_features", sql(_E2 + ", b AS (SELECT arg_min(family, (mae, family)) AS family FROM l GROUP BY lot), m AS (SELECT family, count(*) AS lots, avg(mae) AS a, avg(rmse) AS b FROM l GROUP BY family)", f"SELECT e.family, count(*) AS wafers, {dr6('avg(mae)', 'wafer_macro_mae')}, {dr6('avg(rmse)', 'wafer_macro_rmse')}, {dr6('median(mae)', 'median_wafer_mae')}, any_value(lots) AS lots, {dr6('any_value(a)', 'lot_macro_mae')}, {dr6('any_value(b)', 'lot_macro_rmse')}, (SELECT count(*) FROM b WHERE b.family = e.family) AS best_lots FROM e JOIN m USING (family) GROUP BY e.family"))
def benchmark_two_features(spark, sf):
    """Families side by side: macro errors, the median wafer, and lots won."""
    s = _benchmark(spark, sf)["summary"]
    return s.select("family", "wafers", *map(r6, ("wafer_macro_mae", "wafer_macro_rmse", "median_wafer_mae")), "lots", r6("lot_macro_mae"), r6("lot_macro_rmse"), "best_lots")


_INTERVAL = ", ".join(dr6(v, k) for k, v in {"bootstrap_mean": "avg(s)", "p025": "quantile_cont(s, 0.025)", "p975": "quantile_cont(s, 0.975)", "probability_negative": "avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END)"}.items())


@query("benchmark_change_two_features", sql(_E2 + ", s2 AS (SELECT lot, sum(mae) FILTER (family = 'ridge') AS a, sum(mae) FILTER (family = 'pls') AS b FROM e GROUP BY lot), num AS (SELECT *, row_number() OVER (ORDER BY lot) - 1 AS i FROM s2), " + _draws("s2", "n") + ", boot AS (SELECT rep, sum(a) / sum(b) - 1 AS s FROM draws JOIN num USING (i) GROUP BY rep)", f"SELECT {_INTERVAL}, (SELECT {dr6('sum(a) / sum(b) - 1', 'o').removesuffix(' AS o')} FROM s2) AS observed_relative_change FROM boot"))
def benchmark_change_two_features(spark, sf):
    """The relative change of one family's error, with its interval over lots drawn with replacement."""
    c = _benchmark(spark, sf)["change"]
    return c.select(*map(r6, ("bootstrap_mean", "p025", "p975", "probability_negative", "observed_relative_change")))


@query("spatial_gate_of_true_shift", sql(_BASE + _folds("a", _LOLO, _NOT_HELD) + ", kw AS (SELECT experiment_key, pt.lot, avg(abs(t - v)) AS a, avg(abs(t + s - v)) AS b FROM ash JOIN pt USING (experiment_key) JOIN atp USING (f, x, y) WHERE NOT tr GROUP BY ALL), l AS (SELECT lot, avg(a) AS a, avg(b) AS b FROM kw GROUP BY lot), num AS (SELECT *, row_number() OVER (ORDER BY lot) - 1 AS i FROM l), " + _draws("l", "n").replace("20260721", "20260726") + ", boot AS (SELECT rep, 1 - sum(b) / sum(a) AS s FROM draws JOIN num USING (i) GROUP BY rep), o AS (SELECT 1 - avg(b) / avg(a) AS gain, count(*) FILTER (b < a) AS lots_improved, count(*) AS lots FROM l)", f"SELECT {_INTERVAL}, {dr6('any_value(gain)', 'gain')}, any_value(lots_improved) AS lots_improved, any_value(lots) AS lots, CASE WHEN any_value(gain) >= 0.05 AND quantile_cont(s, 0.025) > 0 AND any_value(lots_improved) >= 7 THEN 'PASS' WHEN any_value(gain) <= 0 THEN 'FAIL' ELSE 'QUALIFIED' END AS gate FROM boot CROSS JOIN o"))
def spatial_gate_of_true_shift(spark, sf):
    """The gate of the residual stage, asked of the true shift against the template."""
    facts = models.evaluate_folds(rows(spark, sf), ("pls",), ONE).filter("stage IN ('template', 'oracle_zero_residual')")
    facts = facts.withColumn("stage", F.when(F.col("stage") == "template", "mean_shift").otherwise("full_map"))
    p, xy = _placed(spark, sf, facts)
    g = analyses.spatial_decomposition(p, template.coordinate_zones(xy))["gate"]
    return g.select(*map(r6, ("bootstrap_mean", "p025", "p975", "probability_negative", "gain")), "lots_improved", "lots", "gate")
