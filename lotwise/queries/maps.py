"""Queries over point maps: templates, decompositions, audits, calibrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import template as T
from lotwise.operators import validate as V
from lotwise.queries.registry import DECOMPOSED, DENSE, LONG, SPARSE, big, dr6, query, r6, sql
from lotwise.sources import tables


def decomposed(spark, sf):
    d = T.with_targets(tables.dense(spark, sf).drop("wafer"))
    return T.with_filled_flag(T.decompose(d))


@query("lolo_template_lot_macro_mae", sql(DECOMPOSED, f"SELECT lot_number, {dr6('avg(abs(observed - template_prediction))', 'template_mae')}, count(*) AS points FROM decomposed WHERE target = 'stepheight' GROUP BY lot_number"))
def lolo_template_lot_macro_mae(spark, sf):
    d = T.decompose(T.with_targets(tables.dense(spark, sf), ["stepheight"]))
    return d.groupBy("lot_number").agg(r6(F.avg(F.abs(F.col("observed") - F.col("template_prediction"))), "template_mae"), F.count("*").alias("points"))


@query("lolo_decompose_rows", sql(DECOMPOSED, f"SELECT target, experiment_key, lot_number, x, y, {dr6('observed')}, {dr6('global_prediction')}, {dr6('template_prediction')}, {dr6('mean_shift')}, {dr6('shifted', 'template_plus_true_mean_shift')}, {dr6('residual')}, outer_test_lot, filled AS postox_value_was_filled FROM decomposed"))
def lolo_decompose_rows(spark, sf):
    return decomposed(spark, sf).select("target", "experiment_key", "lot_number", "x", "y", *map(r6, ("observed", "global_prediction", "template_prediction", "mean_shift", "template_plus_true_mean_shift", "residual")), "outer_test_lot", "postox_value_was_filled")


WAFERS = DECOMPOSED + """, wafers AS (SELECT target, experiment_key, lot_number, outer_test_lot, avg(observed) AS observed_mean, avg(template_prediction) AS template_mean, any_value(mean_shift) AS mean_shift, avg(abs(residual)) AS residual_mae,
  sqrt(avg(residual * residual)) AS residual_rmse, max(abs(residual)) AS maximum_absolute_residual, CAST(count(*) FILTER (filled) AS BIGINT) AS postoxide_filled_points FROM decomposed GROUP BY ALL)"""
_W = ("observed_mean", "template_mean", "mean_shift", "residual_mae", "residual_rmse", "maximum_absolute_residual")


@query("wafer_summaries", sql(WAFERS, "SELECT target, experiment_key, lot_number, outer_test_lot, " + ", ".join(map(dr6, _W)) + ", postoxide_filled_points FROM wafers"))
def wafer_summaries(spark, sf):
    return T.wafer_summaries(decomposed(spark, sf)).select("target", "experiment_key", "lot_number", "outer_test_lot", *map(r6, _W), "postoxide_filled_points")


@query("lot_summaries", sql(WAFERS, f"SELECT target, lot_number, count(DISTINCT experiment_key) AS wafers, {dr6('avg(mean_shift)', 'mean_shift_mean')}, {dr6('coalesce(stddev_samp(mean_shift), 0)', 'mean_shift_std')}, {dr6('avg(residual_rmse)', 'residual_rmse_mean')}, {dr6('coalesce(stddev_samp(residual_rmse), 0)', 'residual_rmse_std')}, {dr6('max(maximum_absolute_residual)', 'maximum_absolute_residual')}, CAST(sum(postoxide_filled_points) AS BIGINT) AS postoxide_filled_points FROM wafers GROUP BY target, lot_number"))
def lot_summaries(spark, sf):
    s = T.lot_summaries(T.wafer_summaries(decomposed(spark, sf)))
    return s.select("target", "lot_number", "wafers", *map(r6, ("mean_shift_mean", "mean_shift_std", "residual_rmse_mean", "residual_rmse_std", "maximum_absolute_residual")), big("postoxide_filled_points"))


def _r2(p: str) -> str:
    return f"1.0 - sum((observed - {p}) * (observed - {p})) / nullif(count(*) * var_pop(observed), 0)"


@query("decomposition_summary", sql(DECOMPOSED + """, l AS (SELECT target, avg(e) AS a, avg(s) AS b FROM (SELECT target, lot_number, avg(abs(observed - template_prediction)) AS e, avg(abs(residual)) AS s FROM decomposed GROUP BY ALL) GROUP BY target),
w AS (SELECT target, avg(r) AS a, median(r) AS b, stddev_samp(m) AS c FROM (SELECT target, experiment_key, sqrt(avg(residual * residual)) AS r, any_value(mean_shift) AS m FROM decomposed GROUP BY ALL) GROUP BY target),
q AS (SELECT target, count(*) AS n, count(DISTINCT experiment_key) AS wafers, count(DISTINCT lot_number) AS lots, """ + f"{_r2('global_prediction')} AS g, {_r2('template_prediction')} AS t, {_r2('shifted')} AS o, avg(abs(observed - template_prediction)) AS e, avg(abs(residual)) AS s, count(*) FILTER (filled) AS f FROM decomposed GROUP BY target)",
    f"SELECT target, n AS rows, wafers, lots, {dr6('g', 'global_r2')}, {dr6('t', 'template_r2')}, t >= 0.95 AS template_dominant, {dr6('o', 'true_mean_shift_oracle_r2')}, {dr6('e', 'template_mae')}, {dr6('l.a', 'template_lot_macro_mae')}, {dr6('q.s', 'true_mean_shift_oracle_mae')}, {dr6('l.b', 'true_mean_shift_oracle_lot_macro_mae')}, {dr6('w.a', 'wafer_residual_rmse_mean')}, {dr6('w.b', 'wafer_residual_rmse_median')}, {dr6('w.c', 'mean_shift_standard_deviation')}, f AS postoxide_filled_rows FROM q JOIN l USING (target) JOIN w USING (target)"))
def decomposition_summary(spark, sf):
    s = T.decomposition_summary(decomposed(spark, sf))
    return s.select("target", "rows", "wafers", "lots", r6("global_r2"), r6("template_r2"), "template_dominant", *map(r6, ("true_mean_shift_oracle_r2", "template_mae", "template_lot_macro_mae", "true_mean_shift_oracle_mae", "true_mean_shift_oracle_lot_macro_mae", "wafer_residual_rmse_mean", "wafer_residual_rmse_median", "mean_shift_standard_deviation")), "postoxide_filled_rows")


@query("template_audit_r2", sql(DECOMPOSED + ", o AS (SELECT *, avg(observed) OVER (PARTITION BY target, experiment_key) + template_prediction - avg(template_prediction) OVER (PARTITION BY target, experiment_key) AS oracle FROM decomposed)", f"SELECT target, {dr6(_r2('template_prediction'), 'template_r2')}, {dr6(_r2('oracle'), 'oracle_r2')} FROM o GROUP BY target"))
def template_audit_r2(spark, sf):
    return T.audit_r2(T.with_targets(tables.dense(spark, sf))).select("target", r6("template_r2"), r6("oracle_r2"))


@query("dense_validation_counts", sql(DENSE, "SELECT (SELECT count(*) FROM dense) AS rows, CAST(0 AS BIGINT) AS null_ids, (SELECT count(*) FROM dense) - (SELECT count(*) FROM (SELECT DISTINCT experiment_key, x, y FROM dense)) AS repeated_points, CAST(0 AS BIGINT) AS non_finite, (SELECT count(DISTINCT n) FROM (SELECT count(*) AS n FROM dense GROUP BY experiment_key)) AS point_counts, CAST(0 AS BIGINT) AS wafers_in_several_lots"))
def dense_validation_counts(spark, sf):
    v = V.dense_violations(tables.dense(spark, sf), T.TARGETS)
    return v.select(*[big(c) for c in v.columns])


@query("measurement_audit", sql(DENSE + ", " + SPARSE, """SELECT * FROM (
  SELECT 'dense_rows' AS metric, count(*) AS value FROM dense UNION ALL SELECT 'dense_wafers', count(DISTINCT experiment_key) FROM dense
  UNION ALL SELECT 'dense_coordinates', count(*) FROM (SELECT DISTINCT x, y FROM dense) UNION ALL SELECT 'missing_raw_postoxide', count(*) FROM dense WHERE postox_thickness_nan IS NULL
  UNION ALL SELECT 'missing_filled_postoxide', count(*) FROM dense WHERE postox_thickness IS NULL UNION ALL SELECT 'sparse_rows', count(*) FROM sparse
  UNION ALL SELECT 'sparse_wafers', count(DISTINCT experiment_key) FROM sparse UNION ALL SELECT 'sparse_rows_without_key', count(*) FROM sparse WHERE experiment_key IS NULL
  UNION ALL SELECT 'sparse_coordinates', count(*) FROM (SELECT DISTINCT x, y FROM sparse) UNION ALL SELECT 'paired_rows', count(*) FROM sparse JOIN dense USING (experiment_key, x, y)
  UNION ALL SELECT 'paired_wafers', count(DISTINCT experiment_key) FROM sparse JOIN dense USING (experiment_key, x, y)
  UNION ALL SELECT 'coordinates_of_sparse_only', count(*) FROM (SELECT x, y FROM sparse EXCEPT SELECT x, y FROM dense))"""))
def measurement_audit(spark, sf):
    return V.measurement_audit(tables.dense(spark, sf), tables.sparse(spark, sf)).select("metric", big("value"))


@query("formula_audit", sql(DENSE + ", " + SPARSE, f"SELECT 'dense' AS tool, {dr6('max(abs(stepheight - postox_thickness - si_etch))', 'maximum_absolute_difference')} FROM dense UNION ALL SELECT 'sparse', floor(max(abs(stepheight - oxide_etch - si_etch)) * 1e6 + 0.4997) / 1e6 FROM sparse"))
def formula_audit(spark, sf):
    return V.formula_audit(tables.dense(spark, sf), tables.sparse(spark, sf)).select("tool", r6("maximum_absolute_difference"))


PAIRED = DENSE + ", " + SPARSE + """, paired AS (SELECT d.experiment_key, d.lot_number, d.x, d.y, d.target, s.v AS sparse_value, d.v AS dense_value FROM
  (SELECT * FROM (SELECT experiment_key, lot_number, x, y, stepheight, oxide_etch, si_etch FROM dense) UNPIVOT (v FOR target IN (stepheight, oxide_etch, si_etch))) d JOIN
  (SELECT * FROM (SELECT experiment_key, x, y, stepheight, oxide_etch, si_etch FROM sparse WHERE experiment_key IS NOT NULL) UNPIVOT (v FOR target IN (stepheight, oxide_etch, si_etch))) s USING (experiment_key, x, y, target))"""


@query("cross_tool_bias", sql(PAIRED, f"SELECT target, count(*) AS paired_points, {dr6('avg(sparse_value - dense_value)', 'bias')}, {dr6('avg(abs(sparse_value - dense_value))', 'mae')}, {dr6('corr(sparse_value, dense_value)', 'pearson')} FROM paired GROUP BY target"))
def cross_tool_bias(spark, sf):
    return T.tool_bias(T.paired_tools(tables.sparse(spark, sf), tables.dense(spark, sf))).select("target", "paired_points", r6("bias"), r6("mae"), r6("pearson"))


@query("cross_tool_lolo_median_calibration", sql(PAIRED + """, f AS (SELECT DISTINCT lot_number AS held FROM paired), o AS (SELECT target, held AS lot_number, x, y, median(sparse_value - dense_value) AS offs FROM paired JOIN f ON lot_number <> held GROUP BY ALL),
l AS (SELECT target, lot_number, avg(abs(sparse_value - dense_value)) AS raw, avg(abs(sparse_value - dense_value - offs)) AS cal FROM paired JOIN o USING (target, lot_number, x, y) GROUP BY ALL)""", f"SELECT target, {dr6('avg(raw)', 'raw_lot_macro_mae')}, {dr6('avg(cal)', 'calibrated_lot_macro_mae')}, count(*) FILTER (cal < raw) AS lots_improved, count(*) AS lots FROM l GROUP BY target"))
def cross_tool_lolo_median_calibration(spark, sf):
    c = T.median_calibration(T.paired_tools(tables.sparse(spark, sf), tables.dense(spark, sf)))
    return c.select("target", r6("raw_lot_macro_mae"), r6("calibrated_lot_macro_mae"), "lots_improved", "lots")


@query("coordinate_zones", sql(DENSE + ", c AS (SELECT DISTINCT x, y FROM dense), m AS (SELECT *, sqrt(x * x + y * y) / max(sqrt(x * x + y * y)) OVER () AS s FROM c)", "SELECT x, y, CASE WHEN s <= 1.0 / 3 THEN 'center' WHEN s <= 2.0 / 3 THEN 'middle' ELSE 'edge' END AS zone FROM m"))
def coordinate_zones(spark, sf):
    return T.coordinate_zones(tables.dense(spark, sf).select("x", "y").distinct())


@query("ordered_map_rows", sql(DENSE, f"SELECT experiment_key, lot_number, count(*) AS points, {dr6('arg_min(stepheight, (y, x))', 'first_value')}, {dr6('arg_max(stepheight, (y, x))', 'last_value')} FROM dense WHERE wafer IN (SELECT user_id FROM events) GROUP BY ALL"))
def ordered_map_rows(spark, sf):
    m = V.ordered_maps(tables.dense(spark, sf), tables.traces(spark, sf), "stepheight")
    return m.select("experiment_key", "lot_number", big(F.size("map"), "points"), r6(F.col("map")[0], "first_value"), r6(F.element_at("map", -1), "last_value"))


@query("dictionary_decode", "SELECT CAST(code AS INTEGER) AS code, count(*) AS n, floor(avg(code / 100.0) * 1e6 + 0.4997) / 1e6 AS value FROM (SELECT floor((1.0 + CAST(unnest(embedding) AS DOUBLE)) * 100) AS code FROM embeddings) GROUP BY code")
def dictionary_decode(spark, sf):
    s = tables.spectra(spark, sf).select(F.explode("intensity").alias("v")).select(F.floor(F.col("v") * 100).cast("int").alias("code"))
    dictionary = spark.range(1001).select(F.col("id").cast("int").alias("code"), (F.col("id") / 100.0).alias("value"))
    return V.decode(s.groupBy("code").agg(F.count("*").alias("n")), dictionary).select("code", "n", r6("value"))
