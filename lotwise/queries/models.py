"""Queries of nested model evaluations; what they fit is beyond SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.operators import conformal, features, metrics, resample, risk, template, validate
from lotwise.plans import analyses, models
from lotwise.queries import traces
from lotwise.queries.policies import selected
from lotwise.queries.registry import query, r6
from lotwise.sources import tables
from lotwise.sources.shared import written


NAMES = [f"{s}__{t}" for s in tables.SIGNALS for t in features.STATISTICS]


def _rows(spark, sf):
    """Long features and maps. Both are met by checks, by fits and by scores, so they are written: traces are gone through once."""
    f = written(traces.long_features(spark, sf).filter("value is not null"), "features")
    return f, validate.ordered_maps(written(tables.dense(spark, sf), "dense"), f, "stepheight")


def rows(spark, sf):
    return models.modelling_rows(*_rows(spark, sf))


def _errors(facts):
    return metrics.wafer_errors(models.points(facts), ["family", "ablation", "stage", "experiment_key", "lot_number"])


@query("nested_lolo")
def nested_lolo(spark, sf):
    """Ridge and partial least squares, leave-one-lot-out, by stage: lot-macro errors."""
    e = _errors(models.evaluate_folds(rows(spark, sf), ("ridge", "pls")))
    return metrics.stage_summary(e, ["mae", "rmse"], ["family", "stage"])


@query("nested_lolo_folds")
def nested_lolo_folds(spark, sf):
    return models.folds(models.evaluate_folds(rows(spark, sf), ("pls",)))


@query("gpr_nested_lolo")
def gpr_nested_lolo(spark, sf):
    facts = models.evaluate_folds(rows(spark, sf), ("gpr",))
    p = models.points(facts).filter("stage = 'full_map'")
    return p.groupBy("lot_number").agg(r6(F.avg(F.abs(metrics.error())), "mae")).join(metrics.interval_coverage(p, by=["lot_number"]), "lot_number")


@query("chronological_vm")
def chronological_vm(spark, sf):
    """Ridge, partial least squares and a process whose kernel is fitted: earlier lots only against leave-one-lot-out."""
    r = rows(spark, sf)
    at = lambda forward: _errors(models.evaluate_folds(r, tuple(models.CHRONOLOGICAL), models.CHRONOLOGICAL, forward=forward)).filter("stage = 'full_map'")
    return models.compare(at(True), at(False))


@query("feature_ablation")
def feature_ablation(spark, sf):
    facts = models.evaluate_folds(rows(spark, sf), ("pls",), subsets=models.ablation_subsets(NAMES))
    return metrics.stage_summary(_errors(facts).filter("stage = 'full_map'"), ["mae", "rmse"], ["ablation"])


@query("feature_ablation_steps")
def feature_ablation_steps(spark, sf):
    """Cumulative feature groups: how many lots each one betters."""
    facts = models.evaluate_folds(rows(spark, sf), ("pls",), subsets=models.ablation_subsets(NAMES, families=False))
    return models.ablation_steps(_errors(facts).filter("stage = 'full_map'"))


@query("feature_stability")
def feature_stability(spark, sf):
    f, maps = _rows(spark, sf)
    return metrics.stability_rollup(models.stability(models.evaluate_folds(models.modelling_rows(f, maps), ("pls",)), NAMES))


@query("conformal_vm")
def conformal_vm(spark, sf):
    p = models.points(models.evaluate_folds(rows(spark, sf), ("pls",))).filter("stage = 'full_map'").withColumns({"x": F.col("place").cast("double"), "y": F.lit(0.0)})
    folds = resample.fit_calibrate_test(p, least_fit=0)
    cal = folds.filter("role = 'calibration'").withColumn("score", F.abs(metrics.error()))
    pb = conformal.bounds(cal, ["test_lot", "x", "y"], "score", (0.8, 0.9))
    mb = conformal.bounds(conformal.wafer_scores(cal, ["test_lot", "experiment_key"]), ["test_lot"], "score", (0.8, 0.9))
    return conformal.gate(conformal.coverage(folds.filter("role = 'test'"), pb, mb))


@query("model_disagreement")
def model_disagreement(spark, sf):
    p = models.points(models.evaluate_folds(rows(spark, sf), ("ridge", "pls"))).withColumns({"x": F.col("place"), "y": F.lit(0)})
    return risk.model_disagreement(p)


@query("causal_feedback_refit")
def causal_feedback_refit(spark, sf):
    r = models.causal_feedback(rows(spark, sf), selected(spark, sf).select("experiment_key", "budget", "measured"))
    return risk.stream_metrics(r, F.col("drift_error_threshold"), ["test_lot", "feedback", "budget"])


@query("feedback_policies")
def feedback_policies(spark, sf):
    """Policies crossed with feedback: lot-macro errors and what F1 to F3 gain on none, 3 random replicates."""
    r = rows(spark, sf)
    s = models.feedback_streams(r, analyses.causal_wafers(r), ("combined", "oracle"), (0.1, 0.3), 3)
    return models.feedback_gain(s).select("policy", "budget", "feedback", r6("lot_macro_system_mae"), r6("relative_gain"))


@query("validated_weights")
def validated_weights(spark, sf):
    """The weights that inner lots select, what they gain on equal ones, and whether the rule adopts them."""
    w = analyses.drift_risk(rows(spark, sf), replicates=100)["weights"]
    return w.select("held_out_lot", "weights", r6("inner_equal_macro_aurc"), r6("inner_selected_macro_aurc"), r6("inner_relative_gain"), r6("inner_improved_lot_fraction"), "adoption_rule_passed", "grid_candidates")


def _spectra(spark, sf):
    return tables.spectra(spark, sf).groupBy("experiment_key").agg(F.max("intensity").alias("_m")).select("experiment_key", F.col("_m").alias("spectrum"))


@query("oes_fused")
def oes_fused(spark, sf):
    e = _errors(models.fused_spectra(rows(spark, sf), _spectra(spark, sf)))
    return metrics.stage_summary(e, ["mae"], ["stage"])


@query("oes_early_fusion")
def oes_early_fusion(spark, sf):
    """Process features alone and with spectral ones, for the wafers that have both."""
    f, maps = _rows(spark, sf)
    s = features.mean_spectrum(tables.spectra(spark, sf)).select("experiment_key", F.concat(F.lit("wl_"), F.col("channel").cast("string"), F.lit("__active_mean")).alias("feature"), F.col("mean").alias("value"))
    f = f.join(s.select("experiment_key").distinct(), "experiment_key", "left_semi")
    keep = s.join(f.select("experiment_key").distinct(), "experiment_key", "left_semi")
    both = models.modelling_rows(f, maps).withColumn("ablation", F.lit("process")).unionByName(models.modelling_rows(features.fuse(f, keep, "oes__"), maps).withColumn("ablation", F.lit("process_oes")))
    return metrics.stage_summary(_errors(models.evaluate_folds(both, ("pls",))).filter("stage = 'full_map'"), ["mae"], ["ablation"])


@query("drift_risk")
def drift_risk(spark, sf):
    """Mean areas under the risk curves, by policy."""
    lots = analyses.drift_risk(rows(spark, sf))["lots"]
    return lots.groupBy("policy").agg(F.count("*").alias("lots"), r6(F.avg("aurc"), "macro_aurc"))


@query("causal_policies")
def causal_policies(spark, sf):
    """Policies replayed by models and scores of earlier lots: errors by policy and budget, 100 random replicates."""
    p = analyses.causal_policies(rows(spark, sf))["policies"]
    return p.select("mode", "policy", "budget", r6("lot_macro_system_mae"), r6("mean_measured_fraction"), r6("worst_lot_mae"))


def _placed(spark, sf, facts):
    """Points with the coordinates of their places, which are in the order of (y, x)."""
    xy = tables.dense(spark, sf).select("x", "y").distinct()
    place = F.row_number().over(Window.orderBy("y", "x")) - 1
    return models.points(facts).join(F.broadcast(xy.withColumn("place", place)), "place"), xy


@query("spatial_gate")
def spatial_gate(spark, sf):
    p, xy = _placed(spark, sf, models.evaluate_folds(rows(spark, sf), ("pls",)))
    return analyses.spatial_decomposition(p, template.coordinate_zones(xy))["gate"]


@query("model_benchmark")
def model_benchmark(spark, sf):
    facts = models.evaluate_folds(rows(spark, sf), ("pls", "gpr"))
    e = metrics.wafer_errors(models.points(facts), ["family", "stage", "experiment_key", "lot_number"])
    return analyses.model_benchmark(e, models.points(facts))["summary"]
