"""The analysis in steps: features, decomposition, models, risk, conformal bounds, replay (K7), and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators import conformal, features, metrics, risk, segment, template, validate
from lotwise.plans import analyses, models
from lotwise.plans.manifest import Step
from lotwise.sources import tables


def _features(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    regions = segment.detect_regions(ctx["traces"], ctx["config"].get("detector", "complementary"))
    return {"features": features.trace_features(regions, list(tables.SIGNALS)).filter("value is not null"), "diagnostics": features.trace_diagnostics(regions)}


def _cycles(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    s = segment.with_suspicion(segment.cycle_diagnostics(ctx["traces"], ctx["config"].get("detector", "complementary")))
    return {"cycle_diagnostics": s, "cycle_lots": segment.lot_cycle_summary(s)}


def _template(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    d = template.with_filled_flag(template.decompose(template.with_targets(ctx["dense"])))
    w = template.wafer_summaries(d)
    return {"template_wafers": w, "template_lots": template.lot_summaries(w), "template_summary": template.decomposition_summary(d)}


def _baseline(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    maps = validate.ordered_maps(ctx["dense"], ctx["features"], "stepheight")
    facts = models.evaluate_folds(models.modelling_rows(ctx["features"], maps), ctx["config"].get("families", ("ridge", "pls")))
    return {"facts": facts}


def _metrics(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    e = metrics.wafer_errors(models.points(ctx["facts"]), ["family", "stage", "experiment_key", "lot_number"])
    return {"wafer_errors": e, "stage_summary": metrics.stage_summary(e, ["mae", "rmse"]), "folds": models.folds(ctx["facts"])}


def _risk(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    e = metrics.wafer_ordinal(ctx["wafer_errors"].filter("family = 'pls' and stage = 'full_map'").select("experiment_key", "lot_number", F.col("mae").alias("error")))
    p = models.points(ctx["facts"]).withColumns({"x": F.col("place"), "y": F.lit(0)})
    w = e.join(risk.model_disagreement(p).withColumnRenamed("model_disagreement", "score"), ["lot_number", "experiment_key"])
    return {"risk_wafers": w, "risk_curves": risk.policy_curve(w, (0.1, 0.2, 0.3)), "risk_lots": risk.aurc(w)}


def _replay(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    maps = validate.ordered_maps(ctx["dense"], ctx["features"], "stepheight")
    picks = risk.causal_selection(ctx["risk_wafers"], (0.2, 0.5), spark.createDataFrame([(0.2, 0.0), (0.5, 0.0)], "budget double, threshold double").crossJoin(ctx["risk_wafers"].select("lot_number").distinct()))
    return {"replay": models.causal_feedback(models.modelling_rows(ctx["features"], maps), picks.select("experiment_key", "budget", "measured"), ctx["config"].get("feedbacks", ("F0", "F1")))}


def _rows(ctx: dict) -> DataFrame:
    return models.modelling_rows(ctx["features"], validate.ordered_maps(ctx["dense"], ctx["features"], "stepheight"))


def _placed(ctx: dict, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points with coordinates, the coordinates): places of a map are in the order of (y, x)."""
    xy = ctx["dense"].select("x", "y").distinct()
    place = F.row_number().over(Window.orderBy("y", "x")) - 1  # a row a coordinate
    return models.points(facts).join(xy.withColumn("place", place), "place"), xy


def _named(prefix: str, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {f"{prefix}_{k}": v for k, v in frames.items()}


def _ablation(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    facts = models.evaluate_folds(_rows(ctx), ("pls",), subsets=models.ablation_subsets(_feature_names(ctx)))
    p = models.points(facts)
    e = metrics.wafer_errors(p, ["ablation", "stage", "experiment_key", "lot_number"])
    profiles = metrics.residual_profiles(p.filter("stage = 'full_map'"), ["ablation"])
    return {"ablation_wafers": e, "ablation_profiles": profiles, "ablation_steps": models.ablation_steps(e.filter("stage = 'full_map'"))}


def _feature_names(ctx: dict) -> list[str]:
    return sorted(r[0] for r in ctx["features"].select("feature").distinct().collect())  # a row a column of the wide table


def _audit(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    return _named("audit", analyses.data_audit(ctx["dense"], ctx["sparse"], ctx["traces"], list(tables.SIGNALS), ctx.get("spectra")))


def _detectors(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    every = [segment.cycle_diagnostics(ctx["traces"], d).withColumn("detector", F.lit(d)) for d in segment.DETECTORS]
    c = segment.detector_summary(reduce(DataFrame.unionByName, every))
    return {"detectors": c, "selected_detector": segment.selected_detector(c)}


def _stability(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    s = models.stability(ctx["facts"], _feature_names(ctx))
    return {"stability": s, "stability_rollup": metrics.stability_rollup(s.filter("family = 'pls'"))}


def _failure(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    """Of the lot with the largest mean error."""
    e = ctx["wafer_errors"].filter("family = 'pls' and stage = 'full_map'").groupBy("lot_number").agg(F.avg("mae").alias("e"))
    lot = e.orderBy(F.desc("e"), "lot_number").first()["lot_number"]
    keys = ctx["wafer_errors"].filter(F.col("lot_number") == lot).select("experiment_key").distinct()
    return {"failure_wafers": metrics.lot_failure(models.points(ctx["facts"]), lot, "pls"), "failure_features": metrics.out_of_lot_z(ctx["features"], keys)}


def _spectra(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    """The pilot's lots are those that have spectra, or the configured ones."""
    spectra = ctx["spectra"].groupBy("experiment_key").agg(F.max("intensity").alias("spectrum"))
    rows = _rows(ctx)
    if ctx["config"].get("lots"):
        rows = models.selected_lots(rows, ctx["config"]["lots"])
    facts = models.fused_spectra(rows, spectra)
    e = metrics.wafer_errors(models.points(facts), ["stage", "experiment_key", "lot_number"])
    flags = validate.with_target_flag(spectra.select("experiment_key"), ctx["dense"])
    return {"spectral_facts": facts, "spectral_summary": metrics.stage_summary(e, ["mae", "rmse"], ["stage"]), "spectral_targets": flags}


def _feedback(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    rows = _rows(ctx)
    s = models.feedback_streams(rows, analyses.causal_wafers(rows), ("ood", "disagreement", "combined", "oracle"), ctx["config"].get("budgets", (0.1, 0.2, 0.3)), ctx["config"].get("replicates", 5))
    return {"feedback_streams": s, "feedback_gain": models.feedback_gain(s)}


def _chronological(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    facts = models.evaluate_folds(_rows(ctx), ctx["config"].get("families", ("pls",)), forward=True)
    e = metrics.wafer_errors(models.points(facts), ["family", "stage", "experiment_key", "lot_number"]).filter("stage = 'full_map'")
    return {"forward_facts": facts, "comparison": models.compare(e, ctx["wafer_errors"].filter("stage = 'full_map'"))}


def _spatial(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    p, xy = _placed(ctx, ctx["facts"])
    return _named("spatial", analyses.spatial_decomposition(p, template.coordinate_zones(xy)))


def _drift(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    return _named("drift", analyses.drift_risk(_rows(ctx)))


def _uncertainty(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    p, _ = _placed(ctx, ctx["forward_facts"])
    out = analyses.conformal_bounds(p.filter("stage = 'full_map'"), least_fit=0)
    base = p.filter("stage = 'template'").groupBy(F.col("lot_number").alias("test_lot")).agg(F.avg(F.abs(metrics.error())).alias("baseline_mae"))
    some = out["point_bounds"].select("nominal_coverage", "attainable").unionByName(out["map_bounds"].select("nominal_coverage", "attainable"))
    return _named("uncertainty", out | {"checks": conformal.uncertainty_gate(out["lots"], some, base)})


def _policies(spark: SparkSession, ctx: dict) -> dict[str, DataFrame]:
    return _named("policies", analyses.causal_policies(_rows(ctx)))


STEPS = (
    Step("data_audit", _audit, {}, claim_boundary="what the tables hold, not what they should"),
    Step("detector_selection", _detectors, {}, claim_boundary="detectors are chosen by cycle counts, not by errors"),
    Step("features", _features, {"detector": "complementary"}),
    Step("cycle_validation", _cycles, {"detector": "complementary"}),
    Step("target_template", _template, {}, claim_boundary="templates see no row of the lot they predict"),
    Step("process_baseline", _baseline, {"families": ("ridge", "pls")}, claim_boundary="parameters are chosen within training lots", needs=("features",)),
    Step("metrics", _metrics, {}, needs=("process_baseline",)),
    Step("risk_audit", _risk, {}, gate="QUALIFIED", needs=("process_baseline", "metrics")),
    Step("causal_replay", _replay, {"feedbacks": ("F0", "F1")}, gate="QUALIFIED", claim_boundary="decisions see earlier lots and wafers only", needs=("features", "risk_audit")),
    Step("feature_ablation", _ablation, {}, claim_boundary="each feature set is evaluated as the whole", needs=("features",)),
    Step("chronological_vm", _chronological, {"families": ("pls",)}, claim_boundary="models see earlier lots only", needs=("features", "metrics")),
    Step("spatial_decomposition", _spatial, {}, gate="QUALIFIED", needs=("process_baseline",)),
    Step("drift_risk", _drift, {}, gate="QUALIFIED", claim_boundary="percentiles are against training wafers", needs=("features",)),
    Step("uncertainty_calibration", _uncertainty, {}, gate="QUALIFIED", claim_boundary="bounds are calibrated on the lot before", needs=("chronological_vm",)),
    Step("feature_stability", _stability, {}, needs=("features", "process_baseline")),
    Step("lot_failure", _failure, {}, needs=("features", "process_baseline", "metrics")),
    Step("spectral_pilot", _spectra, {}, gate="QUALIFIED", claim_boundary="wafers that have spectra only", needs=("features",)),
    Step("feedback_policies", _feedback, {"budgets": (0.1, 0.3), "replicates": 2}, gate="QUALIFIED", claim_boundary="scores are of earlier lots, feedback changes models only", needs=("features",)),
    Step("selective_metrology", _policies, {}, gate="QUALIFIED", claim_boundary="decisions see earlier lots and wafers only", needs=("features",)),
)


def retain_gate(reduction: float, lots_improved: int, least_reduction: float = 0.05, least_lots: int = 3) -> bool:
    return reduction >= least_reduction and lots_improved >= least_lots


def risk_gate(reduction: float, lots_improved: int) -> str:
    return "PASS" if reduction >= 0.10 and lots_improved >= 7 else "FAIL"


def policy_gate(better_budgets: int, negative_intervals: int, largest_win_share: float, better_without_lot: int, worst_change: float) -> tuple[str, dict[str, bool]]:
    """PASS if all five checks hold."""
    checks = {
        "two_budgets_better": better_budgets >= 2, "two_intervals_negative": negative_intervals >= 2, "lot_win_fraction": largest_win_share >= 0.70,
        "two_budgets_better_without_lot": better_without_lot >= 2, "worst_lot_change": worst_change <= 0.10,
    }
    return ("PASS" if all(checks.values()) else "FAIL"), checks
