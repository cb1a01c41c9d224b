"""Whole analyses composed of the operators (V14, A9, A25, R18, R19, M18, C4, U3): lazily built frames by name."""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.stats import safe_divide, spearman, unpivot
from lotwise.kernels import evaluate
from lotwise.kernels import policies as kernel
from lotwise.operators import conformal, metrics, replay, resample, risk, template, validate
from lotwise.plans import models
from lotwise.sources.shared import spread, written

SCORES = ("initial_state", "wafer_delta", "ewma_distance", "ood_distance", "model_disagreement")


def data_audit(dense: DataFrame, sparse: DataFrame, traces: DataFrame, signals: Sequence[str], spectra: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows, wafers and coordinates of either tool, formulas, trace steps, the template's reach, how the tools agree, and whether there are spectra."""
    paired = template.paired_tools(sparse, dense)
    spark = dense.sparkSession
    some = spectra.agg(F.countDistinct("experiment_key").alias("spectral_wafers")) if spectra is not None else spark.range(1).select(F.lit(0).cast("long").alias("spectral_wafers"))
    return {
        "spectra": some.withColumn("spectra_present", F.col("spectral_wafers") > 0),
        "measurements": validate.measurement_audit(dense, sparse), "formulas": validate.formula_audit(dense, sparse), "traces": validate.process_audit(traces, signals), "dates": validate.wafers_by_date(traces),
        "template": template.audit_r2(template.with_targets(dense)), "tools": template.tool_bias(paired), "calibration": template.median_calibration(paired),
    }


def model_benchmark(wafers: DataFrame, points: DataFrame, base: str = "pls", other: str = "gpr", replicates: int = 10_000, seed: int = 20260721) -> dict[str, DataFrame]:
    """Families side by side: macro errors, lots won, and the relative change of one family's error with its wafer-weighted interval."""
    full = wafers.filter("stage = 'full_map'")
    summary = metrics.stage_summary(full, ["mae", "rmse"], ["family"]).join(metrics.best_lot_counts(full), "family").join(full.groupBy("family").agg(F.median("mae").alias("median_wafer_mae")), "family")
    lots = full.filter(F.col("family").isin(base, other)).groupBy("lot_number").pivot("family", [base, other]).agg(F.sum("mae"))
    change = resample.cluster_bootstrap(lots, seed, replicates, other, base).withColumn("statistic", F.col("statistic") - 1)
    observed = lots.agg((F.sum(other) / F.sum(base) - 1).alias("observed_relative_change"))
    out = {"summary": summary, "lots": full.groupBy("family", "lot_number").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")), "change": resample.bootstrap_interval(change).crossJoin(observed)}
    gp = points.filter((F.col("family") == other) & (F.col("stage") == "full_map") & F.col("predicted_std").isNotNull())
    w = gp.groupBy("experiment_key").agg(F.avg(F.abs(metrics.error())).alias("mae"), F.avg("predicted_std").alias("std"))
    return out | {"coverage": metrics.interval_coverage(gp), "capture": metrics.top_capture(w, "mae", "std"), "rank": spearman(w, "mae", "std", [])}


def spatial_decomposition(points: DataFrame, zones: DataFrame, family: str = "pls", replicates: int = 10_000, seed: int = 20260726) -> dict[str, DataFrame]:
    """Five stages, template to rebuilt residual: wafer and coordinate metrics, summaries, and the gate of the residual stage.

    points: (family, stage, experiment_key, lot_number, x, y, observed, predicted); zones: (x, y, zone).
    """
    p = points.filter(F.col("family") == family).join(F.broadcast(zones), ["x", "y"])
    wafers = metrics.spatial_metrics(p, ["stage", "experiment_key", "lot_number"])
    summary = metrics.stage_summary(wafers, ["mae", "rmse", "residual_profile_mae"], ["stage"])
    lots = wafers.groupBy("lot_number").pivot("stage", ["mean_shift", "full_map"]).agg(F.avg("mae"))
    gain = resample.cluster_bootstrap(lots, seed, replicates, "full_map", "mean_shift").withColumn("statistic", 1 - F.col("statistic"))
    observed = lots.agg((1 - safe_divide(F.avg("full_map"), F.avg("mean_shift"))).alias("gain"), F.count_if(F.col("full_map") < F.col("mean_shift")).alias("lots_improved"), F.count("*").alias("lots"))
    gate = resample.bootstrap_interval(gain).crossJoin(observed).withColumn("gate", metrics.gain_gate(F.col("gain"), F.col("p025"), F.col("lots_improved")))
    return {"wafers": wafers, "coordinates": metrics.coordinate_mae(p, ["stage"]), "summary": summary, "gate": gate}


RISK = "fold string, held_out_lot int, test_lot int, experiment_key string, lot_number int, is_train boolean, x array<double>, initial_state double, wafer_delta double, ewma_distance double, model_disagreement double, error double"
#: Of a fold: the lot held out, the lot tested, one of the lots that it concerns, and what to apply to that one's wafers.
APPLIED = "held_out_lot int, test_lot int, at_lot int, models binary"


def _changes(c: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance from the origin, from the row before, from the exponential mean before the row) of rows in order; NaN for the first."""
    before, run = np.full(len(c), np.nan), np.full(len(c), np.nan)
    before[1:] = np.linalg.norm(np.diff(c, axis=0), axis=1)
    mean = c[0] if len(c) else None
    for i in range(1, len(c)):
        run[i] = np.linalg.norm(c[i] - mean)
        mean = alpha * c[i] + (1 - alpha) * mean
    return np.linalg.norm(c, axis=1), before, run


def risk_inputs(rows: DataFrame, components: int = 10, parameters=models.PARAMETERS, forward: bool = False, least_lots: int = 3, alpha: float = 0.3, inner: bool = False) -> DataFrame:
    """Each wafer of each fold: its place on the fold's principal components, how it changes within its lot, how far the families' maps are apart, and the error of partial least squares.

    A fold tests one lot and is fitted on others: leave-one-lot-out, or with ``forward`` the earlier ones, of which
    there must be ``least_lots``. With ``inner`` each training lot is tested too, by what is fitted on the others with
    the parameters of its outer fold. Training wafers are predicted by the models that were fitted on them; they serve
    as the reference of percentiles only. Fits need the lots' moments: transforms and models go to the lots, and a
    group holds the wafers of one, by the fits of one outer fold. Components are about the training mean, which is the origin.
    """
    params = {f: tuple(parameters[f]) for f in ("pls", "ridge")}
    rows = written(rows.withColumn("ablation", F.lit("all")), "risk-rows")
    moments = written(models.lot_moments(rows), "moments")
    each = rows.crossJoin(F.broadcast(moments.select(F.col("lot_number").alias("held_out_lot")).distinct()))
    best = models._chosen(models.Parts(rows, moments), models.fold_rows(moments, list(params), forward, least_lots), params, evaluate.SHARE, evaluate.MOST)

    def fit(key: tuple, g: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        w, held, out = models._moments(g), int(key[1]), []
        picked = {c.family: (params[c.family][int(c.place)], params[c.family][int(c.residual_place)]) for c in chosen.itertuples()}
        others = [n for n in w.names if n != held]
        for tested in [held, *(others if inner else ())] if len(picked) == 2 else ():
            names = tuple(n for n in others if n != tested)
            if sum(w.own[n].count for n in names) < 2:
                continue
            t = w.training(names)
            maps = {f: evaluate.portable(w, names, f, [s], [r]) for f, (s, r) in picked.items()}
            blob = pickle.dumps((maps, t.kept, t.feature_mean[t.kept], t.axes(components) / t.deviation))
            out += [(held, tested, n, blob) for n in (*names, tested)]
        return pd.DataFrame(out, columns=models._names(APPLIED))

    def apply(wafers: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(wafers) and len(fitted):
            g, x, maps, lots = models._sorted(wafers)
            for f in fitted.itertuples():
                by, kept, mean, axes = pickle.loads(f.models)
                c = (x[:, kept] - mean) @ axes.T
                full = {name: m.stages(x, maps)["full_map"] for name, m in by.items()}
                apart, error = np.sqrt(((full["pls"] - full["ridge"]) ** 2).mean(axis=1)), np.abs(full["pls"] - maps).mean(axis=1)
                fold = str(f.held_out_lot) if f.test_lot == f.held_out_lot else f"{f.held_out_lot}/{f.test_lot}"
                initial, delta, run = _changes(c, alpha)
                out.append(pd.DataFrame({"fold": fold, "held_out_lot": f.held_out_lot, "test_lot": f.test_lot, "experiment_key": g["experiment_key"], "lot_number": lots, "is_train": lots != f.test_lot, "x": list(c), "initial_state": initial, "wafer_delta": delta, "ewma_distance": run, "model_disagreement": apart, "error": error}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame([], columns=models._names(RISK))

    by = ["ablation", "held_out_lot"]
    fitted = models.fold_rows(moments, ["all"], forward, least_lots).groupBy(*by).cogroup(best.groupBy(*by)).applyInPandas(fit, APPLIED)
    own = spread(fitted, "at_lot", "held_out_lot").groupBy("at_lot", "held_out_lot")
    out = spread(each, "lot_number", "held_out_lot").groupBy("lot_number", "held_out_lot").cogroup(own).applyInPandas(apply, RISK)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("wafer_delta", "ewma_distance")})


def risk_scores(inputs: DataFrame, redundancy: float = 0.90) -> DataFrame:
    """Test wafers of each fold with their five scores, the percentile of each among the training wafers of the fold, and combined_risk.

    initial_state is left out of the mean where its rank correlation with the distance to the nearest training wafer is
    at least ``redundancy``, of either sign, in training. ``inputs`` is met several times, and what is found for it is written.
    """
    s = written(risk.with_nearest(inputs, fold="fold").drop("compared"), "risk-near")
    drop = spearman(s.filter("is_train"), "ood_distance", "initial_state", ["fold"]).select("fold", (F.abs(F.coalesce("spearman", F.lit(0.0))) >= redundancy).alias("initial_is_redundant"))
    long = unpivot(s, ["fold", "experiment_key", "is_train"], SCORES, "score")
    p = risk.empirical_percentile(long.filter("not is_train"), long.filter("is_train"), "value", ["fold", "score"])
    wide = p.groupBy("fold", "experiment_key").agg(*[F.first(F.when(F.col("score") == n, F.col("percentile")), ignorenulls=True).alias(f"{n}_percentile") for n in SCORES])
    test = s.filter("not is_train").select("fold", "held_out_lot", "lot_number", "experiment_key", *SCORES, "error")
    j = test.join(wide, ["fold", "experiment_key"]).join(drop, "fold", "left").withColumn("initial_is_redundant", F.coalesce("initial_is_redundant", F.lit(False)))
    kept = [F.when((F.lit(n) != "initial_state") | ~F.col("initial_is_redundant"), F.col(f"{n}_percentile")) for n in SCORES]
    some = F.filter(F.array(*kept), lambda x: x.isNotNull())
    return j.withColumn("combined_risk", F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


#: What weights have to gain on equal ones, in the share of inner lots that they don't worsen, to be adopted.
LEAST_GAIN, LEAST_SHARE, WEIGHT_PARTS = 0.02, 0.70, 4
WEIGHTS = "held_out_lot int, weights array<double>, inner_equal_macro_aurc double, inner_selected_macro_aurc double, inner_relative_gain double, inner_improved_lot_fraction double, adoption_rule_passed boolean, grid_candidates int"


def validated_weights(scores: DataFrame, parts: int = WEIGHT_PARTS) -> DataFrame:
    """(held_out_lot, weights, diagnostics): of the grid of weights of ``parts`` parts those of the least mean area over the inner lots, ties to the first; adopted if they gain enough on equal weights in enough lots.

    ``scores`` are those of inner folds. Weights are in the order of ``SCORES``; where initial_state is redundant in the
    outer fold it has none. Areas are found lot by lot, so a group holds one lot's percentiles, and averaged natively.
    """

    def grid(redundant: bool) -> list[list[float]]:
        free = [i for i, n in enumerate(SCORES) if not (redundant and n == "initial_state")]
        cuts = ([b - a - 1 for a, b in zip((-1, *c), (*c, parts + len(free) - 1))] for c in combinations(range(parts + len(free) - 1), len(free) - 1))
        out = [[1 / len(free) if i in free else 0.0 for i in range(len(SCORES))]]  # equal weights come first, numbered -1
        for c in sorted(cuts):
            w = [0.0] * len(SCORES)
            for i, x in zip(free, c):
                w[i] = x / parts
            out.append(w)
        return out

    def areas_of(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("experiment_key")
        p, e = np.nan_to_num(np.stack(g["p"].to_numpy()).astype(float), nan=0.5), g["error"].to_numpy(float)
        w = np.array(grid(bool(g["redundant"].iloc[0])))
        order = np.argsort(-np.round(w @ p.T, 12), axis=1, kind="stable")
        return pd.DataFrame({"held_out_lot": int(key[0]), "test_lot": int(key[1]), "place": np.arange(-1, len(w) - 1), "weights": list(w), "aurc": kernel.areas(e[order])})

    p = scores.select("held_out_lot", F.col("lot_number").alias("test_lot"), "experiment_key", "error", F.col("outer_redundant").alias("redundant"), F.array(*[F.col(f"{n}_percentile") for n in SCORES]).alias("p"))
    a = p.groupBy("held_out_lot", "test_lot").applyInPandas(areas_of, "held_out_lot int, test_lot int, place int, weights array<double>, aurc double")
    equal = a.filter("place = -1").select("held_out_lot", "test_lot", F.col("aurc").alias("equal"))
    m = a.join(equal, ["held_out_lot", "test_lot"]).groupBy("held_out_lot", "place").agg(F.first("weights").alias("weights"), F.avg("aurc").alias("aurc"), F.avg("equal").alias("equal"), F.avg((F.col("aurc") <= F.col("equal")).cast("double")).alias("improved"))
    best = m.filter("place >= 0").groupBy("held_out_lot").agg(F.min_by(F.struct("weights", "aurc", "equal", "improved"), F.struct("aurc", "place")).alias("b"), F.count("*").cast("int").alias("grid_candidates"))
    gain = 1 - safe_divide(F.col("b.aurc"), F.col("b.equal"))
    adopted = F.coalesce((gain >= LEAST_GAIN) & (F.col("b.improved") >= LEAST_SHARE), F.lit(False))
    return best.select("held_out_lot", "b.weights", F.col("b.equal").alias("inner_equal_macro_aurc"), F.col("b.aurc").alias("inner_selected_macro_aurc"), gain.alias("inner_relative_gain"), F.col("b.improved").alias("inner_improved_lot_fraction"), adopted.alias("adoption_rule_passed"), "grid_candidates")


def weighted_risk(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds training_weighted_risk: the percentiles under the weights that inner lots select, adopted or not."""
    j = scores.join(weights.select("held_out_lot", "weights"), "held_out_lot", "left")
    total = F.lit(0.0)
    for i, n in enumerate(SCORES):
        total = total + F.col("weights")[i] * F.coalesce(f"{n}_percentile", F.lit(0.5))
    return j.withColumn("training_weighted_risk", total).drop("weights")


def policy_scores(scores: DataFrame) -> DataFrame:
    """A row for each wafer and policy: the five percentiles, combined, training_weighted_candidate if scores have it, oracle."""
    named = [F.struct(F.lit(n).alias("policy"), F.col(f"{n}_percentile").alias("score")) for n in SCORES]
    named += [F.struct(F.lit("combined").alias("policy"), F.col("combined_risk").alias("score")), F.struct(F.lit("oracle").alias("policy"), F.col("error").alias("score"))]
    if "training_weighted_risk" in scores.columns:
        named.append(F.struct(F.lit("training_weighted_candidate").alias("policy"), F.col("training_weighted_risk").alias("score")))
    w = metrics.wafer_ordinal(scores.select("experiment_key", "lot_number", "error", F.array(*named).alias("p")))
    return w.select("experiment_key", "lot_number", "wafer_order", "error", F.explode("p").alias("p")).select("experiment_key", "lot_number", "wafer_order", "error", "p.policy", "p.score")


def drift_risk(rows: DataFrame, budgets: Sequence[float] = (0.1, 0.2, 0.3), alpha: float = 0.3, components: int = 10, replicates: int = 10_000, seed: int = 20260721) -> dict[str, DataFrame]:
    """Which wafers to measure: scores, curves and areas by policy, what single lots do to them, and intervals against random.

    'periodic' is even spacing; 'random' is the mean over ``replicates`` orders of a lot, whose percentiles ``lots`` has as well.
    'training_weighted_candidate' weighs the percentiles as the inner folds of the training lots would; ``weights`` tells
    whether the rule would adopt that. What is met several times is written: the inputs, and the scores.
    """
    every = written(risk_scores(written(risk_inputs(rows, components, alpha=alpha, inner=True), "risk-inputs")), "risk-scores")
    outer = every.filter(~F.col("fold").contains("/")).drop("fold")
    redundant = outer.select("held_out_lot", F.col("initial_is_redundant").alias("outer_redundant")).distinct()
    weights = validated_weights(every.filter(F.col("fold").contains("/")).join(redundant, "held_out_lot"))
    scores = written(weighted_risk(outer, weights), "scores")
    p = policy_scores(scores)
    by = ["lot_number", "policy"]
    one = p.filter("policy = 'oracle'")
    lots = risk.aurc(p, by=by).unionByName(risk.periodic_aurc(one, by=["lot_number"]).withColumn("policy", F.lit("periodic")))
    drawn = risk.random_policy(one, replicates, seed, budgets).withColumn("policy", F.lit("random"))
    lots = lots.unionByName(drawn.drop("budgets"), allowMissingColumns=True)
    curves = risk.policy_curve(p, budgets, by=by).unionByName(risk.periodic_curve(one, budgets, by=["lot_number"]).withColumn("policy", F.lit("periodic")))
    curves = curves.unionByName(drawn.select("lot_number", "policy", F.explode("budgets").alias("b")).select("lot_number", "policy", "b.*"))
    base = lots.filter("policy = 'random'").select("lot_number", F.col("aurc").alias("_random"))
    apart = lots.filter("policy <> 'random'").join(base, "lot_number").select("policy", "lot_number", (F.col("aurc") - F.col("_random")).alias("d"))
    samples = resample.cluster_bootstrap(apart, seed, replicates, "d", by=["policy"])
    long = unpivot(scores, ["held_out_lot", "experiment_key"], SCORES, "score")
    return {"scores": scores, "weights": weights, "curves": curves, "lots": lots, "influence": risk.policy_influence(lots), "bootstrap": resample.bootstrap_interval(samples, ["policy"]), "correlations": risk.score_correlations(long, ["held_out_lot"])}


CAUSAL = ("ood", "disagreement", "combined", "validated_combined", "oracle")


def causal_wafers(rows: DataFrame, alpha: float = 0.3, least_lots: int = 3) -> DataFrame:
    """(experiment_key, lot_number, wafer_order, true_error, drift_error_threshold, the scores of ``CAUSAL``) of the lots that follow ``least_lots`` others, by what earlier lots tell.

    A lot's drift threshold is the 95 % quantile of its training wafers' errors.
    """
    inputs = written(risk_inputs(rows, forward=True, least_lots=least_lots, alpha=alpha), "causal-inputs")
    limit = inputs.filter("is_train").groupBy("held_out_lot").agg(F.percentile("error", F.lit(0.95)).alias("drift_error_threshold"))
    w = risk_scores(inputs).join(limit, "held_out_lot").select(
        "experiment_key", "lot_number", F.col("error").alias("true_error"), "drift_error_threshold", F.col("ood_distance_percentile").alias("ood"), F.col("model_disagreement_percentile").alias("disagreement"),
        F.col("combined_risk").alias("combined"), F.col("combined_risk").alias("validated_combined"), F.cume_dist().over(Window.partitionBy("lot_number").orderBy("error")).alias("oracle"))
    return metrics.wafer_ordinal(w)


def causal_policies(rows: DataFrame, budgets: Sequence[float] = replay.BUDGETS, replicates: int = 100, bootstraps: int = 10_000, alpha: float = 0.3, least_lots: int = 3, seed: int = 20260721, without_lot: int = 8) -> dict[str, DataFrame]:
    """Policies replayed over each lot by models and scores of earlier lots only: streams by lot, by policy, combined against random, and the gate.

    'validated_combined' is the combined score, as weights chosen in training are not adopted. Scores and lots are written
    before they are used again.
    """
    w = written(causal_wafers(rows, alpha, least_lots), "causal-scores")
    lots = written(replay.lot_summary(replay.streams(w, CAUSAL, budgets, replicates, seed)), "causal-lots")
    difference = replay.policy_difference(lots, replicates=bootstraps, seed=seed)
    return {"scores": w, "lots": lots, "policies": replay.policy_summary(lots), "difference": difference, "gate": replay.gate(lots, difference, without_lot)}


def conformal_bounds(points: DataFrame, nominals: Sequence[float] = (0.8, 0.9, 0.95), least_fit: int = 2) -> dict[str, DataFrame]:
    """Bounds calibrated on the lot before each test lot, coverage and gate. points: (experiment_key, lot_number, x, y, observed, predicted) predicted from earlier lots."""
    folds = resample.fit_calibrate_test(points, least_fit)
    cal = folds.filter("role = 'calibration'").withColumn("score", F.abs(metrics.error()))
    pb = conformal.bounds(cal, ["test_lot", "x", "y"], "score", nominals)
    mb = conformal.bounds(conformal.wafer_scores(cal, ["test_lot", "experiment_key"]), ["test_lot"], "score", nominals)
    lots = conformal.coverage(folds.filter("role = 'test'"), pb, mb)
    return {"point_bounds": pb, "map_bounds": mb, "lots": lots, "gate": conformal.gate(lots)}
