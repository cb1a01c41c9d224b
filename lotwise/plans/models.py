"""Nested evaluations as grouped jobs (L6-L18, C2-C9): fold, family and ablation are keys, numpy runs in Arrow groups.

Linear families are fitted on the moments of lots, which folds merge, and go to the wafers they are scored on; facts
come back as rows and are unfolded natively.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.kernels import evaluate, gaussian, linear
from lotwise.kernels import policies as kernel
from lotwise.operators.features import FEATURE_GROUPS, family_of, feature_group, feature_vectors, group_of, sensor_family
from lotwise.plans.tiles import process_folds
from lotwise.sources.shared import spread, written

#: Default candidates of each family.
PARAMETERS: dict[str, tuple] = {"ridge": (0.1, 1.0, 10.0, 100.0, 1000.0), "pls": (1, 2, 4), "gpr": (gaussian.Settings(4, 1.0, 0.1), gaussian.Settings(4, 3.0, 0.1), gaussian.Settings(8, 3.0, 0.3))}
#: Those of the forward evaluation: its process has one, whose kernel is fitted.
CHRONOLOGICAL: dict[str, tuple] = {"ridge": PARAMETERS["ridge"], "pls": PARAMETERS["pls"], "gpr": (gaussian.Settings(8, 3.0, 0.05, True),)}
SPECTRAL_CANDIDATES = tuple((k, a) for k in (2, 4, 8) for a in (1.0, 10.0, 100.0))
CUMULATIVE = {"A_G1": ("G1_level",), "B_G1_G2": ("G1_level", "G2_temporal_drift"), "C_G1_G2_G3": ("G1_level", "G2_temporal_drift", "G3_bosch_phase"), "D_all": tuple(FEATURE_GROUPS)}

FACTS = "held_out_lot int, family string, ablation string, experiment_key string, lot_number int, stage string, predicted array<double>, observed array<double>, predicted_std array<double>, facts string, importance array<double>, coefficient_sign array<double>"


def modelling_rows(features: DataFrame, maps: DataFrame, key: str = "experiment_key") -> DataFrame:
    """(experiment_key, lot_number, x, map): the wafers that have both, vectors by feature name, maps as ``ordered_maps`` gives them."""
    return feature_vectors(features, key).join(maps.select(key, "lot_number", "map"), key).select(F.col(key).alias("experiment_key"), F.col("lot_number").cast("int").alias("lot_number"), "x", "map")


def fold_rows(rows: DataFrame, families: Sequence[str], forward: bool, least: int) -> DataFrame:
    """Each wafer for every fold and family that it is trained on or tested in."""
    lots = rows.select(F.col("lot_number").alias("held_out_lot")).distinct()
    fold = F.lit(True)
    if forward:
        from pyspark.sql import Window

        lots = lots.withColumn("_k", F.dense_rank().over(Window.orderBy("held_out_lot"))).filter(F.col("_k") > least).drop("_k")
        fold = F.col("lot_number") <= F.col("held_out_lot")
    spec = lots.withColumn("family", F.explode(F.array(*map(F.lit, families))))
    return rows.join(F.broadcast(spec), fold)


def _sorted(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    g = g.sort_values("experiment_key").reset_index(drop=True)
    return g, np.stack(g["x"].to_numpy()).astype(float), np.stack(g["map"].to_numpy()).astype(float), g["lot_number"].to_numpy()


def _emit(g, test, held, family, ablation, fold: evaluate.Fold, observed) -> pd.DataFrame:
    out = []
    for stage, p in fold.stages.items():
        sd = fold.stds.get(stage)
        for j, i in enumerate(np.flatnonzero(test)):
            out.append((held, family, ablation, g["experiment_key"][i], int(g["lot_number"][i]), stage, p[j], observed[i], None if sd is None else sd[j], json.dumps(fold.facts), fold.importance, fold.sign))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")])


MOMENTS = "ablation string, subset string, places array<int>, lot_number int, features int, count long, mean array<double>, centred array<double>"


def _names(kinds: str) -> list[str]:
    return [c.split()[0] for c in kinds.split(", ")]


def lot_moments(rows: DataFrame, subsets: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """Moments of each lot's rows (x, map) by ``ablation``: tasks merge those of what they read, and only these are shuffled.

    With ``subsets`` (places of features, by name) there is a row for each subset: the entries of one matrix that
    belong to it, so that the rows are gone through once for all of them.
    """
    z = rows.select("ablation", "lot_number", F.size("x").alias("features"), F.concat("x", "map").alias("z"))

    def frame(found: dict) -> pd.DataFrame:
        return pd.DataFrame([(a, "", None, n, p, m.count, m.mean, m.centred.ravel()) for (a, n), (p, m) in found.items()], columns=_names(MOMENTS))

    def partial(batches):
        found: dict = {}
        for b in batches:
            for key, g in b.groupby(["ablation", "lot_number"]):
                m = linear.Moments.of(np.stack(g["z"].to_numpy()))
                found[key] = (int(g["features"].iloc[0]), found[key][1] + m if key in found else m)
        yield frame(found)

    def total(g: pd.DataFrame) -> pd.DataFrame:
        w = _moments(g)
        (n, m), name = next(iter(w.own.items())), g["ablation"].iloc[0]
        if subsets is None:
            return frame({(name, n): (w.features, m)})
        own = ((s, np.asarray(places, int), w.only(places).own[n]) for s, places in subsets.items())
        return pd.DataFrame([(name, s, places, n, len(places), x.count, x.mean, x.centred.ravel()) for s, places, x in own], columns=_names(MOMENTS))

    return z.mapInPandas(partial, MOMENTS).groupBy("ablation", "lot_number").applyInPandas(total, MOMENTS)


def _moments(g: pd.DataFrame) -> evaluate.LotMoments:
    """Parts of one lot are merged in an order of their own, so the sum doesn't depend on how they came."""
    parts: dict = {}
    for n, count, mean, centred in zip(g["lot_number"], g["count"], g["mean"], g["centred"]):
        parts.setdefault(int(n), []).append(linear.Moments(int(count), np.asarray(mean, float), np.asarray(centred, float).reshape(len(mean), -1)))
    own = {}
    for n, some in parts.items():
        some.sort(key=lambda m: (m.count, m.mean.tobytes()))
        own[n] = sum(some[1:], some[0])
    return evaluate.LotMoments(own, int(g["features"].iloc[0]))


def _places(g: pd.DataFrame) -> np.ndarray | None:
    places = g["places"].iloc[0]
    return None if places is None else np.asarray(places, int)


FITTED = "ablation string, subset string, held_out_lot int, family string, at_lot int, models binary"
INNER = "ablation string, subset string, held_out_lot int, family string, residual boolean, place int, label string, at_lot int, part int, wafers long, total double"
FINAL = FITTED + ", facts string, importance array<double>, coefficient_sign array<double>"
_BY = ["ablation", "subset", "held_out_lot", "family"]


#: Wafers of a lot that one group holds, and of a whole fold of a Gaussian process.
PART, GROUP = 1024, 2048


class Parts:
    """The wafers of lots in parts of some ``PART``, and what was fitted sent to each part of its lot. No group grows with its lot."""

    def __init__(self, rows: DataFrame, moments: DataFrame):
        self.by = ["ablation", "lot_number", "part"]
        self.lots = moments.groupBy("ablation", "lot_number").agg(F.ceil(F.max("count") / PART).cast("int").alias("parts"))  # a row a lot
        dealt = rows.select("ablation", "experiment_key", "lot_number", "x", "map").join(F.broadcast(self.lots), ["ablation", "lot_number"])
        self.wafers = dealt.withColumn("part", F.pmod(F.xxhash64("experiment_key"), "parts").cast("int")).drop("parts")

    def applied(self, fitted: DataFrame, run, kinds: str) -> DataFrame:
        """``run(wafers, fitted)`` of each part of the lot that ``at_lot`` names."""
        lots = self.lots.withColumnRenamed("lot_number", "at_lot")
        sent = fitted.join(F.broadcast(lots), ["ablation", "at_lot"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        at = ["ablation", "at_lot", "part"]
        return spread(self.wafers, *self.by).groupBy(*self.by).cogroup(spread(sent, *at).groupBy(*at)).applyInPandas(run, kinds)


def _chosen(parts: Parts, folds: DataFrame, params: Mapping[str, Sequence], share: float, most: int) -> DataFrame:
    """(ablation, subset, held_out_lot, family, place, residual_place, error, residual_error): the parameters that inner folds choose.

    Candidates are fitted on the lots' moments, scored part by part of a lot, averaged and chosen natively. Parts are
    added up in their order, so candidates that are the same model stay equal.
    """

    def inner(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        name, subset, held, family = key[0], key[1], int(key[2]), key[3]
        w, places, out = _moments(g), _places(g), []
        train = tuple(n for n in w.names if n != held)
        for n in train if len(train) > 1 else ():
            fitted = evaluate.portable(w, tuple(x for x in train if x != n), family, params[family], params[family], share, most, places)
            out.append((name, subset, held, family, n, pickle.dumps(fitted)))
        return pd.DataFrame(out, columns=_names(FITTED))

    def scored(wafers: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(wafers) and len(fitted):
            _, x, maps, _ = _sorted(wafers)
            for name, subset, held, family, at, part, blob in zip(*(fitted[c] for c in ("ablation", "subset", "held_out_lot", "family", "at_lot", "part", "models"))):
                for residual, found in zip((False, True), pickle.loads(blob).errors(x, maps)):
                    out += [(name, subset, held, family, residual, i, evaluate.label(params[family][i]), at, part, len(x), (e**2 if residual else e) * len(x)) for i, e in enumerate(found)]
        return pd.DataFrame(out, columns=_names(INNER))

    fitted = spread(folds, *_BY).groupBy(*_BY).applyInPandas(inner, FITTED)
    scores = parts.applied(fitted, scored, INNER)
    lots = scores.groupBy(*_BY, "residual", "place", "label", "at_lot").agg(F.array_sort(F.collect_list(F.struct("part", "total"))).alias("t"), F.sum("wafers").alias("n"))
    mean = F.aggregate("t", F.lit(0.0), lambda a, x: a + x["total"]) / F.col("n")
    lots = lots.withColumn("e", F.when(F.col("residual"), F.sqrt(mean)).otherwise(mean))
    each = F.transform(F.array_sort(F.collect_list(F.struct("at_lot", "e"))), lambda x: x["e"])
    scores = lots.groupBy(*_BY, "residual", "place", "label").agg(each.alias("e")).withColumn("error", F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.size("e"))
    best = scores.groupBy(*_BY, "residual").agg(F.min(F.struct("error", "label", "place")).alias("b"))
    at = lambda r: F.max(F.when(F.col("residual") == r, F.col("b")))
    return best.groupBy(*_BY).agg(at(False).alias("s"), at(True).alias("r")).select(*_BY, "s.place", F.col("r.place").alias("residual_place"), F.col("s.error").alias("error"), F.col("r.error").alias("residual_error"))


def _linear_folds(rows: DataFrame, params: Mapping[str, Sequence], forward: bool, least: int, share: float, most: int, subsets: Mapping[str, Sequence[int]] | None) -> DataFrame:
    """The facts of the families that moments suffice for.

    No group holds more than some ``PART`` wafers: folds are fitted on the lots' moments, and what they fit goes to the
    parts of the lot that it is scored on.
    """
    moments = written(lot_moments(rows, subsets), "moments")
    folds = fold_rows(moments, list(params), forward, least)
    parts = Parts(rows, moments)
    best = _chosen(parts, folds, params, share, most)

    def final(key: tuple, g: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(chosen):
            return pd.DataFrame([], columns=_names(FINAL))
        name, subset, held, family = key[0], key[1], int(key[2]), key[3]
        w, c = _moments(g), chosen.iloc[0]
        train = tuple(n for n in w.names if n != held)
        s, r = params[family][int(c["place"])], params[family][int(c["residual_place"])]
        facts, importance, sign = evaluate.fold_facts(w, train, family, s, r, float(c["error"]), float(c["residual_error"]), w.own[held].count, share, most)
        blob = pickle.dumps(evaluate.portable(w, train, family, [s], [r], share, most, _places(g)))
        return pd.DataFrame([(name, subset, held, family, held, blob, json.dumps(facts), importance, sign)], columns=_names(FINAL))

    def predicted(wafers: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(wafers) and len(fitted):
            g, x, maps, _ = _sorted(wafers)
            for f in fitted.itertuples():
                name = f.subset or f.ablation
                for stage, p in pickle.loads(f.models).stages(x, maps).items():
                    out += [(f.held_out_lot, f.family, name, k, int(n), stage, p[i], maps[i], None, f.facts, f.importance, f.coefficient_sign) for i, (k, n) in enumerate(zip(g["experiment_key"], g["lot_number"]))]
        return pd.DataFrame(out, columns=_names(FACTS))

    models = spread(folds, *_BY).groupBy(*_BY).cogroup(spread(best, *_BY).groupBy(*_BY)).applyInPandas(final, FINAL)
    return parts.applied(models, predicted, FACTS)


def evaluate_folds(rows: DataFrame, families: Sequence[str] = ("ridge", "pls"), parameters: Mapping[str, Sequence] = PARAMETERS, forward: bool = False, least_lots: int = 3, variance: float = 0.90, most: int = 8, ablation: str = "ablation", subsets: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """The facts of every outer fold: leave-one-lot-out, or with ``forward`` earlier lots only.

    One row for each test wafer and stage; see ``points``, ``folds``, ``stability``. Parameters are chosen in inner
    folds of the training lots, of which there must be two or more. ``rows`` may carry a column ``ablation``; each value
    is evaluated in the same job. ``subsets``, by name the places in x, are ablations of the same rows: they share one
    moment matrix a lot. Gaussian processes need their training wafers: folds of up to ``GROUP`` wafers are groups of them, the
    matrices of larger ones are factored by tiles (see ``tiles``), for each round of points where parameters are fitted.
    The wafers' rows and the lots' moments are met several times, so they are written to the shared folder.
    """
    rows = written(rows.withColumn("ablation", F.col(ablation) if ablation in rows.columns else F.lit("all")), "modelling-rows")
    params = {f: tuple(parameters[f]) for f in families}
    linear_ones = {f: p for f, p in params.items() if f != "gpr"}
    out = _linear_folds(rows, linear_ones, forward, least_lots, variance, most, subsets) if linear_ones else None
    if "gpr" not in params:
        return out

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        held, family, name = int(key[0]), key[1], key[2]
        g, x, maps, lots = _sorted(g)
        w = evaluate.Wafers(x, maps, lots)
        return _emit(g, lots == held, held, family, name, evaluate.run_fold(w, tuple(n for n in w.names if n != held), held, family, params[family], variance, most), maps)

    wafers = rows.groupBy("ablation").count().agg(F.max("count")).first()[0] or 0
    if wafers > GROUP:
        moments = written(lot_moments(rows), "moments")
        known = {a: _moments(g) for a, g in moments.toPandas().groupby("ablation")}  # a row a lot
        tiled = process_folds(Parts(rows, moments), known, params["gpr"], forward, least_lots, variance, most, _emit, FACTS)
        return tiled if out is None else out.unionByName(tiled)
    grouped = fold_rows(rows, ["gpr"], forward, least_lots).groupBy("held_out_lot", "family", "ablation").applyInPandas(run, FACTS)
    return grouped if out is None else out.unionByName(grouped)


def points(facts: DataFrame, coordinates: Column | None = None) -> DataFrame:
    """One row for each wafer, stage and place of the map."""
    z = F.posexplode(F.arrays_zip("predicted", "observed", F.coalesce("predicted_std", F.transform("predicted", lambda _: F.lit(None).cast("double"))).alias("predicted_std")))
    p = facts.select("held_out_lot", "family", "ablation", "experiment_key", "lot_number", "stage", z.alias("place", "z"))
    return p.select("held_out_lot", "family", "ablation", "experiment_key", "lot_number", "stage", "place", "z.predicted", "z.observed", F.col("z.predicted_std").alias("predicted_std"))


FOLD_FIELDS = "training_wafers int, test_wafers int, retained_features int, mean_parameter string, mean_inner_lot_macro_mae double, residual_parameter string, residual_inner_lot_macro_rmse double, residual_components int, residual_explained_variance double"


def folds(facts: DataFrame) -> DataFrame:
    """One row for each fold, family and ablation: what was chosen."""
    f = facts.select("held_out_lot", "family", "ablation", "facts").distinct()
    return f.select("held_out_lot", "family", "ablation", F.from_json("facts", FOLD_FIELDS).alias("f")).select("held_out_lot", "family", "ablation", "f.*")


def stability(facts: DataFrame, names: Sequence[str], top: int = 20) -> DataFrame:
    """(fold, family, feature, feature_group, sensor_family, importance, coefficient_sign, rank, top_20); constant features are not ranked."""
    from pyspark.sql import Window

    f = facts.filter(F.col("importance").isNotNull()).dropDuplicates(["held_out_lot", "family", "ablation"])
    n = F.array(*map(F.lit, sorted(names)))
    z = f.select("held_out_lot", "family", "ablation", F.posexplode(F.arrays_zip("importance", "coefficient_sign")).alias("place", "z")).filter(F.col("z.importance").isNotNull() & ~F.isnan("z.importance"))
    z = z.withColumn("feature", F.try_element_at(n, F.col("place") + 1))
    rank = F.row_number().over(Window.partitionBy("held_out_lot", "family", "ablation").orderBy(F.desc("importance"), "place"))
    z = z.select("held_out_lot", "family", "ablation", "place", "feature", feature_group(F.col("feature")).alias("feature_group"), sensor_family(F.col("feature")).alias("sensor_family"), F.col("z.importance").alias("importance"), F.col("z.coefficient_sign").alias("coefficient_sign"))
    return z.withColumn("rank", rank).withColumn("top_20", F.col("rank") <= top).drop("place")


def ablation_subsets(names: Sequence[str], cumulative: Mapping[str, Sequence[str]] = CUMULATIVE, families: bool = True) -> dict[str, list[int]]:
    """By ablation the places of its features in their order: cumulative groups, and with ``families`` each sensor family alone."""
    ordered = sorted(names)
    out = {name: [i for i, n in enumerate(ordered) if group_of(n) in groups] for name, groups in cumulative.items()}
    if families:
        for i, n in enumerate(ordered):
            out.setdefault(f"only_{family_of(n)}", []).append(i)
    return {name: places for name, places in out.items() if places}


def ablation_steps(wafers: DataFrame, order: Sequence[str] = tuple(CUMULATIVE)) -> DataFrame:
    """(ablation, previous, lots, lots_improved, lot_macro_mae, relative_gain) of each cumulative subset against the one before; the first has none before it."""
    lots = wafers.filter(F.col("ablation").isin(*order)).groupBy("ablation", "lot_number").agg(F.avg("mae").alias("mae"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("ablation"))
    lots = lots.withColumn("_p", place)
    before = lots.select((F.col("_p") + 1).alias("_p"), "lot_number", F.col("ablation").alias("previous"), F.col("mae").alias("_mae"))
    j = lots.join(before, ["_p", "lot_number"], "left")
    return j.groupBy("ablation").agg(F.max("previous").alias("previous"), F.count("*").alias("lots"), F.count_if(F.col("mae") < F.col("_mae")).alias("lots_improved"), F.avg("mae").alias("lot_macro_mae"), (1 - F.avg("mae") / F.avg("_mae")).alias("relative_gain"))


def compare(forward_wafers: DataFrame, lolo_wafers: DataFrame) -> DataFrame:
    """(scope, family, lot_number, lolo_mae, chronological_mae, relative_degradation) per lot of both and as means of lots."""
    a = forward_wafers.groupBy("family", "lot_number").agg(F.avg("mae").alias("chronological_mae"))
    j = a.join(lolo_wafers.groupBy("family", "lot_number").agg(F.avg("mae").alias("lolo_mae")), ["family", "lot_number"])
    g = j.groupingSets([["family", "lot_number"], ["family"]], "family", "lot_number").agg(F.avg("lolo_mae").alias("lolo_mae"), F.avg("chronological_mae").alias("chronological_mae"))
    return g.select(F.when(F.col("lot_number").isNull(), "macro").otherwise("lot").alias("scope"), "family", "lot_number", "lolo_mae", "chronological_mae", (F.col("chronological_mae") / F.when(F.col("lolo_mae") > 0, F.col("lolo_mae")) - 1).alias("relative_degradation"))


#: Values of spectra (wafers by channels) that one task holds.
SPECTRAL_VALUES = 2_000_000
KERNEL = "a int, b int, lot_number int, rows int, kernel binary"
SHIFTS = "held_out_lot int, experiment_key string, shift double, setting string, inner_error double"


def fold_kernels(spectra: DataFrame, values: int = SPECTRAL_VALUES) -> DataFrame:
    """(a, b, lot_number, rows, kernel): for the wafers that a fold trains on, all but lots a and b, the products of every lot's standard spectra with theirs.

    spectra: (experiment_key, lot_number, spectrum). b is a for an outer fold; an inner one and that with both lots
    exchanged train on the same wafers. Channels are standardised over training, constant ones left out. A task holds
    some channels of all wafers, ``values`` numbers at most, and makes their share of every kernel; shares are added up
    lot by lot. Rows are wafers by (lot, key), columns the training ones.
    """
    n, wide = spectra.agg(F.count("*"), F.max(F.size("spectrum"))).first()
    width = max(1, min(int(wide or 1), values // max(int(n), 1)))
    cut = F.transform(F.sequence(F.lit(0), F.size("spectrum") - 1, F.lit(width)), lambda i: F.slice("spectrum", i + 1, F.lit(width)))
    parts = spectra.select("experiment_key", F.col("lot_number").cast("int").alias("lot_number"), F.posexplode(cut).alias("part", "v"))

    def share(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["lot_number", "experiment_key"])
        x, lots = np.stack(g["v"].to_numpy()).astype(float), g["lot_number"].to_numpy()
        names, out = sorted(set(lots.tolist())), []
        for i, a in enumerate(names):
            for b in names[i:]:
                train = (lots != a) & (lots != b)
                if train.sum() < 2:
                    continue
                mean, deviation = x[train].mean(axis=0), x[train].std(axis=0)
                keep = deviation**2 > 1e-18
                z = (x[:, keep] - mean[keep]) / deviation[keep]
                k = z @ z[train].T
                out += [(a, b, n, int((lots == n).sum()), k[lots == n].tobytes()) for n in names]
        return pd.DataFrame(out, columns=_names(KERNEL))

    def added(g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(k) for k in g["kernel"])
        return g.iloc[:1].assign(kernel=total.tobytes())

    return parts.groupBy("part").applyInPandas(share, KERNEL).groupBy("a", "b", "lot_number").applyInPandas(added, KERNEL)


def spectral_shifts(rows: DataFrame, spectra: DataFrame, candidates: Sequence[tuple[int, float]] = SPECTRAL_CANDIDATES, values: int = SPECTRAL_VALUES) -> DataFrame:
    """(held_out_lot, experiment_key, shift, setting, inner_error): each wafer's shift by its spectrum, leave-one-lot-out.

    Ridge on the leading components of standard channels, by the fold's kernel alone: the number of components and the
    penalty are those of the least mean error over the inner lots. A group holds a kernel of wafers, never spectra.
    """
    candidates = tuple(candidates)
    levels = rows.select("experiment_key", F.col("lot_number").cast("int").alias("lot_number"), (F.aggregate("map", F.lit(0.0), lambda s, x: s + x) / F.size("map")).alias("level"))
    own = levels.join(spectra.select("experiment_key", "spectrum"), "experiment_key")
    kernels = written(fold_kernels(own, values), "kernels")
    levels = own.groupBy("lot_number").agg(F.array_sort(F.collect_list(F.struct("experiment_key", "level"))).alias("w"))
    blocks = kernels.join(levels, "lot_number")

    def fold(g: pd.DataFrame):
        """(training levels less their mean, that mean, u, s, the kernel and keys and levels of a lot)."""
        g = g.sort_values("lot_number")
        a, b = int(g["a"].iloc[0]), int(g["b"].iloc[0])
        own = {int(n): (np.frombuffer(k).reshape(r, -1), [x["experiment_key"] for x in w], np.array([x["level"] for x in w])) for n, r, k, w in zip(g["lot_number"], g["rows"], g["kernel"], g["w"])}
        train = [n for n in own if n not in (a, b)]
        y, k = np.concatenate([own[n][2] for n in train]), np.concatenate([own[n][0] for n in train])
        values, u = np.linalg.eigh((k + k.T) / 2)
        s = np.sqrt(np.maximum(values[::-1], 0))
        return a, b, own, y.mean(), y - y.mean(), u[:, ::-1], s

    def predicted(parts, lot: int, some) -> dict:
        _, _, own, _, y, u, s = parts
        # A centred matrix of n rows has n - 1 directions; what is left of others is rounding.
        m = max(1, int((s > 1e-7 * s[0]).sum()))
        along, weight = own[lot][0] @ u[:, :m] / np.maximum(s[:m], 1e-300), u[:, :m].T @ y
        out = {}
        for k, alpha in some:
            n = max(1, min(k, len(y) - 1, m))
            out[k, alpha] = along[:, :n] @ (s[:n] / (s[:n] ** 2 + alpha) * weight[:n])
        return out

    def inner(g: pd.DataFrame) -> pd.DataFrame:
        parts = fold(g)
        a, b, own, level = parts[:4]
        out = []
        for held, tested in ((a, b), (b, a)):
            for i, p in enumerate(predicted(parts, tested, candidates).values()):
                out.append((held, tested, i, float(np.abs(p - (own[tested][2] - level)).mean())))
        return pd.DataFrame(out, columns=["held", "tested", "place", "error"])

    named = F.array(*[F.lit(f"pca={k},alpha={alpha:g}") for k, alpha in candidates])
    errors = blocks.filter("a <> b").groupBy("a", "b").applyInPandas(inner, "held int, tested int, place int, error double").groupBy("held", "place").agg(F.avg("error").alias("error"))
    best = errors.withColumn("setting", F.element_at(named, F.col("place") + 1)).groupBy("held").agg(F.min(F.struct("error", "setting", "place")).alias("b")).select(F.col("held").alias("a"), "b.*")

    def outer(g: pd.DataFrame) -> pd.DataFrame:
        parts = fold(g)
        c = candidates[int(g["place"].iloc[0])]
        p = predicted(parts, parts[0], [c])[c]
        return pd.DataFrame({"held_out_lot": parts[0], "experiment_key": parts[2][parts[0]][1], "shift": p, "setting": g["setting"].iloc[0], "inner_error": g["error"].iloc[0]})

    return blocks.filter("a = b").join(best, "a").groupBy("a").applyInPandas(outer, SHIFTS)


def fused_spectra(rows: DataFrame, spectra: DataFrame, pls: Sequence = PARAMETERS["pls"], candidates: Sequence[tuple[int, float]] = SPECTRAL_CANDIDATES) -> DataFrame:
    """Leave-one-lot-out facts of the fused model: ``spectra(experiment_key, spectrum array)`` predict the shift, process features the residual.

    Of wafers that have both. Spectra go into kernels by channels, process features into moments by lots.
    """
    rows = written(rows.join(spectra.select("experiment_key"), "experiment_key", "left_semi").select("experiment_key", "lot_number", "x", "map"), "fused-rows")
    facts = evaluate_folds(rows, ("pls",), {"pls": tuple(pls)}).filter(F.col("stage").isin("template", "mean_shift", "full_map"))
    at = lambda s: F.first(F.when(F.col("stage") == s, F.col("predicted")), ignorenulls=True)
    wide = facts.groupBy("held_out_lot", "experiment_key", "lot_number").agg(at("template").alias("template"), at("mean_shift").alias("mean"), at("full_map").alias("full"), F.first("observed").alias("observed"), F.first("facts").alias("own"))
    j = wide.join(spectral_shifts(rows, spectra, candidates), ["held_out_lot", "experiment_key"])
    shifted = F.transform("template", lambda x: x + F.col("shift"))
    residual = F.zip_with("full", "mean", lambda x, y: x - y)
    stages = F.array(F.struct(F.lit("template").alias("stage"), F.col("template").alias("p")), F.struct(F.lit("mean_shift").alias("stage"), shifted.alias("p")), F.struct(F.lit("full_map").alias("stage"), F.zip_with(shifted, residual, lambda x, y: x + y).alias("p")))
    said = F.to_json(F.struct(F.col("setting").alias("spectral_setting"), F.col("inner_error").alias("spectral_inner_mae"), F.get_json_object("own", "$.residual_parameter").alias("residual_parameter"), F.get_json_object("own", "$.residual_inner_lot_macro_rmse").cast("double").alias("residual_inner_lot_macro_rmse")))
    none = F.lit(None).cast("array<double>")
    return j.select("held_out_lot", F.lit("oes_mean_process_residual").alias("family"), F.lit("all").alias("ablation"), "experiment_key", "lot_number", F.explode(stages).alias("s"), "observed", said.alias("facts")).select(
        "held_out_lot", "family", "ablation", "experiment_key", "lot_number", "s.stage", F.col("s.p").alias("predicted"), "observed", none.alias("predicted_std"), "facts", none.alias("importance"), none.alias("coefficient_sign"))


REPLAY = "test_lot int, feedback string, budget double, experiment_key string, wafer_order int, measured boolean, true_error double, system_error double, updates int, drift_error_threshold double"
FEEDBACKS = ("F0", "F1", "F2", "F3")
CAUSAL = "test_lot int, model binary"


def causal_models(rows: DataFrame, parameters: Sequence = PARAMETERS["pls"], least_lots: int = 3) -> tuple[DataFrame, DataFrame]:
    """((test_lot, model), (test_lot, drift_error_threshold)) of every lot that follows at least ``least_lots`` others, fitted on earlier lots.

    drift_error_threshold is the 95 % quantile of the training wafers' errors. Fits need the lots' moments only; models
    go to the lots that they are applied to.
    """
    params = {"pls": tuple(parameters)}
    rows = written(rows.withColumn("ablation", F.lit("all")), "causal-rows")
    moments = written(lot_moments(rows), "moments")
    folds, dealt = fold_rows(moments, ["pls"], True, least_lots), Parts(rows, moments)
    best = written(_chosen(dealt, folds, params, evaluate.SHARE, evaluate.MOST), "chosen")

    def parts(key: tuple, g: pd.DataFrame, chosen: pd.DataFrame):
        w, c, held = _moments(g), chosen.iloc[0], int(key[2])
        return w, tuple(n for n in w.names if n != held), held, params["pls"][int(c["place"])], params["pls"][int(c["residual_place"])]

    def fit(key: tuple, g: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(chosen):
            return pd.DataFrame([], columns=_names(CAUSAL))
        w, train, held, s, r = parts(key, g, chosen)
        return pd.DataFrame([(held, pickle.dumps(evaluate.Causal(w, train, s, r)))], columns=_names(CAUSAL))

    def back(key: tuple, g: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(chosen):
            return pd.DataFrame([], columns=_names(FITTED))
        w, train, held, s, r = parts(key, g, chosen)
        blob = pickle.dumps(evaluate.portable(w, train, "pls", [s], [r]))
        return pd.DataFrame([("all", "", held, "pls", n, blob) for n in train], columns=_names(FITTED))

    def errors(wafers: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(wafers) and len(fitted):
            _, x, maps, _ = _sorted(wafers)
            out = [(held, float(e)) for held, blob in zip(fitted["held_out_lot"], fitted["models"]) for e in np.abs(pickle.loads(blob).stages(x, maps)["full_map"] - maps).mean(axis=1)]
        return pd.DataFrame(out, columns=["test_lot", "error"])

    pairs = folds.groupBy(*_BY).cogroup(best.groupBy(*_BY))
    train = dealt.applied(pairs.applyInPandas(back, FITTED), errors, "test_lot int, error double")
    limits = train.groupBy("test_lot").agg(F.percentile("error", F.lit(0.95)).alias("drift_error_threshold"))
    return pairs.applyInPandas(fit, CAUSAL), limits


def causal_feedback(rows: DataFrame, selection: DataFrame, feedbacks: Sequence[str] = FEEDBACKS, parameters: Sequence = PARAMETERS["pls"], alpha: float = 0.3, least_lots: int = 3) -> DataFrame:
    """A row for each wafer, budget and feedback of every test lot that follows at least ``least_lots`` others.

    selection: (experiment_key, budget, measured). Models see earlier lots and wafers measured before only; a group
    replays the test lot for one feedback and budget.
    """
    models, limits = causal_models(rows, parameters, least_lots)
    models = models.join(limits, "test_lot").withColumn("feedback", F.explode(F.array(*map(F.lit, feedbacks))))
    picked = selection.groupBy("experiment_key", "budget").agg(F.max("measured").alias("measured"))
    wafers = rows.select(F.col("lot_number").alias("test_lot"), "experiment_key", "lot_number", "x", "map")
    # A lot's budgets, each with all of its wafers: those that a selection lacks are not measured.
    budgets = wafers.select("test_lot", "experiment_key").join(picked, "experiment_key").select("test_lot", F.col("budget").alias("_b")).distinct()
    named = lambda: budgets.select("test_lot", F.col("_b").alias("budget"))
    own = wafers.join(F.broadcast(named()), "test_lot").join(picked, ["experiment_key", "budget"], "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    own = own.withColumn("feedback", F.explode(F.array(*map(F.lit, feedbacks))))
    models = models.join(named(), "test_lot")

    def run(key: tuple, g: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g) and len(fitted):
            lot, feedback, budget = int(key[0]), key[1], float(key[2])
            g, x, targets, _ = _sorted(g)
            model, limit = pickle.loads(fitted["model"].iloc[0]), float(fitted["drift_error_threshold"].iloc[0])
            true, measured = np.abs(model.predicted(model.start, x) - targets).mean(axis=1), g["measured"].to_numpy(bool)
            _, errors, updates = evaluate.replay(model, x, targets, measured, feedback, alpha)
            out = [(lot, feedback, budget, k, i + 1, bool(m), float(t), float(e), updates, limit) for i, (k, m, t, e) in enumerate(zip(g["experiment_key"], measured, true, errors))]
        return pd.DataFrame(out, columns=_names(REPLAY))

    by = ("test_lot", "feedback", "budget")
    return spread(own, *by).groupBy(*by).cogroup(spread(models, *by).groupBy(*by)).applyInPandas(run, REPLAY)


#: Groups over which the streams of one lot and feedback are dealt, at most: each has a copy of the lot's wafers.
STREAM_PARTS = 16
FEEDBACK_STREAMS = "lot_number int, policy string, budget double, replicate long, feedback string, updates int, " + ", ".join(f"{c} {'long' if c == 'measured_wafers' else 'double'}" for c in kernel.METRICS)


def feedback_streams(rows: DataFrame, wafers: DataFrame, policies: Sequence[str], budgets: Sequence[float], replicates: int = 100, seed: int = 20260721, feedbacks: Sequence[str] = FEEDBACKS, parameters: Sequence = PARAMETERS["pls"], alpha: float = 0.3, least_lots: int = 3) -> DataFrame:
    """(lot_number, policy, budget, replicate, feedback, updates, metrics): policies that decide wafer by wafer, crossed with what they teach the models.

    ``wafers`` has the scores of ``policies`` by experiment_key, as ``analyses.causal_wafers``; 'no_metrology',
    'periodic' and ``replicates`` of 'random' are added. A row a stream: decisions are made and replayed where the lot's
    wafers are, by what earlier lots and the wafers measured before them tell. What a measured wafer teaches changes no
    decision, as scores are of earlier lots. A stream goes through its wafers one after the other; the streams of a lot
    and feedback are dealt over groups, ``STREAM_PARTS`` at most.
    """
    models, _ = causal_models(rows, parameters, least_lots)
    policies = list(policies)
    cells = [(p, r, float(b)) for p, some in (("no_metrology", 1), ("periodic", 1), *((p, 1) for p in policies), ("random", replicates)) for r in range(some) for b in budgets]
    parts = max(1, min(STREAM_PARTS, len(cells)))
    dealt = lambda df: df.withColumn("feedback", F.explode(F.array(*map(F.lit, feedbacks)))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    models = dealt(models)
    scores = wafers.select("experiment_key", F.array(*[F.col(p).cast("double") for p in policies]).alias("s"))
    own = dealt(rows.join(scores, "experiment_key").select(F.col("lot_number").alias("test_lot"), "experiment_key", "lot_number", "x", "map", "s"))

    def run(key: tuple, g: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g) and len(fitted):
            g, x, targets, _ = _sorted(g)
            model, n = pickle.loads(fitted["model"].iloc[0]), len(g)
            true = np.abs(model.predicted(model.start, x) - targets).mean(axis=1)
            s, keys = np.stack(g["s"].to_numpy()).astype(float).T, g["experiment_key"].tolist()

            def decided(policy: str, replicate: int, b: float) -> np.ndarray:
                if policy == "no_metrology":
                    return np.zeros(n, bool)
                if policy == "periodic":
                    return kernel.periodic(n, b)
                own = kernel.keyed_draws(seed, [replicate], keys) / float(1 << 32) if policy == "random" else s[policies.index(policy)][None]
                return kernel.quota(own, np.array([b]), np.array([1 - b]))[0]

            for policy, replicate, b in cells[int(key[2]) :: parts]:
                measured = decided(policy, replicate, b)
                _, errors, updates = evaluate.replay(model, x, targets, measured, key[1], alpha)
                m = kernel.stream_metrics(measured[None], true, errors[None])
                out.append((int(key[0]), policy, b, replicate, key[1], updates, *(m[c][0] for c in kernel.METRICS)))
        return pd.DataFrame(out, columns=_names(FEEDBACK_STREAMS))

    by = ("test_lot", "feedback", "part")
    streams = spread(own, *by).groupBy(*by).cogroup(spread(models, *by).groupBy(*by)).applyInPandas(run, FEEDBACK_STREAMS)
    return streams.withColumn("unmeasured_wafer_mae", F.when(~F.isnan("unmeasured_wafer_mae"), F.col("unmeasured_wafer_mae")))


def feedback_gain(streams: DataFrame) -> DataFrame:
    """(policy, budget, feedback, lot_macro_system_mae, relative_gain): means of lots, and what each feedback gains on none."""
    lots = streams.groupBy("policy", "budget", "feedback", "lot_number").agg(F.avg("total_system_mae").alias("e"))
    m = lots.groupBy("policy", "budget", "feedback").agg(F.avg("e").alias("lot_macro_system_mae"))
    base = m.filter("feedback = 'F0'").select("policy", "budget", F.col("lot_macro_system_mae").alias("_b"))
    return m.join(base, ["policy", "budget"]).withColumn("relative_gain", 1 - F.col("lot_macro_system_mae") / F.when(F.col("_b") > 0, F.col("_b"))).drop("_b")


def selected_lots(rows: DataFrame, lots: Sequence[int]) -> DataFrame:
    """The wafers of some lots; ValueError for a lot that has none."""
    found = {r[0] for r in rows.select("lot_number").distinct().filter(F.col("lot_number").isin(*lots)).collect()}
    if missing := sorted(set(lots) - found):
        raise ValueError(f"selected lots have no wafers: {missing}")
    return rows.filter(F.col("lot_number").isin(*lots))


def require_features(keys: DataFrame, features: Mapping[str, DataFrame], key: str = "experiment_key") -> None:
    """ValueError naming wafers of ``keys`` that a feature source lacks, up to ten of each."""
    lacking = {name: [r[0] for r in keys.select(key).distinct().join(f.select(key).distinct(), key, "left_anti").orderBy(key).limit(10).collect()] for name, f in features.items()}
    if any(lacking.values()):
        raise ValueError("selected dense wafer is missing features: " + ", ".join(f"{k}={v}" for k, v in lacking.items() if v))
