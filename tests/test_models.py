"""Kernels against closed forms, nested evaluation without leakage, replays in batch and as a stream, manifests."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise import queries
from lotwise.kernels import evaluate, gaussian, linear
from lotwise.operators import risk
from lotwise.plans import analyses, manifest, models, pipeline, tiles
from lotwise.sources.shared import written
from lotwise.streaming import replay
from tests.conftest import SF


def test_least_squares_limits():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(40, 5)), r.normal(size=(40, 2))
    ols = np.linalg.lstsq(np.c_[np.ones(40), x], y, rcond=None)[0]
    for m in (linear.fit_pls(x, y, 5), linear.fit_ridge(x, y, 1e-10)):
        assert np.allclose(m.coefficients, ols[1:]) and np.allclose(m.intercept, ols[0])
    wide = r.normal(size=(8, 30))
    a = linear.fit_ridge(wide, y[:8], 2.0)
    c = wide - wide.mean(0)
    assert np.allclose(a.coefficients, np.linalg.solve(c.T @ c + 2 * np.eye(30), c.T @ (y[:8] - y[:8].mean(0))))
    assert np.allclose(linear.fit_pls(x, np.ones(40), 3).predict(x), 1.0)


def test_vip_finds_the_feature():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 4))
    v = linear.vip(linear.fit_pls(x, 4 * x[:, 0] + 0.05 * r.normal(size=80), 2))
    assert v.argmax() == 0 and v[0] > 1 and (v**2).sum() == pytest.approx(4)


def training(x, maps):
    w = evaluate.Wafers(np.asarray(x, float), np.asarray(maps, float), np.zeros(len(x), int))
    return w.training((0,))


def test_maps_are_template_shift_and_residual():
    m = np.array([[10, 11, 12], [10.5, 11.6, 12.4], [9.8, 10.7, 11.9]])
    t = training([[0.0], [1.0], [2.0]], m)
    assert np.allclose(t.template, m.mean(0)) and np.allclose(t.template + t.shift(m)[:, None] + t.residual(m), m) and t.level == pytest.approx(m.mean())
    components, share = t.components(1.0, 8)
    r = t.residual(m)
    assert share == pytest.approx(1) and np.allclose(r @ components.T @ components, r) and np.allclose(r.mean(0), 0) and np.allclose(r.mean(1), 0)
    with pytest.raises(ValueError):
        training([[0.0], [1.0]], [[1.0, 2.0], [1.0, np.nan]])


def test_components_are_those_of_the_residuals():
    r = np.random.default_rng(5)
    m = r.normal(size=(30, 7)) * [5, 4, 3, 2, 1, 1, 1] + 100
    t = training(r.normal(size=(30, 2)), m)
    _, axes, variance = linear.principal_components(t.residual(m), 7)
    for share in (0.5, 0.9, 0.99):
        got, reached = t.components(share, 4)
        assert reached == pytest.approx(variance[: len(got)].sum() / variance.sum()) and (len(got) == 4 or reached >= share)
        assert np.allclose(np.abs((got * axes[: len(got)]).sum(1)), 1)


def test_constant_features():
    assert training([[1.0, 5.0], [2.0, 5.0], [3.0, 5.0]], np.eye(3)).kept.tolist() == [True, False]
    with pytest.raises(ValueError, match="varies"):
        training(np.ones((3, 2)), np.eye(3))


def test_moments_of_folds_are_those_of_their_wafers():
    r = np.random.default_rng(6)
    x, maps, lots = r.normal(size=(40, 6)) + 50, r.normal(size=(40, 5)) + 900, np.arange(40) % 4
    x[lots != 2, 3] = 17.25  # varies in one lot only
    w = evaluate.Wafers(x, maps, lots)
    train = lots != 2
    t = w.training((0, 1, 3))
    keep = [0, 1, 2, 4, 5]
    z = (x[train][:, keep] - x[train][:, keep].mean(0)) / x[train][:, keep].std(0)
    assert t.kept.tolist() == [i in keep for i in range(6)] and np.allclose(t.standard(x[train]), z)
    for family, direct in (("ridge", linear.fit_ridge), ("pls", linear.fit_pls)):
        for components, y in ((None, maps[train].mean(1) - maps[train].mean()), (t.components(0.9, 3)[0], t.residual(maps[train]) @ t.components(0.9, 3)[0].T)):
            a, b = w.fitted((0, 1, 3), family, 2, components), direct(z, y, 2)
            assert np.allclose(a.predict(z), b.predict(z)) and np.allclose(a.coefficients, b.coefficients)


@pytest.mark.parametrize("family", ["ridge", "pls"])
@pytest.mark.parametrize("scale", [1e4, 1e6, 1e12])
def test_what_is_held_out_leaves_no_trace(family, scale):
    """Outer and inner folds are bit for bit the same, whatever the values of the lot that they leave out."""
    r = np.random.default_rng(8)
    x, maps, lots = r.normal(size=(70, 5)) + 7.3, r.normal(size=(70, 4)), np.arange(70) % 7
    x[lots != 3, 2] = 7.3  # constant but for the spiking lot
    wild_x, wild_maps = x.copy(), maps.copy()
    wild_x[lots == 3] *= scale
    wild_maps[lots == 3] *= scale
    tame, wild = evaluate.Wafers(x, maps, lots), evaluate.Wafers(wild_x, wild_maps, lots)
    train = (0, 1, 2, 4, 5, 6)
    assert tame.training(train).kept.tolist() == [True, True, False, True, True]
    for names in (train, *(tuple(n for n in train if n != i) for i in train), (0, 1, 2)):
        a, b = (evaluate.portable(w, names, family, (1, 2), (1, 2)) for w in (tame, wild))
        assert (a.template == b.template).all() and (a.components == b.components).all()
        for m, n in zip((*a.shifts, *a.scores), (*b.shifts, *b.scores)):
            assert (m.coefficients == n.coefficients).all() and (m.intercept == n.intercept).all()
    assert evaluate.chosen(tame, train, family, (1, 2), True) == evaluate.chosen(wild, train, family, (1, 2), True)


def test_merged_moments_are_exact():
    r = np.random.default_rng(9)
    rows = r.normal(size=(33, 4)) * [1e-3, 1, 1e3, 1] + [1e6, 0, 1e9, 5]
    parts = [linear.Moments.of(x) for x in np.split(rows, [1, 9, 10, 25])]
    m, whole = sum(parts[1:], parts[0]), linear.Moments.of(rows)
    assert m.count == 33 and np.allclose(m.mean, whole.mean, rtol=1e-15) and np.allclose(m.centred, whole.centred, rtol=1e-6, atol=1e-9)
    tree = evaluate.LotMoments(dict(enumerate(parts)), 2)
    assert np.allclose(tree.moments((0, 2, 4)).centred, linear.Moments.of(np.concatenate([rows[:1], rows[9:10], rows[25:]])).centred, rtol=1e-6, atol=1e-9)


def test_ablations_of_one_matrix_are_those_of_their_rows(spark):
    rows = [(k, n, [*x, x[0] * (i % 3), float(i % 4)], m) for i, (k, n, x, m) in enumerate(wafers(4, 4))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = models.evaluate_folds(df, ("pls",), subsets={"two": [0, 3], "all": [0, 1, 2, 3, 4]})
    want = models.evaluate_folds(df.withColumn("x", F.array(F.col("x")[0], F.col("x")[3])).withColumn("ablation", F.lit("two")).unionByName(df.withColumn("ablation", F.lit("all"))), ("pls",))
    by = lambda f: {(r["ablation"], r["stage"], r["experiment_key"]): r["predicted"] for r in f.collect()}
    a, b = by(got), by(want)
    assert a.keys() == b.keys() and len(a) == 2 * 5 * 16 and all(np.allclose(a[k], b[k]) for k in a)


def test_one_decomposition_serves_all_settings():
    r = np.random.default_rng(7)
    x, new, y = r.normal(size=(12, 60)), r.normal(size=(5, 60)), r.normal(size=12)
    x[:, 3] = new[:, 3] = 1
    keep = [i for i in range(60) if i != 3]
    z, v = ((a[:, keep] - x[:, keep].mean(0)) / x[:, keep].std(0) for a in (x, new))
    for (k, alpha), p in linear.shrunken(x, y, new, [(2, 1.0), (5, 10.0), (40, 0.1)]).items():
        _, axes, _ = linear.principal_components(z, min(k, 11))
        assert np.allclose(p, linear.fit_ridge(z @ axes.T, y, alpha).predict(v @ axes.T)[:, 0])


def test_process_interpolates_and_knows_its_noise():
    x = np.linspace(0, 6, 25)[:, None]
    y = np.sin(x[:, 0])
    m = gaussian.fit_process(x, y, gaussian.Settings(1, 1.0, 1e-4))
    p, sd = m.predict(x)
    assert np.abs(p[:, 0] - y).max() < 0.05 and (sd > 0).all() and m.predict(np.array([[30.0]]))[1][0, 0] > sd.max()
    d, t = gaussian._squares(m.inputs, m.inputs), ((y - y.mean()) / y.std())[:, None]
    start = np.log([1.0, 1.0, 0.1])
    assert gaussian._likelihood(d, t, gaussian._climb(d, t, start)) > gaussian._likelihood(d, t, start)


def wafers(lots=5, each=3, bump=None):
    r = np.random.default_rng(2)
    rows = []
    for lot in range(1, lots + 1):
        for w in range(each):
            v = lot + w / 4
            m = [10 + p + 0.2 * v + 0.01 * r.normal() for p in range(3)]
            rows.append((f"2025-01-{lot:02d}_{w:02d}", lot, [v, v * v, 1.0], [x + 1000 for x in m] if lot == bump else m))
    return rows


SCHEMA = "experiment_key string, lot_number int, x array<double>, map array<double>"


@pytest.mark.parametrize("forward", [False, True])
def test_predictions_do_not_see_what_is_held_out(spark, forward):
    def at(bump):
        f = models.evaluate_folds(spark.createDataFrame(wafers(bump=bump), SCHEMA), ("ridge", "pls", "gpr"), forward=forward)
        return {(r["family"], r["stage"], r["experiment_key"]): r["predicted"] for r in f.filter("held_out_lot = 4 and stage in ('template', 'mean_shift', 'full_map')").collect()}

    plain, bumped = at(None), at(4)
    assert plain and all(np.allclose(plain[k], bumped[k]) for k in plain)
    if forward:
        later = at(5)
        assert all(np.allclose(plain[k], later[k]) for k in plain)


@pytest.mark.parametrize("forward", [False, True])
def test_folds_of_moments_are_those_of_wafers(spark, forward):
    rows = wafers(6, 4)
    got = models.evaluate_folds(spark.createDataFrame(rows, SCHEMA).repartition(5), ("ridge", "pls"), forward=forward).collect()
    x, maps, lots = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    by = {(r["held_out_lot"], r["family"], r["stage"], r["experiment_key"]): r for r in got}
    held = [4, 5, 6] if forward else [1, 2, 3, 4, 5, 6]
    assert len(by) == len(got) == len(held) * 2 * 5 * 4
    for lot in held:
        known = lots <= lot if forward else lots > 0
        w = evaluate.Wafers(x[known], maps[known], lots[known])
        for family in ("ridge", "pls"):
            f = evaluate.run_fold(w, tuple(n for n in w.names if n != lot), lot, family, models.PARAMETERS[family])
            for stage, p in f.stages.items():
                for i, k in enumerate(r[0] for r in rows if r[1] == lot):
                    r = by[lot, family, stage, k]
                    assert np.allclose(r["predicted"], p[i], atol=1e-6)
                    facts = json.loads(r["facts"])
                    assert all(facts[n] == pytest.approx(v) for n, v in f.facts.items())
                    assert np.allclose(np.array(r["importance"], float), f.importance, equal_nan=True)


@pytest.mark.parametrize("forward", [False, True])
def test_processes_by_tiles_are_those_of_groups(spark, forward, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(f"2025-01-{lot:02d}_{w:02d}", lot, [lot + w / 4, r.normal(), 1.0, r.normal() + lot], [10 + p + 0.2 * lot + r.normal() for p in range(4)]) for lot in (1, 2, 3, 4) for w in range(9 + lot)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    settings = {"gpr": (gaussian.Settings(2, 1.0, 0.1), gaussian.Settings(3, 3.0, 0.3))}

    def at(group):
        monkeypatch.setattr(models, "GROUP", group)
        monkeypatch.setattr(models, "PART", 6)
        f = models.evaluate_folds(df, ("gpr",), settings, forward=forward).collect()
        return {(x["held_out_lot"], x["lot_number"], x["stage"], x["experiment_key"]): x for x in f}

    groups = at(1000)
    monkeypatch.setattr(tiles, "TILE_BYTES", 5_000)  # several batches
    batches, sizes, each = [], [], tiles._factored
    monkeypatch.setattr(tiles, "_factored", lambda session, some: (batches.append(len(some)), sizes.extend(n for p in some for *_, n in p.train + p.test), each(session, some)))
    by_tiles = at(10)
    assert len(batches) > 2 and max(sizes) < 13  # no tile grows with the fold
    assert groups.keys() == by_tiles.keys() and len(groups) == sum(5 * (9 + n) for n in ((4,) if forward else (1, 2, 3, 4)))
    for k, x in groups.items():
        y = by_tiles[k]
        assert np.allclose(x["predicted"], y["predicted"], atol=1e-8) and x["observed"] == y["observed"]
        assert (x["predicted_std"] is None) == (y["predicted_std"] is None) and np.allclose(x["predicted_std"] or 0, y["predicted_std"] or 0, atol=1e-8)
        a, b = json.loads(x["facts"]), json.loads(y["facts"])
        assert a.keys() == b.keys() and all(b[n] == pytest.approx(v) for n, v in a.items())


def test_an_ascent_ends_where_the_likelihood_is_largest():
    r = np.random.default_rng(3)
    for noise in (0.0, 0.5):  # with none its bound is met
        x = r.normal(size=(80, 3))
        y = np.sin(x @ r.normal(size=(3, 2))) + noise * r.normal(size=(80, 2))
        d, y = gaussian._squares(x, x), (y - y.mean(axis=0)) / y.std(axis=0)
        theta = gaussian._climb(d, y, np.log([1.0, 3.0, 0.05]))
        low, high = np.log(np.array(gaussian.BOUNDS)).T
        best = gaussian._likelihood(d, y, theta)
        assert best > gaussian._likelihood(d, y, np.log([1.0, 3.0, 0.05])) + 1
        assert all(gaussian._likelihood(d, y, np.clip(theta + step * s * e, low, high)) < best + 1e-3 for e in np.eye(3) for s in (1, -1) for step in (0.01, 0.1))
        c, length, n = np.exp(theta)
        k = c * np.exp(-d / (2 * length**2)) + (n + 1e-10) * np.eye(80)
        want = -0.5 * np.trace(y.T @ np.linalg.solve(k, y)) - np.linalg.slogdet(k)[1] - 80 * np.log(2 * np.pi)
        assert best == pytest.approx(want)


def test_fitted_processes_by_tiles_are_those_of_groups(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(f"2025-01-{lot:02d}_{w:02d}", lot, [lot + w / 4, r.normal(), 1.0, r.normal() + lot], [float(10 + p + 0.2 * lot + np.sin(w) + r.normal()) for p in range(4)]) for lot in (1, 2, 3) for w in range(8 + lot)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    settings = {"gpr": (gaussian.Settings(2, 3.0, 0.05, True),)}

    def at(group):
        monkeypatch.setattr(models, "GROUP", group)
        monkeypatch.setattr(models, "PART", 12)
        f = models.evaluate_folds(df, ("gpr",), settings, forward=True, least_lots=2).collect()
        return {(x["held_out_lot"], x["stage"], x["experiment_key"]): x for x in f}

    groups, sizes, each = at(1000), [], tiles._factored
    monkeypatch.setattr(tiles, "_factored", lambda session, some: (sizes.extend(n for p in some for *_, n in p.train + p.test), each(session, some)))
    by_tiles = at(10)
    assert sizes and max(sizes) < 13 and groups and groups.keys() == by_tiles.keys()  # no tile grows with the fold
    for k, x in groups.items():
        y = by_tiles[k]
        assert np.allclose(x["predicted"], y["predicted"], atol=1e-4) and np.allclose(x["predicted_std"] or 0, y["predicted_std"] or 0, atol=1e-4)


def test_the_forward_query_compares_every_family(spark):
    got = queries.QUERIES["chronological_vm"](spark, SF).collect()
    assert {(x["family"], x["scope"]) for x in got} == {(f, s) for f in ("gpr", "pls", "ridge") for s in ("lot", "macro")}
    of = {f: sorted((x["lot_number"] or 0, x["chronological_mae"]) for x in got if x["family"] == f) for f in ("gpr", "pls", "ridge")}
    assert len({str(v) for v in of.values()}) == 3
    assert [s.optimize for s in models.CHRONOLOGICAL["gpr"]] == [True]


def test_facts_unfold(spark):
    f = models.evaluate_folds(spark.createDataFrame(wafers(), SCHEMA), ("pls",)).cache()
    assert f.count() == 15 * 5 and models.points(f).count() == 15 * 5 * 3
    folds = models.folds(f).collect()
    assert len(folds) == 5 and all(x["retained_features"] == 2 and x["training_wafers"] == 12 for x in folds)
    s = models.stability(f, ["a__active_mean", "b__active_std", "c__active_range"])
    assert s.count() == 10 and s.filter("top_20").count() == 10 and {r[0] for r in s.select("feature").distinct().collect()} == {"a__active_mean", "b__active_std"}
    assert f.filter("stage = 'oracle_pca_reconstruction'").count() == 15


def test_fused_spectra(spark):
    rows = spark.createDataFrame(wafers(4), SCHEMA)
    s = rows.select("experiment_key", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i * F.col("x")[0]).alias("spectrum"))
    f = models.fused_spectra(rows, s, candidates=((2, 1.0), (4, 10.0)))
    assert f.select("held_out_lot").distinct().count() == 4 and f.filter("stage = 'full_map'").count() == 12


@pytest.mark.parametrize("values", [40, 2_000_000])
def test_kernels_by_channels_are_the_primal_model(spark, values):
    """More channels than wafers, one of them constant; a few channels a task, or all in one."""
    r = np.random.default_rng(16)
    data = wafers(4, 4)
    s = {k: [float(v) for v in np.r_[r.normal(size=30) + x[0] * np.linspace(0, 1, 30), 5.0]] for k, _, x, _ in data}
    rows, spectra = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(list(s.items()), "experiment_key string, spectrum array<double>")
    candidates = ((2, 1.0), (4, 10.0), (50, 0.1))
    got = {x["experiment_key"]: x for x in models.spectral_shifts(rows, spectra, candidates, values).collect()}
    x, maps, lots = np.array([d[2] for d in data]), np.array([d[3] for d in data]), np.array([d[1] for d in data])
    spec, w = np.array([s[d[0]] for d in data]), evaluate.Wafers(x, maps, lots)
    fused = {(f["stage"], f["experiment_key"]): f for f in models.fused_spectra(rows, spectra, candidates=candidates).collect()} if values > 40 else {}
    for held in (1, 2, 3, 4):
        fold = evaluate.run_fused_fold(w, spec, tuple(n for n in w.names if n != held), held, models.PARAMETERS["pls"], candidates)
        for i, j in enumerate(np.flatnonzero(lots == held)):
            g = got[data[j][0]]
            assert g["setting"] == fold.facts["spectral_setting"] and g["inner_error"] == pytest.approx(fold.facts["spectral_inner_mae"])
            assert g["shift"] == pytest.approx((fold.stages["mean_shift"] - fold.stages["template"])[i, 0])
            for stage in ("template", "mean_shift", "full_map") if fused else ():
                assert np.allclose(fused[stage, data[j][0]]["predicted"], fold.stages[stage][i])
                assert json.loads(fused[stage, data[j][0]]["facts"])["residual_parameter"] == fold.facts["residual_parameter"]


def test_feedback_only_changes_what_comes_later(spark):
    w = wafers(5, 4)
    x, maps, lots = np.array([r[2] for r in w]), np.array([r[3] for r in w]), np.array([r[1] for r in w])
    test = lots == 5
    model = evaluate.Causal.chosen(evaluate.Wafers(x, maps, lots), (1, 2, 3, 4), (1, 2))
    z, targets, measured = x[test], maps[test] + 0.5, np.array([False, True, False, True])
    base, _, n0 = evaluate.replay(model, z, targets, measured, "F0")
    assert n0 == 0
    for f in ("F1", "F2", "F3"):
        p, e, n = evaluate.replay(model, z, targets, measured, f)
        assert n == 2 and np.allclose(p[:2], base[:2]) and not np.allclose(p[2], base[2]) and (e[measured] == 0).all()
    with pytest.raises(ValueError):
        evaluate.replay(model, z, targets, measured, "F9")


def test_feedback_job(spark):
    rows = spark.createDataFrame(wafers(5, 4), SCHEMA)
    picks = rows.select("experiment_key", F.lit(0.5).alias("budget"), (F.substring("experiment_key", -1, 1).cast("int") % 2 == 1).alias("measured"))
    r = models.causal_feedback(rows, picks).collect()
    assert len(r) == 2 * 4 * 4 and {x["feedback"] for x in r} == {"F0", "F1", "F2", "F3"}
    assert all(x["system_error"] == 0 for x in r if x["measured"])


def test_policies_of_earlier_lots(spark):
    from lotwise.plans import analyses

    rows = spark.createDataFrame(wafers(6, 5), SCHEMA)
    out = analyses.causal_policies(rows, budgets=(0.0, 0.4, 1.0), replicates=7, bootstraps=200, without_lot=6)
    lots = out["lots"].collect()
    assert {x["lot_number"] for x in lots} == {4, 5, 6} and {x["mode"] for x in lots} == {"direct_substitution", "ranking_only"}
    assert {x["policy"] for x in lots} == {"no_metrology", "periodic", "ood", "disagreement", "combined", "validated_combined", "oracle", "random"}
    assert all(x["random_replicates"] == (7 if x["policy"] == "random" else 1) for x in lots)
    plain = {x["lot_number"]: x["total_system_mae"] for x in lots if x["policy"] == "no_metrology" and x["budget"] == 0}
    for x in lots:
        if x["policy"] == "no_metrology" or x["budget"] == 0:
            assert x["measured_fraction"] == 0 and x["total_system_mae"] == pytest.approx(plain[x["lot_number"]])
        elif x["budget"] == 1 and x["policy"] != "no_metrology":
            assert x["measured_fraction"] == 1 and x["total_system_mae"] == 0
        else:
            assert x["measured_fraction"] == pytest.approx(0.4)
    best = min(x["total_system_mae"] for x in lots if x["budget"] == 0.4 and x["lot_number"] == 5)
    assert best == pytest.approx(next(x["total_system_mae"] for x in lots if x["budget"] == 0.4 and x["lot_number"] == 5 and x["policy"] == "oracle" and x["mode"] == "ranking_only"))
    assert out["gate"].first()["gate"] in ("PASS", "FAIL") and out["difference"].count() == 3


def test_weights_that_inner_lots_select(spark):
    """Against a search of the whole grid in plain Python, with ties, and with a redundant score left out."""
    from itertools import product

    from lotwise.kernels import policies as kernel
    from lotwise.plans import analyses

    r = np.random.default_rng(14)
    rows = [(held, inner, f"{inner}-{i:02d}", float(r.random()), held == 2, *(float(r.choice([0.1, 0.5, 0.9])) for _ in analyses.SCORES)) for held in (1, 2) for inner in range(3, 8) for i in range(6)]
    names = [f"{n}_percentile" for n in analyses.SCORES]
    df = spark.createDataFrame(rows, "held_out_lot int, lot_number int, experiment_key string, error double, outer_redundant boolean, " + ", ".join(f"{n} double" for n in names))
    for x in analyses.validated_weights(df).collect():
        own = [y for y in rows if y[0] == x["held_out_lot"]]
        free = [i for i, n in enumerate(analyses.SCORES) if not (x["held_out_lot"] == 2 and n == "initial_state")]

        def area(w):
            out = []
            for inner in range(3, 8):
                some = [y for y in own if y[1] == inner]
                p, e = np.array([y[5:] for y in some]), np.array([y[3] for y in some])
                out.append(kernel.areas(e[np.argsort(-np.round(p @ w, 12), kind="stable")][None])[0])
            return np.array(out)

        grid = [np.array([c[free.index(i)] / 4 if i in free else 0.0 for i in range(5)]) for c in product(range(5), repeat=len(free)) if sum(c) == 4]
        equal = area(np.array([1 / len(free) if i in free else 0.0 for i in range(5)]))
        best = min(range(len(grid)), key=lambda i: (area(grid[i]).mean(), i))
        assert x["weights"] == grid[best].tolist() and x["grid_candidates"] == len(grid)
        gain, share = 1 - area(grid[best]).mean() / equal.mean(), (area(grid[best]) <= equal).mean()
        assert x["inner_relative_gain"] == pytest.approx(gain) and x["inner_improved_lot_fraction"] == pytest.approx(share)
        assert x["adoption_rule_passed"] == (gain >= 0.02 and share >= 0.7)


def test_drift_risk_has_all_policies(spark):
    from lotwise.plans import analyses

    out = analyses.drift_risk(spark.createDataFrame(wafers(5, 5), SCHEMA), replicates=50)
    lots = out["lots"].collect()
    assert {x["policy"] for x in lots} == {*analyses.SCORES, "combined", "training_weighted_candidate", "oracle", "periodic", "random"} and len(lots) == 5 * 10
    assert all(x["aurc"] >= next(y["aurc"] for y in lots if y["policy"] == "oracle" and y["lot_number"] == x["lot_number"]) - 1e-9 for x in lots)
    w = out["weights"].collect()
    assert len(w) == 5 and all(sum(x["weights"]) == pytest.approx(1) for x in w)


def test_scores_search_for_nearest_rows_once(spark):
    inputs = written(analyses.risk_inputs(spark.createDataFrame(wafers(), SCHEMA), inner=True), "risk-inputs")
    plan = analyses.risk_scores(inputs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan  # each use of the distances had searched anew


def test_risk_inputs_are_those_of_whole_folds(spark):
    """Moments sent to lots give what a group of all the fold's wafers would."""
    from lotwise.plans import analyses

    rows = wafers(5, 4)
    got = {(x["fold"], x["experiment_key"]): x for x in analyses.risk_inputs(spark.createDataFrame(rows, SCHEMA), forward=True).collect()}
    x, maps, lots = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    assert {f for f, _ in got} == {"4", "5"}
    for held in (4, 5):
        known = lots <= held
        w = evaluate.Wafers(x[known], maps[known], lots[known])
        names = tuple(range(1, held))
        t = w.training(names)
        z = t.standard(x)
        mean, axes, _ = linear.principal_components(z[lots < held], 10)
        c = (z - mean) @ axes.T
        full = {f: evaluate.run_fold(w, names, held, f, models.PARAMETERS[f]).stages["full_map"] for f in ("pls", "ridge")}
        for i, j in enumerate(np.flatnonzero(lots == held)):
            g = got[str(held), rows[j][0]]
            assert not g["is_train"] and g["initial_state"] == pytest.approx(np.linalg.norm(c[j]), abs=1e-7)
            assert g["model_disagreement"] == pytest.approx(np.sqrt(((full["pls"][i] - full["ridge"][i]) ** 2).mean()), abs=1e-7) and g["error"] == pytest.approx(np.abs(full["pls"][i] - maps[j]).mean())
            if i:
                assert g["wafer_delta"] == pytest.approx(np.linalg.norm(c[j] - c[j - 1]), abs=1e-7)
        assert sum(f == str(held) for f, _ in got) == known.sum()


def test_feedback_crossed_with_policies(spark):
    """A stream's errors are those of the job of one selection; no feedback is what no learning gives."""
    rows = spark.createDataFrame(wafers(5, 4), SCHEMA)
    scores = rows.select("experiment_key", (F.substring("experiment_key", -1, 1).cast("double") / 4).alias("combined"))
    s = models.feedback_streams(rows, scores, ("combined",), (0.0, 0.5), 2).collect()
    assert {(x["policy"], x["replicate"]) for x in s} == {("no_metrology", 0), ("periodic", 0), ("combined", 0), ("random", 0), ("random", 1)} and len(s) == 2 * 5 * 2 * 4
    picks = risk.causal_selection(rows.join(scores, "experiment_key").select("experiment_key", "lot_number", "combined", (F.substring("experiment_key", -1, 1).cast("int") + 1).alias("wafer_order")), (0.5,), score="combined")
    one = models.causal_feedback(rows, picks.select("experiment_key", "budget", "measured")).groupBy("test_lot", "feedback").agg(F.avg("system_error").alias("e"), F.max("updates").alias("u")).collect()
    for x in one:
        y = next(y for y in s if y["policy"] == "combined" and y["budget"] == 0.5 and (y["lot_number"], y["feedback"]) == (x["test_lot"], x["feedback"]))
        assert y["total_system_mae"] == pytest.approx(x["e"]) and y["updates"] == x["u"]
    gain = models.feedback_gain(models.feedback_streams(rows, scores, ("combined",), (0.0, 0.5), 1)).collect()
    assert all(x["relative_gain"] == pytest.approx(0) for x in gain if x["feedback"] == "F0" or x["policy"] == "no_metrology" or x["budget"] == 0)


def test_selected_lots_and_flags(spark):
    from lotwise.operators import metrics, validate

    rows = spark.createDataFrame(wafers(3, 2), SCHEMA)
    assert models.selected_lots(rows, (1, 3)).count() == 4
    with pytest.raises(ValueError, match="9"):
        models.selected_lots(rows, (1, 9))
    models.require_features(rows, {"process": rows})
    with pytest.raises(ValueError, match="oes=.*2025-01-01_00"):
        models.require_features(rows, {"process": rows, "oes": rows.filter("lot_number > 1")})
    audit = spark.createDataFrame([("a",), ("b",), (None,)], "experiment_key string")
    flags = {r[0]: r[1] for r in validate.with_target_flag(audit, spark.createDataFrame([("a",), ("a",), (None,)], "experiment_key string")).collect()}
    assert flags == {"a": True, "b": False, None: False}
    p = spark.createDataFrame([("s", "w", 1.0, 2.0), ("s", "w", 3.0, 3.0), ("s", "v", 0.0, 5.0), ("s", "v", 2.0, 7.0)], "ablation string, experiment_key string, observed double, predicted double")
    x = metrics.residual_profiles(p).first()
    assert (x["wafers"], x["residual_profile_mae"], x["residual_profile_rmse"]) == (2, 0.25, 0.25)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(lot, i + 1, f"{lot}-{i:02d}", float(r.random()), float(r.normal()), float(r.random())) for lot in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "lot_number int, wafer_order int, experiment_key string, score double, shift double, error double")
    batch = risk.bias_feedback(risk.causal_selection(df, (0.2, 0.5)), 0.3)
    want = {(x["lot_number"], x["budget"], x["wafer_order"]): (x["measured"], round(x["bias"], 9)) for x in batch.collect()}
    src = str(tmp_path / "in")
    wide = df.withColumns({"budget": F.explode(F.array(F.lit(0.2), F.lit(0.5))), "lot_size": F.lit(9)}).withColumn("threshold", 1 - F.col("budget"))
    for lo, hi in ((1, 4), (5, 9)):
        wide.filter(F.col("wafer_order").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
        replay.run_available(spark.readStream.schema(wide.schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(x["lot_number"], x["budget"], x["wafer_order"]): (x["measured"], round(x["bias"], 9)) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


@pytest.mark.parametrize("splits", [[(1, 6)], [(1, 2), (2, 4), (5, 6)]])
def test_feedback_stream_is_the_batch_replay(spark, tmp_path, splits):
    """F0 to F3 over splits with repeated rows; a later lot closes the first one and its state."""
    from lotwise.streaming import feedback

    data = wafers(5, 6)
    rows = spark.createDataFrame(data, SCHEMA)
    made, _ = models.causal_models(rows, (1, 2))
    cells = F.explode(F.array(*[F.struct(F.lit(0.5).alias("budget"), F.lit(f).alias("feedback")) for f in models.FEEDBACKS]))
    made = made.withColumn("c", cells).select("test_lot", "c.*", "model")
    made.write.parquet(str(tmp_path / "models"))
    order = (F.substring("experiment_key", -2, 2).cast("int") + 1).alias("wafer_order")
    wide = rows.filter("lot_number >= 4").withColumn("c", cells).select("lot_number", "c.*", order, "experiment_key", F.lit(6).alias("lot_size"), F.lit(0.6).alias("score"), F.lit(0.5).alias("threshold"), "x", "map")
    wide = wide.withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("wafer_order") * 60 + (F.col("lot_number") - 4) * 100_000))
    parts = [wide.filter((F.col("lot_number") == 4) & F.col("wafer_order").between(*s)) for s in splits] + [wide.filter("lot_number = 5"), wide.filter("lot_number = 5 and wafer_order = 6")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feedback.run_available(spark.readStream.schema(wide.schema).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "models")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    picks = wide.filter("feedback = 'F0'").select("experiment_key", "lot_number", "wafer_order", F.lit(0.6).alias("score"))
    want = models.causal_feedback(rows, risk.causal_selection(picks, (0.5,)).select("experiment_key", "budget", "measured"), parameters=(1, 2)).collect()
    assert len(want) == 2 * 4 * 6 and len([x for x in got if not x["closed"]]) == len(want)
    by = {(x["feedback"], x["experiment_key"]): x for x in got if not x["closed"]}
    for x in want:
        y = by[x["feedback"], x["experiment_key"]]
        assert y["measured"] == x["measured"] and y["system_error"] == pytest.approx(x["system_error"])
    closed = [x for x in got if x["closed"]]
    assert {(x["lot_number"], x["feedback"]) for x in closed} == {(4, f) for f in models.FEEDBACKS} and all(x["wafer_order"] == 6 for x in closed)
    for x in closed:
        assert x["system_error"] == pytest.approx(np.mean([y["system_error"] for y in want if y["test_lot"] == 4 and y["feedback"] == x["feedback"]]))


def test_manifest(tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("x")
    args = dict(analysis="t", input_files=[f], config={}, random_seed=1, split_identifiers=[1], runtime_seconds=0.1, result_files=[f], claim_boundaries=[], gate="PASS")
    m = manifest.build_manifest(**args)
    assert m["inputs"][str(f)]["bytes"] == 1 and json.dumps(m)
    with pytest.raises(ValueError):
        manifest.build_manifest(**args | {"gate": "GREAT"})
    with pytest.raises(FileNotFoundError):
        manifest.build_manifest(**args | {"result_files": [tmp_path / "none"]})
    assert manifest.package_versions(["no-such-package"]) == {"no-such-package": "not-installed"}


def test_file_hashes(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("x")
    r = manifest.file_hashes(spark, str(f)).first()
    assert r["sha256"] == manifest.file_hash(f) and r["md5"] == manifest.file_hash(f, "md5")


def test_steps_are_reused_until_something_changes(spark, tmp_path):
    def one(spark, ctx):
        return {"t": spark.range(ctx["config"]["n"])}

    steps = lambda n: [manifest.Step("one", one, {"n": n})]
    run = lambda n, **k: manifest.run_steps(spark, steps(n), str(tmp_path), k.pop("inputs", {"a": "1"}), **k)["one"]["status"]
    assert [run(3), run(3), run(4), run(3, inputs={"a": "2"}), run(3, force=True)] == ["RAN", "REUSED", "RAN", "RAN", "RAN"]
    table = next((tmp_path / "one").glob("*/t"))
    for p in (tmp_path / "one").glob("*/t"):
        spark.range(99).write.mode("overwrite").parquet(str(p))
    assert table.exists() and run(4) == "RAN" and run(4) == "REUSED"
    assert not list(tmp_path.glob("_aside-*"))


def test_steps_on_a_path_that_only_spark_opens(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.steps.link./at", f"file://{tmp_path}")

    def one(spark, ctx):
        return {"t": spark.range(ctx["config"]["n"])}

    def two(spark, ctx):
        return {"u": ctx["t"].selectExpr("sum(id) AS s")}

    steps = [manifest.Step("one", one, {"n": 5}), manifest.Step("two", two, needs=("one",))]
    run = lambda: {k: v["status"] for k, v in manifest.run_steps(spark, steps, "viewfs://steps/at/out", {"a": "1"}).items()}
    assert run() == {"one": "RAN", "two": "RAN"} and run() == {"one": "REUSED", "two": "REUSED"}


def test_digests(spark, tmp_path):
    from lotwise.plans import store

    df = spark.range(1000).selectExpr("id", "id % 7 AS a", "IF(id % 3 = 0, NULL, array(id)) AS b", "CAST(id AS STRING) AS c")
    d = store.digest(df)
    assert d == store.digest(df.repartition(7).orderBy("c")) and d != store.digest(df.unionByName(df.limit(1))) and d != store.digest(df.withColumnRenamed("c", "x")) and d != store.digest(df.limit(999))
    data = np.random.default_rng(15).bytes(300_000)
    (tmp_path / "a.bin").write_bytes(data)
    import hashlib

    got = {r["path"].rsplit("/", 1)[1]: r for r in store.file_hashes(spark, str(tmp_path)).collect()}
    assert got["a.bin"]["sha256"] == hashlib.sha256(data).hexdigest() and got["a.bin"]["md5"] == hashlib.md5(data).hexdigest()
    trees = {r["path"].rsplit("/", 1)[1]: r for r in store.tree_hashes(spark, str(tmp_path), part=65_536).collect()}
    parts = [hashlib.sha256(data[i : i + 65_536]).hexdigest() for i in range(0, len(data), 65_536)]
    assert trees["a.bin"]["parts"] == 5 and trees["a.bin"]["root"] == hashlib.sha256("".join(parts).encode()).hexdigest()


def test_claims_are_recomputed_from_artifacts(spark):
    t = spark.createDataFrame([("pls", 0.5, 2), ("pls", 0.7, 3), ("gpr", 0.9, 4)], "family string, mae double, n int")
    claims = {"pls_mae": ("wafers", "avg(mae)", "number", "family = 'pls'"), "rows": ("wafers", "count(*)", "count", ""), "share": ("wafers", "avg(CAST(n > 2 AS DOUBLE))", "percent", ""), "none": ("wafers", "avg(mae)", "number", "family = 'x'")}
    got = {r["claim_id"]: r["status"] for r in manifest.audit_claims(manifest.recomputed(claims, {"wafers": t}), "0.6000 of 3 rows, 66.6667%").collect()}
    assert got == {"pls_mae": "PASS", "rows": "PASS", "share": "PASS", "none": "FAIL"}
    with pytest.raises(ValueError, match="gone"):
        manifest.recomputed({"x": ("gone", "count(*)", "count", "")}, {"wafers": t})


def test_claims(spark):
    c = spark.createDataFrame([("a", 0.5), ("b", float("nan")), ("c", 0.123456)], "claim_id string, value double").withColumn("display", manifest.display(F.col("value")))
    got = {r["claim_id"]: r["status"] for r in manifest.audit_claims(c, "values 0.5000 and NaN and 0.1236").collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "FAIL"}
    assert manifest.markdown_table(c.limit(1)).splitlines()[2] == "| a | 0.5000 | 0.5000 |"


def test_gates():
    assert pipeline.risk_gate(0.0928, 8) == "FAIL" and pipeline.risk_gate(0.12, 7) == "PASS"
    assert not pipeline.retain_gate(0.04, 4) and pipeline.retain_gate(0.05, 3)
    assert pipeline.policy_gate(2, 2, 0.7, 2, 0.1)[0] == "PASS" and pipeline.policy_gate(2, 1, 0.7, 2, 0.1)[0] == "FAIL"


def test_every_step_runs_and_is_reused(spark, tmp_path):
    from lotwise.plans import cli
    from tests.conftest import SF

    out = str(tmp_path / "out")
    some = ["data_audit", "detector_selection", "feature_stability", "lot_failure", "spectral_pilot", "feedback_policies", "feature_ablation"]
    assert cli.main([*some, "--data", SF, "--output", out]) == 0
    report = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert {"features", "process_baseline", "metrics", *some} == set(report) and {x["status"] for x in report.values()} == {"RAN"}
    for x in report.values():
        for table in x["tables"].values():
            assert spark.read.parquet(table).count() > 0, table
    assert cli.main(["lot_failure", "data_audit", "--data", SF, "--output", out]) == 0
    assert {x["status"] for x in json.loads((tmp_path / "out" / "summary.json").read_text()).values()} == {"REUSED"}


def test_inputs_of_models_are_gone_through_once(spark):
    """Fits and scores read the features and maps that were written, not the traces again."""
    from lotwise.queries import models as queried
    from tests.conftest import SF

    files = queried.rows(spark, SF).inputFiles()
    assert files and not any(f.endswith(("events.parquet", "lineitem.parquet")) for f in files)


def test_quota_by_ranges_and_streams_of_long_lots(spark, monkeypatch):
    """Decisions don't depend on how many wafers and streams are looked at together, and a long lot doesn't narrow the streams that step together."""
    from lotwise.kernels import policies as kernel
    from lotwise.operators import replay as grid

    r = np.random.default_rng(2)
    scores, b = r.random((6, 50)), np.array([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
    want, looked = kernel.quota(scores, b, 1 - b), []
    monkeypatch.setattr(kernel, "CELLS", 42)
    assert (kernel.quota(scores, b, 1 - b) == want).all()
    assert (kernel.quota_by_ranges(lambda lo, hi: looked.append(hi - lo) or scores[:, lo:hi], 50, b, 1 - b) == want).all() and max(looked) == 7
    df = spark.createDataFrame([(1, i + 1, f"w{i:02d}", float(i % 7), 0.5) for i in range(50)], "lot_number int, wafer_order int, experiment_key string, true_error double, combined double")
    rows = grid.streams(df, ["combined"], (0.1, 0.5), 40)
    drawn = rows.filter("policy = 'random'").groupBy("budget").agg(F.count("*").alias("n"), F.countDistinct("replicate").alias("r"), F.avg("measured_fraction").alias("m")).collect()
    assert {(x["budget"], x["n"], x["r"]) for x in drawn} == {(0.1, 40, 40), (0.5, 40, 40)} and all(x["m"] == pytest.approx(x["budget"]) for x in drawn)
    assert rows.filter("policy = 'random'").select(F.spark_partition_id()).distinct().count() > 1


def test_feedback_refits_what_has_learnt(spark, monkeypatch):
    """F2 refits the shift alone, and the streams of a lot and feedback are dealt over groups."""
    w = wafers(5, 6)
    x, maps, lots = np.array([r[2] for r in w]), np.array([r[3] for r in w]), np.array([r[1] for r in w])
    model, test = evaluate.Causal.chosen(evaluate.Wafers(x, maps, lots), (1, 2, 3, 4), (1, 2)), lots == 5
    fits, plain = [], linear.partial_least_squares
    monkeypatch.setattr(linear, "partial_least_squares", lambda *a: fits.append(1) or plain(*a))
    evaluate.replay(model, x[test], maps[test], np.array([True, False, True, True, False, False]), "F2")
    assert len(fits) == 5  # of the shift at first and after each of three wafers, of the residual once
    rows = spark.createDataFrame(w, SCHEMA)
    scores = rows.select("experiment_key", F.lit(0.5).alias("combined"))
    s = models.feedback_streams(rows, scores, ("combined",), (0.2, 0.5), 12)
    assert s.count() == 2 * 4 * 2 * 15 and s.select("lot_number", "feedback", "policy", "replicate", "budget").distinct().count() == s.count()
    assert "part" in s._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInPandas")[1].split("\n")[0]
