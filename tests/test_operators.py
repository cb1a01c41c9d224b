"""Exact small values and leakage tests of the operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import stats
from lotwise.operators import asof, conformal, features, metrics, resample, risk, segment, template, validate
from lotwise.sources.shared import shared_dir

SECONDS = segment.TraceSpec()


def trace(spark, cycles=4, key="w"):
    """Power on for the cycles; in each of 6 s the long gas flows 4.5 s, then the short one; ``drift`` rises."""
    rows = []
    end = 3 + 6 * cycles
    for i in range(int(round((end + 3) / 0.2)) + 1):
        t = round(0.2 * i, 10)
        on = 3 <= t < end
        place = (t - 3) % 6
        rows.append((key, 1, t, 100.0 if on else 0.0, 600.0 if on and place < 4.5 - 1e-9 else 0.0, 300.0 if on and place >= 4.5 - 1e-9 else 0.0, 2 * t))
    return spark.createDataFrame(rows, "experiment_key string, lot_number int, t double, rf double, gas_long double, gas_short double, drift double")


@pytest.mark.parametrize("detector", segment.DETECTORS)
@pytest.mark.parametrize("cycles", [4, 7])
def test_cycles_of_a_synthetic_trace(spark, detector, cycles):
    r = segment.detect_regions(trace(spark, cycles), detector)
    segment.require_cycles(r)
    x = r.agg(F.first("cycle_count"), F.min(F.when(F.col("active"), F.col("t"))), F.max(F.when(F.col("active"), F.col("t"))), F.max("cycle_index")).first()
    assert x[0] == cycles and x[1] == pytest.approx(3.0) and x[2] == pytest.approx(2.8 + 6 * cycles) and x[3] == cycles - 1
    d = segment.cycle_diagnostics(trace(spark, cycles), detector).first()
    assert d["phase_overlap_samples"] == 0 and d["uncovered_active_samples"] == 0 and d["cycle_index_monotonic"] and d["first_edge_inside_active"]


def test_features_of_a_rising_signal(spark):
    f = {r["feature"]: r["value"] for r in features.trace_features(segment.detect_regions(trace(spark)), ["drift", "gas_long"]).collect()}
    assert f["drift__active_slope"] == pytest.approx(2 * 23.8) and f["drift__early_late_delta"] > 0 and f["drift__cycle_mean_slope"] > 0
    assert f["gas_long__long_phase_mean"] == 600 and f["gas_long__short_phase_mean"] == 0 and f["gas_long__phase_difference"] == 600
    assert len(f) == 20


def test_trace_checks(spark):
    t = trace(spark)
    validate.validate_traces(t, ["rf"])
    with pytest.raises(ValueError, match="missing"):
        validate.validate_traces(t, ["nothing"])
    with pytest.raises(ValueError, match="strictly increasing"):
        validate.validate_traces(t.unionByName(t.limit(1)), ["rf"])
    with pytest.raises(ValueError, match="fewer than two"):
        segment.require_cycles(segment.detect_regions(t.withColumn("gas_long", F.lit(1.0)), "quantile"))
    with pytest.raises(ValueError, match="unknown"):
        segment.detect_regions(t, "other")


def test_debounce_keeps_distance_from_the_last_kept(spark):
    df = spark.createDataFrame([([1.0, 3.0, 4.5, 7.0, 7.1, 10.0],)], "e array<double>")
    assert df.select(segment.debounced(F.col("e"), 3.0)).first()[0] == [1.0, 4.5, 10.0]


def dense(spark, bump=0.0):
    rows = [(f"2025-01-0{lot}_{w:02d}", lot, float(x), 0.0, base + shift + (bump if lot == 1 else 0.0)) for lot, shift in ((1, 1.0), (2, -1.0), (3, 0.5)) for w in (1, 2) for x, base in ((-1, 10.0), (1, 20.0))]
    return spark.createDataFrame(rows, "experiment_key string, lot_number int, x double, y double, stepheight double")


def test_template_of_shifted_lots(spark):
    d = template.decompose(template.with_targets(dense(spark), ["stepheight"]))
    assert d.count() == 12 and d.filter("abs(residual) > 1e-9").count() == 0
    template.require_coverage(d)
    s = template.decomposition_summary(d.withColumn("postox_value_was_filled", F.lit(False)), 0.8).first()
    assert s["template_dominant"] and s["true_mean_shift_oracle_r2"] == pytest.approx(1.0)


def test_template_does_not_see_the_held_out_lot(spark):
    at = lambda b: sorted(map(tuple, template.decompose(template.with_targets(dense(spark, b), ["stepheight"])).filter("lot_number = 1").select("experiment_key", "x", "template_prediction", "global_prediction").collect()))
    assert at(0.0) == at(1000.0)


def test_uncovered_coordinate(spark):
    d = dense(spark).withColumn("x", F.when((F.col("lot_number") == 2) & (F.col("x") > 0), 9.0).otherwise(F.col("x")))
    with pytest.raises(ValueError, match="lot 2"):
        template.require_coverage(template.decompose(template.with_targets(d, ["stepheight"])))


def test_dense_checks(spark):
    d = dense(spark)
    validate.validate_dense(d, ["stepheight"])
    for bad, what in ((d.limit(0), "empty"), (d.unionByName(d.limit(1)), "duplicate"), (d.withColumn("stepheight", F.when(F.col("x") > 0, F.col("stepheight"))), "non-finite"), (d.withColumn("lot_number", F.lit(None).cast("int")), "null"), (d.filter("not (experiment_key = '2025-01-01_01' and x = 1)"), "different coordinate")):
        with pytest.raises(ValueError, match=what):
            validate.validate_dense(bad, ["stepheight"])
    with pytest.raises(ValueError, match="missing columns"):
        validate.validate_dense(d, ["other"])


def test_zones(spark):
    z = template.coordinate_zones(spark.createDataFrame([(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)], "x double, y double")).orderBy("x").collect()
    assert [r["zone"] for r in z] == ["center", "middle", "edge"]


def test_change_scores(spark):
    rows = [("a", 1, [10.0], [11.0]), ("b", 1, [12.0], [11.0]), ("c", 1, [13.0], [11.0]), ("d", 2, [5.0], [11.0])]
    df = spark.createDataFrame(rows, "experiment_key string, lot_number int, x array<double>, centroid array<double>")
    got = {a: {r["experiment_key"]: r for r in risk.change_scores(df, a).collect()} for a in (0.1, 0.5)}
    assert [got[0.1][k]["initial_state"] for k in "abc"] == [1, 1, 2]
    assert [got[0.1][k]["wafer_delta"] for k in "abc"] == [None, 2, 1] and got[0.1]["d"]["ewma_distance"] is None
    assert got[0.1]["c"]["ewma_distance"] == pytest.approx(2.8) and got[0.5]["c"]["ewma_distance"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        risk.change_scores(df, 0.0)


def test_quota(spark):
    df = spark.createDataFrame([([0.95, 0.10, 0.90, 0.20, 0.80],)], "s array<double>")
    assert df.select(risk.quota_decisions(F.col("s"), 0.4, 0.6)).first()[0] == [True, False, True, False, False]


@pytest.mark.parametrize("seed", range(3))
def test_quota_is_always_met(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(i, r.random(int(r.integers(1, 30))).tolist(), float(b)) for i in range(20) for b in (0, 0.1, 0.3, 0.5, 1)]
    df = spark.createDataFrame(rows, "i int, s array<double>, b double")
    got = df.select("s", "b", risk.quota_decisions(F.col("s"), F.col("b"), 0.7).alias("m")).collect()
    assert all(sum(x["m"]) == min(round(x["b"] * len(x["s"])), len(x["s"])) for x in got)


def test_aurc_and_curves_against_numpy(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for lot in range(4):
        n = int(r.integers(2, 12))
        e, s = r.random(n), np.round(r.random(n), 1)
        rows += [(lot, i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(e, s))]
        order = np.argsort(-s, kind="stable")
        risks = np.array([np.delete(e, order[:k]).mean() for k in range(n)])
        cover = np.arange(n, 0, -1) / n
        want[lot] = np.trapezoid(risks[::-1], cover[::-1]) / (1 - 1 / n)
    df = spark.createDataFrame(rows, "lot_number int, wafer_order int, error double, score double")
    got = {x["lot_number"]: x["aurc"] for x in risk.aurc(df).collect()}
    assert got == pytest.approx(want)
    zero = risk.policy_curve(df, (0.0,)).collect()
    assert all(x["selected_wafers"] == 0 for x in zero)


def test_empirical_percentile(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    own = spark.createDataFrame([("a", 2.0), ("b", 0.0), ("c", None), ("d", 9.0)], "k string, v double")
    got = {r["k"]: r["percentile"] for r in risk.empirical_percentile(own, ref, "v").collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.5, "d": 1.0}


def test_conformal_rank(spark):
    b = conformal.bounds(spark.range(10).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("s")), ["g"], "s", (0.95,)).first()
    assert (b["bound"], b["rank"], b["attainable"]) == (9.0, 10, False) and b["resolution"] == pytest.approx(1 / 11)
    with pytest.raises(ValueError):
        conformal.bounds(spark.range(1), ["id"], "id", (1.0,))


def test_nearest_takes_the_earlier_of_two(spark):
    ref = spark.createDataFrame([("a", 0.0, 1), ("a", 2.0, 2), ("a", 4.0, 3)], "k string, t double, v int")
    own = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.5), ("a", -1.0), ("a", 9.0), ("b", 0.0)], "k string, t double")
    got = {(r["k"], r["t"]): (r["ref_v"]) for r in asof.asof_nearest(own, ref, "k", "t", ["v"]).collect()}
    assert got == {("a", 1.0): 1, ("a", 2.0): 2, ("a", 3.5): 3, ("a", -1.0): 1, ("a", 9.0): 3, ("b", 0.0): None}
    back = {r["t"]: r["ref_v"] for r in asof.asof_backward(own.filter("k = 'a'"), ref, "k", "t", ["v"]).collect()}
    assert back == {1.0: 1, 2.0: 2, 3.5: 2, -1.0: None, 9.0: 3}


def test_splits(spark):
    lots = spark.createDataFrame([(lot,) for lot in range(1, 7) for _ in range(2)], "lot_number int")
    e = resample.expanding_window(lots, 3)
    assert sorted(r[0] for r in e.select("test_lot").distinct().collect()) == [4, 5, 6]
    assert e.filter("is_train and lot_number >= test_lot").count() == 0
    assert resample.nested_folds(lots).count() == 30
    assert resample.leave_one_out(lots).filter("is_train").count() == 60


def test_bootstrap_is_the_same_each_time(spark):
    lots = spark.createDataFrame([(i, float(i)) for i in range(5)], "lot_number int, v double")
    at = lambda p: sorted(map(tuple, resample.cluster_bootstrap(lots.repartition(p), 7, 50, "v").collect()))
    assert at(1) == at(3) and len(at(1)) == 50


def test_rank_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 5.0), ("a", None, 1.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: (r["n"], r["spearman"]) for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert got["a"] == (3, pytest.approx(0.8660254)) and got["b"] == (1, None)


def test_pivots_and_joins_that_must_be_unique(spark):
    df = spark.createDataFrame([("a", "f", 1.0), ("a", "f", 2.0)], "k string, f string, v double")
    with pytest.raises(ValueError, match="duplicate"):
        stats.strict_pivot(df, ["k"], "f", "v", ["f"])
    with pytest.raises(ValueError, match="left keys"):
        stats.validated_join(df, df.limit(1), ["k"])
    assert stats.validated_join(df, df.limit(1).select("k"), ["k"], validate="many_to_one").count() == 2


def test_keys_and_groups(spark):
    df = spark.createDataFrame([("Day_2024_01_02_Wafer_03",), ("Day_2024_01_02_Wafer_03x",)], "name string")
    got = [r["experiment_key"] for r in validate.parsed_keys(df, "name").orderBy("name").collect()]
    assert got == ["2024-01-02_03", None]
    with pytest.raises(ValueError, match="unexpected"):
        validate.require_parsed(validate.parsed_keys(df, "name"), "name")
    s = spark.createDataFrame([("/x/Day_2024_01_02.nc", "Wafer_07")], "p string, g string")
    assert validate.spectral_keys(s, "p", "g").first()["experiment_key"] == "2024-01-02_07"
    f = spark.createDataFrame([("Chamber_Pressure__active_mean",), ("HeliumBPFlow__cycle_mean_std",), ("X__active_slope",), ("DCBias__phase_difference",)], "feature string")
    assert [r[0] for r in f.select(features.sensor_family(F.col("feature"))).collect()] == ["pressure", "gas_or_backside_flow", "remaining_process_signals", "rf_power_matching_electrical"]


def test_decode(spark):
    codes = spark.createDataFrame([(0,), (1,), (7,)], "code int")
    d = validate.decode(codes, spark.createDataFrame([(0, 0.5), (1, float("nan"))], "code int, value double"))
    assert tuple(validate.decode_violations(d).first()) == (3, 1, 1)
    with pytest.raises(Exception):
        spark.createDataFrame([([5],)], "c array<int>").select(validate.decode_array(F.col("c"), F.array(F.lit(1.0)))).collect()


def test_best_lots(spark):
    rows = [("pls", lot, 1.0) for lot in (1, 2, 3)] + [("gpr", lot, 2.0) for lot in (1, 2, 3)]
    got = {r["family"]: r["best_lots"] for r in metrics.best_lot_counts(spark.createDataFrame(rows, "family string, lot_number int, mae double")).collect()}
    assert got == {"pls": 3, "gpr": 0}


def lot_errors(spark, sizes):
    r = np.random.default_rng(8)
    rows = [(lot, i + 1, float(e)) for lot, n in enumerate(sizes) for i, e in enumerate(r.gamma(2, 1, n))]
    return rows, spark.createDataFrame(rows, "lot_number int, wafer_order int, error double")


def area(v):
    risk = [sum(v[i:]) / len(v[i:]) for i in range(len(v))]
    return risk[0] if len(v) == 1 else sum((a + b) / 2 for a, b in zip(risk, risk[1:])) / (len(v) - 1)


def test_every_order_of_small_lots(spark):
    from itertools import permutations

    rows, df = lot_errors(spark, [1, 3, 6, 9])
    got = risk.every_order(df).groupBy("lot_number").agg(F.sort_array(F.collect_list("aurc")).alias("a")).collect()
    assert {x["lot_number"] for x in got} == {0, 1, 2}
    for x in got:
        assert np.allclose(x["a"], sorted(area(p) for p in permutations([e for lot, _, e in rows if lot == x["lot_number"]])))
    assert risk.every_order(df.filter("lot_number = 3")).count() == 0


def test_random_policy_is_the_mean_of_all_orders(spark):
    from itertools import permutations

    rows, df = lot_errors(spark, [1, 5, 40])
    for x in risk.random_policy(df, 20_000, 3, (0.0, 0.4)).collect():
        e = [v for lot, _, v in rows if lot == x["lot_number"]]
        assert x["aurc"] == pytest.approx(np.mean(e), rel=0.02) and x["random_p025"] <= x["aurc"] + 1e-9 and x["aurc"] <= x["random_p975"] + 1e-9
        assert x["budgets"][0]["retained_mae"] == pytest.approx(np.mean(e)) and x["budgets"][1]["retained_mae"] == pytest.approx(np.mean(e), rel=0.02)
        if len(e) == 5:
            low, high = np.quantile([area(p) for p in permutations(e)], (0.025, 0.975))
            assert x["random_p025"] == pytest.approx(low, rel=0.03) and x["random_p975"] == pytest.approx(high, rel=0.03)


def test_periodic_area_by_lookup(spark):
    rows, df = lot_errors(spark, [1, 2, 3, 17, 50])
    for x in risk.periodic_aurc(df).collect():
        e = np.array([v for lot, _, v in rows if lot == x["lot_number"]])
        n, kept = len(e), []
        for k in range(n):
            at = {int(np.rint(i * (n - 1) / max(k - 1, 1))) for i in range(k)}
            kept.append(np.delete(e, sorted(at)).mean())
        want = kept[0] if n == 1 else sum((a + b) / 2 for a, b in zip(kept, kept[1:])) / (n - 1)
        assert x["aurc"] == pytest.approx(want)


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_training_rows(spark, block):
    r = np.random.default_rng(9)
    rows = [(f, f"w{i}", [float(v) for v in r.normal(size=3)], bool(i % 3)) for f in (1, 2) for i in range(20)] + [(3, "alone", [0.0, 0.0, 0.0], True)]
    got = risk.nearest_training_distance(spark.createDataFrame(rows, "held_out_lot int, experiment_key string, x array<double>, is_train boolean"), block=block).collect()
    want = {(f, k): min(np.linalg.norm(np.subtract(x, y)) for g, j, y, t in rows if g == f and j != k and t) for f, k, x, _ in rows if f < 3}
    assert {(a["held_out_lot"], a["experiment_key"]) for a in got} == set(want)
    assert all(a["ood_distance"] == pytest.approx(want[a["held_out_lot"], a["experiment_key"]]) for a in got)


@pytest.mark.parametrize("hot", [False, True])
def test_rings_rule_out_most_rows(spark, hot):
    """On clustered rows less than a tenth of all pairs is looked at; if a third of the rows is one cluster, little more."""
    block = 16
    r = np.random.default_rng(10)
    centres = r.normal(size=(30, 4)) * 40
    rows = [(f, f"w{i}", (centres[0 if hot and i % 3 == 0 else r.integers(30)] + r.normal(size=4)).tolist(), bool(i % 5)) for f in (1, 2) for i in range(900)]
    got = risk.nearest_search(spark.createDataFrame(rows, "held_out_lot int, experiment_key string, x array<double>, is_train boolean"), block=block).collect()
    for f in (1, 2):
        own = [x for x in rows if x[0] == f]
        train = np.array([x[2] for x in own if x[3]])
        names = [x[1] for x in own if x[3]]
        for x in (x for x in got if x["held_out_lot"] == f):
            v = next(y[2] for y in own if y[1] == x["experiment_key"])
            d = np.linalg.norm(train - v, axis=1)
            assert x["ood_distance"] == pytest.approx(min(z for z, n in zip(d, names) if n != x["experiment_key"]))
    assert len(got) == 1800 and sum(x["compared"] for x in got) < (0.15 if hot else 0.1) * 1800 * 720


def test_rows_are_not_copied_for_the_rings_that_they_ask(spark):
    """On rows without clusters every row asks for most rings; what is shuffled and written for them stays a few times the rows."""
    r = np.random.default_rng(11)
    rows = [(f, f"w{i}", r.normal(size=8).tolist(), bool(i % 5)) for f in (1, 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "held_out_lot int, experiment_key string, x array<double>, is_train boolean").repartition(4).cache()
    df.count()
    shared = shared_dir(spark).removeprefix("file://")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def used() -> int:
        files = disk.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size())) + sum(os.lstat(f"{d}/{f}").st_size for d, _, names in os.walk(shared) for f in names)

    before = used()
    got = risk.nearest_search(df, block=64).collect()
    assert used() - before < 12 * 6000 * 8 * 8  # 40 times the vectors when rows were sent to rings
    assert len(got) == 6000 and sum(x["compared"] for x in got) > 20 * 64 * 6000
    x, train = np.array([v for f, _, v, _ in rows if f == 1]), np.array([t for f, *_, t in rows if f == 1])
    for g in (g for g in got if g["held_out_lot"] == 1):
        i = int(g["experiment_key"][1:])
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert g["ood_distance"] == pytest.approx(d[train & (np.arange(3000) != i)].min(), rel=1e-13)


def test_scans_in_blocks_are_the_folds(spark):
    """Blocks of a few rows, several lots, against the fold of a whole array and plain loops."""
    r = np.random.default_rng(12)
    rows = [(lot, i + 1, f"{lot}-{i:04d}", float(r.choice([0.1, 0.5, 0.9, r.random()])), float(r.normal()), [float(v) for v in r.normal(size=2)], [0.5, -1.0]) for lot, n in ((1, 1), (2, 7), (3, 8), (4, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "lot_number int, wafer_order int, experiment_key string, score double, shift double, x array<double>, centroid array<double>")
    budgets = (0.0, 0.1, 0.3, 0.5, 1.0)
    got = risk.causal_selection(df, budgets, block=4).cache()
    fold = df.groupBy("lot_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("wafer_order", "score"))), lambda s: s["score"]).alias("s")).withColumn("b", F.explode(F.array(*map(F.lit, budgets))))
    want = {(x["lot_number"], x["b"]): x["m"] for x in fold.select("lot_number", "b", risk.quota_decisions(F.col("s"), F.col("b"), 1 - F.col("b")).alias("m")).collect()}
    for x in got.collect():
        assert x["measured"] == want[x["lot_number"], x["budget"]][x["wafer_order"] - 1]
    bias = {(x["lot_number"], x["budget"], x["wafer_order"]): x for x in risk.bias_feedback(got, 0.3, block=4).collect()}
    for lot, b in want:
        now = 0.0
        for i, m in enumerate(want[lot, b]):
            x = bias[lot, b, i + 1]
            assert x["bias"] == pytest.approx(now)
            now = 0.3 * x["shift"] + 0.7 * now if m else now
    change = {x["experiment_key"]: x for x in risk.change_scores(df, 0.3, block=4).collect()}
    for lot in (1, 2, 3, 4):
        own = [x for x in rows if x[0] == lot]
        run = before = None
        for _, _, k, _, _, v, c in own:
            v, x = np.array(v), change[k]
            assert x["initial_state"] == pytest.approx(np.linalg.norm(v - c))
            for name, other in (("wafer_delta", before), ("ewma_distance", run)):
                assert (x[name] is None) == (other is None) and (other is None or x[name] == pytest.approx(np.linalg.norm(v - other)))
            run = v if run is None else 0.3 * v + 0.7 * run
            before = v


def test_a_million_wafers_in_linear_time():
    import time

    from lotwise.operators import scan

    r = np.random.default_rng(13)
    took = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        limit = scan.limits(r.random(n), np.arange(n), n, 0.3, 0.7)
        c, whole = 0, int(scan.taken(limit, 0).sum())
        for at in range(0, n, scan.BLOCK):
            c = scan.counted(c, scan.steps_of(limit[at : at + scan.BLOCK]))
        took.append(time.perf_counter() - began)
        assert c == whole == round(0.3 * n)
    assert took[1] < 8 * took[0]


def test_correlation_p_values(spark):
    known = [(0.5, 10, 0.141113), (0.9, 5, 0.037386), (-0.3, 50, 0.034286), (0.0, 8, 1.0), (1.0, 6, 0.0), (0.05, 400, 0.318525)]  # Student's t, by numerical integration
    df = spark.createDataFrame([(r, n) for r, n, _ in known] + [(None, 9), (0.4, 2)], "r double, n long")
    got = [x[0] for x in df.select(stats.correlation_p_value("r", "n")).collect()]
    assert got[-2:] == [None, None] and np.allclose(got[:-2], [p for _, _, p in known], atol=2e-6)
