"""Debouncing against a loop, areas of long lots against the definition, and the NetCDF sources on files of a stand-in library."""

import json
import math
import os
import pickle
import sys
import textwrap
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lotwise import queries
from lotwise.functions import stats
from lotwise.operators import risk, segment
from lotwise.plans import models
from lotwise.sources import netcdf
from tests.conftest import same_rows

SPEC = segment.TraceSpec()


def kept(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] > gap:
            out.append(t)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_kept_edges_are_those_of_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k, (n, scale) in enumerate([(1, 1.0), (60, 1.0), (60, 4.0), (200, 0.4), (40, 0.0)]):
        t = np.round(np.cumsum(rng.exponential(scale, n)), 1) if scale else np.full(n, 2.0)
        rows += [(f"k{k}", float(x), bool(r)) for x, r in zip(t, rng.random(n) < 0.6)]
    rows += [("nulls", None, True), ("nulls", 1.0, None), ("nulls", 2.0, True), ("none", 1.0, False)]
    df = spark.createDataFrame(rows, "experiment_key string, t double, rises boolean")
    d = segment.with_kept_edges(df, "rises", 3.0)
    assert d.columns == [*df.columns, "kept_edge"] and d.count() == len(rows)
    got = {r[0]: r[1] for r in d.groupBy("experiment_key").agg(segment.kept_times()).collect()}
    for key in {r[0] for r in rows}:
        assert got[key] == kept([t for k, t, rises in rows if k == key and rises and t is not None], 3.0), key
    assert segment.with_kept_edges(df.limit(0), "rises", 3.0).count() == 0


def test_a_trace_shares_one_shuffle_and_no_row_holds_its_edges(spark):
    rows = [("w", 0.2 * i, 100.0 if 300 <= i < 3300 else 0.0, 600.0 if i % 30 < 22 else 0.0, 300.0 if i % 30 >= 22 else 0.0) for i in range(3600)]
    df = spark.createDataFrame(rows, "experiment_key string, t double, rf double, gas_long double, gas_short double")
    for detector in segment.DETECTORS:
        d = segment.detect_regions(df, detector)
        assert not [f for f in d.schema if f.dataType.typeName() == "array"]
        assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        one = d.agg(F.first("cycle_count"), F.count_if("kept_edge"), F.max("cycle_index")).first()
        assert one[0] == one[1] == one[2] + 1 == 100


def test_quantiles_round_once_as_sql_does(spark, duck):
    rng = np.random.default_rng(11)
    rows = [(f"k{k}", None if i == 3 else float(x)) for k, n in enumerate(rng.integers(1, 90, 200)) for i, x in enumerate(np.round(rng.uniform(0, 300, n), 2))]
    got = stats.with_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], ["lo", "hi"])
    assert got.columns == ["k", "v", "lo", "hi"] and got.count() == len(rows)
    own = got.select("k", "lo", "hi").distinct().toArrow()  # noqa: F841
    plain = pa.table({"k": [r[0] for r in rows], "v": [r[1] for r in rows]})  # noqa: F841
    apart = duck.sql("select count(*) from own full join (select k, quantile_cont(v, 0.05) a, quantile_cont(v, 0.95) b from plain group by k) q using (k) where (lo, hi) is distinct from (a, b)").fetchall()
    assert apart == [(0,)]


def test_quantiles_between_equal_neighbours(spark):
    # 5 % and 95 % of 58 samples lie between equal neighbours, 3 and 91; SQL's own rounding is kept there too.
    values = [3.0] * 6 + [47.0] * 46 + [91.0] * 6
    df = spark.createDataFrame([("w", float(i), float(i % 58 != 0), v, v) for i, v in enumerate(values)], "experiment_key string, t double, rf double, gas_long double, gas_short double")
    got = segment.with_quantiles(df, "gas_long", ["experiment_key"], ["lo", "hi"]).select("lo", "hi").distinct().collect()
    assert [tuple(r) for r in got] == [(math.fma(3.0, 1 - (57 * 0.05 - 2), 3.0 * (57 * 0.05 - 2)), math.fma(91.0, 1 - (57 * 0.95 - 54), 91.0 * (57 * 0.95 - 54)))]


@pytest.fixture(scope="module")
def threshold_events(tmp_path_factory):
    """Events of three wafers with samples that meet a threshold exactly."""
    import duckdb

    rows = []
    for user in (19, 11062, 16883):
        r = np.random.default_rng(user)
        n = r.integers(20, 60)
        for at, short, long, power in zip(np.sort(r.integers(0, 2 * 10**12, n)), r.integers(0, 30, n), r.integers(0, 30, n), r.integers(0, 100, n)):
            rows.append((97 * user + int(short), 1704067200 * 10**6 + int(at), user, float(power), f'{{"k": {long}}}'))
    event_id, ts, user_id, value, props = zip(*rows)
    folder = tmp_path_factory.mktemp("events")
    pq.write_table(pa.table({"event_id": event_id, "ts": pa.array(ts, pa.timestamp("us")), "user_id": user_id, "value": value, "props": props}), folder / "events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", [
    "cycle_assignment_duration_filtered", "cycle_assignment_period_constrained", "cycle_assignment_quantile", "cycle_diagnostics", "edge_debounce", "feature_pivot",
    "phase_masks_complementary", "phase_masks_duration_filtered", "phase_masks_period_constrained", "phase_masks_quantile",
])
def test_samples_on_a_threshold_fall_as_in_sql(spark, threshold_events, name):
    folder, con = threshold_events
    same_rows(queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name]))


def test_a_policy_is_not_worse_than_itself(spark):
    # A second run of the areas gives other last bits; here, other values.
    anew = F.udf(lambda _: os.urandom(4)[0] / 256.0 + 0.001, "double").asNondeterministic()
    lots = spark.range(40).select((F.col("id") + 1).cast("int").alias("lot_number"), F.lit("random").alias("policy"), anew("id").alias("aurc"))
    got = risk.policy_influence(lots).select("lots_worse_than_random", "median_policy_minus_random", "relative_reduction_vs_random").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 0.0)]


def test_even_places_of_long_lots(spark):
    # 60,000 * 59,999 is beyond 32 bits.
    for n, budgets in ((1, (0.5,)), (2, (0.1, 0.5, 1.0)), (7, (0.1, 0.3, 0.5, 1.0)), (60_000, (0.1, 0.7))):
        df = spark.range(n).select(F.lit(1).alias("lot_number"), F.col("id").cast("int").alias("wafer_order"), (F.col("id") % 101).cast("double").alias("error"))
        got = {r["requested_budget"]: r for r in risk.periodic_curve(df, budgets).collect()}
        for b in budgets:
            k = min(int(np.rint(b * n)), n - 1)
            at = sorted({int(np.rint(i * (n - 1) / max(k - 1, 1))) for i in range(k)})
            assert got[b]["selected_wafers"] == len(at)
            assert got[b]["retained_mae"] == pytest.approx(np.delete(np.arange(n) % 101.0, at).mean())


def test_the_area_of_a_long_lot_is_one_pass(spark):
    e = np.random.default_rng(3).random(60_000)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(e)], "lot_number int, wafer_order int, error double").withColumn("score", -F.col("wafer_order"))
    start = time.monotonic()
    got = risk.aurc(df).first()["aurc"]
    assert time.monotonic() - start < 15  # a sum for each row took 3.6e9 additions
    left = np.cumsum(e[::-1])[::-1] / np.arange(len(e), 0, -1)
    assert got == pytest.approx(np.trapezoid(left) / (len(e) - 1))


def test_distances_are_taken_some_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(9)
    side = lambda n, at: pd.DataFrame({"k": [f"w{i + at}" for i in range(n)], "x": list(rng.random((n, 3)))})
    q, t = side(50, 0), side(40, 30)
    whole = risk._nearest(q, t)
    monkeypatch.setattr(risk, "NEAREST_CELLS", 90)
    assert (risk._nearest(q, t) == whole).all()
    for i, (k, x) in enumerate(zip(q["k"], q["x"])):
        assert whole[i] == pytest.approx(min(np.linalg.norm(x - y) for k2, y in zip(t["k"], t["x"]) if k2 != k))


def test_periodic_areas_in_parts(spark):
    rng = np.random.default_rng(5)
    lots = {1: rng.random(700), 2: rng.random(1), 3: rng.random(257)}
    df = spark.createDataFrame([(lot, f"s{lot % 2}", i, float(e)) for lot, x in lots.items() for i, e in enumerate(x)], "lot_number int, side string, wafer_order int, error double")
    for r in risk.periodic_aurc(df, by=("lot_number", "side")).collect():
        e, n, left = lots[r["lot_number"]], len(lots[r["lot_number"]]), []
        for c in range(n):
            left.append(np.delete(e, sorted({int(np.rint(i * (n - 1) / max(c - 1, 1))) for i in range(c)})).mean())
        assert r["aurc"] == pytest.approx(left[0] if n == 1 else np.trapezoid(left) / (n - 1))
    gap = df.withColumn("error", F.when((F.col("lot_number") != 3) | (F.col("wafer_order") != 5), F.col("error")))
    assert {r["lot_number"] for r in risk.periodic_aurc(gap).filter("aurc is null").collect()} == {3}


#: A module netCDF4 that opens pickled groups and notes what is read of them.
STAND_IN = '''
import pickle

class Variable:
    def __init__(self, path, name, value):
        self.path, self.name, self.value = path, name, value
    def __len__(self):
        return len(self.value)
    def __getitem__(self, at):
        got = self.value[at]
        with open(self.path + ".log", "a") as f:
            f.write(f"{self.name} {getattr(got, 'size', 0)}\\\\n")
        return got

class Group:
    def __init__(self, path, name, held):
        self.variables = {k: Variable(path, f"{name}/{k}", v) for k, v in held.items()}

class Dataset:
    def __init__(self, path):
        with open(path, "rb") as f:
            held = pickle.load(f)
        self.groups = {k: Group(path, k, v) for k, v in held["groups"].items()}
        self.variables = Group(path, "", held["variables"]).variables
    def __enter__(self):
        return self
    def __exit__(self, *_):
        return False
'''

FEATURES = {"Etch_1": ["b", "a", "only_1", "c"], "Etch_2": ["c", "b", "a"], "Etch_3": ["a", "x", "b", "c"]}


def _dump(path, groups, variables):
    with open(path, "wb") as f:
        pickle.dump({"groups": groups, "variables": variables}, f)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Two files with three groups, and their dictionary; the real library reads them only if it is the stand-in."""
    try:
        import netCDF4

        if not hasattr(netCDF4, "STAND_IN"):
            pytest.skip("the files are the stand-in's")
    except ImportError:
        pass
    at = tmp_path_factory.mktemp("nc")
    module = at / "netCDF4.py"
    module.write_text(textwrap.dedent(STAND_IN).replace("\\\\n", "\\n") + "\nSTAND_IN = True\n")
    spark.sparkContext.addPyFile(str(module))
    sys.path.insert(0, str(at))
    rng = np.random.default_rng(1)
    groups = {}
    for name, features in FEATURES.items():
        n = {"Etch_1": 25, "Etch_2": 7, "Etch_3": 10}[name]
        groups[name] = {"times": np.arange(n) * 0.5, "data": rng.integers(0, 50, (n, len(features))).astype(np.uint16), "feature": np.array(features), "wavelengths": np.arange(len(features)) * 0.1 + 200}
    _dump(at / "one.nc", {k: groups[k] for k in ("Etch_1", "Etch_2")}, {})
    _dump(at / "two.nc", {"Etch_3": groups["Etch_3"]}, {})
    _dump(at / "dictionary.nc", {}, {"data": np.arange(50) * 1.5 - 3})
    netcdf.register(spark)
    yield at, groups
    sys.path.remove(str(at))


def _reads(path):
    log = path.with_name(path.name + ".log")
    lines = [x.split() for x in log.read_text().splitlines()] if log.exists() else []
    log.unlink(missing_ok=True)
    return [(name, int(size)) for name, size in lines]


@pytest.mark.parametrize("splits", [1, 3])
def test_traces_of_common_signals(spark, files, splits):
    at, groups = files
    both, dictionary = f"{at}/one.nc,{at}/two.nc", f"{at}/dictionary.nc"
    g = spark.read.format("wafer_netcdf_groups").load(both)
    assert {(r["group"], r["samples"], tuple(r["features"])) for r in g.collect()} == {(k, len(groups[k]["times"]), tuple(v)) for k, v in FEATURES.items()}
    assert [r[0] for r in netcdf.common_signals(g).collect()] == ["a", "b", "c"]
    got = netcdf.process_traces(spark, both, dictionary, splits)
    assert got.columns == ["path", "group", "t", "a", "b", "c"] and got.count() == 42
    for name, held in groups.items():
        rows = sorted(tuple(r) for r in got.filter(F.col("group") == name).select("t", "a", "b", "c").collect())
        x = held["data"][:, [FEATURES[name].index(s) for s in "abc"]] * 1.5 - 3
        assert np.allclose(rows, np.column_stack([held["times"], x]))
    with pytest.raises(ValueError, match="duplicate"):
        netcdf.process_traces(spark, f"{both},{_copied(at)}", dictionary)


def _copied(at):
    (at / "three.nc").write_bytes((at / "two.nc").read_bytes())
    return at / "three.nc"


def test_filters_and_columns_reach_the_file(spark, files):
    at, groups = files
    read = spark.read.format("wafer_netcdf").option("rows", 5)
    _reads(at / "one.nc"), _reads(at / "two.nc")
    d = read.load(f"{at}/one.nc,{at}/two.nc").filter((F.col("group") == "Etch_1") & (F.col("t") >= 5.0) & (F.col("t") < 6.0) & (F.col("row") < 15))
    rows = d.collect()
    assert [(r["row"], r["t"], r["codes"]) for r in sorted(rows, key=lambda r: r["row"])] == [(i, i * 0.5, groups["Etch_1"]["data"][i].tolist()) for i in (10, 11)]
    seen = _reads(at / "one.nc")
    assert sum(n for name, n in seen if name.endswith("data")) == 8 and not any("Etch_2" in name for name, _ in seen)
    assert sum(n for name, n in seen if name.endswith("times")) == 15 and not _reads(at / "two.nc")
    assert read.schema("group string, row long").load(f"{at}/one.nc").filter("group in ('Etch_2', 'nowhere')").count() == 7
    assert not [x for x in _reads(at / "one.nc") if x[0].endswith(("data", "times"))]
    two = read.schema("row long, codes array<int>").option("signals", json.dumps(["c", "a"])).load(f"{at}/two.nc").orderBy("row").collect()
    assert [r["codes"] for r in two] == groups["Etch_3"]["data"][:, [3, 0]].tolist()
    assert spark.read.format("wafer_netcdf").load(f"{at}/one.nc").filter("path = 'other'").count() == 0 and not _reads(at / "one.nc")


@pytest.mark.parametrize("rows", [3, 512])
def test_sums_by_blocks(spark, files, rows):
    at, groups = files
    b = spark.read.format("wafer_netcdf_blocks").options(rows=rows, dictionary=f"{at}/dictionary.nc", splits=2).load(f"{at}/one.nc")
    for r in netcdf.channel_sums(b).collect():
        x = groups[r["group"]]["data"][:, r["channel"]] * 1.5 - 3
        assert (r["samples"], r["minimum"], r["maximum"]) == (len(x), x.min(), x.max()) and (r["mean"], r["deviation"]) == pytest.approx((x.mean(), x.std()))
    w = spark.read.format("wafer_netcdf_groups").load(f"{at}/two.nc").first()["wavelengths"]
    assert w == pytest.approx([200, 200.1, 200.2, 200.3])


@pytest.mark.parametrize("values,problem", [(np.arange(20) * 1.0, "invalid dictionary code"), (np.where(np.arange(50) == 49, np.nan, 0.0), "non-finite"), (np.array([]), "invalid")])
def test_bad_codes_fail(spark, files, values, problem):
    at, groups = files
    groups["Etch_3"]["data"][0, 0] = 49
    _dump(at / "bad.nc", {"Etch_3": groups["Etch_3"]}, {})
    _dump(at / "short.nc", {}, {"data": values})
    with pytest.raises(Exception, match=problem):
        spark.read.format("wafer_netcdf_blocks").option("dictionary", f"{at}/short.nc").load(f"{at}/bad.nc").collect()


def test_missing_times_and_codes_are_null(spark, files):
    at, _ = files
    _dump(at / "masked.nc", {"g": {"times": np.ma.array([0.0, 1.0, 2.0], mask=[0, 1, 0]), "data": np.ma.array([[1, 2], [3, 4], [5, 6]], mask=[[0, 1], [0, 0], [0, 0]])}}, {})
    d = spark.read.format("wafer_netcdf").load(f"{at}/masked.nc").orderBy("row")
    assert [(r["t"], r["codes"]) for r in d.collect()] == [(0.0, [1, None]), (None, [3, 4]), (2.0, [5, 6])]
    assert d.filter("t >= 0").count() == 2
    _dump(at / "empty.nc", {"g": {"times": np.zeros(0), "data": np.zeros((0, 2), np.uint16)}}, {})
    assert spark.read.format("wafer_netcdf").load(f"{at}/empty.nc").count() == 0


@pytest.mark.parametrize("family", ["ridge", "pls"])
def test_lots_in_parts_give_the_models_of_whole_lots(spark, monkeypatch, family):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(60, 4))
    maps = x @ rng.normal(size=(4, 5)) + rng.normal(scale=0.1, size=(60, 5))
    rows = spark.createDataFrame([(f"w{i:03d}", i % 4 + 1, x[i].tolist(), maps[i].tolist()) for i in range(60)], "experiment_key string, lot_number int, x array<double>, map array<double>")

    def found():
        facts = models.evaluate_folds(rows, (family,))
        return {(r["experiment_key"], r["stage"]): (r["predicted"], r["facts"]) for r in facts.collect()}

    whole = found()
    monkeypatch.setattr(models, "PART", 4)
    some = found()
    assert set(some) == set(whole) and len(some) == 60 * 5
    for k, (p, facts) in whole.items():
        assert some[k][0] == pytest.approx(p, abs=1e-9)
        a, b = json.loads(facts), json.loads(some[k][1])
        assert (a["mean_parameter"], a["residual_parameter"]) == (b["mean_parameter"], b["residual_parameter"])
        assert a["residual_inner_lot_macro_rmse"] == pytest.approx(b["residual_inner_lot_macro_rmse"])
    moments = models.lot_moments(rows.withColumn("ablation", F.lit("all")))
    sizes = models.Parts(rows.withColumn("ablation", F.lit("all")), moments).wafers.groupBy("lot_number", "part").count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 15
