"""Risk scores and selection policies (R1-R20, C1, C5-C8), ordered within lots by the wafer key."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.stats import l2_distance, safe_divide, spearman
from lotwise.kernels import policies as kernel
from lotwise.operators import scan
from lotwise.operators.resample import rankings
from lotwise.sources.shared import new_dir, spread, written


def empirical_percentile(values: DataFrame, reference: DataFrame, value: str, by: Sequence[str] = (), out: str = "percentile") -> DataFrame:
    """Adds the share of the reference at or below each value; 0.5 for NULL. One sort of both sides, no pairs."""
    ref = reference.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    own = values.select(*by, F.col(value).alias("_v"), F.lit(1).alias("_side"), F.struct(*values.columns).alias("_row"))
    w = Window.partitionBy(*by)
    both = ref.unionByName(own, allowMissingColumns=True)
    upto = F.count(F.when(F.col("_side") == 0, 1)).over(w.orderBy(F.col("_v").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0))
    total = F.count(F.when(F.col("_side") == 0, 1)).over(w)
    both = both.withColumn(out, F.when(F.col("_v").isNull(), 0.5).otherwise(upto / F.when(total > 0, total)))
    return both.filter("_side = 1").select("_row.*", out)


def change_scores(vectors: DataFrame, alpha: float, centroid: str = "centroid", by: Sequence[str] = ("lot_number",), key: str = "experiment_key", x: str = "x", block: int | None = None) -> DataFrame:
    """Adds initial_state (distance to the centroid), wafer_delta (to the previous wafer) and ewma_distance (to the running mean before the wafer).

    The first wafer of a lot has NULL for the last two. Lots are scanned in blocks: a block hands on its last wafer and
    the running mean, which is an affine map of the one before it.
    """
    if not 0 < alpha <= 1:
        raise ValueError("ewma_alpha must be in (0, 1]")

    def matrix(g: pd.DataFrame) -> np.ndarray:
        return np.stack(g["_x"].to_numpy()).astype(float)

    def summary(g: pd.DataFrame):
        v = matrix(g)
        if g["_i"].iloc[0] == 0:  # a lot's mean starts as its first wafer
            return v[-1], 0.0, scan.decayed(v[1:], alpha, v[0])[-1]
        return v[-1], (1 - alpha) ** len(v), scan.decayed(v, alpha, np.zeros(v.shape[1]))[-1]

    def after(carry, s):
        return s[0], s[2] if carry is None else s[1] * carry[1] + s[2]

    def apply(g: pd.DataFrame, carry) -> pd.DataFrame:
        v = matrix(g)
        before = np.concatenate([v[:1] if carry is None else carry[0][None], v[:-1]])
        run = scan.decayed(v[1:], alpha, v[0]) if carry is None else scan.decayed(v, alpha, carry[1])[:-1]
        run = np.concatenate([v[:1], run[:-1]]) if carry is None else run
        near = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=1))
        initial = np.array([np.nan if c is None else float(np.sqrt(((r - np.asarray(c, float)) ** 2).sum())) for r, c in zip(v, g["_c"])])
        out = g[[*by, key]].assign(initial_state=initial, wafer_delta=near(v, before), ewma_distance=near(v, run))
        if carry is None:
            out.iloc[0, -2:] = np.nan
        return out

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    kinds = ", ".join([*(f"`{c}` {types[c]}" for c in (*by, key)), "initial_state double, wafer_delta double, ewma_distance double"])
    rows = vectors.select(*by, key, F.col(x).alias("_x"), F.col(centroid).alias("_c"))
    s = scan.scanned(rows, by, [key], summary, after, apply, kinds, block)
    s = s.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("initial_state", "wafer_delta", "ewma_distance")})
    return vectors.join(s, [*by, key])


def fold_scales(long: DataFrame, lot: str = "lot_number", least_variance: float = 1e-12) -> DataFrame:
    """(held_out_lot, feature, mean, deviation) over the other lots of long(lot, feature, value); features that don't vary there are left out.

    Lots' moments are merged from either end, and a fold is what is before its lot merged with what is behind it. Means
    are running sums, and the second moment grows with each lot by its own and by its distance from the mean so far:
    nothing is subtracted that a large value of the held-out lot could have rounded away.
    """
    own = long.groupBy("feature", lot).agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("q")).filter("n > 0")
    for side, order in (("a", F.asc(lot)), ("b", F.desc(lot))):
        w = Window.partitionBy("feature").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        n = F.coalesce(F.sum("n").over(w), F.lit(0))
        own = own.withColumns({f"n{side}": n, f"m{side}": F.coalesce(F.sum(F.col("n") * F.col("m")).over(w), F.lit(0.0)) / F.greatest(n, F.lit(1))})
        grows = F.col("q") + F.col("n") * F.col(f"n{side}") / (F.col("n") + F.col(f"n{side}")) * (F.col("m") - F.col(f"m{side}")) ** 2
        own = own.withColumn("_g", grows).withColumn(f"q{side}", F.coalesce(F.sum("_g").over(w), F.lit(0.0)))
    n = F.col("na") + F.col("nb")
    mean = (F.col("na") * F.col("ma") + F.col("nb") * F.col("mb")) / n
    variance = (F.col("qa") + F.col("qb") + F.col("na") * F.col("nb") / n * (F.col("ma") - F.col("mb")) ** 2) / n
    return own.filter(n > 0).select(F.col(lot).alias("held_out_lot"), "feature", mean.alias("mean"), variance.alias("_v")).filter(F.col("_v") > least_variance).select("held_out_lot", "feature", "mean", F.sqrt("_v").alias("deviation"))


def standardized(long: DataFrame, lot: str = "lot_number", least_variance: float = 1e-12) -> DataFrame:
    """``long`` once for each fold, with held_out_lot, is_train and z: the value scaled by the fold's training rows; those constant in training are dropped."""
    j = long.join(fold_scales(long, lot, least_variance), "feature")
    return j.withColumns({"is_train": F.col(lot) != F.col("held_out_lot"), "z": (F.col("value") - F.col("mean")) / F.col("deviation")}).drop("mean", "deviation")


#: Vectors of either side that one task compares with each other, and points from which distances are known.
BLOCK, PIVOTS = 4096, 64
#: Pivots of all folds together, a handful a fold at least.
MOST_PIVOTS, LEAST_PIVOTS = 200_000, 4


#: Cells of a matrix of distances that one task holds.
NEAREST_CELLS = 1_000_000


def _least(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least distance from each row of x to a row of y other than that at its place in ``own`` (-1: none), some rows at a time.

    Products rule out all rows but those that rounding leaves open; these are compared dimension by dimension, exactly.
    """
    out, step = np.full(len(x), np.inf), max(1, NEAREST_CELLS // max(len(y), 1))
    length = (y**2).sum(axis=1)
    for at in range(0, len(x) if len(y) else 0, step):
        some, place = x[at : at + step], own[at : at + step]
        square = some @ (-2 * y.T)
        square += length
        same = np.flatnonzero(place >= 0)
        square[same, place[same]] = np.inf
        slack = 1e-12 * (x.shape[1] + 1) * ((some**2).sum(axis=1) + length.max())
        i, j = np.nonzero(square <= (square.min(axis=1) + slack)[:, None])
        exact = np.zeros(len(i))
        for k in range(x.shape[1]):
            exact += (some[i, k] - y[j, k]) ** 2
        exact[place[i] == j] = np.inf
        np.minimum.at(out, i + at, np.sqrt(exact))
    return out


def _places(keys, wanted) -> np.ndarray:
    place = dict(zip(keys, range(len(keys))))  # keys are distinct within a fold
    return np.array([place.get(k, -1) for k in wanted], int)


def _nearest(q: pd.DataFrame, t: pd.DataFrame) -> np.ndarray:
    """The least distance from each row of q to a row of t of another key."""
    return _least(np.stack(q["x"].to_numpy()).astype(float), np.stack(t["x"].to_numpy()).astype(float), _places(t["k"].tolist(), q["k"]))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T, 0))


def _bounds(distances: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """The least distance that a row of each ring can have, by the triangle inequality; rings: (pivot, least and largest distance to it).

    Bounds are taken down by what rounding may have added to a distance.
    """
    own = distances[:, rings[:, 0].astype(int)]
    slack = 1e-6 * (1 + own + rings[:, 2])
    return np.maximum(np.maximum(own - rings[:, 2], rings[:, 1] - own) - slack, 0)


#: Bounds of a row and a ring that one task holds, and rings that a row looks into one by one before it sweeps over the others.
BOUND_CELLS, AHEAD = 2_000_000, 3


def with_nearest(vectors: DataFrame, fold: str = "held_out_lot", train: str = "is_train", key: str = "experiment_key", x: str = "x", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``vectors`` without x, with ood_distance, the distance to the nearest training row (NULL if there is no other), and compared, how many rows were looked at for it.

    Training rows lie in rings about their nearest pivots, of ``block`` rows at most, each a file of the shared folder.
    A row first looks into the rings that can be nearest; what it finds there rules out all rings that the triangle
    inequality keeps farther away, and only the others are looked into. Tasks map the rings that their rows need, so rows
    are never copied for the rings that they ask: what is written and shuffled grows as the rows do. Pivots are rows of
    some keys, the same in all folds; they and the rings' bounds, a row for each ``block`` training rows, come to the
    driver and go to the tasks. ``vectors`` is gone through several times.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(fold).alias("f"), F.col(key).alias("k"), F.col(x).alias("x"), F.col(train).alias("t"))
    kinds = f"f {vectors.schema[fold].dataType.simpleString()}, k {vectors.schema[key].dataType.simpleString()}, x array<double>"
    folds = rows.select("f").distinct().count()
    some = max(LEAST_PIVOTS, min(pivots, MOST_PIVOTS // max(folds, 1)))
    named = rows.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(some)
    at: dict = {}
    for r in rows.join(F.broadcast(named), "k").select("f", "k", "x").collect():  # ``some`` a fold at most
        at.setdefault(r["f"], []).append((r["k"], r["x"]))
    pivot_of = spark.sparkContext.broadcast({f: np.array([v for _, v in sorted(found, key=lambda p: str(p[0]))], float) for f, found in at.items()})
    folder = new_dir(spark, "rings")

    def own_pivots(f, width: int) -> np.ndarray:
        return pivot_of.value.get(f, np.zeros((1, width)))

    def placed(batches):
        for b in batches:
            for f, g in b.groupby("f", sort=False):
                d = _to_pivots(np.stack(g["x"].to_numpy()).astype(float), own_pivots(f, len(g["x"].iloc[0])))
                home = d.argmin(axis=1)
                yield g[["f", "k", "x"]].assign(home=home, d=d[np.arange(len(g)), home])

    def ring(g: pd.DataFrame) -> pd.DataFrame:
        name = uuid.uuid4().hex  # a task that is run again names its own
        np.save(f"{folder}/{name}-x.npy", np.stack(g["x"].to_numpy()).astype(float))
        with open(f"{folder}/{name}-keys", "wb") as f:
            pickle.dump(g["k"].tolist(), f)
        return pd.DataFrame({"f": g["f"].iloc[:1], "home": g["home"].iloc[0], "lo": g["d"].min(), "hi": g["d"].max(), "n": len(g), "name": name})

    around = Window.partitionBy("f", "home").orderBy("d", "k")
    training = rows.filter("t").mapInPandas(placed, kinds + ", home int, d double").withColumn("b", F.floor((F.row_number().over(around) - 1) / F.lit(block)))
    told = spread(training, "f", "home", "b").groupBy("f", "home", "b").applyInPandas(ring, kinds.split(", ")[0] + ", home int, lo double, hi double, n long, name string")
    rings: dict = {}
    for r in told.collect():  # a row a ring
        rings.setdefault(r["f"], []).append((r["home"], r["lo"], r["hi"], r["n"], r["name"]))
    ring_of = spark.sparkContext.broadcast({f: (np.array([r[:3] for r in sorted(found)], float), [r[3:] for r in sorted(found)]) for f, found in rings.items()})

    def searched(f, keys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, compared = np.full(len(v), np.inf), np.zeros(len(v), np.int64)
        bounds, files = ring_of.value.get(f, (None, ()))
        if not files:
            return best, compared
        d = _to_pivots(v, own_pivots(f, v.shape[1]))
        low = _bounds(d, bounds)
        nearest = np.lexsort((d[:, bounds[:, 0].astype(int)], low), axis=1)

        def look(j: int, i: np.ndarray) -> None:
            n, name = files[j]
            with open(f"{folder}/{name}-keys", "rb") as found:
                own = _places(pickle.load(found), keys[i])
            best[i] = np.minimum(best[i], _least(v[i], np.load(f"{folder}/{name}-x.npy", mmap_mode="r"), own))
            compared[i] += n

        done = np.zeros(low.shape, bool)
        for ahead in range(min(AHEAD, len(files))):
            at = nearest[:, ahead]
            can = low[np.arange(len(v)), at] < best
            for j in np.unique(at[can]):
                i = np.flatnonzero(can & (at == j))
                look(j, i)
                done[i, j] = True
        for j in np.argsort(low.mean(axis=0)):
            i = np.flatnonzero((low[:, j] < best) & ~done[:, j])
            if len(i):
                look(j, i)
        return best, compared

    def search(batches):
        for b in batches:
            distance, compared = np.full(len(b), np.inf), np.zeros(len(b), np.int64)
            for f, at in b.groupby(fold, sort=False, dropna=False).indices.items():
                step = max(1, BOUND_CELLS // max(1, len(ring_of.value.get(f, (0, ()))[1])))
                for lo in range(0, len(at), step):
                    i = at[lo : lo + step]
                    distance[i], compared[i] = searched(f, b[key].to_numpy()[i], np.stack(b[x].to_numpy()[i]).astype(float))
            yield b.drop(columns=[x]).assign(ood_distance=distance, compared=compared)

    own = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in vectors.schema if c.name != x), "ood_distance double, compared long"])
    found = spread(vectors, fold, key).sortWithinPartitions(fold).mapInPandas(search, own)
    return found.withColumn("ood_distance", F.when(F.col("ood_distance") < F.lit(float("inf")), F.col("ood_distance")))


def nearest_search(vectors: DataFrame, fold: str = "held_out_lot", train: str = "is_train", key: str = "experiment_key", x: str = "x", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(fold, key, ood_distance, compared) of the rows for which ``with_nearest`` finds one. Rows are written once."""
    rows = written(vectors.select(fold, key, x, train), "vectors")
    return with_nearest(rows, fold, train, key, x, block, pivots).filter("ood_distance is not null").select(fold, key, "ood_distance", "compared")


def nearest_training_distance(vectors: DataFrame, fold: str = "held_out_lot", train: str = "is_train", key: str = "experiment_key", x: str = "x", block: int = BLOCK) -> DataFrame:
    """(fold, key, ood_distance): distance to the nearest training row of the fold other than the row itself.

    Rows of a fold without any other training row are left out; keys are distinct within a fold.
    """
    return nearest_search(vectors, fold, train, key, x, block).drop("compared")


def model_disagreement(points: DataFrame, a: str = "pls", b: str = "ridge", keys: Sequence[str] = ("lot_number", "experiment_key")) -> DataFrame:
    """(keys, model_disagreement): root mean square over points between two families' full maps."""
    p = points.filter(F.col("family").isin(a, b) & (F.col("stage") == "full_map")).groupBy(*keys, "x", "y").pivot("family", [a, b]).agg(F.first("predicted"))
    d = F.col(a) - F.col(b)
    return p.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("model_disagreement"))


def mean_of(columns: Sequence[str]) -> Column:
    """Equal-weight mean of percentiles."""
    out = F.lit(0.0)
    for c in columns:
        out = out + F.col(c)
    return out / len(columns)


def rint(x: Column) -> Column:
    return F.rint(x).cast("int")


def _ranked(wafers: DataFrame, score: str, by: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return wafers.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc(score), order)), "_n": F.count("*").over(w)})


def policy_curve(wafers: DataFrame, budgets: Sequence[float], score: str = "score", error: str = "error", by: Sequence[str] = ("lot_number",), order: str = "wafer_order") -> DataFrame:
    """(by, requested_budget, selected_wafers, actual_metrology_fraction, retained_mae): the largest scores are measured, at most all but one."""
    b = F.explode(F.array(*[F.lit(float(x)) for x in budgets]))
    r = _ranked(wafers, score, by, order).withColumn("requested_budget", b)
    r = r.withColumn("_k", F.least(rint(F.col("requested_budget") * F.col("_n")), F.col("_n").cast("int") - 1))
    return r.groupBy(*by, "requested_budget").agg(
        F.first("_k").cast("long").alias("selected_wafers"), (F.first("_k") / F.first("_n")).alias("actual_metrology_fraction"), F.avg(F.when(F.col("_rn") > F.col("_k"), F.col(error))).alias("retained_mae"),
    )


def periodic_places(n: Column, count: Column) -> Column:
    """The places from 0 of ``count`` wafers spread evenly over n, repeats once."""
    place = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: _periodic_place(i, n, count))
    return F.when(count > 0, F.array_distinct(place)).otherwise(F.array().cast("array<int>"))


def _periodic_place(i: Column, n: Column, count: Column) -> Column:
    return rint(i.cast("long") * (n - 1) / F.greatest(count - 1, F.lit(1)).cast("double"))


def is_periodic_place(place: Column, n: Column, count: Column) -> Column:
    """Whether a place is one of ``periodic_places``: such places ascend, so only those numbered about place * (count - 1) / (n - 1) can be it."""
    near = F.floor(place.cast("long") * (count - 1) / F.greatest(n - 1, F.lit(1)).cast("double"))
    out = F.lit(False)
    for step in (-1, 0, 1, 2):
        out = out | (((near + step).between(0, count - 1)) & (_periodic_place(near + step, n, count) == place))
    return out


def periodic_curve(wafers: DataFrame, budgets: Sequence[float], error: str = "error", by: Sequence[str] = ("lot_number",), order: str = "wafer_order") -> DataFrame:
    """As ``policy_curve``, for wafers at even distances in their order."""
    w = Window.partitionBy(*by)
    r = wafers.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w).cast("int")}).withColumn("requested_budget", F.explode(F.array(*[F.lit(float(x)) for x in budgets])))
    r = r.withColumn("_at", is_periodic_place(F.col("_i"), F.col("_n"), F.least(rint(F.col("requested_budget") * F.col("_n")), F.col("_n") - 1)))
    selected = F.count_if("_at")
    return r.groupBy(*by, "requested_budget").agg(selected.alias("selected_wafers"), (selected / F.first("_n")).alias("actual_metrology_fraction"), F.avg(F.when(~F.col("_at"), F.col(error))).alias("retained_mae"))


def aurc(wafers: DataFrame, score: str = "score", error: str = "error", by: Sequence[str] = ("lot_number",), order: str = "wafer_order") -> DataFrame:
    """(by, aurc): the area under the curve of retained error over coverage, by suffix means of one sort.

    Coverages are evenly spaced, so the trapezoid is (sum - (first + last) / 2) / (n - 1); a lot of one wafer has its error.
    """
    r = _ranked(wafers, score, by, order)
    # From the last rank on: a frame that starts at the current row would be summed anew for each row.
    ahead = Window.partitionBy(*by).orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_risk", F.avg(error).over(ahead))
    ends = F.sum(F.when(F.col("_rn") == 1, F.col("_risk")).otherwise(0.0)) + F.sum(F.when(F.col("_rn") == F.col("_n"), F.col("_risk")).otherwise(0.0))
    return r.groupBy(*by).agg(F.when(F.count("*") > 1, (F.sum("_risk") - ends / 2) / (F.count("*") - 1)).otherwise(F.first("_risk")).alias("aurc"))


def periodic_aurc(wafers: DataFrame, error: str = "error", by: Sequence[str] = ("lot_number",), order: str = "wafer_order") -> DataFrame:
    """The area for even spacing, whose selection is made anew for each count.

    A task works on a range of counts of one lot from its array of errors: a 64th of them, 256 at least, so a wafer is
    sent 64 times at most, however long the lot. A missing error makes its lot's area NULL.
    """
    w = Window.partitionBy(*by)
    own = wafers.select(*by, F.col(order).alias("o"), F.col(error).cast("double").alias("e")).withColumn("n", F.count("*").over(w))
    own = own.withColumn("span", F.greatest(F.ceil(F.col("n") / 64), F.lit(256)).cast("long"))
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("span")))))

    def run(group: tuple, g: pd.DataFrame) -> pd.DataFrame:
        e, n, span = g.sort_values("o", kind="stable")["e"].to_numpy(float), len(g), int(g["span"].iloc[0])
        counts = np.arange(group[-1] * span, min((group[-1] + 1) * span, n))
        risk = kernel.periodic_risks(e, counts)
        weight = np.where((counts == 0) | (counts == n - 1), 0.5, 1.0) / (n - 1) if n > 1 else np.ones(1)
        return pd.DataFrame({**dict(zip(by, [[x] for x in group[:-1]])), "area": [float((risk * weight).sum())]})

    kinds = ", ".join(f"`{c}` {wafers.schema[c].dataType.simpleString()}" for c in by)
    parts = spread(own, *by, "part").groupBy(*by, "part").applyInPandas(run, f"{kinds}, area double")
    return parts.groupBy(*by).agg(F.when(F.count("area") == F.count("*"), F.sum("area")).alias("aurc"))


RANDOM = "lot_number int, aurc double, random_p025 double, random_p975 double, budgets array<struct<requested_budget:double,selected_wafers:long,actual_metrology_fraction:double,retained_mae:double>>"
#: Random orders that one task draws of a lot.
PART = 1000


def random_areas(wafers: DataFrame, replicates: int = 10_000, seed: int = 20260721, budgets: Sequence[float] = (), error: str = "error", order: str = "wafer_order", key: str = "experiment_key") -> DataFrame:
    """(lot_number, replicate, aurc, retained): measuring a lot in each of so many random orders; ``retained`` has the mean error left at each budget.

    An order is that of draws keyed by (seed, replicate, wafer), so a task makes a range of ``PART`` orders of one lot
    from its array of errors, some hundred thousand places at a time, and gives back areas: wafers meet ranges of
    replicates, not replicates. Without a column ``key`` a wafer's key is its lot and order.
    """
    named = F.col(key).cast("string") if key in wafers.columns else F.concat_ws("-", "lot_number", order)
    shares = [float(b) for b in budgets]

    def run(group: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("o", kind="stable")
        e, first = g["e"].to_numpy(float), int(group[1]) * PART
        left = [min(int(np.rint(b * len(e))), len(e) - 1) for b in shares]
        out = []
        for some, ordered in kernel.drawn_orders(seed, first, min(first + PART, replicates), g["k"].tolist(), e):
            kept = np.stack([ordered[:, k:].mean(axis=1) for k in left], axis=1) if left else np.zeros((len(some), 0))
            out.append(pd.DataFrame({"lot_number": int(group[0]), "replicate": some, "aurc": kernel.areas(ordered), "retained": list(kept)}))
        return pd.concat(out)

    own = wafers.select(F.col("lot_number").cast("int").alias("lot_number"), F.col(order).alias("o"), named.alias("k"), F.col(error).cast("double").alias("e"))
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // PART) - 1))))
    return spread(own, "lot_number", "part").groupBy("lot_number", "part").applyInPandas(run, "lot_number int, replicate long, aurc double, retained array<double>")


def random_policy(wafers: DataFrame, replicates: int = 10_000, seed: int = 20260721, budgets: Sequence[float] = (), error: str = "error", order: str = "wafer_order", key: str = "experiment_key") -> DataFrame:
    """(lot_number, aurc, random_p025, random_p975, budgets): measuring in random order, over so many keyed orders of each lot.

    aurc and the budgets' retained errors are means over the orders, the others percentiles of their areas.
    """
    a = random_areas(wafers, replicates, seed, budgets, error, order, key)
    q = F.percentile("aurc", F.array(F.lit(0.025), F.lit(0.975)))
    g = a.groupBy("lot_number").agg(F.avg("aurc").alias("aurc"), q.alias("_q"), *[F.avg(F.col("retained")[i]).alias(f"_r{i}") for i in range(len(budgets))])
    g = g.join(wafers.groupBy(F.col("lot_number").cast("int").alias("lot_number")).agg(F.count("*").alias("_n")), "lot_number")

    def listed(i: int, b: float) -> Column:
        k = F.least(rint(F.lit(float(b)) * F.col("_n")), F.col("_n").cast("int") - 1).cast("long")
        return F.struct(F.lit(float(b)).alias("requested_budget"), k.alias("selected_wafers"), (k / F.col("_n")).alias("actual_metrology_fraction"), F.col(f"_r{i}").alias("retained_mae"))

    some = F.array(*[listed(i, b) for i, b in enumerate(budgets)]) if budgets else F.array()
    return g.select("lot_number", "aurc", F.col("_q")[0].alias("random_p025"), F.col("_q")[1].alias("random_p975"), some.cast(RANDOM.split("budgets ")[1]).alias("budgets"))


def every_order(wafers: DataFrame, most: int = 8, error: str = "error", order: str = "wafer_order") -> DataFrame:
    """(lot_number, permutation, aurc): every order of measuring the lots of at most ``most`` wafers; larger lots are left out."""
    w = Window.partitionBy("lot_number")
    small = wafers.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") <= most)
    lots = small.groupBy("lot_number").agg(F.array_sort(F.collect_list(F.struct(order, F.col(error).cast("double").alias("e")))).alias("w"))
    lots = spread(written(lots.select("lot_number", F.size("w").alias("_n"), F.col("w.e").alias("e")), "small-lots"), "lot_number")
    out = None
    for n in sorted(r[0] for r in lots.select("_n").distinct().collect()):  # at most 8 sizes; a row a lot and order, n! of each
        orders = rankings(wafers.sparkSession, n).groupBy("permutation").agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("p"))
        one = lots.filter(F.col("_n") == n).crossJoin(F.broadcast(orders)).select("lot_number", "permutation", _area([F.col("e")[F.col("p")[i]["item"]] for i in range(n)]).alias("aurc"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else wafers.limit(0).select("lot_number", F.lit(0).alias("permutation"), F.col(error).cast("double").alias("aurc"))


def _area(errors: Sequence[Column]) -> Column:
    """``aurc`` of one lot from its errors in the order of measuring."""
    def mean(some: Sequence[Column]) -> Column:
        total, count = F.lit(0.0), F.lit(0)
        for x in some:
            total, count = total + F.coalesce(x, F.lit(0.0)), count + x.isNotNull().cast("int")
        return total / F.when(count > 0, count)

    if len(errors) == 1:
        return errors[0]
    risks = [mean(errors[i:]) for i in range(len(errors))]
    total = F.lit(0.0)
    for x in risks:
        total = total + F.coalesce(x, F.lit(0.0))
    return F.when(risks[0].isNotNull(), (total - (F.coalesce(risks[0], F.lit(0.0)) + F.coalesce(risks[-1], F.lit(0.0))) / 2) / (len(errors) - 1))


def score_correlations(scores_long: DataFrame, by: Sequence[str], key: str = "experiment_key") -> DataFrame:
    """(by, score_a, score_b, n, spearman) of every pair of scores(by, key, score, value)."""
    a = scores_long.select(*by, key, F.col("score").alias("score_a"), F.col("value").alias("a"))
    b = scores_long.select(*by, key, F.col("score").alias("score_b"), F.col("value").alias("b"))
    return spearman(a.join(b, [*by, key]).filter("score_a < score_b"), "a", "b", [*by, "score_a", "score_b"])


def policy_influence(lot_summary: DataFrame, excluded_lot: int = 8, baseline: str = "random") -> DataFrame:
    """A row for each policy and removed lot ('none' too): macro AURC against the baseline's. The median difference is over all lots, removed or not.

    A lot's baseline is taken from the same rows, not from a second run of ``lot_summary``, whose sums could differ in their last bits.
    """
    own = Window.partitionBy("lot_number")
    base = F.col("policy") == baseline
    p = lot_summary.withColumns({"_base": F.max(F.when(base, F.col("aurc"))).over(own), "_has": F.max(base.cast("int")).over(own)}).filter("_has = 1").drop("_has")
    median = p.groupBy("policy").agg(F.median(F.col("aurc") - F.col("_base")).alias("median_policy_minus_random"))
    lots = lot_summary.select(F.col("lot_number").alias("_removed")).distinct()
    removed = lots.select("_removed", F.col("_removed").cast("string").alias("removed_lot")).unionByName(lots.sparkSession.range(1).select(F.lit(None).cast("int").alias("_removed"), F.lit("none").alias("removed_lot")))
    j = p.join(removed, F.col("_removed").isNull() | (F.col("lot_number") != F.col("_removed")))
    g = j.groupBy("policy", "removed_lot").agg(F.avg("aurc").alias("macro_aurc"), F.avg("_base").alias("macro_random_aurc"), (1 - safe_divide(F.avg("aurc"), F.avg("_base"))).alias("relative_reduction_vs_random"), F.max("aurc").alias("worst_lot_aurc"), F.count_if(F.col("aurc") > F.col("_base")).alias("lots_worse_than_random"))
    return g.join(median, "policy").withColumn("excluded_lot_of_interest", F.lit(excluded_lot))


def weight_selection(percentiles: DataFrame, grid: DataFrame, components: Sequence[str], by: Sequence[str] = ("held_out_lot",), inner: str = "lot_number", error: str = "error", order: str = "experiment_key") -> DataFrame:
    """(by, weights, aurc): the weights of the grid with the least mean AURC over the inner lots; ties to the first of the grid."""
    w = percentiles.crossJoin(F.broadcast(grid))
    score = F.lit(0.0)
    for i, c in enumerate(components):
        score = score + F.col("weights")[i] * F.col(c)
    a = aurc(w.withColumn("_score", score), "_score", error, [*by, "grid_index", inner], order)
    m = a.groupBy(*by, "grid_index").agg(F.avg("aurc").alias("aurc")).join(F.broadcast(grid), "grid_index")
    return m.groupBy(*by).agg(F.min_by("weights", F.struct("aurc", "grid_index")).alias("weights"), F.min("aurc").alias("aurc"))


def quota_decisions(scores: Column, budget: Column | float, threshold: Column | float) -> Column:
    """array<boolean>: which of the ordered scores are measured online.

    The quota is rint(budget n), n at most. A wafer is taken if without it the quota could not be met any more, or if
    its score is at the threshold and the share so far stays within the budget, rounded up.
    """
    budget = budget if isinstance(budget, Column) else F.lit(float(budget))
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    n = F.size(scores)
    total = F.least(rint(budget * n), n)
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("i"), F.array().cast("array<boolean>").alias("f"))

    def step(s: Column, x: Column) -> Column:
        forced = s["c"] < total - (n - s["i"] - 1)
        cap = F.least(total, F.ceil(budget * (s["i"] + 1)).cast("int"))
        take = (s["c"] < total) & (forced | ((x >= threshold) & (s["c"] < cap)))
        return F.struct((s["c"] + take.cast("int")).alias("c"), (s["i"] + 1).alias("i"), F.concat(s["f"], F.array(take)).alias("f"))

    return F.aggregate(scores, start, step, lambda s: s["f"])


def causal_selection(wafers: DataFrame, budgets: Sequence[float], thresholds: DataFrame | None = None, score: str = "score", by: Sequence[str] = ("lot_number",), order: str = "wafer_order", block: int | None = None) -> DataFrame:
    """Each wafer for each budget with ``measured``, decided as ``quota_decisions`` does. thresholds: (by, budget, threshold), or a wafer's score at 1 - budget by default.

    Lots are scanned in blocks: a block hands on how many wafers it leaves taken, a step function of how many were
    before it. ``order`` tells the wafers of a lot apart.
    """
    g = wafers.select(*by, order, F.col(score).cast("double").alias("_v")).withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    g = g.join(thresholds, [*by, "budget"]) if thresholds is not None else g.withColumn("threshold", 1 - F.col("budget"))

    def limit(g: pd.DataFrame) -> np.ndarray:
        return scan.limits(g["_v"].to_numpy(float), g["_i"].to_numpy(), int(g["_n"].iloc[0]), float(g["budget"].iloc[0]), float(g["threshold"].iloc[0]))

    types = {f.name: f.dataType.simpleString() for f in g.schema}
    kinds = ", ".join([*(f"`{c}` {types[c]}" for c in (*by, order)), "budget double", f"threshold {types['threshold']}", "measured boolean"])
    decided = scan.scanned(
        g, [*by, "budget"], [order], lambda g: scan.steps_of(limit(g)), lambda carry, s: scan.counted(carry or 0, s),
        lambda g, carry: g[[*by, order, "budget", "threshold"]].assign(measured=scan.taken(limit(g), carry or 0)), kinds, block)
    return wafers.join(decided, [*by, order])


def bias_feedback(selected: DataFrame, alpha: float, shift: str = "shift", by: Sequence[str] = ("lot_number", "budget"), order: str = "wafer_order", block: int | None = None) -> DataFrame:
    """Adds ``bias``, what a prediction is corrected by: an exponential mean of the shifts of the wafers measured before it.

    Scanned in blocks: a block makes an affine map of the bias that comes into it.
    """

    def taught(g: pd.DataFrame) -> np.ndarray:
        return g.loc[g["measured"], "_v"].to_numpy(float)

    def summary(g: pd.DataFrame) -> tuple[float, float]:
        v = taught(g)
        return (1 - alpha) ** len(v), float(scan.decayed(v, alpha, 0.0)[-1])

    def apply(g: pd.DataFrame, carry) -> pd.DataFrame:
        run = scan.decayed(taught(g), alpha, carry or 0.0)
        learnt = np.concatenate([[0], np.cumsum(g["measured"].to_numpy(bool))[:-1]]).astype(int)
        return g[[*by, order]].assign(bias=run[learnt])

    types = {f.name: f.dataType.simpleString() for f in selected.schema}
    kinds = ", ".join([*(f"`{c}` {types[c]}" for c in (*by, order)), "bias double"])
    rows = selected.select(*by, order, F.col(shift).cast("double").alias("_v"), "measured")
    b = scan.scanned(rows, by, [order], summary, lambda carry, s: s[0] * (carry or 0.0) + s[1], apply, kinds, block)
    return selected.join(b, [*by, order])


def stream_metrics(wafers: DataFrame, threshold: Column | float, by: Sequence[str], true_error: str = "true_error", system_error: str = "system_error", order: str = "wafer_order") -> DataFrame:
    """Errors of a replayed lot, which of its worst fifth was measured, when its error first passed the threshold and how long it stayed there."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    w = Window.partitionBy(*by)
    r = wafers.withColumns({"_limit": limit, "_n": F.count("*").over(w), "_worst": F.row_number().over(w.orderBy(F.desc(true_error), order))})
    r = r.withColumn("_onset", F.min(F.when(F.col(true_error) > F.col("_limit"), F.col(order))).over(w))
    back = F.min(F.when((F.col(order) > F.col("_onset")) & (F.col(true_error) <= F.col("_limit")), F.col(order)))
    k = F.greatest(F.lit(1), F.ceil(0.2 * F.first("_n")))
    high = F.col("_worst") <= F.greatest(F.lit(1), F.ceil(0.2 * F.col("_n")))
    m = F.col("measured")
    return r.groupBy(*by).agg(
        F.avg(system_error).alias("total_system_mae"), F.avg(F.when(~m, F.col(true_error))).alias("unmeasured_wafer_mae"), F.avg(m.cast("double")).alias("measured_fraction"), (F.count_if(high & m) / k).alias("high_error_capture"),
        F.percentile(system_error, F.lit(0.95)).alias("p95_system_error"), F.sum(system_error).alias("cumulative_system_error"), F.count_if(m).alias("measured_wafers"), F.first("_limit").alias("drift_error_threshold"),
        F.first("_onset").cast("long").alias("drift_onset_wafer_order"), F.when(F.first("_onset").isNotNull(), F.coalesce(back - F.first("_onset"), F.first("_n") - F.first("_onset") + 1)).cast("long").alias("recovery_wafer_count"),
    )


def top_selection(wafers: DataFrame, budgets: Sequence[float], score: str = "score", by: Sequence[str] = ("lot_number",), order: str = "wafer_order") -> DataFrame:
    """Ranking of the whole lot: ``measured`` for the rint(budget n) largest scores, all at most."""
    r = _ranked(wafers, score, by, order).withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    return r.withColumn("measured", F.col("_rn") <= F.least(rint(F.col("budget") * F.col("_n")), F.col("_n").cast("int"))).drop("_rn", "_n")
