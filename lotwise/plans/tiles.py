"""Gaussian processes of folds that no task can hold: exact, their matrices by tiles in the shared folder (L3, L4).

Wafers are dealt into parts of their lots; a tile is the matrix of two parts. Below the training parts' rows follow those
of the outputs and, where deviations are wanted, of the test parts, so that one factorisation by block columns gives means
and deviations: a test row's tiles times the outputs', and their squares. Inner folds want means alone, which take weights
of the training wafers, solved from the last column back. A task holds one tile and maps those that it takes off, whatever the fold's
size; a column's tiles are spread over all cores. One factorisation serves all lots that its wafers leave out, and both
stages. Tiles go when their means are known, so the folder holds ``TILE_BYTES``, or one process's tiles if they are more.
Where parameters are fitted, shift and residual have processes of their own, and likelihoods come from the same tiles: a
round of all ascents is a factorisation of all points that they ask for.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.kernels import evaluate, gaussian
from lotwise.sources.shared import new_dir, removed, spread, written

TILE_BYTES = 16 << 30


def _saved(path: str, values: np.ndarray) -> None:
    """Whole or not at all, for tasks that are run again."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, path)


@dataclass(frozen=True)
class Process:
    """A fold's process. Rows of its matrix are ``train`` parts, then ``test`` parts, then the outputs; parts are (lot, part, wafers)."""

    folder: str
    wafers: str
    plan: gaussian.Plan
    components: np.ndarray
    train: tuple
    test: tuple
    deviations: bool
    shifts: int = 1  # of the outputs those that are shifts; components follow
    fits: gaussian.Settings | None = None  # where parameters are fitted, what they start from

    @property
    def bytes(self) -> int:
        own, below = [p[2] for p in self.train], sum(p[2] for p in self.test) if self.deviations else 0
        return 8 * sum(n * (sum(own[i:]) + below) for i, n in enumerate(own))

    def rows(self, j: int) -> list[int]:
        """Of a column's tiles those below its first."""
        return [*range(j + 1, len(self.train) + (len(self.test) if self.deviations else 0)), len(self.train) + len(self.test)]

    def tile(self, i: int, j: int) -> np.ndarray:
        return np.load(f"{self.folder}/{i}-{j}.npy", mmap_mode="r")

    def part(self, i: int, what: str) -> np.ndarray:
        lot, part, _ = (self.train + self.test)[i]
        return np.load(f"{self.wafers}/{lot}-{part}-{what}.npy")

    def left(self, i: int, j: int) -> np.ndarray:
        """A tile less what the columns before it explain."""
        if i == len(self.train) + len(self.test):
            a = self.plan.outputs(self.part(j, "map")).T.copy()
        else:
            a = self.plan.kernel(self.part(i, "x"), self.part(j, "x"), i == j)
        for k in range(j):
            a -= self.tile(i, k) @ self.tile(j, k).T
        return a

    def head(self, j: int) -> None:
        """The column's first tile is factored; what follows takes its inverse. Parameters that are tried may have no factor."""
        a = self.left(j, j)
        try:
            lower = np.linalg.cholesky(a)
        except np.linalg.LinAlgError:
            if not self.fits:
                raise
            lower = np.full(a.shape, np.nan)
        _saved(f"{self.folder}/{j}-{j}.npy", lower)
        _saved(f"{self.folder}/{j}-inverse.npy", np.linalg.solve(lower, np.eye(len(lower))))

    def below(self, i: int, j: int) -> None:
        _saved(f"{self.folder}/{i}-{j}.npy", self.left(i, j) @ np.load(f"{self.folder}/{j}-inverse.npy").T)

    def weigh(self, j: int) -> None:
        """The weights of a training part, after those behind it."""
        a = self.tile(len(self.train) + len(self.test), j).T.copy()
        for i in range(j + 1, len(self.train)):
            a -= self.tile(i, j).T @ np.load(f"{self.folder}/{i}-weights.npy")
        _saved(f"{self.folder}/{j}-weights.npy", np.load(f"{self.folder}/{j}-inverse.npy").T @ a)

    def likelihood(self) -> tuple[float, float]:
        """``gaussian.profile`` at the point that is tried."""
        last, heads = len(self.train) + len(self.test), range(len(self.train))
        squares = sum(float((self.tile(last, j) ** 2).sum()) for j in heads)
        logs = sum(float(np.log(np.diag(self.tile(j, j))).sum()) for j in heads)
        return gaussian.profile(squares, logs, sum(p[2] for p in self.train), self.plan.targets.shape[1], self.plan.theta[2])

    def predicted(self, at: int) -> tuple[np.ndarray, np.ndarray | None]:
        """(means, standard deviations if wanted) of a test part, rows by outputs."""
        i, last = len(self.train) + at, len(self.train) + len(self.test)
        mean, explained = 0.0, 0.0
        for j in range(len(self.train)):
            if self.deviations:
                v = np.array(self.tile(i, j))
                mean, explained = mean + v @ self.tile(last, j).T, explained + (v**2).sum(axis=1)
            else:
                mean = mean + self.plan.kernel(self.part(i, "x"), self.part(j, "x")) @ np.load(f"{self.folder}/{j}-weights.npy")
        return mean * self.plan.y_scale, self.plan.deviations(explained) if self.deviations else None


def _each(spark: SparkSession, items: Sequence, run: Callable[..., list[tuple]], kinds: str) -> DataFrame:
    """``run(*item)`` of each item, spread over all cores; its rows."""
    names = [c.split()[0] for c in kinds.split(", ")]

    def rows(batches):
        for b in batches:
            for n in b["id"]:
                yield pd.DataFrame(run(*items[n]), columns=names)

    return spark.range(0, len(items), 1, min(len(items), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(rows, kinds)


def _factored(spark: SparkSession, processes: Sequence[Process]) -> None:
    def done(step: Callable, items: list) -> None:
        if items:
            _each(spark, items, lambda *item: [] if step(*item) else [(1,)], "n int").count()

    for p in processes:
        os.makedirs(p.folder)
    for j in range(max(len(p.train) for p in processes)):
        some = [p for p in processes if j < len(p.train)]
        done(lambda p, j: p.head(j), [(p, j) for p in some])
        done(lambda p, i, j: p.below(i, j), [(p, i, j) for p in some for i in p.rows(j)])
    for j in reversed(range(max(len(p.train) for p in processes))):
        done(lambda p, j: p.weigh(j), [(p, j) for p in processes if j < len(p.train) and not p.deviations and not p.fits])


def _fitted(spark: SparkSession, processes: Sequence[Process]) -> dict[str, Process]:
    """Those whose parameters are fitted, with them, by folder. A process hands on two numbers a point."""
    climbs = {p.folder: (p, gaussian.ascent(p.fits)) for p in processes if p.fits}
    asked, out = {at: next(climb) for at, (_, climb) in climbs.items()}, {}
    while asked:
        units = [(at, [replace(climbs[at][0], folder=f"{at}-{i}", plan=replace(climbs[at][0].plan, theta=(1.0, *point)), test=(), deviations=False)]) for at, some in asked.items() for i, point in enumerate(some)]
        found: dict = {}
        for batch in _batches(units):
            _factored(spark, [p for _, (p,) in batch])
            told = _each(spark, [(n, p) for n, (_, (p,)) in enumerate(batch)], lambda n, p: [(n, *p.likelihood())], "unit int, value double, constant double").collect()
            told = {n: value for n, *value in told}
            for n, (at, (p,)) in enumerate(batch):
                found.setdefault(at, []).append(tuple(told[n]))
                removed(spark, f"file://{p.folder}")
        asked = {}
        for at, values in found.items():
            p, climb = climbs[at]
            try:
                asked[at] = climb.send(values)
            except StopIteration as best:
                out[at] = replace(p, plan=replace(p.plan, theta=best.value), fits=None)
    return out


def _dealt(parts, at: str) -> dict:
    """Writes the parts' features, maps and keys; (lot, part, wafers) by ablation, a row for each part."""
    ablations = sorted(r[0] for r in parts.lots.select("ablation").distinct().collect())
    for i in range(len(ablations)):
        os.makedirs(f"{at}/{i}")

    def write(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("experiment_key")
        name, lot, part = g["ablation"].iloc[0], int(g["lot_number"].iloc[0]), int(g["part"].iloc[0])
        to = f"{at}/{ablations.index(name)}/{lot}-{part}"
        for what in ("x", "map"):
            _saved(f"{to}-{what}.npy", np.stack(g[what].to_numpy()).astype(float))
        _saved(f"{to}-key.npy", g["experiment_key"].to_numpy().astype(str))
        return pd.DataFrame([(name, lot, part, len(g))], columns=["ablation", "lot", "part", "wafers"])

    found: dict = {}
    for r in sorted(spread(parts.wafers, *parts.by).groupBy(*parts.by).applyInPandas(write, "ablation string, lot int, part int, wafers long").collect()):
        found.setdefault(r[0], (f"{at}/{ablations.index(r[0])}", {}))[1].setdefault(r[1], []).append((r[1], r[2], int(r[3])))
    return found


def _batches(units: Sequence[tuple[object, list[Process]]]) -> list[list]:
    out, size = [], 0
    for u in units:
        own = sum(p.bytes for p in u[1])
        if not out or size + own > TILE_BYTES:
            out.append([])
            size = 0
        out[-1].append(u)
        size += own
    return out


def process_folds(parts, moments: Mapping[str, evaluate.LotMoments], settings: Sequence[gaussian.Settings], forward: bool, least: int, share: float, most: int, emit: Callable, facts: str) -> DataFrame:
    """The facts of every outer fold, as ``evaluate.run_fold`` gives them. ``moments`` has a row of each lot."""
    spark = parts.wafers.sparkSession
    at = new_dir(spark, "tiles")
    dealt = _dealt(parts, at)
    held_out = sorted({n for w in moments.values() for n in w.names})[least if forward else 0 :]
    folds = [(a, held, tuple(n for n in w.names if (n < held if forward else n != held))) for a, w in moments.items() for held in w.names if held in held_out]

    def process(a: str, lots: tuple, s: gaussian.Settings, test: Sequence, deviations: bool, shifts: bool = True, scores: bool = True) -> Process:
        t = moments[a].training(lots)
        components, _ = t.components(share, most)
        folder, own = dealt[a]
        targets = np.hstack([t.targets(c) for c, wanted in ((None, shifts), (components, scores)) if wanted])
        return Process(f"{at}/{uuid.uuid4().hex}", folder, gaussian.plan(t, s, targets), components, tuple(p for n in lots for p in own[n]), tuple(p for n in test for p in own[n]), deviations, int(shifts), s if s.optimize else None)

    def pair(a: str, lots: tuple, i: int, j: int, test: Sequence, deviations: bool) -> list[Process]:
        """[of the shift, of the residual's components], or the one that serves both."""
        if i == j and not settings[i].optimize:
            return [process(a, lots, settings[i], test, deviations)]
        return [process(a, lots, settings[i], test, deviations, scores=False), process(a, lots, settings[j], test, deviations, shifts=False)]

    def known(units: list) -> list:
        fitted = _fitted(spark, [p for _, some in units for p in some])
        return [(u, [fitted.get(p.folder, p) for p in some]) for u, some in units]

    # Inner folds: a set of training lots is met once, whichever folds it belongs to.
    left: dict = {}
    for a, _, train in folds:
        for n in train:
            left.setdefault((a, tuple(x for x in train if x != n)), set()).add(n)
    units = known([((a, lots, i), pair(a, lots, i, i, sorted(out), False)) for (a, lots), out in left.items() for i in range(len(settings))])
    totals: dict = {}

    def scored(place: int, by_shift: Process, by_scores: Process, k: int) -> list[tuple]:
        row, t = len(by_shift.train) + k, by_shift.plan.training
        shift = by_shift.predicted(k)[0]
        scores = shift if by_scores is by_shift else by_scores.predicted(k)[0]
        maps = by_shift.part(row, "map")
        return [(place, by_shift.test[k][0], k, len(maps), float(np.abs(shift[:, 0] - t.shift(maps)).sum()), float(((scores[:, by_scores.shifts :] @ by_scores.components - t.residual(maps)) ** 2).mean(axis=1).sum()))]

    for batch in _batches(units):
        _factored(spark, [p for _, some in batch for p in some])
        items = [(u, some[0], some[-1], k) for u, (_, some) in enumerate(batch) for k in range(len(some[0].test))]
        found = _each(spark, items, scored, "unit int, lot int, part int, wafers long, shift double, residual double").groupBy("unit", "lot").agg(F.sum("wafers"), F.array_sort(F.collect_list(F.struct("part", "shift", "residual"))))
        for u, lot, wafers, sums in found.collect():  # a row for each lot
            totals[(*batch[u][0], lot)] = (sum(x["shift"] for x in sums) / wafers, np.sqrt(sum(x["residual"] for x in sums) / wafers))
        for p in (p for _, some in batch for p in some):
            removed(spark, f"file://{p.folder}")

    units = []
    for a, held, train in folds:
        each = [[totals[a, tuple(x for x in train if x != n), i, n] for n in train] for i in range(len(settings))]
        (shift_error, _, i), (residual_error, _, j) = (min((float(np.mean([e[stage] for e in one])), settings[i].label, i) for i, one in enumerate(each)) for stage in (0, 1))
        told = evaluate.fold_facts(moments[a], train, "gpr", settings[i], settings[j], shift_error, residual_error, moments[a].own[held].count, share, most)[0]
        units.append(((a, held, told), pair(a, train, i, j, [held], True)))
    units = known(units)

    def final(a: str, held: int, told: dict, by_shift: Process, by_scores: Process, k: int) -> list[tuple]:
        t, row = by_shift.plan.training, len(by_shift.train) + k
        shift, shift_sd = by_shift.predicted(k)
        scores, score_sd = (shift, shift_sd) if by_scores is by_shift else by_scores.predicted(k)
        keys, maps = by_shift.part(row, "key"), by_shift.part(row, "map")
        stages, stds = evaluate.staged(t, by_scores.components, maps, shift[:, :1], shift_sd[:, :1], scores[:, by_scores.shifts :], score_sd[:, by_scores.shifts :])
        g = pd.DataFrame({"experiment_key": keys, "lot_number": held})
        return list(emit(g, np.ones(len(g), bool), held, "gpr", a, evaluate.Fold(stages, stds, told), maps).itertuples(index=False, name=None))

    out = None
    for batch in _batches(units):
        _factored(spark, [p for _, processes in batch for p in processes])
        one = written(_each(spark, [(*u, processes[0], processes[-1], k) for u, processes in batch for k in range(len(processes[0].test))], final, facts), "process-facts")
        out = one if out is None else out.unionByName(one)
        for p in (p for _, processes in batch for p in processes):
            removed(spark, f"file://{p.folder}")
    return spark.createDataFrame([], facts) if out is None else out
