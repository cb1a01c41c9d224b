"""Replays of measurement policies over lots (C8-C12): streams of policies, modes, budgets and random replicates, and what they sum up to."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.stats import safe_divide
from lotwise.kernels import policies as kernel
from lotwise.operators import resample
from lotwise.sources.shared import spread

#: Budgets of the grid, and those that the gate looks at.
BUDGETS, GATE_BUDGETS = (0.0, 0.1, 0.2, 0.3, 0.5), (0.1, 0.2, 0.3)
MEANS = ("total_system_mae", "unmeasured_wafer_mae", "measured_fraction", "high_error_capture", "p95_system_error", "cumulative_system_error", "drift_error_threshold", "drift_onset_wafer_order", "recovery_wafer_count")
STREAMS = "lot_number int, mode string, policy string, budget double, replicate long, " + ", ".join(f"{c} {'long' if c == 'measured_wafers' else 'double'}" for c in kernel.METRICS) + ", drift_error_threshold double, drift_onset_wafer_order long, recovery_wafer_count long"
#: Random replicates that one task draws of a lot, at most, and over how many tasks fewer are spread.
PART, TASKS = 1000, 16


def streams(wafers: DataFrame, policies: Sequence[str], budgets: Sequence[float] = BUDGETS, replicates: int = 100, seed: int = 20260721, lot: str = "lot_number", order: str = "wafer_order", key: str = "experiment_key", error: str = "true_error") -> DataFrame:
    """(lot_number, mode, policy, budget, replicate, metrics): a row a stream of decisions, not a row a wafer of it.

    ``wafers`` has a column of scores for each of ``policies``, and may have drift_error_threshold. Modes:
    'direct_substitution' decides wafer by wafer under a quota, the threshold being 1 - budget; 'ranking_only' by the
    ranks of the whole lot. 'no_metrology' and 'periodic' are the same in both; 'random' is drawn anew in each replicate
    and decides directly. A measured wafer has no system error. A task holds one lot's scores and steps through its
    wafers with its streams side by side, 64 or more at once; of random replicates it draws a range by their keys.
    """
    limit = F.col("drift_error_threshold") if "drift_error_threshold" in wafers.columns else F.lit(None)
    own = wafers.select(F.col(lot).cast("int").alias("lot"), F.col(order).alias("o"), F.col(key).cast("string").alias("k"), F.col(error).cast("double").alias("e"), limit.cast("double").alias("limit"), F.array(*[F.col(p).cast("double") for p in policies]).alias("s"))
    each = max(1, min(PART, -(-replicates // TASKS)))
    parts = 1 + -(-replicates // each)
    own = own.withColumn("part", F.explode(F.sequence(F.lit(-1), F.lit(parts - 2))) if parts > 1 else F.lit(-1))
    every = [float(b) for b in budgets]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("o", kind="stable")
        n, e, limit = len(g), g["e"].to_numpy(float), float(g["limit"].iloc[0]) if g["limit"].notna().iloc[0] else np.nan
        onset, recovery = kernel.drift(e, limit)
        out = []

        fit = max(1, kernel.CELLS // n)  # streams whose numbers are held at once

        def add(mode: str, names: Sequence[tuple[str, float, int]], measured: np.ndarray) -> None:
            for at in range(0, len(names), fit):
                some = names[at : at + fit]
                m = kernel.stream_metrics(measured[at : at + fit], e)
                out.append(pd.DataFrame({"lot_number": int(key[0]), "mode": mode, "policy": [x[0] for x in some], "budget": [x[1] for x in some], "replicate": [x[2] for x in some], **m}))

        def decided(mode: str, cells: Sequence[tuple[str, float, int]], scores) -> None:
            """Streams in blocks; ``scores`` gives those of some of them for a range of wafers."""
            online = mode == "direct_substitution"
            step = max(fit, kernel.STREAMS) if online else fit
            for at in range(0, len(cells), step):
                some = cells[at : at + step]
                b = np.array([x[1] for x in some])
                add(mode, some, kernel.quota_by_ranges(lambda lo, hi: scores(some, lo, hi), n, b, 1 - b) if online else kernel.ranked(scores(some, 0, n), b))

        if key[1] < 0:
            s = np.stack(g["s"].to_numpy()).astype(float).T.reshape(len(policies), n)
            cells = [(p, b, 0) for p in policies for b in every]
            for mode in ("direct_substitution", "ranking_only"):
                decided(mode, cells, lambda some, lo, hi: np.stack([s[policies.index(x[0]), lo:hi] for x in some]))
                for b in every:
                    add(mode, [("no_metrology", b, 0), ("periodic", b, 0)], np.stack([np.zeros(n, bool), kernel.periodic(n, b)]))
        else:
            # A replicate's draws serve all of its budgets.
            keys = g["k"].tolist()
            cells = [("random", b, r) for r in range(int(key[1]) * each, min((int(key[1]) + 1) * each, replicates)) for b in every]

            def draws(some: Sequence[tuple[str, float, int]], lo: int, hi: int) -> np.ndarray:
                reps = sorted({x[2] for x in some})
                d = kernel.keyed_draws(seed, reps, keys[lo:hi]) / float(1 << 32)
                return d[[x[2] - reps[0] for x in some]]

            decided("direct_substitution", cells, draws)
        made = pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in STREAMS.split(", ")])
        return made.assign(drift_error_threshold=limit, drift_onset_wafer_order=pd.array([onset] * len(made), "Int64"), recovery_wafer_count=pd.array([recovery] * len(made), "Int64"))

    policies = list(policies)
    rows = spread(own, "lot", "part").groupBy("lot", "part").applyInPandas(run, STREAMS)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("unmeasured_wafer_mae", "drift_error_threshold")})


def lot_summary(streams: DataFrame, by: Sequence[str] = ("lot_number", "mode", "policy", "budget")) -> DataFrame:
    """A row for each lot, mode, policy and budget: the metrics of its streams as means over replicates, and how many there are."""
    return streams.groupBy(*by).agg(*[F.avg(c).alias(c) for c in MEANS], F.countDistinct("replicate").alias("random_replicates"))


def policy_summary(lots: DataFrame, by: Sequence[str] = ("mode", "policy", "budget")) -> DataFrame:
    """A row for each mode, policy and budget: means over lots, the worst lot, the sum of errors."""
    return lots.groupBy(*by).agg(
        F.avg("total_system_mae").alias("lot_macro_system_mae"), F.avg("unmeasured_wafer_mae").alias("lot_macro_unmeasured_mae"), F.avg("measured_fraction").alias("mean_measured_fraction"), F.avg("high_error_capture").alias("mean_high_error_capture"),
        F.max("total_system_mae").alias("worst_lot_mae"), F.avg("p95_system_error").alias("mean_p95_system_error"), F.sum("cumulative_system_error").alias("cumulative_error"), F.avg("recovery_wafer_count").alias("mean_recovery_wafer_count"),
    )


def _side_by_side(lots: DataFrame, policy: str, base: str, lot: str) -> DataFrame:
    """(lot, budget, own, other): total errors of two policies that decide directly, to 9 places, so that equal ones are no different."""
    d = lots.filter((F.col("mode") == "direct_substitution") & F.col("policy").isin(policy, base))
    at = lambda p: F.round(F.max(F.when(F.col("policy") == p, F.col("total_system_mae"))), 9)
    return d.groupBy(F.col(lot).alias("lot_number"), "budget").agg(at(policy).alias("own"), at(base).alias("other"))


def policy_difference(lots: DataFrame, policy: str = "combined", base: str = "random", replicates: int = 10_000, seed: int = 20260721, lot: str = "lot_number") -> DataFrame:
    """(budget, observed_mean_difference, bootstrap_mean, p025, p975, probability_negative): the policy's error less the base's, lots drawn with replacement."""
    d = _side_by_side(lots, policy, base, lot).withColumn("d", F.col("own") - F.col("other"))
    i = resample.bootstrap_interval(resample.cluster_bootstrap(d, seed, replicates, "d", by=["budget"]), ["budget"])
    return i.join(d.groupBy("budget").agg(F.avg("d").alias("observed_mean_difference")), "budget")


def gate(lots: DataFrame, difference: DataFrame, without_lot: int = 8, budgets: Sequence[float] = GATE_BUDGETS, policy: str = "combined", base: str = "random", lot: str = "lot_number") -> DataFrame:
    """(better_budgets, negative_intervals, largest_win_share, better_without_lot, worst_change, gate): the five checks of a policy over the gate's budgets, and PASS if all hold."""
    d = _side_by_side(lots, policy, base, lot).filter(F.col("budget").isin(*budgets))
    others = F.when(F.col("lot_number") != without_lot, F.col("other") - F.col("own"))
    b = d.groupBy("budget").agg(
        (1 - safe_divide(F.avg("own"), F.avg("other"))).alias("gain"), F.avg((F.col("own") <= F.col("other")).cast("double")).alias("wins"), F.avg(others).alias("without"), (safe_divide(F.max("own"), F.max("other")) - 1).alias("worst"))
    b = b.join(difference.select("budget", "p975"), "budget", "left")
    s = b.agg(F.count_if(F.col("gain") > 0).alias("better_budgets"), F.count_if(F.col("p975") < 0).alias("negative_intervals"), F.max("wins").alias("largest_win_share"), F.count_if(F.col("without") > 0).alias("better_without_lot"), F.max("worst").alias("worst_change"))
    holds = (F.col("better_budgets") >= 2) & (F.col("negative_intervals") >= 2) & (F.col("largest_win_share") >= 0.70) & (F.col("better_without_lot") >= 2) & (F.col("worst_change") <= 0.10)
    return s.withColumn("gate", F.when(holds, "PASS").otherwise("FAIL"))
