"""Replay grids of policies over wafer errors, their summaries, intervals and gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.operators import replay
from lotwise.queries.policies import _PERIODIC, FACTS, SEED, _draws, facts
from lotwise.queries.registry import dr6, query, r6

#: Scores of the proxy wafers: the size of the residual, that of the shift, and the error itself.
POLICIES = ("combined", "ood", "oracle")
REPLICATES = 100
_MEANS = ("total_system_mae", "unmeasured_wafer_mae", "measured_fraction", "high_error_capture", "p95_system_error", "cumulative_system_error")
_SAME = "(SELECT CAST(unnest([0.0, 0.1, 0.2, 0.3, 0.5]) AS DOUBLE) AS b)"

_GRID = "WITH RECURSIVE " + FACTS.replace("WITH ", "") + f""", sized AS (SELECT *, CAST(count(*) OVER (PARTITION BY lot_number) AS INTEGER) AS n FROM facts),
own AS (SELECT lot_number, wafer_order, error, n, unnest(['combined', 'ood', 'oracle']) AS policy, 0 AS replicate, unnest([score / max(score) OVER w, abs(shift) / max(abs(shift)) OVER w, cume_dist() OVER (PARTITION BY lot_number ORDER BY error)]) AS s FROM sized WINDOW w AS (PARTITION BY lot_number)),
drawn AS (SELECT lot_number, wafer_order, error, n, 'random' AS policy, replicate, ('0x' || substr(md5(concat_ws('-', {SEED}, replicate, experiment_key)), 1, 8))::BIGINT % 4294967296 / 4294967296.0 AS s FROM sized CROSS JOIN (SELECT unnest(range({REPLICATES})) AS replicate)),
bs AS (SELECT p.*, b, CAST(least(round_even(b * n, 0), n) AS INTEGER) AS total FROM (SELECT * FROM own UNION ALL SELECT * FROM drawn) p CROSS JOIN {_SAME}),
q AS (SELECT lot_number, policy, replicate, b, 0 AS i, 0 AS c, false AS measured FROM (SELECT DISTINCT lot_number, policy, replicate, b FROM bs) UNION ALL
  SELECT q.lot_number, q.policy, q.replicate, q.b, q.i + 1, q.c + CAST((q.c < total AND (q.c < total - (n - q.i - 1) OR (s >= 1 - q.b AND q.c < least(total, ceil(q.b * (q.i + 1)))))) AS INTEGER), (q.c < total AND (q.c < total - (n - q.i - 1) OR (s >= 1 - q.b AND q.c < least(total, ceil(q.b * (q.i + 1))))))
  FROM q JOIN bs ON bs.lot_number = q.lot_number AND bs.policy = q.policy AND bs.replicate = q.replicate AND bs.b = q.b AND bs.wafer_order = q.i + 1),
plain AS (SELECT *, unnest(['ranking_only', 'direct_substitution']) AS mode FROM (SELECT lot_number, wafer_order, error, n, b, unnest(['no_metrology', 'periodic']) AS policy, unnest([false, list_contains({_PERIODIC.format(k='least(round_even(b * n, 0), n)')}, wafer_order - 1)]) AS measured FROM sized CROSS JOIN {_SAME})),
cells AS (SELECT 'direct_substitution' AS mode, bs.lot_number, bs.policy, bs.replicate, bs.b, bs.wafer_order, error, n, q.measured FROM bs JOIN q ON bs.lot_number = q.lot_number AND bs.policy = q.policy AND bs.replicate = q.replicate AND bs.b = q.b AND bs.wafer_order = q.i
  UNION ALL SELECT 'ranking_only', lot_number, policy, 0, b, wafer_order, error, n, row_number() OVER (PARTITION BY lot_number, policy, b ORDER BY s DESC, wafer_order) <= total FROM bs WHERE policy <> 'random'
  UNION ALL SELECT mode, lot_number, policy, 0, b, wafer_order, error, n, measured FROM plain),
st AS (SELECT *, CASE WHEN measured THEN 0 ELSE error END AS sys, row_number() OVER (PARTITION BY mode, lot_number, policy, replicate, b ORDER BY error DESC, wafer_order) AS worst FROM cells),
streams AS (SELECT mode, lot_number, policy, replicate, b AS budget, avg(sys) AS total_system_mae, avg(error) FILTER (NOT measured) AS unmeasured_wafer_mae, avg(CAST(measured AS INTEGER)) AS measured_fraction, count(*) FILTER (measured AND worst <= greatest(1, ceil(0.2 * n))) / greatest(1, ceil(0.2 * any_value(n))) AS high_error_capture, quantile_cont(sys, 0.95) AS p95_system_error, sum(sys) AS cumulative_system_error FROM st GROUP BY ALL),
lots AS (SELECT mode, lot_number, policy, budget, {', '.join(f'avg({c}) AS {c}' for c in _MEANS)}, count(DISTINCT replicate) AS random_replicates FROM streams GROUP BY ALL)"""

_PAIRS = f""", pairs AS (SELECT lot_number, budget, round(max(total_system_mae) FILTER (policy = 'combined'), 9) AS own, round(max(total_system_mae) FILTER (policy = 'random'), 9) AS other FROM lots WHERE mode = 'direct_substitution' GROUP BY ALL),
num AS (SELECT *, own - other AS d, row_number() OVER (PARTITION BY budget ORDER BY lot_number) - 1 AS i FROM pairs), {_draws("(SELECT DISTINCT lot_number FROM pairs)", "n")},
boot AS (SELECT budget, rep, avg(d) AS s FROM draws JOIN num USING (i) GROUP BY ALL),
diff AS (SELECT budget, avg(s) AS bootstrap_mean, quantile_cont(s, 0.025) AS p025, quantile_cont(s, 0.975) AS p975, avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END) AS probability_negative FROM boot GROUP BY budget)"""


def lots(spark, sf):
    w = Window.partitionBy("lot_number")
    f = facts(spark, sf).withColumns({"combined": F.col("score") / F.max("score").over(w), "ood": F.abs("shift") / F.max(F.abs("shift")).over(w), "oracle": F.cume_dist().over(w.orderBy("error")), "true_error": F.col("error")})
    return replay.lot_summary(replay.streams(f, POLICIES, replicates=REPLICATES))


@query("replay_lot_summary", _GRID + f" SELECT mode, lot_number, policy, budget, {', '.join(map(dr6, _MEANS))}, random_replicates FROM lots")
def replay_lot_summary(spark, sf):
    return lots(spark, sf).select("mode", "lot_number", "policy", "budget", *map(r6, _MEANS), "random_replicates")


_POLICY = {"lot_macro_system_mae": "avg(total_system_mae)", "lot_macro_unmeasured_mae": "avg(unmeasured_wafer_mae)", "mean_measured_fraction": "avg(measured_fraction)", "mean_high_error_capture": "avg(high_error_capture)", "worst_lot_mae": "max(total_system_mae)", "mean_p95_system_error": "avg(p95_system_error)", "cumulative_error": "sum(cumulative_system_error)"}


@query("replay_policy_summary", _GRID + f" SELECT mode, policy, budget, {', '.join(dr6(v, k) for k, v in _POLICY.items())} FROM lots GROUP BY mode, policy, budget")
def replay_policy_summary(spark, sf):
    return replay.policy_summary(lots(spark, sf)).select("mode", "policy", "budget", *map(r6, _POLICY))


@query("replay_policy_difference", _GRID + _PAIRS + f" SELECT budget, {dr6('bootstrap_mean')}, {dr6('p025')}, {dr6('p975')}, {dr6('probability_negative')}, (SELECT {dr6('avg(d)', 'o').removesuffix(' AS o')} FROM num WHERE num.budget = diff.budget) AS observed_mean_difference FROM diff")
def replay_policy_difference(spark, sf):
    d = replay.policy_difference(lots(spark, sf))
    return d.select("budget", *map(r6, ("bootstrap_mean", "p025", "p975", "probability_negative", "observed_mean_difference")))


@query("replay_policy_gate", _GRID + _PAIRS + f""", low AS (SELECT budget, 1 - avg(own) / nullif(avg(other), 0) AS gain, avg(CASE WHEN own <= other THEN 1.0 ELSE 0.0 END) AS wins, avg(other - own) FILTER (lot_number <> 3) AS wo, max(own) / nullif(max(other), 0) - 1 AS worst FROM pairs WHERE budget IN (0.1, 0.2, 0.3) GROUP BY budget),
checks AS (SELECT count(*) FILTER (gain > 0) AS better_budgets, count(*) FILTER (p975 < 0) AS negative_intervals, max(wins) AS largest_win_share, count(*) FILTER (wo > 0) AS better_without_lot, max(worst) AS worst_change FROM low LEFT JOIN diff USING (budget))
SELECT better_budgets, negative_intervals, {dr6('largest_win_share')}, better_without_lot, {dr6('worst_change')}, CASE WHEN better_budgets >= 2 AND negative_intervals >= 2 AND largest_win_share >= 0.7 AND better_without_lot >= 2 AND worst_change <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS gate FROM checks""")
def replay_policy_gate(spark, sf):
    x = lots(spark, sf)
    return replay.gate(x, replay.policy_difference(x), without_lot=3).select("better_budgets", "negative_intervals", r6("largest_win_share"), "better_without_lot", r6("worst_change"), "gate")
