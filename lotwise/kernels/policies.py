"""Measurement policies of one lot in numpy: keyed draws, areas of risk curves, online quotas, and what a stream adds up to."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np

#: Cells of a matrix (streams or orders by wafers) that are worked on at once.
CELLS = 400_000
#: Streams of a lot, at least, that step through its wafers together: with fewer for longer lots, time would grow with the square of a lot.
STREAMS = 64


def keyed_draws(seed: int, replicates: Sequence[int], keys: Sequence[str]) -> np.ndarray:
    """A 32-bit number for each (replicate, key): the first eight digits of the md5 of 'seed-replicate-key'.

    A draw depends on its seed, replicate and key alone, so any task can make any range of them.
    """
    encoded = [k.encode() for k in keys]
    out = bytearray()
    for r in replicates:
        start = md5(f"{seed}-{r}-".encode())
        for k in encoded:
            h = start.copy()
            h.update(k)
            out += h.digest()[:4]
    return np.frombuffer(bytes(out), ">u4").reshape(len(replicates), len(encoded))


def areas(errors: np.ndarray) -> np.ndarray:
    """The area under the curve of retained error of each row of errors in the order of measuring."""
    n = errors.shape[1]
    risk = np.cumsum(errors[:, ::-1], axis=1)[:, ::-1] / np.arange(n, 0, -1)
    return risk[:, 0] if n == 1 else (risk.sum(axis=1) - (risk[:, 0] + risk[:, -1]) / 2) / (n - 1)


def drawn_orders(seed: int, first: int, last: int, keys: Sequence[str], errors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(replicates, errors in the order of measuring) of replicates ``first`` to ``last`` - 1, some at a time: the largest draws come first, equal ones as they are."""
    step = max(1, CELLS // max(len(errors), 1))
    for at in range(first, last, step):
        some = np.arange(at, min(at + step, last))
        order = (np.int64(0xFFFFFFFF) - keyed_draws(seed, some.tolist(), keys).astype(np.int64)).argsort(axis=1, kind="stable")
        yield some, errors[order]


def quota(scores: np.ndarray, budgets: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Which wafers each stream measures: scores(stream, wafer) in order, a budget and threshold a stream.

    The quota is rint(budget n), n at most. A wafer is taken if without it the quota could not be met any more, or if
    its score is at the threshold and the share so far stays within the budget, rounded up. All streams step together.
    """
    return quota_by_ranges(lambda lo, hi: scores[:, lo:hi], scores.shape[1], budgets, thresholds)


def quota_by_ranges(scores: Callable[[int, int], np.ndarray], n: int, budgets: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """``quota`` of n wafers, whose scores ``scores(lo, hi)`` gives for a range of them at a time: of long lots only the decisions are held."""
    total = np.minimum(np.rint(budgets * n), n).astype(np.int64)
    count, out = np.zeros(len(budgets), np.int64), np.zeros((len(budgets), n), bool)
    step = max(1, CELLS // len(budgets))
    for lo in range(0, n, step):
        some = scores(lo, min(lo + step, n))
        for i in range(lo, min(lo + step, n)):
            cap = np.minimum(total, np.ceil(budgets * (i + 1)).astype(np.int64))
            take = (count < total) & ((count < total - (n - i - 1)) | ((some[:, i - lo] >= thresholds) & (count < cap)))
            out[:, i] = take
            count += take
    return out


def ranked(scores: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """The rint(budget n) largest scores of each stream, of equal ones the earlier; NaN is the least."""
    n = scores.shape[1]
    order = np.argsort(np.where(np.isnan(scores), np.inf, -scores), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[None].repeat(len(scores), 0), axis=1)
    return place < np.minimum(np.rint(budgets * n), n)[:, None]


def periodic(n: int, budget: float) -> np.ndarray:
    """Wafers spread evenly in their order."""
    count, out = int(min(np.rint(budget * n), n)), np.zeros(n, bool)
    if count:
        out[np.rint(np.arange(count) * (n - 1) / max(count - 1, 1)).astype(int)] = True
    return out


def periodic_risks(errors: np.ndarray, counts: Sequence[int]) -> np.ndarray:
    """The mean error left after measuring each count (below n) of wafers at even distances.

    Such places are more than one apart, so none repeats: what is left is the lot's sum less the errors at those places.
    """
    n, total, out = len(errors), errors.sum(), np.empty(len(counts))
    for i, c in enumerate(counts):
        at = np.rint(np.arange(c) * (n - 1) / max(c - 1, 1)).astype(np.int64)
        out[i] = (total - errors[at].sum()) / (n - c)
    return out


METRICS = ("total_system_mae", "unmeasured_wafer_mae", "measured_fraction", "high_error_capture", "p95_system_error", "cumulative_system_error", "measured_wafers")


def stream_metrics(measured: np.ndarray, errors: np.ndarray, system: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The metrics of each stream of decisions over one lot's true errors; ``system`` has what is left where it isn't the errors of the unmeasured wafers."""
    n = len(errors)
    k = max(1, int(np.ceil(0.2 * n)))
    worst = np.zeros(n, bool)
    worst[np.argsort(-errors, kind="stable")[:k]] = True
    system = np.where(measured, 0.0, errors) if system is None else system
    left = (~measured).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        unmeasured = np.where(measured, 0.0, errors).sum(axis=1) / left
    return {
        "total_system_mae": system.mean(axis=1), "unmeasured_wafer_mae": np.where(left > 0, unmeasured, np.nan), "measured_fraction": measured.mean(axis=1), "high_error_capture": (measured & worst).sum(axis=1) / k,
        "p95_system_error": np.quantile(system, 0.95, axis=1), "cumulative_system_error": system.sum(axis=1), "measured_wafers": measured.sum(axis=1),
    }


def drift(errors: np.ndarray, limit: float) -> tuple[int | None, int | None]:
    """(place from 1 at which the error first passes the limit, how many wafers until it is back; what is left of the lot if it never is)."""
    over = np.flatnonzero(errors > limit) if np.isfinite(limit) else []
    if not len(over):
        return None, None
    onset = int(over[0])
    back = np.flatnonzero(errors[onset + 1 :] <= limit)
    return onset + 1, int(back[0]) + 1 if len(back) else len(errors) - onset
