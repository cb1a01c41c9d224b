"""Scans over long ordered groups in blocks with a carry: each block is summed up, the sums are folded, and blocks go on from their carry.

A group's rows are numbered and cut into blocks, so that a task holds one block and never a group. What a block does to
the state that comes into it is a small value that composes: an affine map for exponential means, a step function of
the number of wafers taken for quotas.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 65_536


def scanned(df: DataFrame, by: Sequence[str], order: Sequence[str], summary: Callable[[pd.DataFrame], object], after: Callable[[object, object], object], apply: Callable[[pd.DataFrame, object], pd.DataFrame], kinds: str, block: int | None = None) -> DataFrame:
    """Rows of ``kinds`` that ``apply(block, carry)`` makes of each block of the groups in ``order``.

    ``summary(block)`` is what a block does, and ``after(carry, summary)`` the carry behind it; the first carry is None.
    Blocks come sorted, with _i, the place in the group from 0, and _n, its size. Summaries of a group, one a block, are
    folded in one task; a group of one block has none.
    """
    block = block or BLOCK
    whole = Window.partitionBy(*by)
    rows = df.withColumns({"_i": F.row_number().over(whole.orderBy(*order)) - 1, "_n": F.count("*").over(whole)}).withColumn("_b", F.floor(F.col("_i") / block).cast("long"))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    sort = lambda g: g.sort_values("_i", kind="stable")

    def summed(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, pickle.dumps(summary(sort(g))))], columns=[*by, "_b", "_s"])

    def folded(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        carry, out = None, []
        for b, s in sorted(zip(g["_b"], g["_s"])):
            carry = after(carry, pickle.loads(s))
            out.append((*key, b + 1, pickle.dumps(carry)))
        return pd.DataFrame(out, columns=[*by, "_b", "_c"])

    def applied(key: tuple, g: pd.DataFrame, carries: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame([], columns=[c.split()[0].strip("`") for c in kinds.split(", ")])
        return apply(sort(g), pickle.loads(carries["_c"].iloc[0]) if len(carries) else None)

    ahead = rows.filter((F.col("_b") + 1) * block < F.col("_n"))  # the last block of a group hands nothing on
    carries = ahead.groupBy(*by, "_b").applyInPandas(summed, f"{keys}, _b long, _s binary").groupBy(*by).applyInPandas(folded, f"{keys}, _b long, _c binary")
    return rows.groupBy(*by, "_b").cogroup(carries.groupBy(*by, "_b")).applyInPandas(applied, kinds)


# Exponential means: the mean behind a row is alpha x + (1 - alpha) times the mean before it.


def decayed(x: np.ndarray, alpha: float, start) -> np.ndarray:
    """The mean before each row, and behind the last, from ``start``."""
    out = np.empty((len(x) + 1, *np.shape(x)[1:]))
    out[0] = start
    for i, v in enumerate(x):
        out[i + 1] = alpha * v + (1 - alpha) * out[i]
    return out


# Quotas: a wafer with limit l takes the count c to c + 1 if c < l.


def limits(scores: np.ndarray, places: np.ndarray, n: int, budget: float, threshold: float) -> np.ndarray:
    """Up to which count each wafer is taken: by force if the quota could not be met without it, or by its score within the share so far."""
    total = int(min(np.rint(budget * n), n))
    eligible = np.where(scores >= threshold, np.ceil(budget * (places + 1)), -1)
    return np.minimum(total, np.maximum(total - (n - places - 1), eligible)).astype(np.int64)


def steps_of(limit: np.ndarray) -> np.ndarray:
    """A block's wafers as one function: a count c goes to c plus how many of these ascending numbers are above it.

    Behind some wafers a count is c + k(c), which grows with c, so the next wafer is taken for all c below one number:
    the least for which c + k(c) reaches its limit.
    """
    some: list[int] = []
    for x in limit.tolist():
        lo, hi = 0, max(x, 0)  # c + k(c) >= c, so no more than x
        while lo < hi:
            mid = (lo + hi) // 2
            if mid + len(some) - bisect_left(some, mid + 1) >= x:
                hi = mid
            else:
                lo = mid + 1
        if x > 0:
            insort(some, lo)
    return np.array(some, np.int64)


def counted(c: int, steps: np.ndarray) -> int:
    return c + len(steps) - int(np.searchsorted(steps, c, "right"))


def taken(limit: np.ndarray, c: int) -> np.ndarray:
    """Which wafers of a block are taken from a count on."""
    out = np.zeros(len(limit), bool)
    for i, x in enumerate(limit.tolist()):
        if c < x:
            out[i] = True
            c += 1
    return out
