"""Column and small DataFrame helpers that the operators share. NULL stands for a missing number, never NaN."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def linear_quantile(x: Column, q: float) -> Column:
    """The exact quantile with linear interpolation, as an aggregate."""
    return F.percentile(x, F.lit(q))


def _rounded_once(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding, as a fused multiply-add: what the product rounds off is found by halves of 26 bits (Dekker) and added back."""
    halves = lambda x: (134217729.0 * x - (134217729.0 * x - x), x - (134217729.0 * x - (134217729.0 * x - x)))
    (ah, al), (bh, bl) = halves(a), halves(b)
    product, total = a * b, a * b + c
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    back = total - product
    fused = total + (((product - (total - back)) + (c - back)) + lost)
    return F.when(F.isnan(fused), total).otherwise(fused)


def with_quantiles(df: DataFrame, value: str, by: Sequence[str], out: Sequence[str], shares: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """Adds the exact quantiles of each group with linear interpolation, as columns ``out``; NULLs have no part in them.

    They are lo * (1 - d) + hi * d of the two neighbours, the first product not rounded: the bits that DuckDB's
    quantile_cont gives, so that values which a quantile's half meets exactly fall on the same side of it. Neighbours are
    found by their places in a sort of the group, so no row holds the group's values.
    """
    own = Window.partitionBy(*by)
    v = F.col(value).cast("double")
    d = df.withColumns({"_place": F.row_number().over(own.orderBy(v.asc_nulls_last())) - 1, "_count": F.count(value).over(own)})
    at = [(F.col("_count") - 1) * F.lit(float(q)) for q in shares]
    ends = {f"_{end}{i}": F.max(F.when(F.col("_place") == f(x), v)).over(own) for i, x in enumerate(at) for end, f in (("lo", F.floor), ("hi", F.ceil))}
    d = d.withColumns(ends).withColumns({f"_share{i}": x - F.floor(x) for i, x in enumerate(at)})
    fused = {name: _rounded_once(F.col(f"_lo{i}"), 1.0 - F.col(f"_share{i}"), F.col(f"_hi{i}") * F.col(f"_share{i}")) for i, name in enumerate(out)}
    return d.withColumns(fused).drop("_place", "_count", *ends, *[f"_share{i}" for i in range(len(at))])


def mean_if(x: Column, when: Column) -> Column:
    return F.avg(F.when(when, x))


def flag_mean(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def safe_divide(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return a / F.when(b != 0, b)


def r_squared(observed: str, predicted: str) -> Column:
    """1 - squared errors over squared deviations, as an aggregate; NULL for a constant ``observed``."""
    total = F.count(observed) * F.var_pop(observed)
    return F.lit(1.0) - safe_divide(F.sum((F.col(observed) - F.col(predicted)) ** 2), F.when(F.var_pop(observed) > 0, total))


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ranks from 1, ties getting the average of theirs; NULLs get none."""
    own = Window.partitionBy(*by)
    rank = F.rank().over(own.orderBy(F.col(value).asc_nulls_last()))
    peers = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), rank + (peers - 1) / 2.0))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str], out: str = "spearman") -> DataFrame:
    """(by, n, out): the rank correlation of each group over rows with both values; NULL for fewer than three or constants."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    ranked = average_rank(average_rank(both, a, "_ra", by), b, "_rb", by)
    usable = (F.count("*") >= 3) & (F.var_pop("_ra") > 0) & (F.var_pop("_rb") > 0)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(usable, F.corr("_ra", "_rb")).alias(out))


def _incomplete_beta(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function at x of parameters a and 1/2, by its continued fraction."""
    b, swap = 0.5, x > (a + 1) / (a + 2.5)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / keep(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / keep(1 + step * d), keep(1 + step / c)
            h = h * d * c
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - math.lgamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
    return np.where(swap, 1 - front * h, front * h)


@F.pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation of n pairs by Student's t with n - 2 degrees of freedom; NULL for fewer than three."""
    x, k = r.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan)
    out = np.full(len(x), np.nan)
    some = np.isfinite(x) & (k >= 3)
    if some.any():
        # P(|t| > t_r) is the incomplete beta function at (n - 2) / (n - 2 + t_r^2) = 1 - r^2.
        out[some] = _incomplete_beta((k[some] - 2) / 2, np.clip(1 - x[some] ** 2, 0, 1))
    return pd.Series(out).where(some, None).astype("Float64")


def robust_absolute_z(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """|x - median| / (1.4826 MAD) within each group; 0 where the MAD is at most 1e-12. Two aggregates, joined back by group."""
    keys = list(by)
    center = df.groupBy(*keys).agg(F.median(value).alias("_center"))
    d = df.crossJoin(center) if not keys else df.join(center, keys)
    mad = d.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_center"))).alias("_mad"))
    d = d.crossJoin(mad) if not keys else d.join(mad, keys)
    z = F.when(F.col("_mad") <= 1e-12, 0.0).otherwise(F.abs(F.col(value) - F.col("_center")) / (1.4826 * F.col("_mad")))
    return d.withColumn(out, z).drop("_center", "_mad")


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row for each id and column, values as double."""
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), name, value)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """A join after a check that keys are unique on the sides named 'one'; ValueError otherwise."""
    first, _, second = validate.partition("_to_")
    for side, kind, name in ((left, first, "left"), (right, second, "right")):
        if kind == "one" and side.groupBy(*on).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name} keys are not unique: {', '.join(on)}")
    return left.join(right, list(on), how)


def strict_pivot(df: DataFrame, index: Sequence[str], column: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row for each index and one column for each name; ValueError if a cell has several rows."""
    if df.groupBy(*index, column).count().filter("count > 1").limit(1).count():
        raise ValueError("index contains duplicate entries, cannot pivot")
    return df.groupBy(*index).pivot(column, list(names)).agg(F.first(value))
