"""Nearest and backward as-of joins in time order, by one union and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rezeroed(df: DataFrame, key: str, time: str, out: str = "elapsed") -> DataFrame:
    """Adds the time since the first sample of the key."""
    return df.withColumn(out, F.col(time) - F.min(time).over(Window.partitionBy(key)))


def _sides(probe: DataFrame, reference: DataFrame, key: str, time: str, carry: Sequence[str]) -> DataFrame:
    """Both sides in one frame with the reference rows before and after each row; of equal times the reference comes first."""
    ref = reference.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), *carry).alias("_ref"))
    own = probe.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*probe.columns).alias("_probe"))
    both = ref.unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy("_k").orderBy("_t", "_side")
    return both.withColumns({
        "_before": F.last("_ref", True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("_ref", True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).filter("_side = 1")


def asof_backward(probe: DataFrame, reference: DataFrame, key: str, time: str, carry: Sequence[str], prefix: str = "ref_") -> DataFrame:
    """``probe`` with the last reference row at or before each time; NULL where there is none."""
    s = _sides(probe, reference, key, time, carry)
    return s.select("_probe.*", F.col("_before.t").alias(f"{prefix}{time}"), *[F.col(f"_before.{c}").alias(f"{prefix}{c}") for c in carry])


def asof_nearest(probe: DataFrame, reference: DataFrame, key: str, time: str, carry: Sequence[str], prefix: str = "ref_") -> DataFrame:
    """``probe`` with the nearest reference row of its key; of two as near the earlier one."""
    s = _sides(probe, reference, key, time, carry)
    back, ahead = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    near = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    return s.withColumn("_near", near).select("_probe.*", F.col("_near.t").alias(f"{prefix}{time}"), *[F.col(f"_near.{c}").alias(f"{prefix}{c}") for c in carry])


def alignment_diagnostics(aligned: DataFrame, key: str, time: str, ref_time: str, cycle: str = "ref_cycle_index", active: str = "ref_active") -> DataFrame:
    """(key, aligned_rows, active_rows, aligned_cycles, median and largest |offset|)."""
    off = F.abs(F.col(time) - F.col(ref_time))
    return aligned.groupBy(key).agg(F.count("*").alias("aligned_rows"), F.count_if(active).alias("active_rows"), F.countDistinct(F.when(F.col(cycle) >= 0, F.col(cycle))).alias("aligned_cycles"), F.median(off).alias("median_absolute_offset"), F.max(off).alias("maximum_absolute_offset"))
