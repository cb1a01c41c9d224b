"""Queries by name, each with the DuckDB SQL that has the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir)."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six places by plain arithmetic that engines share, its boundaries away from the ties of short decimals."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.floor(x.cast("double") * 1e6 + 0.4997) / 1e6
    return x.alias(name or (c if isinstance(c, str) else "value"))


def big(c: str | Column, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name or (c if isinstance(c, str) else "value"))


KEY = "concat('2024-01-0', CAST({w} % 5 + 1 AS VARCHAR), '_', lpad(CAST({w} AS VARCHAR), 6, '0'))"
TRACES = f"""traces AS (
  SELECT user_id AS wafer, CAST(user_id % 5 + 1 AS INTEGER) AS lot_number, {KEY.format(w='user_id')} AS experiment_key, epoch_us(ts) / 3.6e9 AS t,
    value AS rf, CAST(json_extract(props, '$.k') AS DOUBLE) AS gas_long, CAST(event_id % 97 AS DOUBLE) AS gas_short FROM events
)"""
POINTS = f"""points AS (
  SELECT l_suppkey AS wafer, CAST(l_suppkey % 5 + 1 AS INTEGER) AS lot_number, {KEY.format(w='l_suppkey')} AS experiment_key, CAST(l_linenumber - 4 AS DOUBLE) AS x,
    CAST(CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS DOUBLE) AS y, l_extendedprice, l_quantity, l_discount FROM lineitem
)"""
DENSE = POINTS + """, dense AS (
  SELECT wafer, lot_number, experiment_key, x, y, round(avg(l_extendedprice) / 1000, 9) AS stepheight, round(avg(l_quantity), 9) AS oxide_etch, round(avg(l_discount), 9) AS postox_thickness,
    CASE WHEN count(*) % 17 = 0 THEN NULL ELSE round(avg(l_discount), 9) END AS postox_thickness_nan,
    round(round(avg(l_extendedprice) / 1000, 9) - round(avg(l_discount), 9), 9) AS si_etch FROM points GROUP BY wafer, lot_number, experiment_key, x, y
)"""
SPARSE = """sparse AS (
  SELECT wafer, lot_number, CASE WHEN wafer % 13 = 0 THEN NULL ELSE experiment_key END AS experiment_key, x, y, round(median(l_extendedprice) / 1000, 9) AS stepheight, round(median(l_quantity), 9) AS oxide_etch,
    round(round(median(l_extendedprice) / 1000, 9) - round(median(l_discount), 9), 9) AS si_etch FROM points WHERE x IN (-3, 0, 3) GROUP BY wafer, lot_number, experiment_key, x, y
)"""
SPECTRA = f"""spectra AS (
  SELECT CAST(label AS BIGINT) AS wafer, CAST(label % 5 + 1 AS INTEGER) AS lot_number, {KEY.format(w='label')} AS experiment_key,
    (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 700.0 / count(*) OVER (PARTITION BY label) AS t, list_transform(embedding, lambda v: 1.0 + CAST(v AS DOUBLE)) AS intensity FROM embeddings
)"""
LONG = DENSE + """, long AS (SELECT experiment_key, lot_number, x, y, postox_thickness_nan, target, observed FROM dense UNPIVOT (observed FOR target IN (stepheight, oxide_etch, si_etch)))"""
DECOMPOSED = LONG + """, p AS (SELECT target, x, y, lot_number, sum(observed) AS s, count(*) AS n FROM long GROUP BY ALL),
t AS (SELECT *, (sum(s) OVER (PARTITION BY target, x, y) - s) / nullif(sum(n) OVER (PARTITION BY target, x, y) - n, 0) AS template_prediction FROM p),
g AS (SELECT target, lot_number, (sum(sum(s)) OVER (PARTITION BY target) - sum(s)) / nullif(sum(sum(n)) OVER (PARTITION BY target) - sum(n), 0) AS global_prediction FROM p GROUP BY target, lot_number),
d0 AS (SELECT long.*, template_prediction, global_prediction, avg(observed - template_prediction) OVER (PARTITION BY target, experiment_key) AS mean_shift FROM long JOIN t USING (target, x, y, lot_number) JOIN g USING (target, lot_number)),
decomposed AS (SELECT *, template_prediction + mean_shift AS shifted, observed - template_prediction - mean_shift AS residual, postox_thickness_nan IS NULL AS filled, lot_number AS outer_test_lot FROM d0)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def dr6(expr: str, name: str | None = None) -> str:
    """The SQL of ``r6``."""
    return f"floor(({expr}) * 1e6 + 0.4997) / 1e6 AS {name or expr}"
