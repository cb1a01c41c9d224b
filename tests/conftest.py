"""One small local session for all tests."""

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    """A value as either engine gives it: whole decimals are numbers, NaN is NULL."""
    import math
    from decimal import Decimal

    if isinstance(x, Decimal):
        return int(x) if x == int(x) else float(x)
    if isinstance(x, float) and math.isnan(x):
        return None
    return [plain(v) for v in x] if isinstance(x, list) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def same_rows(spark_df, duck_rel) -> None:
    a, b = spark_df.toArrow(), duck_rel.to_arrow_table()
    assert sorted(a.column_names) == sorted(b.column_names)
    rows = lambda t: sorted(repr(tuple(plain(r[c]) for c in sorted(t.column_names))) for r in t.to_pylist())
    assert rows(a) == rows(b)
