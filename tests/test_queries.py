"""Every query with SQL gives DuckDB's rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keytide.catalog import ORACLES, QUERIES
from keytide.operators import mutate

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """Tables of which the destination has keys of the log twice: ghost rows have the keys of other rows."""
    d, sf = str(tmp_path_factory.mktemp("twice")), "/root/testdata/sf0.01"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.union(orders.where("o_orderkey < 148").withColumn("o_orderkey", F.expr("(o_orderkey - 9900) * 101"))).write.parquet(f"{d}/orders.parquet")
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{d}/events.parquet")
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["metrics", "unmatched_after_recheck", "unmatched_rows", "validation_rounds"])
def test_matches_sql_where_the_destination_has_keys_twice(spark, twice, name):
    d, con = twice
    assert rows(QUERIES[name](spark, d).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["apply_batch_in_order", "apply_updates", "apply_batch"])
def test_tasks_of_an_application_grow_in_number_and_not_in_rows(spark, sf, monkeypatch, name):
    monkeypatch.setattr(mutate, "TASK_BYTES", 1000, raising=False)
    tasks = QUERIES[name](spark, sf).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert tasks.sum() > 1300 and tasks.max() < 150  # the session has 4 shuffle partitions


def test_golden_counts(spark, sf):
    golden = {"not_imported": 16, "not_inserted": 1, "not_updated_base": 12, "not_updated_cross": 9, "not_removed": 6, "reinserted_keys": 110, "batch_updated_minus_removed": 611, "batch_removed": 153}
    assert {n: QUERIES[n](spark, sf).count() for n in golden} == golden
