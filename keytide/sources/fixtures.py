"""A source, a destination that has fallen behind, and a change log, derived from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators.keylog import compact
from keytide.sources.tables import epoch, table

PK = "pk"
COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

SQL = """
src AS (SELECT o_orderkey AS pk, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders),
dst AS (SELECT pk, o_custkey, CASE WHEN pk % 89 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate,
               CASE WHEN pk % 83 = 2 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM src WHERE pk % 97 <> 0
        UNION ALL
        SELECT pk + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM src WHERE pk % 101 = 0),
log AS (SELECT CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN event_id * 101 % 10100 + 1000000
                    ELSE event_id * 7 % (SELECT count(*) FROM orders) END AS pk,
               CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
               CAST(floor(epoch(ts)) AS BIGINT) AS ts
        FROM events WHERE event_type <> 'view'),
kl AS (SELECT op, pk, max(ts) AS ts FROM log GROUP BY op, pk)
"""


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(PK), *COLUMNS[:-1], priority.alias("o_orderpriority"))


def destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = source(spark, sf_dir)
    status = F.when(F.col(PK) % 89 == 1, "X").otherwise(F.col("o_orderstatus"))
    priority = F.when(F.col(PK) % 83 != 2, F.col("o_orderpriority"))
    stale = src.where(F.col(PK) % 97 != 0).withColumns({"o_orderstatus": status, "o_orderpriority": priority})
    return stale.union(src.where(F.col(PK) % 101 == 0).withColumn(PK, F.col(PK) + 1_000_000))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").count()
    i, kind = F.col("event_id"), F.col("event_type")
    key = F.when((kind == "error") & (i % 2 == 1), i * 101 % 10100 + 1_000_000).otherwise(i * 7 % n)
    op = F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U")
    return table(spark, sf_dir, "events").where(kind != "view").select(op.alias("op"), key.alias(PK), epoch(F.col("ts")).alias("ts"))


def key_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(change_log(spark, sf_dir))


def keys(spark: SparkSession, sf_dir: str, *ops: str) -> DataFrame:
    return key_log(spark, sf_dir).where(F.col("op").isin(*ops)).select(PK).distinct()
