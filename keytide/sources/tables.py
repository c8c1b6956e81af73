"""Tables as sources: columns, keys, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_list(df: DataFrame) -> str:
    return ",".join(df.columns)


def check_key(df: DataFrame, *pk: str) -> str:
    """The one key column; composite keys and keys that aren't integers are refused."""
    if len(pk) != 1:
        raise ValueError("the key must be one column")
    if not isinstance(df.schema[pk[0]].dataType, (T.LongType, T.IntegerType)):
        raise ValueError(f"the key {pk[0]} must be an integer or a long")
    return pk[0]


def database_and_table_exist(spark: SparkSession, name: str) -> tuple[bool, bool]:
    database = name.rpartition(".")[0] or spark.catalog.currentDatabase()
    there = spark.catalog.databaseExists(database)
    return there, there and spark.catalog.tableExists(name)


def row_estimate(spark: SparkSession, name: str) -> int:
    """Rows by the catalog's statistics, refreshed first."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    stats = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'").select("data_type").first()[0]
    return int(next(part for part in stats.split(", ") if part.endswith("rows")).split()[0])


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))
