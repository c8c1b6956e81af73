"""The row change log: segments of (op, pk, ts), op one of I, U, D, ts in seconds.

An update that changes its key is logged as D of the old key and I of the new one (`decode`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "op string, pk bigint, ts bigint"


def read_stream(spark: SparkSession, folder: str, segments_per_round: int = 4) -> DataFrame:
    """The log as a stream, so many segments a round."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", segments_per_round).parquet(folder)


def read_batch(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def decode(events: DataFrame, pk: str = "pk") -> DataFrame:
    """(op, pk, ts) of row events (kind, before.pk, after.pk, ts), kind one of write, update, delete."""
    old, new = F.col(f"before.{pk}").cast("long"), F.col(f"after.{pk}").cast("long")
    entry = lambda op, key: F.struct(F.lit(op).alias("op"), key.alias("pk"))
    moved = new.isNotNull() & (old != new)
    out = (
        F.when(F.col("kind") == "write", F.array(entry("I", new)))
        .when(F.col("kind") == "delete", F.array(entry("D", old)))
        .when((F.col("kind") == "update") & moved, F.array(entry("D", old), entry("I", new)))
        .when(F.col("kind") == "update", F.array(entry("U", old)))
    )
    return events.select(F.inline(out), F.col("ts").cast("long").alias("ts"))


def segment_number(name: Column) -> Column:
    """The number behind the last dot of a segment's name."""
    return F.element_at(F.split(name, r"\."), -1).try_cast("long")


def segment_inventory(segments: DataFrame, current: str, position: int) -> DataFrame:
    """Bytes of log not read yet: segments(name, size) from the current one on by their numbers, less the position in it."""
    later = segment_number(F.col("name")) >= int(current.rpartition(".")[2])
    left = F.coalesce(F.sum(F.when(later, F.col("size"))), F.lit(0)) - position
    return segments.agg(F.greatest(F.lit(0), left).cast("long").alias("lag_bytes"))


def segment_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size) of the files of a log folder."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    return files.where(~F.col("name").startswith("_") & ~F.col("name").startswith("."))


def segment_name(base: str, number: Column, digits: int = 6) -> Column:
    text = number.cast("string")
    return F.concat(F.lit(f"{base}."), F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0")))


def segments_to_read(segments: DataFrame, current: str, most: int) -> DataFrame:
    """The segments of the next round: from the current one on, in order of their numbers, so many at most."""
    first = int(current.rpartition(".")[2])
    rows = segments.withColumn("number", segment_number(F.col("name"))).where(F.col("number") >= first)
    return rows.orderBy("number").limit(most)
