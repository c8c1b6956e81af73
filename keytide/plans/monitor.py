"""Metrics of a copy, as one DataFrame (name, value), and of the host that writes."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class HostMetrics(Protocol):
    """How busy the writer is: what load shedding goes by."""

    def cpu(self) -> float:
        """Percent of the processors in use."""

    def latency(self) -> float:
        """Milliseconds that a write takes."""


class TaskMetrics:
    """The share of the cluster's task slots in use; the latency isn't known and counts as none."""

    def __init__(self, spark: SparkSession) -> None:
        self.context = spark.sparkContext

    def cpu(self) -> float:
        tracker = self.context.statusTracker()
        busy = sum(info.numActiveTasks for s in tracker.getActiveStageIds() if (info := tracker.getStageInfo(s)))
        return 100.0 * min(1.0, busy / max(1, self.context.defaultParallelism))

    def latency(self) -> float:
        return 0.0


def event_lag(status: DataFrame) -> DataFrame:
    """First and last checkpoint of status(ts), those of at most 1 left out, and the time between them."""
    ts = F.when(F.col("ts") > 1, F.col("ts"))
    return status.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).withColumn("seconds", F.col("last_ts") - F.col("first_ts"))


def mean_rate(points: DataFrame, by: str, value: str) -> DataFrame:
    """The mean over managers of each one's mean."""
    return points.groupBy(by).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_rate"))


def metrics(spark: SparkSession, **values: DataFrame | float | None) -> DataFrame:
    """(name, value) of one-column, one-row DataFrames and numbers; unknown ones are left out."""
    plain = [(k, float(v)) for k, v in values.items() if v is not None and not isinstance(v, DataFrame)]
    out = spark.createDataFrame(plain, "name string, value double")
    for name, df in values.items():
        if isinstance(df, DataFrame):
            out = out.union(df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("double").alias("value")))
    return out.where("value is not null")
