"""The change log as a stream, applied to a dataset in micro-batches.

A batch is compacted to its keys, and each key's row is read from the source as it is now. Application depends on the source alone, and
the dataset keeps the number of the last batch, so a repeated batch changes nothing; the stream's own checkpoint keeps the position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from keytide.operators.keylog import compact
from keytide.plans.dataset import Dataset
from keytide.sources.changelog import read_stream


def start(
    spark: SparkSession,
    log_folder: str,
    source: Callable[[], DataFrame],
    target: Dataset,
    checkpoint: str,
    segments_per_round: int = 4,
    key_log: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Applies what is there and ends or, given an interval such as "10 seconds", goes on and looks for more that often. With key_log, each batch's
    compacted log is kept in that folder before it is applied."""

    def apply(batch: DataFrame, number: int) -> None:
        log = compact(batch).persist()
        try:
            if key_log:
                log.write.mode("overwrite").parquet(f"{key_log}/batch={number}")
            target.apply(source(), log.select(target.pk), number)
        finally:
            log.unpersist()

    stream = read_stream(spark, log_folder, segments_per_round)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()
