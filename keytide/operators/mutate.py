"""Changes of a destination as pure functions of DataFrames; keytide.plans.dataset writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytide.operators.scans import key_range, key_set

#: Bytes of both sides, by Spark's estimate, that go to a task where a destination is joined with keys; from UNKNOWN on it is no estimate.
TASK_BYTES, UNKNOWN = 4 << 20, 1 << 50


def _dealt(src: DataFrame | None, dst: DataFrame, pk: str, *keys: DataFrame) -> list[DataFrame]:
    """src (if given), dst and sets of keys, dealt out by key to so many tasks that what one of them sorts doesn't grow with the sides. The number is
    known before any job, whatever the session's number of shuffle partitions; where sizes aren't known, Spark has its way."""
    frames = [dst, *keys] if src is None else [src, dst, *keys]
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in frames[: len(frames) - len(keys)])
    if size >= UNKNOWN:
        return frames
    tasks = max(dst.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return [df.repartition(tasks, pk) for df in frames]


def fitted(rows: DataFrame, target: T.StructType) -> DataFrame:
    """Rows in the target's columns and types. A value that doesn't fit raises; columns that rows lack are null."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields))


def copy_missing(src: DataFrame, dst: DataFrame, pk: str, low: int | None = None, high: int | None = None, target: T.StructType | None = None) -> DataFrame:
    """Source rows, of a range if given, that the destination lacks: appending them twice does no harm. With a target schema, dst may hold keys alone."""
    rows = src if low is None else key_range(src, pk, low, high)
    return fitted(rows.join(dst.select(pk), pk, "left_anti"), target or dst.schema)


def updated(src: DataFrame, dst: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    """The destination with the source's present row for each key. Keys that have left the source change nothing."""
    return _updated(*_dealt(src, dst, pk, keys), pk)


def _updated(src: DataFrame, dst: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    rows = fitted(key_set(src, keys, pk), dst.schema)
    return dst.join(rows.select(pk), pk, "left_anti").unionByName(rows)


def without(dst: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    dst, keys = _dealt(None, dst, pk, keys)
    return dst.join(keys, pk, "left_anti")


def applied(src: DataFrame, dst: DataFrame, changed: DataFrame, pk: str) -> DataFrame:
    """The destination after all changed keys: each key's row becomes the source's present one, or goes if there is none.

    A function of the source alone, so the order of operations and repeated application don't matter."""
    src, dst, changed = _dealt(src, dst, pk, changed)
    rows = fitted(key_set(src, changed, pk), dst.schema)
    return dst.join(changed, pk, "left_anti").unionByName(rows)


def applied_in_batches(src: DataFrame, dst: DataFrame, updates: DataFrame, removed: DataFrame, pk: str) -> DataFrame:
    """Updates, then unconditional deletes: what validation must put right if a deleted key was inserted again.

    Deleted keys leave both sides first, which gives the same rows: no join has to hold those of both sides."""
    src, dst, updates, removed = _dealt(src, dst, pk, updates, removed)
    return _updated(src.join(removed, pk, "left_anti"), dst.join(removed, pk, "left_anti"), updates, pk)
