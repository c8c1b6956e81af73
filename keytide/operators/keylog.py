"""The compacted key log, its windows, and the keys pending for application.

Every operator is an aggregate, a union or an anti-join on the key; none gathers keys on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compact(log: DataFrame) -> DataFrame:
    """One row for each (op, pk), with the latest ts."""
    return log.groupBy("op", "pk").agg(F.max("ts").alias("ts"))


def merge(log: DataFrame, more: DataFrame) -> DataFrame:
    return compact(log.unionByName(more))


def window(log: DataFrame, start: int, end: int) -> DataFrame:
    """Entries of [start, end], both inclusive."""
    return log.where(F.col("ts").between(start, end))


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("op").agg(F.count("*").cast("long").alias("n"))


def bounds(log: DataFrame) -> DataFrame:
    return log.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def _keys(log: DataFrame, *ops: str) -> DataFrame:
    return log.where(F.col("op").isin(*ops)).select("pk").distinct()


def updated_keys(log: DataFrame) -> DataFrame:
    """Keys to write again: inserted or updated, and not deleted."""
    return _keys(log, "I", "U").join(_keys(log, "D"), "pk", "left_anti")


def removed_keys(log: DataFrame) -> DataFrame:
    return _keys(log, "D")


def last_operations(log: DataFrame) -> DataFrame:
    """(pk, op): the latest operation of each key; a delete yields to a write of the same second."""
    rank = F.struct("ts", F.when(F.col("op") == "D", 0).otherwise(1).alias("w"), "op")
    return log.groupBy("pk").agg(F.max(rank)["op"].alias("op"))


def merge_pending(updated: DataFrame, removed: DataFrame, more_updated: DataFrame, more_removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending keys with those of another batch: U := (U + (u - r)) - r, R := R + r."""
    new = updated.union(more_updated.join(more_removed, "pk", "left_anti")).distinct().join(more_removed, "pk", "left_anti")
    return new, removed.union(more_removed).distinct()


def feed_back(updated: DataFrame, removed: DataFrame, not_updated: DataFrame, not_removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending keys with those that validation found unmatched: U := (U + (nu - nr)) - nr, R := R + nr."""
    return merge_pending(updated, removed, not_updated, not_removed)


def pop(keys: DataFrame, n: int, largest: bool = False) -> DataFrame:
    """The n smallest or largest keys."""
    return keys.orderBy(F.desc("pk") if largest else F.asc("pk")).limit(n)


@dataclass
class WindowLoader:
    """Event-time windows over a key log, their width adapted to the numbers of entries.

    A window starts at the last mark (so the boundary second is read again). It is halved while one op has over `most` entries in it, and
    doubled while it is empty or has nothing but the boundary second, with more to come; a window that had to be doubled is taken as it is. The next mark is the latest ts seen."""

    most: int = 100_000
    width: int = 3600
    mark: int | None = None

    def next(self, log: DataFrame) -> tuple[int, int] | None:
        """The next window, or None if there is nothing to load or no width is small enough."""
        low, high = log.agg(F.min("ts"), F.max("ts")).first()
        start = self.mark if self.mark is not None else (low or 0)
        if not start or high is None or start > high:
            return None
        grown = False
        while self.width > 0:
            sizes = window(log, start, start + self.width).groupBy("op").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
            largest, last = sizes.agg(F.max("n"), F.max("last")).first()
            if (largest or 0) > self.most and not grown:
                self.width //= 2
            elif not largest or (self.mark is not None and last == start < high):
                self.width, grown = self.width * 2, True
            else:
                return start, start + self.width
        return None

    def load(self, log: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """(updated, removed) keys of the next window; advances the mark."""
        if (found := self.next(log)) is None:
            return None
        part = window(log, *found)
        self.mark = part.agg(F.max("ts")).first()[0]
        return updated_keys(part), removed_keys(part)


def windows(log: DataFrame, most: int, width: int, mark: int | None = None) -> list[tuple[int, int]]:
    """All windows of a WindowLoader(most, width, mark) over log, until its mark is the latest ts; later ones would only read that second
    again. They follow from the numbers of entries by op and second, of which the driver holds those of each second with entries.

    Raises ValueError where the loader would stay before the end as no width is small enough."""
    log = log.where("ts is not null") if mark is None else log.where(F.col("ts") >= mark)
    got = log.groupBy("ts", "op").agg(F.count("*").alias("n")).toArrow()
    if not got.num_rows:
        return []
    seconds, at = np.unique(got["ts"].to_numpy(), return_inverse=True)
    ops = np.unique(np.array(got["op"].to_pylist(), dtype=str), return_inverse=True)[1]
    before = np.zeros((ops.max() + 1, len(seconds) + 1), np.int64)  # entries of each op before each second
    np.add.at(before, (ops, at + 1), got["n"].to_numpy())
    before = before.cumsum(axis=1)
    out: list[tuple[int, int]] = []
    start, high, grown, first = int(seconds[0]) if mark is None else mark, int(seconds[-1]), False, mark is None
    while start and (first or start < high):
        lo, hi = np.searchsorted(seconds, start), np.searchsorted(seconds, start + width, "right")
        if hi == lo:  # the entries of the mark's second have moved on
            width, grown = width * 2, True
            continue
        largest, last = int((before[:, hi] - before[:, lo]).max()), int(seconds[hi - 1])
        if largest > most and not grown:
            if not (width := width // 2):
                raise ValueError(f"over {most} entries of one operation from second {start} on: no window is small enough")
        elif not first and last <= start:
            width, grown = width * 2, True
        else:
            out.append((start, start + width))
            start, grown, first = last, False, False
    return out


def counter(log: DataFrame) -> Callable[[int, int], int]:
    """A function of two seconds: the entries between them. The driver holds the number of each second with entries."""
    got = log.groupBy("ts").agg(F.count("*").alias("n")).orderBy("ts").toArrow()
    seconds, before = got["ts"].to_numpy(), np.append(0, np.cumsum(got["n"].to_numpy()))
    return lambda a, b: int(before[np.searchsorted(seconds, b, "right")] - before[np.searchsorted(seconds, a)])


def batches(log: DataFrame, found: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive windows that hold `most` entries together at most, or one window; from the first start to the last end."""
    starts = np.array([start for start, _ in found], np.int64)
    got = log.where(F.col("ts").between(found[0][0], found[-1][1])).groupBy("ts").agg(F.count("*").alias("n")).toArrow()
    at = np.searchsorted(starts, got["ts"].to_numpy(), "right") - 1
    sizes = np.bincount(at, got["n"].to_numpy(), len(found)).astype(int).tolist()
    held, begin = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield found[begin][0], found[i][0]
            held, begin = 0, i
        held += n
    yield found[begin][0], found[-1][1]


def next_batch(updated: DataFrame, removed: DataFrame, n: int) -> DataFrame:
    """(kind, pk): the n smallest keys of the larger of the two pending sets; if they are equally large, of the removed ones."""
    every = updated.select(F.lit("updated").alias("kind"), "pk").union(removed.select(F.lit("removed").alias("kind"), "pk"))
    sizes = every.groupBy("kind").agg(F.count("*").alias("n"))
    larger = sizes.agg(F.max_by("kind", F.struct("n", F.col("kind") == "removed")).alias("kind"))  # one row
    return every.join(F.broadcast(larger), "kind").orderBy("pk").limit(n)


def window_sizes(log: DataFrame, found: list[tuple[int, int]]) -> DataFrame:
    """(window, start_ts, end_ts, n_updated, n_removed) of all windows(log): the numbers of keys that the loader gives for each.

    A window holds the entries from its start to the next one's, both inclusive, so each entry finds its one or two windows by itself."""
    starts = np.array([start for start, _ in found], np.int64)

    @F.arrow_udf("array<int>")
    def of(ts: pa.Array) -> pa.Array:
        last = np.searchsorted(starts, ts.to_numpy(zero_copy_only=False), "right") - 1
        return pa.array([[i - 1, i] if i and starts[i] == t else [i] for i, t in zip(last.tolist(), ts.to_pylist(), strict=True)], pa.list_(pa.int32()))

    plan = log.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(found)], "window int, start_ts bigint, end_ts bigint")
    if not found:
        return plan.selectExpr("*", "0L as n_updated", "0L as n_removed")
    written, removed = F.max(F.col("op").isin("I", "U")), F.max(F.col("op") == "D")
    keys = log.where("ts is not null").select("op", "pk", F.explode(of("ts")).alias("window")).groupBy("window", "pk").agg(written.alias("w"), removed.alias("r"))
    sizes = keys.groupBy("window").agg(F.count_if(F.col("w") & (~F.col("r") | F.col("pk").isNull())).alias("n_updated"), F.count_if("r").alias("n_removed"))
    return plan.join(sizes, "window").select("window", "start_ts", "end_ts", "n_updated", "n_removed")
