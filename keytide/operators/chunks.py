"""Division of keys and times into ranges, and progress over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.model import ChunkStatus

SCHEMA = "chunk_id int, start_pk bigint, end_pk bigint, status string, last_pk bigint"


def plan(spark: SparkSession, min_pk: int | None, max_pk: int | None, min_size: int = 100_000, most: int = 200) -> DataFrame:
    """(chunk_id, start_pk, end_pk): at least one chunk, at most `most`, each of min_size keys or more where there are so many. The first
    begins at min_pk and the last ends at max_pk."""
    if max_pk is None or min_pk is None:
        raise ValueError("the source has no rows")
    n = max(1, min(max_pk // min_size, most)) if max_pk > 0 else 1
    size = max(1, max_pk // n)
    i = F.col("id")
    start = F.when(i == 0, F.lit(min(min_pk, 1))).otherwise(i * size + 1)
    end = F.when(i == n - 1, F.lit(max_pk)).otherwise((i + 1) * size)
    return spark.range(n).select(i.cast("int").alias("chunk_id"), start.cast("long").alias("start_pk"), end.cast("long").alias("end_pk"))


def chunk_of(key: Column, bounds: list[tuple[int, int, int]]) -> Column:
    """The chunk of a key among sorted (chunk_id, start_pk, end_pk), null outside all: a binary search as one expression."""
    if len(bounds) == 1:
        chunk, start, end = bounds[0]
        return F.when(key.between(start, end), F.lit(chunk))
    middle = len(bounds) // 2
    return F.when(key < bounds[middle][1], chunk_of(key, bounds[:middle])).otherwise(chunk_of(key, bounds[middle:]))


def row_counts(df: DataFrame, pk: str, chunks: DataFrame) -> DataFrame:
    """Rows of each chunk. Chunks are few (their number is a setting), so they are read to the driver; rows aren't joined."""
    bounds = sorted((r.chunk_id, r.start_pk, r.end_pk) for r in chunks.collect())
    rows = df.select(chunk_of(F.col(pk), sorted(bounds, key=lambda b: b[1])).alias("chunk_id")).where("chunk_id is not null")
    found = rows.groupBy("chunk_id").agg(F.count("*").alias("n"))
    return chunks.select("chunk_id").join(found, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def validation_ranges(spark: SparkSession, low: int, high: int, batch: int) -> DataFrame:
    """(start_pk, end_pk) of batch + 1 keys each from low to high."""
    n = max(0, (high - low) // (batch + 1) + 1)
    start = F.lit(low) + F.col("id") * (batch + 1)
    return spark.range(n).select(start.cast("long").alias("start_pk"), F.least(start + batch, F.lit(high)).cast("long").alias("end_pk"))


def time_ranges(log: DataFrame, batch: int, start: int, end: int) -> DataFrame:
    """(op, start_ts, end_ts): for each op, ranges so wide that they hold about `batch` entries if these were even."""
    rows = log.groupBy("op").agg(F.count("*").alias("n"))
    width = F.expr(f"{(end - start) * batch} div n")
    begin = F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), width + 1))
    return rows.select("op", begin.alias("start_ts"), width.alias("w")).select("op", "start_ts", F.least(F.col("start_ts") + F.col("w"), F.lit(end)).cast("long").alias("end_ts"))


def bisected(low: int, high: int, count: Callable[[int, int], int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges within [low, high] of at most `most` entries, or of one second, by halving those with more."""
    todo = [(low, high)]
    while todo:
        a, b = todo.pop()
        if b > a and count(a, b) > most:
            middle = a + (b - a) // 2
            todo += [(middle + 1, b), (a, middle)]
        else:
            yield a, b


@dataclass
class SparseBatch:
    """The size of the next batch where keys have gaps: a multiple of the wanted number of rows."""

    rows: int
    multiplier: float = 1.0

    @property
    def size(self) -> int:
        return int(self.rows * self.multiplier)

    def after(self, found: int) -> None:
        if found == 0:
            self.multiplier += 1
        elif found == self.rows:
            self.multiplier = max(1.0, self.multiplier * 0.9)
        else:
            self.multiplier = self.size / found


def resume_point(status: str, start_pk: int, last_pk: int | None, largest_there: int | None) -> int | None:
    """Where to go on in a chunk; None if it is done. After a duplicate key it is behind the largest key that has arrived."""
    if status == ChunkStatus.DONE:
        return None
    if status == ChunkStatus.DUPLICATE_KEY:
        return start_pk if largest_there is None else largest_there + 1
    return start_pk if last_pk is None else last_pk + 1


def incomplete(chunks: DataFrame) -> DataFrame:
    """Chunks that aren't done to their last key; an unknown progress counts as incomplete."""
    done: Column = F.col("status").eqNullSafe(ChunkStatus.DONE.value) & F.col("last_pk").eqNullSafe(F.col("end_pk"))
    return chunks.where(~done)


def progress(chunks: DataFrame, max_pk: int) -> DataFrame:
    """Percent of keys passed; a chunk counts one row less than it has."""
    passed = F.when(F.col("last_pk") >= F.col("start_pk"), F.col("last_pk") - F.col("start_pk"))
    return chunks.agg((F.coalesce(F.sum(passed), F.lit(0)) / F.lit(float(max_pk)) * 100).alias("percent"))
