"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. At each node every child draws -ln(u) / weight, u in (0, 1) from a hash of the row's key and the
child's name; the smallest draw wins, so a child gets its share of the node's weight. A child's draw depends on its own
name and weight alone: when weights change, rows only move at nodes on the paths to changed leaves, into a child whose
weight rose or out of one whose weight fell. `Tree` does that for any weights.

`shard` takes a number of shards, and one more shard must take rows only into itself, at every number. Shards fill regions of
racks * per_rack places. A full region draws as above. A region that isn't full yet has places without a shard, and so can't
draw with its present weight, since a greater weight would bring rows to its old shards too. Its places arrive one after
another instead: the first one at -ln(u) / places, where the descent by rack and shard leads; each later one -ln(u) / (places
left) after the one before, in an order given by hashes. The region's draw is the time of its first place that has a
shard, which is distributed as its shards' weight asks. A new shard changes nothing but that its place now counts: a row moves only
if that place arrives before all others, and then it moves there. The last place to be filled makes the first arrival the region's draw,
as in full regions.

Draws are numpy arithmetic over batches of keys' hashes: as expressions they were as slow, and so many that compiling them took
the driver's memory. Edge cases: a null key is a key of its own; null texts count no bytes; equal rows get equal shards and slots of their
own; an empty table gives an empty result; other columns are dropped; fewer than one shard is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytide.llm import textvec as tv
from keytide.llm.shared import saved, ship, table

SHARDS, PER_RACK, RACKS = 40, 5, 2
#: Rows of a shard that are numbered in one task, on average.
SLOT_ROWS = 200_000
#: Keys whose draws are made at once.
AT_ONCE = 1 << 16


def waits(h: np.ndarray, level: int, name: np.ndarray | int) -> np.ndarray:
    """-ln(u) for hashes of keys and the names of children on a level, u in (0, 1)."""
    names = np.broadcast_to(np.asarray(name), h.shape).astype(np.uint64)
    x = tv.mix(h ^ tv.mix((names | np.uint64(level << 40)) * np.uint64(tv.BASE)))
    return -np.log(((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))


def _next(h: np.ndarray, level: int, first: np.ndarray, n: int) -> np.ndarray:
    """The winner of the children first, first + 1, ... of equal weight."""
    return first + np.stack([waits(h, level, first + i) for i in range(n)]).argmin(axis=0)


@dataclass(frozen=True)
class Tree:
    """Weights of leaves by (region, rack, shard)."""

    leaves: tuple[tuple[int, int, int, float], ...]

    def children(self, level: int, parent: int | None) -> dict[int, float]:
        out: dict[int, float] = {}
        for leaf in self.leaves:
            if (parent is None or leaf[level - 1] == parent) and leaf[3] > 0:
                out[leaf[level]] = out.get(leaf[level], 0.0) + leaf[3]
        return out

    def place(self, h: np.ndarray) -> np.ndarray:
        """The shard of each hash."""
        at = np.zeros(len(h), np.int64)
        for level in range(3):
            new = np.zeros(len(h), np.int64)
            for parent in [None] if level == 0 else np.unique(at).tolist():
                rows = np.arange(len(h)) if parent is None else np.flatnonzero(at == parent)
                names, weights = zip(*sorted(self.children(level, parent).items()), strict=True)
                draws = np.stack([waits(h[rows], level, name) / weight for name, weight in zip(names, weights, strict=True)])
                new[rows] = np.array(names)[draws.argmin(axis=0)]
            at = new
        return at


@dataclass(frozen=True)
class Shards:
    """So many shards of equal weight; with one more, rows only move into the new one."""

    n: int
    per_rack: int = PER_RACK
    racks: int = RACKS

    def __post_init__(self) -> None:
        if self.n < 1:
            raise ValueError("there must be a shard")

    def _first_place(self, h: np.ndarray, region: np.ndarray) -> np.ndarray:
        rack = _next(h, 1, region * self.racks, self.racks)
        return _next(h, 2, rack * self.per_rack, self.per_rack)

    def place(self, h: np.ndarray) -> np.ndarray:
        """The shard of each hash."""
        places = self.per_rack * self.racks
        full, open_ = divmod(self.n, places)
        time, region = np.full(len(h), np.inf), np.zeros(len(h), np.int64)
        for g in range(full):
            draw = waits(h, 0, g) / places
            region[draw < time] = g
            time = np.minimum(draw, time)
        out = self._first_place(h, region)
        if open_:
            # the open region: its first place leads where the descent does, the others follow by rank; the first that has a shard is taken
            begin = full * places
            first = self._first_place(h, np.full(len(h), full))
            ranks = np.stack([waits(h, 3, begin + i) for i in range(places)])
            ranks[first - begin, np.arange(len(h))] = -1
            there = ranks[:open_].argmin(axis=0)
            turn = (ranks < ranks[there, np.arange(len(h))]).sum(axis=0)
            # the wait before the first place is that of a full region, so that the last place to be filled changes no draw
            steps = [waits(h, 0, full) / places] + [waits(h, 4, begin + i) / (places - i) for i in range(1, places)]
            arrived = np.cumsum(np.stack(steps), axis=0)[turn, np.arange(len(h))]
            out = np.where(arrived < time, begin + there, out)
        return out


def assign(df: DataFrame, tree: Tree | Shards, key: Column, out: str = "shard") -> DataFrame:
    """df with the shard of each row."""
    ship(df.sparkSession)

    @F.arrow_udf("int")
    def place(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        parts = [tree.place(h[i : i + AT_ONCE]) for i in range(0, len(h), AT_ONCE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int32())

    return df.withColumn(out, place(F.xxhash64(key)))


def numbered(df: DataFrame, by: str, key: str, buckets: int) -> DataFrame:
    """df with a gapless slot from 0 within each value of `by`: rows are numbered in buckets of the key's hash, after the
    counts of the buckets before, so that no task holds a whole shard."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_b").orderBy(key, "text_crc32", "size")
    return (
        df.withColumn("_i", F.row_number().over(within).cast("long") - 1)
        .join(sizes, [by, "_b"])
        .withColumn("slot", F.col("_before") + F.col("_i"))
        .drop("_b", "_i", "_before")
    )


def shard(docs: DataFrame, shards: int = SHARDS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the law is `key`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = assign(assign(rows, Shards(shards), F.col("doc_id")), Shards(shards + 1), F.col("doc_id"), "grown_shard")
    rows = saved(rows, "shards")  # some 30 bytes a row, so that draws and check sums are made once and not for each pass
    buckets = max(8, -(-rows.count() // (shards * slot_rows)))
    return numbered(rows, "shard", "doc_id", buckets).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
