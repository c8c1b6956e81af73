"""Near-duplicates of embeddings by random-hyperplane signs, exact cosines and distributed components.

Equal vectors are one class, compared once. In each of several tables a class falls in the bucket of its signs against random
hyperplanes; the bits of a bucket grow with the logarithm of the number of classes, so that a bucket holds about BUCKET of them, and the tables are as
many as give a pair at the sought cosine the wanted chance to share a bucket in one. Within buckets all cosines are computed in double
precision and links are kept from the threshold on. A pair that meets in several tables counts in the first alone.

A bucket with more than BLOCK classes is split: its classes are dealt into blocks, and each pair of blocks is a task's work of its own, so
that no task grows with a bucket and nothing is left out. What leaves a block pair are sums: for each class the number of linked vectors,
and for the components a spanning forest; links are never listed by pair.

Vectors that are null, zero, or hold null or non-finite components link with nothing, not even with equal ones. Vectors of other lengths
than the one compared never link with it. Edge cases: repeated rows are vectors of their own; an empty table gives an empty result; extra columns
are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm.components import components
from keytide.llm.shared import join_skewed, saved, ship, table

SIMILAR, CHANCE, BUCKET, BLOCK, SEED = 0.9, 0.98, 64, 1024, 7


def plan(n: int, similar: float = SIMILAR, chance: float = CHANCE) -> tuple[int, int]:
    """(bits, tables) for n classes."""
    bits = min(30, max(4, round(math.log2(max(2, n) / BUCKET))))
    meet = (1 - math.acos(similar) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - chance) / math.log(1 - meet)))


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and bounds of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))


def _signed(bits: int, tables: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1)
            flat, off = _matrix(vectors)
            dims = np.diff(off)
            out = np.zeros((batch.num_rows, tables), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = unit(flat[(off[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim))
                above = (x @ planes(dim, bits, tables)).reshape(len(at), tables, bits) >= 0
                out[at] = (above * (1 << np.arange(bits))).sum(axis=2)
            signs = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(out.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), signs], ["id", "signs"])

    return sign


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the links (a, b) of n nodes."""
    up = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[j] != j:
            up[j] = up[up[j]]
            j = up[j]
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append((x, y))
    return out


def _link_group(t: int, ids: np.ndarray, size: np.ndarray, side: np.ndarray, x: np.ndarray, signs: np.ndarray, similar: float):
    """Links of one bucket, or of one pair of its blocks (side 0 and 1): (id, linked vectors) and a forest."""
    two = bool(side.any()) and not side.all()
    left = np.flatnonzero(side == 0) if two else np.arange(len(ids))
    right = np.flatnonzero(side == 1) if two else left
    ok = x[left] @ x[right].T >= similar
    if not two:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    if t and len(i):  # met in an earlier table already
        first = ~(signs[i, :t] == signs[j, :t]).any(axis=1)
        i, j = i[first], j[first]
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    n = np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))
    at = np.flatnonzero(n)
    return ids[at], n[at].astype(np.int64), [(int(ids[p]), int(ids[q])) for p, q in _forest(len(ids), i, j)]


#: Rows held at once: groups are worked off as soon as they are whole.
_GROUP = ["t", "bucket", "dim", "block_a", "block_b"]


def _linked(similar: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_end(batches):
            rows = batch if rest is None else (pa.concat_batches([rest, batch]) if batch is not None else rest)
            if rows is None or not rows.num_rows:
                continue
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in _GROUP])
            start = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)
            ends = np.append(start[1:], rows.num_rows)
            if batch is not None:  # the last group may go on
                rest = rows.slice(int(start[-1]))
                rows, start, ends = rows.slice(0, int(start[-1])), start[:-1], ends[:-1]
            if not len(start):
                continue
            ids, size, side = (rows.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "side"))
            flat, off = _matrix(rows.column("vector"))
            signs = rows.column("signs").flatten().to_numpy().reshape(rows.num_rows, -1)
            out: list[tuple] = []
            for lo, hi in zip(start.tolist(), ends.tolist(), strict=True):
                if hi - lo > 1:
                    x = unit(flat[off[lo] : off[hi]].reshape(hi - lo, -1))
                    v, n, forest = _link_group(int(keys[0, lo]), ids[lo:hi], size[lo:hi], side[lo:hi], x, signs[lo:hi], similar)
                    out += [(a, c, None) for a, c in zip(v.tolist(), n.tolist(), strict=True)] + [(a, 0, b) for a, b in forest]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["id", "linked", "other"])

    return link


def _and_end(batches):
    yield from batches
    yield None


def classes(vectors: DataFrame) -> DataFrame:
    """(id, n, vector) of the distinct vectors that may link; id is the smallest vec_id."""
    ok = F.size("embedding") > 0
    ok &= F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("embedding", lambda c: c != 0)
    rows = vectors.where(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))


def linked(distinct: DataFrame, similar: float = SIMILAR, chance: float = CHANCE, block: int = BLOCK) -> DataFrame:
    """(id, linked, other): numbers of linked vectors to be added up by id, and links (id, other) of forests."""
    ship(distinct.sparkSession)
    bits, tables = plan(distinct.count(), similar, chance)
    signs = saved(distinct.select("id", "embedding").mapInArrow(_signed(bits, tables), "id bigint, signs array<int>"), "vectors-signs")
    by = ["t", "bucket", "dim"]
    rows = distinct.join(signs, "id").withColumn("dim", F.size("embedding"))
    entry = rows.select("id", "dim", F.posexplode("signs").alias("t", "bucket"))
    full = entry.groupBy(*by).agg(F.count("*").alias("m")).where(F.col("m") > block).withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).drop("m")
    full = saved(full, "vectors-full")
    rows = rows.select("id", "n", F.col("embedding").alias("vector"), "dim", "signs", F.posexplode("signs").alias("t", "bucket"))
    rows = rows.join(full, by, "left").withColumn("own", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    # a block takes part in the pairs with itself and with every other; the lower block is side 0
    part = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("block_a"), F.greatest(F.col("own"), o).alias("block_b")))
    rows = rows.select("id", "n", "vector", "signs", *by, "own", F.inline(part)).withColumn("side", (F.col("own") != F.col("block_a")).cast("int")).drop("own")
    rows = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return rows.mapInArrow(_linked(similar), "id bigint, linked bigint, other bigint")


def near_duplicates(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    distinct = saved(classes(vectors), "vectors-distinct")
    found = saved(linked(distinct, similar), "vectors-links")
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), "vectors-components")
    links = found.where("other is null").groupBy("id").agg(F.sum("linked").alias("linked"))
    known = distinct.join(links, "id", "left").join(roots, "id", "left")
    known = saved(known.select("embedding", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "vectors-known")
    there = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    alone = vectors.where(~there).select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    rows = join_skewed(vectors.where(there), known, ["embedding"], how="left").select("vec_id", "n_links", "component_id").union(alone)
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_hyperplane_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
