"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most 2 bits, then their first segments
differ in at most 1 bit or their second segments in none. So each fingerprint looks up the Hamming ball of radius 1 of its
first segment (33 keys) and its second segment, and matches are kept if the complete distance is at most 2: none is lost.

A table bucket with more than HOT fingerprints isn't joined, as its pairs would grow with the square of its size. The
fingerprints that look it up list the 65 fingerprints within 1 bit of themselves instead: two are within 2 bits exactly if
they share one, and each shared one links its fingerprints in a star. That is exact as well.

Equal texts and equal fingerprints count once until the end. Edge cases: null, empty and word-less texts have fingerprint
zero and are linked like any other; repeated rows fall in one component and all come back; a null doc_id is never the
smallest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import textvec as tv
from keytide.llm.components import components
from keytide.llm.shared import join_skewed, saved, ship, table

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints in one table bucket up to which its pairs are compared.
HOT = 32


def fingerprints_of(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """A fingerprint for each row of lower-cased bytes."""
    starts, ends, first = tv.words(data, off)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    # the words, joined by one space: a shingle is one slice of them
    to_end = np.cumsum(lengths + 1)
    to = to_end - lengths - 1
    buf = np.full(to_end[-1], 32, np.uint8)
    at = _ranges(starts, lengths)
    buf[np.repeat(to - starts, lengths) + at] = data[at]
    text, digest = buf.tobytes(), xxhash.xxh64_intdigest
    a, b = to.tolist(), (to_end - 1).tolist()
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = hi - lo
        if not n:
            continue
        k = min(n, shingle)
        h = np.array([digest(text[x:y], SEED) for x, y in zip(a[lo : hi - k + 1], b[lo + k - 1 : hi], strict=True)], dtype=">u8")
        ones = np.zeros(64, np.int64)
        for j in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[j : j + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length, one after another."""
    total = np.cumsum(lengths)
    return np.arange(total[-1]) + np.repeat(starts - total + lengths, lengths)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = [fingerprints_of(tv.LOWER[data], off) for _, _, data, off in tv.chunks(batch.column(2))]
        fps = np.concatenate(fp or [np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "same", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, same, fp) of every row; same is a hash of the text, which tells rows of one doc_id apart."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
    return rows.mapInArrow(_batches, "doc_id long, same long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct values of fps(fp), such that what can be reached by links of at most RADIUS bits
    can be reached by these."""
    one_bit = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    high = [0, *(1 << i for i in range(31)), -(1 << 31)]
    fp = F.col("fp")
    seg_a, seg_b = F.shiftright(fp, 32).cast("int"), F.shiftright(F.shiftleft(fp, 32), 32).cast("int")
    entry = lambda t, k: F.struct(F.lit(t).alias("t"), k.alias("k"))
    shelf = fps.select("fp", F.inline(F.array(entry(0, seg_a), entry(1, seg_b))))
    ball = F.transform(F.lit(high), lambda m: entry(0, seg_a.bitwiseXOR(m)))
    probes = fps.select("fp", F.inline(F.concat(ball, F.array(entry(1, seg_b)))))
    full = saved(shelf.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("t", "k"), "simhash-hot")
    shelf, mild = (x.join(full, ["t", "k"], "left_anti") for x in (shelf, probes))
    near = (
        mild.withColumnRenamed("fp", "a")
        .join(shelf.withColumnRenamed("fp", "b"), ["t", "k"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
    )
    hot = probes.join(full, ["t", "k"], "left_semi").select("fp").distinct()
    mids = hot.select("fp", F.explode(F.transform(F.lit([0, *one_bit]), lambda m: fp.bitwiseXOR(m))).alias("mid"))
    low = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    stars = mids.join(low, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
    return near.union(stars).distinct()


def classes(fps: DataFrame, links_of: Callable[[DataFrame], DataFrame], label: str = "simhash") -> DataFrame:
    """(fp, n, head, root, component_id) of every distinct fp of fps(doc_id, same, fp), by the links of these: its rows; which of them
    stands first; a fp that stands for the component, and the smallest doc_id of the component. A null doc_id stands last."""
    head = F.struct(F.col("doc_id").isNull().alias("_kt_null"), F.coalesce("doc_id", F.lit(0)).alias("_kt_id"), F.col("same").alias("_kt_same"))
    reps = saved(fps.groupBy("fp").agg(F.min(head).alias("head"), F.count("*").alias("n")), f"{label}-distinct")
    roots = components(links_of(reps.select("fp")), f"{label}-links").withColumnRenamed("id", "fp")
    low = F.when(~F.col("head._kt_null"), F.col("head._kt_id"))
    lows = roots.join(reps, "fp").groupBy("root").agg(F.min(low).alias("component"))
    linked = roots.join(lows, "root").select("fp", "root", "component")
    return reps.join(linked, "fp", "left").select(
        "fp", "n", "head", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), low).otherwise(F.col("component")).alias("component_id")
    )


def near_classes(docs: DataFrame) -> DataFrame:
    """classes() of the fingerprints of docs."""
    return classes(saved(fingerprints(docs), "simhash"), links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, same, fp, root, component_id) of every row; component_id is the smallest doc_id that links reach, root a
    fingerprint that stands for the component."""
    fps = saved(fingerprints(docs), "simhash")
    found = saved(classes(fps, links).drop("head"), "simhash-classes")
    return join_skewed(fps, found, ["fp"]).select("doc_id", "same", "fp", "root", "component_id")


def keep_one(docs: DataFrame, near: Callable[[DataFrame], DataFrame] = near_classes) -> DataFrame:
    """One row of docs for each component of near(docs): that of the smallest doc_id, a null one only if there is no other."""
    found = near(docs).groupBy("root").agg(F.min("head").alias("head"))
    key = ["_kt_null", "_kt_id", "_kt_same"]
    rows = docs.withColumns({"_kt_null": F.col("doc_id").isNull(), "_kt_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_kt_same": F.xxhash64("text")})
    return rows.join(found.select("head.*"), key, "left_semi").dropDuplicates(key).select(docs.columns)


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
