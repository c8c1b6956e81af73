"""Near copies of the pipeline by SimHash: texts whose sets of word 5-grams have a Jaccard similarity of SIMILAR or more, and components of them.

A set's fingerprint has TABLES segments of BITS sign bits and CHECK more. A bit is the sign of a sum over the 5-grams, of a byte that is hashed from
each, less its mean. Two sets of similarity s have a cosine of 2 s / (1 + s) or more, so a bit differs with a chance of at most
acos(8 / 9) / pi = 0.151 at 0.8, whatever their sizes, and with 0.5 in unrelated sets. op5's 64 bits can't be both wide enough
for that and selective: these 2,528 are.

The index is a multi-index hash with a table for each segment. Bits seldom differ but where a sum is near zero, so a set is entered in a table under the
four keys that its WEAK weakest bits, either way, give. Two sets meet in a table if they agree in all bits that are weak in neither:
with a chance of 0.131 at 0.8, so that all TABLES miss a pair with a chance of 1e-6 (less above), and of 1e-6 a table for an unrelated pair. Those that meet are compared in
the CHECK bits: more than RADIUS differ with a chance of 2e-8 at 0.8, and in all but 3e-4 of unrelated pairs. Entries are dealt to parts as packed arrays and
paired by workers, some tables at a time, so that the disk holds a few tables' entries at once. The pairs in a bucket with more than HOT sets (or four times the
size that unrelated sets would give it) aren't compared in these bits: all its sets count as near its first one.

Pairs never become rows, as a group's grow with the square of its size. What is near in a part forms groups, and a part gives a star for each: its
first set with each other one. A group of two is compared exactly from the texts, and a set of larger ones with the first sets of HEADS of its groups; components of
what is found so far are formed. A group within one component needs nothing more. Of the others, sets of other components than the first set's are compared among themselves, and with the rest
unless the triangle inequality of Jaccard distances rules links out: where all in the first set's component are linked to it directly and all others are more than
twice the distance of a link away. Stars of what is to be compared that share sets are a cluster, and workers compare each set outside a cluster's
largest component with all its sets of other components, in pairs of blocks. So no pair that meets, is near and could change a component is left out.

Words are as for the other operators; a text of fewer than five words is one gram of all its words. Equal sets count once until the end.
Edge cases: null, empty and word-less texts have the empty set and are one component; repeated rows fall in one component and all come
back; a null doc_id is never the smallest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm import textvec as tv
from keytide.llm.components import components
from keytide.llm.decontam import grams_of
from keytide.llm.shared import remove_table, saved, ship
from keytide.llm.simhash import _ranges, classes

SHINGLE, SIMILAR = 5, 0.8
#: Segments of a fingerprint, their sign bits, and how many of these are entered both ways.
TABLES, BITS, WEAK = 100, 24, 2
#: Further sign bits, and the most in which a pair may differ.
CHECK, RADIUS = 128, 44
#: Sets in one bucket up to which its pairs are compared.
HOT = 32
#: First sets of larger groups that each set of them is compared with before clusters are.
HEADS = 4
#: 5-grams in one of two blocks that a worker compares.
BLOCK = 1 << 20
#: Sets in a round of tables, up to ROUNDS of them, and entries in a part of a round.
ROUND, ROUNDS, PART = 10_000, 10, 1 << 18
_WORDS = (TABLES * BITS + CHECK) // 8
_SALTS = tv.mix(np.arange(1, 3 * _WORDS + 1, dtype=np.uint64) * np.uint64(tv.BASE))
_XOR, _ODD, _ODD2 = _SALTS[::3], _SALTS[1::3] | np.uint64(1), _SALTS[2::3] | np.uint64(1)
_ENTRY = np.dtype([("key", "<u4"), ("n", "<u4"), ("fp", "<i8"), ("check", "<u8", CHECK // 64)])


def gram_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The 5-grams of each row, sorted, each once."""
    starts, ends, first = tv.words(data, off)
    h = tv.word_hashes(data, starts, ends)
    return [np.unique(grams_of(h[a:b], min(SHINGLE, b - a))) if b > a else h[:0] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    return np.array([int(tv.mix(tv.mix(s + np.uint64(tv.BASE)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0]) if len(s) else 0 for s in sets], np.uint64)


def sums(sets: list[np.ndarray]) -> np.ndarray:
    """A row of sums for each set, none of which may be empty: twice the bytes hashed from its grams, less their mean. Their signs are the fingerprint."""
    out = np.zeros((len(sets), 8 * _WORDS), np.int32)
    # up to 256 bytes are summed in lanes of 16 bits, four to a word
    runs = [(i, at, min(at + 256, len(s))) for i, s in enumerate(sets) for at in range(0, len(s), 256)]
    even = np.uint64(0x00FF00FF00FF00FF)
    for lo in range(0, len(runs), 256):
        some = runs[lo : lo + 256]
        grams = np.concatenate([sets[i][a:b] for i, a, b in some])
        at = np.cumsum([0, *(b - a for _, a, b in some[:-1])])
        lanes = np.empty((_WORDS, 2, len(some)), np.uint64)
        h, t = np.empty_like(grams), np.empty_like(grams)
        for j in range(_WORDS):
            np.multiply(np.bitwise_xor(grams, _XOR[j], out=h), _ODD[j], out=h)
            np.multiply(np.bitwise_xor(h, np.right_shift(h, np.uint64(32), out=t), out=h), _ODD2[j], out=h)
            np.bitwise_xor(h, np.right_shift(h, np.uint64(29), out=t), out=h)
            np.add.reduceat(np.bitwise_and(h, even, out=t), at, out=lanes[j, 0])
            np.right_shift(h, np.uint64(8), out=h)
            np.add.reduceat(np.bitwise_and(h, even, out=t), at, out=lanes[j, 1])
        of = np.array([i for i, _, _ in some])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        each = lanes.transpose(2, 0, 1).copy().view(np.uint16).reshape(len(some), -1)
        out[of[first]] += 2 * np.add.reduceat(each, first, axis=0, dtype=np.int32)
    return out - 255 * np.array([len(s) for s in sets], np.int32)[:, None]


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set, none of which may be empty: BITS // 8 bytes of signs and the places of the WEAK weakest for each table, and CHECK // 8 bytes of signs."""
    tables, check = [np.zeros((0, TABLES, BITS // 8 + WEAK), np.uint8)], [np.zeros((0, CHECK // 8), np.uint8)]
    for lo in range(0, len(sets), 512):
        s = sums(sets[lo : lo + 512])
        part = s[:, : TABLES * BITS].reshape(len(s), TABLES, BITS)
        weak = np.partition(np.abs(part).astype(np.int64) << 5 | np.arange(BITS), range(WEAK), axis=2)[:, :, :WEAK] & 31
        tables.append(np.concatenate([np.packbits(part > 0, axis=2, bitorder="little"), weak.astype(np.uint8)], axis=2))
        check.append(np.packbits(s[:, TABLES * BITS :] > 0, axis=1))
    return np.concatenate(tables), np.concatenate(check)


def entries(ids: np.ndarray, n: np.ndarray, check: np.ndarray, tables: np.ndarray, some: range) -> np.ndarray:
    """What sets enter in some of the tables: 2 ** WEAK entries in each, under the table's number and a key."""
    own = tables[:, some]
    keys = np.array(some, np.uint32) << np.uint32(BITS)
    for i in range(BITS // 8):
        keys = keys | own[:, :, i].astype(np.uint32) << np.uint32(8 * i)
    keys = keys[:, :, None]
    for i in range(WEAK):
        bit = np.uint32(1) << own[:, :, BITS // 8 + i].astype(np.uint32)
        keys = np.concatenate([keys, keys ^ bit[:, :, None]], axis=2)
    out = np.empty(keys.shape, _ENTRY)
    out["key"], out["n"], out["fp"] = keys, n[:, None, None], ids[:, None, None]
    out["check"] = np.ascontiguousarray(check).view("<u8")[:, None, None]
    return out.ravel()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, tables, check = [np.zeros(0, np.uint64)], [], [], []
        for _, _, data, off in tv.chunks(batch.column(2)):
            sets = gram_sets(data, off)
            ids.append(set_ids(sets))
            sizes += [len(s) for s in sets]
            t, c = fingerprints([s for s in sets if len(s)])
            rows = zip(t, c, strict=True)
            for s in sets:
                a, b = next(rows) if len(s) else (None, None)
                tables.append(a if a is None else a.tobytes())
                check.append(b if b is None else b.tobytes())
        cols = [batch.column(0), batch.column(1), pa.array(np.concatenate(ids).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(tables, pa.binary()), pa.array(check, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "same", "fp", "n", "tables", "check"])


def _dealt(batches: Iterator[pa.RecordBatch], some: range, parts: int) -> Iterator[pa.RecordBatch]:
    """Entries of batches(fp, n, tables, check), packed for each part."""
    for batch in batches:
        for lo in range(0, len(batch), 2048):
            fp, n, tables, check = (batch.column(i).slice(lo, 2048) for i in range(4))
            bytes_of = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint8)
            rows = entries(fp.to_numpy(), n.to_numpy(), bytes_of(check).reshape(len(fp), -1), bytes_of(tables).reshape(len(fp), TABLES, -1), some)
            to = (tv.mix(rows["key"].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            rows, cuts = rows[order], np.flatnonzero(np.diff(to[order])) + 1
            packed = [x.tobytes() for x in np.split(rows, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(to[order][np.concatenate([[0], cuts])]), pa.array(packed, pa.binary())], ["part", "rows"])


def _lowest(many: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of so many nodes the lowest one that links (i, j) reach."""
    low = np.arange(many)
    while True:
        x, y = low[i], low[j]
        if not (apart := x != y).any():
            return low
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != (up := low[low])).any():
            low = up


def _met(part: pa.Table, similar: float, radius: int, hot: int) -> pa.Table:
    """Of the entries of a part: (a, b, near, more). Sets that meet in a bucket and may be similar, and those of a bucket of more than `hot`, form groups;
    the first set of each with each other one, whether these two are near, and whether there are more."""
    rows = np.frombuffer(b"".join(part["rows"].to_pylist()), _ENTRY)
    rows = rows[np.lexsort((rows["fp"], rows["key"]))]
    key, many = rows["key"], len(rows)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(begin, append=many)
    first, size = np.repeat(begin, size), np.repeat(size, size)
    fps, at, node = np.unique(rows["fp"], return_index=True, return_inverse=True)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = rows["n"][i].astype(float), rows["n"][j].astype(float)
        differ = np.bitwise_count(rows["check"][i] ^ rows["check"][j]).sum(axis=1, dtype=np.int64)
        return (np.minimum(x, y) >= similar * np.maximum(x, y)) & (differ <= radius)

    j = np.flatnonzero((size > hot) & (first != np.arange(many)))
    found = [(node[first[j]], node[j])]
    i, step = np.flatnonzero((size > 1) & (size <= hot)), 1
    while len(i := i[i + step < first[i] + size[i]]):
        ok = i[near(i, i + step)]
        found.append((node[ok], node[ok + step]))
        step += 1
    low = _lowest(len(fps), *(np.concatenate(x) for x in zip(*found, strict=True)))
    b = np.flatnonzero(low != np.arange(len(low)))
    a = low[b]
    return pa.table({"a": fps[a], "b": fps[b], "near": near(at[a], at[b]), "more": np.bincount(low, minlength=1)[a] > 2})


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in tv.chunks(batch.column(0)):
            sets = gram_sets(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "grams"])


def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
        both = np.sort(np.concatenate([x, y]), kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        out.append(shared / (len(both) - shared))
    return pa.array(out, pa.float64())


def _compared(part: pa.Table, similar: float) -> pa.Table:
    """Links that join components within a part(fp, root, grams), as few as join all that its pairs of `similar` or more do."""
    fp = part["fp"].to_pylist()
    sets = [np.frombuffer(g, np.uint64) for g in part["grams"].to_pylist()]
    comp = np.unique(part["root"].to_numpy(), return_inverse=True)[1]
    n = np.array([len(s) for s in sets])
    owner, first = np.repeat(np.arange(len(sets)), n), np.cumsum([0, *n])
    gram = np.unique(np.concatenate(sets), return_inverse=True)[1]
    by_gram = owner[np.argsort(gram, kind="stable")]
    many = np.bincount(gram)
    begin = np.cumsum(many) - many
    out: list[tuple[int, int]] = []
    for x in np.flatnonzero(comp != np.bincount(comp).argmax()).tolist():
        g = gram[first[x] : first[x + 1]]
        shared = np.bincount(by_gram[_ranges(begin[g], many[g])], minlength=len(sets))
        hits = np.flatnonzero((shared / (n + n[x] - shared) >= similar) & (comp != comp[x]))
        for c, i in zip(*np.unique(comp[hits], return_index=True), strict=True):
            out.append((fp[x], fp[hits[i]]))
            comp[comp == c] = comp[x]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _grams(docs: DataFrame, sets: DataFrame, fps: DataFrame) -> DataFrame:
    """(fp, grams) of the sets in fps(fp)."""
    texts = docs.select(F.xxhash64("text").alias("same"), "text").join(sets.join(fps, "fp", "left_semi").select("same"), "same", "left_semi")
    return saved(texts.select("text").mapInArrow(_gram_rows, "fp long, grams binary").dropDuplicates(["fp"]), "copies-grams", lean=True)


def _similarities(grams: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs(a, b) of sets, exactly."""
    of = lambda end: grams.select(F.col("fp").alias(end), F.col("grams").alias(f"g{end}"))
    return saved(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.arrow_udf(_jaccard, "double")("ga", "gb").alias("similarity")), "copies-links", lean=True)


def _unsettled(stars: DataFrame, compared: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """(a, b): links between sets of the groups of stars(a, b) that may hold pairs of `similar` or more between components."""
    for end in ("a", "b"):
        stars = stars.join(roots.select(F.col("fp").alias(end), F.col("root").alias(f"of_{end}")), end, "left")
    stars = stars.join(compared, ["a", "b"], "left").withColumn("apart", F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    # 1 - similarity is a metric; a hair less, for rounding
    far = F.col("similarity") < 2 * similar - 1 - 1e-9
    stars = stars.withColumn("clear", F.coalesce(F.when(F.col("apart"), far).otherwise(F.col("similarity") >= similar), F.lit(False)))
    stars = saved(stars.select("a", "b", "apart", "clear"), "copies-stars", lean=True)
    heads = stars.groupBy("a").agg(F.min(F.when(F.col("apart"), F.col("b"))).alias("head"), F.min("clear").alias("split")).where("head is not null")
    return stars.join(heads, "a").where("apart or not split").select(F.when(F.col("split"), F.col("head")).otherwise(F.col("a")).alias("a"), "b")


def _between(grams: DataFrame, sets: DataFrame, roots: DataFrame, clusters: DataFrame, similar: float) -> DataFrame:
    """Links between the components of roots(fp, root) within clusters(fp, cluster)."""
    rows = clusters.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(sets.select("fp", "n"), "fp")
    rows = saved(rows, "copies-hot")
    sizes = rows.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high"))
    rows = rows.join(sizes.where("low < high").select("cluster", "blocks"), "cluster").join(grams, "fp")
    own, other = F.pmod(F.xxhash64("fp"), "blocks").cast("int"), F.explode(F.expr("sequence(0, blocks - 1)"))
    rows = rows.withColumn("own", own).withColumn("other", other).where("blocks = 1 or own <> other")
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "root", "grams")
    return saved(rows.groupBy("cluster", "i", "j").applyInArrow(lambda part: _compared(part, similar), "a long, b long"), "copies-more")


def meetings(sets: DataFrame, similar: float) -> DataFrame:
    """(a, b, near, more) as of _met(), of all tables, each pair once."""
    count = sets.count()
    rounds = min(ROUNDS, 1 + count // ROUND)
    radius, hot = RADIUS, max(HOT, 4 * (count * 2**WEAK >> BITS))
    found = []
    for i in range(rounds):
        some = range(i, TABLES, rounds)
        parts = 4 + count * len(some) * 2**WEAK // PART
        dealt = sets.select("fp", "n", "tables", "check").mapInArrow(partial(_dealt, some=some, parts=parts), "part int, rows binary")
        met = dealt.groupBy("part").applyInArrow(lambda part: _met(part, similar, radius, hot), "a long, b long, near boolean, more boolean")
        found.append(saved(met, "copies-met", lean=True))
    once = reduce(DataFrame.union, found).groupBy("a", "b").agg(F.max("near").alias("near"), F.max("more").alias("more"))
    out = saved(once, "copies-pairs", lean=True)
    for x in found:
        remove_table(x)
    return out


def links(docs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b): links between sets(fp, same, n, tables, check) of docs, of which all have `similar` or more, and which reach what all such
    pairs reach."""
    met = meetings(sets.where("n > 0"), similar)
    grams = _grams(docs, sets, met.select(F.col("a").alias("fp")).union(met.select("b")).distinct())
    heads = F.slice(F.sort_array(F.collect_set(F.struct((~F.col("near")).alias("far"), "a"))), 1, HEADS)
    few = met.where("more").groupBy("b").agg(heads.alias("heads")).select(F.explode("heads.a").alias("a"), "b")
    compared = _similarities(grams, met.where("not more").select("a", "b").union(few))
    found = compared.where(F.col("similarity") >= similar).select("a", "b")
    if met.where("more").isEmpty():
        return found
    roots = components(found, "copies-first").withColumnRenamed("id", "fp")
    unsettled = _unsettled(met.where("more").select("a", "b"), compared, roots, similar)
    clusters = saved(components(unsettled, "copies-clusters").select(F.col("id").alias("fp"), F.col("root").alias("cluster")), "copies-clusters", lean=True)
    return found.union(_between(grams, sets, roots, clusters, similar))


def near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """simhash.classes() of the 5-gram sets of docs; fp is a hash of the set."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
    rows = saved(rows.mapInArrow(_sketched, "doc_id long, same long, fp long, n long, tables binary, check binary"), "copies")
    sets = saved(rows.groupBy("fp").agg(F.min("same").alias("same"), *(F.first(c).alias(c) for c in ("n", "tables", "check"))), "copies-sets", lean=True)
    return classes(rows.select("doc_id", "same", "fp"), lambda _: links(docs, sets, similar), "copies")
