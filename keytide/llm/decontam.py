"""Benchmark decontamination by SimHash windows.

Each benchmark item is compared with the windows of a document that have as many words as it (the whole document, if that is
shorter). A window's fingerprint is the SimHash of its word 5-grams, repeats counting, of 192 bits. The index of the items of a length has
a table for each of 12 blocks of 16 bits. A window looks up the Hamming ball of radius 3 of each of its blocks (697 keys) and
fetches the items there. Two fingerprints within 43 bits are within 3 bits in two blocks at least (else 11 blocks would differ in 4 bits
or more, 44 in all), so items that two tables give are the candidates: all within the radius, and few others (0.7 % of unrelated pairs; one
table would give 12 %). Their complete distances are verified, and then found pairs count if their exact weighted similarity (sum
of the smaller over sum of the larger counts of 5-grams) is 0.8 or more.

At a similarity of 0.8 the distance is 29 bits on average with a standard deviation of 5: pairs at the very threshold are
within the radius with a chance of 0.998, more similar ones even more surely (tests measure it). Only windows that share at least one 5-gram
with an item of their length are fingerprinted: others have similarity 0, so nothing is lost by that.

Items go to the workers in indexes of at most ITEM_BYTES of text. More items mean more indexes, one after another, each with a pass of its own
whose result is written before the index is given up, so that what is sent and held is bounded whatever the benchmark's size. Documents
are neither shuffled nor collected.

Words are as for the other operators ([^\\x20\\x09-\\x0D]+, A-Z lower-cased). Items of fewer than five words are one gram of all their
words. Edge cases: null, empty and word-less texts and items match nothing; items without an item_id are left out, by `hits` and `clean` alike (the
pipeline gives all items an id first, so that none is left out there); repeated items are all reported; repeated rows are each reported; no
items: nothing is found; extra columns are kept by `clean` and dropped by `hits`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import textvec as tv
from keytide.llm.shared import remove_table, saved, ship, table

SHINGLE, SIMILAR, ITEM_BYTES = 5, 0.8, 8 << 20
#: Blocks of 16 bits; the radius of their balls; how many blocks must agree; and what that guarantees.
BLOCKS, NEAR, AGREE = 12, 3, 2
RADIUS = (NEAR + 1) * (BLOCKS - AGREE + 1) - 1
BALL = np.array([m for m in range(1 << 16) if m.bit_count() <= NEAR], np.uint16)
#: Windows that are fingerprinted, and that look up the index, at once.
WINDOWS, LOOKUPS = 1 << 15, 1 << 11
_BITS = 20


def grams_of(h: np.ndarray, k: int) -> np.ndarray:
    return tv.join_hash(*(h[i : len(h) - k + 1 + i] for i in range(k))) if len(h) >= k else np.zeros(0, np.uint64)


def window_fingerprints(grams: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints, as rows of BLOCKS blocks, of the windows of n grams that begin at `at` (all within grams). A block at a time: 64 bytes a gram."""
    out = np.zeros((len(at), BLOCKS), np.uint16)
    c = np.zeros((len(grams) + 1, 16), np.int32)
    place = np.arange(16, dtype=np.uint16)
    for b in range(BLOCKS):
        if b % 4 == 0:
            words = grams if b == 0 else tv.mix(grams + np.uint64(b * 0x9E3779B97F4A7C15 % (1 << 64)))
        block = (words >> np.uint64(16 * (b % 4))).astype(np.uint16)
        np.cumsum((block[:, None] >> place) & 1, axis=0, dtype=np.int32, out=c[1:])
        out[:, b] = ((2 * (c[at + n] - c[at]) > n) * (1 << place.astype(np.int64))).sum(axis=1)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two lists of grams."""
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    low = int(np.minimum(ca[i], cb[j]).sum())
    return low / (len(a) + len(b) - low) if low else 0.0


def similarities(span: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """similarity() of each window of n grams of a span with an item, all at once.

    An occurrence of a gram that the item has c times counts in the windows that hold it, but for those that hold c earlier ones: it counts from the
    window behind the c-th one before it on. So the sum of the smaller counts is a sum of such ranges."""
    windows = len(span) - n + 1
    grams, times = np.unique(item, return_counts=True)
    of = np.minimum(np.searchsorted(grams, span), len(grams) - 1)
    at = np.flatnonzero(grams[of] == span)
    order = np.argsort(of[at], kind="stable")
    at, of = at[order], of[at[order]]
    rank, c = np.arange(len(at)) - np.searchsorted(of, of), times[of]
    before = np.where(rank >= c, at[np.maximum(np.arange(len(at)) - c, 0)], -1)
    begin = np.maximum(np.maximum(before, at - n) + 1, 0)
    begin, end = begin[begin < windows], np.minimum(at + 1, windows)[begin < windows]
    low = np.cumsum(np.bincount(begin, minlength=windows + 1) - np.bincount(end, minlength=windows + 1))[:windows]
    return low / (n + len(item) - low)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Shelf:
    """The items of one length: for each block a table from its values to items, and a bit for each value that there is."""

    def __init__(self, own: np.ndarray, fps: np.ndarray) -> None:
        self.own, self.fps, self.tables = own, fps, []
        for b in range(BLOCKS):
            order = np.argsort(fps[:, b], kind="stable")
            keys, first = np.unique(fps[order, b], return_index=True)
            there = np.zeros(1 << 16, bool)
            there[keys] = True
            self.tables.append((np.packbits(there, bitorder="little"), keys, np.append(first, len(order)), order))

    def fetched(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place on the shelf) of the pairs that AGREE tables or more give for the balls of window fingerprints."""
        n, pairs = len(self.own), [np.zeros(0, np.int64)]
        for b, (there, keys, first, order) in enumerate(self.tables):
            probe = fps[:, b, None] ^ BALL
            w, j = np.nonzero((there[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1)
            k = np.searchsorted(keys, probe[w, j])
            many = first[k + 1] - first[k]
            item = order[np.arange(many.sum()) + np.repeat(first[k] - np.cumsum(many) + many, many)]
            pairs.append(np.repeat(w, many) * n + item)
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        pair = pair[times >= AGREE]
        return pair // n, pair % n

    def candidates(self, fps: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all pairs within RADIUS."""
        for lo in range(0, len(fps), LOOKUPS):
            part = fps[lo : lo + LOOKUPS]
            w, i = self.fetched(part)
            near = distances(part[w], self.fps[i]) <= RADIUS
            yield from zip((lo + w[near]).tolist(), self.own[i[near]].tolist(), strict=True)


class Index:
    """Lengths of items by gram; and items by length and fingerprint."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids, self.grams, size = [], [], []
        for item, text in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0], x[1] or "")):
            data = np.frombuffer((text or "").encode(), np.uint8)
            off = np.array([0, len(data)])
            starts, ends, _ = tv.words(data, off)
            if len(starts):
                self.ids.append(item)
                size.append(len(starts))
                self.grams.append(grams_of(tv.word_hashes(data, starts, ends), min(SHINGLE, len(starts))))
        size = np.array(size, np.int64)
        self.by_k = {}
        for k in sorted({min(SHINGLE, n) for n in size.tolist()}):
            own = [i for i, n in enumerate(size.tolist()) if min(SHINGLE, n) == k]
            pairs = np.zeros(sum(len(self.grams[i]) for i in own), dtype=[("g", "u8"), ("n", "i8")])
            pairs["g"], pairs["n"] = np.concatenate([self.grams[i] for i in own]), np.repeat(size[own], [len(self.grams[i]) for i in own])
            pairs = np.unique(pairs)
            keys, first = np.unique(pairs["g"], return_index=True)
            lut = np.zeros(1 << _BITS, bool)
            lut[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.by_k[k] = (keys, np.append(first, len(pairs)), pairs["n"].copy(), lut)
        self.shelves = {}
        for n in sorted(set(size.tolist())):
            own = np.flatnonzero(size == n)
            self.shelves[n] = Shelf(own, np.concatenate([window_fingerprints(self.grams[i], np.array([0]), len(self.grams[i])) for i in own]))

    def find(self, data: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """For each row the (item_id, first word of its best window, similarity) of the items it holds."""
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(off) - 1)]
        starts, ends, first = tv.words(data, off)
        if not len(starts) or not self.ids:
            return found
        h = tv.word_hashes(data, starts, ends)
        for k, (keys, bounds, sizes, lut) in self.by_k.items():
            g = grams_of(h, k)
            at = np.flatnonzero(lut[(g & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            key = np.searchsorted(keys, g[at])
            real = (key < len(keys)) & (keys[np.minimum(key, len(keys) - 1)] == g[at])
            at, key = at[real], key[real]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[row + 1]
            at, key, row = at[inside], key[inside], row[inside]
            if not len(at):
                continue
            many = bounds[key + 1] - bounds[key]
            size = sizes[np.arange(many.sum()) + np.repeat(bounds[key] - np.cumsum(many) + many, many)]
            self._windows(found, g, k, first, np.repeat(row, many), np.repeat(at, many), size)
        return found

    def _windows(self, found, g, k, first, row, at, size) -> None:
        """Windows around the shared grams: fingerprints, lookups, exact similarity."""
        order = np.lexsort((at, size, row))
        row, at, size = row[order], at[order], size[order]
        cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(size) != 0)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), [*cuts.tolist(), len(row)], strict=True):
            r, n = int(row[lo]), int(size[lo])
            a, b = int(first[r]), int(first[r + 1])
            width = min(n, b - a)
            grams = width - k + 1
            hits = at[lo:hi]
            # all windows that hold a hit: starts in [hit - grams + 1, hit]
            low, high = np.maximum(hits - grams + 1, a), np.minimum(hits, b - width)
            mark = np.zeros(b - width - a + 2, np.int32)
            np.add.at(mark, low - a, 1)
            np.add.at(mark, high - a + 1, -1)
            begin = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            best: dict[int, tuple[float, int]] = {}
            for part in np.split(begin, np.flatnonzero(np.diff(begin) > 1) + 1):
                for x in range(0, len(part), WINDOWS):
                    w = part[x : x + WINDOWS]
                    span = g[a + w[0] : a + w[-1] + grams]
                    near: dict[int, list[int]] = {}
                    for wi, i in self.shelves[n].candidates(window_fingerprints(span, w - w[0], grams)):
                        near.setdefault(i, []).append(wi)
                    for i, at_windows in near.items():
                        at_windows = np.sort(at_windows)
                        s = similarities(span, self.grams[i], grams)[at_windows]
                        top = int(s.argmax())
                        if s[top] >= SIMILAR and s[top] > best.get(i, (0.0, 0))[0]:
                            best[i] = (float(s[top]), int(w[at_windows[top]]))
            found[r] += [(self.ids[i], begin_at, s) for i, (s, begin_at) in sorted(best.items())]


HIT = "array<struct<item_id: bigint, first_word: bigint, similarity: double>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("similarity", pa.float64())]))


def _parts(benchmark: DataFrame, item_bytes: int) -> tuple[DataFrame, int]:
    """The items with an id and a text, and the number of indexes for them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    return items, max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))


def index_of(items: DataFrame, part: int, parts: int) -> Index:
    """The index of one of so many parts of the items, of about ITEM_BYTES of text; these come to the driver."""
    got = (items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)).toArrow()
    return Index(got["item_id"].to_pylist(), got["text"].to_pylist())


def finder(spark: SparkSession, index: Index):
    """A function of text columns, what a text holds of the index's items; and the index as it was sent."""
    ship(spark)
    sent = spark.sparkContext.broadcast(index)

    @F.arrow_udf(HIT)
    def find(text: pa.Array) -> pa.Array:
        return pa.array([x for _, _, data, off in tv.chunks(text) for x in sent.value.find(data, off)], _HIT)

    return find, sent


def hits(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): what documents hold of benchmark items, with the best window of each."""
    items, parts = _parts(benchmark, item_bytes)
    out = None
    for i in range(parts):
        find, sent = finder(docs.sparkSession, index_of(items, i, parts))
        found = docs.select("doc_id", F.inline(find(F.col("text"))))
        if parts == 1:
            return found
        found = saved(found, "windows")
        sent.destroy()
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs without those that hold a benchmark item."""
    items, parts = _parts(benchmark, item_bytes)
    for i in range(parts):
        find, sent = finder(docs.sparkSession, index_of(items, i, parts))
        left = docs.where(F.size(find(F.col("text"))) == 0)
        if parts == 1:
            return left
        left = saved(left, "windows")
        sent.destroy()
        if i:
            remove_table(docs)
        docs = left
    return docs


def op8_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
