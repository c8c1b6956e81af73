"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by the scoring workers.

Counting. Each task hashes the words of its documents and sums the n-grams of a few megabytes of text at a time. What it sends is one packed
row for each of many buckets: the bucket's n-grams sorted by context, with each context once. A bucket is a range of hashes of
whole n-grams, so a very frequent word's n-grams spread over all buckets. Buckets are merged into sorted runs of (hash, count). They give packed
sums for the next shorter n-grams, in how many different words' company each stands, and for their contexts: the sum of counts, and
how many have count 1, 2 and more. Those are merged in the same way, level by level down to single words. Above FAN buckets, rows
go to ranges of buckets first and are dealt to the buckets by a further stage, so that the number of rows doesn't grow with the square of the text.

Storing. Each merged bucket is a file of the shared folder: a sorted array of 64-bit hashes and arrays of counts. Workers map the
files, so that no worker holds the model in memory: a lookup picks the bucket by the hash's range, and searches its array. A worker
process opens a model once. In a store without file paths, it maps an unlinked copy.

Probability. With D(c) for counts 1, 2 and more from the counts of counts of a level, for a word w after a context h, h' being h without its first word:
p(w | h) = max(0, c(hw) - D(c(hw))) / c(h .) + g(h) * p(w | h'). c are counts at the longest contexts; below, the numbers of distinct words before.
The last p is max(0, n(. w) - D) / n(. .) + g / (V + 1). The g give the mass that the discounts took. A text begins after boundaries and ends
with one; the end counts as a token.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Edge cases: null, empty and word-less texts are the end alone; with nothing to learn from, every
probability is that of one unknown word, and base_score is that of no counts; repeated rows are counted and scored each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import textvec as tv
from keytide.llm.quality import fold
from keytide.llm.shared import scratch, ship, table

#: Words of the longest n-grams.
ORDER = 2
#: The hash that stands for the boundary of a text, as a word before its first and after its last.
END = np.uint64(0x2545F4914F6CDD1D)
#: Bytes of text whose n-grams are summed before they are sent: bounds memory, at about 30 bytes a byte.
SUMMED = 16 << 20
#: Bytes of text for each bucket; at least so many buckets; and the most to which a row is sent for each in one step.
BUCKET_BYTES, LEAST_BUCKETS, FAN = 16 << 20, 16, 1024
#: Bytes of text scored at once.
SCORED = 4 << 20
#: What is known of an n-gram: its count (words before it, below the longest); as a context, the sum of the counts of what follows and how many of those have count 1, 2
#: and more; and, of words, the tokens.
FIELDS = ("count", "after", "once", "twice", "more", "tokens")
_PACKED = "bucket int, kind int, blob binary"
GRAMS, CONTEXTS, STATS = 0, 1, 2


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and ends of rows one after another, each row led by a boundary; and the place of each boundary, with the
    end of all last."""
    starts, ends, first = tv.words(data, off)
    h = tv.word_hashes(data, starts, ends)
    n = np.diff(first)
    rows = len(n)
    # row r: boundary, its words, (the next row's boundary is its end); one more boundary at the very end
    place = first[:-1] + np.arange(rows)
    out = np.empty(len(h) + rows + 1, np.uint64)
    at = np.ones(len(out), bool)
    at[place] = at[-1] = False
    out[~at] = END
    out[at] = h
    return out, np.append(place, len(out) - 1)


def contexts(t: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """For each token but the first boundary, the hashes of the order - 1, ..., 2, 1 words before it; beyond the text's begin are boundaries."""
    before = [t[:-1]]
    if order > 2:
        at = np.arange(1, len(t))
        inside = at - place[np.searchsorted(place, at, "left") - 1]
        before += [np.where(k <= inside, t[np.maximum(at - k, 0)], END) for k in range(2, order)]
    out = []
    for k in range(order - 1, 0, -1):
        h = before[k - 1]
        for w in reversed(before[: k - 1]):
            h = tv.join_hash(h, w)
        out.append(h)
    return np.stack(out)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pack(hashes: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
    """Arrays as bytes; numbers take one byte each, where 255 stands for a larger one that is given in full behind."""
    big = [x[x >= 255].astype(np.int64) for x in numbers]
    head = [len(hashes), len(numbers), *map(len, hashes), *map(len, numbers), *map(len, big)]
    small = [np.minimum(x, 255).astype(np.uint8) for x in numbers]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (np.array(head, np.int64), *hashes, *big, *small))


def unpack(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    a, b = np.frombuffer(blob, np.int64, 2).tolist()
    head = np.frombuffer(blob, np.int64, a + 2 * b, 16).tolist()
    at = 16 + 8 * len(head)

    def take(kind, k):
        nonlocal at
        out = np.frombuffer(blob, kind, k, at)
        at += k * np.dtype(kind).itemsize
        return out

    hashes = [take(np.uint64, k) for k in head[:a]]
    big = [take(np.int64, k) for k in head[a + b :]]
    numbers = [take(np.uint8, k).astype(np.int64) for k in head[a : a + b]]
    for x, more in zip(numbers, big, strict=True):
        x[x == 255] = more
    return hashes, numbers


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def summed(keys: np.ndarray, sums: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the sums of each field, and the first of each of more arrays (last axis by key)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = _group_starts(keys) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(sums[:, order], start, axis=1) if len(keys) else sums
    return keys[start], total, *(x[..., order[start]] for x in more)


def _by_range(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted hashes, and where each one's are."""
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cut)).tolist():
        yield i, slice(int(cut[i]), int(cut[i + 1]))


def gram_rows(ctx: np.ndarray, w: np.ndarray, sums: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Packed sums of n-grams by bucket: ctx has the hashes of all their contexts, the longest first, and w the last words."""
    keys, sums, ctx, w = summed(tv.join_hash(ctx[0], w), sums, ctx, w)
    for i, own in _by_range(keys, buckets):
        by = np.argsort(ctx[0, own], kind="stable")
        c, part = ctx[:, own][:, by], sums[:, own][:, by]
        start = _group_starts(c[0])
        yield i, GRAMS, pack([*c[:, start], w[own][by]], [np.diff(np.append(start, c.shape[1])), *part])


def grams_from(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, numbers = unpack(blob)
    return np.repeat(np.stack(hashes[:-1]), numbers[0], axis=1), hashes[-1], np.stack(numbers[1:])


def key_rows(keys: np.ndarray, sums: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Packed sums of sorted distinct keys by bucket."""
    for i, own in _by_range(keys, buckets):
        yield i, CONTEXTS, pack([keys[own]], list(sums[:, own]))


def _rows(found: Iterator[tuple[int, int, bytes]], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    for row in found:
        held.append(row)
        if len(held) == at_once:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])


def _count(order: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            ctx, w = (np.concatenate([x[i] for x in held], axis=-1) for i in (0, 1))
            held.clear()
            yield from _rows(gram_rows(ctx, w, np.ones((1, len(w)), np.int64), buckets))

        for batch in batches:
            for _, _, data, off in tv.chunks(batch.column(0)):
                t, place = tokens(data, off)
                held.append((contexts(t, place, order), t[1:]))
                size += len(data)
                if size >= SUMMED:
                    size = 0
                    yield from flush()
        if held:
            yield from flush()

    return count


def _deal(buckets: int):
    """Packed n-grams of ranges of buckets, summed a few megabytes at a time, by bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush():
            ctx, w, sums = (np.concatenate(x, axis=-1) for x in zip(*map(grams_from, held), strict=True))
            held.clear()
            yield from _rows(gram_rows(ctx, w, sums, buckets))

        for batch in batches:
            for blob in batch.column(2).to_pylist():
                held.append(blob)
                size += len(blob)
                if size >= 2 * SUMMED:
                    size = 0
                    yield from flush()
        if held:
            yield from flush()

    return deal


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The blobs of each bucket by kind; rows come sorted by bucket."""
    now, blobs = None, [[], [], []]
    for batch in batches:
        for bucket, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now and now is not None:
                yield now, blobs
                blobs = [[], [], []]
            now = bucket
            blobs[kind].append(blob)
    if now is not None:
        yield now, blobs


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file of the model in the shared folder, whole or not at all, so that a repeated task does no harm."""
    fs, path = pafs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


def _run(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """A bucket's file: the sorted hashes; and of each column a byte for each, with the places and values of those of 255 and more."""
    big = [np.flatnonzero(c >= 255) for c in columns]
    parts = [np.array([len(keys), len(columns), *map(len, big)], np.int64), keys]
    for c, at in zip(columns, big, strict=True):
        parts += [at.astype(np.int64), c[at].astype(np.int64)]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (*parts, *(np.minimum(c, 255).astype(np.uint8) for c in columns)))


def _merge(folder: str, level: int, order: int, below: int):
    """Merges the buckets of n-grams of `level` words, and gives what there is to sum for those of one word less."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (grams, known, stats) in _by_bucket(batches):
            yield from _rows((-1, STATS, x) for x in stats)
            if bucket < 0:
                continue
            ctx, w, sums = (np.concatenate(x, axis=-1) for x in zip(*map(grams_from, grams), strict=True)) if grams else (np.zeros((level - 1, 0), np.uint64), np.zeros(0, np.uint64), np.zeros((2, 0), np.int64))
            keys, sums, ctx, w = summed(tv.join_hash(ctx[0], w), sums, ctx, w)
            c, own_tokens = sums[0], sums[-1]
            columns = [c]
            every = keys
            if level < order:  # these are contexts of longer ones, too
                parts = [unpack(x) for x in known]
                every, columns = _united(keys, c[None], np.concatenate([p[0][0] for p in parts]) if parts else keys[:0], np.concatenate([np.stack(p[1]) for p in parts], axis=1) if parts else np.zeros((4, 0), np.int64))
            _put(folder, f"{level}-{bucket}", _run(every, list(columns)))
            yield from _rows([(-1, STATS, pack([], [np.array([level, *((c == i).sum() for i in (1, 2, 3, 4)), 0, 0, 0])]))])
            after, mine = summed(ctx[0], np.stack([c, c == 1, c == 2, c > 2]).astype(np.int64))
            one = np.stack([np.ones(len(c), np.int64), own_tokens])
            if level > 2:
                yield from _rows(gram_rows(ctx[1:], w, one, below), 256)
                yield from _rows(key_rows(after, mine, below), 256)
            else:
                yield from _rows(key_rows(*_united(*summed(w, one), after, mine), below), 256)

    return merge


def _united(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of both, with the sums of the fields of x and those of y."""
    sums = np.zeros((len(x) + len(y), len(a) + len(b)), np.int64)
    sums[: len(x), : len(a)], sums[len(x) :, len(a) :] = x, y
    return summed(np.concatenate([a, b]), sums)


def _merge_words(folder: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stats():
            for bucket, (_, known, stats) in _by_bucket(batches):
                yield from (unpack(x)[1][0].tolist() for x in stats)
                if bucket >= 0:
                    parts = [unpack(x) for x in known]
                    w, s = summed(np.concatenate([p[0][0] for p in parts]), np.concatenate([np.stack(p[1]) for p in parts], axis=1))
                    count, own = s[0], s[1]
                    _put(folder, f"1-{bucket}", _run(w, [count, *s[2:], own]))
                    yield [1, *((count == i).sum() for i in (1, 2, 3, 4)), own.sum(), (own > 0).sum(), count.sum()]

        rows = [list(map(int, x)) for x in stats()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["counts"])

    return merge


def discounts(n: tuple[int, ...]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and more from the counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [0.0] + [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else min(k, y) for k in (1, 2, 3)]
    return np.array(d)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums over all of them; buckets and counts of counts by level, from words on."""

    folder: str
    buckets: tuple[int, ...]
    counts: tuple[tuple[int, ...], ...]
    tokens: int
    vocabulary: int
    kinds: int

    @property
    def order(self) -> int:
        return len(self.buckets)

    def score(self, maps: Maps, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, log10 probability by word counts, by the model) of each row."""
        t, place = tokens(data, off)
        ctx, then = contexts(t, place, self.order), t[1:]
        words, of = np.unique(t, return_inverse=True)  # the words that are looked up, as such and as contexts
        known = dict(zip(FIELDS, maps.look_up(1, words), strict=True))
        word, before = ({k: x[at] for k, x in known.items()} for at in (of[1:], of[:-1]))
        e, (m1, m2, *_) = discounts(self.counts[0]), self.counts[0]
        left = e[1] * m1 + e[2] * m2 + e[3] * max(0, self.vocabulary - m1 - m2)
        c = word["count"]
        p = np.maximum(0, c - e[np.minimum(c, 3)]) / max(1, self.kinds) + (left / self.kinds if self.kinds else 1.0) / (self.vocabulary + 1)
        for level in range(2, self.order + 1):
            h, d = ctx[self.order - level], discounts(self.counts[level - 1])
            c = maps.found(level, tv.join_hash(h, then))[0]
            over = before if level == 2 else dict(zip(FIELDS, maps.found(level - 1, h), strict=False))
            after = np.maximum(over["after"], 1)
            back = np.where(over["after"] > 0, (d[1] * over["once"] + d[2] * over["twice"] + d[3] * over["more"]) / after, 1.0)
            p = np.maximum(0, c - d[np.minimum(c, 3)]) / after + back * p
        base = np.log10((word["tokens"] + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        total = lambda x: np.add.reduceat(x, place[:-1])
        return np.diff(place), total((word["tokens"] > 0).astype(np.int64)), total(base), total(np.log10(np.maximum(p, 1e-300)))


class Maps:
    """A model's arrays, mapped when first needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}
        self.fs, self.path = pafs.FileSystem.from_uri(model.folder)

    def _map(self, name: str):
        """(hashes, columns) of a bucket, a column being bytes, places of larger numbers, and these."""
        if name not in self.open:
            self.open[name] = None if (m := self._file(name)) is None else self._parts(m)
        return self.open[name]

    @staticmethod
    def _parts(m: np.ndarray):
        n, k = m[:16].view(np.int64).tolist()
        big = m[16 : 16 + 8 * k].view(np.int64).tolist()
        at = 16 + 8 * k
        keys = m[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        columns = []
        for j, b in enumerate(big):
            small = m[len(m) - n * (k - j) : len(m) - n * (k - j - 1)]
            columns.append((small, m[at : at + 8 * b].view(np.int64), m[at + 8 * b : at + 16 * b].view(np.int64)))
            at += 16 * b
        return keys, columns

    def _file(self, name: str):
        at = f"{self.path}/{name}"
        if isinstance(self.fs, pafs.LocalFileSystem):
            return np.memmap(at, np.uint8, "r") if os.path.exists(at) else None
        if self.fs.get_file_info(at).type == pafs.FileType.NotFound:
            return None
        with tempfile.NamedTemporaryFile() as f, self.fs.open_input_stream(at) as g:  # a store without a path: a copy that is unlinked at once, and so is gone with the worker
            shutil.copyfileobj(g, f)
            f.flush()
            return np.memmap(f.name, np.uint8, "r")

    def found(self, level: int, h: np.ndarray) -> list[np.ndarray]:
        """look_up for hashes in any order."""
        keys, back = np.unique(h, return_inverse=True)
        return [x[back] for x in self.look_up(level, keys)]

    def look_up(self, level: int, keys: np.ndarray) -> list[np.ndarray]:
        """The columns of the n-grams of so many words by their sorted hashes: zero for those that there aren't."""
        columns = len(FIELDS) if level == 1 else 1 if level == self.model.order else len(FIELDS) - 1
        out = np.zeros((columns, len(keys)), np.int64)
        for bucket, own in _by_range(keys, self.model.buckets[level - 1]):
            if (m := self._map(f"{level}-{bucket}")) is None or not len(m[0]):
                continue
            at = np.minimum(np.searchsorted(m[0], keys[own]), len(m[0]) - 1)
            there = np.flatnonzero(m[0][at] == keys[own])
            at = at[there]
            for row, (small, places, values) in zip(out, m[1], strict=True):
                got = small[at].astype(np.int64)
                if len(places) and len(many := np.flatnonzero(got == 255)):
                    got[many] = values[np.searchsorted(places, at[many])]
                row[own.start + there] = got
        return list(out)


_opened: dict[str, Maps] = {}


def opened(model: Model) -> Maps:
    """The model's arrays, opened once by a worker process, which keeps those of one model."""
    if model.folder not in _opened:
        _opened.clear()
        _opened[model.folder] = Maps(model)
    return _opened[model.folder]


def model_folder(spark: SparkSession) -> str:
    """A new folder for a model: one that pyarrow opens too, as workers write and map its files themselves."""
    folder = scratch(spark, "lm")
    if ":" not in folder.split("/")[0]:
        folder = f"file://{os.path.abspath(folder)}"
    try:
        fs, path = pafs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"the language model needs spark.checkpoint.dir to be a folder that pyarrow opens: {folder}") from e
    fs.create_dir(path, recursive=True)
    return folder


def train(docs: DataFrame, learn_from: Column, order: int = ORDER) -> Model:
    """Counts the rows of docs for which learn_from holds; a shuffle of packed sums for each level."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    ship(spark)
    most = int(max(LEAST_BUCKETS, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)))
    buckets = (max(LEAST_BUCKETS // 2, most // 4), *(max(LEAST_BUCKETS, most // 2) for _ in range(order - 2)), most)
    folder = model_folder(spark)
    texts = docs.where(F.coalesce(learn_from, F.lit(False))).select("text")
    coarse = most if most <= FAN else -(-most // -(-most // FAN))
    rows = texts.mapInArrow(_count(order, coarse), _PACKED)
    if coarse < most:  # ranges of buckets first, each in as many tasks as it has buckets
        width = -(-most // coarse)
        rows = rows.repartition(most, "bucket", F.pmod(F.xxhash64("blob"), F.lit(width))).mapInArrow(_deal(most), _PACKED)
    for level in range(order, 1, -1):
        rows = rows.repartitionById(buckets[level - 1], F.greatest("bucket", F.lit(0))).sortWithinPartitions("bucket").mapInArrow(_merge(folder, level, order, buckets[level - 2]), _PACKED)
    rows = rows.repartitionById(buckets[0], F.greatest("bucket", F.lit(0))).sortWithinPartitions("bucket").mapInArrow(_merge_words(folder), "counts array<bigint>")
    rows = rows.groupBy(F.get("counts", F.lit(0)).alias("level")).agg(*(F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(1, 8)))
    found = {r.level: tuple(r)[1:] for r in rows.collect()}  # a row for each level
    none = (0,) * 7
    return Model(folder, buckets, tuple(found.get(i, none)[:4] for i in range(1, order + 1)), *found.get(1, none)[4:])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _kt_lm: n_tokens, n_known, base_score, score."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        maps = opened(model)
        for text in texts:
            parts = [model.score(maps, data, off) for _, _, data, off in tv.chunks(text, SCORED)]
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.StructArray.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)], ["n_tokens", "n_known", "base_score", "score"])

    return docs.withColumn("_kt_lm", score(F.col("text")))


def op3_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 1
    model = train(docs, ~held_out)
    return scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "_kt_lm.n_tokens", "_kt_lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "_kt_lm.base_score", "_kt_lm.score")
