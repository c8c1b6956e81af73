"""Quality of documents by a linear-chain conditional random field over lines.

A line is good or bad. Its features are those of itself and of the lines before and after it: length, shares of kinds of bytes and of
kinds of words, repetition. The field is fitted on labelled documents, whose lines all take the document's label; forward-backward
gives each line's marginal, and the document's score is their mean weighted by the lines' lengths.

The fit takes at most TRAIN_DOCS labelled documents (those with the lowest hash of doc_id) and all their lines; scoring covers every
line of every document. Labels, lang, source and doc_id are no features. Edge cases: a null or empty text is one empty line and gets a score
too; documents with several labels take the lowest, null labels are ignored; of several rows of a labelled doc_id one is learnt from, whose
text has the lowest hash; without any label every score is 0.5 and `keep_good` keeps all rows; repeated rows get equal scores; an
empty table gives an empty result; other columns are kept by `scored`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import textvec as tv
from keytide.llm.shared import ship, table

TRAIN_DOCS, ROUNDS, L2, THRESHOLD = 3000, 120, 1e-3, 0.7

# Kinds of bytes.
_KINDS = np.zeros((6, 256), bool)
_KINDS[0, 65:91] = True  # capitals
_KINDS[1, 48:58] = True  # digits
_KINDS[2, [ord(c) for c in ".,;:'\"-()?"]] = True  # common marks
_KINDS[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # all marks
_KINDS[4, 128:] = True  # beyond ASCII
_KINDS[5, [*range(9, 14), 32]] = True  # white space
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]] = True
N_FEATURES = 15


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, for each row the number of its first line and, last, that of all lines)."""
    breaks = np.flatnonzero(data == 10)
    lines_before = np.searchsorted(breaks, off)  # breaks before a row's start
    first = lines_before + np.arange(len(off))
    # Each row's lines start at its start and after each of its breaks; they end at its breaks and its end.
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    n_lines = len(starts)
    ends = np.empty(n_lines, np.int64)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = off[1:]
    size = (ends - starts).astype(float)
    feats = np.zeros((n_lines, N_FEATURES), np.float32)
    at_least_1 = np.maximum(size, 1)
    feats[:, 0] = np.log1p(size)
    c = np.zeros(len(data) + 1, np.int32)
    for k in range(6):
        np.cumsum(_KINDS[k][data], out=c[1:], dtype=np.int32)
        feats[:, 1 + k] = (c[ends] - c[starts]) / at_least_1
    w0, w1, _ = tv.words(data, off)
    if len(w0):
        line_of = np.searchsorted(starts, w0, "right") - 1
        n = np.bincount(line_of, minlength=n_lines)
        m = np.maximum(n, 1)
        tail, head = data[w1 - 1], data[w0]
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_LETTER[data], out=c[1:], dtype=np.int32)
        letters = c[w1] - c[w0]
        per = lambda x: np.bincount(line_of, x, n_lines) / m
        feats[:, 7] = np.log1p(n)
        feats[:, 8] = size / m / 10
        feats[:, 9] = per(letters == 0)
        feats[:, 10] = per(~_LETTER[tail] & ~_KINDS[2][tail])
        feats[:, 11] = per(~_LETTER[head])
        np.cumsum(_KINDS[0][data], out=c[1:], dtype=np.int32)
        feats[:, 12] = per((c[w1] - c[w0] == letters) & (letters > 1))
        feats[:, 13] = _repeats(tv.word_hashes(data, w0, w1), line_of, n) / m
        feats[:, 14] = per(w1 - w0 > 20)
    return feats, size, first


def _repeats(h: np.ndarray, line_of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many words of each line have come before in it."""
    order = np.lexsort((h, line_of))
    a, b = h[order], line_of[order]
    again = np.zeros(len(a), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return np.bincount(b[again], minlength=len(n)).astype(float)


def with_neighbours(feats: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of the line before, the line and the line after; zero beyond the document."""
    n = len(feats)
    out = np.zeros((n, 3 * feats.shape[1] + 3), np.float32)
    f = feats.shape[1]
    out[:, f : 2 * f] = feats
    out[1:, :f], out[:-1, 2 * f : 3 * f] = feats[:-1], feats[1:]
    starts, ends = first[:-1], first[1:] - 1
    out[starts, :f] = 0
    out[ends, 2 * f : 3 * f] = 0
    out[:, 3 * f] = 1
    out[starts, 3 * f + 1] = 1
    out[ends, 3 * f + 2] = 1
    return out


class Field:
    """Two labels; `weights` for a good line's features against a bad one's, `turns` for label pairs."""

    def __init__(self, mean: np.ndarray, std: np.ndarray) -> None:
        self.mean, self.std = mean.astype(np.float32), std.astype(np.float32)
        self.weights = np.zeros(3 * len(mean) + 3)
        self.turns = np.zeros((2, 2))
        self.fitted = False

    def scores(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((feats - self.mean) / self.std, first)

    def marginals(self, emit: np.ndarray, first: np.ndarray, expect: bool = False):
        """P(good) of each line from the log odds of lines; with expect also log Z and the expected label pairs."""
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = first[:-1][order], lengths[order]
        most = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(most), "left")  # sequences longer than t
        fwd, bwd = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
        e = np.zeros((len(emit), 2))
        e[:, 1] = emit
        t0 = starts[: active[0]] if most else starts[:0]
        fwd[t0] = e[t0]
        for t in range(1, most):
            at = starts[: active[t]] + t
            before = fwd[at - 1]
            fwd[at] = e[at] + np.logaddexp(before[:, :1] + self.turns[0], before[:, 1:] + self.turns[1])
        for t in range(most - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            after = e[at + 1] + bwd[at + 1]
            bwd[at] = np.logaddexp(self.turns[:, 0] + after[:, :1], self.turns[:, 1] + after[:, 1:])
        both = fwd + bwd
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        if not expect:
            return p
        ends = first[1:] - 1
        log_z = np.logaddexp(fwd[ends, 0], fwd[ends, 1])
        inner = np.ones(len(emit), bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        z = np.logaddexp(both[at, 0], both[at, 1])
        pairs = np.array([[np.exp(fwd[at, i] + self.turns[i, j] + e[at + 1, j] + bwd[at + 1, j] - z).sum() for j in (0, 1)] for i in (0, 1)])
        return p, log_z, pairs

    def fit(self, feats: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Field:
        """Adam on the mean log-likelihood of whole label chains."""
        x = self.scores(feats, first)
        y = np.repeat(labels, np.diff(first)).astype(float)
        inner = np.ones(len(y), bool)
        inner[first[1:] - 1] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[np.flatnonzero(inner)].astype(int), y[np.flatnonzero(inner) + 1].astype(int)), 1)
        theta, n = np.concatenate([self.weights, self.turns.ravel()]), len(y)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, rounds + 1):
            p, _, pairs = self.marginals(x @ self.weights, first, expect=True)
            grad = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / n - L2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            self.weights, self.turns = theta[:-4], theta[-4:].reshape(2, 2)
        self.fitted = True
        return self

    def documents(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, lines, lines more likely good) of each row."""
        feats, size, first = line_features(data, off)
        p = self.marginals(self.scores(feats, first).astype(float) @ self.weights, first)
        weight = size + 1
        total = lambda x: np.add.reduceat(x, first[:-1])
        return total(p * weight) / total(weight), np.diff(first), total((p >= 0.5).astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, bound: int = TRAIN_DOCS) -> Field:
    """A field fitted on at most `bound` labelled rows for which learn_from holds."""
    spark = docs.sparkSession
    ship(spark)
    chosen = labels.where(F.col("quality").isNotNull() & F.coalesce(learn_from, F.lit(False))).groupBy("doc_id").agg(F.min("quality").alias("_kt_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # so many rows at most: small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("_kt_label").alias("_kt_label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def features(batches):
        for batch in batches:
            out: list[list] = [[], []]
            for lo, hi, data, off in tv.chunks(batch.column(1)):
                feats, _, first = line_features(data, off)
                for i in range(hi - lo):
                    out[0].append(batch.column(0)[lo + i].as_py())
                    out[1].append(feats[first[i] : first[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["label", "feats"])

    got = rows.select(F.col("_kt_label").cast("int"), "text").mapInArrow(features, "label int, feats binary").toArrow()
    feats = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in got["feats"].to_pylist()]
    if not feats:
        return Field(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    order = sorted(range(len(feats)), key=lambda i: (len(feats[i]), feats[i].tobytes()))  # the same sums on every run
    label = np.array(got["label"].to_pylist())[order]
    feats = [feats[i] for i in order]
    every = np.concatenate(feats)
    first = np.concatenate([[0], np.cumsum([len(x) for x in feats])])
    return Field(every.mean(axis=0), every.std(axis=0) + 1e-3).fit(every, first, (label > 0).astype(int))


def score_udf(model: Field):
    @F.arrow_udf("struct<score: double, lines: bigint, good_lines: bigint>")
    def score(text: pa.Array) -> pa.Array:
        parts = [model.documents(data, off) for _, _, data, off in tv.chunks(text)]
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["score", "lines", "good_lines"])

    return score


def fold(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def scored(docs: DataFrame, model: Field) -> DataFrame:
    """docs with _kt_quality: score, lines, good_lines."""
    ship(docs.sparkSession)
    return docs.withColumn("_kt_quality", score_udf(model)(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold; labels of the held-out quarter aren't learnt from. All rows if
    there is no labelled row to learn from, as nothing then tells good from bad."""
    model = train(docs, labels, fold("doc_id", 4) != 2)
    if not model.fitted:
        return docs
    return scored(docs, model).where(F.col("_kt_quality.score") >= threshold).select(docs.columns)


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train(docs, labels, fold("doc_id", 4) != 2)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"),
        F.col("_kt_quality.score").alias("score"),
        (F.col("_kt_quality.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("_kt_quality.lines").alias("n_lines"),
        F.col("_kt_quality.good_lines").alias("n_good_lines"),
    )
