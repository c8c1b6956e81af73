"""The corpus pipeline and its stages against brute force."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_ops import check_hits, roots, tok

import corpus_pipeline
from keytide.llm import mixing, nearcopies, quality, simhash
from keytide.llm import textvec as tv

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(t):
    w = tuple(tok(t))
    return frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) if w else frozenset()


def heads(rows):
    """The smallest doc_id of each component of (doc_id, text) linked by similarities of 0.8 or more."""
    sets = {grams(t) for _, t in rows}
    of = {s: i for i, s in enumerate(sets)}
    pairs = [(of[a], of[b]) for a in sets for b in sets if of[a] < of[b] and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1 and len(a & b) / len(a | b) >= 0.8]
    where, low = roots(set(of.values()), pairs), {}
    for i, t in rows:
        low.setdefault(where[of[grams(t)]], []).append(i)
    return sorted((min((i for i in ids if i is not None), default=None) for ids in low.values()), key=lambda x: (x is None, x))


def copies(n=12, each=6):
    """Texts with copies of which a few words differ, so that similarities lie on both sides of 0.8."""
    r = random.Random(5)
    out = []
    for _ in range(n):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice((12, 60, 200)))]
        for _ in range(each):
            w = list(base)
            for _ in range(r.choice((0, 1, max(1, len(w) // 60), len(w) // 40, len(w) // 20))):
                w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize(("hot", "block"), [(1, 300), (3, 1 << 20), (32, 1 << 20)])
def test_near_copies_at_the_similarity_stay_once(spark, monkeypatch, hot, block):
    rows = copies()
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)
    monkeypatch.setattr(nearcopies, "HOT", hot)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    want = heads(rows)
    assert 12 < len(want) < len({t for _, t in rows})
    assert sorted(r.doc_id for r in corpus_pipeline.stage_simhash(spark, df, "").collect()) == want


def chains(n=24):
    """Windows that slide over texts: similarities of neighbours are 0.9, and 0.74 at one place in the middle of each."""
    r = random.Random(6)
    long = [[f"w{r.randrange(10**6)}" for _ in range(1000)] for _ in range(2)]
    out = [" ".join(w[at : at + 200]) for w in long for at in [10 * i + 20 * (i >= n // 2) for i in range(n)]]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("each", [60, 120])
def test_rows_of_pairs_grow_with_a_group_and_not_with_its_square(spark, monkeypatch, each):
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base[:at] + [f"x{i}"] + base[at + 1 :]) for i, at in ((i, r.randrange(200)) for i in range(each))]
    made, meetings = [], nearcopies.meetings
    monkeypatch.setattr(nearcopies, "meetings", lambda *args: made.append(meetings(*args)) or made[0])
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)
    assert [x.doc_id for x in corpus_pipeline.stage_simhash(spark, df, "").collect()] == [0] == heads(rows)
    assert each - 1 <= made[0].count() <= 8 * each


@pytest.mark.parametrize(("first", "block"), [(1, 3000), (4, 1 << 20)])
def test_links_that_stars_leave_out_are_found(spark, monkeypatch, first, block):
    rows = [(i, t) for i, (_, t) in enumerate(copies() + chains())]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)
    want = heads(rows)
    monkeypatch.setattr(nearcopies, "HEADS", first)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    assert sorted(x.doc_id for x in corpus_pipeline.stage_simhash(spark, df, "").collect()) == want
    # all sets in one group, whose first set is similar to few of them
    one = lambda sets, _: sets.crossJoin(sets.agg(F.min("fp").alias("a"))).where("fp > a").select("a", F.col("fp").alias("b"), F.lit(True).alias("near"), F.lit(True).alias("more"))
    monkeypatch.setattr(nearcopies, "meetings", one)
    assert sorted(x.doc_id for x in corpus_pipeline.stage_simhash(spark, df, "").collect()) == want


def test_near_copies_of_the_fixture_and_edge_cases(spark, sf, messy, none):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), messy):
        kept = simhash.keep_one(df, nearcopies.near_copies)
        assert kept.columns == df.columns
        got = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
        assert got == heads([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert simhash.keep_one(none, nearcopies.near_copies).count() == 0


def test_sign_bits_of_sets_differ_by_their_angle():
    r = np.random.default_rng(4)
    for n, extra in ((9, 1), (300, 33)):
        grams = [r.integers(0, 2**63, n + extra, dtype=np.uint64) for _ in range(300)]
        (at, ac), (bt, bc) = (nearcopies.fingerprints(s) for s in ([np.sort(g[:n]) for g in grams], [np.sort(g[extra:]) for g in grams]))
        angle = np.arccos((n - extra) / n) / np.pi
        assert abs(np.bitwise_count(ac ^ bc).mean() / 8 - angle) < 0.01 and abs(np.bitwise_count(ac ^ np.roll(bc, 1, 0)).mean() / 8 - 0.5) < 0.01
        ids, size = np.arange(300), np.full(300, n)
        a, b = (nearcopies.entries(ids, size, c, t, range(nearcopies.TABLES))["key"].reshape(300, nearcopies.TABLES, -1) for t, c in ((at, ac), (bt, bc)))
        met = (a[:, :, :, None] == b[:, :, None, :]).any((2, 3))
        # 0.8 and 0.802: every pair meets somewhere, and unrelated ones hardly ever
        assert 0.11 < met.mean() < 0.16 and met.any(1).all()
        assert (a[:, :, :, None] == np.roll(b, 1, 0)[:, :, None, :]).any((2, 3)).mean() < 1e-4


def test_the_stage_gets_its_pairs_by_sign_bits(spark, monkeypatch):
    rows = copies(3)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)
    monkeypatch.setattr(nearcopies, "RADIUS", -1)
    assert corpus_pipeline.stage_simhash(spark, df, "").count() == len({grams(t) for _, t in rows})


def written(folder, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def items_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def order(rows):
    return sorted(map(tuple, rows), key=str)


def chained(spark, folder):
    """Every stage on the rows that the stage before it gave, each compared with brute force; the last stage's rows."""
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = tables["documents"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert stages == [corpus_pipeline.stage_quality, corpus_pipeline.stage_simhash, corpus_pipeline.stage_decontaminate, corpus_pipeline.stage_mix, corpus_pipeline.stage_shard]
    took = []
    for stage in stages:
        rows = docs.collect()
        out = stage(spark, docs, folder)
        out = spark.createDataFrame(out.collect(), out.schema)
        assert stage is corpus_pipeline.stage_shard or out.columns == docs.columns
        took.append((rows, out.collect()))
        docs = out
    # quality: scores of the model outside Spark
    before, after = took[0]
    model = quality.train(tables["documents"], tables["labels"], quality.fold("doc_id", 4) != 2)
    score = lambda t: model.documents(*next(tv.chunks(pa.array([t], pa.string())))[2:])[0][0]
    usable = any(x.quality is not None and x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 != 2 and any(r.doc_id == x.doc_id for r in before) for x in tables["labels"].collect())
    assert order(after) == order(r for r in before if not usable or score(r.text) >= quality.THRESHOLD)
    # near copies
    before, after = took[1]
    assert sorted((r.doc_id for r in after), key=lambda x: (x is None, x)) == heads([(r.doc_id, r.text) for r in before]) and set(map(tuple, after)) <= set(map(tuple, before))
    # benchmark: every item under an id of its own, and every document too
    before, after = took[2]
    items = items_of(spark, [(i, r.text) for i, r in enumerate(tables["benchmark"].collect())])
    held = {i for i, _, _ in check_hits(spark.createDataFrame([(i, r.text) for i, r in enumerate(before)], "doc_id bigint, text string"), items)}
    assert order(after) == order(r for i, r in enumerate(before) if i not in held)
    # mixing: each row once at least, and no more than the limit allows
    before, after = (collections.Counter(map(tuple, x)) for x in took[3])
    assert set(before) == set(after) and all(before[r] <= after[r] <= mixing.REPEATS * before[r] for r in before)
    # shards: sizes and check sums of every row, slots without gaps
    before, after = took[4]
    data = lambda r: (r.text or "").encode()
    assert order((r.doc_id, r.size, r.text_crc32) for r in after) == order((r.doc_id, len(data(r)) + 16, zlib.crc32(data(r))) for r in before)
    slots = collections.defaultdict(list)
    for r in after:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return took


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(("the", "river", "walks", "under", "a", "bridge", "of", "stone", f"name{r.randrange(400)}")) for _ in range(n)) + "."
    item = "which of these nine planets is the nearest one to the sun at all times of year"
    texts = [prose(60) for _ in range(40)] + ["@@ ## 1 2 3 $$ %% ^^ " * 12 + str(i) for i in range(12)]
    texts += [texts[0], texts[1] + " more", f"{prose(20)} {item} {prose(20)}"]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 3 == 0], len(t)) for i, t in enumerate(texts)], COLUMNS)
    labels = labels_of(spark, [(i, int(i < 40), 0) for i in range(52)])
    folder = written(tmp_path, docs, labels, items_of(spark, [(1, None), (None, item), (None, item)]))
    took = chained(spark, folder)
    assert [len(a) > len(b) for a, b in took[:3]] == [True] * 3 and 54 not in {x.doc_id for x in took[2][1]}
    assert order(corpus_pipeline.run(spark, folder).collect()) == order(took[-1][1])


def test_items_without_an_id_count(spark, tmp_path):
    item = "which of these nine planets is the nearest one to the sun at all times of year"
    docs = spark.createDataFrame([(1, f"before {item} after", "en", "a", 1), (2, "something else", "en", "a", 1)], COLUMNS)
    folder = written(tmp_path, docs, labels_of(spark), items_of(spark, [(None, item), (7, None)]))
    assert [r.doc_id for r in corpus_pipeline.stage_decontaminate(spark, docs, folder).collect()] == [2]


def test_without_usable_labels_all_documents_stay(spark, messy):
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for rows in ([], [(held_out, 1, 0)], [(1, None, 0)], [(999, 1, 0)]):
        assert quality.keep_good(messy, labels_of(spark, rows)).count() == messy.count()


def test_pipeline_on_messy_and_empty_tables(spark, tmp_path, messy, none):
    folder = written(tmp_path / "messy", messy, labels_of(spark), items_of(spark, [(None, None), (None, "no id at all, but words"), (3, "")]))
    assert len(chained(spark, folder)[-1][1]) > 0
    nulls = messy.select(*(F.lit(None).cast(t).alias(c) for c, t in messy.dtypes))
    for name, docs in (("none", none), ("nulls", nulls)):
        out = corpus_pipeline.run(spark, written(tmp_path / name, docs, labels_of(spark), items_of(spark)))
        assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.isEmpty() == (name == "none")
