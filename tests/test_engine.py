"""Chunks, versioned datasets, streaming, operations and whole copies."""

from __future__ import annotations

import glob
import random
from datetime import UTC, datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keytide.model import Config, LayoutSpec, Stage
from keytide.operators import chunks, compare, keylog
from keytide.plans import dataset, layout
from keytide.plans.dataset import Dataset, Names
from keytide.plans.migration import Migration
from keytide.plans.operation import Operation, operation, register
from keytide.sources import changelog
from keytide.sources.tables import check_key, database_and_table_exist, row_estimate
from keytide.streaming import apply as stream

SCHEMA = "id bigint, a string, b string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def numbered(n, low=0):
    return [(i, f"a{i % 3}", None if i % 5 == 0 else f"b{i}") for i in range(low, n)]


@pytest.mark.parametrize(("low", "high", "size", "most"), [(0, 10_000, 1000, 10), (0, 5, 1000, 10), (0, 0, 10, 10), (-20, 95, 10, 4), (7, 8, 1, 200)])
def test_chunks_cover_all_keys_once(spark, low, high, size, most):
    found = sorted(map(tuple, chunks.plan(spark, low, high, size, most).collect()))
    assert len(found) <= most and found[0][1] <= low and found[-1][2] == high
    assert all(b[1] == a[2] + 1 for a, b in zip(found, found[1:], strict=False))


def test_no_rows_no_chunks(spark):
    with pytest.raises(ValueError):
        chunks.plan(spark, None, None)


def test_keys_are_checked(spark):
    df = frame(spark, [(1, "x", "y")])
    assert check_key(df, "id") == "id"
    for bad in (("a",), ("id", "a")):
        with pytest.raises(ValueError):
            check_key(df, *bad)


def test_modes_differ_in_keys_that_are_missing(spark):
    src, dst, keys = frame(spark, [(1, "x", None), (2, "y", "z")]), frame(spark, [(1, "x", None)]), frame(spark, [(1,), (2,), (3,)], "id bigint")
    assert content(compare.not_updated(src, dst, keys, "id")) == [(2,)]
    assert content(compare.not_updated(src, dst, keys, "id", "cross")) == []
    assert content(compare.rematched_updated(src, dst, keys, "id")) == [(1,), (3,)]


@pytest.mark.parametrize("kind", ["base", "cross", "own_checks"])
def test_keys_that_the_destination_has_twice_are_owed_once_and_until_all_rows_match(spark, kind):
    @register("own_checks")
    class OwnChecks(Operation):
        def rematched_updated(self, src, dst, keys, pk):
            return super().rematched_updated(src, dst, keys, pk)

    src = frame(spark, [(1, "x", None), (2, "y", "z"), (3, "v", "w"), (4, "m", None)])
    dst = frame(spark, [(1, "x", None), (1, "old", None), (2, "y", "z"), (2, "y", "z"), (3, "old", "w"), (3, "v", "old"), (9, "g", None), (9, "g", None)])
    log = spark.createDataFrame([("U", 1, 1), ("U", 2, 1), ("U", 3, 1), ("I", 4, 1), ("D", 9, 1)], "op string, id bigint, ts bigint")
    owed, op = [(1, "not_updated"), (3, "not_updated"), (4, "not_updated"), (9, "not_removed")], operation(kind)
    found = op.unmatched(src, dst, log, "id")
    assert content(found) == owed and content(op.recheck(src, dst, found, "id")) == owed
    assert content(op.recheck(src, src, found, "id")) == []


def test_types_are_cast_in_cross_mode(spark):
    src, dst = frame(spark, [(1, 5), (2, 6)], "id bigint, v int"), frame(spark, [(1, "5"), (2, "no number")], "id bigint, v string")
    keys = frame(spark, [(1,), (2,)], "id bigint")
    assert content(compare.rematched_updated(src, dst, keys, "id", "cross")) == [(1,)]
    assert content(compare.not_updated(src, dst, keys, "id", "cross")) == [(2,)]


def test_events_are_decoded(spark):
    events = spark.createDataFrame(
        [("write", None, (1,), 5), ("update", (2,), (2,), 6), ("update", (3,), (4,), 7), ("delete", (5,), None, 8)], "kind string, before struct<pk: bigint>, after struct<pk: bigint>, ts bigint"
    )
    assert content(changelog.decode(events)) == [("D", 3, 7), ("D", 5, 8), ("I", 1, 5), ("I", 4, 7), ("U", 2, 6)]


def test_window_loader_adapts(spark):
    log = spark.createDataFrame([("I", i, 100 + i // 10) for i in range(100)] + [("D", 5, 300)], "op string, pk bigint, ts bigint")
    loader = keylog.WindowLoader(most=30, width=64)
    seen = set()
    for _ in range(20):
        if (found := loader.load(log)) is None:
            break
        seen |= {r.pk for r in found[0].collect()}
        if loader.mark == 300:
            break
    assert seen == set(range(100)) and loader.mark == 300


def test_dataset_versions(spark, tmp_path):
    src = frame(spark, numbered(100))
    data = Dataset.create(spark, f"file://{tmp_path}/d", src.schema, "id", span=10)
    assert data.read().count() == 0
    data.append(src, 0, 49)
    data.append(src, 0, 99)  # the first half is there already
    assert content(data.read()) == content(src)
    before = data.manifest["buckets"]
    now = frame(spark, [r for r in numbered(100) if r[0] != 42]).withColumn("a", F.when(F.col("id") == 7, "new").otherwise(F.col("a")))
    data.apply(now, frame(spark, [(7,), (42,), (1000,)], "id bigint"))
    assert content(data.read()) == content(now) and data.manifest["buckets"] == before
    data.compact()
    assert content(data.read()) == content(now) and not data.manifest["layers"]
    after = data.manifest["buckets"]
    assert {b for b in before if before[b] != after.get(b)} == {"0", "4"}
    data.vacuum()
    assert content(data.read()) == content(now)
    assert content(Dataset.at(spark, f"file://{tmp_path}/d").read()) == content(now)


def test_ranges_are_copied_at_once_and_change_no_folder(spark, tmp_path):
    src = frame(spark, numbered(100))
    data = Dataset.create(spark, f"file://{tmp_path}/d", src.schema, "id", span=30)
    data.append(src, ranges=[(0, 14), (15, 20), (70, 74)], width=5)
    assert content(data.read()) == content(src.where("id < 21 or id between 70 and 74")) and data.manifest["version"] == 1
    before = data.manifest["buckets"]
    data.append(src, ranges=[(10, 80)])
    assert content(data.read()) == content(src.where("id <= 80"))
    assert all(data.manifest["buckets"][b][: len(f)] == f for b, f in before.items())


@pytest.mark.parametrize(("seed", "most"), [(3, 2_000_000), (4, 16)])
def test_layers_read_as_the_newest_rows(spark, tmp_path, monkeypatch, seed, most):
    monkeypatch.setattr(dataset, "LAYERS", 4)
    monkeypatch.setattr(dataset, "LAYER_KEYS", most)
    r = random.Random(seed)
    state = {i: (i, f"a{i}", None) for i in range(40)}
    data = Dataset.create(spark, f"file://{tmp_path}/d", frame(spark, []).schema, "id", span=16)
    data.append(frame(spark, list(state.values())))
    for turn in range(6):
        keys = r.sample(range(50), 7)
        for k in keys:
            if k in state and r.random() < 0.5:
                del state[k]
            else:
                state[k] = (k, f"t{turn}", "b")
        data.apply(frame(spark, list(state.values())), frame(spark, [(k,) for k in keys], "id bigint"), turn)
        assert content(data.read()) == content(frame(spark, list(state.values()))) and len(data.manifest["layers"]) < 4
        if turn == 2:
            data.append(frame(spark, list(state.values()) + [(900, "x", "y")]))  # keys that layers deleted aren't there, and nothing is there twice
            state[900] = (900, "x", "y")
            assert content(data.read()) == content(frame(spark, list(state.values())))
    data.vacuum()
    data.lay_out(["a"], ["a"])
    assert content(data.read()) == content(frame(spark, list(state.values()))) and data.manifest["order"] == ["a", "id"]


def test_repeated_batches_do_nothing(spark, tmp_path):
    data = Dataset.create(spark, f"file://{tmp_path}/d", frame(spark, []).schema, "id", span=10)
    key = frame(spark, [(1,)], "id bigint")
    assert data.apply(frame(spark, [(1, "x", "y")]), key, 0) == 1
    assert data.apply(frame(spark, [(1, "other", "y")]), key, 0) is None
    assert content(data.read()) == [(1, "x", "y")]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_log_converges(spark, tmp_path, seed):
    r = random.Random(seed)
    state = {i: (i, f"a{i}", "b") for i in range(60)}
    old = dict(state)
    log = []
    for t in range(200):
        k = r.randrange(90)
        if k in state and r.random() < 0.4:
            del state[k]
            log.append(("D", k, t // 7))
        else:
            log.append(("U" if k in state else "I", k, t // 7))
            state[k] = (k, f"a{t}", None)
    src, dst = frame(spark, list(state.values())), frame(spark, list(old.values()))
    data = Dataset.create(spark, f"file://{tmp_path}/d", src.schema, "id", span=16)
    data.append(dst)
    keys = spark.createDataFrame(log, "op string, id bigint, ts bigint")
    data.apply(src, keys.select("id"))
    assert content(data.read()) == content(src)
    assert compare.unmatched(src, data.read(), keys, "id").isEmpty()


def test_stream_restarts_where_it_ended(spark, tmp_path):
    root = f"file://{tmp_path}"
    log = lambda rows: spark.createDataFrame(rows, changelog.SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/log")
    rows = {i: (i, "old", "x") for i in range(20)}
    schema = "pk bigint, a string, b string"
    data = Dataset.create(spark, f"{root}/d", frame(spark, [], schema).schema, "pk", span=5)
    data.append(frame(spark, list(rows.values()), schema))
    go = lambda: stream.start(spark, f"{root}/log", lambda: frame(spark, list(rows.values()), schema), data, f"{root}/cp", 1, f"{root}/keys").awaitTermination()
    rows[3] = (3, "new", "x")
    del rows[4]
    log([("U", 3, 1), ("U", 3, 2)])
    log([("D", 4, 3)])
    go()
    assert content(data.read()) == content(frame(spark, list(rows.values()), schema))
    version = data.manifest["version"]
    go()
    assert data.manifest["version"] == version
    rows[30] = (30, "new", None)
    log([("I", 30, 4)])
    go()
    assert content(data.read()) == content(frame(spark, list(rows.values()), schema))
    kept = spark.read.parquet(f"{root}/keys")
    assert kept.where("op = 'U'").count() == 1 and kept.where("op = 'U'").first().ts == 2


def test_swap(spark, tmp_path):
    names = Names(spark, f"file://{tmp_path}")
    names.set(src="one", dst="two")
    with pytest.raises(KeyError):
        names.swap("src", "nothing", "20240101")
    old = names.swap("src", "dst", "20240101")
    assert names.all() == {"src": "two", old: "one"}
    names.restore("src", "dst", old)
    assert names.all() == {"src": "one", "dst": "two"}


def test_layouts_last(spark, tmp_path):
    data = Dataset.create(spark, f"file://{tmp_path}/d", frame(spark, []).schema, "id", span=20)
    data.append(frame(spark, numbered(50)))
    layout.check_unique(data.read(), LayoutSpec("key", ("id",), unique=True))
    with pytest.raises(ValueError, match="unique"):
        layout.check_unique(data.read(), LayoutSpec("bad", ("a",), unique=True))
    data.lay_out(["a"], ["a", "b"])
    now = frame(spark, [(7, "zz", "new"), (8, "a0", "new")])
    data.apply(now, now.select("id"))
    data.compact()
    for folder in (f for folders in data.manifest["buckets"].values() for f in folders):
        rows = [r for f in glob.glob(f"{tmp_path}/d/{folder}/*.parquet") for r in pq.ParquetFile(f).read(["a", "id"]).to_pylist()]
        assert rows and [(r["a"], r["id"]) for r in rows] == sorted((r["a"], r["id"]) for r in rows)
    assert content(data.read().where("id in (7, 8)")) == content(now)
    assert layout.laid_out(data.read(), LayoutSpec("by_a", ("a",)), 2).count() == 50


def test_operations(spark):
    @register("odd")
    class Odd(Operation):
        def row_filter(self):
            return F.col("id") % 2 == 1

    assert operation("odd").source(frame(spark, numbered(6))).count() == 3
    with pytest.raises(KeyError):
        operation("nothing")
    with pytest.raises(TypeError):
        operation("retention", {"no_such_setting": 1})
    calls = []

    @register("watching")
    class Watching(Operation):
        def not_updated(self, src, dst, keys, pk):
            calls.append("not_updated")
            return super().not_updated(src, dst, keys, pk)

        def rematched_updated(self, src, dst, keys, pk):
            calls.append("rematched_updated")
            return super().rematched_updated(src, dst, keys, pk).where("id <> 3")

    src, dst = frame(spark, numbered(9)), frame(spark, [(i, "x", None) if i in (3, 4) else r for i, r in enumerate(numbered(7))])
    log = spark.createDataFrame([("U", 3, 1), ("U", 4, 1), ("U", 5, 1), ("I", 8, 2), ("D", 1, 2), ("D", 20, 3)], "op string, id bigint, ts bigint")
    found = [operation(n).unmatched(src, dst, log, "id") for n in ("base", "watching")]
    assert content(found[0]) == content(found[1]) == [(3, "not_updated"), (4, "not_updated"), (8, "not_updated")] and calls == ["not_updated"]
    assert content(operation("watching").recheck(src, src, found[0], "id")) == [(3, "not_updated")] and content(operation("base").recheck(src, src, found[0], "id")) == []
    times = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 3, 1))], "id bigint, ts timestamp")
    assert content(operation("retention", {"as_of": "2024-03-10"}).source(times).select("id")) == [(2,)]


@pytest.fixture
def copy(spark, tmp_path):
    """A source that changes, its log, and a maker of the Migration over them."""

    class Copy:
        schema = "pk bigint, a string, b string"
        rows = {r[0]: r for r in numbered(120)}
        log: list = []
        hidden: set = set()  # keys whose present row the copy doesn't get to see when it applies
        now = datetime(2024, 5, 6, 12, tzinfo=UTC)
        names: list = []

        def source(self, name):
            self.names.append(name)
            return frame(spark, list(self.rows.values()), self.schema)

        def make(self, **settings):
            settings = {"min_chunk_size": 25, "max_chunk_count": 4, "layouts": (LayoutSpec("by_a", ("a",)),), **settings}
            return Migration(spark, f"file://{tmp_path}/m", self.source, frame(spark, [], self.schema).schema, "pk", Config(**settings), lambda: spark.createDataFrame(self.log, "op string, pk bigint, ts bigint"), 32, lambda: self.now)

        def until(self, stage, **settings):
            run = self.make(**settings)
            while run.stage != stage:
                run.step()
            return run

        def change(self, ts):
            self.rows = self.rows | {5: (5, "changed", None), 500: (500, "new", "b")}
            self.rows.pop(6, None)
            self.log = [*self.log, ("U", 5, ts), ("D", 6, ts), ("I", 500, ts + 1)]

    made = Copy()
    made.rows, made.log, made.names = dict(Copy.rows), [], []
    return made


def test_whole_copy_swaps(spark, copy):
    copy.until(Stage.APPLY)
    copy.change(100)
    assert copy.make().run() == Stage.VALIDATION  # no leave to swap yet
    assert (done := copy.make(auto_swap=True)).run() == Stage.DONE
    assert content(done.target().read()) == content(copy.source("")) and done.target().manifest["order"] == ["a", "pk"]
    assert done.names.all() == {"source": "destination", "_source_old_20240506": "source"}
    assert done.unmatched().isEmpty() and "_source_old_20240506" in copy.names
    plan = done.plan().first()
    assert plan.final_max_id == 500 and plan.ended_at is not None
    assert [r.stage for r in done.status("stages").collect()] == ["CHUNKS", "BULK_COPY", "BULK_VALIDATION", "APPLY", "PRE_VALIDATION", "LAYOUT", "APPLY", "PRE_VALIDATION", "VALIDATION", "SWAP", "DONE"]
    assert done.layout_table().where("ended_at is null").isEmpty() and done.chunk_table().where("status <> 'done'").isEmpty()
    gauges = {r.name: r.value for r in done.gauges().collect()}
    assert gauges["unmatched_rows"] == 0 and gauges["last_loaded_timestamp"] == gauges["last_event_timestamp"] == 1 and gauges["updated_keys"] == gauges["removed_keys"] == 0
    assert gauges["bulk_progress"] > 90 and gauges["insert_rate"] > 0 and gauges["open_layouts"] == 0
    sizes = spark.createDataFrame([("log.000001", 10), ("log.000002", 30)], "name string, size bigint")
    done._segments = lambda: (sizes, "log.000002", 4)
    assert {r.name: r.value for r in done.gauges().collect()}["remaining_log_bytes"] == 0
    copy.now = copy.now.replace(hour=13)
    assert {r.name: r.value for r in done.gauges().collect()}["remaining_log_bytes"] == 26


def test_keys_that_never_match_keep_the_names_from_being_swapped(spark, copy):
    """A value that never matches, then a good key as the last entry of the log: however often it runs, no swap."""

    @register("losing")
    class Losing(Operation):
        lost = {5}

        def apply(self, target, src, keys):
            super().apply(target, src.withColumn("a", F.when(F.col("pk").isin(list(self.lost)), "lost").otherwise(F.col("a"))), keys)

    copy.until(Stage.APPLY, operation="losing")
    copy.change(100)
    copy.log.append(("U", 7, 5000))
    for turn in range(3):
        run = copy.make(operation="losing", auto_swap=True)
        assert run.run() == Stage.VALIDATION and run.state["validated"] == 5000
        assert content(run.debt()) == [(5, "not_updated")] and run.names.all() == {"source": "source", "destination": "destination"}
        assert [r.unmatched for r in run.status("validated").collect()] == [1] * (turn + 1)
    Losing.lost = {-1}
    assert (run := copy.make(operation="losing", auto_swap=True)).run() == Stage.DONE
    assert run.debt().isEmpty() and content(run.target().read()) == content(copy.source(""))


def test_names_are_restored_when_the_last_validation_fails(spark, copy):
    copy.until(Stage.SWAP, auto_swap=True)
    run = copy.make(auto_swap=True, swap_tries=2, swap_seconds=-1)
    assert run.step() == Stage.SWAP_FAILED
    assert run.names.all() == {"source": "source", "destination": "destination"} and run.state["old"] is None
    assert run.status("swaps").count() == 2


def test_a_driver_that_ends_within_the_swap_is_followed_by_one_that_ends_it(spark, copy):
    run = copy.until(Stage.SWAP, auto_swap=True)
    run.names.swap("source", "destination", "20240506")
    assert copy.make(auto_swap=True).run() == Stage.DONE
    assert run.names.all() == {"source": "destination", "_source_old_20240506": "source"}


def test_log_is_applied_by_windows_from_the_mark_on(spark, copy):
    copy.until(Stage.APPLY, layouts=())
    for i in range(60):
        copy.rows[i] = (i, "u", str(i))
        copy.log.append(("U", i, 1000 + 40 * i))
    settings = {"layouts": (), "pending_max": 16, "window_seconds": 300}
    assert (run := copy.make(**settings)).run() == Stage.VALIDATION
    loaded = run.status("loaded").collect()
    assert len(loaded) >= 4 and [r.mark for r in loaded] == sorted(r.mark for r in loaded) and run.state["loaded"] == 1000 + 40 * 59
    assert all(sum(r.start <= t <= r.end for _, _, t in copy.log) <= 17 for r in loaded)  # a boundary second is read twice
    assert content(run.target().read()) == content(copy.source(""))
    copy.change(9000)
    run = copy.make(**settings)
    assert run.catch_up(state := run.state) and run.lag(state) == 0
    new = [r for r in run.status("loaded").collect()[len(loaded) :]]
    assert new and all(r.end >= 1000 + 40 * 59 for r in new) and content(run.target().read()) == content(copy.source(""))


def test_application_waits_while_it_is_switched_off_or_behind(spark, copy):
    run = copy.until(Stage.APPLY, disable_apply=True)
    copy.change(100)
    assert run.run() == Stage.APPLY and run.state["loaded"] is None
    assert run.lag(run.state) == 101
    assert copy.make(layouts=()).run() == Stage.VALIDATION


def test_full_validation_finds_what_marks_have_passed(spark, copy):
    settings = {"layouts": (), "auto_swap": True, "full_validation_hours": 1.0}
    copy.until(Stage.APPLY, **settings)
    copy.change(100)
    copy.until(Stage.VALIDATION, **settings)
    run = copy.make(**settings)
    state = run.state
    run.validate(state)
    copy.rows[5] = (5, "silently", "other")  # no entry of the log tells
    run = copy.make(**settings)
    assert run.step() == Stage.VALIDATION and run.status("full_validated").count() == 1  # a full one is due; it pays the debt, and another round follows
    assert content(run.target().read()) == content(copy.source(""))
    assert run.run() == Stage.DONE and run.status("full_validated").count() == 1
    copy.now = copy.now.replace(hour=14)
    assert run._full_due(run.state)


def test_copy_goes_on_where_it_ended(spark, copy, monkeypatch):
    seen = []

    @register("breaking")
    class Breaking(Operation):
        def insert(self, target, src, ranges, width):
            seen.append((ranges, width))
            if len(seen) == 2:
                raise RuntimeError("lost")
            super().insert(target, src, ranges, width)

    settings = {"operation": "breaking", "batch_unit": 1, "min_batch_size": 1, "batch_size_step": 1, "max_batch_size": 4}
    run = copy.until(Stage.BULK_COPY, **settings)
    with pytest.raises(RuntimeError):
        run.step()
    states = [c["status"] for c in run.state["chunks"]]
    assert states[0] == "done" and "in_progress" in states and run.target().manifest["version"] == 1
    assert copy.make(**settings).step() == Stage.BULK_VALIDATION
    assert content(run.target().read()) == content(copy.source("")) and seen[1][0] == seen[2][0] and seen[2][1] != seen[0][1]


def test_settings_from_files_and_environment(tmp_path):
    (tmp_path / "c.toml").write_text('min_chunk_size = 7\npreferred_window = "22:00-02:00"\n[[layouts]]\nname = "x"\ncolumns = ["a", "b"]\n')
    c = Config.load(str(tmp_path / "c.toml"), {"KEYTIDE_AUTO_SWAP": "True", "KEYTIDE_SOURCE": "123", "KEYTIDE_CPU_SOFT": "12.5", "OTHER": "1", "KEYTIDE_SOURCE_ENDPOINT": "a"})
    assert (c.min_chunk_size, c.preferred_window, c.auto_swap, c.source, c.cpu_soft) == (7, ("22:00", "02:00"), True, "123", 12.5)
    assert c.layouts == (LayoutSpec("x", ("a", "b")),) and c.operation == "base"
    (tmp_path / "c.json").write_text('{"SOURCE_ENDPOINT": "a", "destination_endpoint": "b", "auto_swap": true}')
    c = Config.load(str(tmp_path / "c.json"), {})
    assert c.operation == "cross" and not c.auto_swap
    with pytest.raises(ValueError):
        Config.load(None, {"KEYTIDE_NONSENSE": "1"})


def test_log_inventory(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("I", i, i) for i in range(n)], changelog.SCHEMA)
    rows(50).repartition(3).write.parquet(f"file://{tmp_path}/log")
    files = changelog.segment_files(spark, f"file://{tmp_path}/log")
    assert {r.name: r.size for r in files.collect()} == {p.name: p.stat().st_size for p in (tmp_path / "log").iterdir() if p.suffix == ".parquet"}
    sizes = spark.createDataFrame([("log.999999", 10), ("log.1000000", 20), ("log.1000001", 30)], "name string, size bigint")
    assert changelog.segment_inventory(sizes, "log.1000000", 5).first()[0] == 45


def test_stream_that_goes_on(spark, tmp_path):
    root = f"file://{tmp_path}"
    schema = "pk bigint, a string, b string"
    data = Dataset.create(spark, f"{root}/d", frame(spark, [], schema).schema, "pk", span=5)
    put = lambda rows: spark.createDataFrame(rows, changelog.SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/log")
    put([("I", 1, 1)])
    query = stream.start(spark, f"{root}/log", lambda: frame(spark, [(1, "x", "y"), (2, "z", None)], schema), data, f"{root}/cp", every="1 second")
    query.processAllAvailable()
    put([("I", 2, 2)])
    query.processAllAvailable()
    query.stop()
    assert content(data.read()) == [(1, "x", "y"), (2, "z", None)]


def test_next_batch(spark):
    keys = lambda n: spark.range(n).select(F.col("id").alias("pk"))
    for u, r, kind in ((3, 5, "removed"), (5, 3, "updated"), (4, 4, "removed")):
        assert content(keylog.next_batch(keys(u), keys(r), 2)) == [(kind, 0), (kind, 1)]
    assert keylog.next_batch(keys(0), keys(0), 2).isEmpty()


def test_row_differences_count_repeated_rows(spark):
    a, b = frame(spark, [(1, "x", None)] * 3 + [(2, "y", "z")]), frame(spark, [(1, "x", None), (2, "y", None), (3, "w", "w")])
    assert content(compare.row_differences(a, b, "id")) == [(1, "source"), (1, "source"), (2, "destination"), (2, "source"), (3, "destination")]


def test_catalog(spark, tmp_path):
    assert database_and_table_exist(spark, "no_such_db.t") == (False, False)
    spark.sql("CREATE DATABASE IF NOT EXISTS kt_test")
    try:
        frame(spark, numbered(10)).write.mode("overwrite").option("path", f"{tmp_path}/t").saveAsTable("kt_test.t")
        assert database_and_table_exist(spark, "kt_test.t") == (True, True)
        assert row_estimate(spark, "kt_test.t") == 10
    finally:
        spark.sql("DROP DATABASE kt_test CASCADE")
