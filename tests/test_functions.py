"""Pure functions against their tables of cases."""

from __future__ import annotations

import logging

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keytide.catalog import TRACE_CONFIG
from keytide.functions.logfmt import LogfmtFormatter
from keytide.functions.tuning import MOVES, Climb, Setting, State, Tuner, climbed, in_window
from keytide.model import ChunkStatus, Config, Stage
from keytide.operators import chunks


def test_hill_climb_trace():
    tuner = Tuner(TRACE_CONFIG, Setting(100, 4))
    got = [(s.batch, s.threads) for s in (tuner.update(30, 5, r) for r in (100, 200, 200, 300, 200, 200))]
    assert got == [(200, 4), (300, 4), (200, 8), (300, 8), (200, 8), (200, 8)]
    assert tuner.memory.best == Setting(200, 8)
    for _ in range(TRACE_CONFIG.optimal_use_limit):
        tuner.update(30, 5, 200)
    assert tuner.memory.best is None and tuner.now == Setting(300, 8)


CLIMB = Config(min_batch_size=100, batch_size_step=100, max_batch_size=1000, min_threads=1, threads_step=1, max_threads=4, optimal_use_limit=3)


@settings(deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_a_climb_never_leaves_its_bounds_and_grows_one_thing_at_a_time(rates):
    now, memory = Setting(100, 1), Climb()
    for rate in rates:
        before = memory.state(now, CLIMB)
        new, memory = climbed(now, rate, memory, CLIMB)
        assert 100 <= new.batch <= CLIMB.max_batch_size and 1 <= new.threads <= CLIMB.max_threads
        assert not (new.batch > now.batch and new.threads > now.threads and before is not State.HOLDING)
        assert memory.last == now and memory.rate == rate and (memory.uses < CLIMB.optimal_use_limit if memory.best else not memory.uses)
        now = new


def test_every_state_has_its_moves():
    assert set(MOVES) == {(s, paid) for s in State for paid in (True, False)}


@pytest.mark.parametrize(
    ("cpu", "latency", "want"),
    [(61, 5, Setting(3000, 0)), (41, 5, Setting(3000, 4)), (30, 51, Setting(1000, 0)), (30, 31, Setting(1500, 8)), (30, 5, Setting(3000, 8))],
)
def test_load_shedding(cpu, latency, want):
    assert Tuner(Config(), Setting(3000, 8)).update(cpu, latency, 0) == want


def test_recovers_from_nothing_and_counts_changes():
    tuner = Tuner(Config(), Setting(1000, 0))
    assert tuner.update(30, 5, 0) == Setting(1000, 1) and tuner.revision == 1
    tuner.update(30, 5, 0)
    assert tuner.revision == 1


def test_window():
    assert in_window("10:00", "10:00", "12:00") and in_window("12:00", "10:00", "12:00") and not in_window("12:01", "10:00", "12:00")
    assert in_window("23:30", "23:00", "01:00") and in_window("00:59", "23:00", "01:00") and not in_window("02:00", "23:00", "01:00")


def test_sparse_batches():
    b = chunks.SparseBatch(100)
    b.after(0)
    assert b.size == 200
    b.after(50)
    assert b.multiplier == 4
    b.after(100)
    assert b.multiplier == pytest.approx(3.6)


def test_resume_point():
    assert chunks.resume_point(ChunkStatus.DONE, 1, 9, 9) is None
    assert chunks.resume_point(ChunkStatus.NOT_STARTED, 1, None, None) == 1
    assert chunks.resume_point(ChunkStatus.IN_PROGRESS, 1, 5, None) == 6
    assert chunks.resume_point(ChunkStatus.DUPLICATE_KEY, 1, 5, 7) == 8
    assert chunks.resume_point(ChunkStatus.DUPLICATE_KEY, 1, 5, None) == 1


@settings(deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 20))
def test_bisection_covers_all_once(times, most):
    count = lambda a, b: sum(a <= t <= b for t in times)
    found = list(chunks.bisected(0, 50, count, most))
    assert [x for a, b in found for x in range(a, b + 1)] == list(range(51))
    assert all(a == b or count(a, b) <= most for a, b in found)


def test_stages_and_settings():
    assert Stage.LAYOUT < Stage.PRE_VALIDATION and Stage.SWAP_FAILED < Stage.SWAP
    with pytest.raises(ValueError, match="nonsense"):
        Config.of({"nonsense": 1})
    assert Config.of({"MIN_CHUNK_SIZE": 5}).min_chunk_size == 5


def test_log_lines():
    record = logging.LogRecord("copy", logging.WARNING, "", 0, 'said "%s"', ("no",), None)
    record.fields = {"chunk": 3, "note": ""}
    line = LogfmtFormatter().format(record)
    assert line.partition(" ")[2] == 'level=warning logger=copy msg="said \\"no\\"" chunk=3 note=""'
