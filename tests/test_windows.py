"""The window loader's whole plan against a replay by brute force."""

from __future__ import annotations

import pytest

from keytide import catalog
from keytide.operators import keylog
from keytide.sources import fixtures


def replayed(rows, most, width):
    """The loader's windows until its mark is the last second, with the numbers of their keys, by brute force over (op, pk, ts)."""
    out, mark, high = [], None, max(ts for _, _, ts in rows)
    while mark != high:
        start, grown = min(ts for _, _, ts in rows) if mark is None else mark, False
        while True:
            part = [r for r in rows if start <= r[2] <= start + width]
            if max(sum(r[0] == op for r in part) for op in "IUD") > most and not grown:
                width //= 2
                assert width
            elif mark is not None and max(r[2] for r in part) == start:
                width, grown = width * 2, True
            else:
                break
        removed = {r[1] for r in part if r[0] == "D"}
        out.append((len(out), start, start + width, len({r[1] for r in part if r[0] != "D"} - removed), len(removed)))
        mark = max(r[2] for r in part)
    return out


def test_window_plan_covers_the_whole_log(spark, sf):
    log = fixtures.key_log(spark, sf)
    rows = [(r.op, r.pk, r.ts) for r in log.collect()]
    want = replayed(rows, 200, 3600 * 24)
    got = sorted(tuple(r) for r in catalog.QUERIES["window_loader_plan"](spark, sf).collect())
    assert got == want and len(want) > 5
    assert all(any(start <= ts <= end for _, start, end, _, _ in got) for _, _, ts in rows)


def test_window_plan_is_the_loaders(spark):
    rows = [("I", i, 100 + i // 10) for i in range(100)] + [("U", i, 100 + i // 3) for i in range(60)] + [("D", 5, 300), ("D", 7, 109), ("I", 7, 109), ("D", 9, 9000)]
    log = spark.createDataFrame(rows, "op string, pk bigint, ts bigint")
    found = keylog.windows(log, 30, 64)
    assert sorted(tuple(r) for r in keylog.window_sizes(log, found).collect()) == replayed(rows, 30, 64)
    loader = keylog.WindowLoader(most=30, width=64)
    for x in found:
        assert loader.next(log) == x
        loader.load(log)
    assert loader.mark == 9000
    assert keylog.windows(log.limit(0), 30, 64) == [] and keylog.window_sizes(log.limit(0), []).count() == 0
    with pytest.raises(ValueError):
        keylog.windows(log, 5, 64)
