from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 997}" for i in range(60_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty, odd and long texts, repeated rows, ties, and extra columns whose names clash."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all of it at last"
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n\x0b\x0c\r ", "en", "a"), (None, "no id at all, but words", "en", "b"), (None, None, None, "b"),
        (6, LONG, "en", "a"), (7, "one", "en", None), (8, "Two Words", "en", "c"), (9, "ÀÉ   ß x 日本 語", "fr", "c"), (10, "\n\n\n", "en", "c"), (11, base + " now", "en", "a"), (12, "X!!! Y!!! " * 50, "en", "a"),
    ]
    rows = [(*r, len(r[1]) if r[1] else None, 0.5, 1, "k", 2, "t", 3, 4) for r in rows]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int, kept_text string, tokens int, words string, fp int, blocks int"
    )


@pytest.fixture(scope="session")
def ids(messy):
    return sorted((r.doc_id for r in messy.select("doc_id").collect()), key=lambda x: (x is None, x))


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)
