"""Scans by key: ranges, key sets, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_range(df: DataFrame, pk: str, low: int, high: int) -> DataFrame:
    """Rows with low <= pk <= high; the bounds reach the Parquet scan."""
    return df.where(F.col(pk).between(low, high))


def key_ranges(df: DataFrame, pk: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows of any of the ranges, both ends included; ranges that meet are one filter."""
    joined: list[list[int]] = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    return df.where(reduce(Column.__or__, (F.col(pk).between(a, b) for a, b in joined), F.lit(False)) if joined else F.lit(False))


def key_set(df: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    """Rows with one of the keys. A semi-join: the side that is small is found at run time, and no list of literals is built."""
    return df.join(keys, pk, "left_semi")


def page(df: DataFrame, pk: str, n: int, after: int | None = None) -> DataFrame:
    """The next n rows by key."""
    rows = df if after is None else df.where(F.col(pk) > after)
    return rows.orderBy(pk).limit(n)


def largest_key(df: DataFrame, pk: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """max_pk of all rows or of a range; null if there are none."""
    rows = df if low is None else key_range(df, pk, low, high)
    return rows.agg(F.max(pk).cast("long").alias("max_pk"))


def latest(log: DataFrame, by: str) -> DataFrame:
    """The row with the largest `by`, without a sort."""
    return log.agg(F.max_by(F.struct(*log.columns), by).alias("x")).select("x.*")


def earliest(log: DataFrame, by: str) -> DataFrame:
    return log.agg(F.min_by(F.struct(*log.columns), by).alias("x")).select("x.*")
