"""Operations: what of the source is copied and how rows change on the way.

An operation has one filter and one projection, both used for the copy, the application and every check, so that these can't disagree.
Beyond these, each step of a copy is a method that an operation may override: insert, apply, max_pk, not_imported, not_inserted,
not_updated, not_removed, rematched_updated and rematched_removed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.operators import compare, scans
from keytide.plans.dataset import Dataset

REGISTRY: dict[str, type[Operation]] = {}


def register(name: str):
    def put(cls):
        REGISTRY[name] = cls
        return cls

    return put


def operation(name: str, settings: dict | None = None, **more) -> Operation:
    """A registered operation, with its settings checked by its own fields."""
    if name not in REGISTRY:
        raise KeyError(f"no operation {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**(settings or {}), **more)


@register("base")
@dataclass
class Operation:
    #: "base" where both sides are at one endpoint, "cross" where they may differ in types.
    mode: str = "base"

    def row_filter(self) -> Column | None:
        return None

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def source(self, df: DataFrame) -> DataFrame:
        keep = self.row_filter()
        return self.transform(df if keep is None else df.where(keep))

    def insert(self, target: Dataset, src: DataFrame, ranges: list[tuple[int, int]], width: int) -> None:
        """Copies the rows of ranges of keys that the target lacks."""
        target.append(src, ranges=ranges, width=width)

    def apply(self, target: Dataset, src: DataFrame, keys: DataFrame) -> None:
        """Brings changed keys to the source's present state: updates and deletes alike."""
        target.apply(src, keys)

    def max_pk(self, src: DataFrame, pk: str) -> DataFrame:
        return scans.largest_key(src, pk)

    def not_imported(self, src: DataFrame, dst: DataFrame, pk: str, low: int | None = None, high: int | None = None) -> DataFrame:
        return compare.not_imported(src, dst, pk, low, high)

    def not_inserted(self, src: DataFrame, dst: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
        return compare.not_inserted(src, dst, keys, pk)

    def not_updated(self, src: DataFrame, dst: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
        return compare.not_updated(src, dst, keys, pk, self.mode)

    def not_removed(self, src: DataFrame, dst: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
        return compare.not_removed(src, dst, keys, pk)

    def rematched_updated(self, src: DataFrame, dst: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
        return compare.rematched_updated(src, dst, keys, pk, self.mode)

    def rematched_removed(self, src: DataFrame, dst: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
        return compare.rematched_removed(src, dst, keys, pk)

    def _own(self, *names: str) -> bool:
        return any(getattr(type(self), n) is not getattr(Operation, n) for n in names)

    def unmatched(self, src: DataFrame, dst: DataFrame, log: DataFrame, pk: str) -> DataFrame:
        """(pk, unmatch_type) of a key log: in one pass over both sides, or by the operation's own checks if it has any."""
        if not self._own("not_inserted", "not_updated", "not_removed"):
            return compare.unmatched(src, dst, log, pk, self.mode)
        of = lambda op: log.where(F.col("op") == op).select(pk).distinct()
        late = self.not_inserted(src, dst, of("I"), pk).union(self.not_updated(src, dst, of("U"), pk)).select(pk, F.lit("not_updated").alias("unmatch_type"))
        return late.union(self.not_removed(src, dst, of("D"), pk).select(pk, F.lit("not_removed"))).distinct()

    def recheck(self, src: DataFrame, dst: DataFrame, found: DataFrame, pk: str) -> DataFrame:
        """What of unmatched(pk, unmatch_type) still is. By an operation's own checks, a key that rows of both kinds have is owed until none is stale."""
        if not self._own("not_inserted", "not_updated", "not_removed", "rematched_updated", "rematched_removed"):
            return compare.recheck(src, dst, found, pk, self.mode)
        of = lambda kind: found.where(F.col("unmatch_type") == kind).select(pk)
        good = self.rematched_updated(src, dst, of("not_updated"), pk).select(pk).join(self.not_updated(src, dst, of("not_updated"), pk), pk, "left_anti")
        good = good.select(pk, F.lit("not_updated").alias("unmatch_type")).union(self.rematched_removed(src, dst, of("not_removed"), pk).select(pk, F.lit("not_removed")))
        return found.join(good, [pk, "unmatch_type"], "left_anti")


@register("cross")
@dataclass
class CrossOperation(Operation):
    mode: str = "cross"


@register("retention")
@dataclass
class Retention(Operation):
    """Only rows of the last so many days."""

    column: str = "ts"
    days: int = 30
    as_of: str | None = None

    def row_filter(self) -> Column:
        now = F.current_timestamp() if self.as_of is None else F.lit(self.as_of).cast("timestamp")
        return F.col(self.column).cast("timestamp") > now - F.make_dt_interval(F.lit(self.days))
