"""Layout steps: what indexes are to a database. Parquet has none; rows are ordered, files have Bloom filters, and columns that must be
unique are checked. Dataset.lay_out writes a layout; this module has what comes before it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keytide.model import LayoutSpec
from keytide.operators.compare import duplicates


def laid_out(df: DataFrame, spec: LayoutSpec, partitions: int) -> DataFrame:
    """Rows in ranges of the columns, sorted within: readers skip row groups by their bounds."""
    return df.repartitionByRange(partitions, *spec.columns).sortWithinPartitions(*spec.columns)


def check_unique(df: DataFrame, spec: LayoutSpec) -> None:
    if spec.unique and (found := duplicates(df, *spec.columns).take(3)):
        raise ValueError(f"{spec.name}: {', '.join(spec.columns)} aren't unique: {found}")
