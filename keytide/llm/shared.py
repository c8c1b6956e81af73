"""What the operators of this package share: the shared folder, written tables, shipping of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_own: set[str] = set()
#: Keys with this share of all rows are joined by broadcast.
SHARE = 1 / 256
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset and driver and executors are one process (tests), a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keytide-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, in a folder of the application's own that is deleted when the driver ends."""
    app = f"{shared_dir(spark).rstrip('/')}/keytide-{spark.sparkContext.applicationId}"
    if app not in _own:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(app)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(hadoop)
        files.deleteOnExit(hadoop)
        _own.add(app)
    return f"{app}/{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
    """df as a written table in the shared folder: it cuts the lineage and survives lost executors. If lean, the shuffle files
    behind it go at once, and not when the driver collects its garbage."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if lean:
        spark.conf.set(name, "true")
    try:
        df.write.parquet(path := scratch(spark, label))
    finally:
        if lean:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def remove_table(df: DataFrame) -> None:
    """Deletes the files behind a table made by saved()."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def join_skewed(rows: DataFrame, keyed: DataFrame, on: list[str], count: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with keyed, a written table that has each key once and the number of its rows in `count`.

    Keys with SHARE of all rows or more, 1 / SHARE of them at most, are broadcast, so that their rows stay where they are; of the
    others none has many rows in one task."""
    most = max(2.0, (keyed.agg(F.sum(count)).first()[0] or 0) * SHARE)
    hot = keyed.where(F.col(count) >= most)
    many = rows.join(F.broadcast(hot), on)
    few = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keyed.where(F.col(count) < most), on, how)
    return many.unionByName(few)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, so that Python workers can import it, and bounds the
    bytes of an Arrow batch, as rows may be very long; a smaller bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="keytide-"), f"keytide-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan, from file sizes; only used to choose partition counts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
