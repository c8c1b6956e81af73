"""Line dedup over levelled sorted runs of line hashes, native.

The lines of all documents are hashed once into a table, in batches of whole documents of BATCH_BYTES for each core. The batches go one
after another into a store of sorted runs of (hash, documents that have it): each new batch is merge-anti-joined with the run of hashes known to be
common, and adds its own run for the others; `fan` runs of a level are compacted into one of the next, and hashes that have reached
the threshold by then move to the run of common ones. After the last batch a compaction of all levels leaves exactly the keys
found in at least `least` documents, and the lines with such keys are dropped. A store may be kept and given more corpora.

Runs are tables bucketed and sorted by hash, one file a bucket, all with the same number of buckets. So neither the anti-join nor
a compaction shuffles or sorts a run: buckets of equal number are merged. Only a batch itself is shuffled, as sums by hash.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased; its hash has 128 bits. Documents are told apart
by doc_id, those without one by their text: several rows of one doc_id, equal or not, are one document. Edge cases: a null or empty text
is one empty line; keys of no code points are never dropped; a document of which all lines go keeps the empty text; repeated rows get
the same result each; an empty table gives an empty result; other columns are kept by `dedup_lines`, but for those named as its own, and
may have any names but those that begin with "_kt_".
"""

from __future__ import annotations

import contextlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm.shared import input_bytes, join_skewed, remove, saved, scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"
LEAST, FAN = 10, 2
#: Bytes of input in a batch for each core of the cluster.
BATCH_BYTES = 64 << 20
KEY = ["_kt_null", "_kt_id", "_kt_same"]
HASH = ["h1", "h2"]


@contextlib.contextmanager
def _in_order(spark: SparkSession):
    """Tables are scanned a bucket to a task, and scans of buckets that are one file each tell that they are sorted."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LineRuns:
    """Runs of (h1, h2, n) by level and the run of common hashes: names of tables bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, least: int, fan: int = FAN) -> None:
        self.spark, self.least, self.fan = spark, least, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.common: str | None = None
        self.folders: dict[str, str] = {}

    def _run(self, df: DataFrame) -> str:
        name, path = f"keytide_lines_{uuid.uuid4().hex}", scratch(self.spark, "lines-run")
        with _in_order(self.spark):
            df.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        self.folders[name] = path
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.folders.pop(name))

    def fresh(self, batch: DataFrame) -> DataFrame:
        """batch(h1, h2, n) without the hashes that are common already."""
        return batch.join(self.spark.table(self.common).hint("merge"), HASH, "left_anti") if self.common else batch

    def merged(self, one: str, two: str) -> DataFrame:
        """Two runs as one: their buckets are merged in pairs."""
        a, b = self.spark.table(one), self.spark.table(two).withColumnRenamed("n", "more")
        both = a.join(b.hint("merge"), HASH, "full")
        return both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

    def add(self, batch: DataFrame) -> None:
        """Counts the keys of batch(h1, h2, n) that aren't common yet in a run of their own."""
        self._push(self._run(self.fresh(batch)), 0)

    def _push(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            runs, self.levels[level] = self.levels[level], []
            self._push(self._compact(runs), level + 1)

    def _joined(self, one: str, two: str) -> str:
        out = self._run(self.merged(one, two))
        self._drop(one, two)
        return out

    def _compact(self, runs: list[str]) -> str:
        """One run of several; the hashes that have reached the threshold leave it for the common ones."""
        every = reduce(self._joined, runs)
        rows = self.spark.table(every)
        many = self._run(rows.where(F.col("n") >= self.least))
        rest = self._run(rows.where(F.col("n") < self.least))
        self.common = self._joined(self.common, many) if self.common else many
        self._drop(every)
        return rest

    def close(self) -> DataFrame:
        """All common hashes, each once, with the number of documents that made it one or more. More batches may follow."""
        runs = [r for level in self.levels for r in level]
        if runs:
            self.levels = [*([] for _ in self.levels), [self._compact(runs)]]
        return self.spark.table(self.common) if self.common else self.spark.createDataFrame([], "h1 bigint, h2 bigint, n bigint")

    def remove(self) -> None:
        self._drop(*list(self.folders))
        self.levels, self.common = [], None


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {"_kt_null": F.col("doc_id").isNull(), "_kt_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_kt_same": F.xxhash64("text")}
    )


def n_batches(docs: DataFrame) -> int:
    """Batches of BATCH_BYTES for each core, by the sizes of files; 8 if these aren't known."""
    size = input_bytes(docs)
    return 8 if size >= 1 << 60 else max(1, -(-size // (BATCH_BYTES * docs.sparkSession.sparkContext.defaultParallelism)))


def hashed_lines(docs: DataFrame, batches: int) -> tuple[DataFrame, str]:
    """Every line with a key, written by batch: (key of the document, pos, h1, h2, batch), and where. A document's rows are in one batch."""
    spark = docs.sparkSession
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = _keyed(docs.select("doc_id", "text")).select(*KEY, F.posexplode(lines).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where("key <> ''")
    of = F.xxhash64(F.lit("batch"), "_kt_id", F.when(F.col("_kt_null"), F.col("_kt_same")))
    rows = rows.select(
        *KEY, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), F.pmod(of, F.lit(batches)).cast("int").alias("batch")
    )
    if batches > 1:  # files of each batch as many as there are tasks for it, and not as many as there are tasks that read documents
        files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
        rows = rows.repartition(batches * files, "batch", F.pmod(F.xxhash64("_kt_id", "_kt_same", "pos"), F.lit(files)))
    rows.write.partitionBy("batch").parquet(path := scratch(spark, "lines"))
    return spark.read.schema(rows.schema).parquet(path), path


def dedup_lines(docs: DataFrame, least: int = LEAST, batches: int | None = None, fan: int = FAN, runs: LineRuns | None = None) -> DataFrame:
    """docs with the columns kept_text, n_lines and n_dropped. With `runs`, documents counted there before count too, and docs are added to it."""
    lines, path = hashed_lines(docs, batches or (batches := n_batches(docs)))
    store = runs or LineRuns(docs.sparkSession, least, fan)
    for b in range(batches):
        own = lines.where(F.col("batch") == b).select("_kt_id", F.when(F.col("_kt_null"), F.col("_kt_same")).alias("_kt_same"), "_kt_null", *HASH)
        store.add(own.distinct().groupBy(*HASH).agg(F.count("*").alias("n")))
    common = store.close()
    gone = join_skewed(lines.select(*KEY, "pos", *HASH), common, HASH).groupBy(*KEY).agg(F.collect_set("pos").alias("_kt_gone"))
    gone = saved(gone, "lines-gone")
    remove(docs.sparkSession, path)
    if runs is None:
        store.remove()
    rows = _keyed(docs).join(gone, KEY, "left").withColumn("_kt_text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_kt_lines", F.split("_kt_text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_kt_lines") - 1), F.col("_kt_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("_kt_lines", i)), "\n")
    made = ("kept_text", "n_lines", "n_dropped")
    return rows.select(
        *(c for c in docs.columns if c.lower() not in made),
        F.when(F.col("_kt_gone").isNull(), F.col("_kt_text")).otherwise(kept).alias("kept_text"),
        F.size("_kt_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_kt_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_runs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
