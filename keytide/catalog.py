"""The engine's queries on the derived fixtures, each with SQL for the comparison where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.tuning import Setting, Tuner
from keytide.model import Config, LayoutSpec, Stage
from keytide.operators import chunks, compare, keylog, mutate, scans
from keytide.plans import monitor
from keytide.plans.dataset import Dataset, Names
from keytide.plans.migration import Migration
from keytide.plans.operation import Operation, operation, register
from keytide.plans.store import Store
from keytide.sources import changelog, fixtures
from keytide.sources.tables import column_list, epoch, table
from keytide.streaming import apply as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PK = fixtures.PK


WHOLE = "pk, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"


def _whole(df: DataFrame) -> DataFrame:
    """Whole rows, the time as text."""
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def query(sql: str | None = None, fixture: bool = True):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {fixtures.SQL} {sql}" if fixture else sql
        return f

    return put


def _src(s, d):
    return fixtures.source(s, d)


def _dst(s, d):
    return fixtures.destination(s, d)


def _sides(s, d):
    return _src(s, d), _dst(s, d)


def _keys(s, d, *ops):
    return fixtures.keys(s, d, *ops)


ROW = "a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice AND a.o_orderdate IS NOT DISTINCT FROM b.o_orderdate AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority"
KEYS = "SELECT DISTINCT pk FROM kl WHERE op"


@query("SELECT pk, o_custkey, o_orderstatus, o_totalprice FROM src WHERE pk BETWEEN 100 AND 999")
def pk_range_scan(s, d):
    return scans.key_range(_src(s, d), PK, 100, 999).select(PK, "o_custkey", "o_orderstatus", "o_totalprice")


@query(f"SELECT pk, o_custkey, o_orderpriority FROM src WHERE pk IN ({KEYS} = 'U')")
def key_set_scan(s, d):
    return scans.key_set(_src(s, d), _keys(s, d, "U"), PK).select(PK, "o_custkey", "o_orderpriority")


@query("SELECT string_agg(column_name, ',' ORDER BY column_index) AS columns FROM duckdb_columns() WHERE table_name = 'orders'", fixture=False)
def column_catalog(s, d):
    return s.createDataFrame([(column_list(table(s, d, "orders")),)], "columns string")


@query("SELECT max(pk) AS max_pk FROM src")
def max_pk(s, d):
    return scans.largest_key(_src(s, d), PK)


@query("SELECT max(pk) AS max_pk FROM dst WHERE pk BETWEEN 0 AND 970")
def max_pk_in_range(s, d):
    return scans.largest_key(_dst(s, d), PK, 0, 970)


CHUNKS = """m AS (SELECT min(pk) AS lo, max(pk) AS hi, greatest(1, least(max(pk) // 100, 20)) AS n FROM src),
c AS (SELECT CAST(i AS INTEGER) AS chunk_id, CAST(CASE WHEN i = 0 THEN least(lo, 1) ELSE i * (hi // n) + 1 END AS BIGINT) AS start_pk,
             CAST(CASE WHEN i = n - 1 THEN hi ELSE (i + 1) * (hi // n) END AS BIGINT) AS end_pk
      FROM m, (SELECT unnest(range(20)) AS i) WHERE i < n)"""


def _chunks(s, d):
    low, high = _src(s, d).agg(F.min(PK), F.max(PK)).first()
    return chunks.plan(s, low, high, 100, 20)


@query(f", {CHUNKS} SELECT chunk_id, start_pk, end_pk FROM c")
def chunk_plan(s, d):
    return _chunks(s, d)


@query(f", {CHUNKS} SELECT chunk_id, count(src.pk) AS n FROM c LEFT JOIN src ON src.pk BETWEEN start_pk AND end_pk GROUP BY chunk_id")
def chunk_row_counts(s, d):
    return chunks.row_counts(_src(s, d), PK, _chunks(s, d))


@query("SELECT CAST(s AS BIGINT) AS start_pk, CAST(least(s + 1000, hi) AS BIGINT) AS end_pk FROM (SELECT unnest(range(0, hi + 1, 1001)) AS s, hi FROM (SELECT max(pk) AS hi FROM src))")
def bulk_validation_ranges(s, d):
    return chunks.validation_ranges(s, 0, scans.largest_key(_src(s, d), PK).first()[0], 1000)


@query(
    """, b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM kl), w AS (SELECT op, lo, hi, (hi - lo) * 100 // count(*) AS w FROM kl, b GROUP BY op, lo, hi),
    r AS (SELECT op, hi, w, unnest(range(lo, hi + 1, w + 1)) AS start_ts FROM w)
    SELECT op, start_ts, CAST(least(start_ts + w, hi) AS BIGINT) AS end_ts FROM r"""
)
def event_ts_ranges(s, d):
    log = fixtures.key_log(s, d)
    return chunks.time_ranges(log, 100, *keylog.bounds(log).first())


@query("SELECT pk, o_custkey FROM src WHERE pk > 500 ORDER BY pk LIMIT 100")
def keyset_page(s, d):
    return scans.page(_src(s, d), PK, 100, 500).select(PK, "o_custkey")


@query("SELECT pk FROM src WHERE pk NOT IN (SELECT pk FROM dst)")
def not_imported(s, d):
    return compare.not_imported(*_sides(s, d), PK)


@query("SELECT pk FROM src WHERE pk BETWEEN 0 AND 1000 AND pk NOT IN (SELECT pk FROM dst)")
def not_imported_in_range(s, d):
    return compare.not_imported(*_sides(s, d), PK, 0, 1000)


@query(f"SELECT pk FROM src WHERE pk IN ({KEYS} = 'I') AND pk NOT IN (SELECT pk FROM dst)")
def not_inserted(s, d):
    return compare.not_inserted(*_sides(s, d), _keys(s, d, "I"), PK)


@query(f"SELECT a.pk FROM src a LEFT JOIN dst b ON a.pk = b.pk WHERE a.pk IN ({KEYS} = 'U') AND (b.pk IS NULL OR NOT ({ROW}))")
def not_updated_base(s, d):
    return compare.not_updated(*_sides(s, d), _keys(s, d, "U"), PK)


@query(f"SELECT a.pk FROM src a JOIN dst b ON a.pk = b.pk WHERE a.pk IN ({KEYS} = 'U') AND NOT ({ROW})")
def not_updated_cross(s, d):
    return compare.not_updated(*_sides(s, d), _keys(s, d, "U"), PK, "cross")


@query(f"SELECT pk FROM ({KEYS} = 'D') WHERE pk IN (SELECT pk FROM dst) AND pk NOT IN (SELECT pk FROM src)")
def not_removed(s, d):
    return compare.not_removed(*_sides(s, d), _keys(s, d, "D"), PK)


@query(f"SELECT pk FROM ({KEYS} = 'D') WHERE pk IN (SELECT pk FROM src)")
def reinserted_keys(s, d):
    return compare.reinserted(_src(s, d), _keys(s, d, "D"), PK)


REMATCHED = f"SELECT a.pk FROM src a JOIN dst b ON a.pk = b.pk WHERE a.pk IN ({KEYS} = 'U') AND {ROW} UNION SELECT pk FROM ({KEYS} = 'U') WHERE pk NOT IN (SELECT pk FROM src)"


@query(REMATCHED)
def rematched_updated_base(s, d):
    return compare.rematched_updated(*_sides(s, d), _keys(s, d, "U"), PK)


@query(REMATCHED)
def rematched_updated_cross(s, d):
    src, dst = _sides(s, d)
    return compare.rematched_updated(src, dst.withColumn("o_custkey", F.col("o_custkey").cast("string")), _keys(s, d, "U"), PK, "cross")


@query(f"SELECT pk FROM ({KEYS} = 'D') WHERE pk NOT IN (SELECT pk FROM dst) UNION SELECT pk FROM ({KEYS} = 'D') WHERE pk IN (SELECT pk FROM src)")
def rematched_removed(s, d):
    return compare.rematched_removed(*_sides(s, d), _keys(s, d, "D"), PK)


UNMATCHED = f"""un AS (
    SELECT pk, 'not_updated' AS unmatch_type FROM src WHERE pk IN ({KEYS} = 'I') AND pk NOT IN (SELECT pk FROM dst)
    UNION SELECT a.pk, 'not_updated' FROM src a LEFT JOIN dst b ON a.pk = b.pk WHERE a.pk IN ({KEYS} = 'U') AND (b.pk IS NULL OR NOT ({ROW}))
    UNION SELECT pk, 'not_removed' FROM ({KEYS} = 'D') WHERE pk IN (SELECT pk FROM dst) AND pk NOT IN (SELECT pk FROM src))"""


@query(f", {UNMATCHED} SELECT pk, unmatch_type FROM un")
def unmatched_rows(s, d):
    return compare.unmatched(*_sides(s, d), fixtures.key_log(s, d), PK)


@query(
    f""", {UNMATCHED}, fixed AS (SELECT * FROM dst WHERE pk % 2 = 1 OR pk NOT IN (SELECT pk FROM un)
        UNION ALL SELECT src.* FROM src WHERE pk % 2 = 0 AND pk IN (SELECT pk FROM un))
    SELECT pk, unmatch_type FROM un WHERE pk % 2 = 1"""
)
def unmatched_after_recheck(s, d):
    """Half of the unmatched keys are put right, and the check is repeated."""
    src, dst = _sides(s, d)
    found = compare.unmatched(src, dst, fixtures.key_log(s, d), PK)
    fixed = mutate.applied(src, dst, found.where(F.col(PK) % 2 == 0).select(PK).distinct(), PK)
    return compare.recheck(src, fixed, found, PK)


@query("SELECT op, pk, ts FROM kl")
def key_log_compact(s, d):
    return fixtures.key_log(s, d)


@query("SELECT op, count(*) AS n FROM kl GROUP BY op")
def key_log_counts(s, d):
    return keylog.counts(fixtures.key_log(s, d))


@query("SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM kl")
def event_ts_bounds(s, d):
    return keylog.bounds(fixtures.key_log(s, d))


@query("SELECT op, pk, ts FROM kl WHERE ts BETWEEN 1704500000 AND 1705000000")
def log_window_scan(s, d):
    return keylog.window(fixtures.key_log(s, d), 1704500000, 1705000000)


@query(f"{KEYS} IN ('I', 'U') EXCEPT {KEYS} = 'D'")
def batch_updated_minus_removed(s, d):
    return keylog.updated_keys(fixtures.key_log(s, d))


@query(f"{KEYS} = 'D'")
def batch_removed(s, d):
    return keylog.removed_keys(fixtures.key_log(s, d))


@query("SELECT pk, CASE WHEN max(ts) FILTER (WHERE op = 'D') > coalesce(max(ts) FILTER (WHERE op <> 'D'), -1) THEN 'D' ELSE 'W' END AS last_op FROM kl GROUP BY pk")
def last_operation_by_key(s, d):
    return keylog.last_operations(fixtures.key_log(s, d)).select(PK, F.when(F.col("op") == "D", "D").otherwise("W").alias("last_op"))


def _halves(s, d):
    log = fixtures.key_log(s, d)
    middle = 1705300000
    return log.where(F.col("ts") < middle), log.where(F.col("ts") >= middle)


PENDING = """a AS (SELECT * FROM kl WHERE ts < 1705300000), b AS (SELECT * FROM kl WHERE ts >= 1705300000),
u1 AS (SELECT pk FROM a WHERE op IN ('I','U') EXCEPT SELECT pk FROM a WHERE op = 'D'), r1 AS (SELECT DISTINCT pk FROM a WHERE op = 'D'),
u2 AS (SELECT pk FROM b WHERE op IN ('I','U') EXCEPT SELECT pk FROM b WHERE op = 'D'), r2 AS (SELECT DISTINCT pk FROM b WHERE op = 'D'),
u AS (SELECT pk FROM (SELECT pk FROM u1 UNION SELECT pk FROM u2) EXCEPT SELECT pk FROM r2), r AS (SELECT pk FROM r1 UNION SELECT pk FROM r2)"""


@query(f", {PENDING} SELECT 'updated' AS kind, pk FROM u UNION ALL SELECT 'removed', pk FROM r")
def pending_merge_live(s, d):
    a, b = _halves(s, d)
    u, r = keylog.merge_pending(keylog.updated_keys(a), keylog.removed_keys(a), keylog.updated_keys(b), keylog.removed_keys(b))
    return u.select(F.lit("updated").alias("kind"), PK).union(r.select(F.lit("removed").alias("kind"), PK))


@query(
    f""", {PENDING}, {UNMATCHED}, nu AS (SELECT pk FROM un WHERE unmatch_type = 'not_updated'), nr AS (SELECT pk FROM un WHERE unmatch_type = 'not_removed')
    SELECT 'updated' AS kind, pk FROM ((SELECT pk FROM u UNION SELECT pk FROM nu) EXCEPT SELECT pk FROM nr) UNION ALL SELECT 'removed', pk FROM (SELECT pk FROM r UNION SELECT pk FROM nr)"""
)
def feedback_sets(s, d):
    a, b = _halves(s, d)
    u, r = keylog.merge_pending(keylog.updated_keys(a), keylog.removed_keys(a), keylog.updated_keys(b), keylog.removed_keys(b))
    found = compare.unmatched(*_sides(s, d), fixtures.key_log(s, d), PK)
    of = lambda kind: found.where(F.col("unmatch_type") == kind).select(PK)
    u, r = keylog.feed_back(u, r, of("not_updated"), of("not_removed"))
    return u.select(F.lit("updated").alias("kind"), PK).union(r.select(F.lit("removed").alias("kind"), PK))


@query(
    """, t AS (SELECT list(ts ORDER BY ts) FILTER (WHERE op = 'I') AS li, list(ts ORDER BY ts) FILTER (WHERE op = 'U') AS lu, list(ts ORDER BY ts) FILTER (WHERE op = 'D') AS ld, list(ts ORDER BY ts) AS every, min(ts) AS lo, max(ts) AS hi FROM kl),
    try(start, width, grown, first, emit) AS (
        SELECT lo, CAST(86400 AS BIGINT), false, true, false FROM t
        UNION ALL
        SELECT CASE WHEN good THEN last ELSE start END, CASE WHEN good THEN width WHEN most > 200 AND NOT grown THEN width // 2 ELSE width * 2 END, NOT good AND (grown OR most <= 200), first AND NOT good, good
        FROM (SELECT *, NOT (most > 200 AND NOT grown) AND (first OR last > start) AS good
              FROM (SELECT start, width, grown, first, hi, list_max(list_filter(every, lambda x: x >= start AND x <= start + width)) AS last,
                           greatest(len(list_filter(li, lambda x: x >= start AND x <= start + width)), len(list_filter(lu, lambda x: x >= start AND x <= start + width)), len(list_filter(ld, lambda x: x >= start AND x <= start + width))) AS most
                    FROM try, t WHERE first OR start < hi) a) b),
    marks AS (SELECT start AS mark, width FROM try WHERE emit UNION ALL SELECT lo, NULL FROM t),
    w AS (SELECT CAST(row_number() OVER (ORDER BY mark) - 1 AS INTEGER) AS "window", mark AS start_ts, mark + lead(width) OVER (ORDER BY mark) AS end_ts FROM marks),
    k AS (SELECT "window", start_ts, end_ts, pk, max(op IN ('I', 'U')) AS w, max(op = 'D') AS r FROM w JOIN kl ON ts BETWEEN start_ts AND end_ts WHERE end_ts IS NOT NULL GROUP BY ALL)
    SELECT "window", start_ts, end_ts, count(*) FILTER (WHERE w AND NOT r) AS n_updated, count(*) FILTER (WHERE r) AS n_removed FROM k GROUP BY ALL"""
)
def window_loader_plan(s, d):
    """All windows of the loader, with the numbers of keys of each."""
    log = fixtures.key_log(s, d)
    return keylog.window_sizes(log, keylog.windows(log, most=200, width=3600 * 24))


@query(f"SELECT pk FROM ({KEYS} IN ('I', 'U') EXCEPT {KEYS} = 'D') ORDER BY pk LIMIT 50")
def smallest_pending_keys(s, d):
    return keylog.pop(keylog.updated_keys(fixtures.key_log(s, d)), 50)


@query(f"SELECT pk FROM ({KEYS} IN ('I', 'U') EXCEPT {KEYS} = 'D') ORDER BY pk DESC LIMIT 50")
def largest_pending_keys(s, d):
    return keylog.pop(keylog.updated_keys(fixtures.key_log(s, d)), 50, largest=True)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1", fixture=False)
def latest_checkpoint(s, d):
    return scans.latest(table(s, d, "events").select("event_id", "event_type"), "event_id")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1", fixture=False)
def first_checkpoint(s, d):
    return scans.earliest(table(s, d, "events").select("event_id", "event_type"), "event_id")


PROGRESS = f"""{CHUNKS}, p AS (SELECT chunk_id, start_pk, end_pk, CASE WHEN chunk_id % 4 = 3 THEN 'in_progress' ELSE 'done' END AS status,
    CASE WHEN chunk_id % 4 = 2 THEN NULL WHEN chunk_id % 4 = 3 THEN start_pk + 10 ELSE end_pk END AS last_pk FROM c)"""


def _progress(s, d):
    i = F.col("chunk_id") % 4
    last = F.when(i == 2, F.lit(None)).when(i == 3, F.col("start_pk") + 10).otherwise(F.col("end_pk"))
    return _chunks(s, d).select("*", F.when(i == 3, "in_progress").otherwise("done").alias("status"), last.alias("last_pk"))


@query(f", {PROGRESS} SELECT chunk_id FROM p WHERE NOT (status = 'done' AND last_pk IS NOT DISTINCT FROM end_pk)")
def incomplete_chunks(s, d):
    return chunks.incomplete(_progress(s, d)).select("chunk_id")


@query(f", {PROGRESS} SELECT CAST(coalesce(sum(CASE WHEN last_pk >= start_pk THEN last_pk - start_pk END), 0) AS DOUBLE) / (SELECT max(pk) FROM src) * 100 AS percent FROM p")
def bulk_progress(s, d):
    return chunks.progress(_progress(s, d), scans.largest_key(_src(s, d), PK).first()[0])


@query(f", k AS ({KEYS} = 'U'), q AS (SELECT * FROM dst WHERE pk NOT IN (SELECT pk FROM src WHERE pk IN (SELECT pk FROM k)) UNION ALL SELECT * FROM src WHERE pk IN (SELECT pk FROM k)) SELECT {WHOLE} FROM q")
def apply_updates(s, d):
    return _whole(mutate.updated(*_sides(s, d), _keys(s, d, "U"), PK))


@query(f"SELECT pk, o_custkey FROM dst WHERE pk NOT IN ({KEYS} = 'D')")
def apply_deletes(s, d):
    return mutate.without(_dst(s, d), _keys(s, d, "D"), PK).select(PK, "o_custkey")


@query(f"SELECT {WHOLE} FROM (SELECT * FROM dst WHERE pk NOT IN (SELECT pk FROM kl) UNION ALL SELECT * FROM src WHERE pk IN (SELECT pk FROM kl))")
def apply_batch(s, d):
    return _whole(mutate.applied(*_sides(s, d), fixtures.keys(s, d, "I", "U", "D"), PK))


@query(f", k AS ({KEYS} IN ('I', 'U') EXCEPT {KEYS} = 'D'), q AS (SELECT * FROM dst WHERE pk NOT IN (SELECT pk FROM src WHERE pk IN (SELECT pk FROM k)) UNION ALL SELECT * FROM src WHERE pk IN (SELECT pk FROM k)) SELECT {WHOLE} FROM q WHERE pk NOT IN ({KEYS} = 'D')")
def apply_batch_in_order(s, d):
    log = fixtures.key_log(s, d)
    return _whole(mutate.applied_in_batches(*_sides(s, d), keylog.updated_keys(log), keylog.removed_keys(log), PK))


@query(f"SELECT {WHOLE} FROM src WHERE pk NOT IN (SELECT pk FROM dst)")
def bulk_copy_missing(s, d):
    return _whole(mutate.copy_missing(*_sides(s, d), PK))


@query("SELECT pk, side FROM (SELECT pk, 'source' AS side FROM (SELECT * FROM src EXCEPT ALL SELECT * FROM dst) UNION ALL SELECT pk, 'destination' FROM (SELECT * FROM dst EXCEPT ALL SELECT * FROM src))")
def row_differences(s, d):
    return compare.row_differences(*_sides(s, d), PK)


DIFFERENCES = "SELECT count(*) AS n FROM (SELECT * FROM (SELECT * FROM src EXCEPT ALL SELECT * FROM q) UNION ALL SELECT * FROM (SELECT * FROM q EXCEPT ALL SELECT * FROM src))"
APPLIED = "q AS (SELECT * FROM dst WHERE pk NOT IN (SELECT pk FROM k) UNION ALL SELECT * FROM src WHERE pk IN (SELECT pk FROM k))"


@query(f", k AS (SELECT pk FROM src UNION SELECT pk FROM dst), {APPLIED} {DIFFERENCES}")
def converged_diff(s, d):
    """Differences left after every key of both sides is applied."""
    src, dst = _sides(s, d)
    done = mutate.applied(src, dst, src.select(PK).union(dst.select(PK)).distinct(), PK)
    return compare.row_differences(src, done, PK).agg(F.count("*").alias("n"))


@query(f", k AS (SELECT DISTINCT pk FROM kl), {APPLIED} {DIFFERENCES}")
def applied_diff(s, d):
    """Differences left after the keys of the log are applied: what the log doesn't tell."""
    src, dst = _sides(s, d)
    done = mutate.applied(src, dst, fixtures.keys(s, d, "I", "U", "D"), PK)
    return compare.row_differences(src, done, PK).agg(F.count("*").alias("n"))


@query("SELECT pk, o_custkey FROM src WHERE o_orderdate > TIMESTAMP '1998-08-02' - INTERVAL 365 DAY")
def retention_copy(s, d):
    keep = operation("retention", {"column": "o_orderdate", "days": 365, "as_of": "1998-08-02"})
    return keep.source(_src(s, d)).select(PK, "o_custkey")


SEGMENTS = "seg AS (SELECT 'log.' || lpad(CAST(event_id // 100 AS VARCHAR), 6, '0') AS name, CAST(sum(40 + length(props)) AS BIGINT) AS size FROM events GROUP BY 1)"


@query(f"WITH {SEGMENTS} SELECT CAST(coalesce(sum(size), 0) - 100 AS BIGINT) AS lag_bytes FROM seg WHERE name >= 'log.000005'", fixture=False)
def log_lag_bytes(s, d):
    name = F.concat(F.lit("log."), F.lpad(F.expr("event_id div 100").cast("string"), 6, "0"))
    segments = table(s, d, "events").groupBy(name.alias("name")).agg(F.sum(F.length("props") + 40).alias("size"))
    return changelog.segment_inventory(segments, "log.000005", 100)


@query(f"WITH {SEGMENTS}, n AS (SELECT name, size, CAST(split_part(name, '.', 2) AS BIGINT) AS number FROM seg) SELECT name, size, number FROM n WHERE number >= 5 ORDER BY number LIMIT 4", fixture=False)
def log_segments_to_read(s, d):
    """The next round's segments: a round has a fixed number of them."""
    name = changelog.segment_name("log", F.expr("event_id div 100"))
    segments = table(s, d, "events").groupBy(name.alias("name")).agg(F.sum(F.length("props") + 40).alias("size"))
    return changelog.segments_to_read(segments, "log.000005", 4)


@query("SELECT min(ts) AS first_ts, max(ts) AS last_ts, max(ts) - min(ts) AS seconds FROM log WHERE ts > 1")
def event_lag(s, d):
    return monitor.event_lag(fixtures.change_log(s, d))


@query("SELECT round(avg(m), 6) AS mean_rate FROM (SELECT user_id % 5 AS w, avg(user_id) AS m FROM events GROUP BY 1)", fixture=False)
def mean_insert_rate(s, d):
    points = table(s, d, "events").select((F.col("user_id") % 5).alias("w"), "user_id")
    return monitor.mean_rate(points, "w", "user_id").select(F.round("mean_rate", 6).alias("mean_rate"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM src GROUP BY ALL HAVING count(*) > 1")
def index_unique_check(s, d):
    return compare.duplicates(_src(s, d), "o_custkey", "o_orderpriority")


@query(f", {UNMATCHED} SELECT name, value FROM (SELECT 'unmatched_rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM un UNION ALL SELECT 'source_rows', CAST(count(*) AS DOUBLE) FROM src UNION ALL SELECT 'batch_size', 1000.0)")
def metrics(s, d):
    found = compare.unmatched(*_sides(s, d), fixtures.key_log(s, d), PK)
    return monitor.metrics(s, unmatched_rows=found.agg(F.count("*")), source_rows=_src(s, d).agg(F.count("*")), batch_size=1000, unknown=None)


def _work(s: SparkSession) -> str:
    """A new folder for a query that writes, in the shared folder where one is named; it goes when the driver ends."""
    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not (s.sparkContext.master == "local" or s.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = f"{(base or 'file://' + tempfile.mkdtemp(prefix='keytide-')).rstrip('/')}/keytide-work-{uuid.uuid4().hex[:12]}"
    Store(s, root).delete_on_exit()
    return root


@query(f"SELECT {WHOLE} FROM (SELECT * FROM dst WHERE pk NOT IN (SELECT pk FROM log) UNION ALL SELECT * FROM src WHERE pk IN (SELECT pk FROM log))")
def stream_apply(s, d):
    """The log, written as segments by day and streamed into a versioned dataset."""
    root = _work(s)
    log = fixtures.change_log(s, d)
    log.repartitionByRange(8, "ts").write.parquet(f"{root}/log")
    src, dst = _sides(s, d)
    target = Dataset.create(s, f"{root}/dst", dst.schema, PK, span=4000)
    target.append(dst)
    stream.start(s, f"{root}/log", lambda: _src(s, d), target, f"{root}/checkpoint").awaitTermination()
    return _whole(target.read())


def _migration(s, d, source=None, log=None, **settings) -> Migration:
    config = Config(**{"min_chunk_size": 5000, "max_chunk_count": 30, "auto_swap": True, "preferred_window": ("00:00", "23:59"), "pending_max": 1_000_000, **settings})
    src, changes = _src(s, d), fixtures.change_log(s, d)
    return Migration(s, _work(s), source or (lambda: src), src.schema, PK, config, log or (lambda: changes), span=50_000)


@query(f"SELECT {WHOLE} FROM src")
def bulk_copied(s, d):
    """The chunks of the source, copied and validated; no log."""
    run = _migration(s, d, disable_handler=True)
    if run.run() != Stage.DONE:
        raise RuntimeError("the copy isn't complete")
    return _whole(run.target().read())


@query(f"SELECT {WHOLE} FROM src")
def migrated_table(s, d):
    """A whole copy from chunks to swap, then what bears the source's name."""
    run = _migration(s, d)
    run.run()
    where = run.names.all()[run.config.source]
    return _whole(Dataset.at(s, f"{run.root}/{where}").read() if where == "destination" else _src(s, d).limit(0))


@query("SELECT position, stage FROM (VALUES (0, 'CHUNKS'), (1, 'BULK_COPY'), (2, 'BULK_VALIDATION'), (3, 'APPLY'), (4, 'PRE_VALIDATION'), (5, 'LAYOUT'), (6, 'APPLY'), (7, 'PRE_VALIDATION'), (8, 'VALIDATION'), (9, 'SWAP'), (10, 'DONE')) AS v(position, stage)", fixture=False)
def stage_history(s, d):
    """The stages that a whole copy with a layout goes through."""
    run = _migration(s, d, layouts=(LayoutSpec("by_customer", ("o_custkey",)),))
    run.run()
    rows = [(i, r.stage) for i, r in enumerate(run.status("stages").collect())]
    return s.createDataFrame(rows, "position int, stage string")


@register("even_only")
class EvenOnly(Operation):
    """Applies keys that are even and loses the others."""

    def apply(self, target, src, keys):
        super().apply(target, src, keys.where(F.col(PK) % 2 == 0))


def _unmatched_sql(log: str) -> str:
    """UNMATCHED over another key log, without a name."""
    return UNMATCHED.replace("un AS", "", 1).strip().replace("FROM kl", f"FROM {log}")


@query(
    f""", half AS (SELECT op, pk, max(ts) AS ts FROM log WHERE ts < 1705300000 GROUP BY op, pk), late AS (SELECT * FROM kl WHERE ts >= (SELECT max(ts) FROM half)),
    one AS (SELECT * FROM {{half}} WHERE pk % 2 = 1), two AS (SELECT * FROM one UNION SELECT * FROM {{late}} WHERE pk % 2 = 1)
    SELECT 1 AS round, pk, unmatch_type FROM one UNION ALL SELECT 2, pk, unmatch_type FROM two"""
    .replace("{half}", _unmatched_sql("half")).replace("{late}", _unmatched_sql("late"))
)
def validation_rounds(s, d):
    """What is owed after each of two validations, the second of which begins at the first one's mark: keys that were found are applied again,
    but odd ones stay as they are, and stay owed whatever the mark is."""
    until, log = [1705300000], fixtures.change_log(s, d)
    run = _migration(s, d, log=lambda: log.where(F.col("ts") < until[0]), operation="even_only")
    run.target().append(_dst(s, d))
    state, owed = run.state, []
    for i in (1, 2):
        run.validate(state)
        owed.append(run.debt(state).select(F.lit(i).alias("round"), PK, "unmatch_type").toPandas())  # the folder goes with the next round
        until[0] = 1 << 40
    rows = [tuple(r) for part in owed for r in part.itertuples(index=False)]
    return s.createDataFrame(rows, "round int, pk bigint, unmatch_type string")


MOVED = "CASE event_type WHEN 'signup' THEN 'write' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind"


@query(
    f"""WITH e AS (SELECT event_id, {MOVED}, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)
    SELECT 'I' AS op, event_id AS pk, ts FROM e WHERE kind = 'write' UNION ALL SELECT 'D', event_id, ts FROM e WHERE kind = 'delete'
    UNION ALL SELECT 'U', event_id, ts FROM e WHERE kind = 'update' AND event_id % 5 <> 0
    UNION ALL SELECT 'D', event_id, ts FROM e WHERE kind = 'update' AND event_id % 5 = 0 UNION ALL SELECT 'I', event_id + 1, ts FROM e WHERE kind = 'update' AND event_id % 5 = 0""",
    fixture=False,
)
def decoded_events(s, d):
    """Row events as entries of the log; every fifth update moves its row to another key."""
    kind = F.when(F.col("event_type") == "signup", "write").when(F.col("event_type") == "error", "delete").otherwise("update")
    at = lambda key: F.struct(key.alias("pk"))
    rows = table(s, d, "events").select(
        kind.alias("kind"), F.when(kind != "write", at(F.col("event_id"))).alias("before"),
        F.when(kind != "delete", at(F.col("event_id") + F.when((kind == "update") & (F.col("event_id") % 5 == 0), 1).otherwise(0))).alias("after"), epoch(F.col("ts")).alias("ts"),
    )
    return changelog.decode(rows)


@query(f", {PROGRESS} SELECT chunk_id, CASE WHEN chunk_id % 4 = 2 THEN start_pk ELSE start_pk + 11 END AS resume_pk FROM p WHERE chunk_id % 4 IN (2, 3)")
def resume_points(s, d):
    """Where each chunk that isn't done goes on. Chunks are as many as a setting says at most."""
    rows = [(r.chunk_id, chunks.resume_point("not_started" if r.last_pk is None else r.status, r.start_pk, r.last_pk, None)) for r in _progress(s, d).collect()]
    return s.createDataFrame([r for r in rows if r[1] is not None], "chunk_id int, resume_pk bigint")


@query(
    """, k AS (SELECT list(pk) AS keys FROM src WHERE pk % 7 = 0 AND pk <= 2000),
    walk(step, start_pk, multiplier, n) AS (
        SELECT 0, CAST(0 AS BIGINT), CAST(1.0 AS DOUBLE), len(list_filter(keys, lambda x: x >= 0 AND x < 100)) FROM k
        UNION ALL
        SELECT step + 1, start_pk + size, m, len(list_filter(keys, lambda x: x >= start_pk + size AND x < start_pk + size + CAST(floor(100 * m) AS BIGINT)))
        FROM (SELECT *, CAST(floor(100 * multiplier) AS BIGINT) AS size, CASE WHEN n = 0 THEN multiplier + 1 WHEN n = 100 THEN greatest(1.0, multiplier * 0.9) ELSE CAST(floor(100 * multiplier) AS DOUBLE) / n END AS m FROM walk) w, k
        WHERE start_pk + size <= 2000)
    SELECT step, start_pk, CAST(floor(100 * multiplier) AS BIGINT) AS size, CAST(n AS BIGINT) AS n FROM walk"""
)
def sparse_batches(s, d):
    """A walk over sparse keys in batches of 100 rows: how many keys each takes, and the rows found."""
    keys = _src(s, d).where((F.col(PK) % 7 == 0) & (F.col(PK) <= 2000)).select(PK).persist()
    batch, start, rows = chunks.SparseBatch(100), 0, []
    while start <= 2000:
        n, size = scans.key_range(keys, PK, start, start + batch.size - 1).count(), batch.size
        rows.append((len(rows), start, size, n))
        batch.after(n)
        start += size
    keys.unpersist()
    return s.createDataFrame(rows, "step int, start_pk bigint, size bigint, n bigint")


@query(
    """, t AS (SELECT list(ts) AS every, min(ts) AS lo, max(ts) AS hi FROM kl),
    cut(a, b) AS (SELECT lo, hi FROM t UNION ALL
        SELECT unnest([a, a + (b - a) // 2 + 1]), unnest([a + (b - a) // 2, b]) FROM cut, t WHERE b > a AND len(list_filter(every, lambda x: x >= a AND x <= b)) > 200)
    SELECT a AS start_ts, b AS end_ts FROM cut, t WHERE NOT (b > a AND len(list_filter(every, lambda x: x >= a AND x <= b)) > 200)"""
)
def bisected_ranges(s, d):
    """Ranges of time with 200 entries of the log at most, by halves."""
    log = fixtures.key_log(s, d)
    low, high = keylog.bounds(log).first()
    return s.createDataFrame(list(chunks.bisected(low, high, keylog.counter(log), 200)), "start_ts bigint, end_ts bigint")


@query(f""", u AS ({KEYS} IN ('I', 'U') EXCEPT {KEYS} = 'D'), r AS ({KEYS} = 'D'), n AS (SELECT (SELECT count(*) FROM u) AS nu, (SELECT count(*) FROM r) AS nr)
    SELECT kind, pk FROM (SELECT 'updated' AS kind, pk FROM u, n WHERE nu > nr UNION ALL SELECT 'removed', pk FROM r, n WHERE nr >= nu) ORDER BY pk LIMIT 500""")
def drain_batch(s, d):
    """The next batch that is applied: of the larger of the pending sets."""
    log = fixtures.key_log(s, d)
    return keylog.next_batch(keylog.updated_keys(log), keylog.removed_keys(log), 500)


@query("SELECT name, target FROM (VALUES ('_orders_old_20240102', 'v1'), ('orders', 'v2'), ('old', '_orders_old_20240102')) AS v(name, target)", fixture=False)
def swap_outcome(s, d):
    names = Names(s, _work(s))
    names.set(orders="v1", orders_new="v2")
    old = names.swap("orders", "orders_new", datetime(2024, 1, 2, tzinfo=UTC).strftime("%Y%m%d"))
    return s.createDataFrame(sorted(names.all().items()) + [("old", old)], "name string, target string")


TRACE_CONFIG = Config(min_batch_size=100, batch_size_step=100, max_batch_size=10000, min_threads=4, threads_step=4, max_threads=8, optimal_use_limit=10)


#: The first six steps are those of the survey's golden trace; then the best setting is held for ten turns.
TRACE = [(0, 100, 200, 4, 1), (1, 200, 300, 4, 2), (2, 200, 200, 8, 3), (3, 300, 300, 8, 4), (4, 200, 200, 8, 5)] + [(i, 200, 200, 8, 5) for i in range(5, 15)] + [(15, 200, 300, 8, 6)]
SHED = [(0, 30, 5, 3000, 8), (1, 45, 5, 3000, 4), (2, 70, 5, 3000, 0), (3, 30, 5, 3000, 1), (4, 30, 40, 1500, 1), (5, 30, 60, 1000, 0), (6, 30, 5, 1000, 1)]
_values = lambda rows: ", ".join(map(str, rows))


@query(f"SELECT step, CAST(rate AS DOUBLE) AS rate, batch_size, threads, revision FROM (VALUES {_values(TRACE)}) AS v(step, rate, batch_size, threads, revision)", fixture=False)
def tuner_trace(s, d):
    tuner = Tuner(TRACE_CONFIG, Setting(100, 4))
    rows = []
    for i, rate in enumerate([100, 200, 200, 300, 200, 200, *[200] * 10]):
        now = tuner.update(30, 5, rate)
        rows.append((i, float(rate), now.batch, now.threads, tuner.revision))
    return s.createDataFrame(rows, "step int, rate double, batch_size int, threads int, revision int")


@query(f"SELECT step, CAST(cpu AS DOUBLE) AS cpu, CAST(latency AS DOUBLE) AS latency, batch_size, threads FROM (VALUES {_values(SHED)}) AS v(step, cpu, latency, batch_size, threads)", fixture=False)
def shed_trace(s, d):
    tuner = Tuner(Config(), Setting(3000, 8))
    rows = []
    for i, (cpu, latency) in enumerate([(30, 5), (45, 5), (70, 5), (30, 5), (30, 40), (30, 60), (30, 5)]):
        now = tuner.update(cpu, latency, 0.0)
        rows.append((i, float(cpu), float(latency), now.batch, now.threads))
    return s.createDataFrame(rows, "step int, cpu double, latency double, batch_size int, threads int")
