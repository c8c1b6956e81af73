"""A whole copy: chunks, bulk copy, validation, application of the change log, layouts, swap.

One driver loop goes from stage to stage; its state is in files (manifest of the destination, chunks, marks, debt, stage), so a new driver goes on
where the last one ended. What could not be validated is a debt: a stored table of keys that is checked again in each validation
and must be empty before names are swapped, whatever mark the validation has reached."""

from __future__ import annotations

import inspect
import json
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytide.functions.tuning import Setting, Tuner, in_window
from keytide.model import ChunkStatus, Config, Stage
from keytide.operators import chunks, keylog
from keytide.plans import layout, monitor
from keytide.plans.dataset import Dataset, Names
from keytide.plans.operation import Operation, operation
from keytide.plans.store import Store
from keytide.sources import changelog
from keytide.sources.tables import check_key

DEBT = "pk bigint, unmatch_type string"


class Migration:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        source: Callable[..., DataFrame],
        target_schema: T.StructType,
        pk: str,
        config: Config | None = None,
        log: Callable[[], DataFrame] | None = None,
        span: int = 1_000_000,
        clock: Callable[[], datetime] = lambda: datetime.now(UTC),
        host: monitor.HostMetrics | None = None,
        segments: Callable[[], tuple[DataFrame, str, int]] | None = None,
    ) -> None:
        """source gives the source's present rows; if it takes an argument, that is the name that the source has at the time. log gives the
        change log(op, pk, ts) as far as it goes. host tells how busy the writer is. segments gives the log's segments(name, size), the present one
        and the position in it, for the gauge of bytes that are left."""
        self.spark, self.root, self.pk, self.config, self._log, self.clock = spark, root.rstrip("/"), pk, config or Config(), log, clock
        self._source, self._segments, self.store, self.host = source, segments, Store(spark, root), host or monitor.TaskMetrics(spark)
        self._named = bool(inspect.signature(source).parameters)
        self.names = Names(spark, root)
        self.operation: Operation = operation(self.config.operation, self.config.operation_settings)
        if not self.store.exists("state.json"):
            check_key(self.source(self.config.source), pk)
            Dataset.create(spark, f"{self.root}/destination", target_schema, pk, span)
            self.names.set(**{self.config.source: "source", self.config.destination: "destination"})
            first = Stage.CHUNKS if self.config.disable_handler else Stage.START_HANDLER
            start = Setting(self.config.min_batch_size, self.config.min_threads)
            self._save(
                {
                    "stage": int(first), "chunks": [], "layouts": {}, "old": None, "created_at": self._now(), "ended_at": None, "final_max_id": None,
                    "loaded": None, "width": self.config.window_seconds, "caught_up_at": None, "validated": None, "debt": None, "n_debt": 0, "full_validated_at": None,
                    "batch": start.batch, "threads": start.threads, "rate": None,
                }
            )

    # state and status

    def _now(self) -> float:
        return self.clock().timestamp()

    def _save(self, state: dict) -> None:
        self.store.replace("state.json", json.dumps(state))

    @property
    def state(self) -> dict:
        return json.loads(self.store.read("state.json"))

    @property
    def stage(self) -> Stage:
        return Stage(self.state["stage"])

    def _note(self, kind: str, **values) -> None:
        """Appends a row to a status log."""
        self.store.add(f"status/{kind}", json.dumps({"at": self._now(), **values}))

    def status(self, kind: str) -> DataFrame:
        """Rows of a status log, oldest first: stages, copied, loaded, validated, full_validated or swaps."""
        rows = [json.loads(x) for x in self.store.all(f"status/{kind}")]
        return self.spark.createDataFrame([{k: v for k, v in r.items() if v is not None} for r in rows]) if rows else self.spark.createDataFrame([], "at double")

    def plan(self) -> DataFrame:
        """One row: what the copy is, and when it began and ended."""
        s, c = self.state, self.config
        row = (c.source, c.destination, self.pk, c.operation, s["created_at"], s["ended_at"], s["final_max_id"])
        out = self.spark.createDataFrame([row], "source string, destination string, pk string, operation string, created_at double, ended_at double, final_max_id bigint")
        return out.withColumns({k: F.timestamp_seconds(k) for k in ("created_at", "ended_at")})

    def chunk_table(self, state: dict | None = None) -> DataFrame:
        rows = [(c["chunk_id"], c["start_pk"], c["end_pk"], c["status"], c["last_pk"]) for c in (state or self.state)["chunks"]]
        return self.spark.createDataFrame(rows, chunks.SCHEMA)

    def layout_table(self) -> DataFrame:
        """(name, columns, unique, started_at, ended_at) of every layout that the settings ask for."""
        done = self.state["layouts"]
        rows = [(x.name, ",".join(x.columns), x.unique, *(done.get(x.name) or (None, None))) for x in self.config.layouts]
        return self.spark.createDataFrame(rows, "name string, columns string, unique boolean, started_at double, ended_at double")

    def gauges(self) -> DataFrame:
        """(name, value) of what is known of the copy's progress; without a handler of the log, of the bulk copy alone. Times count from the first entry of the log."""
        s = self.state
        values: dict = {"batch_size": s["batch"], "threads": s["threads"], "insert_rate": s["rate"]}
        if s["chunks"]:
            values["bulk_progress"] = chunks.progress(self.chunk_table(s), max(c["end_pk"] for c in s["chunks"]) or 1)
        if self.config.disable_handler:
            return monitor.metrics(self.spark, **values)
        values |= {"unmatched_rows": s["n_debt"], "open_layouts": len(self._layouts_left(s))}
        if self._segments:
            caught_up = s["caught_up_at"] is not None and self._now() - s["caught_up_at"] <= 2
            values["remaining_log_bytes"] = 0 if caught_up else changelog.segment_inventory(*self._segments())
        if self._log:
            log = self.key_log()
            low, high = keylog.bounds(log).first()
            if low is not None:
                values["last_event_timestamp"] = high - low
                if s["loaded"] is not None:
                    values["last_loaded_timestamp"] = s["loaded"] - low
                    log = log.where(F.col("ts") > s["loaded"])
                if s["caught_up_at"] is not None:
                    values["last_caught_up_timestamp"] = s["caught_up_at"] - low
            values["updated_keys"] = keylog.updated_keys(log).agg(F.count("*"))
            values["removed_keys"] = keylog.removed_keys(log).agg(F.count("*"))
        return monitor.metrics(self.spark, **values)

    # sides

    def source(self, name: str | None = None) -> DataFrame:
        """The source under the name that it has: after the swap of names its old one."""
        name = name or self.state["old"] or self.config.source
        return self.operation.source(self._source(name) if self._named else self._source())

    def target(self) -> Dataset:
        return Dataset.at(self.spark, f"{self.root}/destination")

    def _entries(self, since: int | None) -> DataFrame:
        """The change log from a second on, or all of it: the bound reaches the scan."""
        return self._log() if since is None else self._log().where(F.col("ts") >= since)

    def key_log(self, since: int | None = None) -> DataFrame:
        """The compacted log, or its part from a second on."""
        return keylog.compact(self._entries(since)) if self._log else self.spark.createDataFrame([], "op string, pk bigint, ts bigint")

    def last_event(self, since: int | None = None) -> int | None:
        return self._entries(since).agg(F.max("ts")).first()[0] if self._log else None

    # stages

    def step(self) -> Stage:
        """Does the present stage's work and returns the next stage."""
        state = self.state
        work = {
            Stage.START_HANDLER: self._start, Stage.CHUNKS: self._chunks, Stage.BULK_COPY: self._copy, Stage.BULK_VALIDATION: self._validate_copy, Stage.APPLY: self._apply,
            Stage.PRE_VALIDATION: self._pre_validate, Stage.LAYOUT: self._layout, Stage.VALIDATION: self._validate, Stage.SWAP: self._swap,
        }
        stage = Stage(state["stage"])
        if stage in work:
            state["stage"] = int(work[stage](state))
            self._save(state)
            if state["stage"] != stage:
                self._note("stages", stage=Stage(state["stage"]).name)
        return Stage(state["stage"])

    def run(self, most: int = 50) -> Stage:
        """Goes on until the copy is done, has failed, or waits: for the log, for debt to be paid, or for leave to swap."""
        for _ in range(most):
            before = self.stage
            if (now := self.step()) == before or now in (Stage.DONE, Stage.SWAP_FAILED, Stage.BULK_VALIDATION_FAILED):
                break
        return self.stage

    def _start(self, state: dict) -> Stage:
        return Stage.APPLY if self.config.skip_bulk_copy else Stage.CHUNKS

    def _chunks(self, state: dict) -> Stage:
        low, high = self.source().agg(F.min(self.pk), F.max(self.pk)).first()
        planned = chunks.plan(self.spark, low, high, self.config.min_chunk_size, self.config.max_chunk_count).collect()  # max_chunk_count at most
        state["chunks"] = [{**r.asDict(), "status": ChunkStatus.NOT_STARTED.value, "last_pk": None} for r in planned]
        return Stage.BULK_COPY

    def _copy(self, state: dict) -> Stage:
        """Rounds of as many chunks as the tuner has threads, each copied as one job and committed as one version. Tasks take so many keys that
        they have about the tuner's batch of rows."""
        target, c = self.target(), self.config
        tuner = Tuner(c, Setting(state["batch"], state["threads"]))
        sparse = chunks.SparseBatch(tuner.now.batch * c.batch_unit)
        slots = self.spark.sparkContext.defaultParallelism
        while todo := [x for x in state["chunks"] if x["status"] != ChunkStatus.DONE]:
            if tuner.now.threads == 0:  # shed: nothing is written until the writer is calm again
                time.sleep(1)
                tuner.update(self.host.cpu(), self.host.latency(), 0.0)
                continue
            # a thread is one slot's worth of chunks: small chunks go together until each slot has a batch to write
            each = max(1, slots * sparse.size // max(1, todo[0]["end_pk"] - todo[0]["start_pk"] + 1))
            now = todo[: tuner.now.threads * each]
            ranges = [(chunks.resume_point(x["status"], x["start_pk"], x["last_pk"], None), x["end_pk"]) for x in now]
            began = time.monotonic()
            for x in now:
                x["status"] = ChunkStatus.IN_PROGRESS.value
            self._save(state)
            self.operation.insert(target, self.source(), ranges, sparse.size)
            took = time.monotonic() - began
            keys = sum(b - a + 1 for a, b in ranges)
            rows = target.read().where(F.col(self.pk).between(ranges[0][0], ranges[-1][1])).count()
            for x in now:
                x |= {"status": ChunkStatus.DONE.value, "last_pk": x["end_pk"]}
            state["rate"] = rows / max(took, 1e-3)
            setting = tuner.update(self.host.cpu(), self.host.latency(), state["rate"] / tuner.now.threads)
            sparse = chunks.SparseBatch(setting.batch * c.batch_unit, sparse.multiplier)
            sparse.after(round(rows / max(1.0, keys / sparse.size)))
            state["batch"], state["threads"] = setting.batch, max(1, setting.threads)
            self._save(state)
            self._note("copied", chunks=len(now), rows=rows, seconds=took)
        return Stage.BULK_VALIDATION

    def _validate_copy(self, state: dict) -> Stage:
        if state["chunks"] and (open_ := {r.chunk_id for r in chunks.incomplete(self.chunk_table(state)).collect()}):
            for c in state["chunks"]:
                if c["chunk_id"] in open_:
                    c["status"] = ChunkStatus.NOT_STARTED.value
            return Stage.BULK_COPY
        ends = [c["end_pk"] for c in state["chunks"]]
        low, high = min((c["start_pk"] for c in state["chunks"]), default=0), max(ends, default=-1)
        if not self.operation.not_imported(self.source(), self.target().read(), self.pk, low, high).isEmpty():
            return Stage.BULK_VALIDATION_FAILED
        return Stage.DONE if self.config.disable_handler else Stage.APPLY

    def catch_up(self, state: dict) -> bool:
        """Applies what the log has behind the mark, in batches of the loader's windows with pending_max entries of a kind at most (a window
        that holds more by itself is a batch); the mark is kept after each. True if nothing is left, as far as the log went."""
        if self.config.disable_apply:
            return False
        if self._log is None:
            state["caught_up_at"] = self._now()
            return True
        last = self.last_event(state["loaded"])
        if last is not None and state["loaded"] != last:
            log = self.key_log(state["loaded"])
            windows = keylog.windows(log, self.config.pending_max, state["width"], state["loaded"])
            if windows:
                state["width"] = windows[-1][1] - windows[-1][0]
                for start, end in keylog.batches(log, windows, self.config.pending_max):
                    changed = keylog.window(log, start, end)
                    self.operation.apply(self.target(), self.source(), changed.select(F.col("pk").alias(self.pk)))
                    state["loaded"] = changed.agg(F.max("ts")).first()[0]
                    self._save(state)
                    self._note("loaded", start=start, end=end, mark=state["loaded"])
        if last is None or (state["loaded"] or 0) >= last:
            state["caught_up_at"] = self._now()
            return True
        return False

    def lag(self, state: dict) -> int:
        """Seconds of log behind the mark."""
        last = self.last_event(state["loaded"])
        return 0 if last is None or state["loaded"] == last else last - (state["loaded"] or 0)

    def _apply(self, state: dict) -> Stage:
        near = self.catch_up(state) or (not self.config.disable_apply and self.lag(state) < self.config.lag_seconds)
        return Stage.PRE_VALIDATION if near else Stage.APPLY

    def _pre_validate(self, state: dict) -> Stage:
        if not self.catch_up(state):
            return Stage.PRE_VALIDATION
        return Stage.LAYOUT if self._layouts_left(state) else Stage.VALIDATION

    def _layouts_left(self, state: dict) -> list:
        return [x for x in self.config.layouts if not (state["layouts"].get(x.name) or (None, None))[1]]

    def _layout(self, state: dict) -> Stage:
        """Checks and builds the layouts that are left, so many at once. The destination is written in the order of the first layout, with Bloom
        filters for the columns of all, and keeps both in later versions."""
        target, left = self.target(), self._layouts_left(state)
        for i in range(0, len(left), self.config.layouts_at_once):
            group = left[i : i + self.config.layouts_at_once]
            for x in group:
                state["layouts"][x.name] = (self._now(), None)
                layout.check_unique(target.read(), x)
            self._save(state)
            target.lay_out(list(self.config.layouts[0].columns), [c for x in group for c in x.columns])
            for x in group:
                state["layouts"][x.name] = (state["layouts"][x.name][0], self._now())
            self._save(state)
        return Stage.APPLY

    # validation

    def unmatched(self, since: int | None = None) -> DataFrame:
        """What the key log from `since` on, or all of it, has left unmatched."""
        log = self.key_log(since)
        return self.operation.unmatched(self.source(), self.target().read(), log.withColumnRenamed("pk", self.pk), self.pk)

    def debt(self, state: dict | None = None) -> DataFrame:
        """(pk, unmatch_type) that earlier validations found and that didn't match since."""
        state = state or self.state
        rows = self.spark.read.schema(DEBT).parquet(f"{self.root}/{state['debt']}") if state["debt"] else self.spark.createDataFrame([], DEBT)
        return rows.withColumnRenamed("pk", self.pk)

    def validate(self, state: dict, full: bool = False, last: int | None = None) -> bool:
        """Checks the log from the last mark on, or all of it, and what is owed from before; keys that don't match are applied again and checked
        once more. Those that still don't are the new debt. Valid if there is none. last is the end of the log, if it is known."""
        last = self.last_event() if last is None else last
        found = self.unmatched(None if full else state["validated"]).union(self.debt(state).select(self.pk, "unmatch_type")).distinct()
        name, owed = f"debt/{uuid.uuid4().hex}", 0
        put = lambda rows, at: rows.select(F.col(self.pk).cast("long").alias("pk"), "unmatch_type").write.parquet(f"{self.root}/{at}")
        put(found, f"{name}-found")
        found = self.debt({"debt": f"{name}-found"})
        if not found.isEmpty():
            left = lambda: self.operation.recheck(self.source(), self.target().read(), found, self.pk)
            self.operation.apply(self.target(), self.source(), left().select(self.pk))
            put(left(), name)
            owed = self.debt({"debt": name}).count()
        old, state["debt"], state["n_debt"] = state["debt"], name if owed else None, owed
        state["validated"] = last if last is not None else state["validated"]
        self._save(state)
        for gone in {f"{name}-found", old, None if owed else name} - {None}:
            self.store.delete(gone)
        self._note("full_validated" if full else "validated", mark=state["validated"], unmatched=owed, valid=not owed)
        return not owed

    def _full_due(self, state: dict) -> bool:
        hours = self.config.full_validation_hours
        return hours > 0 and (state["full_validated_at"] is None or self._now() - state["full_validated_at"] >= hours * 3600)

    def _validate(self, state: dict) -> Stage:
        """To the swap only if nothing is pending or owed, and no full validation was due: after one, another round must be valid."""
        if not self.catch_up(state):
            return Stage.VALIDATION
        if self._full_due(state):
            self.validate(state, full=True, last=state["loaded"])
            state["full_validated_at"] = self._now()
            return Stage.VALIDATION
        valid = self.validate(state, last=state["loaded"])
        now = self.clock().strftime("%H:%M")
        return Stage.SWAP if valid and self.config.auto_swap and in_window(now, *self.config.preferred_window) else Stage.VALIDATION

    def _swap(self, state: dict) -> Stage:
        """Swaps the names, applies and checks what has come in meanwhile, and restores the names if it doesn't match in a number of tries."""
        if state["n_debt"] or not self.catch_up(state):
            return Stage.VALIDATION
        names = self.config.source, self.config.destination
        if state["old"] is None and names[1] not in self.names.all():  # a driver has ended right after the swap
            state["old"] = max((n for n in self.names.all() if n.startswith(f"_{names[0]}_old_")), default=None)
        if state["old"] is None:
            try:
                state["old"] = self.names.swap(*names, self.clock().strftime("%Y%m%d"))
            except KeyError:
                return Stage.SWAP_FAILED
        renamed_at = self._now()
        self._save(state)
        final = self.operation.max_pk(self.source(), self.pk).first()[0]
        for turn in range(self.config.swap_tries):
            began = time.monotonic()
            valid = self.catch_up(state) and self.validate(state, last=state["loaded"])
            took = time.monotonic() - began
            self._note("swaps", turn=turn, valid=valid, seconds=took)
            if valid and took <= self.config.swap_seconds:
                state |= {"ended_at": renamed_at, "final_max_id": final}
                self.target().compact()
                return Stage.DONE
            time.sleep(0.3)
        self.names.restore(*names, state["old"])
        state["old"] = None
        return Stage.SWAP_FAILED
