"""Keyed Parquet datasets with versions.

Rows lie in buckets of `span` keys; a manifest names the folders of each bucket. Copies add folders to buckets. Changes add a layer: the
changed keys, and the rows that these have now. What it costs to write one follows the number of changes, not the size of the
dataset: readers take for each key the rows of the newest layer that changed it. After LAYERS layers or LAYER_KEYS keys, the buckets that they
touch are written anew and the layers go. Every change ends by replacing the manifest as a whole, so readers see one version, and a change that
breaks off leaves the old one. Versions that were applied from a stream keep its batch number, so a repeated batch is passed over."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytide.operators import mutate
from keytide.operators.scans import key_ranges, key_set
from keytide.plans.store import Store

BUCKET, LAYER = "_bucket", "_layer"
#: Layers, and keys in them, beyond which the buckets that they touch are written anew; so many keys are broadcast to readers (16 bytes each).
LAYERS, LAYER_KEYS = 8, 2_000_000


class Dataset:
    def __init__(self, spark: SparkSession, root: str, pk: str, span: int = 1_000_000) -> None:
        self.spark, self.pk, self.span, self.store = spark, pk, span, Store(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, pk: str, span: int = 1_000_000) -> Dataset:
        """An empty dataset."""
        out = cls(spark, root, pk, span)
        out._put({"version": 0, "span": span, "pk": pk, "schema": schema.json(), "buckets": {}, "layers": [], "order": [pk], "lookup": [], "batch": -1})
        return out

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> Dataset:
        """The dataset in a folder."""
        manifest = json.loads(Store(spark, root).read("manifest.json"))
        return cls(spark, root, manifest["pk"], manifest["span"])

    @property
    def manifest(self) -> dict:
        return json.loads(self.store.read("manifest.json"))

    def _put(self, manifest: dict) -> None:
        self.store.replace("manifest.json", json.dumps(manifest))

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest["schema"]))

    def _parquet(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        paths = [f"{self.store.root}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _keys_of(self, manifest: dict) -> DataFrame | None:
        """(key, _layer): the newest layer that changed each key; None without layers."""
        schema = T.StructType([T.StructField(self.pk, T.StructType.fromJson(json.loads(manifest["schema"]))[self.pk].dataType)])
        parts = [self._parquet(schema, [x["keys"]]).withColumn(LAYER, F.lit(x["version"])) for x in manifest["layers"]]
        return reduce(DataFrame.union, parts).groupBy(self.pk).agg(F.max(LAYER).alias(LAYER)) if parts else None

    def _rows(self, manifest: dict, buckets: set[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of all buckets or of some, by the newest layers."""
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        schema = schema if columns is None else T.StructType([f for f in schema if f.name in columns])
        rows = self._parquet(schema, [f for b, folders in manifest["buckets"].items() if buckets is None or b in buckets for f in folders])
        if (changed := self._keys_of(manifest)) is None:
            return rows
        inside = F.lit(True) if buckets is None else self._bucket().isin([int(b) for b in buckets])
        rows = rows.withColumn("_v", F.lit(0))
        for x in manifest["layers"]:
            if x["rows"]:
                rows = rows.union(self._parquet(schema, [x["rows"]]).where(inside).withColumn("_v", F.lit(x["version"])))
        newest = changed.select(F.col(self.pk).alias("_pk"), LAYER)
        if sum(x["n"] for x in manifest["layers"]) <= LAYER_KEYS:  # so the rows stay where they are
            newest = F.broadcast(newest)
        return rows.join(newest, F.col(self.pk) == F.col("_pk"), "left").where(F.coalesce(LAYER, F.lit(0)) <= F.col("_v")).select(*schema.names)

    def read(self) -> DataFrame:
        return self._rows(self.manifest)

    def _bucket(self):
        return F.floor(F.col(self.pk) / F.lit(self.span)).cast("long")

    def _write(self, rows: DataFrame, manifest: dict, folder: str, width: int) -> dict[str, str]:
        """Writes rows by bucket, in tasks of `width` keys at most; the folder of each bucket."""
        self.store.delete(folder)  # what a broken attempt has left
        rows = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET, F.floor(F.col(self.pk) / F.lit(max(1, width))))
        rows = rows.sortWithinPartitions(BUCKET, *manifest["order"])
        writer = rows.write.partitionBy(BUCKET)
        for column in manifest["lookup"]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.store.root}/{folder}")
        names = [n for n in self.store.folders(folder) if n.startswith(f"{BUCKET}=")]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names}

    def append(self, src: DataFrame, low: int | None = None, high: int | None = None, ranges: Iterable[tuple[int, int]] | None = None, width: int | None = None) -> int:
        """Source rows, of ranges of keys if given, that aren't there yet, as further folders of their buckets. All ranges are copied at once and come
        in with one version; rows that are there are only looked up in buckets that reach into the ranges."""
        ranges = list(ranges) if ranges is not None else [] if low is None else [(low, high)]
        rows = key_ranges(src, self.pk, ranges) if ranges else src
        manifest = self.manifest
        spans = [(a // self.span, b // self.span) for a, b in ranges]
        old = {b for b in manifest["buckets"] if not spans or any(x <= int(b) <= y for x, y in spans)}
        rows = mutate.copy_missing(rows, self._rows(manifest, old, [self.pk]), self.pk, target=self.schema) if old or manifest["layers"] else mutate.fitted(rows, self.schema)
        version = manifest["version"] + 1
        added = self._write(rows, manifest, f"v{version}", width or self.span)
        buckets = manifest["buckets"] | {b: [*manifest["buckets"].get(b, []), f] for b, f in added.items()}
        self._put(manifest | {"version": version, "buckets": buckets})
        return version

    def apply(self, src: DataFrame, changed: DataFrame, batch: int | None = None) -> int | None:
        """Brings the changed keys' rows to the source's present state, as a layer. A batch that was applied before does nothing."""
        manifest = self.manifest
        if batch is not None and batch <= manifest["batch"]:
            return None
        version = manifest["version"] + 1
        folder = f"v{version}"
        self.store.delete(folder)
        changed.select(self.pk).distinct().write.parquet(f"{self.store.root}/{folder}/keys")
        schema = self.schema
        keys = self._parquet(T.StructType([schema[self.pk]]), [f"{folder}/keys"])
        if not (n := keys.count()):
            self.store.delete(folder)
            if batch is not None:
                self._put(manifest | {"batch": batch})
            return manifest["version"]
        mutate.fitted(key_set(src, keys, self.pk), schema).write.parquet(f"{self.store.root}/{folder}/rows")
        layers = [*manifest["layers"], {"version": version, "keys": f"{folder}/keys", "rows": f"{folder}/rows", "n": n}]
        self._put(manifest | {"version": version, "layers": layers} | ({} if batch is None else {"batch": batch}))
        return self.compact() if len(layers) >= LAYERS or sum(x["n"] for x in layers) > LAYER_KEYS else version

    def compact(self) -> int:
        """Writes the buckets that layers touch anew and lets the layers go."""
        manifest = self.manifest
        if (changed := self._keys_of(manifest)) is None:
            return manifest["version"]
        touched = {str(r[0]) for r in changed.select(self._bucket().alias("b")).distinct().collect()}  # as many as the dataset has buckets
        return self._rewrite(manifest, touched)

    def lay_out(self, order: list[str], lookup: list[str]) -> int:
        """Orders the rows of each bucket by the columns, now and in later versions, and gives the files Bloom filters of the lookup columns."""
        manifest = self.manifest
        manifest |= {"order": [*dict.fromkeys([*order, self.pk])], "lookup": [*dict.fromkeys([*manifest["lookup"], *lookup])]}
        changed = self._keys_of(manifest)
        more = set() if changed is None else {str(r[0]) for r in changed.select(self._bucket().alias("b")).distinct().collect()}
        return self._rewrite(manifest, set(manifest["buckets"]) | more)

    def _rewrite(self, manifest: dict, touched: set[str]) -> int:
        version = manifest["version"] + 1
        written = self._write(self._rows(manifest, touched), manifest, f"v{version}", self.span)
        buckets = {b: f for b, f in manifest["buckets"].items() if b not in touched} | {b: [f] for b, f in written.items()}
        self._put(manifest | {"version": version, "buckets": buckets, "layers": []})
        return version

    def vacuum(self) -> None:
        """Deletes folders that the present version doesn't use."""
        manifest = self.manifest
        used = {f.partition("/")[0] for folders in manifest["buckets"].values() for f in folders} | {f"v{x['version']}" for x in manifest["layers"]}
        for name in self.store.folders(""):
            if re.fullmatch(r"v\d+", name) and name not in used:
                self.store.delete(name)


class Names:
    """Names of datasets, held in one file: a swap renames both sides at once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root)

    def all(self) -> dict[str, str]:
        return json.loads(self.store.read("names.json")) if self.store.exists("names.json") else {}

    def set(self, **names: str) -> None:
        self.store.replace("names.json", json.dumps(self.all() | names))

    def swap(self, source: str, destination: str, day: str) -> str:
        """source becomes _source_old_day, destination becomes source. The old name is returned."""
        names = self.all()
        if source not in names or destination not in names:
            raise KeyError(f"{source} and {destination} must both be there")
        old = f"_{source}_old_{day}"
        if old in names:
            raise KeyError(f"{old} is there already")
        names[old], names[source] = names[source], names.pop(destination)
        self.store.replace("names.json", json.dumps(names))
        return old

    def restore(self, source: str, destination: str, old: str) -> None:
        names = self.all()
        names[destination], names[source] = names[source], names.pop(old)
        self.store.replace("names.json", json.dumps(names))
