"""A store of rows by document that is published: snapshots, a log of pointers to them, reindexing and rollback."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .tables import broadcast_if_small, written

BUCKETS = 16


class Store:
    """Rows in folders by snapshot, the isolation keys (tenant and strategy, say) and a bucket of the document's id.

    A version is a file of the log, which names a table of pointers: which snapshot each folder of keys and bucket is read
    from. What a write brings goes into a snapshot of its own, and the version is committed by creating its file: a
    write that fails, or loses against another, leaves the versions before it as they are. Old snapshots stay until
    `vacuum`, so that a rollback is one more version with older pointers.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("tenant", "strategy"), doc: str = "doc_id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.doc, self.buckets = spark, path.rstrip("/"), keys, doc, buckets
        self.at = [*keys, "bucket"]

    def versions(self) -> list[int]:
        return [int(n) for n in files.names(self.spark, f"{self.path}/log")]

    def _entry(self, version: int) -> dict:
        return json.loads(files.text(self.spark, f"{self.path}/log/{version:010d}"))

    def history(self) -> DataFrame:
        """(version, action, parent): every commit; a rollback's parent is the version that it went back to."""
        rows = [(v, e["action"], e["parent"]) for v in self.versions() for e in [self._entry(v)]]
        return self.spark.createDataFrame(rows, "version int, action string, parent int")

    def _pointers(self, version: int) -> DataFrame:
        entry = self._entry(version)
        return self.spark.read.schema(T.StructType.fromJson(entry["pointer_schema"])).parquet(f"{self.path}/pointers/{entry['pointers']}")

    def _commit(self, action: str, parent: int | None, entry: dict) -> int:
        version = max([0, *self.versions()]) + 1
        if parent is not None and action != "rollback" and parent != version - 1:
            raise RuntimeError(f"version {version - 1} was committed meanwhile")
        if not files.create(self.spark, f"{self.path}/log/{version:010d}", json.dumps(entry | {"action": action, "parent": parent})):
            raise RuntimeError(f"version {version} was committed meanwhile")
        return version

    def _same(self, a: DataFrame, b: DataFrame, names: list[str]) -> Column:
        return reduce(Column.__and__, [a[n].eqNullSafe(b[n]) for n in names])

    def _snapshot(self, rows: DataFrame, check: Callable[[DataFrame], None] | None) -> tuple[str, DataFrame, T.StructType]:
        """Writes rows with their buckets; (snapshot, its pointers, the schema of the rows). A check that raises stops it there."""
        name = uuid.uuid4().hex
        kinds = T.StructType([f for f in rows.schema.fields if f.name not in self.at] + [rows.schema[k] for k in self.keys] + [T.StructField("bucket", T.IntegerType())])
        bucket = F.pmod(F.xxhash64(self.doc), F.lit(self.buckets)).cast("int")
        deal = F.pmod(F.xxhash64(self.doc, F.lit("deal")), F.lit(8))  # a tenant of most rows fills several tasks a bucket
        data = rows.withColumn("bucket", bucket).repartition(*self.at, deal)
        data.write.option("compression", "zstd").partitionBy(*self.at).parquet(f"{self.path}/data/snapshot={name}")
        back = self.spark.read.schema(kinds).parquet(f"{self.path}/data/snapshot={name}")
        if check is not None:
            check(back.drop("bucket"))
        return name, back.select(*self.at).distinct().withColumn("snapshot", F.lit(name)), rows.select(*[c for c in rows.columns if c != "bucket"]).schema

    def _point(self, pointers: DataFrame, schema: T.StructType) -> dict:
        name = uuid.uuid4().hex
        pointers.write.parquet(f"{self.path}/pointers/{name}")
        return {"pointers": name, "pointer_schema": pointers.schema.jsonValue(), "schema": schema.jsonValue()}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given. Filters on keys reach the folders; so do the pointers, as a join on them."""
        version = max(self.versions()) if version is None else version
        return self._rows(version).drop("bucket", "snapshot")

    def _rows(self, version: int) -> DataFrame:
        entry, pointers = self._entry(version), self._pointers(version)
        schema = T.StructType.fromJson(entry["schema"])
        own = [f for f in schema.fields if f.name not in self.keys]
        kinds = T.StructType([T.StructField("snapshot", T.StringType()), *[schema[k] for k in self.keys], T.StructField("bucket", T.IntegerType())])
        snapshots = [r.snapshot for r in pointers.select("snapshot").distinct().collect()]  # one for each write since the last whole publish
        if not snapshots:
            return self.spark.createDataFrame([], T.StructType([*own, *kinds.fields]))
        data = self.spark.read.schema(T.StructType([*own, *kinds.fields])).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/snapshot={s}" for s in snapshots])
        p = broadcast_if_small(pointers)
        return data.join(p, self._same(data, p, ["snapshot", *self.at]), "left_semi").select(*schema.names, "bucket", "snapshot")

    def publish(self, rows: DataFrame, check: Callable[[DataFrame], None] | None = None) -> int:
        """Commits rows in place of all that the keys in them had; other keys stay. check gets what was written and raises to refuse it."""
        was = max([0, *self.versions()])
        _, new, schema = self._snapshot(rows, check)
        pointers = new
        if was:
            old, own = self._pointers(was), written(new.select(*self.keys).distinct(), "keys")
            pointers = old.join(broadcast_if_small(own), self._same(old, own, list(self.keys)), "left_anti").unionByName(new)
        return self._commit("publish", was, self._point(pointers, schema))

    def reindex(self, rows: DataFrame, removed: DataFrame | None = None, check: Callable[[DataFrame], None] | None = None) -> int:
        """Commits rows in place of what their documents had under their keys; documents of removed(keys, doc) go.

        Only the folders of those documents are read and written again; the pointers of all others stay.
        """
        was = max(self.versions())
        ids = [*self.keys, self.doc]
        gone = rows.select(*ids) if removed is None else rows.select(*ids).unionByName(removed.select(*ids))
        gone = written(gone.distinct().withColumn("bucket", F.pmod(F.xxhash64(self.doc), F.lit(self.buckets)).cast("int")), "gone")
        touched = written(gone.select(*self.at).distinct(), "touched")
        old, t = self._rows(was), broadcast_if_small(touched)
        old = old.join(t, self._same(old, t, self.at), "left_semi")
        g = broadcast_if_small(gone)
        stay = old.join(g, self._same(old, g, ids), "left_anti").drop("bucket", "snapshot")
        _, new, schema = self._snapshot(stay.unionByName(rows.select(*stay.columns)), check)
        pointers = self._pointers(was)
        kept = pointers.join(t, self._same(pointers, t, self.at), "left_anti")
        return self._commit("reindex", was, self._point(kept.unionByName(new), schema))

    def rollback(self, version: int) -> int:
        """Commits a version that reads as an older one did."""
        entry = self._entry(version)
        return self._commit("rollback", version, {k: entry[k] for k in ("pointers", "pointer_schema", "schema")})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the snapshots that none of the last `keep` versions points to, those of failed writes among them; their names. No write may be under way."""
        used = {r.snapshot for v in self.versions()[-keep:] for r in self._pointers(v).select("snapshot").distinct().collect()}
        old = [n for n in files.names(self.spark, f"{self.path}/data") if n.removeprefix("snapshot=") not in used]
        for n in old:
            files.remove(self.spark, f"{self.path}/data/{n}")
        return old


def complete(expected: DataFrame, key: str) -> Callable[[DataFrame], None]:
    """A check for `publish`: every expected key must be among the rows."""

    def check(rows: DataFrame) -> None:
        lost = expected.select(key).distinct().join(rows.select(key), key, "left_anti").count()
        if lost:
            raise ValueError(f"{lost} of {key} are missing")

    return check
