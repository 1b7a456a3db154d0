"""Keyed tables written by touched buckets (M4, M7, M8, K4).

A table is a folder of Parquet files in ``buckets`` key-hash buckets.  A write reads and rewrites only the
buckets that its batch touches, into a new folder, and then adds one manifest file that says for every bucket
in which folder its rows are.  The manifest is the commit: a writer that dies before it leaves the table as it
was, and readers of an older version keep reading theirs.  Nothing is renamed or staged.

The merge inside the touched buckets is one aggregation on the key (``operators.upsert``).  Keys are unique within a table,
so buckets are even however often a key appears in a batch.

    data/<version>-<id>/bucket=<b>/part-*.parquet
    commits/<version>.json        {"parent", "keys", "buckets", "schema", "entries": {bucket: folder}, "end": true}
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.upsert import apply_changes, latest_per_key, upsert

_BUCKET = "bucket"


class ConflictError(RuntimeError):
    """Another writer committed in between; the batch can be written again."""


class KeyedTable:
    """A keyed table at ``path``.  A NULL in a key column is a key value like any other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._copy = jvm.org.apache.commons.io.IOUtils

    # -- manifests

    def _listed(self, folder: str) -> list[str]:
        p = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _manifest(self, version: int) -> dict | None:
        """The manifest of a version; None for one whose writer died while writing it."""
        stream = self._fs.open(self._path(f"{self.path}/commits/{version:012d}.json"))
        try:
            text = self._copy.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            got = json.loads(text)
        except ValueError:
            return None
        return got if got.get("end") else None

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return [v for v in self._numbers() if self._manifest(v)]

    def _numbers(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._listed("commits") if n.endswith(".json")]

    def _latest(self) -> tuple[int, dict]:
        for v in reversed(self._numbers()):
            got = self._manifest(v)
            if got:
                return v, got
        raise FileNotFoundError(f"no keyed table at {self.path}")

    def _put(self, version: int, manifest: dict) -> None:
        out = None
        try:
            out = self._fs.create(self._path(f"{self.path}/commits/{version:012d}.json"), False)
        except Exception as e:                                              # noqa: BLE001 - told apart by what is there
            if version in self._numbers():
                raise ConflictError(f"version {version} of {self.path} is taken") from e
            raise
        out.write(bytearray(json.dumps(manifest | {"end": True}).encode()))
        out.close()

    # -- reading

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or an older version of it."""
        got = self._latest()[1] if version is None else self._manifest(version)
        return self._rows(got, None)

    def _rows(self, manifest: dict, touched: set[int] | None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/{_BUCKET}={b}" for b, folder in sorted(manifest["entries"].items()) if touched is None or int(b) in touched]
        reader = self.spark.read.schema(manifest["schema"])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], manifest["schema"])

    # -- writing

    @staticmethod
    def _bucket(keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")

    def create(self, df: DataFrame, keys: Sequence[str], buckets: int = 64, order: str | None = None) -> int:
        """Write a new table from ``df``; of rows that share a key the one of the greatest ``order`` stays."""
        if self._numbers():
            raise ConflictError(f"{self.path} is a keyed table already")
        kept = latest_per_key(df, keys, [order] if order else [F.lit(0)])
        kept = kept.select(*[c for c in df.columns if c != order])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        manifest = {"parent": 0, "keys": list(keys), "buckets": buckets, "schema": schema, "entries": {}}
        return self._write(kept, manifest, 0, set(range(buckets)))

    def _write(self, rows: DataFrame, manifest: dict, parent: int, touched: set[int]) -> int:
        version = max([parent, *self._numbers()]) + 1
        folder = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        n = min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        columns = [c for c in rows.columns]
        dealt = rows.select(*columns, self._bucket(manifest["keys"], manifest["buckets"]).alias(_BUCKET)).repartition(n, _BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{folder}")
        written = {int(n.split("=")[1]) for n in self._listed(f"data/{folder}") if n.startswith(f"{_BUCKET}=")}
        entries = {b: f for b, f in manifest["entries"].items() if int(b) not in touched} | {str(b): folder for b in written}
        if parent and self._latest()[0] != parent:
            raise ConflictError(f"{self.path} got version {self._latest()[0]} while {version} was written")
        self._put(version, manifest | {"parent": parent, "entries": entries})
        return version

    def _touched(self, batch: DataFrame, manifest: dict) -> set[int]:
        found = batch.select(self._bucket(manifest["keys"], manifest["buckets"]).alias("b")).distinct().collect()    # at most one row a bucket
        return {r.b for r in found}

    def _merge(self, batch: DataFrame, merge) -> int:
        parent, manifest = self._latest()
        # keys hash alike only as the table's own types
        types = {f.name: f.dataType for f in self._rows(manifest, set()).schema.fields}
        missing = [k for k in manifest["keys"] if k not in batch.columns]
        if missing:
            raise ValueError(f"the batch lacks key columns {missing}")
        batch = batch.withColumns({k: F.col(k).cast(types[k]) for k in manifest["keys"]})
        touched = self._touched(batch, manifest)
        if not touched:
            return parent
        merged = merge(self._rows(manifest, touched), batch, manifest["keys"])
        return self._write(merged.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()]), manifest, parent, touched)

    def upsert(self, batch: DataFrame, order: str | None = None) -> int:
        """M4, M7: insert or update by key; the last duplicate (greatest ``order``) wins, columns that the batch
        lacks keep their values.  Returns the version; a batch without rows writes none."""
        return self._merge(batch, lambda old, new, keys: upsert(old, new, keys, order))

    def apply_changes(self, changes: DataFrame, order: str, op_col: str = "op", delete_value: str = "delete") -> int:
        """M8: the latest change of each key decides; deletes remove the key."""
        return self._merge(changes, lambda old, new, keys: apply_changes(old, new, keys, order, op_col, delete_value))

    def delete(self, gone: DataFrame) -> int:
        """Remove the keys in ``gone``."""
        def without(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
            marked = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
            return old.join(marked, [old[k].eqNullSafe(marked[f"__{k}"]) for k in keys], "left_anti")
        return self._merge(gone, without)

    def insert(self, batch: DataFrame, collisions: str | None = None) -> dict:
        """K3, K4: add rows of new keys.  If a key is there already, or twice in the batch, the whole batch goes to the keyed table at
        ``collisions`` (default: this path and a suffix) and this one stays as it is.  Test and write see one version:
        a writer in between is a conflict."""
        parent, manifest = self._latest()
        keys = manifest["keys"]
        touched = self._touched(batch, manifest)
        if not touched:
            return {"path": self.path, "version": parent, "collision": False}
        old = self._rows(manifest, touched)
        marked = old.select(*[F.col(k).alias(f"__{k}") for k in keys])
        hit = batch.join(marked, [batch[k].eqNullSafe(marked[f"__{k}"]) for k in keys], "left_semi")
        if not hit.isEmpty() or not batch.groupBy(*keys).count().where("count > 1").isEmpty():
            other = collisions or f"{self.path}_{uuid.uuid4().hex[:8]}"
            batch.write.parquet(other)
            return {"path": other, "version": parent, "collision": True}
        types = {f.name: f.dataType for f in old.schema.fields}
        rows = batch.select(*[(F.col(c) if c in batch.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        return {"path": self.path, "version": self._write(old.unionByName(rows), manifest, parent, touched), "collision": False}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drop data folders that none of the last ``keep`` versions names, and older manifests."""
        versions = self.versions()
        held = {f for v in versions[-keep:] for f in self._manifest(v)["entries"].values()}
        gone = [f for f in self._listed("data") if f not in held]
        for f in gone:
            self._fs.delete(self._path(f"{self.path}/data/{f}"), True)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/commits/{v:012d}.json"), False)
        return [os.path.join(self.path, "data", f) for f in gone]
