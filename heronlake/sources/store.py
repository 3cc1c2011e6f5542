"""Stored tables with keys: upserts, deletes and appends that rewrite only the files they touch.

A table's rows lie in Parquet files by partition columns (a tenant, a knowledge base) and buckets of a hash. A manifest, a
table itself, lists the files of a snapshot with their partition and bucket, so reads open only the files that can hold what
they ask for. A change writes new files, then a manifest for each table that it changed, and last a small commit file which
names them all. That file is created only if it doesn't exist, so a change that is cut off leaves the snapshot before it,
of two changes at once one fails, and several tables change together. Older snapshots can be read until :meth:`Store.vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.operators import merge
from heronlake.sources.scratch import files


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


@dataclass(frozen=True)
class Layout:
    """How a table is kept: its columns, key, partition columns, the columns that its buckets go by (the key's, or some that
    the key determines, such as a chunk's document), and their number."""

    columns: str
    key: tuple[str, ...]
    parts: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    buckets: int = 16

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)

    @property
    def bucket_by(self) -> tuple[str, ...]:
        return self.by or self.key

    def bucket(self, values: dict[str, Column] | None = None) -> Column:
        """The bucket of a row, or of some values, as the columns' types hash."""
        cast = [(values or {}).get(c, F.col(c)).cast(self.schema[c].dataType) for c in self.bucket_by]
        return F.pmod(F.xxhash64(*cast), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """The tables as one commit left them."""

    store: Store
    version: int
    manifests: dict[str, str] = field(default_factory=dict)

    def files(self, table: str) -> DataFrame:
        """(file, bytes, bucket, partition columns, n) of each file of a table."""
        spark, layout = self.store.spark, self.store.tables[table]
        parts = ", ".join(f"`{p}` {layout.schema[p].dataType.simpleString()}" for p in layout.parts)
        kinds = f"file string, bytes bigint, bucket int, n bigint{', ' + parts if parts else ''}"
        if table not in self.manifests:
            return spark.createDataFrame([], kinds)
        return spark.read.schema(kinds).parquet(f"{self.store.path}/manifest/{table}/{self.manifests[table]}")

    def pruned(self, table: str, where: dict | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The files that can hold rows with the values of ``where`` and the keys of a batch."""
        layout, found = self.store.tables[table], self.files(table)
        where = where or {}
        for p in layout.parts:
            if p in where:
                found = found.where(F.col(p).eqNullSafe(F.lit(where[p])))
        if all(c in where for c in layout.bucket_by):
            found = found.where(F.col("bucket") == layout.bucket({c: F.lit(where[c]) for c in layout.bucket_by}))
        if keys is not None:
            if all(c in keys.columns for c in layout.bucket_by):
                wanted = keys.select(layout.bucket().alias("bucket")).distinct()
                found = found.join(F.broadcast(wanted), "bucket", "left_semi")  # at most a row a bucket
            shared = [p for p in layout.parts if p in keys.columns]
            if shared:
                found = found.join(keys.select(*shared).distinct(), shared, "left_semi")
        return found

    def read(self, table: str, where: dict | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a table; with ``where``, those with these values, and with ``keys``, those whose key a batch has
        (in the columns that both have). Only files that the manifest can't rule out are opened."""
        layout = self.store.tables[table]
        rows = self.store.open(table, [r.file for r in self.pruned(table, where, keys).select("file").collect()])
        for c, value in (where or {}).items():
            rows = rows.where(F.col(c).eqNullSafe(F.lit(value)))
        if keys is not None:
            on = [c for c in (*layout.parts, *layout.key, *layout.by) if c in keys.columns]
            rows = rows.join(keys.select(*dict.fromkeys(on)).distinct(), list(dict.fromkeys(on)), "left_semi")
        return rows

    def counts(self, table: str) -> DataFrame:
        """(partition columns, n): rows of each partition, by the manifest alone."""
        return self.files(table).groupBy(*self.store.tables[table].parts).agg(F.sum("n").alias("n"))


class Store:
    """Tables of some layouts below one path."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Layout]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        for p in (f"{self.path}/commits", f"{self.path}/data"):
            fs, target = files(spark, p)
            fs.mkdirs(target)

    def versions(self) -> list[int]:
        fs, target = files(self.spark, f"{self.path}/commits")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(target) if s.getPath().getName().endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last snapshot, or that of a version; version 0 has no rows."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Snapshot(self, 0)
        line = self.spark.read.text(f"{self.path}/commits/{version:012d}.json").first()
        return Snapshot(self, version, json.loads(line.value))

    def read(self, table: str, where: dict | None = None, keys: DataFrame | None = None) -> DataFrame:
        return self.snapshot().read(table, where, keys)

    def change(self) -> Change:
        """A change of one or more tables: ``with store.change() as c: c.upsert(...)``; it is committed at the end."""
        return Change(self)

    def open(self, table: str, paths: list[str], named: bool = False) -> DataFrame:
        """The rows of some files, which Spark names as URIs; with their file's name if ``named``."""
        layout = self.tables[table]
        schema = layout.schema.add("bucket", T.IntegerType()) if named else layout.schema
        if not paths:
            empty = T.StructType([*layout.schema.fields, T.StructField("file", T.StringType())]) if named else layout.schema
            return self.spark.createDataFrame([], empty)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{table}").parquet(*map(unquote, paths))
        columns = [F.col(c) for c in layout.schema.names]
        return rows.select(*columns, F.col("_metadata.file_path").alias("file")) if named else rows.select(*columns)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last ``keep`` snapshots has, those of changes that were cut off too, and older
        commits; how many files went. Not while another change runs."""
        versions = self.versions()
        used: set[str] = set()
        for v in versions[-keep:]:
            s = self.snapshot(v)
            for t in s.manifests:
                used |= {unquote(r.file).split("/write=", 1)[1] for r in s.files(t).select("file").collect()}
        fs, target = files(self.spark, f"{self.path}/data")
        found, gone = fs.listFiles(target, True), []
        while found.hasNext():
            p = found.next().getPath()
            if p.getName().endswith(".parquet") and p.toString().split("/write=", 1)[1] not in used:
                gone.append(p)
        for p in gone:
            fs.delete(p, False)
        for v in versions[:-keep]:
            fs.delete(files(self.spark, f"{self.path}/commits/{v:012d}.json")[1], False)
        return len(gone)


class Change:
    """What a change does to a snapshot. Tables that it has changed are read as it leaves them."""

    def __init__(self, store: Store) -> None:
        self.store, self.base = store, store.snapshot()
        self.now = Snapshot(store, self.base.version, dict(self.base.manifests))
        #: Files of the snapshot that were written again, and new ones, by table.
        self.rewritten: dict[str, int] = {}

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.now.manifests != self.base.manifests:
            self._commit()

    def _commit(self) -> None:
        spark = self.store.spark
        fs, target = files(spark, f"{self.store.path}/commits/{self.base.version + 1:012d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {self.base.version + 1} was committed by another change") from e
            raise
        out.write(json.dumps(self.now.manifests).encode())
        out.close()

    def upsert(self, table: str, rows: DataFrame, order: Iterable[str] = ()) -> None:
        """Insert rows or replace those with their key, in any partition. Of rows with one key the last by ``order`` counts
        (the greatest, without). Rows with a null in the key replace none."""
        layout = self.store.tables[table]
        rest = [c for c in layout.schema.names if c not in layout.key]
        ordered = [c for c in rest if not isinstance(layout.schema[c].dataType, (T.MapType, T.VariantType))]
        whole = F.lit(True)
        for c in layout.key:
            whole &= F.col(c).isNotNull()
        named = rows.where(whole)
        last = merge.last_write(named, list(layout.key), list(order) or ordered) if ordered else named.dropDuplicates(list(layout.key))
        new = last.select(*layout.schema.names).unionByName(rows.where(~whole).select(*layout.schema.names))
        self._replace(table, new, new.select(*dict.fromkeys((*layout.key, *layout.bucket_by))), list(layout.key))

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows, whatever is there."""
        self._replace(table, rows, None, [])

    def delete(self, table: str, keys: DataFrame, on: Iterable[str] = ()) -> None:
        """Delete the rows that have a batch's values in ``on`` (the key, if none are named)."""
        on = list(on) or list(self.store.tables[table].key)
        self._replace(table, None, keys.select(*on).distinct(), on)

    def clear(self, table: str, **parts) -> None:
        """Delete whole partitions, or all; only the manifest changes."""
        found = self.now.files(table)
        gone = F.lit(True)
        for p, value in parts.items():
            if p not in self.store.tables[table].parts:
                raise ValueError(f"{table} isn't partitioned by {p}")
            gone &= F.col(p).eqNullSafe(F.lit(value))
        self._list(table, found.where(~gone))

    def compact(self, table: str, most: int = 4) -> None:
        """Write the buckets that have more than ``most`` files again."""
        layout = self.store.tables[table]
        place = ["bucket", *layout.parts]
        many = self.now.files(table).groupBy(*place).agg(F.collect_list("file").alias("f")).where(F.size("f") > most)
        old = [x for r in many.select("f").collect() for x in r.f]
        if old:
            self._write(table, old, self.store.open(table, old))

    def _replace(self, table: str, new: DataFrame | None, gone: DataFrame | None, on: list[str]) -> None:
        old: list[str] = []
        rows = new
        if gone is not None:
            near = [r.file for r in self.now.pruned(table, keys=gone.select(*on) if new is None else gone).select("file").collect()]
            if near:
                held = self.store.open(table, near, named=True)
                old = [r.file for r in held.join(gone.select(*on).distinct(), on, "left_semi").select("file").distinct().collect()]
            if old:
                kept = self.store.open(table, old).join(gone.select(*on).distinct(), on, "left_anti").select(*self.store.tables[table].schema.names)
                rows = kept if new is None else kept.unionByName(new.select(*kept.columns))
        self._write(table, old, rows if new is not None or old else None)

    def _write(self, table: str, old: list[str], rows: DataFrame | None) -> None:
        """Rows in new files, in place of some old ones."""
        store, layout = self.store, self.store.tables[table]
        before = self.now.files(table)
        if old:
            before = before.join(store.spark.createDataFrame([(x,) for x in old], "file string"), "file", "left_anti")
        self.rewritten[table] = self.rewritten.get(table, 0) + len(old)
        if rows is not None:
            path = f"{store.path}/data/{table}/write={uuid.uuid4().hex}"
            place = [*layout.parts, "bucket"]
            rows = rows.select(*(F.col(c).cast(layout.schema[c].dataType).alias(c) for c in layout.schema.names), layout.bucket().alias("bucket"))
            # rebalancing brings a bucket's rows together and cuts those of a hot one into several files
            rows = rows.hint("rebalance", *place).sortWithinPartitions(*place, *layout.key)
            rows.write.partitionBy(*place).parquet(path)
            if self._any(path):
                written = store.spark.read.schema(layout.schema.add("bucket", T.IntegerType())).option("basePath", path).parquet(path)
                listed = written.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "bucket", *layout.parts)
                listed = listed.groupBy("file", "bytes", *place).agg(F.count(F.lit(1)).alias("n"))
                before = before.unionByName(listed.select(*before.columns))
        self._list(table, before)

    def _any(self, path: str) -> bool:
        fs, target = files(self.store.spark, path)
        return any(s.isDirectory() for s in fs.listStatus(target))

    def _list(self, table: str, listed: DataFrame) -> None:
        name = uuid.uuid4().hex
        listed.coalesce(1).write.parquet(f"{self.store.path}/manifest/{table}/{name}")  # a row a file
        self.now.manifests[table] = name
