"""What the operators share: the shared folder, written tables, Arrow helpers and connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one outgoing Arrow batch holds, about.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session doesn't name one, a local session gets a temporary folder; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return f"file://{tempfile.gettempdir()}/heronlake-shared-{os.getuid()}"
    raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines see")


_RUNS: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when its driver ends."""
    run = f"{shared_dir(spark)}/heronlake-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        _RUNS.add(run)
        target = spark._jvm.org.apache.hadoop.fs.Path(run)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, zstd: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage and outlives executors.

    With a level of ``zstd`` it is compressed by that.
    """
    path = scratch(df.sparkSession, name)
    out = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", zstd) if zstd else df.write
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    if files := table.inputFiles():
        remove(table.sparkSession, files[0].rsplit("/", 1)[0])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_rows(
    df: DataFrame, columns: list[str], schema: str | T.StructType, make: Callable[[], Callable[..., Iterable[tuple]]]
) -> DataFrame:
    """Rows of Python values made from runs of rows, through Arrow.

    ``make`` runs once in each task and returns a function that gets a list of values for each of ``columns``, and
    yields output rows; its attribute ``done``, if any, is called at the end of the task and may return last rows. Runs and outgoing batches are cut by bytes, so memory is bounded by :data:`BATCH_BYTES` and the
    longest row.
    """
    from pyspark.sql.types import StructType

    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        work = make()
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(c, type=kinds.field(i).type) for i, c in enumerate(zip(*rows, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, schema=kinds)

        for b in batches:
            for part in slices(b):
                for row in work(*(part.column(i).to_pylist() for i in range(len(columns)))):
                    rows.append(row)
                    held += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes, list, np.ndarray)))
                    if held > BATCH_BYTES or len(rows) >= 20_000:
                        yield batch()
                        rows, held = [], 0
        if hasattr(work, "done"):
            rows += work.done() or ()
        if rows:
            yield batch()
        del work, rows
        release()

    return df.select(*columns).mapInArrow(run, out)


def release() -> None:
    """Give freed memory back to the system: a worker lives on, and the next task in it may need less."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most / max(1, batch.nbytes)))) if n else 1
    for i in range(0, n, step):
        yield batch.slice(i, step)


def ddl(df: DataFrame, *names: str) -> str:
    """The named columns as the start of a schema string."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge list reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every step links the neighbours of a node to the
    smallest of them, found by a partial aggregation and a join, so no node's neighbours are ever gathered. Each round is
    written to the shared folder. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = stored(e, "cc")

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first())

    was = state(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "cc")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(low, "u")
        small = small.select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("p")
        ).select("p.u", "p.v")
        e = stored(small.where("u > v").distinct(), "cc")
        now = state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    assert spark
    return nodes.unionByName(roots)
