"""A vector index: an inverted file of cells around centroids, probed by cosine and rescored exactly.

The centroids are fitted on a bounded sample; every vector is stored, by its nearest centroid's cell. A search reads the
cells nearest to its query. How many are enough for a wanted recall is measured when the index is built, on sampled vectors
against all. An exact search then also reads each other cell that can hold a better vector: no vector of a cell is
farther from its centroid than the cell's angle, so by the triangle inequality of angles its cosine with a query is at most
that of the difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.sources.scratch import stored
from heronlake.sources.store import Layout, Store

#: Vectors that centroids are fitted on at most, most cells, rounds; vectors that recall is measured with; queries at once.
SAMPLE, CELLS, ROUNDS, AUDITED, ASKED = 50_000, 4096, 10, 256, 1024
#: Cells of a matrix of scores that are filled at once; what rounded scores may differ by.
SCORES, SLACK = 4_000_000, 1e-8


def unit(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which of them count): null, ragged, zero and non-finite ones don't."""
    fits = np.array([v is not None and len(v) == dims and None not in v for v in vectors], bool)
    x = np.zeros((len(vectors), dims))
    if fits.any():
        x[fits] = np.array([v for v, ok in zip(vectors, fits, strict=True) if ok], np.float64)
    size = np.sqrt((x * x).sum(1))
    fits &= np.isfinite(size) & (size > 0)
    x[~fits] = 0
    return x / np.where(fits, size, 1.0)[:, None], fits


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by rounds of spherical means; the first are spread over the sample."""
    centers = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centers = np.where(size > 1e-12, sums / np.maximum(size, 1e-300), centers)
    return centers


class VectorIndex:
    """An index below a path. Keys aren't null; ``also`` names columns of the vectors' table that searches can filter by."""

    def __init__(self, spark: SparkSession, path: str, dims: int, key: str = "bigint", also: str = "") -> None:
        more = f", {also}" if also else ""
        self.dims, self.spark = dims, spark
        self.store = Store(spark, path, {
            "vectors": Layout(f"key {key}, cell int, vector array<float>{more}", ("key",), ("cell",), (), 1),
            "centroids": Layout("cell int, center array<double>", ("cell",), (), (), 1),
            "cells": Layout("cell int, n bigint, low double", ("cell",), (), (), 1),
            "recall": Layout("probes int, recall double", ("probes",), (), (), 1),
        })

    def centers(self) -> np.ndarray:
        rows = self.store.read("centroids").orderBy("cell").collect()  # CELLS at most
        return np.array([r.center for r in rows]).reshape(-1, self.dims)

    def build(self, vectors: DataFrame, key: str, vector: str, cells: int | None = None) -> None:
        """Fit the centroids on :data:`SAMPLE` vectors at most (those of the least hash), store all, and measure recall at 10.
        Vectors that are null, of other dimensions, zero or hold a null or non-finite component are left out."""
        n = vectors.count()
        some = vectors.where(F.size(vector) == self.dims).orderBy(F.xxhash64(key)).limit(SAMPLE).select(vector).collect()
        x, fits = unit([r[0] for r in some], self.dims)
        x = x[fits]
        centers = fitted(x, cells or min(CELLS, max(1, int(n**0.5)))) if len(x) else np.zeros((0, self.dims))
        with self.store.change() as c:
            for t in ("vectors", "centroids", "cells", "recall"):
                c.clear(t)
            c.append("centroids", self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centers)], "cell int, center array<double>"))
        if len(centers):
            self.add(vectors, key, vector)
            self._measure()

    def add(self, vectors: DataFrame, key: str, vector: str) -> None:
        """Store vectors, new ones or others in place of those with their key; centroids and the measured recall stay."""
        centers = self.centers()
        held = self.spark.sparkContext.broadcast(centers)  # CELLS vectors at most
        names = [c for c in self.store.tables["vectors"].schema.names if c not in ("key", "cell", "vector")]
        rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"), *names)
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, fits = unit(b.column(1).to_pylist(), dims)
                kept = b.filter(pa.array(fits))
                scores = x[fits] @ held.value.T
                cell = scores.argmax(1)
                columns = [*kept.columns, pa.array(cell, pa.int32()), pa.array(scores[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept.schema.names, "cell", "near"])

        placed = stored(rows.mapInArrow(run, schema), "placed")
        with self.store.change() as c:
            c.upsert("vectors", placed.drop("near"))
            cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("low"))
            c.append("cells", cells)

    def _measure(self) -> None:
        """Store, for numbers of probed cells, the recall at 10 of sampled vectors against all."""
        some = self.store.read("vectors").orderBy(F.xxhash64(F.col("key"), F.lit(1))).limit(AUDITED)
        queries = stored(some.select(F.col("key").alias("q"), F.col("vector").alias("v")), "audit")
        rows = queries.collect()  # AUDITED
        centers = self.centers()
        x, _ = unit([r.v for r in rows], self.dims)
        place = np.empty((len(rows), len(centers)), int)
        np.put_along_axis(place, (-(x @ centers.T)).argsort(1, kind="stable"), np.arange(len(centers))[None], 1)
        number = {r.q: i for i, r in enumerate(rows)}
        best = self._nearest(queries, "q", "v", 10, {i: range(len(centers)) for i in range(len(rows))}, rows)
        at = np.array([place[number[r.q], r.cell] for r in best.select("q", "cell").collect()])
        share = [(int(p), float((at < p).mean())) for p in np.unique(np.append(np.arange(1, len(centers) + 1, max(1, len(centers) // 64)), len(centers)))]
        with self.store.change() as c:
            c.append("recall", self.spark.createDataFrame(share, "probes int, recall double"))

    def probes(self, recall: float) -> int:
        """The fewest cells that gave a recall."""
        row = self.store.read("recall").where(F.col("recall") >= recall).agg(F.min("probes")).first()
        return row[0] or 1

    def search(
        self, queries: DataFrame, qkey: str, vector: str, k: int, recall: float = 0.95, exact: bool = False, threshold: float | None = None, where: Column | None = None
    ) -> DataFrame:
        """(qkey, key, score, rank): the k nearest vectors of each query by cosine, rounded to nine digits, ties by key.

        With a ``threshold``, only those that reach it; with ``where``, of the vectors for which it holds. Cells are probed for
        a recall, or, if ``exact``, until no other can hold a better vector. Queries come in batches of :data:`ASKED`; one that
        is null, of other dimensions, zero or not finite has no rows.
        """
        centers, out = self.centers(), None
        low = {r.cell: r.low for r in self.store.read("cells").groupBy("cell").agg(F.min("low").alias("low")).collect()}  # CELLS
        radius = np.array([np.arccos(np.clip(low.get(i, 1.0), -1, 1)) for i in range(len(centers))])
        rows = queries.where(F.col(qkey).isNotNull()).select(F.col(qkey), F.col(vector))
        n = max(1, -(-rows.count() // ASKED))
        probes = min(len(centers), self.probes(recall)) if len(centers) else 0
        for b in range(n):
            batch = stored(rows.where(F.pmod(F.xxhash64(qkey), F.lit(n)) == b), "asked")
            some = batch.collect()  # ASKED, about
            x, fits = unit([r[1] for r in some], self.dims)
            near = x @ centers.T
            order = (-near).argsort(1, kind="stable")
            cells = {i: set(order[i, :probes].tolist()) for i in range(len(some)) if fits[i]}
            found = self._nearest(batch, qkey, vector, k, cells, some, threshold, where)
            if exact:
                found = stored(found, "nearest")
                last = {r[qkey]: r.s for r in found.where(F.col("rank") == k).select(qkey, F.col("score").alias("s")).collect()}
                most = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0))
                rest = {}
                for i in cells:
                    least = max(last.get(some[i][0], -2.0), -2.0 if threshold is None else threshold)
                    rest[i] = set(np.flatnonzero(most[i] >= least - SLACK).tolist()) - cells[i]
                more = self._nearest(batch, qkey, vector, k, rest, some, threshold, where)
                found = _best(found.drop("rank").unionByName(more.drop("rank")), qkey, k)
            out = found if out is None else out.unionByName(found)
        return out.select(qkey, "key", "score", "rank")

    def _nearest(self, batch: DataFrame, qkey: str, vector: str, k: int, cells: dict, some: list, threshold: float | None = None, where: Column | None = None) -> DataFrame:
        """(qkey, key, cell, score, rank) of the vectors in the cells that each query, by its number, asks for."""
        snap, dims = self.store.snapshot(), self.dims
        wanted = sorted({c for x in cells.values() for c in x})
        files = snap.files("vectors").where(F.col("cell").isin(wanted)).select("file").collect()
        vectors = self.store.open("vectors", [r.file for r in files])
        vectors = (vectors if where is None else vectors.where(where)).select("key", "cell", "vector")
        by_cell: dict[int, list[int]] = {}
        for q, x in cells.items():
            for c in x:
                by_cell.setdefault(c, []).append(q)
        held = self.spark.sparkContext.broadcast((by_cell, unit([r[1] for r in some], dims)[0], [r[0] for r in some]))  # ASKED queries
        least = -2.0 if threshold is None else threshold - SLACK
        schema = T.StructType([batch.schema[qkey], vectors.schema["key"], T.StructField("cell", T.IntegerType()), T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds, (asking, asked, names) = to_arrow_schema(schema), held.value
            for b in batches:
                x, _ = unit(b.column(2).to_pylist(), dims)
                cell = b.column(1).to_numpy()
                for c in np.unique(cell):
                    at, qs = np.flatnonzero(cell == c), asking.get(int(c), [])
                    for i in range(0, len(qs), max(1, SCORES // len(at))):
                        part = qs[i : i + max(1, SCORES // len(at))]
                        scores = np.round(x[at] @ asked[part].T, 9)
                        for j, q in enumerate(part):
                            own = scores[:, j]
                            on = np.flatnonzero(own >= max(least, np.partition(own, -k)[-k] if len(own) > k else -2.0))
                            if len(on):
                                columns = [pa.array([names[q]] * len(on), kinds.field(0).type), b.column(0).take(pa.array(at[on])), pa.array(np.full(len(on), c, np.int32)), pa.array(own[on])]
                                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

        found = vectors.mapInArrow(run, schema)
        if threshold is not None:
            found = found.where(F.col("score") >= threshold)
        return _best(found, qkey, k)


def _best(found: DataFrame, qkey: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(qkey).orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
