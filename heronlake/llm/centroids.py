"""Centroid clustering by sort-means, in integers.

Vectors are scaled to integers, so sums, distances and means are exact and don't depend on the order of additions. In each
round a task sorts, for each centroid, the others by their distance from it. A vector starts from its previous centroid, at
distance d, and goes through the others in that order; it stops at the first that lies strictly beyond 2 d, since all from
there on are farther from the vector than d (the triangle inequality). Ties go to the smaller number, hence "strictly".

The table of a round holds each vector with its centroid, and a row for each task and centroid with the sum of its vectors;
only these few rows are read for the new centroids, and they are added up by Spark. What a task gets from the driver are
the centroids: k times the dimensions, whatever the data's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import discard, release, stored

#: Scaled components are kept within these bounds, so that a squared distance fits a long for up to 64 dimensions.
BOUND = 1 << 27
ROUND = "vec_id {0}, vector array<int>, cluster int, distance bigint, total array<bigint>, n bigint"


def integers(vectors: DataFrame, dims: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): the vectors of ``dims`` components, none null or non-finite, as floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(key).alias("vec_id"), scaled.alias("vector"))


def first(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of ``seed:vec_id`` (a null id: nothing), ties by the vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.vector for r in vectors.orderBy(name, "vector").select("vector").limit(k).collect()], np.int64)


def assign(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of x, scanned from its previous centroid."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    nearest, least = previous.copy(), ((x - centroids[previous]) ** 2).sum(1)
    for c in np.unique(previous):
        rows = np.flatnonzero(previous == c)
        limit = least[rows].copy()
        for other in np.argsort(between[c], kind="stable"):
            if other == c:
                continue
            # between > 4 * limit, without an overflow: both are squares, so 2 d is 4 times
            inside = (between[c, other] - 1) // 4 < limit
            rows, limit = rows[inside], limit[inside]
            if not len(rows):
                break
            d = ((x[rows] - centroids[other]) ** 2).sum(1)
            better = (d < least[rows]) | ((d == least[rows]) & (other < nearest[rows]))
            nearest[rows[better]], least[rows[better]] = other, d[better]
    return nearest, least


def _round(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The table after an assignment, with each task's sums."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = table.sparkSession.sparkContext.broadcast(centroids)  # k times the dimensions
    kind = table.schema["vec_id"].dataType.simpleString()
    rows = table.where("n IS NULL").select("vec_id", "vector", "cluster")
    out = table.sparkSession.createDataFrame([], ROUND.format(kind)).schema
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, centers = to_arrow_schema(out), held.value
        total, n = np.zeros(centers.shape, np.int64), np.zeros(len(centers), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(-1, dims).astype(np.int64)
            cluster, distance = assign(x, b.column(2).to_numpy().astype(np.int64), centers)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(0)
                n[c] += int((cluster == c).sum())
            columns = [b.column(0), b.column(1).cast(kinds.field(1).type), pa.array(cluster, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(x), kinds.field(i).type) for i in (4, 5))], schema=kinds)
        used = np.flatnonzero(n)
        empty = [pa.nulls(len(used), kinds.field(i).type) for i in (0, 1)]
        sums = [pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()), pa.array([total[c] for c in used], kinds.field(4).type), pa.array(n[used])]
        yield pa.RecordBatch.from_arrays([*empty, *sums], schema=kinds)
        release()

    return stored(rows.mapInArrow(run, out), "centroids-round")


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of what each centroid has; one without vectors stays."""
    parts = table.where("n IS NOT NULL").select("cluster", "n", F.posexplode("total").alias("i", "x"))
    sums = parts.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # k times the dimensions
        out[r.cluster, r.i] = int(r.x) // r.n
    return out


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, vector, cluster, distance), centroids) after ``rounds`` moves of the centroids and a last assignment.

    Vectors that are null, of another length, or hold a null or non-finite component are left out; scaled components are kept
    within :data:`BOUND`. Rows with one id are rows of their own, a null id too. Fewer vectors than k are that many
    centroids, and none give no rows. Other columns are ignored, whatever they are called. One pass over the vectors and one
    written table for each round, no shuffle but of the tasks' sums; the table of the round before is deleted.
    """
    table = integers(vectors, dims, scale, key, vector)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("distance", "bigint"), ("total", "array<bigint>"), ("n", "bigint"))]
    table = stored(table.select("vec_id", "vector", F.lit(0).alias("cluster"), *empty), "centroids-vectors")
    centroids = first(table.select("vec_id", "vector"), k, seed).reshape(-1, dims)
    for i in range(rounds + 1 if len(centroids) else 0):
        after = _round(table, centroids)
        discard(table)
        table = after
        if i < rounds:
            centroids = moved(table, centroids)
    return table.where("n IS NULL").select("vec_id", "vector", "cluster", "distance"), centroids


def described(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The clustered rows with the inertia of their cluster and of all, and the hash of their centroid."""
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    most = 2**63 - 1
    facts = [
        (c, min(s, most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, s in sums.items()
    ]
    told = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
