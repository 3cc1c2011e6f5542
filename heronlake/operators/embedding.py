"""Embedding providers, and a store of vectors by content: what was embedded once isn't embedded again.

A provider has a name, its dimensions, and ``embed``, which takes the texts of a batch and gives a row for each. It is made in
each task from its class and options, so it needn't be sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.operators.retrieval import DIMENSIONS, Tokens
from heronlake.sources.scratch import stored
from heronlake.sources.store import Layout, Store

#: Texts that a provider gets at once.
BATCH = 64


class Provider(Protocol):
    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashProvider:
    """Hash embeddings, without a model."""

    def __init__(self, dims: int = DIMENSIONS) -> None:
        self.dims, self.name = dims, f"hash-{dims}"
        self.tokens = Tokens({}, dims)

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.tokens.table(texts)[1]


PROVIDERS: dict[str, type] = {"hash": HashProvider}


def provider(kind: str, **options) -> Provider:
    if kind not in PROVIDERS:
        raise ValueError(f"no embedding provider is called {kind}")
    return PROVIDERS[kind](**options)


class EmbeddingStore:
    """Vectors below a path, by provider and SHA-256 of the content; several providers can share a path."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "hash", buckets: int = 8, **options) -> None:
        self.kind, self.options, self.name = kind, options, provider(kind, **options).name
        columns = "provider string, content_hash string, vector array<double>"
        self.store = Store(spark, path, {"vectors": Layout(columns, ("provider", "content_hash"), ("provider",), ("content_hash",), buckets)})
        #: Texts that were embedded, counted where they were: repeated tasks count again.
        self.calls = spark.sparkContext.accumulator(0)

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, vector) of each row; a null text is empty. Contents that the store hasn't are embedded, once each, and added."""
        hashed = rows.select(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash"))
        held = self.store.read("vectors", {"provider": self.name}, keys=hashed.select("content_hash").distinct()).select("content_hash")
        contents = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("content_hash", F.sha2("text", 256))
        new = contents.join(held, "content_hash", "left_anti").dropDuplicates(["content_hash"])
        kind, options, calls = self.kind, self.options, self.calls

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = provider(kind, **options)
            for b in batches:
                for i in range(0, b.num_rows, BATCH):
                    part = b.slice(i, BATCH)
                    vectors = own.embed(part.column(1).to_pylist())
                    calls.add(part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], names=["content_hash", "vector"])

        made = stored(new.select("content_hash", "text").mapInArrow(run, "content_hash string, vector array<double>"), "embedded")
        if not made.isEmpty():
            with self.store.change() as c:
                c.append("vectors", made.withColumn("provider", F.lit(self.name)))
        vectors = self.store.read("vectors", {"provider": self.name}, keys=hashed.select("content_hash").distinct())
        return hashed.join(vectors.select("content_hash", "vector"), "content_hash").select(key, "vector")
