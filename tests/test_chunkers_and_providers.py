"""Chunkers as table functions and embedding providers with a store."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.operators import chunkers, chunking, embedding, retrieval

TEXT = "intro words\n\n# One\n" + "alpha beta gamma delta\n" * 9 + "## Two\r\nlong " + "x " * 40 + "\n\n###### Three\nend\x0bof it"


def texts(spark):
    rows = [(1, TEXT), (2, "# A\n## B"), (3, ""), (4, None), (5, "# only\n\n"), (None, "no id"), (6, "a b"), (7, " lead\n  # Head  \n" + "y " * 100)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def table(frame):
    return sorted((r.doc_id or 0, r.ordinal, r.section, r.chunk, r.chunk_id) for r in frame.collect())


def test_chunkers_by_name_equal_the_operators(spark):
    docs = texts(spark)
    want = [r for r in table(chunking.hierarchical(docs, size=12, overlap=3)) if r[0]]
    assert [r for r in table(chunkers.chunked(docs, "hierarchical", size=12, overlap=3)) if r[0]] == want
    assert [r for r in table(chunkers.packed_lines(chunkers.lines(docs), size=12, overlap=3)) if r[0]] == want
    slid = chunking.sliding(docs, size=7, overlap=2)
    got = chunkers.chunked(docs, "sliding", text=chunkers.spaced(), size=7, overlap=2)
    assert sorted((r.doc_id or 0, r.ordinal, r.chunk) for r in got.collect()) == sorted((r.doc_id or 0, r.ordinal, r.chunk) for r in slid.collect())
    with pytest.raises(ValueError, match="no chunker"):
        chunkers.chunked(docs, "other")


class Halves:
    def eval(self, text, size, overlap):
        if text:
            yield "first", text[: len(text) // 2]
            yield "second", text[len(text) // 2 :]


def test_a_chunker_of_ones_own(spark):
    chunkers.register(spark, "halves", Halves)
    docs = spark.createDataFrame([(1, "abcd"), (2, None)], "doc_id bigint, text string")
    assert [(r.doc_id, r.ordinal, r.chunk) for r in chunkers.chunked(docs, "halves").orderBy("ordinal").collect()] == [(1, 0, "ab"), (1, 1, "cd")]
    docs.createOrReplaceTempView("docs_to_halve")
    found = spark.sql("SELECT doc_id, c.chunk FROM docs_to_halve, LATERAL chunk_halves(text, 10, 0) AS c")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "ab"), (1, "cd")]


class Lengths:
    def __init__(self, factor: float = 1.0) -> None:
        self.factor, self.dims, self.name = factor, 2, f"lengths-{factor}"

    def embed(self, given):
        return np.array([[len(t) * self.factor, 1.0] for t in given]).reshape(-1, 2)


def test_contents_are_embedded_once(spark, tmp_path, monkeypatch):
    store = embedding.EmbeddingStore(spark, f"file://{tmp_path}/e", "hash", dims=16)
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(60)] + [(60, None), (61, "")], "doc_id bigint, text string")
    first = {r.doc_id: r.vector for r in store.embed(docs, "doc_id", "text").collect()}
    assert store.calls.value == 31 and len(first) == 62
    again = {r.doc_id: r.vector for r in store.embed(docs, "doc_id", "text").collect()}
    assert store.calls.value == 31 and again == first
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 5, "another").otherwise(F.col("text")))
    assert store.embed(changed, "doc_id", "text").count() == 62 and store.calls.value == 32
    want: dict = {}
    for r in retrieval.hash_embedding(docs, "doc_id", dims=16).collect():
        want.setdefault(r.doc_id, [0.0] * 16)[r.slot] = r.value
    assert all(np.allclose(first[k], v) for k, v in want.items())
    monkeypatch.setitem(embedding.PROVIDERS, "lengths", Lengths)
    other = embedding.EmbeddingStore(spark, f"file://{tmp_path}/e", "hash", dims=8)
    assert len(other.embed(docs, "doc_id", "text").first().vector) == 8  # of its own, at the same place
    assert embedding.provider("lengths", factor=2.0).embed(["abc"]).tolist() == [[6.0, 1.0]]
    with pytest.raises(ValueError, match="no embedding provider"):
        embedding.provider("none")
    assert store.embed(docs.limit(0), "doc_id", "text").count() == 0
