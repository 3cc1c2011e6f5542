"""The stored indexes against plain scans: same rows, fewer postings and files read, new rows without reading old ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.operators import inverted, ivf, retrieval

FOLDER = "/root/testdata/sf0.001"


def rows(frame, key):
    return {(r[0], r["rank"]): (r[key], r[2]) for r in frame.collect()}


def test_indexed_bm25_equals_the_scan(spark, tmp_path):
    docs, asked = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    index = inverted.Index(spark, f"file://{tmp_path}/a", "bigint", shard=24)
    index.add(docs.where("doc_id < 120"), "doc_id", "text")
    before = {r.file for r in index.store.snapshot().files("postings").collect()}
    index.add(docs, "doc_id", "text")  # the old ones are known
    assert before <= {r.file for r in index.store.snapshot().files("postings").collect()}
    assert index.stats().first().n == docs.count()
    read = []
    got = index.search(asked, k=3, read=read)
    plain = retrieval.ranked_list(asked, docs, "item_id", "doc_id", "sparse", "text", k=3).select("item_id", "doc_id", "sparse", "rank")
    assert rows(got, "key") == rows(plain, "doc_id")
    decoded, had, every = read[0]
    assert decoded <= had and decoded < every / 10


def test_rare_terms_spare_postings_of_frequent_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 16)
    r = np.random.default_rng(1)
    texts = [(i, " ".join(["the"] * int(r.integers(1, 9)) + ["of"] * int(r.integers(1, 9)) + (["rare"] * 3 if i % 97 == 5 else []) + [f"w{int(x)}" for x in r.integers(0, 900, 20)])) for i in range(3000)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    index = inverted.Index(spark, f"file://{tmp_path}/b", "bigint", shard=800)
    index.add(table, "doc_id", "text")
    asked = spark.createDataFrame([(1, "the rare of of"), (2, "w7 the"), (3, "nowhere"), (4, None), (None, "the"), (5, "the the of")], "item_id bigint, text string")
    read = []
    got = rows(index.search(asked, k=5, read=read), "key")
    plain = retrieval.ranked_list(asked.where("item_id IS NOT NULL"), table, "item_id", "doc_id", "sparse", "text", k=5).select("item_id", "doc_id", "sparse", "rank")
    assert got == rows(plain, "doc_id") and {q for q, _ in got} == {1, 2, 5}
    one = []
    index.search(asked.where("item_id = 1"), k=5, read=one)
    assert one[0][0] < one[0][1] / 2, one  # of the postings of its terms


def test_ties_odd_chunks_and_an_empty_index(spark, tmp_path):
    index = inverted.Index(spark, f"file://{tmp_path}/c", "string", shard=2)
    asked = spark.createDataFrame([("q", "same words")], "item_id string, text string")
    assert index.search(asked).count() == 0 and index.frequencies().count() == 0 and index.stats().first() == (0, 1.0)
    texts = [(f"k{i}", "same words here", 0) for i in range(9)] + [("empty", "", 0), ("null", None, 0), (None, "same words", 0), ("k1", "again", 0)]
    index.add(spark.createDataFrame(texts[:-1], "doc_id string, text string, no int"), "doc_id", "text")
    index.add(spark.createDataFrame(texts[-1:], "doc_id string, text string, no int"), "doc_id", "text")
    got = [(r.key, r["rank"]) for r in index.search(asked, k=4).orderBy("rank").collect()]
    assert got == [("k0", 1), ("k1", 2), ("k2", 3), ("k3", 4)]
    assert index.stats().first().n == 11
    assert {r.term: r.df for r in index.frequencies().collect()} == {"same": 9, "words": 9, "here": 9}


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(2)
    means = r.normal(size=(30, 16))
    x = np.repeat(means, 100, 0) + 0.25 * r.normal(size=(3000, 16))
    table = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x.astype(np.float32))]
    return x.astype(np.float32).astype(float), spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int").cache()


def brute(x, q, k, keep=None, least=-2.0):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[q], 9)
    on = [i for i in np.lexsort((np.arange(len(s)), -s)) if s[i] >= least and (keep is None or keep(i))]
    return on[:k]


def test_the_vector_index_reads_few_cells(spark, tmp_path, clustered):
    x, table = clustered
    index = ivf.VectorIndex(spark, f"file://{tmp_path}/v", 16, also="label int")
    index.build(table, "vec_id", "embedding", cells=40)
    queries = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    got: dict = {}
    for r in index.search(queries, "qid", "embedding", 10, recall=0.95).collect():
        got.setdefault(r.qid, set()).add(r.key)
    found = sum(len(got[q] & set(brute(x, q, 10))) for q in got)
    assert len(got) == 30 and found >= 0.95 * 300
    assert index.probes(0.95) < 10  # of 40 cells
    snap = index.store.snapshot()
    probed = index._nearest(queries.limit(1), "qid", "embedding", 10, {0: {3, 4}}, queries.limit(1).collect())
    size = {r.file.split("/write=")[1]: r.bytes for r in snap.files("vectors").collect()}
    assert sum(size[f.split("/write=")[1]] for f in probed.inputFiles()) < sum(size.values()) / 8


def test_exact_searches_with_threshold_filter_and_new_vectors(spark, tmp_path, clustered):
    x, table = clustered
    index = ivf.VectorIndex(spark, f"file://{tmp_path}/w", 16, also="label int")
    index.build(table.where("vec_id < 2500"), "vec_id", "embedding", cells=25)
    index.add(table.where("vec_id >= 2400"), "vec_id", "embedding")  # a hundred of them again
    assert index.store.read("vectors").count() == 3000
    queries = table.where("vec_id % 300 = 7").select(F.col("vec_id").alias("qid"), "embedding")
    every: dict = {}
    for r in index.search(queries, "qid", "embedding", 12, recall=0.1, exact=True).orderBy("rank").collect():
        every.setdefault(r.qid, []).append(r.key)
    assert every == {q: brute(x, q, 12) for q in every} and len(every) == 10
    some: dict = {}
    found = index.search(queries, "qid", "embedding", 12, exact=True, threshold=0.9, where=F.col("label") == 1)
    for r in found.orderBy("rank").collect():
        some.setdefault(r.qid, []).append(r.key)
    assert some == {q: y for q in every if (y := brute(x, q, 12, lambda i: i % 3 == 1, 0.9))}


def test_odd_vectors(spark, tmp_path):
    index = ivf.VectorIndex(spark, f"file://{tmp_path}/x", 2)
    schema = "vec_id bigint, embedding array<float>, cell string"
    index.build(spark.createDataFrame([], schema), "vec_id", "embedding")
    nan = float("nan")
    odd = [(1, None, ""), (2, [1.0], ""), (3, [0.0, 0.0], ""), (4, [nan, 1.0], ""), (5, [None, 1.0], ""), (None, [1.0, 0.0], ""), (6, [1.0, 0.0], ""), (7, [2.0, 0.0], ""), (8, [0.0, 1.0], "")]
    table = spark.createDataFrame(odd, schema)
    queries = table.select(F.col("vec_id").alias("q"), "embedding")
    assert index.store.read("vectors").count() == 0
    index.build(table, "vec_id", "embedding")
    got = sorted((r.q, r.key, r.score, r["rank"]) for r in index.search(queries, "q", "embedding", 2, exact=True).collect())
    assert got == [(6, 6, 1.0, 1), (6, 7, 1.0, 2), (7, 6, 1.0, 1), (7, 7, 1.0, 2), (8, 6, 0.0, 2), (8, 8, 1.0, 1)]


def test_scans_of_odd_vectors_and_keys(spark):
    nan = float("nan")
    odd = [("a", None), ("b", [1.0]), ("c", [0.0, 0.0]), ("d", [nan, 1.0]), ("e", [None, 1.0]), (None, [1.0, 0.0]), ("f", [2.0, 0.0])]
    table = spark.createDataFrame(odd, "name string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [5.0])], "q int, v array<double>")
    got = {(r.q, r["rank"]): (r.name, r.score) for r in retrieval.nearest(asked, table, "q", "name", "v", 3).collect()}
    assert [got[1, i] for i in (1, 2, 3)] == [(None, 1.0), ("f", 1.0), ("a", 0.0)] and got[3, 1] == ("b", 1.0) and got[2, 1] == (None, 0.0)
    assert retrieval.nearest(asked.limit(0), table, "q", "name", "v", 3).count() == 0
    chunks = spark.createDataFrame([(None, "same words"), (None, "same words"), ("k", "same words")], "name string, text string")
    items = spark.createDataFrame([(1, "same words")], "item int, text string")
    assert [(r.name, r["rank"]) for r in retrieval.ranked_list(items, chunks, "item", "name", "sparse").collect()] == [("k", 1)]
    assert [r.name for r in retrieval.fused(items, chunks, "item", "name").collect()] == ["k"]
