"""Stored tables: what a change rewrites, what a read opens, changes that are cut off or meet another."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heronlake.sources.store import Conflict, Layout, Store

TABLES = {
    "docs": Layout("doc_id bigint, tenant string, text string, meta map<string,string>", ("doc_id",), ("tenant",), buckets=8),
    "chunks": Layout("chunk_id string, doc_id bigint, tenant string, chunk string", ("chunk_id",), ("tenant",), ("doc_id",), 8),
}


def docs(spark, ids, word="old"):
    return spark.createDataFrame([(i, f"t{i % 3}", f"{word} {i}", {"a": word}) for i in ids], TABLES["docs"].columns)


def chunks(spark, ids, word="old"):
    rows = [(f"{i}-{k}", i, f"t{i % 3}", f"{word} {k}") for i in ids for k in range(3)]
    return spark.createDataFrame(rows, TABLES["chunks"].columns)


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", TABLES)
    with s.change() as c:
        c.append("docs", docs(spark, range(200)))
        c.append("chunks", chunks(spark, range(200)))
    return s


def test_an_upsert_rewrites_the_files_it_touches(spark, store):
    before = {r.file for r in store.snapshot().files("docs").collect()}
    batch = docs(spark, [7, 500, 501], "new")
    with store.change() as c:
        c.upsert("docs", batch)
    after = {r.file for r in store.snapshot().files("docs").collect()}
    assert c.rewritten["docs"] == 1 == len(before - after) and len(after - before) <= 3
    assert texts(store.read("docs")) == {**{i: f"old {i}" for i in range(200)}, 7: "new 7", 500: "new 500", 501: "new 501"}
    # a key that comes again in another partition leaves the old one
    moved = batch.where("doc_id = 7").withColumn("tenant", F.lit("elsewhere"))
    with store.change() as c:
        c.upsert("docs", moved)
    assert [r.tenant for r in store.read("docs", {"doc_id": 7}).collect()] == ["elsewhere"]


def test_reads_open_what_can_match(spark, store):
    snap = store.snapshot()
    every = snap.files("docs").count()
    one = store.read("docs", {"doc_id": 42, "tenant": "t0"})
    assert len(one.inputFiles()) == 1 < every and [r.doc_id for r in one.collect()] == [42]
    assert len(store.read("docs", {"doc_id": 42}).inputFiles()) <= 3
    tenant = store.read("docs", {"tenant": "t1"})
    assert len(tenant.inputFiles()) <= 8 and tenant.count() == 67
    some = store.read("chunks", keys=spark.createDataFrame([(5,), (9,)], "doc_id bigint"))
    assert some.count() == 6 and len(some.inputFiles()) < snap.files("chunks").count() / 2
    assert {r.tenant: r.n for r in snap.counts("docs").collect()} == {"t0": 67, "t1": 67, "t2": 66}
    assert store.read("docs", {"tenant": "none"}).count() == 0


def test_tables_change_together_and_delete(spark, store):
    fresh = docs(spark, [1, 2], "new")
    with store.change() as c:
        c.delete("chunks", fresh, on=["doc_id"])
        c.upsert("docs", fresh)
        c.append("chunks", chunks(spark, [1], "new"))
    now = store.snapshot()
    assert now.version == 2
    held = {r.doc_id: r.n for r in now.read("chunks").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert held[1] == 3 and 2 not in held and held[3] == 3 and len(held) == 199
    assert {r.chunk for r in now.read("chunks").where("doc_id = 1").collect()} == {"new 0", "new 1", "new 2"}
    with store.change() as c:
        c.delete("docs", spark.createDataFrame([(3,), (10**6,)], "doc_id bigint"))
        c.clear("docs", tenant="t2")
    assert texts(store.read("docs")).keys() == {i for i in range(200) if i % 3 != 2 and i != 3}
    assert texts(store.snapshot(1).read("docs")) == {i: f"old {i}" for i in range(200)}  # as it was
    with pytest.raises(ValueError, match="isn't partitioned"):
        store.change().clear("docs", text="x")


def test_a_change_that_is_cut_off_leaves_the_snapshot(spark, store):
    with pytest.raises(RuntimeError, match="cut off"), store.change() as c:
        c.upsert("docs", docs(spark, range(50), "new"))
        c.delete("chunks", docs(spark, range(50)), on=["doc_id"])
        raise RuntimeError("cut off")
    assert store.versions() == [1] and texts(store.read("docs"))[3] == "old 3" and store.read("chunks").count() == 600
    referenced = store.snapshot().files("docs").count() + store.snapshot().files("chunks").count()
    assert store.vacuum() > 0 and store.read("docs").count() == 200
    assert store.vacuum() == 0 and store.snapshot().files("docs").count() + store.snapshot().files("chunks").count() == referenced


def test_of_two_changes_at_once_one_fails(spark, store):
    first, second = store.change(), store.change()
    first.append("docs", docs(spark, [900]))
    second.append("docs", docs(spark, [901]))
    with first:
        pass
    with pytest.raises(Conflict), second:
        pass
    assert store.read("docs").where("doc_id >= 900").count() == 1


def test_many_small_files_become_few(spark, store):
    for i in range(5):
        with store.change() as c:
            c.append("docs", docs(spark, range(1000 + 20 * i, 1020 + 20 * i)))
    rows, many = store.read("docs").count(), store.snapshot().files("docs").count()
    with store.change() as c:
        c.compact("docs", most=2)
    assert store.snapshot().files("docs").count() < many / 2 and store.read("docs").count() == rows


def test_odd_rows(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/odd", TABLES)
    assert s.read("docs").count() == 0 and s.snapshot().version == 0 and s.vacuum() == 0
    columns = TABLES["docs"].columns + ", extra int"
    rows = [(1, None, "a", None, 0), (1, "t", "b", None, 0), (None, "t", "x", None, 0), (None, "t", "x", None, 0), (2, "a/b=c %", "", {}, 0)]
    with s.change() as c:
        c.upsert("docs", spark.createDataFrame(rows, columns))
        c.delete("chunks", spark.createDataFrame([("none",)], "chunk_id string"))
    got = sorted((r.doc_id or 0, r.tenant, r.text) for r in s.read("docs").collect())
    assert got == [(0, "t", "x"), (0, "t", "x"), (1, "t", "b"), (2, "a/b=c %", "")]  # the last of a key by its columns
    with s.change() as c:
        c.upsert("docs", spark.createDataFrame(rows[2:3], columns))
        c.upsert("docs", spark.createDataFrame([], columns))
    assert s.read("docs").count() == 5 and s.read("docs", {"tenant": "a/b=c %"}).count() == 1
    with s.change() as c:
        c.clear("docs")
    assert s.read("docs").count() == 0
    with s.change():
        pass
    assert s.versions() == [1, 2, 3]
