"""Streams with state: the decisions of the folds over several triggers and a restart, states that expire, bounded dedupe."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from heronlake.operators import activity as A
from heronlake.streaming import dedupe, flows, state

SCHEMA = "id bigint, k string, s bigint, kind string"


def events(spark, seed=1, n=240):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b", "c", None]), int(s), r.choice(["set", "get", "fail", "ok"])) for i, s in enumerate(sorted(r.uniform(0, 5000) for _ in range(n)))]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))


def write(frame, folder, name):
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of a folder to which a test adds files, a trigger each."""
    table = events(spark)
    folder = f"file://{tmp_path}/in"

    def add(i, n=3):
        write(table.where((F.col("id") >= 240 * i // n) & (F.col("id") < 240 * (i + 1) // n)), folder, f"part={i}")

    add(0)
    stream = lambda: spark.readStream.schema(table.schema).option("basePath", folder).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    return table, add, stream, f"file://{tmp_path}/kept"


def test_admission_carries_on_after_a_restart(spark, arriving):
    table, add, stream, kept = arriving
    want = {(r.k, r.id): r.admitted for r in A.admitted(table, "k", "ts", "id", 3, 300).collect()}
    for i in range(3):
        got = {(r.k, r.id): r.admitted for r in state.kept(state.admitted(stream(), "k", "ts", "id", 3, 300), "admitted", kept).collect()}
        assert got == {x: y for x, y in want.items() if x[1] < 80 * (i + 1)}
        if i < 2:
            add(i + 1)
    assert not all(want.values())


def test_caches_equal_the_window(spark, arriving):
    table, add, stream, kept = arriving
    add(1)
    add(2)
    rows = table.where("kind IN ('set', 'get')")
    sets, gets = (rows.where(F.col("kind") == x).select("k", "ts", "id") for x in ("set", "get"))
    want = {r.id: r.cached for r in A.valid_at(sets, gets, "k", "ts", "id", 120).collect()}
    live = stream().where("kind IN ('set', 'get')")
    live = live.withColumn("get", F.col("kind") == "get")
    got = state.kept(state.cached(live, "k", "ts", "id", "get", "id", 120), "cache", kept)
    found = {r.id: None if r.cached is None else int(r.cached) for r in got.collect()}
    assert found.keys() == want.keys() and any(x is None for x in want.values()) and any(x is not None for x in want.values())
    named = {i: k for i, k, *_ in (tuple(r) for r in table.collect())}
    assert {i: x for i, x in found.items() if named[i] is not None} == {i: x for i, x in want.items() if named[i] is not None}


def test_backoff_carries_on_and_forgets(spark, arriving):
    table, add, stream, kept = arriving
    add(1)
    add(2)
    live = stream().withColumns({"ok": F.col("kind") == "ok", "after": F.when(F.col("kind") == "set", "90").otherwise("soon")})
    got = {r.id: (r.backoff_s, r.most_s, r.wait_s) for r in state.kept(state.backoff(live, "k", "ts", "id", "ok", "after"), "backoff", kept).collect()}
    failures: dict = {}
    for i, k, _, kind, _ in (tuple(r) for r in table.orderBy("id").collect()):
        failures[k] = 0 if kind == "ok" else failures.get(k, 0) + 1
        if kind != "ok":
            wait = min(60.0, 2.0 ** failures[k])
            assert got[i] == (wait, round(1.1 * wait, 6), max(wait, 90.0 if kind == "set" else 0.0)), i


def test_state_expires(spark, tmp_path):
    folder, kept = f"file://{tmp_path}/in", f"file://{tmp_path}/kept"
    base = spark.createDataFrame([(1, "a", 10, "fail"), (2, "a", 11, "fail")], SCHEMA)
    later = [spark.createDataFrame([(i, "z", i * 100_000, "ok")], SCHEMA) for i in (3, 4, 5)]
    last = spark.createDataFrame([(9, "a", 600_000, "fail")], SCHEMA)
    run = lambda: state.kept(
        state.backoff(
            spark.readStream.schema(base.schema).option("basePath", folder).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*").withColumns({"ts": F.timestamp_seconds("s"), "ok": F.col("kind") == "ok", "after": F.lit("")}),
            "k", "ts", "id", "ok", "after", forget=60, late="1 minute",
        ), "backoff", kept,
    )
    for n, frame in enumerate([base, *later, last]):
        write(frame, folder, f"part={n}")
        found = {r.id: r.backoff_s for r in run().collect()}
    assert found == {1: 2.0, 2: 4.0, 9: 2.0}  # idle for long, it starts again


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def test_dedupe_reads_no_history_without_a_hit(spark, tmp_path):
    seen = dedupe.Seen(spark, f"file://{tmp_path}/seen", 1)
    frame = lambda xs: spark.createDataFrame([(None if x is None else sha(x),) for x in xs], "content_hash string")
    for n in range(4):
        seen.add(frame([*range(500 * n, 500 * n + 500), None, 500 * n]), n)
    told = {r.number: r for r in seen.triggers().collect()}
    assert [told[n].read_bytes for n in range(4)] == [0, 0, 0, 0] and all(told[n].new == 500 for n in range(4))
    seen.add(frame([*range(2000, 2100), 7]), 4)
    seen.add(frame([*range(2000, 2100), 7]), 4)  # again after a failure
    last = {r.number: r for r in seen.triggers().collect()}[4]
    total = sum(r.bytes for r in seen.store.snapshot().files("hashes").collect())
    assert last.new == 100 and last.looked_up == 1 and 0 < last.read_bytes < total / 8
    got = [r.content_hash for r in seen.hashes().collect()]
    assert len(got) == 2100 and set(got) == {sha(x) for x in range(2100)}


def test_filters_never_miss_and_full_ones_still_are_right(spark, tmp_path, monkeypatch):
    assert dedupe.places([sha(i) for i in range(50)]).shape == (50, dedupe.PROBES) and dedupe.places([]).shape == (0, dedupe.PROBES)
    monkeypatch.setattr(dedupe, "BITS", 64)
    import pandas as pd

    bits = dedupe._meet(("a",), pd.DataFrame({"content_hash": [sha(i) for i in range(100)]}), pd.DataFrame({"bits": [], "n": []}))
    again = dedupe._meet(("a",), pd.DataFrame({"content_hash": [sha(i) for i in range(200)]}), bits.iloc[-1:][["bits", "n"]].reset_index(drop=True))
    assert again["maybe"][:100].all()


def test_stream_of_documents(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id bigint, text string")
    rows.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = flows.content_hashes(spark, f"file://{tmp_path}", kept=f"file://{tmp_path}/kept")
    assert sorted(r[0] for r in got.collect()) == sorted(sha(f"text {i}") for i in range(5))
