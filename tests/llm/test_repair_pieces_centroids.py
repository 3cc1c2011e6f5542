"""Conversation repair, SentencePiece and centroids: against brute force, the library, and over odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from heronlake.llm import centroids, dialogue, pieces, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_centroids"])
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def all_repairs(letters: str, most: int):
    """Every way of editing rows, with up to ``most`` inserted turns: (cost, audit) of those that the grammar accepts."""
    choices = [["D"] if x == "x" else ["D", "K", "Ru", "Ra"] for x in letters]
    for edits in itertools.product(*choices):
        for k in range(most + 1):
            for where in itertools.combinations_with_replacement(range(len(letters) + 1), k):
                for kinds in itertools.product("ua", repeat=k):
                    audit = roles = ""
                    cost = 0
                    for i in range(len(letters) + 1):
                        for w, kind in zip(where, kinds, strict=True):
                            if w == i:
                                audit, roles, cost = audit + "I", roles + kind, cost + 5
                        if i < len(letters):
                            e, x = edits[i], letters[i]
                            audit += e[0]
                            roles += "" if e == "D" else x.lower() if e == "K" else e[1]
                            cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if x.isupper() and e != "D" else 0)
                    if re.fullmatch("(s?(ua)+)?", roles):
                        yield cost, audit


def test_cheapest_edits_equal_all_ways():
    r = random.Random(5)
    for _ in range(60):
        letters = "".join(r.choice("suaoSUAOx") for _ in range(r.randint(0, 4)))
        ((_, cost, audit),) = dialogue.cheapest(letters, dialogue.START, True)
        assert (cost, audit) == min(all_repairs(letters, 2)), letters


def decided(letters: str, monkeypatch, block: int):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    repair, out, held = dialogue.Repair(), [], 0
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for i, x in enumerate(letters):
        out += repair.add(x, role[x.lower()], str(i))
        held = max(held, len(repair.rows))
    out += repair.end()
    return repair.cost, "".join(x[0] for x in out), [x for x in out if x[0] != "D"], held


def test_blocks_give_what_one_search_gives(monkeypatch):
    r = random.Random(6)
    for n in (0, 1, 7, 40, 90):
        for weights in ("suaoSUAOx", "uauauauax", "xxxxxxxxs", "sssu", "a", "u"):
            letters = "".join(r.choice(weights) for _ in range(n))
            ((_, cost, audit),) = dialogue.cheapest(letters, dialogue.START, True)
            for block in (1, 3, 8):
                got = decided(letters, monkeypatch, block)
                assert got[:2] == (cost, audit), (letters, block)
                assert re.fullmatch("(s?(ua)+)?", "".join(x[1][0] for x in got[2]))
    *_, held = decided("suauxaUaou" * 300, monkeypatch, 16)
    assert held < 100  # of 3,000 rows


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, conv string, gone boolean, fault int"


def test_conversations_with_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi.", "x", False, 1), (1, 1, "assistant", "Yes?", "x", False, 1), (1, 5, "assistant", " \t\n", "x", False, 1),
        (2, None, "tool", "no end", "x", False, 1), (2, 3, "user", "Hi.", "x", False, 1), (2, 3, "user", "Hi.", "x", False, 1),
        (3, 0, None, None, "x", False, 1), (None, 7, "user", "A.", "x", False, 1), (None, 7, "assistant", "B!\r\n", "x", False, 1),
        (4, 1, "user", "gone", "x", True, 1), (5, -(2**63), "user", "x" * 100_000 + ".", "x", False, 1), (5, 2**63 - 1, "assistant", "Y.", "x", None, 1),
    ]
    table = spark.createDataFrame(rows, CONVERSATIONS)
    got = {r.conv_id: r for r in dialogue.reports(table, gone=F.col("gone")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert tuple(got[1])[1:] == (3, 1, 0, 0, 1, 2, "KKD", sha("user:Hi.\nassistant:Yes?"))
    # the rows of null and 3 tie or come by turn: tool, user, user again
    assert tuple(got[2])[1:] == (0, 0, 1, 1, 2, 6, "DDD", sha(""))
    assert tuple(got[3])[1:] == (0, 1, 0, 0, 0, 2, "D", sha(""))
    assert tuple(got[4])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert tuple(got[5])[1:] == (2**63 - 1, 0, 0, 0, 0, 0, "KK", sha("user:" + "x" * 100_000 + ".\nassistant:Y."))
    # a tie of turns goes by role: the assistant comes first
    assert got[None].illegal == 0 and got[None].gaps == 0 and got[None].cost == 2 and got[None].audit == "RR"
    edits = dialogue.repaired(table, gone=F.col("gone")).orderBy("conv_id", "place").collect()
    assert [(r.edit, r.turn, r.fault, r.role) for r in edits if r.conv_id == 1] == [("K", 0, "none", "user"), ("K", 1, "none", "assistant"), ("D", 5, "blank", None)]
    for conv in (1, 5, None):
        text = "\n".join(f"{r.role}:{r.text}" for r in edits if r.conv_id == conv and r.role is not None)
        assert sha(text) == got[conv].repaired_sha256
    empty = table.limit(0)
    assert dialogue.reports(empty).count() == dialogue.repaired(empty).count() == 0
    assert dialogue.reports(dialogue.damaged(empty.select("conv_id", "turn", "role", "text")), gone=F.col("gone")).count() == 0


def test_long_conversations_over_blocks(spark):
    r = random.Random(8)
    rows = [(i % 2, i // 2, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", f"{i}."]), "x", False, 0) for i in range(5000)]
    got = {x.conv_id: x for x in dialogue.reports(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    for c in (0, 1):
        seen, letters = set(), ""
        for _, _, role, text, *_ in sorted((x for x in rows if x[0] == c), key=lambda x: x[1]):
            fault = "blank" if not text else "duplicate" if (role, text) in seen else "none" if text[-1] == "." else "truncated"
            seen.add((role, text))
            letters += dialogue.letter(role, fault)
        ((_, cost, audit),) = dialogue.cheapest(letters, dialogue.START, True)
        assert (got[c].cost, got[c].audit) == (cost, audit)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.load(queries.piece_model()))


def check(library, own, texts):
    for t, got in zip(texts, own.encode_many(texts), strict=True):
        want = library.encode(t or "", add_eos=True)
        assert got.tolist() == want and own.decode(got) == library.decode(want), t[:50]


def test_pieces_know_all_code_points(library, own):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    check(library, own, ["".join(points[i : i + 700]) for i in range(0, len(points), 700)])
    check(library, own, [f"a{c}b {c}{c}" for c in points[:0x3000]])


def test_pieces_of_odd_texts(library, own, monkeypatch):
    r = random.Random(2)
    texts = [None, "", " ", "  ", "▁", " ▁ a▁", "</s><0x41>\x00", "a " * 40 + "  b", "é😀\n\n\t x"]
    texts += ["".join(r.choice("aeinrst ▁\n.x") for _ in range(r.randint(0, 200))) for _ in range(500)]
    texts += ["".join(r.choice(list(own.ids)) for _ in range(r.randint(0, 40))) for _ in range(500)]
    texts += [" " * k + "x" * j for k in range(40) for j in (0, 1, 5)]
    check(library, own, [t or "" for t in texts])
    assert own.encode(None).tolist() == [2] and own.decode([2]) == ""
    monkeypatch.setattr(pieces, "WINDOW", 8)
    check(library, own, ["ab" * 300 + "indivisibilities" * 20, "a" * 999, " " * 333])
    for ids in ([0, 5, 6], [198, 100], [259, 198, 29871], [2, 259, 300], [35, 259], [230, 131, 140, 235]):
        assert own.decode(ids) == library.decode(ids)


def test_a_long_text_and_failed_places(library, own):
    r = random.Random(3)
    word = "".join(r.choice("thearondis") for _ in range(150_000))
    check(library, own, [word, f"{word} {word[:1000]}"])


def test_pieces_of_a_table(spark, library):
    rows = [(None, "a null id", 1), (1, None, 2), (2, "", 3), (3, "word", 4), (3, "word", 4), (4, "x" * 5000 + " é", 5)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.token_ids, r.decoded, r.n_tokens) for r in pieces.encode(table, queries.piece_model()).collect()))
    want = [(i or 0, ids := library.encode(t or "", add_eos=True), library.decode(ids), len(ids)) for i, t, _ in rows]
    assert got == sorted(want)
    assert pieces.encode(table.limit(0), queries.piece_model()).count() == 0


def lloyd(vectors, k, rounds, dims):
    """Plain rounds in Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in ordered[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centers)]
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in kept), centers


@pytest.mark.parametrize(("spread", "copies"), [(1.0, 1), (0.02, 3), (0.0, 2)])
def test_centroids_equal_plain_rounds(spark, spread, copies):
    r = random.Random(4)
    rows = [(i // copies, [float(np.float32(r.choice((-1, 0, 2)) * 0.3 + r.uniform(-spread, spread))) for _ in range(6)]) for i in range(300)]
    rows += [(900, None), (901, [0.0] * 5), (902, [0.0] * 5 + [None]), (903, [0.0] * 5 + [float("nan")]), (904, [float("inf")] * 6), (None, [0.5] * 6), (905, [0.0] * 6)]
    table = spark.createDataFrame([(*x, 1, "y") for x in rows], "vec_id bigint, embedding array<float>, cluster int, n string").repartition(5)
    found, centers = centroids.cluster(table, k=7, rounds=3, dims=6)
    want, plain = lloyd(rows, 7, 3, 6)
    assert sorted((-1 if x.vec_id is None else x.vec_id, x.cluster, x.distance) for x in found.collect()) == want
    assert centers.tolist() == plain
    told = centroids.described(found, centers).collect()
    assert len(told) == len(want) and told[0].inertia == sum(d for _, _, d in want)
    for x in told:
        assert x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, plain[x.cluster])).encode()).hexdigest()


def test_few_and_no_vectors_and_huge_components(spark):
    schema = "vec_id bigint, embedding array<float>"
    none, centers = centroids.cluster(spark.createDataFrame([], schema), dims=2)
    assert none.count() == 0 and len(centers) == 0 and centroids.described(none, centers).count() == 0
    found, centers = centroids.cluster(spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.1])], schema), dims=2)
    rows = {r.vec_id: r for r in found.collect()}
    assert rows[1].vector == [centroids.BOUND, -centroids.BOUND] and rows[2].vector == [0, 6] and len(centers) == 2 and rows[1].distance == 0


def test_the_scan_stops_and_loses_nothing():
    r = np.random.default_rng(1)
    x, c = r.integers(-30, 30, (500, 8)), r.integers(-30, 30, (20, 8))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    for previous in (np.zeros(500, np.int64), d.argmin(1), r.integers(0, 20, 500)):
        nearest, least = centroids.assign(x, previous, c)
        assert (nearest == d.argmin(1)).all() and (least == d.min(1)).all()
