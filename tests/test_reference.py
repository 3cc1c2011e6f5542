"""The engine's own operators: golden cases by hand, and every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import io
import random
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from heronlake import plans
from heronlake.functions import text as X
from heronlake.functions import web
from heronlake.functions.html import Page
from heronlake.functions.vectors import cosine, normalised
from heronlake.operators import activity, chunking, crawl, merge, retrieval
from heronlake.sources import files

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def comparable(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.map(lambda v: round(v, 5) if isinstance(v, float) else v).astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE | plans.CASES_SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = comparable((plans.QUERIES | plans.CASES)[name](spark, FOLDER).toPandas())
    want = comparable(duck.sql((plans.ORACLE | plans.CASES_SQL)[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_streams_carry_on_where_they_stopped(spark, tmp_path):
    from heronlake.streaming import flows

    source = tmp_path / "documents.parquet"
    rows = lambda ids: spark.createDataFrame([(i, f"text {i % 3}") for i in ids], "doc_id bigint, text string").coalesce(1)
    rows(range(5)).write.parquet(str(source))
    kept = str(tmp_path / "kept")
    assert flows.ingest(spark, str(tmp_path), kept=kept).count() == 5
    hashes = flows.content_hashes(spark, str(tmp_path), kept=kept + "2").count()
    rows(range(5, 9)).write.mode("append").parquet(str(source))
    assert sorted(r.doc_id for r in flows.ingest(spark, str(tmp_path), kept=kept).collect()) == list(range(9))
    assert hashes == flows.content_hashes(spark, str(tmp_path), kept=kept + "2").count() == 3


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_packing_carries_words_over():
    assert list(chunking.pack("a b c\nd e f", 4, 1)) == ["a b c", "c d e f"]
    assert list(chunking.pack("a b\nc d e f g h", 4, 1)) == ["a b", "c d e f", "f g h"]
    assert list(chunking.pack("a b c d\ne f g", 4, 3)) == ["a b c d", "b c d e", "c d e f", "d e f g"]
    assert list(chunking.pack("", 4, 1)) == []


def test_sections_follow_headings():
    assert chunking.sections("x\n# A\ny\n## B\n") == [("General", "x"), ("A", "y")]
    assert chunking.sections("# only") == [("General", "# only")]
    assert chunking.sections("   # three spaces\nz") == [("three spaces", "z")]
    assert chunking.sections("####### seven\nz") == [("General", "####### seven\nz")]


def test_sections_and_windows_of_documents(spark):
    docs = spark.createDataFrame([(1, "# R\n" + "refund " * 5), (2, None), (3, "")], "doc_id bigint, text string")
    rows = chunking.hierarchical(docs, size=4, overlap=1).collect()
    assert [(r.doc_id, r.ordinal, r.section, r.chunk) for r in rows] == [(1, 0, "R", "refund " * 3 + "refund"), (1, 1, "R", "refund refund")]


def test_sliding_windows_end_with_the_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, "a")], "doc_id bigint, text string")
    rows = sorted((r.doc_id, r.ordinal, r.chunk) for r in chunking.sliding(docs, size=3, overlap=1).collect())
    assert rows == [(1, 0, "a b c"), (1, 1, "c d e"), (3, 0, "a")]


def test_bm25_counts_repeated_terms_and_ignores_other_scripts(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple"), (3, "plum")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "apple apple"), (2, "apple"), (3, "яблоко"), (4, "")], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id): r.sparse for r in retrieval.ranked_list(queries, docs, "item_id", "doc_id", "sparse").collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert abs(got[1, 1] - 2 * got[2, 1]) < 1e-8 and got[1, 2] > got[1, 1]


def test_fusion_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(300)]
    asked = [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(9)] + [(200, "?"), (201, None)]
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    q = spark.createDataFrame(asked, "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    got = {}
    for r in retrieval.top_k(retrieval.fused(q, d, "item_id", "doc_id", k=5), "item_id", "score", "doc_id", 5).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    block = retrieval.asked(asked, d, "text")
    dense, sparse = block.scores(retrieval.Tokens(block.vocabulary), [t for _, t in docs])
    for n, (item, _) in enumerate(asked):
        score = dict.fromkeys(range(300), 0.0)
        for weight, own in ((0.55, dense[:, n]), (0.45, sparse[:, n])):
            for rank, i in enumerate(sorted(range(300), key=lambda i, own=own: (-own[i], i)), 1):
                score[i] += weight / rank if own[i] > 0 else 0
        best = [i for i in sorted(score, key=lambda i: (-round(score[i], 9), i)) if score[i] > 0][:5]
        assert [(k, i, round(score[i], 9)) for k, i in enumerate(best, 1)] == sorted(got.get(item, [])), item


def test_search_over_sections(spark):
    """Golden cases: a policy with two sections, and two departments."""
    text = "# Refunds\nCustomers may request a refund within 30 days.\n\n# Shipping\nOrders ship within two business days."
    docs = spark.createDataFrame([(1, text, "policy", "support"), (2, "Vacation requests go to HR.", "hr", "hr")], "doc_id bigint, text string, name string, dept string")
    chunks = chunking.hierarchical(docs).join(docs.select("doc_id", "name", "dept"), "doc_id")
    asked = spark.createDataFrame([(1, "How long do customers have to request a refund?"), (2, "...")], "item_id bigint, text string")
    found = retrieval.hybrid_search(asked, chunks)
    top = found.where("rank = 1").join(chunks, "chunk_id").first()
    assert "refund" in top.chunk and top.section == "Refunds"
    support = retrieval.hybrid_search(asked, chunks.where("dept = 'support'")).join(chunks, "chunk_id")
    assert {r.dept for r in support.collect()} == {"support"}
    levels = retrieval.validated(asked, retrieval.validation(found.withColumn("n_words", F.lit(8)), "item_id"), "item_id")
    assert {r.item_id: r.level for r in levels.collect()} == {1: "high", 2: "none"}
    prompt = {r.item_id: r.prompt for r in retrieval.prompts(found.join(chunks, "chunk_id"), asked).collect()}
    assert prompt[1].startswith("Retrieved context:\n[1] policy / Refunds\nCustomers") and "No retrieved context." in prompt[2]
    answer = {r.item_id: r.answer for r in retrieval.extracted(found.join(chunks, "chunk_id"), asked, "item_id").collect()}
    assert answer[1].endswith("[1]") and answer[2] == "No retrieved context."


def test_cosine_is_zero_where_it_is_not_defined(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert rows.select(normalised(F.col("a"))).collect()[3][0] == [0.0]


def test_injection_patterns_each_match(spark):
    from heronlake.plans.corpus import TRIGGERS

    rows = spark.createDataFrame([(t,) for t in (*TRIGGERS, "a new idea", "")], "t string")
    sizes = [r[0] for r in rows.select(F.size(X.injections(F.col("t")))).collect()]
    assert all(n >= 1 for n in sizes[:10]) and sizes[10:] == [0, 0]


def test_guards_and_detectors(spark):
    rows = spark.createDataFrame([("http://172.15.0.1/",), ("http://172.16.0.1/",), ("ftp://a/",), ("https://a.b/login",)], "u string")
    assert [r[0] for r in rows.select(web.fetch_error(F.col("u"))).collect()] == [None, "private", "scheme", None]
    assert [r[0] for r in rows.select(web.detectors(F.lit("x"), F.col("u"))["login"]).collect()] == [False, False, False, True]


def test_admission_forgets_rejected_requests(spark):
    rows = spark.createDataFrame([(1, i, f"2024-01-01 00:00:{i:02d}") for i in range(10)], "k int, id int, ts string")
    got = activity.admitted(rows, "k", "ts", "id", 2, 4).orderBy("id").collect()
    assert [r.admitted for r in got] == [True, True, False, False, True, True, False, False, True, True]


def test_last_write_wins_and_delete(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "k int, v string, o int")
    assert sorted((r.k, r.v) for r in merge.last_write(rows, ["k"], ["o"]).collect()) == [(1, "b"), (2, None)]
    assert merge.delete(rows, rows.where("k = 1"), ["k"]).count() == 1


def test_pages_as_trees():
    p = Page(
        "<html><head><title>T</title><meta name=Description content=d><link rel=canonical href=/c><link rel=alternate hreflang=fr href=https://x.org/fr/></head>"
        "<body><form>f</form><article>" + "<p>" + "long text " * 15 + "<p>second <img src=i.png alt=pic><ul><li>one<li>two</ul></article><a href=' /d.PDF '>doc</a><a href='mailto:x'>m</a>"
        "<svg id=g></svg><video src=v><source src=w></video><audio><source src=a></audio></body>", "https://x.org/p/q",
    )
    assert (p.title, p.meta, p.canonical, p.variants) == ("T", {"description": "d"}, "/c", ["https://x.org/fr/"])
    assert p.anchors == [{"url": "https://x.org/d.PDF", "text": "doc", "domain": "x.org", "is_pdf": True}]
    assert p.assets == {"images": ["https://x.org/p/i.png"], "svgs": ["g"], "videos": ["https://x.org/p/v", "https://x.org/p/w"], "audio": ["https://x.org/p/a"], "documents": ["https://x.org/d.PDF"]}
    assert p.readable.startswith("long text") and "second" in p.readable and "doc" not in p.readable and "f" not in p.readable.split()
    marked, plain = p.markdown
    assert "![pic](https://x.org/p/i.png)" in marked and "- one\n- two" in marked and "\none\ntwo\n" in plain
    assert Page("").text == "" and Page("<p>a</b></i><p>b").text == "a\nb" and Page("<a href='http://[x'>y</a>").anchors[0]["domain"] == ""


def test_readers_of_sheets_slides_pdfs_and_folders(spark, tmp_path):
    def packed(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    book = packed({
        "xl/workbook.xml": "<w xmlns:r='r'><sheet name='A' r:id='r2'/><sheet name='B' r:id='r1'/></w>",
        "xl/_rels/workbook.xml.rels": "<R><Relationship Id='r1' Target='worksheets/sheet1.xml'/><Relationship Id='r2' Target='/xl/worksheets/sheet2.xml'/></R>",
        "xl/worksheets/sheet1.xml": "<w><row><c r='A1'><v>1</v></c></row></w>",
        "xl/worksheets/sheet2.xml": "<w><row><c r='B1'><v>x</v></c><c r='AA1'><v>y</v></c></row><row/></w>",
    })
    first, second = files.sheets(book)
    assert first[0] == "A" and first[1][0][1] == "x" and first[1][0][26] == "y" and len(first[1][0]) == 27 and second == ("B", [["1"]])
    assert files.workbook(book)[1] == ("B", 0, "1") and files.xlsx(book).startswith("=== Sheet: A ===\n\tx\t")
    deck = packed({"ppt/slides/slide1.xml": "<s xmlns:a='a'><a:p><a:t>t</a:t></a:p><a:tbl><a:tr><a:tc><a:p><a:t>1</a:t></a:p></a:tc><a:tc><a:p><a:t>2</a:t></a:p></a:tc></a:tr></a:tbl></s>"})
    assert files.pptx(deck) == "=== Slide 1 ===\nt\n1\t2"
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(there\\)) Tj T* [(sec) -20 (ond)] TJ ET")
    page = b"%PDF-1.4\n1 0 obj <</Length 9 /Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj\n2 0 obj <<>> stream\nBT (two) Tj ET\nendstream endobj"
    assert files.pdf_pages(page) == ["Hello (there)\nsecond", "two"] and files.pdf(b"%PDF", lambda b: "seen") == "seen"
    assert files.pdf(page, lambda b: 1 / 0) == "Hello (there)\nsecond\ntwo"
    (tmp_path / "a.pdf").write_bytes(page)
    (tmp_path / "b.ppt").write_bytes(b"x")
    (tmp_path / "c.json").write_bytes(b"{}")
    rows = files.pages(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [(r.page_number, r.word_count, r.confidence) for r in rows] == [(1, 3, 1.0), (2, 1, 1.0)]
    found = {r["name"]: r for r in files.documents(spark, str(tmp_path), metadata={"document_type": "own"}).collect()}
    assert set(found) == {"a.pdf", "b.ppt"} and found["b.ppt"].error and found["a.pdf"].metadata["document_type"] == "own" and found["a.pdf"].metadata["document_name"] == "a.pdf"
    assert [r["name"] for r in files.listed(spark, str(tmp_path), files.SCANS).collect()] == ["a.pdf"]
    item = '[[null,"ID1"],"n.pdf","application/pdf"]'
    page = f"AF_initDataCallback({{key: 'k', data:[[{item},{item}]], sideChannel: {{}}}});AF_initDataCallback({{data:broken, sideChannel: 1}});"
    assert files.folder_items(page) == [("ID1", "n.pdf", "application/pdf")] and files.folder_items("") == []


def test_crawl_limits_and_cycles(spark):
    links = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 4, 1), (3, 4, 0), (4, 5, 0)], "page int, target int, n int")
    start = spark.createDataFrame([(1,)], "page int")
    got = [(r.page, r.parent, r.depth) for r in crawl.crawl(links, start, 10, 2).orderBy("place").collect()]
    assert got == [(1, None, 0), (2, 1, 1), (3, 1, 1), (4, 2, 2)]
    assert [r.page for r in crawl.crawl(links, start, 3, 9).orderBy("place").collect()] == [1, 2, 3]
    assert crawl.full_site(10, 2) == (200, 10, 120) and crawl.full_site(900, 50) == (500, 20, 120)


def test_pages_without_scripts():
    p = Page("<html><head><title>T</title><script>x</script></head><body><nav>n</nav><p>a <b>b</b></p><a href='/l'>l</a><img src=i>")
    assert (p.title, p.text, p.links, p.images) == ("T", "a b", ["/l"], ["i"])  # a link outside of blocks is no text


def test_documents_from_files(spark, tmp_path):
    def packed(**parts: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name.replace("__", "/") + ".xml", body)
        return out.getvalue()

    (tmp_path / "a.txt").write_bytes(b"caf\xe9")
    (tmp_path / "b.csv").write_text("a, b\n\n c,d\n")
    (tmp_path / "c.html").write_text("<p>x</p><script>y</script>")
    (tmp_path / "d.docx").write_bytes(packed(word__document="<w:d xmlns:w='w'><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p/></w:d>"))
    (tmp_path / "e.pptx").write_bytes(packed(ppt__slides__slide1="<a:d xmlns:a='a'><a:p><a:t>hi</a:t></a:p></a:d>"))
    (tmp_path / "f.xlsx").write_bytes(
        packed(xl__workbook="<w><sheet name='S'/></w>", xl__worksheets__sheet1="<w><row><c><v>1</v></c><c t='inlineStr'><is><t>z</t></is></c></row></w>")
    )
    (tmp_path / "g.docx").write_bytes(b"broken")
    (tmp_path / "h.exe").write_bytes(b"")
    got = {r["name"]: (r["text"], r["error"]) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("caf�", None) and got["b.csv"][0] == "a\tb\nc\td" and got["c.html"][0] == "x\ny"
    assert got["d.docx"][0] == "one two" and got["e.pptx"][0] == "=== Slide 1 ===\nhi" and got["f.xlsx"][0] == "=== Sheet: S ===\n1\tz"
    assert got["g.docx"][0] == "" and got["g.docx"][1].startswith("BadZipFile") and "h.exe" not in got
