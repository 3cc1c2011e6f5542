"""The stored frontier against a queue in Python, cut off and resumed; profiles and progress against recomputed counts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from heronlake.operators import frontier, profile, retrieval


def site(spark, seed=3, n=60):
    r = random.Random(seed)
    pages = [(f"u{i:02d}", f"h{r.randint(0, 5) if i % 2 == 0 else 1000 + i}") for i in range(n) if i % 9]
    links = [(u, f"u{r.randint(0, n - 1):02d}", k) for u, _ in pages for k in range(r.randint(0, 4))]
    return pages, links, spark.createDataFrame(pages, "url string, content_hash string"), spark.createDataFrame(links, "url string, target string, n int")


def queue(pages, links, seeds, max_depth, refused=()):
    """State by address, wave by wave."""
    hashes, out = dict(pages), {}
    now = {u: (0, 0, None) for u in seeds}
    seen: set = set()
    while now:
        order, added = sorted(now, key=lambda u: (now[u][0], now[u][1], u)), {}
        for u in order:
            p, d, parent = now[u]
            state = "failed" if u not in hashes else "duplicate" if hashes[u] in seen else "completed"
            seen |= {hashes[u]} if state == "completed" else set()
            out[u] = (d, parent, state)
            if state == "completed" and d < max_depth:
                for _, t, k in sorted((x for x in links if x[0] == u), key=lambda x: x[2]):
                    if t not in refused:
                        added.setdefault(t, []).append((p, d, u, k))
        now = {t: (10, min(x)[1] + 1, min(x)[2]) for t, x in added.items() if t not in out and t not in now}
    return out


def told(f):
    return {r.url: (r.depth, r.parent, r.state) for r in f.urls().collect()}


def test_a_crawl_equals_a_queue(spark, tmp_path):
    pages, links, p, e = site(spark)
    seeds = spark.createDataFrame([("u01",), ("u02",), ("u01",), (None,)], "url string")
    f = frontier.Frontier(spark, f"file://{tmp_path}/a", 2)
    f.seed(seeds)
    f.run(p, e, max_pages=1000, max_depth=3, refused=F.col("target") == "u05")
    want = queue(pages, links, ["u01", "u02"], 3, {"u05"})
    assert told(f) == want and {x[2] for x in want.values()} == {"completed", "duplicate", "failed"}
    waves = f.waves().agg(*(F.sum(c).alias(c) for c in frontier.COUNTS)).first()
    assert waves.taken == len(want) and waves.found == len(want) - 2
    assert waves.completed + waves.duplicate + waves.failed == waves.taken


def test_a_crawl_that_is_cut_off_goes_on(spark, tmp_path, monkeypatch):
    pages, links, p, e = site(spark, 4)
    f = frontier.Frontier(spark, f"file://{tmp_path}/b", 2)
    f.seed(spark.createDataFrame([("u01",)], "url string"))
    f.run(p, e, max_pages=3, max_depth=4)
    assert f.waves().agg(F.sum("taken")).first()[0] == 3
    before = told(f)

    def cut(self, *_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(frontier.Frontier, "_queued", staticmethod(cut))
        try:
            f.run(p, e, max_pages=1000, max_depth=4)
        except (RuntimeError, TypeError):
            pass
    again = frontier.Frontier(spark, f"file://{tmp_path}/b", 2)
    assert told(again) == before
    again.run(p, e, max_pages=1000, max_depth=4, at_once=5, seconds=600)
    got = told(again)
    assert not [u for u, x in got.items() if x[2] == "queued"] and set(got) >= set(before)
    again.run(p, e, max_pages=1000, max_depth=4, seconds=0)
    assert told(again) == got


def test_seeds_from_robots_and_sitemaps(spark, tmp_path):
    one = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://s/a</loc></url><url><loc>https://s/b</loc></url></urlset>'
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://s/one.xml</loc></sitemap></sitemapindex>'
    maps = spark.createDataFrame([("https://s/one.xml", one), ("https://s/all.xml", index)], "url string, xml string")
    f = frontier.Frontier(spark, f"file://{tmp_path}/c", 2)
    f.seed_site("https://s/", "User-agent: *\nSitemap: https://s/all.xml\nsitemap:https://s/none.xml", maps)
    assert set(told(f)) == {"https://s/", "https://s/a", "https://s/b"}
    g = frontier.Frontier(spark, f"file://{tmp_path}/d", 2)
    g.seed_site("https://s/all.xml", None, maps)
    g.seed_site("https://t/", None, maps)
    assert set(told(g)) == {"https://s/a", "https://s/b", "https://t/"}


def test_a_search_with_its_profile(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"word{i % 7} common text number {i}") for i in range(40)], "chunk_id string, chunk string")
    asked = spark.createDataFrame([(1, "word3 common"), (2, "number 5"), (3, "")], "item_id int, text string")
    p = profile.Profile(spark)
    got = profile.profiled_search(p, asked, chunks)
    plain = retrieval.hybrid_search(asked, chunks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    steps = {r.step: r for r in p.table().collect()}
    assert [r.step for r in p.table().orderBy("place").collect()] == ["fusion", "candidates", "rerank", "results"]
    fused = retrieval.fused(asked, chunks, "item_id", "chunk_id", "chunk")
    assert steps["fusion"].counts["n"] == fused.count() and steps["fusion"].counts["dense"] == fused.where("dense > 0").count()
    assert steps["results"].counts["n"] == got.count() and all(r.seconds > 0 for r in steps.values())
    assert steps["results"].counts["best"] == got.agg(F.max("final")).first()[0]


def test_progress_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(10 * i + k, None if k == 3 else "x" * k) for k in range(10)], "doc_id int, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id int, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start = lambda s: s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    heard = profile.ingested(stream, 30, start, filled=F.count("text"))
    rows = heard.table(spark).orderBy("batch").collect()
    assert [round(r.progress, 4) for r in rows] == [round(25 + 70 / 3, 4), round(25 + 140 / 3, 4), 95.0, 100.0]
    assert [r.counts.get("filled") for r in rows] == [9.0, 9.0, 9.0, None] and rows[-1].came == 30
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30
