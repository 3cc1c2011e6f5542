"""A crawl frontier that lasts: a stored table of addresses with priority, depth, parent and state.

A wave takes the first queued addresses, looks their pages up, leaves out those whose content came before, and adds the
links of the others, all in one change of the store. So a crawl that is cut off goes on from the wave before, and what is
queued, done or skipped can be asked at any time.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions import web
from heronlake.operators.crawl import expand_sitemaps
from heronlake.sources.scratch import stored
from heronlake.sources.store import Layout, Store

#: Priorities of seeds and of what is found; less comes first.
SEED, FOUND = 0, 10
QUEUED, DONE, COPY, FAILED = "queued", "completed", "duplicate", "failed"
COUNTS = ("taken", "completed", "duplicate", "failed", "found", "known", "too_deep", "refused")

ROW = "url string, priority int, depth int, parent string, state string, content_hash string, wave int"


class Frontier:
    """A frontier below a path. Addresses are normalised by the caller; each is kept once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4) -> None:
        self.spark = spark
        self.store = Store(spark, path, {
            "urls": Layout(ROW, ("url",), ("state",), buckets=buckets),
            "waves": Layout("wave int, " + ", ".join(f"{c} bigint" for c in COUNTS), ("wave",), (), (), 1),
        })

    def urls(self) -> DataFrame:
        return self.store.read("urls")

    def waves(self) -> DataFrame:
        return self.store.read("waves")

    def seed(self, urls: DataFrame, priority: int = SEED) -> None:
        """Queue addresses (url), but for those that are known."""
        rows = urls.select("url").where("url IS NOT NULL").distinct()
        rows = rows.join(self.urls().select("url"), "url", "left_anti")
        with self.store.change() as c:
            c.append("urls", self._queued(rows, priority, F.lit(0), F.lit(None)))

    def seed_site(self, site: str, robots: str | None, maps: DataFrame) -> None:
        """Queue a site's address, and what the sitemaps that its robots.txt names (of ``maps``: url, xml) lead to. A site that
        is a sitemap itself is expanded and not queued."""
        one = self.spark.createDataFrame([(site, robots)], "url string, robots string")
        if "sitemap" in site.lower() or site.endswith((".xml", ".xml.gz")):
            self.seed(expand_sitemaps(maps, one.select("url")))
            return
        named = one.select(F.explode(F.regexp_extract_all(F.coalesce("robots", F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("url"))
        self.seed(expand_sitemaps(maps, named).unionByName(one.select("url")))

    @staticmethod
    def _queued(rows: DataFrame, priority: int, depth: Column, parent: Column) -> DataFrame:
        none = F.lit(None)
        return rows.select("url", F.lit(priority).alias("priority"), depth.cast("int").alias("depth"), parent.cast("string").alias("parent"), F.lit(QUEUED).alias("state"), none.cast("string").alias("content_hash"), none.cast("int").alias("wave"))

    def wave(self, pages: DataFrame, links: DataFrame, most: int, max_depth: int, refused: Column | None = None) -> int:
        """Take up to ``most`` queued addresses, by priority, depth and address; how many there were.

        ``pages`` (url, content_hash) has the pages, ``links`` (url, target, n) their links in order. A link is left out if
        ``refused`` holds for it (of the column ``target``). Of pages with one content the first is done, the others are
        copies, whose links aren't followed; an address without a page has failed. A link's parent is the first page of the
        wave that has it.
        """
        now = self.store.snapshot()
        number = (now.read("waves").agg(F.max("wave")).first()[0] or 0) + 1
        queued = now.read("urls", {"state": QUEUED}).orderBy("priority", "depth", "url").limit(most)  # the wave's limit
        taken = stored(queued.select("url", "priority", "depth", "parent"), "taken")
        n = taken.count()
        if not n:
            return 0
        met = taken.join(pages.select("url", F.col("content_hash").alias("h")), "url", "left")
        first = F.row_number().over(W.partitionBy("h").orderBy("priority", "depth", "url"))
        done = now.read("urls", {"state": DONE}).select(F.col("content_hash").alias("h"), F.lit(True).alias("old"))
        met = met.withColumn("r", first).join(done, "h", "left")
        state = F.when(F.col("h").isNull(), FAILED).when(F.col("old") | (F.col("r") > 1), COPY).otherwise(DONE)
        met = stored(met.select("url", "priority", "depth", "parent", state.alias("state"), F.col("h").alias("content_hash"), F.lit(number).alias("wave")), "met")
        out = met.where(F.col("state") == DONE).select(F.col("url"), "priority", "depth").join(links, "url")
        barred = F.lit(False) if refused is None else F.coalesce(refused, F.lit(False))
        deep = F.col("depth") >= max_depth
        told = out.agg(F.count_if(deep).alias("too_deep"), F.count_if(~deep & barred).alias("refused"), F.count_if(~deep & ~barred).alias("links")).first()
        found = out.where(~deep & ~barred).groupBy(F.col("target").alias("url")).agg(F.min(F.struct("priority", "depth", F.col("url").alias("parent"), "n")).alias("x"))
        found = stored(found.join(now.read("urls").select("url"), "url", "left_anti"), "found")
        added = found.count()
        states = {r.state: r["count"] for r in met.groupBy("state").count().collect()}
        row = (number, n, states.get(DONE, 0), states.get(COPY, 0), states.get(FAILED, 0), added, told.links - added, told.too_deep, told.refused)
        with self.store.change() as c:
            c.upsert("urls", met)
            c.append("urls", self._queued(found, FOUND, F.col("x.depth") + 1, F.col("x.parent")))
            c.append("waves", self.spark.createDataFrame([row], self.store.tables["waves"].columns))
        return n

    def run(self, pages: DataFrame, links: DataFrame, max_pages: int, max_depth: int, at_once: int = 1 << 20, refused: Column | None = None, seconds: float | None = None) -> None:
        """Waves until nothing is queued, ``max_pages`` were taken (in all runs together) or the time is up."""
        began = time.monotonic()
        while seconds is None or time.monotonic() - began < seconds:
            taken = self.waves().agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]
            if taken >= max_pages or not self.wave(pages, links, min(at_once, max_pages - taken), max_depth, refused):
                return


def bipartite(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, content_hash) and (url, target, n) of stored pages whose links aren't pages themselves: a link is an address of its
    own, which leads to the pages that have it."""
    name, hub = F.concat(F.lit("page:"), F.col("page_id")), F.concat(F.lit("link:"), F.col("link"))
    listed = pages.select("page_id", F.posexplode(web.links(F.col("html"))).alias("n", "link"))
    known = pages.select(name.alias("url"), F.sha2("html", 256).alias("content_hash"))
    known = known.unionByName(listed.select(hub.alias("url")).distinct().withColumn("content_hash", F.sha2("url", 256)))
    out = listed.select(name.alias("url"), hub.alias("target"), "n")
    return known, out.unionByName(listed.select(hub.alias("url"), name.alias("target"), F.col("page_id").cast("int").alias("n")))
