"""Crawling over stored pages: the link graph, breadth-first levels, frontiers and skip reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions import web
from heronlake.sources.scratch import scratch


def edges(pages: DataFrame) -> DataFrame:
    """(page_id, link): each page's distinct link paths."""
    return pages.select("page_id", F.explode(web.links(F.col("html"))).alias("link"))


def levels(graph: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(page_id, depth): breadth-first over pages that share a link, from ``start``, up to ``depth``.

    A level is two joins with the distinct links of the frontier; pages that were seen are left out by an anti join, and
    each level is written, so lineage doesn't grow.
    """
    spark = graph.sparkSession
    seen = frontier = start.select("page_id", F.lit(0).alias("depth"))
    for n in range(1, depth + 1):
        links = frontier.join(graph, "page_id").select("link").distinct()
        found = graph.join(links, "link", "left_semi").select("page_id").distinct()
        found = found.join(seen.select("page_id"), "page_id", "left_anti").withColumn("depth", F.lit(n))
        path = scratch(spark, "level")
        found.write.parquet(path)
        frontier = spark.read.schema(found.schema).parquet(path)
        seen = seen.unionByName(frontier)
    return seen


def crawl(links: DataFrame, start: DataFrame, max_pages: int = 10, max_depth: int = 2) -> DataFrame:
    """(page, parent, depth, place): breadth-first along ``links`` (page, target, n), in the order of a queue.

    ``links`` holds allowed links only; n orders those of a page. The first ``max_pages`` pages are visited, none deeper than
    ``max_depth``; a page's parent is the one that it was first found on. A level is one join, deduplicated by its first
    place, without what was seen, and written, so lineage doesn't grow.
    """
    spark = links.sparkSession
    kind = links.schema["page"].dataType
    order = F.row_number().over(W.orderBy("page"))
    frontier = start.select("page").distinct().select("page", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), order.cast("bigint").alias("place"))
    seen = None
    for depth in range(max_depth + 1):
        if depth:
            found = frontier.select(F.col("page").alias("parent"), F.col("place").alias("_p")).join(links.withColumnRenamed("page", "parent"), "parent")
            found = found.groupBy(F.col("target").alias("page")).agg(F.min(F.struct("_p", "n", "parent")).alias("f"))
            found = found.join(seen.select("page"), "page", "left_anti")
            left = max_pages - seen.count()
            found = found.orderBy("f._p", "f.n", "page").limit(max(left, 0))  # the limit is the crawl's
            place = F.row_number().over(W.orderBy("f._p", "f.n", "page")) + (max_pages - left)
            frontier = found.select("page", F.col("f.parent").alias("parent"), F.lit(depth).alias("depth"), place.cast("bigint").alias("place"))
        else:
            frontier = frontier.where(F.col("place") <= max_pages)
        path = scratch(spark, "level")
        frontier.write.parquet(path)
        frontier = spark.read.schema(frontier.schema).parquet(path)
        seen = frontier if seen is None else seen.unionByName(frontier)
    return seen


def full_site(max_pages: int, max_depth: int) -> tuple[int, int, int]:
    """(pages, depth, seconds): the limits of a whole site's crawl."""
    pages = min(max(max_pages, 200), 500)
    return pages, min(max(max_depth, 10), 20), min(5 * pages, 120)


def expand_sitemaps(maps: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """(url): the pages that sitemaps (url, xml) reach from ``start`` (url) through indexes, each once; cycles end."""
    spark = maps.sparkSession
    parsed = maps.select("url", web.sitemap(F.col("xml")).alias("s"))
    inner = parsed.select("url", F.explode("s.sitemaps").alias("target"))
    seen = frontier = start.select("url").distinct()
    for _ in range(depth):
        found = frontier.join(inner, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        path = scratch(spark, "maps")
        found.write.parquet(path)
        frontier = spark.read.schema(found.schema).parquet(path)
        seen = seen.unionByName(frontier)
    return parsed.join(seen, "url", "left_semi").select(F.explode("s.pages").alias("url")).distinct()


def first_sitemaps(sites: DataFrame, maps: DataFrame) -> DataFrame:
    """(site, url): the pages of each site's first sitemap that has any; an index is followed for one level."""
    looked = sites.select("site", F.posexplode(web.sitemap_candidates(F.col("site"))).alias("n", "url"))
    parsed = maps.select("url", web.sitemap(F.col("xml")).alias("s"))
    own = looked.join(parsed, "url")
    direct = own.select("site", "n", F.explode("s.pages").alias("page"))
    below = own.select("site", "n", F.explode("s.sitemaps").alias("url")).join(parsed, "url").select("site", "n", F.explode("s.pages").alias("page"))
    found = direct.unionByName(below).where(F.col("page").rlike("^https?://")).distinct()
    best = found.groupBy("site").agg(F.min("n").alias("n"))
    return found.join(best, ["site", "n"]).select("site", F.col("page").alias("url"))


def skip_reason(url: F.Column, allowed: list[str], robots: list[str], blocked: list[str] = (), deep: F.Column | None = None) -> F.Column:
    """Why an address isn't added to the frontier; null if it is. Without allowed domains any but the blocked are."""
    p, domain = web.path(url), web.authority(url)
    barred = F.lit(False)
    for r in robots:
        barred = barred | p.startswith(r)
    outside = domain.isin(*blocked) if blocked else F.lit(False)
    if allowed:
        outside = outside | ~domain.isin(*allowed)
    reason = F.when(~url.startswith("http://") & ~url.startswith("https://"), "scheme")
    if deep is not None:
        reason = reason.when(deep, "max_depth")
    return reason.when(outside, "external").when(barred, "robots")
