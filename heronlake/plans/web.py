"""Queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions import html as H
from heronlake.functions import web
from heronlake.operators import crawl, frontier
from heronlake.plans.registry import query
from heronlake.sources.scratch import scratch, stored
from heronlake.sources.tables import table

LINKS = """list_filter(regexp_extract_all(html, '(?i)<a[^>]+href="([^"]*)"', 1), lambda x: NOT regexp_matches(x, '^(?:javascript|mailto|tel):') AND x <> '')"""
AUTHORITY = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
PAIRS = r"list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '')"


@query(f"SELECT DISTINCT page_id, unnest({LINKS}) AS link FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return crawl.edges(table(spark, d, "pages"))


@query(f"SELECT page_id, len(list_distinct({LINKS}))::INT AS n FROM pages")
def page_link_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(web.links(F.col("html"))).alias("n"))


@query(f"SELECT {AUTHORITY} AS domain, count(*)::BIGINT AS n FROM pages GROUP BY ALL")
def page_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(web.authority(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


VARIANTS = "(SELECT page_id, unnest([url, url || '#x', url || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&utm_source=a' ELSE '?utm_source=a' END]) AS url FROM pages)"
NORMAL = f"""CASE WHEN q = '' THEN base ELSE base || '?' || q END"""


def _normal_sql(path: str, drop: str) -> str:
    return f"""SELECT page_id, {NORMAL} AS url FROM (SELECT page_id, {SCHEME} || '://' || {AUTHORITY} || {path} AS base,
      array_to_string(list_sort(list_filter({PAIRS}, lambda x: {drop})), '&') AS q FROM {VARIANTS})"""


_PLAIN = _normal_sql(
    f"CASE WHEN {PATH} = '/' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END",
    "split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'fbclid')",
)
_BARE = f"CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END"
_DEDUPED = _normal_sql(
    rf"CASE WHEN starts_with({_BARE}, '/en/') OR {_BARE} = '/en' THEN {_BARE} ELSE regexp_replace({_BARE}, '\.(?:en|fr|es|it|de)$', '') END",
    "NOT regexp_matches(lower(split_part(x, '=', 1)), '^(?:info|utm_|fbclid|gclid)')",
)


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Each address, with a fragment, and with a tracking parameter: the plain data hardly repeats any."""
    u = F.col("url")
    tracked = F.when(F.contains(u, F.lit("#")), u).when(F.contains(u, F.lit("?")), F.concat(u, F.lit("&utm_source=a"))).otherwise(F.concat(u, F.lit("?utm_source=a")))
    return table(spark, d, "pages").select("page_id", F.explode(F.array(u, F.concat(u, F.lit("#x")), tracked)).alias("url"))


@query(_PLAIN)
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("page_id", web.normalised(F.col("url")).alias("url"))


@query(f"SELECT url, min(page_id) AS page_id, count(*)::BIGINT AS n FROM ({_DEDUPED}) GROUP BY url")
def url_dedupe(spark: SparkSession, d: str) -> DataFrame:
    found = _variants(spark, d).select("page_id", web.deduplicated(F.col("url")).alias("url"))
    return found.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


PLANTED = """CASE page_id % 8 WHEN 1 THEN '<p>Just a moment</p>' || html WHEN 2 THEN '<div class="g-recaptcha"></div>' || html
WHEN 3 THEN '<noscript>enable JavaScript</noscript>' WHEN 4 THEN html || '<a>Log in</a> Create new account' WHEN 5 THEN 'x' ELSE html END"""


def _any_sql(markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(h), '{m}')" for m in markers) + ")"


DETECT = f"""SELECT page_id, url, h, contains(lower(url), 'login') OR (contains(lower(h), 'id="email"') AND contains(lower(h), 'create new account'))
  OR (length(h) < 30000 AND contains(lower(h), 'log in') AND contains(lower(h), 'create new account')) AS login,
  {_any_sql(web.CLOUDFLARE)} AS cloudflare, {_any_sql(web.CAPTCHA)} AS captcha, {_any_sql(web.SCRIPT_NEEDED)} AND length(h) < 5000 AS script
FROM (SELECT page_id, url, {PLANTED} AS h FROM pages)"""


@query(f"SELECT page_id, login, cloudflare, captcha, script FROM ({DETECT})")
def page_detectors(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select("page_id", web.detectors(F.expr(PLANTED), F.col("url")).alias("x"))
    return found.select("page_id", "x.*")


@query(f"""SELECT page_id, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'failed' END AS level FROM (
SELECT page_id, greatest(0, least(100, 10 * (trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '')::INT + 30 * (length(h) > 1000)::INT
  + 10 * (len({LINKS.replace("html,", "h,")}) > 0)::INT + 10 * (regexp_extract(h, '(?i)<meta[^>]+name="description"[^>]+content="([^"]+)"', 1) <> '')::INT
  + 10 * (length(h) > 1000 AND length(h) < 5000000)::INT - 40 * (length(h) < 200)::INT - 50 * cloudflare::INT - 30 * script::INT - 20 * login::INT
  - 20 * (page_id % 9 = 0)::INT)) AS score FROM ({DETECT}))""")
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("page_id") % 9 == 0, 403).otherwise(200)
    return table(spark, d, "pages").select("page_id", web.quality(F.expr(PLANTED), F.col("url"), status).alias("x")).select("page_id", "x.*")


@query(f"""SELECT page_id, array_to_string(list_filter([CASE WHEN trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' THEN 'title:+10' END, CASE WHEN length(h) > 1000 THEN 'content:+30' END,
  CASE WHEN len({LINKS.replace("html,", "h,")}) > 0 THEN 'links:+10' END, CASE WHEN regexp_extract(h, '(?i)<meta[^>]+name="description"[^>]+content="([^"]+)"', 1) <> '' THEN 'description:+10' END,
  CASE WHEN length(h) > 1000 AND length(h) < 5000000 THEN 'size:+10' END, CASE WHEN length(h) < 200 THEN 'tiny:-40' END, CASE WHEN cloudflare THEN 'cloudflare:-50' END,
  CASE WHEN script THEN 'script:-30' END, CASE WHEN login THEN 'login:-20' END, CASE WHEN page_id % 9 = 0 THEN 'status:-20' END], lambda x: x IS NOT NULL), ' ') AS rules FROM ({DETECT})""")
def quality_breakdown(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("page_id") % 9 == 0, 403).otherwise(200)
    return table(spark, d, "pages").select("page_id", F.array_join(web.breakdown(F.expr(PLANTED), F.col("url"), status), " ").alias("rules"))


_HEAD = """'<html lang="en"><head><title> T ' || page_id || '</title><meta property="og:title" content="O' || page_id || '"><meta name="description" content="D ' || page_id || '">
<meta property="og:site_name" content="S"><meta property="og:type" content="article"><link rel="canonical" href="https://x.example/' || page_id || '"></head>' || html"""


@query("""SELECT page_id, 'T ' || page_id AS title, 'O' || page_id AS og_title, 'D ' || page_id AS description, 'S' AS site_name, 'article' AS og_type, 'https://x.example/' || page_id AS canonical FROM pages""")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title, open graph, description and canonical address; the pages have a planted head before their own."""
    pages = table(spark, d, "pages").select("page_id", "url", F.expr(_HEAD).alias("html"))
    schema = "title string, og_title string, description string, site_name string, og_type string, canonical string"
    return H.read(pages, schema, lambda p: [(p.title.split("<")[0], *(p.meta.get(k) for k in ("og:title", "description", "og:site_name", "og:type")), p.canonical)])


_OUT = f"(SELECT DISTINCT page_id, base || link AS url, base FROM (SELECT page_id, 'https://' || {AUTHORITY} AS base, unnest({LINKS}) AS link FROM pages) WHERE starts_with(link, '/'))"


@query(
    f"SELECT page_id, url, contains(url, base) AND NOT ({' OR '.join(f'''ends_with(lower(url), '{e}')''' for e in web.FILE_ENDINGS)})"
    f" AND NOT ({' OR '.join(f'''contains(lower(url), '{s}')''' for s in web.SHARES)}) AS crawlable FROM {_OUT}"
)
def crawlable(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("https://"), web.authority(F.col("url")))
    out = table(spark, d, "pages").select("page_id", base.alias("base"), F.explode(web.links(F.col("html"))).alias("link"))
    out = out.where(F.col("link").startswith("/")).select("page_id", "base", F.concat("base", "link").alias("url"))
    return out.select("page_id", "url", web.crawlable(F.col("url"), F.col("base")).alias("crawlable"))


GUARDED = "CASE page_id % 8 WHEN 0 THEN 'http://localhost/x' WHEN 1 THEN 'http://10.1.2.3/' WHEN 2 THEN 'http://172.16.0.1/' WHEN 3 THEN 'http://172.32.0.1/' WHEN 4 THEN 'http://192.168.1.1:80/' WHEN 5 THEN 'ftp://example.com/' WHEN 6 THEN 'http://172.31.9.9' ELSE url END"


@query(f"""SELECT page_id, CASE WHEN {SCHEME} NOT IN ('http', 'https') THEN 'scheme' WHEN h IN ({", ".join(f"'{b}'" for b in web.BLOCKED)}) THEN 'blocked'
  WHEN starts_with(h, '10.') OR starts_with(h, '192.168.') OR (starts_with(h, '172.') AND try_cast(split_part(h, '.', 2) AS INT) BETWEEN 16 AND 31) THEN 'private' END AS error
FROM (SELECT page_id, url, regexp_replace({AUTHORITY}, ':[0-9]*$', '') AS h FROM (SELECT page_id, {GUARDED} AS url FROM pages))""")
def ssrf_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", web.fetch_error(F.expr(GUARDED)).alias("error"))


_SEEN = f"(SELECT DISTINCT page_id, unnest([{SCHEME} || '://' || {AUTHORITY} || link, 'https://blocked.example' || link, 'ftp://x' || link]) AS link FROM (SELECT page_id, url, unnest({LINKS}) AS link FROM pages) WHERE starts_with(link, '/'))"


@query(f"""SELECT CASE WHEN NOT starts_with(link, 'http') THEN 'scheme' WHEN page_id % 5 = 4 THEN 'max_depth' WHEN contains(link, '//blocked.example') THEN 'external'
  WHEN starts_with(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/t') OR starts_with(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/The') THEN 'robots' ELSE 'kept' END AS reason,
count(*)::BIGINT AS n FROM {_SEEN} GROUP BY ALL""")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Links of the own site, of a blocked one and of another scheme; every fifth page is too deep."""
    pages = table(spark, d, "pages").select("page_id", F.concat(web.scheme(F.col("url")), F.lit("://"), web.authority(F.col("url"))).alias("base"), F.explode(web.links(F.col("html"))).alias("p"))
    pages = pages.where(F.col("p").startswith("/"))
    found = pages.select("page_id", F.explode(F.array(F.concat("base", "p"), F.concat(F.lit("https://blocked.example"), "p"), F.concat(F.lit("ftp://x"), "p"))).alias("link")).distinct()
    reason = crawl.skip_reason(F.col("link"), [], ["/t", "/The"], ["blocked.example"], F.col("page_id") % 5 == 4)
    return found.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


TYPED = "CASE page_id % 6 WHEN 0 THEN 'https://a.b/x.PDF?y=1' WHEN 1 THEN 'https://a.b/c.docx' WHEN 2 THEN 'https://a.b/i.jpeg' ELSE url END"
HEADER = "CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/x-odd' ELSE NULL END"
_ENDING = r"lower(regexp_extract(split_part(u, '?', 1), '[^/]\.([A-Za-z0-9]+)$', 1))"


_TYPES = (
    f"SELECT page_id, CASE trim(split_part(lower(coalesce(h, '')), ';', 1)) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in web.MIME_TYPES.items())
    + f" ELSE CASE {_ENDING} "
    + " ".join(f"WHEN '{e}' THEN '{k}'" for k, v in web.ENDINGS.items() for e in v)
    + f" ELSE 'unknown' END END AS type FROM (SELECT page_id, {TYPED} AS u, {HEADER} AS h FROM pages)"
)


@query(_TYPES)
def content_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", web.content_type(F.expr(TYPED), F.expr(HEADER)).alias("type"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT page_id, unnest({LINKS}) AS link FROM pages), n AS (
  SELECT DISTINCT a.page_id AS p, b.page_id AS q FROM e a JOIN e b USING (link)), walk AS (
  SELECT min(page_id) AS page_id, 0 AS depth FROM e UNION SELECT q, depth + 1 FROM walk JOIN n ON p = page_id WHERE depth < 3)
SELECT page_id, min(depth) AS depth FROM walk GROUP BY page_id""")
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Pages are neighbours when they share a link: in the data no link leads to another page."""
    graph = crawl.edges(table(spark, d, "pages"))
    return crawl.levels(graph, graph.agg(F.min("page_id").alias("page_id")), 3)


@query()
def readable_text(spark: SparkSession, d: str) -> DataFrame:
    """The block text, the article's text, Markdown and plain text of each page, whole."""
    return H.read(table(spark, d, "pages"), "title string, text string, readable string, markdown string, plain string", lambda p: [(p.title, p.text, p.readable, *p.markdown)])


@query(f"SELECT page_id, {SCHEME} || '://' || {AUTHORITY} || link AS url, {AUTHORITY} AS domain, ends_with(lower(link), '.pdf') AS is_pdf FROM (SELECT DISTINCT page_id, url, unnest({LINKS}) AS link FROM pages) WHERE starts_with(link, '/')")
def link_details(spark: SparkSession, d: str) -> DataFrame:
    """Absolute links with their domains; here those to the own site."""
    found = H.read(table(spark, d, "pages"), "url string, text string, domain string, is_pdf boolean, own string", lambda p: [(a["url"], a["text"], a["domain"], a["is_pdf"], H.domain(p.url)) for a in p.anchors])
    return found.where("domain = own").select("page_id", "url", "domain", "is_pdf")


_ASSETS = """'<img src="/i' || page_id || '.png"><svg id="g' || page_id || '"></svg><video src="/v.mp4"><source src="w.webm"></video><audio><source src="/a.mp3"></audio><a href="/d' || page_id || '.DOCX?x=1">d</a>' || html"""


@query(f"""SELECT page_id, {SCHEME} || '://' || {AUTHORITY} || '/i' || page_id || '.png' AS image, 'g' || page_id AS svg, {SCHEME} || '://' || {AUTHORITY} || '/v.mp4' AS video,
  {SCHEME} || '://' || {AUTHORITY} || '/a.mp3' AS audio, {SCHEME} || '://' || {AUTHORITY} || '/d' || page_id || '.DOCX?x=1' AS document FROM pages""")
def page_assets(spark: SparkSession, d: str) -> DataFrame:
    """The first asset of each kind; the pages have planted ones before their own."""
    pages = table(spark, d, "pages").select("page_id", "url", F.expr(_ASSETS).alias("html"))
    kinds = ("images", "svgs", "videos", "audio", "documents")
    return H.read(pages, "image string, svg string, video string, audio string, document string", lambda p: [tuple(p.assets[k][0] for k in kinds)])


@query("SELECT page_id, sha256(html) AS content_hash, row_number() OVER (PARTITION BY html ORDER BY page_id) > 1 AS duplicate FROM pages")
def page_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("content_hash").orderBy("page_id")
    hashed = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"))
    return hashed.withColumn("duplicate", F.row_number().over(w) > 1)


_ALTERNATES = """CASE WHEN page_id % 2 = 0 THEN '<link rel="alternate" hreflang="fr" href="' || url || '"><link rel="alternate" hreflang="de" href="https://other.invalid/">' ELSE '' END || '<a href="/de/x">x</a>' || html"""


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE {SCHEME} || '://' || {AUTHORITY} || '/de/x' END AS variant FROM pages""")
def lang_variant(spark: SparkSession, d: str) -> DataFrame:
    """Alternates of the own domain, or else links that begin with a language; both are planted, the first is taken."""
    pages = table(spark, d, "pages").select("page_id", "url", F.expr(_ALTERNATES).alias("html"))
    return H.read(pages, "variant string", lambda p: [(p.variants[0],)])


_STATE = "CASE page_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'success' END"


#: A page's outcome: skipped for its address, failed by its status or as a challenge, else loaded.
_OUTCOME = f"""(SELECT page_id, CASE WHEN page_id % 8 IN (0, 1, 2, 4, 5, 6) THEN 'skipped' WHEN page_id % 9 = 0 OR cloudflare THEN 'failed' ELSE 'success' END AS state,
  CASE WHEN page_id % 8 = 5 THEN 'scheme' WHEN page_id % 8 = 0 THEN 'blocked' WHEN page_id % 8 IN (1, 2, 4, 6) THEN 'private' END AS reason FROM ({DETECT}))"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages")
    status = F.when(F.col("page_id") % 9 == 0, 403).otherwise(200)
    reason = web.fetch_error(F.expr(GUARDED))
    blocked = status.isin(*web.BOT_BLOCKED) | web.detectors(F.expr(PLANTED), F.col("url"))["cloudflare"]
    state = F.when(reason.isNotNull(), "skipped").when(blocked, "failed").otherwise("success")
    return t.select("page_id", state.alias("state"), reason.alias("reason"), web.content_type(F.expr(TYPED), F.expr(HEADER)).alias("type"))


@query(f"""SELECT type, count(*) FILTER (state = 'success')::BIGINT AS success, count(*) FILTER (state = 'failed')::BIGINT AS failed, count(*) FILTER (state = 'skipped')::BIGINT AS skipped,
  round(count(*) / 60.0, 6)::DOUBLE AS per_second FROM {_OUTCOME} JOIN ({_TYPES}) USING (page_id) GROUP BY type""")
def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by content type, and pages a second of a crawl that took a minute."""
    counts = [F.count_if(F.col("state") == x).alias(x) for x in ("success", "failed", "skipped")]
    return _outcomes(spark, d).groupBy("type").agg(*counts, F.round(F.count(F.lit(1)) / 60.0, 6).alias("per_second"))


@query(f"SELECT state, coalesce(reason, '-') AS reason, count(*)::BIGINT AS n FROM {_OUTCOME} GROUP BY ALL")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).groupBy("state", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, url FROM pages ORDER BY page_id % 5, length(url), page_id LIMIT 16")
def frontier_pop(spark: SparkSession, d: str) -> DataFrame:
    """The next addresses by priority, depth and arrival; the limit is the number of workers."""
    return table(spark, d, "pages").orderBy(F.expr("page_id % 5"), F.length("url"), "page_id").limit(16).select("page_id", "url")


@query(f"""SELECT u AS url FROM (SELECT url AS u FROM pages UNION SELECT link FROM (SELECT unnest({LINKS}) AS link FROM pages)
UNION SELECT {SCHEME} || '://' || {AUTHORITY} || '/de/x' FROM pages WHERE page_id % 2 = 1) ORDER BY length(u), u LIMIT 200""")
def discovered_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages, of their links and of their languages, the shortest first, as many as a crawl may visit."""
    pages = table(spark, d, "pages")
    found = pages.select("url").union(crawl.edges(pages).select("link")).union(lang_variant(spark, d).where("page_id % 2 = 1").select("variant"))
    return found.distinct().orderBy(F.length("url"), "url").limit(200)


@query("SELECT page_id, 'T ' || page_id AS title, '# H ' || page_id || chr(10) || chr(10) || 'a  **b** [c](https://x.example/c)' AS markdown FROM pages")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The main part of planted pages as Markdown."""
    markup = F.concat(F.lit("<html><head><title>T "), F.col("page_id"), F.lit("</title></head><body><nav>menu</nav><main><h1>H "), F.col("page_id"), F.lit('</h1><p>a <b>b</b> <a href="/c">c</a></p><script>x</script></main><p>after</p></body></html>'))
    pages = table(spark, d, "pages").select("page_id", F.lit("https://x.example/a").alias("url"), markup.alias("html"))
    return H.read(pages, "title string, markdown string", lambda p: [(p.title, p.markdown[0])])


_CHALLENGED = """CASE page_id % 9 """ + " ".join(f"WHEN {i} THEN html || '<p>{m.upper()}</p>'" for i, m in enumerate(web.CHALLENGES)) + " ELSE html || ' class=cf-x' END"


@query(f"SELECT page_id, {_any_sql(web.CHALLENGES)} AS challenge FROM (SELECT page_id, {_CHALLENGED} AS h FROM pages)")
def challenge_flag(spark: SparkSession, d: str) -> DataFrame:
    """Each marker is planted in some pages, in capitals."""
    return table(spark, d, "pages").select("page_id", web.any_of(F.lower(F.expr(_CHALLENGED)), web.CHALLENGES).alias("challenge"))


_SCORE = """greatest(0, least(100, 10 * (trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '')::INT + 30 * (length(h) > 1000)::INT
  + 10 * (len({links}) > 0)::INT + 10 * (regexp_extract(h, '(?i)<meta[^>]+name="description"[^>]+content="([^"]+)"', 1) <> '')::INT
  + 10 * (length(h) > 1000 AND length(h) < 5000000)::INT - 40 * (length(h) < 200)::INT - 50 * cloudflare::INT - 30 * script::INT - 20 * login::INT))"""


@query(f"""WITH n AS (SELECT page_id, {_SCORE.format(links=LINKS.replace("html,", "h,"))} AS score FROM ({DETECT})), r AS (
  SELECT page_id, {_SCORE.format(links=LINKS.replace("html,", "h,"))} AS score FROM ({DETECT.replace(PLANTED, "html")}))
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'render' WHEN n.score < 40 AND r.score > n.score THEN 'render' ELSE 'native' END AS adapter,
  CASE WHEN page_id % 9 = 0 THEN r.score WHEN n.score < 40 AND r.score > n.score THEN r.score ELSE n.score END AS score FROM n JOIN r USING (page_id)""")
def adapter_pick(spark: SparkSession, d: str) -> DataFrame:
    """The page as it was loaded, or as a browser renders it: for blocked robots, and where the first scores below 0.4 and
    the second better."""
    url, status = F.col("url"), F.when(F.col("page_id") % 9 == 0, 403).otherwise(200)
    native, render = (web.quality(x, url, F.lit(200))["score"] for x in (F.expr(PLANTED), F.col("html")))
    scored = table(spark, d, "pages").select("page_id", status.alias("status"), native.alias("n"), render.alias("r"))
    other = F.col("status").isin(*web.BOT_BLOCKED) | ((F.col("n") / 100 < 0.4) & (F.col("r") > F.col("n")))
    return scored.select("page_id", F.when(other, "render").otherwise("native").alias("adapter"), F.when(other, F.col("r")).otherwise(F.col("n")).alias("score"))


_BARE_TEXT = r"trim(regexp_replace(regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""SELECT page_id, ok, CASE WHEN ok AND n > 200 THEN 'native' ELSE 'fallback' END AS source FROM (
  SELECT page_id, page_id % 9 <> 0 AND length({_BARE_TEXT}) > 0 AS ok, length({_BARE_TEXT}) AS n FROM ({DETECT}))""")
def scrape_gate(spark: SparkSession, d: str) -> DataFrame:
    """A scrape is good without an error and with a text; one of 200 characters or fewer is loaded in another way."""
    bare = F.regexp_replace(F.expr(PLANTED), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " ")
    n, status = F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))), F.when(F.col("page_id") % 9 == 0, 403).otherwise(200)
    rows = table(spark, d, "pages").select("page_id", ((status == 200) & (n > 0)).alias("ok"), n.alias("n"))
    return rows.select("page_id", "ok", F.when(F.col("ok") & (F.col("n") > 200), "native").otherwise("fallback").alias("source"))


@query(r"""SELECT page_id, '# ' || trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10)
  || trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_to_document(spark: SparkSession, d: str) -> DataFrame:
    """A scraped page as a titled text, to be ingested."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " ")
    text = F.concat(F.lit("# "), web.title(F.col("html")), F.lit("\n\nSource: "), "url", F.lit("\n\n"), F.trim(F.regexp_replace(bare, r"\s+", " ")))
    return table(spark, d, "pages").select("page_id", text.alias("text"))


@query(f"""SELECT page_id, sha256(html) AS content_hash, row_number() OVER (PARTITION BY html ORDER BY page_id) > 1 AS duplicate, login, cloudflare, len(list_distinct({LINKS}))::INT AS n_links
FROM pages JOIN (SELECT page_id, login, cloudflare FROM ({DETECT.replace(PLANTED, "html")})) USING (page_id)""")
def page_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """What a crawler does with each page: detect, hash, find copies by the smallest id, links."""
    x = web.detectors(F.col("html"), F.col("url"))
    rows = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"), x["login"].alias("login"), x["cloudflare"].alias("cloudflare"), F.size(web.links(F.col("html"))).alias("n_links"))
    first = rows.groupBy("content_hash").agg(F.min("page_id").alias("first"))
    return rows.join(first, "content_hash").select("page_id", "content_hash", (F.col("page_id") != F.col("first")).alias("duplicate"), "login", "cloudflare", "n_links")


_TREE = "(SELECT page_id AS page, unnest([2 * page_id + 1, 2 * page_id + 2]) AS target FROM pages)"
_KEPT = f"(SELECT * FROM {_TREE} WHERE target % 7 <> 3 AND target <= (SELECT max(page_id) FROM pages))"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a site whose pages are a tree; those to every seventh page lead to another domain."""
    pages = table(spark, d, "pages")
    last = pages.agg(F.max("page_id")).first()[0] or 0
    found = pages.select(F.col("page_id").alias("page"), F.posexplode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("n", "target"))
    return found.where((F.col("target") % 7 != 3) & (F.col("target") <= last))


def _crawl_sql(pages: int, depth: int) -> str:
    return f"""WITH RECURSIVE w AS (SELECT 0::BIGINT AS page, NULL::BIGINT AS parent, 0 AS depth UNION ALL SELECT target, w.page, depth + 1 FROM w JOIN {_KEPT} k ON k.page = w.page WHERE depth < {depth})
SELECT page, parent, depth, row_number() OVER (ORDER BY page)::BIGINT AS place FROM w ORDER BY page LIMIT {pages}"""


@query(_crawl_sql(40, 6))
def crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first with limits of pages and depth; a page's parent is the one that it was found on."""
    return crawl.crawl(_links(spark, d), spark.createDataFrame([(0,)], "page bigint"), 40, 6)


@query(_crawl_sql(200, 10))
def crawl_full_site(spark: SparkSession, d: str) -> DataFrame:
    pages, depth, _ = crawl.full_site(10, 2)
    return crawl.crawl(_links(spark, d), spark.createDataFrame([(0,)], "page bigint"), pages, depth)


@query(f"""WITH w AS ({_crawl_sql(500, 3)}) SELECT DISTINCT page, depth, link || '.pdf' AS url FROM w JOIN (SELECT page_id AS page, unnest({LINKS}) AS link FROM pages) USING (page)
WHERE regexp_matches(lower(link), 'the|ha|guide|law')""")
def pdf_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Links to documents with a keyword, on pages down to a depth; every link of the data is taken for a document."""
    seen = crawl.crawl(_links(spark, d), spark.createDataFrame([(0,)], "page bigint"), 500, 3)
    found = crawl.edges(table(spark, d, "pages")).withColumnRenamed("page_id", "page").where(F.lower("link").rlike("the|ha|guide|law"))
    return seen.join(found, "page").select("page", "depth", F.concat("link", F.lit(".pdf")).alias("url")).distinct()


def _frontier_sql(depth: int) -> str:
    """Level by level: what the pages that are no copies lead to and wasn't seen; of one content the first is done."""
    parts = [f"""links AS (SELECT page_id, unnest({LINKS}) AS link FROM pages),
    known AS (SELECT 'page:' || page_id AS url, sha256(html) AS h FROM pages UNION ALL SELECT 'link:' || link, sha256('link:' || link) FROM (SELECT DISTINCT link FROM links)),
    e AS (SELECT DISTINCT 'page:' || page_id AS url, 'link:' || link AS target FROM links UNION SELECT 'link:' || link, 'page:' || page_id FROM links),
    l0 AS (SELECT 'page:' || min(page_id) AS url, 0 AS depth, NULL::VARCHAR AS parent FROM pages), s0 AS (SELECT l0.*, h, 'completed' AS state FROM l0 JOIN known USING (url)), a0 AS (SELECT * FROM s0)"""]
    for i in range(1, depth + 1):
        parts.append(f"""l{i} AS (SELECT target AS url, {i} AS depth, min(e.url) AS parent FROM s{i - 1} JOIN e USING (url) WHERE state = 'completed' AND target NOT IN (SELECT url FROM a{i - 1}) GROUP BY target),
    s{i} AS (SELECT l.*, k.h, CASE WHEN k.h IN (SELECT h FROM a{i - 1} WHERE state = 'completed') OR row_number() OVER (PARTITION BY k.h ORDER BY l.url) > 1 THEN 'duplicate' ELSE 'completed' END AS state FROM l{i} l JOIN known k USING (url)),
    a{i} AS (SELECT * FROM a{i - 1} UNION ALL SELECT * FROM s{i})""")
    return "WITH " + ", ".join(parts) + f" SELECT url, depth, parent, state FROM a{depth}"


@query(_frontier_sql(4))
def frontier_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A crawl from the first page over pages and the links that they share, with a stored frontier."""
    pages = table(spark, d, "pages")
    known, links = (stored(x, "site") for x in frontier.bipartite(pages))
    crawled = frontier.Frontier(spark, scratch(spark, "frontier"), 2)
    crawled.seed(pages.agg(F.min("page_id").alias("p")).select(F.concat(F.lit("page:"), "p").alias("url")))
    crawled.run(known, links, max_pages=1 << 40, max_depth=4, at_once=1 << 30)
    return crawled.urls().select("url", "depth", "parent", "state")


_MAPS = """'<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' """


def _maps(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps: an index of regions, whose indexes list nations (and the root again), whose sitemaps list customers."""
    loc = lambda tag, url: F.concat(F.lit(f"<{tag}><loc> "), url, F.lit(f"</loc></{tag}>"))
    url = lambda kind, key: F.concat(F.lit(f"https://s.example/{kind}/"), key, F.lit(".xml"))
    body = lambda key, entry: F.array_join(F.sort_array(F.collect_list(entry)), "")
    wrap = lambda tag, x: F.concat(F.lit(f'<?xml version="1.0"?>\n<{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), x, F.lit(f"</{tag}>"))
    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    top = r.agg(body(None, loc("sitemap", url("r", F.col("r_regionkey"))))).toDF("x").select(F.lit("https://s.example/sitemap.xml").alias("url"), wrap("sitemapindex", F.col("x")).alias("xml"))
    back = F.lit("<sitemap><loc>https://s.example/sitemap.xml</loc></sitemap>")
    mid = n.groupBy("n_regionkey").agg(body(None, loc("sitemap", url("n", F.col("n_nationkey")))).alias("x"))
    mid = mid.select(url("r", F.col("n_regionkey")).alias("url"), wrap("sitemapindex", F.concat("x", back)).alias("xml"))
    image = F.concat(F.lit("<url><loc>https://s.example/c/"), F.col("c_custkey"), F.lit("</loc><image:image><image:loc>https://s.example/i/"), F.col("c_custkey"), F.lit("</image:loc></image:image></url>"))
    low = c.groupBy("c_nationkey").agg(body(None, image).alias("x")).select(url("n", F.col("c_nationkey")).alias("url"), wrap("urlset", F.col("x")).alias("xml"))
    return top.unionByName(mid).unionByName(low)


@query("SELECT 'https://s.example/' || k || '/' || c_custkey AS url FROM customer JOIN nation ON n_nationkey = c_nationkey, unnest(['c', 'i']) t(k)")
def sitemap_tree(spark: SparkSession, d: str) -> DataFrame:
    """All pages and images below an index of indexes that also has a cycle."""
    return crawl.expand_sitemaps(_maps(spark, d), spark.createDataFrame([("https://s.example/sitemap.xml",)], "url string"))


@query("""SELECT 'https://n' || n_nationkey || '.example/x' AS site, 'https://n' || n_nationkey || '.example/' || CASE n_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS url
FROM nation WHERE n_nationkey % 4 <> 3""")
def sitemap_first_hit(spark: SparkSession, d: str) -> DataFrame:
    """The first of the places where a sitemap may be that has pages; of some sites an index, of others none."""
    host = F.concat(F.lit("https://n"), F.col("n_nationkey"), F.lit(".example"))
    n = table(spark, d, "nation").select(host.alias("h"), "n_nationkey")
    kind = F.col("n_nationkey") % 3
    place = F.when(kind == 0, "/sitemap.xml").when(kind == 1, "/sitemap_index.xml").otherwise("/wp-sitemap.xml")
    page = F.concat("h", F.when(kind == 0, "/a").when(kind == 1, "/b").otherwise("/c"))
    urlset = lambda x: F.concat(F.lit("<urlset><url><loc>"), x, F.lit("</loc></url></urlset>"))
    own = n.where("n_nationkey % 4 <> 3").select(F.concat("h", place).alias("url"), F.when(kind == 1, F.concat(F.lit("<sitemapindex><sitemap><loc>"), "h", F.lit("/sub.xml</loc></sitemap></sitemapindex>"))).otherwise(urlset(page)).alias("xml"))
    below = n.where(kind == 1).select(F.concat("h", F.lit("/sub.xml")).alias("url"), urlset(page).alias("xml"))
    empty = n.where(kind == 2).select(F.concat("h", F.lit("/sitemap.xml")).alias("url"), F.lit("<urlset></urlset>").alias("xml"))
    return crawl.first_sitemaps(n.select(F.concat("h", F.lit("/x")).alias("site")), own.unionByName(below).unionByName(empty))


_ROBOTS = "User-agent: *\nDisallow: /t # no\nAllow: /to\nDisallow: /The\nCrawl-delay: 2.5\nSitemap: https://x/s.xml\n\nUser-agent: ScraperBot\nCrawl-delay: odd\nDisallow: /and\nSitemap: https://x/s.xml\nSitemap: https://x/t.xml"
_P = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""SELECT DISTINCT page_id, link, NOT (starts_with(link, '/t') OR starts_with(link, '/The')) AS anyone, NOT starts_with(link, '/and') AS bot, 2.5::DOUBLE AS delay, 2 AS sitemaps
FROM (SELECT page_id, unnest({LINKS}) AS link FROM pages)""")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether links may be fetched by anyone, and by the bot, which has rules of its own; the first that fits decides."""
    links = crawl.edges(table(spark, d, "pages"))
    found = links.select("page_id", "link", web.robots(F.lit(_ROBOTS)).alias("r"))
    return found.select(
        "page_id", "link", web.can_fetch(F.col("r.rules"), F.col("link")).alias("anyone"), web.can_fetch(F.col("r.rules"), F.col("link"), "scraperbot").alias("bot"),
        F.col("r.delay").alias("delay"), F.size("r.sitemaps").alias("sitemaps"),
    )


_SAVED = "url || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/a b.PDF' WHEN 2 THEN '/x.exe' ELSE '/r*1.docx' END"
_GIVEN = "CASE WHEN page_id % 10 = 0 THEN 'my:file?.txt' WHEN page_id % 10 = 5 THEN ' ' ELSE '' END"


@query(f"""SELECT page_id, CASE WHEN trim(regexp_replace(name, '[\\\\/*?:"<>|]', '_', 'g')) = '' THEN 'downloaded_document' ELSE trim(regexp_replace(name, '[\\\\/*?:"<>|]', '_', 'g')) END AS name FROM (
SELECT page_id, CASE WHEN g <> '' THEN g WHEN list_contains([{", ".join(f"'{e}'" for e in web.SUPPORTED)}], lower(regexp_extract(l, '\\.([^.]+)$', 1))) THEN 'x_' || l
  ELSE 'x_cloud_doc_' || sha1(url)[1:10] || '.pdf' END AS name FROM (
SELECT page_id, url, g, regexp_extract({PATH}, '([^/]*)$', 1) AS l FROM (SELECT page_id, {_SAVED} AS url, {_GIVEN} AS g FROM pages)))""")
def download_name(spark: SparkSession, d: str) -> DataFrame:
    """A given name, the address's own if it can be read, or a hash; without characters that files can't have."""
    return table(spark, d, "pages").select("page_id", web.saved_name(F.expr(_SAVED), F.expr(_GIVEN), "x_").alias("name"))


@query("SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'download=1' AS url FROM pages")
def share_link_rewrite(spark: SparkSession, d: str) -> DataFrame:
    joint = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    return table(spark, d, "pages").select("page_id", F.concat("url", joint, F.lit("download=1")).alias("url"))


@query(f"SELECT DISTINCT id, lang FROM (SELECT unnest(regexp_extract_all(html, 'href=\"/([a-z0-9-]+)', 1)) AS id FROM pages), (VALUES ('en'), ('ar')) l(lang)")
def id_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Ids of listing pages in both languages."""
    ids = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([a-z0-9-]+)'), F.lit(1))).alias("id")).distinct()
    return ids.select("id", F.explode(F.array(F.lit("en"), F.lit("ar"))).alias("lang"))


@query(f"SELECT page_id, sum((ends_with(lower(link), '.pdf') OR regexp_matches(lower(link), 'doc|report'))::INT)::BIGINT AS n FROM (SELECT DISTINCT page_id, unnest({LINKS}) AS link FROM pages) GROUP BY page_id")
def pdf_links(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("link")
    hit = (low.endswith(".pdf") | low.rlike("doc|report")).cast("int")
    return crawl.edges(table(spark, d, "pages")).groupBy("page_id").agg(F.sum(hit).alias("n"))


@query("""SELECT 'https://s.example/sitemap.xml' AS url, 'sitemapindex' AS kind, count(*)::BIGINT AS n FROM region UNION ALL
SELECT 'https://s.example/r/' || n_regionkey || '.xml', 'sitemapindex', count(*) + 1 FROM nation GROUP BY n_regionkey UNION ALL
SELECT 'https://s.example/n/' || c_nationkey || '.xml', 'urlset', 2 * count(*) FROM customer GROUP BY c_nationkey""")
def sitemap_kind(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each sitemap, and how many addresses it lists."""
    found = _maps(spark, d).select("url", web.sitemap(F.col("xml")).alias("s"))
    return found.select("url", "s.kind", (F.size("s.pages") + F.size("s.sitemaps")).cast("bigint").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'downloaded_document' ELSE 'a_b_' || page_id || '_c.pdf' END AS name FROM pages")
def dest_name(spark: SparkSession, d: str) -> DataFrame:
    """A name without characters that files can't have; a given one that is blank has a default."""
    given = F.when(F.col("page_id") % 6 == 0, "  ").otherwise(F.concat(F.lit("a:b|"), F.col("page_id"), F.lit("?c.pdf")))
    return table(spark, d, "pages").select("page_id", web.saved_name(F.col("url"), given).alias("name"))
