"""Web functions as columns: addresses, page detectors, quality scores and content types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings and share links that aren't crawled. One pattern has a capital, and the address is lower-cased
#: before it is compared, so that one never matches; it is kept, as results depend on it.
FILE_ENDINGS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".pdf", ".doc", ".docx", ".mp4", ".mp3", ".zip",
    ".woff", ".woff2", ".ttf", ".eot",
)
SHARES = ("/sharer/", "/shareArticle", "/share.php", "pinterest.com/pin/", "twitter.com/intent/", "linkedin.com/share")
#: Page markers.
CLOUDFLARE = ("cf-browser-verification", "cloudflare ray id", "checking your browser", "just a moment", "_cf_chl_opt")
CAPTCHA = ("recaptcha", "g-recaptcha", "hcaptcha", "captcha-box", "security check")
SCRIPT_NEEDED = ("enable javascript", "javascript is disabled", "noscript")
#: What a challenge page holds, in lower case; status codes of blocked robots; ways to load, best first.
CHALLENGES = ("__cf_chl_", "cf_chl_opt", "challenge-form", "cf-browser-verification", "cdn-cgi/challenge-platform", "/cdn-cgi/l/challenge", "cloudflare")
BOT_BLOCKED = (403, 429, 503)
#: Endings of documents that can be read.
SUPPORTED = ("txt", "md", "markdown", "html", "htm", "docx", "pdf", "png", "jpg", "jpeg", "tiff", "bmp", "webp", "xlsx", "xls", "pptx", "ppt", "csv")
#: Hosts that are never fetched.
BLOCKED = ("127.0.0.1", "localhost", "0.0.0.0", "::1", "169.254.169.254", "metadata.google.internal")
#: Content types by MIME type and by ending.
MIME_TYPES = {
    "text/html": "html", "application/pdf": "pdf", "application/json": "json", "application/xml": "xml", "text/xml": "xml",
    "text/csv": "csv", "text/plain": "text", "application/msword": "word", "application/vnd.ms-excel": "excel",
    "application/vnd.ms-powerpoint": "powerpoint", "application/zip": "zip", "application/gzip": "zip", "application/x-tar": "zip",
    "application/x-rar-compressed": "zip", "application/x-7z-compressed": "zip", "image/jpeg": "image", "image/png": "image",
    "image/gif": "image", "image/webp": "image", "image/svg+xml": "image", "image/bmp": "image", "video/mp4": "video",
    "video/mpeg": "video", "video/webm": "video", "video/quicktime": "video", "video/x-msvideo": "video", "audio/mpeg": "audio",
    "audio/wav": "audio", "audio/ogg": "audio", "audio/mp4": "audio",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "word",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "powerpoint",
}
ENDINGS = {
    "html": ("html", "htm"), "pdf": ("pdf",), "word": ("doc", "docx"), "excel": ("xls", "xlsx"), "powerpoint": ("ppt", "pptx"),
    "text": ("txt",), "csv": ("csv",), "json": ("json",), "xml": ("xml",), "zip": ("zip", "rar", "7z", "tar", "gz"),
    "image": ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico"),
    "video": ("mp4", "avi", "mov", "wmv", "flv", "webm", "mkv", "m4v"), "audio": ("mp3", "wav", "ogg", "m4a", "flac", "aac"),
}


def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in markers))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_pairs(url: Column) -> Column:
    """The query's parts, empty ones left out."""
    return F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")


def with_query(base: Column, pairs: Column) -> Column:
    q = F.array_join(F.array_sort(pairs), "&")
    return F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q))


def normalised(url: Column, drop: tuple[str, ...] = ("utm_source", "utm_medium", "utm_campaign", "fbclid")) -> Column:
    """Lower-case scheme and host, no trailing slash, sorted query without the named parameters, no fragment."""
    p = path(url)
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    kept = F.filter(query_pairs(url), lambda x: ~F.substring_index(x, "=", 1).isin(*drop))
    return with_query(F.concat(scheme(url), F.lit("://"), authority(url), p), kept)


def deduplicated(url: Column) -> Column:
    """As :func:`normalised`, without tracking parameters by their beginnings and without a language ending of the path."""
    p = F.regexp_replace(path(url), "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    keep = p.startswith("/en/") | (p == "/en")
    p = F.when(keep, p).otherwise(F.regexp_replace(p, r"\.(?:en|fr|es|it|de)$", ""))
    kept = F.filter(query_pairs(url), lambda x: ~F.lower(F.substring_index(x, "=", 1)).rlike("^(?:info|utm_|fbclid|gclid)"))
    return with_query(F.concat(scheme(url), F.lit("://"), authority(url), p), kept)


def crawlable(url: Column, base: Column) -> Column:
    low = F.lower(url)
    files = reduce(lambda a, b: a | b, (low.endswith(e) for e in FILE_ENDINGS))
    return url.startswith("http") & F.contains(url, base) & ~files & ~any_of(low, SHARES)


def fetch_error(url: Column) -> Column:
    """Why an address isn't fetched: scheme, blocked or private; null if it may be."""
    h = host(url)
    second = F.split(h, r"\.")
    in_range = F.try_element_at(second, F.lit(2)).try_cast("int").between(16, 31)
    private = h.startswith("10.") | h.startswith("192.168.") | (h.startswith("172.") & F.coalesce(in_range, F.lit(False)))
    return F.when(~scheme(url).isin("http", "https"), "scheme").when(h.isin(*BLOCKED), "blocked").when(private, "private")


def detectors(html: Column, url: Column) -> Column:
    """(login, cloudflare, captcha, script) of a page."""
    low, size = F.lower(html), F.length(html)
    signup = F.contains(low, F.lit("create new account"))
    form = F.contains(low, F.lit('id="email"'))
    login = F.contains(F.lower(url), F.lit("login")) | (form & signup) | ((size < 30_000) & F.contains(low, F.lit("log in")) & signup)
    return F.struct(
        login.alias("login"),
        any_of(low, CLOUDFLARE).alias("cloudflare"),
        any_of(low, CAPTCHA).alias("captcha"),
        (any_of(low, SCRIPT_NEEDED) & (size < 5_000)).alias("script"),
    )


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """The targets of anchors, each once, in order; scripts, mail and phone links are left out."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]+href="([^"]*)\""""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^(?:javascript|mailto|tel):") & (x != "")))


def quality(html: Column, url: Column, status: Column) -> Column:
    """(score, level): points for what a page has, less for what is wrong with it, from 0 to 100."""
    size, d = F.length(html), detectors(html, url)
    described = F.regexp_extract(html, r"""(?i)<meta[^>]+name="description"[^>]+content="([^"]+)\"""", 1) != ""
    rules = (
        (title(html) != "", 10), (size > 1000, 30), (F.size(links(html)) > 0, 10), (described, 10),
        ((size > 1000) & (size < 5_000_000), 10), (size < 200, -40), (d["cloudflare"], -50), (d["script"], -30),
        (d["login"], -20), (status != 200, -20),
    )
    raw = reduce(lambda a, b: a + b, (F.when(c, p).otherwise(0) for c, p in rules))
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    level = F.when(score >= 70, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("failed")
    return F.struct(score.alias("score"), level.alias("level"))


def content_type(url: Column, header: Column) -> Column:
    """By the header, else by the address's ending."""
    mime = F.trim(F.substring_index(F.lower(F.coalesce(header, F.lit(""))), ";", 1))
    by_mime = F.coalesce(*(F.when(mime == k, v) for k, v in MIME_TYPES.items()))
    ending = F.lower(F.regexp_extract(F.substring_index(url, "?", 1), r"[^/]\.([A-Za-z0-9]+)$", 1))
    by_ending = F.coalesce(*(F.when(ending.isin(*v), k) for k, v in ENDINGS.items()))
    return F.coalesce(by_mime, by_ending, F.lit("unknown"))


def robots(text: Column, bot: str = "scraperbot") -> Column:
    """(rules, delay, sitemaps) of a robots.txt: rules (agent, allow, prefix) in order; the delay is that of all or of the bot."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")),
    )
    start = F.struct(F.lit("*").alias("agent"), F.expr("cast(array() as array<struct<agent:string,k:string,v:string>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        agent = F.when(x["k"] == "user-agent", F.lower(x["v"])).otherwise(a["agent"])
        return F.struct(agent.alias("agent"), F.concat(a["out"], F.array(F.struct(agent.alias("agent"), x["k"].alias("k"), x["v"].alias("v")))).alias("out"))

    told = F.aggregate(pairs, start, step)["out"]
    rules = F.transform(
        F.filter(told, lambda x: x["k"].isin("allow", "disallow") & (x["v"] != "")),
        lambda x: F.struct(x["agent"].alias("agent"), (x["k"] == "allow").alias("allow"), x["v"].alias("prefix")),
    )
    delays = F.transform(F.filter(told, lambda x: (x["k"] == "crawl-delay") & x["agent"].isin("*", bot, f"{bot}/1.0")), lambda x: x["v"].try_cast("double"))
    sitemaps = F.array_distinct(F.transform(F.filter(told, lambda x: x["k"] == "sitemap"), lambda x: x["v"]))
    return F.struct(rules.alias("rules"), F.try_element_at(F.filter(delays, lambda x: x.isNotNull()), F.lit(-1)).alias("delay"), sitemaps.alias("sitemaps"))


def can_fetch(rules: Column, path_: Column, agent: str = "*") -> Column:
    """By the rules of the agent, or of all where it has none: the first whose prefix the path has decides."""
    own = F.filter(rules, lambda r: r["agent"] == agent)
    used = F.when(F.size(own) > 0, own).otherwise(F.filter(rules, lambda r: r["agent"] == "*"))
    hit = F.try_element_at(F.filter(used, lambda r: path_.startswith(r["prefix"])), F.lit(1))
    return F.coalesce(hit["allow"], F.lit(True))


def sitemap(xml: Column) -> Column:
    """(kind, pages, sitemaps): locations by the root, those of images and news too; of another root by their endings."""
    root = F.lower(F.regexp_extract(xml, r"<(?:[A-Za-z0-9]+:)?([A-Za-z]+)[\s>/]", 1))
    locs = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:[a-z0-9]+:)?loc>\s*([^<]+?)\s*</"), F.lit(1))
    kind = F.when(root.isin("urlset", "sitemapindex"), root).otherwise("unknown")
    none = F.array().cast("array<string>")
    more = lambda x: x.endswith(".xml") | x.endswith(".xml.gz") | F.contains(F.lower(x), F.lit("sitemap"))
    pages = F.when(kind == "urlset", locs).when(kind == "sitemapindex", none).otherwise(F.filter(locs, lambda x: ~more(x)))
    maps = F.when(kind == "sitemapindex", locs).when(kind == "urlset", none).otherwise(F.filter(locs, more))
    return F.struct(kind.alias("kind"), pages.alias("pages"), maps.alias("sitemaps"))


def sitemap_candidates(url: Column) -> Column:
    """Where a site's sitemap may be, in the order in which it is looked for."""
    base = F.concat(scheme(url), F.lit("://"), authority(url))
    return F.array_distinct(F.array(*(F.concat(base, F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml"))))


def breakdown(html: Column, url: Column, status: Column) -> Column:
    """The rules of :func:`quality` that a page meets, as name:points."""
    size, d = F.length(html), detectors(html, url)
    described = F.regexp_extract(html, r"""(?i)<meta[^>]+name="description"[^>]+content="([^"]+)\"""", 1) != ""
    rules = (
        ("title", title(html) != "", 10), ("content", size > 1000, 30), ("links", F.size(links(html)) > 0, 10), ("description", described, 10),
        ("size", (size > 1000) & (size < 5_000_000), 10), ("tiny", size < 200, -40), ("cloudflare", d["cloudflare"], -50),
        ("script", d["script"], -30), ("login", d["login"], -20), ("status", status != 200, -20),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(f"{n}:{p:+d}")) for n, c, p in rules)))


def saved_name(url: Column, override: Column, prefix: str = "") -> Column:
    """The name of a downloaded file: the given one, that of the address if its ending can be read, or a hash."""
    last = F.regexp_extract(path(url), "([^/]*)$", 1)
    known = F.lower(F.regexp_extract(last, r"\.([^.]+)$", 1)).isin(*SUPPORTED)
    hashed = F.concat(F.lit(f"{prefix}cloud_doc_"), F.substring(F.sha1(url), 1, 10), F.lit(".pdf"))
    name = F.coalesce(F.nullif(override, F.lit("")), F.when(known, F.concat(F.lit(prefix), last)), hashed)
    clean = F.trim(F.regexp_replace(name, r'[\\/*?:"<>|]', "_"))
    return F.when(clean == "", "downloaded_document").otherwise(clean)
