"""Queries and cases of parsers, guards, OCR results and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions import ocr
from heronlake.functions import posts as P
from heronlake.functions import tables as O
from heronlake.functions import text as X
from heronlake.functions import web
from heronlake.plans.registry import case, query
from heronlake.sources.scratch import once, scratch, stored
from heronlake.sources.store import Layout, Store
from heronlake.sources.tables import table


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _values(values: list, names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in values)}) t({names})"


COUNTS = [("1.2K", 1200), ("3M", 3_000_000), ("1,234", 1234), ("", 0), ("abc", 0), ("7 likes", 0), ("7 shares", 7), (None, 0)]


@case(f"SELECT coalesce(s, '-') AS s, n::BIGINT AS n FROM {_values(COUNTS, 's, n')}")
def parse_count(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, [(s,) for s, _ in COUNTS], "s string")
    return rows.select(F.coalesce("s", F.lit("-")).alias("s"), X.parse_count(F.col("s")).alias("n"))


@query("SELECT event_id, strftime(to_timestamp(1700000000 + event_id * 61), '%Y-%m-%d %H:%M') AS at FROM events")
def unix_date(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 61), "yyyy-MM-dd HH:mm")
    return table(spark, d, "events").select("event_id", at.alias("at"))


DATES = [
    ("3 hours ago", "2024-05-15 09:00"), ("2 days ago", "2024-05-13 12:00"), ("2 months ago", "2024-03-16 12:00"), ("30 seconds ago", "2024-05-15 11:59"),
    ("Yesterday", "2024-05-14 00:00"), ("Yesterday at 3:45 PM", "2024-05-14 15:45"), ("just now", "2024-05-15 12:00"), ("5m", "2024-05-15 11:55"), ("2 h", "2024-05-15 10:00"),
    ("3d", "2024-05-12 12:00"), ("1w", "2024-05-08 12:00"), ("2024-01-02T03:04:05", "2024-01-02T03:04"), ("Monday at 10:00 AM", "2024-05-13 10:00"), ("Wednesday", "2024-05-08 00:00"),
    ("June 15 at 2:30 PM", "2023-06-15 14:30"), ("March 5", "2024-03-05 00:00"), ("March 5, 2023", "2023-03-05 00:00"), ("December 1, 2022 at 12:05 am", "2022-12-01 00:05"), ("odd", "odd"), ("", ""),
]


def human_date_column(text: Column, now: Column) -> Column:
    """A date in words as yyyy-MM-dd HH:mm, relative to ``now``; dates and what isn't known as they are."""
    t, low = F.trim(text), F.lower(F.trim(text))
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    n = F.regexp_extract(low, r"^([0-9]+)", 1).try_cast("bigint")
    named = F.coalesce(F.nullif(F.regexp_extract(low, r"^[0-9]+\s+(second|minute|hour|day|week|month)s?\s+ago", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"^[0-9]+\s*([mhdw])$", 1), F.lit("")))
    seconds = F.coalesce(*(F.when(named == k, F.lit(v)) for k, v in units.items()))
    relative = F.timestamp_seconds(F.unix_seconds(now) - n * seconds)
    # an hour in words, or midnight
    clock = r"([0-9]{1,2}):([0-9]{2})\s*(am|pm)?"
    hour, minute, half = (F.regexp_extract(low, clock, i) for i in (1, 2, 3))
    h = F.coalesce(hour.try_cast("int"), F.lit(0))
    h = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(h)
    m = F.coalesce(minute.try_cast("int"), F.lit(0))
    day = F.to_date(now)
    weekdays = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    back = F.coalesce(*(F.when(low.startswith(w), F.when(F.pmod(F.weekday(day) - i, F.lit(7)) == 0, 7).otherwise(F.pmod(F.weekday(day) - i, F.lit(7)))) for i, w in enumerate(weekdays)))
    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    month = F.coalesce(*(F.when(low.rlike(rf"{w}\s+[0-9]"), F.lit(i)) for i, w in enumerate(months, 1)))
    number = F.regexp_extract(low, rf"(?:{'|'.join(months)})\s+([0-9]{{1,2}})", 1).try_cast("int")
    told = F.regexp_extract(t, r"\b(20[0-9]{2})\b", 1).try_cast("int")
    year = F.coalesce(told, F.year(day))
    year = F.when((year == F.year(day)) & (month > F.month(day)), year - 1).otherwise(year)
    on = F.when(F.contains(low, F.lit("yesterday")), F.date_sub(day, 1)).when(back.isNotNull(), F.date_sub(day, back)).when(month.isNotNull(), F.make_date(year, month, number))
    timed = F.concat(F.date_format(on, "yyyy-MM-dd"), F.format_string(" %02d:%02d", h, m))
    form = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(t, 1, 16)).otherwise(
        F.coalesce(form(relative), timed, F.when(F.contains(low, F.lit("just now")), form(now)), t)
    )


@case(f"SELECT s, d AS at FROM {_values(DATES, 's, d')}")
def human_date(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, [(s,) for s, _ in DATES], "s string")
    return rows.select("s", human_date_column(F.col("s"), F.lit("2024-05-15 12:00:00").cast("timestamp")).alias("at"))


NAME_CASES = [("a b/c.pdf", "abc.pdf"), ("Ünï_1-2.txt", "Ünï_1-2.txt"), ("///", "file"), ("", "file")]


@case(f"SELECT s, n AS name FROM {_values(NAME_CASES, 's, n')}")
def filename_cases(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(s,) for s, _ in NAME_CASES], "s string").select("s", X.clean_name(F.col("s")).alias("name"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(url, '[^\p{L}\p{Nl}\p{M}\p{N}._-]', '', 'g'), ''), 'file') AS name,
  coalesce(nullif(regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '[^\p{L}\p{N}._-]', '', 'g'), ''), 'file') AS titled FROM pages""")
def filename_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """File names from addresses and titles."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", X.clean_name(F.col("url")).alias("name"), X.clean_name(title).alias("titled"))


_QUERY = r"replace(regexp_extract(url, '\?([^#]*)', 1), '&', '; ')"


@query(f"""SELECT page_id, array_to_string(list_transform(p, lambda x: trim(split_part(x, '=', 1)) || ':' || trim(substr(x, strpos(x, '=') + 1))), ',') AS pairs,
  array_to_string(list_transform(p, lambda x: trim(split_part(x, '=', 1)) || '=' || trim(substr(x, strpos(x, '=') + 1))), '; ') AS back
FROM (SELECT page_id, list_filter(string_split('page=' || page_id || '; flag; ' || {_QUERY}, ';'), lambda x: contains(x, '=')) AS p FROM pages)""")
def cookie_map(spark: SparkSession, d: str) -> DataFrame:
    """Name and value of each cookie, and the string that they make; a page's cookies are its number and its parameters."""
    text = F.concat(F.lit("page="), F.col("page_id"), F.lit("; flag; "), F.replace(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit("; ")))
    parts = F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    rows = table(spark, d, "pages").select("page_id", pairs.alias("p"))
    joined = lambda mid, end: F.array_join(F.transform("p", lambda x: F.concat(x["k"], F.lit(mid), x["v"])), end)
    return rows.select("page_id", joined(":", ",").alias("pairs"), joined("=", "; ").alias("back"))


DRIVE = [
    ("https://drive.example.com/drive/folders/abc_123-x?usp=s", "folder", "abc_123-x"), ("https://drive.example.com/file/d/F99/view", "file", "F99"),
    ("https://drive.example.com/open?id=ZZ1", "file", "ZZ1"), ("1AbCdEfGhIjKlMnOp", "file", "1AbCdEfGhIjKlMnOp"),
]


@case(f"SELECT s, k AS kind, i AS id FROM {_values(DRIVE, 's, k, i')}")
def drive_id(spark: SparkSession, d: str) -> DataFrame:
    folder = F.nullif(F.regexp_extract("s", "/folders/([A-Za-z0-9_-]+)", 1), F.lit(""))
    file = F.coalesce(F.nullif(F.regexp_extract("s", "/d/([A-Za-z0-9_-]+)", 1), F.lit("")), F.nullif(F.regexp_extract("s", "[?&]id=([A-Za-z0-9_-]+)", 1), F.lit("")))
    rows = _rows(spark, [(s,) for s, *_ in DRIVE], "s string")
    return rows.select("s", F.when(folder.isNotNull(), "folder").otherwise("file").alias("kind"), F.coalesce(folder, file, "s").alias("id"))


PROVIDERS = [
    ("AIzaX", "", "", "gemini"), ("", "https://generativelanguage.googleapis.com/v1", "m", "gemini"), ("", "", "gemini-x", "gemini"),
    ("sk-ant1", "", "", "anthropic"), ("k", "https://api.anthropic.com", "", "anthropic"), ("k", "http://localhost", "llama", "openai_compatible"),
]


@case(f"SELECT a, b, c, p AS provider FROM {_values(PROVIDERS, 'a, b, c, p')}")
def provider_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, [r[:3] for r in PROVIDERS], "a string, b string, c string")
    return rows.select("a", "b", "c", X.provider(F.col("a"), F.col("b"), F.col("c")).alias("provider"))


UPLOADS = [("a.txt", 10, None), ("noext", 10, "extension"), ("a.exe", 10, "type"), ("A.PDF", 104857601, "size"), ("b.pdf", 104857600, None)]
#: Endings that may be uploaded.
ALLOWED = "txt md pdf doc docx xls xlsx ppt pptx csv json xml html htm png jpg jpeg gif bmp tiff tif webp svg epub rtf".split()


@case(f"SELECT s, n::BIGINT AS n, e AS error FROM {_values(UPLOADS, 's, n, e')}")
def upload_guard(spark: SparkSession, d: str) -> DataFrame:
    ending = F.lower(F.regexp_extract("s", r"\.([^.]+)$", 1))
    error = F.when(ending == "", "extension").when(~ending.isin(*ALLOWED), "type").when(F.col("n") > 100 << 20, "size")
    return _rows(spark, [r[:2] for r in UPLOADS], "s string, n bigint").select("s", "n", error.alias("error"))


OCR_UPLOADS = [
    ("a.png", "89504E470D0A1A0A", None), ("a.gif", "47494638", "UNSUPPORTED_FORMAT"), ("a.pdf", "", "EMPTY_FILE"),
    ("b.pdf", "00112233", "CORRUPTED_FILE"), ("c.pdf", "255044462D312E34", None), ("d.jpg", "FFD8FFE0", None),
]


@case(f"SELECT s, h, e AS error FROM {_values(OCR_UPLOADS, 's, h, e')}")
def ocr_upload_guard(spark: SparkSession, d: str) -> DataFrame:
    ending = F.lower(F.regexp_extract("s", r"\.([^.]+)$", 1))
    content = F.unhex("h")
    head = F.hex(F.substring(content, 1, 8))
    good = (
        (ending.isin("png") & head.startswith("89504E47")) | (ending.isin("jpg", "jpeg") & head.startswith("FFD8FF"))
        | (ending.isin("pdf") & head.startswith("25504446"))
    )
    error = (
        F.when(~ending.isin("png", "jpg", "jpeg", "pdf"), "UNSUPPORTED_FORMAT").when(F.length(content) == 0, "EMPTY_FILE")
        .when(F.length(content) > 10 << 20, "FILE_TOO_LARGE").when(~good, "CORRUPTED_FILE")
    )
    return _rows(spark, [r[:2] for r in OCR_UPLOADS], "s string, h string").select("s", "h", error.alias("error"))


SITEMAPS = [
    ("<urlset><url><loc>https://a/1</loc></url><url><loc> https://a/2 </loc></url></urlset>", "urlset", "https://a/1,https://a/2|"),
    ("<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>", "sitemapindex", "|https://a/s.xml"),
    ('<?xml version="1.0"?><n:urlset xmlns:n="u"><n:url><n:loc>https://a/1</n:loc><image:image><image:loc>https://a/i.png</image:loc></image:image></n:url></n:urlset>', "urlset", "https://a/1,https://a/i.png|"),
    ("<rss><loc>https://a/p</loc><loc>https://a/m.xml.gz</loc><loc>https://a/SiteMap/2</loc></rss>", "unknown", "https://a/p|https://a/m.xml.gz,https://a/SiteMap/2"),
    ("<rss/>", "unknown", "|"),
]


@case(f"SELECT x, k AS kind, l AS locs FROM {_values(SITEMAPS, 'x, k, l')}")
def sitemap_locs(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, [(x,) for x, *_ in SITEMAPS], "x string").withColumn("s", web.sitemap(F.col("x")))
    return rows.select("x", "s.kind", F.concat_ws("|", F.array_join("s.pages", ","), F.array_join("s.sitemaps", ",")).alias("locs"))


#: Regions of a page as an engine gives them: the words of a document, each with a box by its place, and as sure as it is long.
_REGION = """(SELECT page, idx, txt, (length(txt) % 11) / 10.0::DOUBLE AS conf, idx % 10 * 60 AS x1, idx // 10 * 20 AS y1, idx % 10 * 60 + 8 * length(txt) AS x2, idx // 10 * 20 + 18 AS y2
FROM (SELECT doc_id AS page, unnest(range(0, len(w)))::INT AS idx, unnest(w) AS txt FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))"""


def _regions(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", " ")).alias("idx", "txt"))
    return words.selectExpr("page", "idx", "txt", "length(txt) % 11 / 10.0D AS conf", "idx % 10 * 60 AS x1", "idx div 10 * 20 AS y1", "idx % 10 * 60 + 8 * length(txt) AS x2", "idx div 10 * 20 + 18 AS y2")


@query(f"""SELECT page, idx, txt, x1, y1, x2, y2 FROM {_REGION} WHERE conf >= 0.5 AND txt <> ''""")
def region_filter(spark: SparkSession, d: str) -> DataFrame:
    """Regions that are sure and not empty, with the box of their polygon."""
    corners = F.array(F.array("x2", "y1"), F.array("x1", "y1"), F.array("x1", "y2"), F.array("x2", "y2"))
    line = F.array(F.struct(corners.alias("polygon"), F.col("txt").alias("text"), F.col("conf").alias("confidence")))
    found = _regions(spark, d).select("page", "idx", F.explode(O.regions(line)).alias("r"))
    return found.select("page", "idx", F.col("r.text").alias("txt"), "r.x1", "r.y1", "r.x2", "r.y2")


@query(f"""SELECT page, round(c, 6)::DOUBLE AS confidence, round(avg(c) OVER (), 6)::DOUBLE AS document FROM (SELECT page, avg(conf) FILTER (conf > 0) AS c FROM {_REGION} GROUP BY page)""")
def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The mean of a page's positive confidences, and the mean of the pages."""
    pages = _regions(spark, d).groupBy("page").agg(F.avg(F.when(F.col("conf") > 0, F.col("conf"))).alias("c"))
    whole = pages.agg(F.round(F.avg("c"), 6).alias("document"))
    return pages.join(F.broadcast(whole)).select("page", F.round("c", 6).alias("confidence"), "document")  # one row


@query(f"""SELECT round(avg(conf), 6)::DOUBLE AS mean, min(conf)::DOUBLE AS low, max(conf)::DOUBLE AS high, round(sum(length(txt)) * 3 / 4.5, 4)::DOUBLE AS per_second, 1.5::DOUBLE AS seconds FROM {_REGION}""")
def region_stats(spark: SparkSession, d: str) -> DataFrame:
    """Confidence, characters a second and the mean time of three runs of 1, 1.5 and 2 seconds."""
    runs = _rows(spark, [(1.0,), (1.5,), (2.0,)], "s double").agg(F.avg("s").alias("seconds"))
    r = _regions(spark, d).agg(F.round(F.avg("conf"), 6).alias("mean"), F.min("conf").alias("low"), F.max("conf").alias("high"), F.sum(F.length("txt")).alias("n"))
    return r.join(F.broadcast(runs)).select("mean", "low", "high", F.round(F.col("n") / F.col("seconds"), 4).alias("per_second"), "seconds")  # one row


@query(f"""SELECT page || ',' || idx || ',"' || replace(txt, '"', '""') || '",' || printf('%.4f', conf::DOUBLE) || ',' || x1 || ',' || y1 || ',' || x2 || ',' || y2 AS line FROM {_REGION}""")
def region_csv(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.replace("txt", F.lit('"'), F.lit('""'))
    return _regions(spark, d).select(F.format_string('%d,%d,"%s",%.4f,%d,%d,%d,%d', "page", "idx", quoted, "conf", "x1", "y1", "x2", "y2").alias("line"))


@query(f"SELECT page, idx, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area FROM {_REGION}")
def bbox_area(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d).selectExpr("page", "idx", "x2 - x1 AS width", "y2 - y1 AS height", "(x2 - x1) * (y2 - y1) AS area")


@query(f"SELECT sum(length(trim(txt)))::BIGINT < 20 * count(DISTINCT page) AS scanned, bool_or(length(txt) > 50) AS digital FROM {_REGION}")
def scanned_pdf(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(spark, d)
    return r.agg((F.sum(F.length(F.trim("txt"))) < 20 * F.countDistinct("page")).alias("scanned"), F.bool_or(F.length("txt") > 50).alias("digital"))


_ENGINES = """(SELECT doc_id, engine, priority, CASE WHEN (doc_id + priority) % 4 = 0 THEN NULL WHEN (doc_id + priority) % 4 = 1 THEN '  ' ELSE left(text, 10 + priority) END AS text,
  CASE WHEN (doc_id * 7 + priority) % 3 = 0 THEN 'timeout' END AS error FROM documents, (VALUES ('cloud', 0), ('local', 1), ('table', 2)) e(engine, priority))"""


@query(f"""SELECT doc_id, coalesce(arg_min(engine, priority) FILTER (error IS NULL AND trim(coalesce(text, '')) <> ''), 'none') AS engine,
  coalesce(arg_min(text, priority) FILTER (error IS NULL AND trim(coalesce(text, '')) <> ''), '') AS text FROM {_ENGINES} GROUP BY doc_id""")
def engine_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Of the results of several engines the first, by priority, without an error and with a text."""
    results = F.expr("""transform(array('cloud', 'local', 'table'), (e, p) -> struct(p AS priority, e AS engine,
      CASE WHEN (doc_id + p) % 4 = 0 THEN NULL WHEN (doc_id + p) % 4 = 1 THEN '  ' ELSE left(text, 10 + p) END AS text, CASE WHEN (doc_id * 7 + p) % 3 = 0 THEN 'timeout' END AS error))""")
    found = table(spark, d, "documents").select("doc_id", O.first_result(results).alias("r"))
    return found.select("doc_id", F.coalesce("r.engine", F.lit("none")).alias("engine"), F.coalesce("r.text", F.lit("")).alias("text"))


ORDERS = [("nemotron", "nemotron,mistral", "nemotron,mistral,paddle"), ("mistral", "nemotron", "nemotron,paddle"), ("mistral", "mistral,nemotron", "mistral,nemotron,paddle"), ("paddle", "mistral", "paddle,mistral"), ("x", "", "paddle")]


@case(f"SELECT p, k, o AS engines FROM {_values(ORDERS, 'p, k, o')}")
def engine_order(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [r[:2] for r in ORDERS], "p string, k string").select("p", "k", F.array_join(O.engine_order(F.col("p"), F.split("k", ",")), ",").alias("engines"))


_PDF = "(SELECT doc_id, i AS page, t, doc_id % 5 = 0 AND i = 1 AS image FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@query(f"""SELECT doc_id, bool_or(length(t) > 50) AS digital, sum(length(trim(t))) < 20 * count(*) AS scanned, count(*) FILTER (image OR length(trim(t)) < 20)::BIGINT AS ocr_pages FROM {_PDF} GROUP BY doc_id""")
def pdf_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pages are the lines of a document. It is digital if any has over 50 characters; a page with an image or under 20 goes
    to recognition."""
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    image = (F.col("doc_id") % 5 == 0) & (F.col("i") == 0)
    return pages.groupBy("doc_id").agg(
        F.bool_or(F.length("t") > 50).alias("digital"), (F.sum(F.length(F.trim("t"))) < 20 * F.count(F.lit(1))).alias("scanned"),
        F.count_if(image | (F.length(F.trim("t")) < 20)).alias("ocr_pages"),
    )


_MARKDOWN = "'# T' || chr(10) || chr(10) || '![i](u) [a](b) **x**' || chr(10) || chr(10) || text"
for _pattern, _to in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]*)\*\*", r"\1"), (r"\*([^*]*)\*", r"\1"), (r"\n{3,}", "\n\n")):
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_pattern}', '{_to}', 'g')"


@query(f"""SELECT doc_id, plain AS full_text, doc_id % 7 + 1 AS page_number, 1 AS n_tables, 2 AS n_links, len(list_filter(string_split(plain, chr(10)), lambda l: trim(l) <> ''))::INT AS n_lines
FROM (SELECT doc_id, trim({_MARKDOWN}) AS plain FROM documents)""")
def cloud_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a cloud engine's JSON answer: the Markdown as plain text, with its lines, tables and links."""
    docs = table(spark, d, "documents")
    page = F.struct((F.col("doc_id") % 7).alias("index"), F.concat(F.lit("# T\n\n![i](u) [a](b) **x**\n\n"), "text").alias("markdown"), F.array(F.struct(F.lit("<table/>").alias("content"))).alias("tables"), F.array(F.lit("u"), F.lit("b")).alias("hyperlinks"))
    answer = F.to_json(F.struct(F.array(page).alias("pages")))
    pages = docs.select("doc_id", F.explode(F.from_json(answer, "pages array<struct<index:bigint,markdown:string,tables:array<struct<content:string>>,hyperlinks:array<string>>>")["pages"]).alias("p"))
    plain = X.markdown_plain(F.col("p.markdown"))
    lines = F.filter(F.split(plain, "\n"), lambda x: F.trim(x) != "")
    return pages.select("doc_id", plain.alias("full_text"), (F.col("p.index") + 1).alias("page_number"), F.size("p.tables").alias("n_tables"), F.size("p.hyperlinks").alias("n_links"), F.size(lines).alias("n_lines"))


ALIGNED = [
    ("Product    Qty  Price\nApple      10   50.00\nOrange     5    30.00", 1, "Product|Qty|Price;Apple|10|50.00;Orange|5|30.00"), ("a  b  c", 0, ""), ("a  b  c\nplain\nplain too\nmore", 0, ""),
    ("x  y  z\n1  2  3\n\ntext here\n\nk   l   m\n1   2   3\n4   5   6", 2, "x|y|z;1|2|3;k|l|m;1|2|3;4|5|6"), ("", 0, ""),
]


@case(f"SELECT s, n AS n_tables, c AS cells FROM {_values(ALIGNED, 's, n, c')}")
def aligned_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose columns are aligned by blanks."""
    rows = _rows(spark, [(i, s) for i, (s, *_) in enumerate(ALIGNED)], "i int, s string")
    found = O.apply(rows, "i", "s", "n_tables int, cells string", lambda t: [(len(x := O.aligned_tables(t)), ";".join("|".join(r) for table_ in x for r in table_))])
    return rows.join(found, "i").select("s", "n_tables", "cells")


@query("""SELECT doc_id, ((len(string_split(text, chr(10))) >= 0)::INT + (doc_id % 3 = 0)::INT)::INT AS planted FROM documents""")
def all_tables(spark: SparkSession, d: str) -> DataFrame:
    """Drawn and aligned tables of every document, where one of the first kind, and in every third one of the second, is
    planted; those of the text itself are counted apart."""
    drawn, spaced = "+--+--+\n| a | b |\n+--+--+\n| 1 | 2 |\n+--+--+", "k    l    m\n1    2    3"
    plant = F.concat(F.lit(drawn), F.when(F.col("doc_id") % 3 == 0, F.lit(f"\n\n{spaced}")).otherwise(""))
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(plant, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("t"))
    both = docs.select("doc_id", (F.size(ocr.tables(F.col("t"))) - F.size(ocr.tables(F.coalesce("text", F.lit(""))))).alias("n"), "t", "text")
    more = O.apply(both, "doc_id", "t", "m int", lambda t: [(len(O.aligned_tables(t)),)]).join(O.apply(both, "doc_id", "text", "own int", lambda t: [(len(O.aligned_tables(t)),)]), "doc_id")
    return both.join(more, "doc_id").select("doc_id", (F.col("n") + F.col("m") - F.col("own")).cast("int").alias("planted"))


@query("""SELECT doc_id, 1 + (doc_id % 2)::INT * 2 AS runs, CASE WHEN doc_id % 2 = 1 THEN 'urdu,chinese,english' ELSE 'english' END AS languages FROM documents""")
def script_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one script in the Latin texts, with two others planted before every second."""
    plant = F.when(F.col("doc_id") % 2 == 1, F.lit("سلام 12 漢字 ")).otherwise("")
    rows = table(spark, d, "documents").select("doc_id", F.concat(plant, F.lit("a "), "text").alias("t"))
    return O.apply(rows, "doc_id", "t", "runs int, languages string", lambda t: [(len(x := O.script_runs(t)), ",".join(k or "-" for k, _ in x))])


HINTED = [("Urdu", 1, 1, 1, 1, 1), ("arabic", 1, 1, 1, 1, 1), ("hindi", 0, 1, 1, 1, 0), ("chinese", 0, 1, 0, 1, 1), ("japanese", 0, 1, 0, 1, 1), ("english", 0, 0, 0, 0, 0), ("klingon", 0, 0, 0, 0, 0)]


@case(f"SELECT l, r AS rtl, a AS denoise, b AS shadows, c AS sharpen, e AS exposure FROM {_values(HINTED, 'l, r, a, b, c, e')}")
def language_hints(spark: SparkSession, d: str) -> DataFrame:
    h = O.hints(F.col("l"))
    return _rows(spark, [r[:1] for r in HINTED], "l string").select("l", *(h[x].cast("int").alias(x) for x in ("rtl", "denoise", "shadows", "sharpen", "exposure")))


@query("""SELECT doc_id, 'english' AS language, 0 AS rtl, 1 AS n_tables, len(string_split(text, chr(10)))::INT AS n_chunks FROM documents""")
def enhanced_result(spark: SparkSession, d: str) -> DataFrame:
    """What recognition adds to a text: its language, hints, tables (one is planted) and pieces."""
    drawn = "+--+--+\n| a | b |\n+--+--+\n| 1 | 2 |\n+--+--+\n\n"
    rows = table(spark, d, "documents").select("doc_id", "text", X.script_language(F.col("text"))["language"].alias("language"))
    tables_ = F.size(ocr.tables(F.concat(F.lit(drawn), "text"))) - F.size(ocr.tables(F.col("text")))
    return rows.select("doc_id", "language", O.hints(F.col("language"))["rtl"].cast("int").alias("rtl"), tables_.alias("n_tables"), F.size(F.split("text", "\n")).alias("n_chunks"))


@query("""SELECT p_partkey, round(e, 6) AS entropy, p_size < 30 OR e < 1.5 AS decorative, p_size > 100 OR (p_size > 20 AND dark > 0.1) AS content FROM (
SELECT p_partkey, p_size, list_entropy(px) AS e, len(list_filter(px, lambda x: x < 200)) / len(px)::DOUBLE AS dark FROM (
SELECT p_partkey, p_size, list_transform(range(0, 64), lambda i: (i * p_partkey) % (1 + p_partkey % 9) * 25) AS px FROM part))""")
def image_filters(spark: SparkSession, d: str) -> DataFrame:
    """An image is decorative by a short side or low entropy of its grey levels, and content by its size and dark share."""
    px = F.expr("transform(sequence(0, 63), i -> cast((i * p_partkey) % (1 + p_partkey % 9) * 25 AS int))")
    rows = table(spark, d, "part").select("p_partkey", "p_size", px.alias("px"))
    shares = F.transform(F.array_distinct("px"), lambda v: F.size(F.filter("px", lambda x: x == v)) / F.size("px"))
    entropy = F.aggregate(shares, F.lit(0.0), lambda t, q: t - q * F.log2(q))
    dark = F.size(F.filter("px", lambda x: x < 200)) / F.size("px")
    rows = rows.select("p_partkey", "p_size", entropy.alias("e"), dark.alias("dark"))
    return rows.select("p_partkey", F.round("e", 6).alias("entropy"), ((F.col("p_size") < 30) | (F.col("e") < 1.5)).alias("decorative"), ((F.col("p_size") > 100) | ((F.col("p_size") > 20) & (F.col("dark") > 0.1))).alias("content"))


#: The posts that :func:`_posts` plants in page sources, as DuckDB has them.
_POSTS = r"""(SELECT conv_id, turn, role, conv_id || '_' || turn AS id, trim(regexp_replace(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g')) AS caption,
  strftime(to_timestamp(1700000000 + conv_id * 1000 + turn), '%Y-%m-%d %H:%M') AS posted_at, length(text)::BIGINT AS likes, turn AS comments,
  CASE role WHEN 'user' THEN 'video' WHEN 'assistant' THEN 'image' END AS media_type,
  CASE role WHEN 'user' THEN 'https://v.example/' || conv_id || '_' || turn || '.mp4' WHEN 'assistant' THEN 'https://i.example/' || conv_id || '_' || turn || '.jpg' END AS media_url FROM conversations)"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts extracted from page sources: one for each conversation, whose turns are post nodes in a JSON payload."""
    c = table(spark, d, "conversations")
    key = F.concat_ws("_", "conv_id", "turn")
    video = F.struct(F.concat(F.lit("https://v.example/"), key, F.lit(".m4a?type=audio")).alias("browser_native_hd_url"), F.concat(F.lit("https://v.example/"), key, F.lit(".mp4")).alias("playable_url"))
    image = F.struct(F.struct(F.struct(F.concat(F.lit("https://i.example/"), key, F.lit(".jpg")).alias("uri")).alias("image")).alias("node"))
    node = F.struct(
        F.lit("Story").alias("__typename"), key.alias("id"), (F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("creation_time"),
        F.concat(F.when(F.col("turn") % 2 == 0, "https://f.example/reel/").otherwise("https://f.example/posts/"), key).alias("permalink_url"),
        F.struct(F.col("text")).alias("message"),
        F.array(F.struct(F.when(F.col("role") == "user", video).alias("video"), F.when(F.col("role") == "assistant", image).alias("media"))).alias("attachments"),
        F.struct(F.struct(F.length("text").alias("count")).alias("reaction_count"), F.struct(F.col("turn").alias("total_count")).alias("comment_count")).alias("feedback"),
    )
    pages = c.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct(node.alias("node"))).alias("edges"))).alias("js"))
    source = F.concat(F.lit('<html><script type="application/json">'), "js", F.lit("</script></html>"))
    return once(spark, d, "conversations", "posts", lambda: P.extracted(pages.select("conv_id", source.alias("s")), "conv_id", "s"))


@query("""SELECT conv_id, turn, total FROM (SELECT conv_id, turn, count(*) OVER ()::BIGINT AS total FROM conversations
WHERE text ILIKE '%the%' AND role = 'user' AND text >= 'A' AND text <= 'Z') ORDER BY conv_id DESC, turn DESC LIMIT 20 OFFSET 10""")
def post_paging(spark: SparkSession, d: str) -> DataFrame:
    """A page of the filtered rows with their number; a blank filter is passed over."""
    t = table(spark, d, "conversations")
    for name, test in (("the", F.col("text").ilike("%the%")), ("", F.col("text").ilike("%%")), ("user", F.col("role") == "user"), ("A", F.col("text") >= "A"), ("Z", F.col("text") <= "Z")):
        t = t.where(test) if name else t
    total = t.agg(F.count(F.lit(1)).alias("total"))
    return t.orderBy(F.desc("conv_id"), F.desc("turn")).offset(10).limit(20).select("conv_id", "turn").join(F.broadcast(total))  # one row


@query(f"""SELECT count(DISTINCT conv_id)::BIGINT AS sessions, count(*) FILTER (NOT reel)::BIGINT AS posts, count(*) FILTER (reel)::BIGINT AS reels,
  count(media_url)::BIGINT AS with_media, (SELECT string_agg(conv_id, ',' ORDER BY conv_id DESC) FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 20)) AS newest
FROM (SELECT *, role = 'user' AS reel FROM {_POSTS})""")
def post_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts, and the 20 newest pages by their last session."""
    p = _posts(spark, d).withColumn("reel", P.classified(F.col("media"), F.col("url")) == "reel")
    newest = p.groupBy("conv_id").agg(F.max("conv_id").alias("last")).orderBy(F.desc("last")).limit(20)
    newest = newest.agg(F.array_join(F.sort_array(F.collect_list("conv_id"), asc=False), ",").alias("newest"))
    counts = p.agg(
        F.countDistinct("conv_id").alias("sessions"), F.count_if(~F.col("reel")).alias("posts"), F.count_if("reel").alias("reels"),
        F.count_if(F.size("media") > 0).alias("with_media"),
    )
    return counts.join(F.broadcast(newest))  # one row on each side


@query(f"""SELECT id, CASE WHEN role = 'user' THEN 'reel' ELSE 'post' END AS kind FROM {_POSTS}""")
def post_classify(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("id", P.classified(F.col("media"), F.col("url")).alias("kind"))


@query("""SELECT c.conv_id, c.turn, s.first_role FROM conversations c JOIN (SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id) s USING (conv_id)""")
def post_session_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.join(c.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role")), "conv_id").select("conv_id", "turn", "first_role")


@query("SELECT conv_id, turn, 'post' AS kind FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 'reel' FROM conversations WHERE role = 'assistant'")
def post_type_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    a = c.where("role = 'user'").withColumn("kind", F.lit("post"))
    return a.unionByName(c.where("role = 'assistant'").withColumn("kind", F.lit("reel"))).drop("role")


@query(f"""SELECT id, concat_ws(chr(10) || chr(10), nullif('**' || posted_at || '**', '****'), nullif(caption, ''), CASE WHEN media_url IS NOT NULL THEN '![' || media_type || '](' || media_url || ')' END,
  'Likes: ' || likes || ' | Comments: ' || comments) AS md FROM {_POSTS}""")
def post_markdown(spark: SparkSession, d: str) -> DataFrame:
    p = _posts(spark, d)
    date = F.when(F.col("posted_at") != "", F.concat(F.lit("**"), "posted_at", F.lit("**")))
    shown = F.transform("media", lambda m: F.concat(F.lit("!["), m["type"], F.lit("]("), m["url"], F.lit(")")))
    counts = F.format_string("Likes: %d | Comments: %d", "likes", "comments")
    return p.select("id", F.concat_ws("\n\n", date, F.nullif("caption", F.lit("")), F.nullif(F.array_join(shown, "\n"), F.lit("")), counts).alias("md"))


@query(f"""SELECT id, CASE WHEN media_url IS NULL THEN '' ELSE media_url END AS image, replace(posted_at, 'T', ' ')[1:16] AS date FROM {_POSTS} WHERE conv_id IN (9, 4, 7) ORDER BY list_position([9, 4, 7], conv_id), comments""")
def post_export_order(spark: SparkSession, d: str) -> DataFrame:
    """Posts in the order of a list of sessions, with the image to show: the first image, else a video's thumb or address."""
    pos = F.array_position(F.array(*(F.lit(i).cast("bigint") for i in (9, 4, 7))), F.col("conv_id"))
    first = lambda kind: F.try_element_at(F.filter("media", lambda m: m["type"] == kind), F.lit(1))
    image = F.coalesce(first("image")["url"], F.nullif(first("video")["thumb"], F.lit("")), first("video")["url"], F.lit(""))
    return _posts(spark, d).where(pos > 0).orderBy(pos, "comments").select("id", image.alias("image"), F.substring(F.replace("posted_at", F.lit("T"), F.lit(" ")), 1, 16).alias("date"))


@query("SELECT conv_id, turn FROM conversations ORDER BY text DESC, conv_id, turn LIMIT 30")
def post_newest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").orderBy(F.desc("text"), "conv_id", "turn").limit(30).select("conv_id", "turn")


MARKDOWN = [("# T\n\n![i](u) [a](b) **x** *y*\n\n\n\nz", "T\n\n a x y\n\nz"), ("plain", "plain")]


@case(f"SELECT s, p AS plain FROM {_values(MARKDOWN, 's, p')}")
def markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(s,) for s, _ in MARKDOWN], "s string").select("s", X.markdown_plain(F.col("s")).alias("plain"))


@query(f"""SELECT p_partkey, 'https://v.example/' || p_partkey || '-' || k || '.mp4' AS video_url, 'https://v.example/' || p_partkey || '.m4a' AS audio_url, 100 * (k + 1) AS width, 50 * (k + 1) AS height
FROM (SELECT p_partkey, arg_max(k, (1 + (p_partkey * 7 + k * 5) % 11, 50 * (k + 1)))::BIGINT AS k FROM part, unnest([0, 1, 2]) t(k) GROUP BY p_partkey)""")
def best_media(spark: SparkSession, d: str) -> DataFrame:
    """The representation of the greatest bandwidth, then height, of each manifest in a page's source."""
    xml = F.expr("""concat('<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><Period><AdaptationSet contentType="video">', array_join(transform(array(0L, 1L, 2L), k ->
      concat('<Representation bandwidth="', 1 + (p_partkey * 7 + k * 5) % 11, '" width="', 100 * (k + 1), '" height="', 50 * (k + 1), '"><BaseURL>https://v.example/', p_partkey, '-', k, '.mp4</BaseURL></Representation>')), ''),
      '</AdaptationSet><AdaptationSet mimeType="audio/mp4"><Representation bandwidth="9"><BaseURL>https://v.example/', p_partkey, '.m4a</BaseURL></Representation></AdaptationSet></Period></MPD>')""")
    source = F.concat(F.lit('<script>{"manifest_xml":"'), F.replace(xml, F.lit('"'), F.lit('\\"')), F.lit('"}</script>'))
    found = P.manifests(table(spark, d, "part").select("p_partkey", source.alias("s")), "p_partkey", "s")
    return found.select("p_partkey", "video_url", "audio_url", "width", "height")


@query("""SELECT c_custkey, c_custkey * 13 % 1000 + 1000 AS followers, c_custkey % 97 AS likes, c_mktsegment AS category, 'https://c' || c_custkey || '.example' AS website,
  c_custkey % 2 = 0 AS verified, c_custkey::VARCHAR AS page_id FROM customer""")
def page_meta(spark: SparkSession, d: str) -> DataFrame:
    """Followers, likes, contacts and ids of a page, from its source."""
    source = F.expr("""concat('<html>{"follower_count":', c_custkey * 13 % 1000 + 1000, ',"like_count" : ', c_custkey % 97, ',"category_list":[{"id":"1","name":"', c_mktsegment,
      '"}],"website":"https://c', c_custkey, '.example","is_verified":', if(c_custkey % 2 = 0, 'true', 'false'), if(c_custkey % 3 = 0, ',"pageID":"', '} fb://profile/'), c_custkey, '"</html>')""")
    found = table(spark, d, "customer").select("c_custkey", P.figures(source).alias("f"))
    return found.select("c_custkey", "f.followers", "f.likes", "f.category", "f.website", "f.verified", "f.page_id")


@query("""SELECT conv_id, 'pfbid' || md5(text) AS id, strftime(to_timestamp(1700000000 + conv_id * 1000 + turn), '%Y-%m-%d %H:%M') AS posted_at, sha1(text) AS caption FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def post_context(spark: SparkSession, d: str) -> DataFrame:
    """Posts of sources without JSON, from what stands around their ids."""
    c = table(spark, d, "conversations")
    one = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.min("turn").alias("turn"))
    source = F.expr("""concat('x "creation_time" : ', 1700000000 + conv_id * 1000 + turn, ' pfbid', md5(text), ' "message":{"text":"', sha1(text), '"} y')""")
    return P.extracted(one.select("conv_id", source.alias("s")), "conv_id", "s").select("conv_id", "id", "posted_at", "caption")


#: Sessions, and their posts and reels by kind; a session's rows lie together.
SESSIONS = {
    "sessions": Layout("session_id bigint, caption string, likes bigint, comments bigint", ("session_id",), buckets=2),
    "details": Layout("session_id bigint, post_id string, content_type string, caption string, likes bigint, comments bigint", ("session_id", "post_id"), ("content_type",), ("session_id",), 2),
}


@query(f"""SELECT conv_id AS session_id, CASE WHEN role = 'user' THEN 'reel' ELSE 'post' END AS content_type, id AS post_id, caption, likes, comments FROM {_POSTS}
UNION ALL SELECT conv_id, 'session', NULL, count(*) || ' items', sum(likes)::BIGINT, sum(comments)::BIGINT FROM {_POSTS} GROUP BY conv_id""")
def session_detail_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a scrape session leaves in its tables, in one change: a header and a row for each post and reel, with numbers that
    are never null."""
    p = _posts(spark, d)
    kind = P.classified(F.col("media"), F.col("url"))
    rows = p.select(F.col("conv_id").alias("session_id"), kind.alias("content_type"), F.col("id").alias("post_id"), "caption", F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("comments", F.lit(0)).alias("comments"))
    rows = stored(rows, "details")
    head = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"), F.sum("comments").alias("comments"))
    store = Store(spark, scratch(spark, "sessions"), SESSIONS)
    with store.change() as c:
        c.upsert("sessions", head.select("session_id", F.concat("n", F.lit(" items")).alias("caption"), "likes", "comments"))
        c.upsert("details", rows)
    now = store.snapshot()
    kept = now.read("sessions").select("session_id", F.lit("session").alias("content_type"), F.lit(None).cast("string").alias("post_id"), "caption", "likes", "comments")
    return now.read("details").unionByName(kept)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN '***' END AS api_key, CASE WHEN c_custkey % 2 = 0 THEN '***' END AS token, c_name AS name FROM customer""")
def secret_mask(spark: SparkSession, d: str) -> DataFrame:
    """A configuration without its secrets: those that are set are masked, the rest stays."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.sha1("c_name")).alias("api_key"), F.when(F.col("c_custkey") % 2 == 0, F.md5("c_name")).alias("token"), F.col("c_name").alias("name"))
    return rows.select("c_custkey", *(F.when(F.col(k).isNotNull(), F.lit("***")).alias(k) for k in ("api_key", "token")), "name")


@query("SELECT doc_id, array_to_string(list_filter([lang, CASE WHEN source <> lang THEN source END, CASE WHEN doc_id % 2 = 0 THEN 'base' END], lambda x: x IS NOT NULL AND x <> ''), ',') AS models FROM documents")
def model_list(spark: SparkSession, d: str) -> DataFrame:
    """The models to try: each once, in order, without empty ones."""
    models = F.array_distinct(F.filter(F.concat(F.array("lang"), F.array("source", "lang", F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("base"))).otherwise(F.array(F.lit("")))), lambda x: x != ""))
    return table(spark, d, "documents").select("doc_id", F.array_join(models, ",").alias("models"))


_SAFE = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id, 'html' AS format, '<h3>Page 1</h3><pre>' || {_SAFE} || '</pre>' AS body FROM documents
UNION ALL SELECT doc_id, 'txt', text FROM documents UNION ALL SELECT doc_id, 'json', to_json({{'page': 1, 'full_text': text}})::VARCHAR FROM documents""")
def export_text(spark: SparkSession, d: str) -> DataFrame:
    """A document's whole text in three formats."""
    t = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    bodies = {"html": F.concat(F.lit("<h3>Page 1</h3><pre>"), t, F.lit("</pre>")), "txt": F.col("text"), "json": F.to_json(F.struct(F.lit(1).alias("page"), F.col("text").alias("full_text")))}
    rows = F.array(*(F.struct(F.lit(k).alias("format"), v.alias("body")) for k, v in bodies.items()))
    return table(spark, d, "documents").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


TABLES = [("+--+--+\n| a | b |\n+--+--+\n| 1 | 2 |\n+--+--+\n\ntext", 1, "a,b;1,2"), ("| x |\n| y |", 0, ""), ("plain", 0, "")]


@case(f"SELECT s, n AS n_tables, c AS cells FROM {_values(TABLES, 's, n, c')}")
def ascii_tables(spark: SparkSession, d: str) -> DataFrame:
    found = _rows(spark, [(s,) for s, *_ in TABLES], "s string").withColumn("t", ocr.tables(F.col("s")))
    rows = F.transform(F.flatten("t"), lambda r: F.array_join(r, ","))
    return found.select("s", F.size("t").alias("n_tables"), F.array_join(rows, ";").alias("cells"))


JAPANESE = [("光学文学認識", "光学文字認識"), ("バターンとフアイル", "パターンとファイル"), ("ロ", "ル"), ("ok", "ok")]


@case(f"SELECT s, c AS corrected FROM {_values(JAPANESE, 's, c')}")
def jp_correct(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(s,) for s, _ in JAPANESE], "s string").select("s", ocr.corrected(F.col("s")).alias("corrected"))


SOCIAL = [
    ("web.facebook.com/a?b=1#c", "https://www.facebook.com/www.facebook.com/a"), (" https://web.facebook.com/x/?y=1 ", "https://www.facebook.com/x/"),
    ("https://www.facebook.com/watch?v=1", "https://www.facebook.com/watch?v=1"), ("/page", "https://www.facebook.com/page"),
]


@case(f"SELECT s, u AS url FROM {_values(SOCIAL, 's, u')}")
def social_url(spark: SparkSession, d: str) -> DataFrame:
    u = F.replace(F.trim("s"), F.lit("web.facebook.com"), F.lit("www.facebook.com"))
    u = F.when(F.contains(u, F.lit("watch")), u).otherwise(F.substring_index(F.substring_index(u, "?", 1), "#", 1))
    full = F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://www.facebook.com/"), F.regexp_replace(u, "^/+", "")))
    return _rows(spark, [(s,) for s, _ in SOCIAL], "s string").select("s", full.alias("url"))


MEDIA = [("a.MP4?x=1", "", "video/mp4"), ("a/video/1", "", "video/mp4"), ("a.webm", "", "video/webm"), ("a.png", "application/octet-stream", "image/png"), ("a", "text/css; q", "text/css"), ("a", "", "image/jpeg")]


@case(f"SELECT u, h, t AS type FROM {_values(MEDIA, 'u, h, t')}")
def media_type(spark: SparkSession, d: str) -> DataFrame:
    low = F.substring_index(F.lower("u"), "?", 1)
    known = (
        F.when((F.col("h") != "") & (F.col("h") != "application/octet-stream"), F.trim(F.substring_index("h", ";", 1)))
        .when(low.endswith(".mp4") | F.contains(low, F.lit("video")), "video/mp4").when(low.endswith(".webm"), "video/webm")
        .when(low.endswith(".png"), "image/png").when(low.endswith(".gif"), "image/gif").when(low.endswith(".webp"), "image/webp").otherwise("image/jpeg")
    )
    return _rows(spark, [r[:2] for r in MEDIA], "u string, h string").select("u", "h", known.alias("type"))


CLEANED = [("a <b>x</b>  y", "a x y"), ("strong>z", "z"), ("end <div", "end"), ("a\n\nb", "a b")]



@case(f"SELECT s, c AS cleaned FROM {_values(CLEANED, 's, c')}")
def llm_text_clean(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(s,) for s, _ in CLEANED], "s string").select("s", X.untagged(F.col("s")).alias("cleaned"))


AUDIO = [
    ("https://x/a?efg=eyJ2ZW5jb2RlX3RhZyI6ImRhc2hfYXVkaW8ifQ", True), ("https://x/a?efg=eyJ2ZW5jb2RlX3RhZyI6InZpZGVvX2F1ZGlvIn0", False),
    ("https://x/dash_audio_1", True), ("https://x/v.mp4", False), ("https://x/v?type=audio", True),
]


@case("SELECT u, a::INT AS audio_only FROM " + _values([(u, int(a)) for u, a in AUDIO], "u, a"))
def audio_only_url(spark: SparkSession, d: str) -> DataFrame:
    """By the tag in the encoded parameter where there is one, else by telling parts of the address."""
    raw = F.regexp_extract("u", "[?&]efg=([^&]+)", 1)
    padded = F.concat(raw, F.substring(F.lit("==="), 1, ((4 - F.length(raw) % 4) % 4).cast("int")))
    tag = F.lower(F.coalesce(F.get_json_object(F.when(raw != "", F.unbase64(padded).cast("string")), "$.vencode_tag"), F.lit("")))
    audio, video = F.contains(tag, F.lit("audio")), F.contains(tag, F.lit("video"))
    known = F.when(audio & ~video, True).when(video, False).otherwise(F.lower("u").rlike(r"/dash_audio[_/]|_audio_only|[?&]type=audio|heaac[^v]"))
    return _rows(spark, [(u,) for u, _ in AUDIO], "u string").select("u", known.cast("int").alias("audio_only"))


@query(f"""SELECT conv_id, id, caption, posted_at, likes, comments FROM {_POSTS}""")
def post_node(spark: SparkSession, d: str) -> DataFrame:
    """The posts of JSON payloads in page sources, with all their fields; what was put in must come out."""
    return _posts(spark, d).select("conv_id", "id", "caption", "posted_at", "likes", "comments")


@query(f"""SELECT id, caption, likes FROM {_POSTS} UNION ALL SELECT 'unknown', '', 0""")
def post_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Posts as the page shows them, half of them without a caption or likes, filled from those of its source where empty."""
    source = _posts(spark, d).select("id", F.col("caption").alias("c"), F.col("likes").alias("l"))
    blank = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    shown = source.select("id", F.when(blank, "").otherwise(F.col("c")).alias("caption"), F.when(blank, 0).otherwise(F.col("l")).alias("likes"))
    shown = shown.unionByName(spark.createDataFrame([("unknown", "", 0)], shown.schema))
    met = shown.join(source, "id", "left")
    likes = F.when(F.col("likes") == 0, F.coalesce("l", "likes")).otherwise(F.col("likes"))
    return met.select("id", F.coalesce(F.nullif("caption", F.lit("")), "c", F.lit("")).alias("caption"), likes.alias("likes"))


@query("""SELECT event_id, CASE WHEN t = '' THEN 'out' WHEN t = 'odd' THEN 'in' WHEN t < '2024-01-10 00:00' THEN 'past' WHEN t > '2024-01-20 23:59' THEN 'future' ELSE 'in' END AS place
FROM (SELECT event_id, CASE event_id % 10 WHEN 3 THEN '' WHEN 4 THEN 'odd' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS t FROM events)""")
def post_date_range(spark: SparkSession, d: str) -> DataFrame:
    """Undated posts are out, as a range is set; a date that can't be read counts as in it."""
    at = F.when(F.col("event_id") % 10 == 3, "").when(F.col("event_id") % 10 == 4, "odd").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    rows = table(spark, d, "events").select("event_id", at.alias("at"), F.try_to_timestamp(F.substring(at, 1, 16), F.lit("yyyy-MM-dd HH:mm")).alias("t"))
    place = (
        F.when(F.col("at") == "", "out").when(F.col("t") < F.lit("2024-01-10 00:00:00").cast("timestamp"), "past")
        .when(F.col("t") > F.lit("2024-01-20 23:59:00").cast("timestamp"), "future").otherwise("in")
    )
    return rows.select("event_id", place.alias("place"))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY ALL")
def health_lww(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "event_id")
    return rows.groupBy("key").agg(F.max_by("value", "event_id").alias("value"))


@query("""SELECT c_custkey, c_name AS name, 'u' || c_custkey AS handle, c_custkey * 3 AS followers, c_custkey % 2 = 0 AS verified, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS platform FROM customer""")
def profile_norm(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of two platforms, each with its own JSON, in one form."""
    one = F.to_json(F.struct(F.struct(F.col("c_name").alias("full_name"), F.concat(F.lit("u"), "c_custkey").alias("username"), F.struct((F.col("c_custkey") * 3).alias("count")).alias("edge_followed_by"), F.lit(True).alias("is_verified")).alias("user")))
    two = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.concat(F.lit("u"), "c_custkey").alias("screen_name"), (F.col("c_custkey") * 3).alias("followers_count"), F.lit(False).alias("verified")).alias("legacy")))
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "first").otherwise("second").alias("platform"), F.when(F.col("c_custkey") % 2 == 0, one).otherwise(two).alias("js"))
    get = lambda a, b: F.when(F.col("platform") == "first", F.get_json_object("js", a)).otherwise(F.get_json_object("js", b))
    return rows.select(
        "c_custkey", get("$.user.full_name", "$.legacy.name").alias("name"), get("$.user.username", "$.legacy.screen_name").alias("handle"),
        get("$.user.edge_followed_by.count", "$.legacy.followers_count").cast("bigint").alias("followers"), (get("$.user.is_verified", "$.legacy.verified") == "true").alias("verified"), "platform",
    )


@query("SELECT doc_id, len(w)::INT AS n, array_to_string(w, chr(10)) AS text, (len(w) * 10)::INT AS width FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') AS w FROM documents)")
def parse_regions(spark: SparkSession, d: str) -> DataFrame:
    """All regions of a page's nested result: a polygon, a text and a confidence for each word; blank ones fall away."""
    words = F.transform(F.filter(F.split("text", " "), lambda x: F.trim(x) != ""), lambda x, i: F.struct(F.array(F.array(i * 10 + 10, F.lit(0)), F.array(i * 10, F.lit(8))).alias("polygon"), x.alias("text"), F.lit(0.9).alias("confidence")))
    found = table(spark, d, "documents").select("doc_id", O.regions(words).alias("r"))
    joined = F.array_join(F.transform("r", lambda r: r["text"]), "\n")
    width = F.coalesce(F.array_max(F.transform("r", lambda r: r["x2"])) - F.array_min(F.transform("r", lambda r: r["x1"])), F.lit(0))
    return found.select("doc_id", F.size("r").alias("n"), joined.alias("text"), width.alias("width"))


_PART = "left(text, 500)"


@query(f"""SELECT doc_id, 'markdown' AS format, '# ' || source || chr(10) || chr(10) || '**Confidence:** ' || printf('%.1f%%', (n_chars % 1000) / 10.0::DOUBLE) || chr(10) || chr(10) || {_PART} AS body FROM documents
UNION ALL SELECT doc_id, 'html', '<h1>' || source || '</h1><p>' || left(text, 1000) || '</p>' FROM documents
UNION ALL SELECT doc_id, 'csv', source || ',' || printf('%.1f', (n_chars % 1000) / 10.0::DOUBLE) || ',"' || replace({_PART}, '"', '""') || '"' FROM documents
UNION ALL SELECT doc_id, 'json', to_json({{'source': source, 'text': text}})::VARCHAR FROM documents""")
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary in four formats; two show 500 characters of the text and one 1,000, which is what they are for."""
    share = (F.col("n_chars") % 1000) / F.lit(10.0)
    part = F.substring("text", 1, 500)
    bodies = {
        "markdown": F.concat(F.lit("# "), "source", F.lit("\n\n**Confidence:** "), F.format_string("%.1f%%", share), F.lit("\n\n"), part),
        "html": F.concat(F.lit("<h1>"), "source", F.lit("</h1><p>"), F.substring("text", 1, 1000), F.lit("</p>")),
        "csv": F.concat("source", F.lit(","), F.format_string("%.1f", share), F.lit(',"'), F.replace(part, F.lit('"'), F.lit('""')), F.lit('"')),
        "json": F.to_json(F.struct("source", "text")),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("format"), v.alias("body")) for k, v in bodies.items()))
    return table(spark, d, "documents").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")