"""Documents from files: text, Markdown, HTML, CSV, simple PDFs and the zip-based office formats.

Files come through the ``binaryFile`` source, so any store that Spark reads will do, and each is read by one task. What a
reader can't read goes to the ``error`` column and the text is empty. Images and old office files need a reader from
outside: ``readers`` maps further endings to functions from bytes to text.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.functions.html import Nodes

#: Endings that a folder scan keeps.
ENDINGS = ("txt", "md", "markdown", "html", "htm", "docx", "pdf", "png", "jpg", "jpeg", "tiff", "bmp", "webp", "xlsx", "xls", "pptx", "ppt", "csv")
#: Endings that a batch of images and scans keeps.
SCANS = ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp", "pdf")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def html(content: bytes) -> str:
    return "\n".join(Nodes(plain(content)).nodes)


def table_text(content: bytes) -> str:
    """Rows as lines of trimmed cells between tabs; empty rows are left out."""
    rows = csv.reader(io.StringIO(plain(content)))
    return "\n".join(line for r in rows if (line := "\t".join(c.strip() for c in r)).strip())


def docx(content: bytes) -> str:
    """The runs of each paragraph, a line for each that has some."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in root.iter() if _local(p.tag) == "p")
    return "\n".join(line for line in lines if line.strip())


def pptx(content: bytes) -> str:
    """A marked block for each slide, in order, with the text of its paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")]
        names.sort(key=lambda n: int("".join(filter(str.isdigit, n.rsplit("/", 1)[-1])) or 0))
        out = []
        for i, n in enumerate(names, 1):
            root = ElementTree.fromstring(z.read(n))
            out.append("\n".join([f"=== Slide {i} ===", *(x for x in slide(root) if x.strip())]))
    return "\n".join(out)


def slide(root: ElementTree.Element) -> Iterator[str]:
    """The paragraphs of a slide, and the rows of its tables with cells between tabs."""

    def text(e: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")

    for e in root:
        if _local(e.tag) == "tr":
            yield "\t".join(" ".join(text(p) for p in c.iter() if _local(p.tag) == "p").strip() for c in e if _local(c.tag) == "tc")
        elif _local(e.tag) == "p":
            yield text(e)
        else:
            yield from slide(e)


def place(reference: str) -> int:
    """The number of a cell's column, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(title, rows of cells) of a workbook's sheets, in order; missing cells are empty, as are rows without any."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in root if _local(s.tag) == "si"]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                targets[r.attrib.get("Id")] = r.attrib.get("Target", "").lstrip("/").removeprefix("xl/")
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for i, s in enumerate((s for s in book.iter() if _local(s.tag) == "sheet"), 1):
            key = next((v for k, v in s.attrib.items() if _local(k) == "id"), None)
            root = ElementTree.fromstring(z.read("xl/" + targets.get(key, f"worksheets/sheet{i}.xml")))
            rows = []
            for row in (r for r in root.iter() if _local(r.tag) == "row"):
                cells: list[str] = []
                for c in row:
                    raw = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                    at = max(place(c.attrib["r"]) if "r" in c.attrib else len(cells), len(cells))
                    cells += [""] * (at - len(cells)) + [strings[int(raw)] if c.attrib.get("t") == "s" and raw else raw]
                rows.append(cells)
            yield s.attrib.get("name", ""), rows


def xlsx(content: bytes) -> str:
    """A marked block for each sheet, with its rows' cells between tabs."""
    return "\n".join("\n".join([f"=== Sheet: {title} ===", *("\t".join(r) for r in rows if any(r))]) for title, rows in sheets(content))


def workbook(content: bytes, most: int = 500) -> list[tuple[str, int, str]]:
    """(sheet, row, line): the first rows of each sheet, as many as a report shows, with cells between bars."""
    return [(title, i, " | ".join(r)) for title, rows in sheets(content) for i, r in enumerate(rows[:most]) if any(r)]


_PDF_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.DOTALL)
_PDF_TEXT = re.compile(rb"\((?P<s>(?:\\.|[^\\()])*)\)\s*(?P<op>Tj|'|\")|\[(?P<a>(?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(?P<nl>T\*|T[dD]\b|\bET\b)", re.DOTALL)
_PDF_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)
_PDF_CHARS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c.isdigit() else _PDF_CHARS.get(c, c)

    return _PDF_ESCAPE.sub(one, raw).decode("cp1252", "replace")


def pdf_pages(content: bytes) -> list[str]:
    """The text that a PDF's content streams show, a string for each stream with text.

    For plain or deflated streams and fonts with a Latin encoding; other PDFs need a reader from outside.
    """
    pages = []
    for m in _PDF_STREAM.finditer(content):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in m["head"]:
            continue
        if b"BT" not in body:
            continue
        out = []
        for t in _PDF_TEXT.finditer(body):
            if t["nl"]:
                out.append("\n")
            elif t["a"] is not None:
                out.append("".join(_pdf_string(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", t["a"])))
            else:
                out.append(("\n" if t["op"] != b"Tj" else "") + _pdf_string(t["s"]))
        pages.append("\n".join(x for line in "".join(out).split("\n") if (x := line.strip())))
    return pages


def pdf(content: bytes, ocr: Callable[[bytes], str] | None = None) -> str:
    """The pages' text, or that of recognition where it has fewer than 50 characters and there is one; its errors are passed over."""
    text = "\n".join(pdf_pages(content))
    if ocr and len(text.strip()) < 50:
        try:
            return ocr(content) or text
        except Exception:
            return text
    return text


READERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(("txt", "md", "markdown"), plain), **dict.fromkeys(("html", "htm"), html),
    "csv": table_text, "docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf,
}


def merged(base: Column, given: Column) -> Column:
    """The entries of two maps; of a key that both have, the second's."""
    old = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(old, given)


def listed(spark: SparkSession, path: str, endings: tuple[str, ...] = ENDINGS, recursive: bool = True) -> DataFrame:
    """(path, name, ending, length, content) of the files of a folder, and those below it, that have one of the endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    name = F.regexp_extract("path", "[^/]+$", 0)
    return files.select("path", name.alias("name"), ending.alias("ending"), "length", "content").where(F.col("ending").isin(*endings))


def read_bytes(rows: DataFrame, key: str, content: str, reader: Callable[[bytes], str]) -> DataFrame:
    """(key, text): what a reader makes of binary values."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [reader(bytes(x)) if x is not None else "" for x in b[content]]})

    return rows.select(key, content).mapInPandas(run, f"`{key}` {kind}, text string")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number, text, words, word_count, confidence): a row for each page of the PDFs below a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, t, t.split(), len(t.split()), 1.0 if t else 0.0) for p, c in zip(b["path"], b["content"], strict=True) for i, t in enumerate(pdf_pages(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "words", "word_count", "confidence"])

    found = listed(spark, path, ("pdf",)).select("path", "content")
    return found.mapInPandas(run, "path string, page_number int, text string, words array<string>, word_count int, confidence double")


def folder_items(page: str) -> list[tuple[str, str, str]]:
    """(id, name, type) of the files that the source of a shared folder's page lists, each id once.

    They are arrays in its JSON that begin with null and an id in an array, and hold a name and a MIME type.
    """
    found: dict[str, tuple[str, str, str]] = {}
    for m in re.finditer(r"AF_initDataCallback\s*\(\s*({.*?})\s*\)\s*;", page, re.DOTALL):
        data = re.search(r"data\s*:\s*(.*)\s*,\s*sideChannel", m[1], re.DOTALL)
        try:
            stack = [json.loads(data[1].strip())] if data else []
        except ValueError:
            continue
        while stack:
            x = stack.pop()
            if not isinstance(x, list):
                continue
            texts = [t for t in x if isinstance(t, str)]
            kind = next((t for t in texts if re.fullmatch(r"[a-z]+/[\w.+-]+", t)), None)
            ids = next((t for t in x if isinstance(t, list) and len(t) > 1 and t[0] is None and isinstance(t[1], str)), None)
            if kind and ids:
                found.setdefault(ids[1], (ids[1], next((t for t in texts if t != kind), ids[1]), kind))
            stack += reversed(x)
    return list(found.values())


def documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """(document_id, path, name, document_type, text, error, metadata): each file below a folder as a document.

    ``metadata`` goes over the name, type and path that each document has.
    """
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for ending, content in zip(b["document_type"], b["content"], strict=True):
                try:
                    texts.append(known[ending](bytes(content)))
                    errors.append(None)
                except KeyError as e:
                    texts.append("")
                    errors.append(f"no reader: {e}")
                except Exception as e:
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.drop(columns="content").assign(text=texts, error=errors)

    files = listed(spark, path).select(F.sha1("path").alias("document_id"), "path", "name", F.col("ending").alias("document_type"), "content")
    found = files.mapInPandas(run, "document_id string, path string, name string, document_type string, text string, error string")
    own = {"document_name": F.col("name"), "document_type": F.col("document_type"), "source_path": F.col("path"), "ocr_applied": F.lit("false")}
    given = F.create_map(*(F.lit(x) for kv in (metadata or {}).items() for x in kv)) if metadata else F.expr("cast(map() as map<string,string>)")
    return found.withColumn("metadata", merged(F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v))), given))
