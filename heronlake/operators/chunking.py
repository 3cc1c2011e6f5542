"""Chunking: fixed word windows as columns; heading sections and greedy packing as a table function over each text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions.text import words
from heronlake.functions.vectors import cosine

SIZE, OVERLAP = 320, 48
HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.+?)\s*$")


def window_starts(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """First words of the windows over n words; the last window is the one that reaches the end."""
    step = max(size - overlap, 1)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def sliding(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, ordinal, chunk, chunk_id, n_words): overlapping windows of words; the id hashes document, ordinal and text.

    The columns of ``also`` are kept beside them.
    """
    w = docs.select(key, *also, words(F.col(text)).alias("w"))
    cut = w.select(key, *also, "w", F.posexplode(window_starts(F.size("w"), size, overlap)).alias("ordinal", "start"))
    part = F.slice("w", F.col("start") + 1, F.lit(size))
    cut = cut.select(key, *also, "ordinal", F.array_join(part, " ").alias("chunk"), F.size(part).cast("bigint").alias("n_words"))
    return cut.withColumn("chunk_id", F.sha1(F.concat_ws(":", F.col(key).cast("string"), F.col("ordinal").cast("string"), "chunk")))


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) by Markdown headings; General before the first, and for a text of headings alone."""
    out, title, lines = [], "General", []
    for line in [*text.splitlines(), None]:
        m = HEADING.match(line) if line is not None else None
        if line is None or m:
            if lines:
                out.append((title, "\n".join(lines).strip()))
                lines = []
            title = m[2].strip() if m else title
        else:
            lines.append(line)
    return out if out or not text.strip() else [("General", text.strip())]


def pack(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """Paragraphs in windows of ``size`` words, the last words of a window again in the next; long ones in windows of their own."""

    def windows(w: list[str]) -> Iterator[list[str]]:
        for at in range(0, len(w), max(size - overlap, 1)):
            yield w[at : at + size]
            if at + size >= len(w):
                return

    held: list[str] = []
    for paragraph in re.split(r"\r?\n", text):
        w = paragraph.split()
        if len(held) + len(w) <= size and len(w) <= size:
            held += w
            continue
        if held:
            yield " ".join(held)
        if len(w) > size:
            parts, held = windows(w), []
        else:
            held = held[len(held) - min(overlap, len(held)) :] + w
            parts = iter(())
            if len(held) > size:
                parts, held = windows(held), []
        yield from map(" ".join, parts)
    if held:
        yield " ".join(held)


def hierarchical(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, section, chunk, chunk_id): sections first, then packed windows within each. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = 0
                for title, body in sections(t or ""):
                    for chunk in pack(body, size, overlap):
                        rows.append((k, n, title, chunk, hashlib.sha1(f"{k}:{n}:{chunk}".encode()).hexdigest()))
                        n += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            names = [key, "ordinal", "section", "chunk", "chunk_id"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ordinal int, section string, chunk string, chunk_id string")


def semantic_islands(chunks: DataFrame, by: str, order: str, vector: str, threshold: float = 0.75) -> DataFrame:
    """Adjacent chunks stay together while their cosine reaches the threshold; adds ``island``, from 0 within ``by``."""
    w = W.partitionBy(by).orderBy(order)
    near = chunks.withColumn("_p", F.lag(vector).over(w))
    cut = F.when(F.col("_p").isNull() | (F.round(cosine(F.col("_p"), F.col(vector)), 9) >= threshold), 0).otherwise(1)
    return near.withColumn("island", F.sum(cut).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("_p")


def mean_vector(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, i, value): the mean of each component."""
    return rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("value"))


def merged_islands(chunks: DataFrame, by: str, order: str, text: str, vector: str, threshold: float = 0.75) -> DataFrame:
    """(by, island, first, last, text, vector, n): adjacent chunks that are alike as one: their texts, the mean of their
    vectors and the last one's order."""
    found = semantic_islands(chunks, by, order, vector, threshold)
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(vector).alias("v"))))
    rows = found.groupBy(by, "island").agg(own.alias("x"))  # an island's chunks are neighbours of one document
    total = F.aggregate(
        F.transform("x", lambda c: F.transform(c["v"], lambda y: y.cast("double"))), F.transform(F.element_at("x", 1)["v"], lambda y: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda p, q: p + q)
    )
    n = F.size("x")
    return rows.select(
        by, "island", F.element_at("x", 1)["o"].alias("first"), F.element_at("x", -1)["o"].alias("last"),
        F.array_join(F.transform("x", lambda c: c["t"]), " ").alias("text"), F.transform(total, lambda y: y / n).alias("vector"), n.cast("bigint").alias("n"),
    )
