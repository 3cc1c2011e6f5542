"""Chunkers as table functions, by name.

A chunker is a class whose ``eval(text, size, overlap)`` yields (section, chunk) in order; :func:`register` makes it a Spark
table function for ``LATERAL``, also in SQL. ``packed_lines`` is for texts that come as lines: a function of a table,
partitioned by document and ordered by line, which folds them in order and holds no more than a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from heronlake.functions.text import words
from heronlake.operators import chunking

#: What ends a line.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


class Chunker(Protocol):
    """What a chunker has to be."""

    def eval(self, text: str, size: int, overlap: int) -> Iterable[tuple[str, str]]: ...


class Hierarchical:
    """Markdown sections, in packed windows of words."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[str, str]]:
        for title, body in chunking.sections(text or ""):
            for chunk in chunking.pack(body, size, overlap):
                yield title, chunk


class Sliding:
    """Windows of words, over words that single spaces part."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[str, str]]:
        w = (text or "").split(" ") if text else []
        for at in range(0, len(w), max(size - overlap, 1)):
            yield "General", " ".join(w[at : at + size])
            if at + size >= len(w):
                return


class Folded:
    """The chunks of a document whose lines come one after another."""

    def __init__(self) -> None:
        self.packer: Packer | None = None
        self.key, self.n = None, 0

    def eval(self, row, size: int, overlap: int) -> Iterator[tuple]:
        if self.packer is None:
            self.packer, self.key = Packer(size, overlap), row["key"]
        yield from self._numbered(self.packer.add(row["line"] or ""))

    def terminate(self) -> Iterator[tuple]:
        if self.packer is not None:
            yield from self._numbered(self.packer.end())

    def _numbered(self, found: Iterable[tuple[str, str]]) -> Iterator[tuple]:
        for section, chunk in found:
            yield self.key, self.n, section, chunk
            self.n += 1


class Packer:
    """Sections and packing by lines: what it holds is a window of words, and the headings before the first other line."""

    def __init__(self, size: int, overlap: int) -> None:
        self.size, self.overlap = size, overlap
        self.title, self.held = "General", []
        self.headings: list[str] | None = []

    def add(self, line: str) -> Iterator[tuple[str, str]]:
        if m := chunking.HEADING.match(line):
            yield from self._flush()
            self.title = m[2].strip()
            if self.headings is not None:
                self.headings.append(line)
            return
        self.headings = None
        w = line.split()
        if len(self.held) + len(w) <= self.size:
            self.held += w
            return
        tail = self.held[max(0, len(self.held) - self.overlap) :] if len(w) <= self.size else []
        yield from self._flush()
        self.held = tail + w
        if len(self.held) > self.size:
            yield from ((self.title, c) for _, c in Sliding().eval(" ".join(self.held), self.size, self.overlap))
            self.held = []

    def _flush(self) -> Iterator[tuple[str, str]]:
        if self.held:
            yield self.title, " ".join(self.held)
        self.held = []

    def end(self) -> Iterator[tuple[str, str]]:
        if self.headings:  # a text of headings alone
            text = "\n".join(self.headings).strip()
            yield from (("General", c) for c in chunking.pack(text, self.size, self.overlap))
        yield from self._flush()


CHUNKERS: dict[str, type] = {"hierarchical": Hierarchical, "sliding": Sliding}


def register(spark: SparkSession, name: str, chunker: type[Chunker]) -> None:
    """Make a chunker known by a name: to :func:`chunked`, and to SQL as ``chunk_<name>(text, size, overlap)``."""
    CHUNKERS[name] = chunker
    spark.udtf.register(f"chunk_{name}", udtf(chunker, returnType="section string, chunk string"))


def chunked(docs: DataFrame, by: str = "hierarchical", key: str = "doc_id", text: Column | str = "text", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """(key, ordinal, section, chunk, chunk_id) of a chunker, by its name: a lateral join of each text with its chunks."""
    if by not in CHUNKERS:
        raise ValueError(f"no chunker is called {by}")
    shown = F.col(text) if isinstance(text, str) else text
    rows = docs.select(F.col(key).alias("key"), shown.alias("text"))
    numbered = udtf(_numbered(CHUNKERS[by]), returnType="ordinal int, section string, chunk string")
    found = rows.lateralJoin(numbered(F.col("text").outer(), F.lit(size), F.lit(overlap)))
    return _named(found, key)


def _numbered(chunker: type[Chunker]) -> type:
    class Numbered:
        def eval(self, text: str, size: int, overlap: int):
            for n, (section, chunk) in enumerate(chunker().eval(text, size, overlap)):
                yield n, section, chunk

    return Numbered


def _named(found: DataFrame, key: str) -> DataFrame:
    ident = F.sha1(F.concat_ws(":", F.col("key").cast("string"), F.col("ordinal").cast("string"), "chunk"))
    return found.select(F.col("key").alias(key), "ordinal", "section", "chunk", ident.alias("chunk_id"))


def spaced(text: str = "text") -> Column:
    """A text with its words parted by single spaces, as the sliding chunker takes them."""
    return F.array_join(words(F.col(text)), " ")


def packed_lines(lines: DataFrame, key: str = "doc_id", order: str = "i", line: str = "line", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """(key, ordinal, section, chunk, chunk_id) of documents whose lines are rows, folded in order."""
    kind = lines.schema[key].dataType.simpleString()
    fold = udtf(Folded, returnType=f"key {kind}, ordinal int, section string, chunk string")
    rows = lines.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(line).alias("line"))
    found = fold(rows.asTable().partitionBy("key").orderBy("at"), F.lit(size), F.lit(overlap))
    return _named(found, key)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i, line)"""
    return docs.select(key, F.posexplode(F.split(text, LINE_ENDS)).alias("i", "line"))
