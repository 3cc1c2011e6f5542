"""OCR text: Japanese corrections and tables drawn with characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corrections of words, then of characters, in the order in which they are made.
WORDS = (
    ("コンビュー夕", "コンピュータ"), ("コンビュータ", "コンピュータ"), ("コンぴゅー多", "コンピュータ"), ("テジタル", "デジタル"),
    ("デジダル", "デジタル"), ("ロCR", "OCR"), ("バターン", "パターン"), ("フアイル", "ファイル"), ("光学文学認識", "光学文字認識"),
    ("文学", "文字"), ("レクノロジー", "テクノロジー"), ("テクノロジ", "テクノロジー"), ("インターネッ", "インターネット"), ("データべース", "データベース"),
)
CHARACTERS = (("夕", "タ"), ("ロ", "ル"), ("バ", "パ"), ("フア", "ファ"), ("フオ", "フォ"))
#: Lines of a drawn table.
BORDER, ROW, DASHES = r"^\s*[+\-|\s]+$", r"^\s*\|(.+)\|?\s*$", r"^\s*[+\-]+[+\-\s]*$"


def corrected(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), (*WORDS, *CHARACTERS), text)


def has_table(text: Column) -> Column:
    """At least two border lines and a row."""
    lines = F.split(text, "\n")
    border = F.size(F.filter(lines, lambda x: x.rlike(BORDER)))
    row = F.size(F.filter(lines, lambda x: ~x.rlike(BORDER) & x.rlike(ROW)))
    return (border >= 2) & (row >= 1)


def tables(text: Column) -> Column:
    """Tables of rows of cells: a section between blank lines that is a table, without its dashes and empty cells."""

    def rows(section: Column) -> Column:
        lines = F.filter(F.split(section, "\n"), lambda x: ~x.rlike(DASHES) & x.rlike(ROW))
        cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(F.regexp_extract(x, ROW, 1), r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
        return F.filter(cells, lambda r: F.size(r) > 0)

    found = F.transform(F.filter(F.split(text, r"\n\s*\n"), has_table), rows)
    return F.filter(found, lambda t: F.size(t) > 0)
