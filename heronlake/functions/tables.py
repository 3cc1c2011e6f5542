"""OCR text as rows: aligned tables, runs of one script, hints by language and results of engines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.text import SCRIPTS

#: Languages written from right to left; what helps before recognition (denoise, shadows, sharpen, exposure).
RIGHT_TO_LEFT = ("urdu", "arabic")
HINTS = {
    "urdu": (True, True, True, True, "Urdu text is RTL, may need more aggressive preprocessing"),
    "arabic": (True, True, True, True, "Arabic text is RTL, requires good image quality"),
    "hindi": (True, True, True, False, "Devanagari script needs strong denoising"),
    "chinese": (True, False, True, True, "CJK characters benefit from sharpening"),
    "japanese": (True, False, True, True, "Japanese text needs clarity"),
    "english": (False, False, False, False, "Standard preprocessing sufficient"),
}
#: The engines after each first choice; those but the last of all need a key.
ENGINES = {"nemotron": ("nemotron", "mistral", "paddle"), "mistral": ("mistral", "nemotron", "paddle"), "paddle": ("paddle", "mistral", "nemotron")}
_GAP = re.compile(r"(?<! ) {2,}(?! )")


def columns_at(line: str) -> list[int]:
    """Where text goes on after two blanks or more."""
    return [m.end() for m in _GAP.finditer(line) if m.end() < len(line)] if line.strip() else []


def aligned(section: str) -> list[list[str]]:
    """The rows of a table whose columns are aligned by blanks; no rows if it isn't one.

    The first line has two gaps or more, and all but one of the others have as many gaps, give or take one. Cells are cut
    where any line has a column; empty ones are left out.
    """
    lines = [x for x in section.split("\n") if x.strip()]
    gaps = [len(columns_at(x)) for x in lines]
    if len(lines) < 2 or gaps[0] < 2 or sum(0 < g and abs(g - gaps[0]) <= 1 for g in gaps[1:]) < len(lines) - 2:
        return []
    cuts = sorted({at for x in lines for at in columns_at(x)})
    rows = []
    for line in lines:
        bounds = [0, *(c for c in cuts if c < len(line)), len(line)]
        rows.append([cell for a, b in zip(bounds, bounds[1:]) if (cell := line[a:b].strip())])  # noqa: B905
    return rows


def aligned_tables(text: str) -> list[list[list[str]]]:
    return [t for s in re.split(r"\n\s*\n", text) if len(t := aligned(s)) > 1]


def script_runs(text: str) -> list[tuple[str | None, str]]:
    """(language, run) of a text: neutral characters stay in the run that they follow."""
    kinds = {k: re.compile(p) for k, p in SCRIPTS.items()}
    out: list[list] = []
    known: dict[str, str | None] = {}
    for c in text:
        if c not in known:
            known[c] = next((k for k, p in kinds.items() if p.match(c)), None)
        if out and (known[c] is None or known[c] == out[-1][0]):
            out[-1][1].append(c)
        else:
            out.append([known[c], [c]])
    return [(k, "".join(x)) for k, x in out]


def apply(rows: DataFrame, key: str, text: str, schema: str, make: Callable[[str], list[tuple]]) -> DataFrame:
    """A row of the key and each tuple that ``make`` finds in a text; a null text is empty. No shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(part.split()[0] for part in re.split(r",\s*(?![^<]*>)", schema))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(b[key], b[text], strict=True) for r in make(t or "")], columns=names)

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, {schema}")


def hints(language: Column) -> Column:
    """(rtl, denoise, shadows, sharpen, exposure, note); what isn't known is as English."""
    low = F.lower(language)

    def of(i: int) -> Column:
        found = F.lit(HINTS["english"][i])
        for name, values in HINTS.items():
            found = F.when(low == name, F.lit(values[i])).otherwise(found)
        return found

    names = ("denoise", "shadows", "sharpen", "exposure", "note")
    return F.struct(low.isin(*RIGHT_TO_LEFT).alias("rtl"), *(of(i).alias(n) for i, n in enumerate(names)))


def engine_order(primary: Column, keys: Column) -> Column:
    """The engines to try, in order; those whose key isn't among ``keys`` are left out, the local one needs none."""
    order = F.array(*map(F.lit, ENGINES["paddle"]))
    for name in ("mistral", "nemotron"):
        order = F.when(primary == name, F.array(*map(F.lit, ENGINES[name]))).otherwise(order)
    return F.filter(order, lambda e: (e == "paddle") | F.array_contains(keys, e))


def first_result(results: Column) -> Column:
    """Of (priority, engine, text, error) the first, by priority, without an error and with a text that isn't blank."""
    fine = F.filter(results, lambda r: r["error"].isNull() & (F.trim(F.coalesce(r["text"], F.lit(""))) != ""))
    return F.try_element_at(F.array_sort(fine), F.lit(1))


def regions(lines: Column, least: float = 0.5) -> Column:
    """Of lines (polygon, text, confidence) the regions (text, confidence, x1, y1, x2, y2) that are sure and not empty."""
    kept = F.filter(lines, lambda r: (r["confidence"] >= least) & (F.trim(r["text"]) != ""))

    def box(r: Column) -> Column:
        xs, ys = F.transform(r["polygon"], lambda p: p[0]), F.transform(r["polygon"], lambda p: p[1])
        return F.struct(
            r["text"].alias("text"), r["confidence"].alias("confidence"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
            F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"),
        )

    return F.transform(kept, box)

