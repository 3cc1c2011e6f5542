"""Benchmark decontamination with a distributed positional inverted index.

The index is divided by documents: a shard holds the postings of about a million words of whole documents, as one row of
a stored table (its terms, the number of postings of each, and their positions in order). A phrase is looked up in each
shard by intersecting the lists of its terms, adjusted by their offsets, from the rarest term of that shard on; all
phrases of a block of test items go through a shard together, as arrays. Neither building nor searching shuffles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from heronlake.llm.common import ddl, map_rows, scratch, slices, stored

WINDOW = 10
#: Words in a shard, about; free positions between documents, at least; bytes of test texts in a block; candidates, and
#: phrases, that are met at once.
SHARD, GAP, BLOCK_BYTES, CANDIDATES, PHRASES = 1 << 20, 64, 8 << 20, 2_000_000, 200_000
#: Lower-cases A-Z; what isn't a digit, a letter or over U+007F becomes a blank.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


class Shard:
    """Postings of whole documents. Positions of two documents are at least ``gap`` apart, so no phrase spans both."""

    def __init__(self, gap: int = GAP) -> None:
        self.gap = gap
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.keys: list = []
        self.words = 0

    def add(self, key, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.keys.append(key)
        self.sizes.append(len(words))
        self.words += len(words)

    def row(self) -> tuple:
        terms = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        sizes = np.array(self.sizes, np.int64)
        places = np.arange(len(terms)) + np.repeat(np.arange(len(sizes)) * self.gap, sizes)
        order = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(self.ids))
        return (
            self.keys,
            sizes.astype("<i8").tobytes(),
            b" ".join(self.ids),
            counts.astype("<i4").tobytes(),
            places[order].astype("<i8" if len(places) and places[-1] >= 1 << 31 else "<i4").tobytes(),
        )


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = GAP) -> DataFrame:
    """The stored index: (shard, keys, sizes, terms, counts, places), a row for each shard.

    Each input row is a document of its own; null and empty texts have no words. Memory is bounded by a shard and the
    longest text.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"shard string, keys array<{kind}>, sizes binary, terms binary, counts binary, places binary"
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, part, n, shard = to_arrow_schema(out), TaskContext.get().partitionId(), 0, Shard(gap)

        def batch() -> pa.RecordBatch:
            values = (f"{part}-{n}", *shard.row())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=kinds.field(i).type) for i, v in enumerate(values)], schema=kinds
            )

        for b in batches:
            for some in slices(b):
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    shard.add(k, words_of(t))
                    if shard.words >= SHARD or len(shard.keys) >= SHARD // 8:
                        yield batch()
                        n, shard = n + 1, Shard(gap)
        if shard.keys:
            yield batch()

    path = scratch(docs.sparkSession, "postings")
    found = docs.select(key, text).mapInArrow(run, out)
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


class Tests:
    """A block of test items: the numbers of their words in a row, and by length the first places and items of phrases.

    An item's windows overlap in that row, so a block is about as large as its texts and its distinct words.
    """

    def __init__(self, rows: list[Row], window: int = WINDOW) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.items = sorted({str(r[0]) for r in rows})
        number = {x: i for i, x in enumerate(self.items)}
        words, found, at = [], defaultdict(list), 0
        for item, text in rows:
            w = words_of(text)
            words.append(np.fromiter(map(self.terms.__getitem__, w), np.int32, len(w)))
            if n := min(window, len(w)):
                starts = np.arange(at, at + len(w) - n + 1, dtype=np.int32)
                found[n].append((starts, np.full(len(starts), number[str(item)], np.int32)))
            at += len(w)
        self.terms.default_factory = None
        self.words = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.phrases = {n: tuple(np.concatenate(c) for c in zip(*x, strict=True)) for n, x in found.items()}


def matches(tests: Tests, terms: bytes, counts: np.ndarray, places: np.ndarray, slop: int = 0, gap: int = GAP):
    """(item numbers, first and last positions) of the phrases in a shard, some at a time.

    With slop, each term may stand that many words before or after its place in the phrase; the positions are those of the
    words that were found.
    """
    local = np.full(len(tests.terms), -1, np.int64)
    for i, t in enumerate(terms.split(b" ") if terms else ()):
        if (k := tests.terms.get(t)) is not None:
            local[k] = i
    starts = np.concatenate([[0], np.cumsum(counts)])
    span = int(places.max()) + 2 * gap if len(places) else 1
    keys = np.repeat(np.arange(len(counts)), counts) * span + places
    words = local[tests.words] if len(tests.words) else np.zeros(0, np.int64)
    for n, (begin, every) in tests.phrases.items():
        if n + 2 * slop >= gap:
            raise ValueError(f"phrases of {n} words with a slop of {slop} need an index with a gap of over {n + 2 * slop}")
        known = np.concatenate([[0], np.cumsum(words >= 0)])
        whole = np.flatnonzero(known[begin + n] - known[begin] == n)  # phrases all of whose terms the shard has
        for cut in range(0, len(whole), PHRASES):
            on = whole[cut : cut + PHRASES]
            phrase, items = words[begin[on, None] + np.arange(n)], every[on]
            size = counts[phrase]
            rare = np.argsort(size, axis=1, kind="stable")
            least = np.take_along_axis(size, rare[:, :1], 1)[:, 0]
            cuts = np.searchsorted(np.cumsum(least), np.arange(0, int(least.sum()), CANDIDATES), side="right")
            for a, b in zip(cuts, [*cuts[1:], len(phrase)], strict=True):
                if a == b:
                    continue
                many = least[a:b]
                row = np.repeat(np.arange(a, b), many)
                first = rare[row, 0]
                at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + starts[phrase[row, first]]
                low = places[at].astype(np.int64)
                place, high = low - first, low
                for k in range(1, n):
                    o = rare[row, k]
                    want = phrase[row, o] * span + place + o
                    hit = np.searchsorted(keys, want - slop)
                    found = keys[np.minimum(hit, len(keys) - 1)]
                    good = (found <= want + slop) & (hit < len(keys))
                    real = (found - phrase[row, o] * span)[good]
                    row, place, low, high = row[good], place[good], np.minimum(low[good], real), np.maximum(high[good], real)
                    if not len(row):
                        break
                if len(row):
                    yield items[row], low, high


def search(index: DataFrame, tests: Tests, slop: int = 0, gap: int = GAP, all_rows: bool = True) -> DataFrame:
    """(shard, i, key, n_words, spans, items): a row for each document, spans being the word runs that phrases cover.

    Without ``all_rows`` only documents with a phrase have one.
    """
    spark = index.sparkSession
    held = spark.sparkContext.broadcast(tests)  # a block of BLOCK_BYTES at most
    kind = index.schema["keys"].dataType.elementType.simpleString()

    def make() -> Callable:
        block: Tests = held.value

        def some(*columns: list):
            for shard, keys, raw_sizes, terms, raw_counts, raw_places in zip(*columns, strict=True):
                sizes, counts = np.frombuffer(raw_sizes, "<i8"), np.frombuffer(raw_counts, "<i4").astype(np.int64)
                n = int(sizes.sum())
                places = np.frombuffer(raw_places, "<i8" if len(raw_places) == 8 * n else "<i4")
                first = np.cumsum(sizes) - sizes + np.arange(len(sizes)) * gap
                cover: dict[int, list] = defaultdict(list)
                items: dict[int, set] = defaultdict(set)
                for item, low, high in matches(block, terms, counts, places, slop, gap):
                    doc = np.searchsorted(first, low, side="right") - 1
                    order = np.lexsort((low, doc))
                    for d, p, q, i in zip(doc[order].tolist(), low[order].tolist(), high[order].tolist(), item[order].tolist(), strict=True):
                        cover[d].append((p - int(first[d]), q - int(first[d]) + 1))
                        items[d].add(block.items[i])
                for i in range(len(keys)) if all_rows else sorted(cover):
                    spans = [{"s": s, "e": e} for s, e in merged(cover.get(i, ()))]
                    yield shard, i, keys[i], int(sizes[i]), spans, sorted(items.get(i, ()))

        return some

    return map_rows(
        index,
        ["shard", "keys", "sizes", "terms", "counts", "places"],
        f"shard string, i bigint, key {kind}, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>",
        make,
    )


def listed() -> Callable:
    """The documents of a shard: (shard, i, key, n_words)."""

    def some(shards: list, keys: list, sizes: list):
        for shard, own, raw in zip(shards, keys, sizes, strict=True):
            yield from ((shard, i, k, n) for i, (k, n) in enumerate(zip(own, np.frombuffer(raw, "<i8").tolist(), strict=True)))

    return some


def merged(spans) -> list[tuple[int, int]]:
    """Half-open spans as disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, slop: int = 0
) -> DataFrame:
    """(key, n_words, n_hit, items, contaminated): each document against all windows of the test items.

    One row for each input row, repeated rows too. A null, empty or wordless text has no words and no hits; test items
    without words or with a null id have no windows; of test items with one id any counts for it. Other columns are
    ignored, whatever they are called. With ``slop`` the words of a window may stand that far from their places; what is hit
    is what lies between the first and the last of them. The test items come in blocks of bounded size, one after another,
    each of which is broadcast and searched for in the stored index; with several blocks a document's parts are put together
    by its place in the index.
    """
    gap = max(GAP, window + 2 * slop + 1)
    index = build(docs, key, text, gap)
    tests = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))

    def block(b: int) -> Tests:
        return Tests(tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), window)

    if blocks == 1:
        parts = search(index, block(0), slop, gap)
    else:
        found = None
        for b in range(blocks):  # stored before the next one starts, so one block is held at a time
            own = stored(search(index, block(b), slop, gap, all_rows=False).drop("key", "n_words"), "hits")
            found = own if found is None else found.unionByName(own)
        hits = found.groupBy("shard", "i").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        every = map_rows(index, ["shard", "keys", "sizes"], f"shard string, i bigint, key {index.schema['keys'].dataType.elementType.simpleString()}, n_words bigint", listed)
        parts = every.join(hits.hint("merge"), ["shard", "i"], "left")

        def make() -> Callable:
            def some(keys: list, sizes: list, spans: list, items: list):
                for k, n, s, i in zip(keys, sizes, spans, items, strict=True):
                    yield k, n, [{"s": a, "e": b} for a, b in merged((x["s"], x["e"]) for x in s or ())], i or []

            return some

        parts = map_rows(
            parts,
            ["key", "n_words", "spans", "items"],
            f"{ddl(parts, 'key')}, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>",
            make,
        )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return parts.select(F.col("key").alias(key), "n_words", hit.alias("n_hit"), "items", (hit > 0).alias("contaminated"))
