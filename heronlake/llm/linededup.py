"""Line dedup by winnowing over line hashes.

A line is a line of the text, or a sentence of a longer one. A window holds as few lines as make up :data:`LEAST_WORDS`
words, from a line on or back from a line, so a line of that many words is a window of its own. The smallest line hash of a
window is its fingerprint, with lines of five words or more before shorter ones. Any run that two texts share holds the same
windows, so its fingerprints are found in both (the guarantee of winnowing, Schleimer et al., 2003).

Positions with one fingerprint are brought together by one sort, which is dealt out by ranges of (fingerprint, window,
place), so a line of any frequency is spread over tasks. A match is extended from the fingerprint both ways to the ends of
its windows, by the hash of their content; windows overlap, and those of both directions together make up the longest common
runs, to their first and last line. Every occurrence of a run but the first, in the order of ids and places, is deleted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from heronlake.llm.common import discard, release, slices, stored

#: Shortest run, in words, that counts as repeated; lines of fewer words than LONG are fingerprints of last resort.
LEAST_WORDS, LONG = 5, 5
CUT = re.compile(r"(?<=[.!?]) |\n")
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def windows(texts: list[str | None], least: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """The windows of some texts, by place: numbers of their texts, fingerprints, content hashes, first characters, ends."""
    digests, sizes, starts, ends, bounds = [], [], [], [], [0]
    for t in texts:
        at, began = 0, len(sizes)
        for line in CUT.split(t) if t else ():
            if bare := line.strip():
                digests.append(xxh3_128_digest(bare))
                sizes.append(len(bare.split()))
                starts.append(at)
                ends.append(at + len(line) + 1)
            at += len(line) + 1
        if len(sizes) > began:
            ends[-1] = min(ends[-1], len(t))
        bounds.append(len(sizes))
    n = len(sizes)
    h, first, last = np.frombuffer(b"".join(digests), "<u8").reshape(n, 2), np.array(starts, np.int32), np.array(ends, np.int32)
    size = np.array(sizes, np.int64)
    words = np.concatenate([[0], np.cumsum(size)])
    limit = np.repeat(bounds[1:], np.diff(bounds))
    to = np.searchsorted(words, words[:-1] + least)  # lines i to to[i] have enough words
    whole = np.flatnonzero(to <= limit) if n else np.zeros(0, np.int64)
    # back from an end, the window from line i is the shortest while the one from line i + 1 on ends later
    until = np.minimum(np.append(to[1:], n + 1)[whole], limit[whole] + 1) if n else whole
    ends_of = np.maximum(until - to[whole], 1)
    nth = np.arange(ends_of.sum()) - np.repeat(np.cumsum(ends_of) - ends_of, ends_of)
    whole, to = np.repeat(whole, ends_of), np.repeat(to[whole], ends_of) + nth
    rank = (h[:, 0] >> np.uint64(1)) | ((size < LONG).astype(np.uint64) << np.uint64(63))
    prints, wide = rank[whole], np.flatnonzero(to - whole > 1)
    if len(wide):  # smallest of runs of 1, 2, 4, ... lines
        table, most = [rank], int((to - whole).max())
        while (1 << len(table)) <= most:
            half, low = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(low, np.concatenate([low[half:], np.full(min(half, n), low.max(), np.uint64)])[:n]))
        level = np.log2((to - whole)[wide]).astype(np.int64)
        for k, low in enumerate(table):
            on = wide[level == k]
            prints[on] = np.minimum(low[whole[on]], low[to[on] - (1 << k)])
    power = _powers(BASE, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[:, 1] * power[:n], dtype=np.uint64)])
    own = (sums[to] - sums[whole]) * _powers(_INVERSE, n)[whole]
    own ^= own >> np.uint64(31)
    text = np.searchsorted(bounds, whole, side="right") - 1
    return text, prints.view(np.int64), own.view(np.int64), first[whole], last[to - 1]


def fingerprints(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(print, own, id, rk, first, last): a row for each window, stored."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                of, prints, own, first, last = windows(part.column(2).to_pylist(), least)
                at = pa.array(of)
                columns = [pa.array(prints), pa.array(own), part.column(0).take(at), part.column(1).take(at), pa.array(first), pa.array(last)]
                yield pa.RecordBatch.from_arrays(columns, names=["print", "own", "id", "rk", "first", "last"])
        release()

    out = T.StructType.fromDDL("print bigint, own bigint, rk bigint, first int, last int")
    out = T.StructType([*out.fields[:2], T.StructField("id", kind), *out.fields[2:]])
    return stored(docs.select(F.col(key), row_key(key, text), F.col(text)).mapInArrow(run, out), "prints")


def row_key(key: str, text: str) -> F.Column:
    return F.xxhash64(F.col(key), F.col(text)).alias("_rk")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(id, rk, a, b): for rows, by id and a hash of the row, the spans of characters that repeat earlier ones, stored."""
    found = fingerprints(docs, key, text, least)
    names = ["id", "rk", "a", "b", "print", "own", "first", "edge", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: each after the first of its window is later. A task's first and last window may span tasks."""
        begun, held = 0, None  # windows seen; the first place of the last one

        def out(b: pa.RecordBatch, rows: np.ndarray, a: np.ndarray, edge: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
            b = b.take(pa.array(rows))
            columns = [b.column(2), b.column(3), pa.array(a[rows]), b.column(5), b.column(0), b.column(1), b.column(4)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(edge[rows]), pa.array(head[rows])], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            prints, own, rk, first, last = (b.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
            new = np.concatenate([[True], (prints[1:] != prints[:-1]) | (own[1:] != own[:-1])])
            if held is not None:
                new[0] = (held.column(0)[0].as_py(), held.column(1)[0].as_py()) != (prints[0], own[0])
            start, group = np.flatnonzero(new), np.cumsum(new)
            before = [held.column(i).to_numpy() if held is not None else c[:1] for i, c in ((3, rk), (4, first), (5, last))]
            rk0, first0, last0 = (np.concatenate([x, c[start]])[group] for x, c in zip(before, (rk, first, last), strict=True))
            same = rk == rk0  # a run that overlaps its first occurrence begins after it
            a = np.where(same, np.maximum(first, last0), first).astype(np.int32)
            edge = group + begun == 1
            later = ~edge & ~(same & (first == first0)) & (a < last)
            yield out(b, np.flatnonzero(edge | later), a, edge, edge & new)
            begun += len(start)
            if len(start):
                held = b.slice(start[-1], 1)
        if begun > 1:
            yield out(held, np.zeros(1, np.int64), held.column(4).to_numpy(), np.ones(1, bool), np.ones(1, bool))

    order = ["print", "own", "id", "rk", "first"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = T.StructType([T.StructField("id", docs.schema[key].dataType)])
    for f in T.StructType.fromDDL("rk bigint, a int, b int, print bigint, own bigint, first int, edge boolean, head boolean"):
        out.add(f)
    rows = stored(dealt.mapInArrow(run, out), "later")
    discard(found)
    # two heads for each task, so what the driver gets and sends is as small as the number of tasks
    heads = rows.where("head").groupBy("print", "own").agg(F.min(F.struct("id", "rk", "first", "b")).alias("f"))
    held = docs.sparkSession.sparkContext.broadcast({(r[0], r[1]): (r.f.rk, r.f.first, r.f.b) for r in heads.collect()})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is later; of rows of windows that may span tasks, those after the first row of any task."""
        for b in batches:
            edge = b.column(7).to_numpy(zero_copy_only=False)
            keep, a = ~edge, b.column(2).to_numpy().copy()
            if len(on := np.flatnonzero(edge)):
                of = b.take(pa.array(on))
                rk, first, last = (of.column(i).to_numpy() for i in (1, 6, 3))
                start = [held.value[x] for x in zip(of.column(4).to_pylist(), of.column(5).to_pylist(), strict=True)]
                rk0, first0, last0 = np.array(start, np.int64).reshape(-1, 3).T
                same = rk == rk0
                a[on] = np.where(same, np.maximum(first, last0), first)
                keep[on] = ~(same & (first == first0)) & (a[on] < last)
            columns = [b.column(0), b.column(1), pa.array(a), b.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=names[:4]).filter(pa.array(keep))

    return rows.select(*names[:8]).mapInArrow(settle, T.StructType(out.fields[:4]))


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Half-open spans as disjoint ones, in order."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    at = np.flatnonzero(new)
    return list(zip(a[at].tolist(), b[np.concatenate([at[1:] - 1, [len(a) - 1]])].tolist(), strict=True))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The documents with a new ``text`` and a column ``removed`` with the deleted spans of the old one.

    ``least`` is the shortest run, in words, that counts as repeated. All rows and columns stay, in any number; a text that
    is null or empty has no lines and stays as it is. Rows with the same id and text count as one place, so none of them is
    deleted for another. A null id comes first. A column that is called ``removed`` is replaced.
    """
    spans = repeats(docs, key, text, least).groupBy(F.col("id").alias("_id"), F.col("rk").alias("_rk2"))
    spans = stored(spans.agg(F.collect_list(F.struct("a", "b")).alias("_spans")), "spans")  # those of one text
    plain = docs.drop("removed")
    out = T.StructType([*plain.schema.fields, *T.StructType.fromDDL("removed array<struct<a:int,b:int>>").fields])
    width, at = len(plain.columns), plain.columns.index(text)
    keyed = plain.select("*", row_key(key, text))
    found = keyed.join(spans.hint("merge"), keyed[key].eqNullSafe(F.col("_id")) & (F.col("_rk") == F.col("_rk2")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        for batch in batches:
            for b in slices(batch):
                spans, texts = b.column(b.num_columns - 1), b.column(at)
                removed: list[list] = [[]] * b.num_rows
                if on := [i for i, ok in enumerate(spans.is_valid().to_pylist()) if ok]:
                    new = texts.to_pylist()
                    for i in on:
                        own = spans[i].values
                        kept, done = [], 0
                        removed[i] = merged(own.field(0).to_numpy(), own.field(1).to_numpy())
                        for x, y in removed[i]:
                            kept.append(new[i][done:x])
                            done = y
                        new[i] = "".join([*kept, new[i][done:]])
                        removed[i] = [{"a": x, "b": y} for x, y in removed[i]]
                    texts = pa.array(new, texts.type)
                columns = [*b.columns[:width], pa.array(removed, kinds.field("removed").type)]
                columns[at] = texts
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
        release()

    return found.select(*plain.columns, "_spans").mapInArrow(cut, out).select(*[c for c in docs.columns if c != "removed"], "removed")
