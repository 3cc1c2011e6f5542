"""Flat token files: writing them, and counting the tokens of each document by a separator scan.

A flat file holds nothing but token ids of a fixed width, an end-of-document id after each document. The scan reads
blocks of fixed size in any order, finds the separators of a block by one vectorised comparison, and stitches documents
that cross blocks by a prefix scan over the blocks' summaries (separators so far, position of the last one).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.llm import bpe
from heronlake.llm.common import ddl, map_rows, scratch, stored

#: Tokens in a block, blocks in a group of the prefix scan, and tokens that the writer holds.
BLOCK, GROUP, HELD = 1 << 20, 4096, 1 << 21


def opened(uri: str):
    """A file system and a path in it, for any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def kind(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def write_flat(docs: DataFrame, vocabulary: str, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each partition's documents as one flat file; the manifest (key, path, ordinal) tells their order.

    Names of special tokens inside a text are ordinary text, so the end-of-document id stands at ends only. A task writes
    under a name of its own and renames at its end, so a repeated or speculative task leaves no half a file. The manifest
    is a stored table.
    """
    held = docs.sparkSession.sparkContext.broadcast(bpe.load(vocabulary))

    def make() -> Callable:
        tok = bpe.loaded(held.value, plain=True)
        part = TaskContext.get().partitionId()
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        out = fs.open_output_stream(f"{base}/_{name}")
        state = {"n": 0}

        def some(keys: list, texts: list):
            ids, sizes = tok.encode_flat(texts)
            out.write(np.insert(ids.astype(kind(len(tok.names))), np.cumsum(sizes), tok.end).tobytes())
            for k in keys:
                yield k, f"{folder}/{name}", state["n"]
                state["n"] += 1

        def done() -> None:
            out.close()
            if state["n"]:
                fs.move(f"{base}/_{name}", f"{base}/{name}")
            else:
                fs.delete_file(f"{base}/_{name}")

        some.done = done
        return some

    return stored(
        map_rows(docs, [key, text], f"{ddl(docs, key)}, path string, ordinal bigint", make), "manifest"
    )


def scan(paths: DataFrame, end: int, width: str) -> DataFrame:
    """(path, ordinal, n_tokens): the documents of flat files, in order, without their separators.

    ``paths`` has one column ``path``. Tokens after the last separator of a file are a document too; two separators in a
    row enclose an empty one; an empty file has none. A file's size is read from its store, its blocks are spread over all
    tasks, and only a row for each block is shuffled by file, in groups of blocks first.
    """
    item = np.dtype(width).itemsize

    def sizes() -> Callable:
        def some(names: list):
            for p in names:
                fs, at = opened(p)
                yield p, fs.get_file_info(at).size // item

        return some

    files = map_rows(paths.select("path").distinct(), ["path"], "path string, total bigint", sizes)
    blocks = files.where("total > 0").select(
        "path", "total", F.explode(F.expr(f"sequence(0L, (total - 1) div {BLOCK})")).alias("block")
    )

    def find() -> Callable:
        def some(names: list, totals: list, numbers: list):
            for p, total, b in zip(names, totals, numbers, strict=True):
                fs, at = opened(p)
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(min(BLOCK, total - b * BLOCK) * item, b * BLOCK * item), width)
                ends = np.flatnonzero(ids == end) + b * BLOCK
                if b * BLOCK + len(ids) == total and ids[-1] != end:
                    ends = np.append(ends, total)
                yield p, b, ends.tolist()

        return some

    found = map_rows(
        blocks.repartition("path", "block"), ["path", "total", "block"], "path string, block bigint, ends array<bigint>", find
    )
    found = stored(found.withColumn("g", F.expr(f"block div {GROUP}")), "blocks")
    own = found.select("path", "g", "block", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    groups = own.groupBy("path", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = W.partitionBy("path").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(
        "path", "g", F.sum("n").over(before).alias("gn"), F.max("last").over(before).alias("glast")
    )
    inner = W.partitionBy("path", "g").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = own.select(
        "path", "g", "block", F.sum("n").over(inner).alias("bn"), F.max("last").over(inner).alias("blast")
    ).join(groups, ["path", "g"])
    carried = carried.select(
        "path",
        "block",
        (F.coalesce("bn", F.lit(0)) + F.coalesce("gn", F.lit(0))).alias("first"),
        F.coalesce("blast", "glast", F.lit(-1)).alias("carry"),
    )
    docs = found.where(F.size("ends") > 0).join(carried, ["path", "block"])
    return docs.select("path", "first", "carry", "ends", F.posexplode("ends").alias("i", "at")).select(
        "path",
        (F.col("first") + F.col("i")).alias("ordinal"),
        (F.col("at") - F.when(F.col("i") == 0, F.col("carry")).otherwise(F.expr("ends[i - 1]")) - 1).alias("n_tokens"),
    )


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of each text, counted in flat token files that are written first.

    One row for each input row, repeated rows too; a null or empty text has 0 tokens; the key may be null; other columns
    are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    manifest = write_flat(docs, vocabulary, scratch(spark, "flat"), key, text)
    tok = bpe.WordBpe(bpe.load(vocabulary))
    counts = scan(manifest.select("path"), tok.end, kind(len(tok.names)))
    return manifest.join(counts, ["path", "ordinal"]).select(key, "n_tokens")
