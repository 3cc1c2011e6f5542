"""Retrieval over chunks: hash embeddings, BM25, rank fusion, reranking, validation, citations, prompts and answers.

Queries come in blocks of a bounded number. A block is broadcast, as a matrix of embeddings and one of term weights, and
meets the chunks a batch at a time where they are read: of all the pairs only each task's best lists leave it. Fusion is
exact, see :func:`fused`. All ties fall by the chunk's key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions.text import tokens

#: BM25's saturation and length weight; weights of dense and sparse ranks; lengths of the cascade.
K1, B = 1.5, 0.75
DENSE, SPARSE = 0.55, 0.45
TOP, RERANKED, FINAL = 20, 8, 5
DIMENSIONS = 384
#: Queries in a block; cells of a matrix of scores that are filled at once; tokens that a task remembers.
BLOCK, CELLS, KNOWN = 256, 4_000_000, 400_000
#: What a token is.
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_'-]*")


def term_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf) of the ASCII tokens."""
    return texts.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def hash_slot(term: Column, dims: int = DIMENSIONS) -> Column:
    """The component of a token: the first four bytes of its SHA-256, big-endian, modulo the dimensions."""
    return F.pmod(F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("bigint"), F.lit(dims))


def hash_sign(term: Column) -> Column:
    """1 if the fifth byte is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(term, 256), 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def hash_embedding(texts: DataFrame, key: str, text: str = "text", dims: int = DIMENSIONS) -> DataFrame:
    """(key, slot, value): the components, other than 0, of the L2-normalised hash embedding."""
    raw = term_counts(texts, key, text).groupBy(key, hash_slot(F.col("term"), dims).alias("slot")).agg(
        F.sum(F.col("tf") * hash_sign(F.col("term"))).alias("raw")
    )
    raw = raw.where("raw != 0")
    size = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    return raw.join(size, key).select(key, "slot", (F.col("raw") / F.col("size")).alias("value"))


class Tokens:
    """Numbers of tokens, with the slot and sign of each, up to a bound."""

    def __init__(self, vocabulary: dict[str, int], dims: int = DIMENSIONS) -> None:
        self.vocabulary, self.dims = vocabulary, dims
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.slots, self.signs, self.terms = [], [], []

    def of(self, text: str) -> list[int]:
        out, known = [], self.numbers
        for w in TOKEN.findall(text):
            w = w.lower()
            if (n := known.get(w)) is None:
                n = known[w] = len(known)
                h = hashlib.sha256(w.encode()).digest()
                self.slots.append(int.from_bytes(h[:4], "big") % self.dims)
                self.signs.append(1.0 if h[4] % 2 == 0 else -1.0)
                self.terms.append(self.vocabulary.get(w, -1))
            out.append(n)
        return out

    def table(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, unit vectors, counts of the vocabulary's terms) of some texts."""
        if len(self.numbers) > KNOWN:
            self.clear()
        found = [self.of(t or "") for t in texts]
        sizes = np.array([len(x) for x in found])
        row, at = np.repeat(np.arange(len(texts)), sizes), np.array([n for x in found for n in x], np.int64)
        slots, signs, terms = np.array(self.slots, np.int64), np.array(self.signs), np.array(self.terms, np.int64)
        raw = np.bincount(row * self.dims + slots[at], signs[at], len(texts) * self.dims).reshape(len(texts), -1) if len(at) else np.zeros((len(texts), self.dims))
        norm = np.sqrt((raw * raw).sum(1, keepdims=True))
        width = max(1, len(self.vocabulary))
        term = terms[at] if len(at) else at
        counts = np.bincount((row * width + term)[term >= 0], minlength=len(texts) * width).reshape(len(texts), width)
        return sizes, np.divide(raw, norm, out=raw, where=norm > 0), counts


@dataclass
class Asked:
    """A block of queries: their keys, the numbers of their terms, term weights (by query) and unit vectors."""

    keys: list
    vocabulary: dict[str, int]
    weights: np.ndarray
    vectors: np.ndarray
    average: float
    better: dict[int, list] = field(default_factory=dict)

    def scores(self, tokens: Tokens, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(dense, sparse) of some chunks against all queries, rounded so that sums in any order rank alike."""
        sizes, vectors, counts = tokens.table(texts)
        length = 1 - B + B * np.maximum(sizes, 1)[:, None] / self.average
        weight = counts * (K1 + 1) / (counts + K1 * length)
        return np.round(vectors @ self.vectors.T, 9), np.round(weight @ self.weights.T, 9)


def asked(rows: list, chunks: DataFrame, text: str) -> Asked:
    """A block of (key, text) with the statistics of the chunks: one aggregation, of the block's terms only."""
    words = [[w.lower() for w in TOKEN.findall(r[1] or "")] for r in rows]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in words for w in x))}
    spark, toks = chunks.sparkSession, tokens(F.col(text))
    lengths = chunks.select(F.size(toks).alias("len"))
    n, average = lengths.agg(F.count(F.lit(1)), F.greatest(F.avg("len"), F.lit(1.0))).first()
    df = np.zeros(max(1, len(vocabulary)))
    if vocabulary:
        known = F.broadcast(spark.createDataFrame(list(vocabulary.items()), "term string, i int"))  # the terms of a block
        found = chunks.select(F.explode(F.array_distinct(toks)).alias("term")).join(known, "term")
        for r in found.groupBy("i").count().collect():
            df[r.i] = r["count"]
    idf = np.where(df > 0, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0)
    _, vectors, counts = Tokens(vocabulary).table([r[1] for r in rows])
    return Asked([r[0] for r in rows], vocabulary, counts * idf, vectors, average or 1.0)


def _batches(batches: Iterator[pa.RecordBatch], block: Asked) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(keys, the same in Arrow, dense, sparse) of runs of chunks; a column for each query."""
    tokens_ = Tokens(block.vocabulary)
    step = max(1, CELLS // max(len(block.vocabulary), len(block.keys), DIMENSIONS))
    for b in batches:
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            keys = np.array(part.column(0).to_pylist())
            yield keys, part.column(0), *block.scores(tokens_, part.column(1).to_pylist())


def best_lists(block: Asked, chunks: DataFrame, ckey: str, text: str, most: int) -> DataFrame:
    """(q, key, dense, sparse): for each query, by number, the chunks that are among the ``most`` best of a task in a list; chunks
    without a key are left out."""
    held = chunks.sparkSession.sparkContext.broadcast(block)  # BLOCK queries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(held.value.keys)
        kept: list[list] = [[None, None] for _ in range(n)]  # for each query and list: (scores, keys, the other scores)
        for keys, _, dense, sparse in _batches(batches, held.value):
            for q in range(n):
                for side, (own, other) in enumerate(((dense[:, q], sparse[:, q]), (sparse[:, q], dense[:, q]))):
                    old = kept[q][side]
                    least = max(0.0, old[0].min()) if old is not None and len(old[0]) >= most else 0.0
                    on = np.flatnonzero(own >= least if least > 0 else own > 0)
                    if len(on) > most:
                        on = on[own[on] >= np.partition(own[on], -most)[-most]]
                    if not len(on):
                        continue
                    rows = own[on], keys[on], other[on]
                    if old is not None:
                        rows = tuple(np.concatenate(x) for x in zip(old, rows, strict=True))
                    order = np.lexsort((rows[1], -rows[0]))[:most]
                    kept[q][side] = tuple(x[order] for x in rows)
        for q in range(n):
            for side in (0, 1):
                if (rows := kept[q][side]) is not None:
                    scores = (rows[0], rows[2]) if side == 0 else (rows[2], rows[0])
                    columns = [pa.array(np.full(len(rows[0]), q, np.int32)), pa.array(rows[1].tolist(), kind), *map(pa.array, scores)]
                    yield pa.RecordBatch.from_arrays(columns, names=["q", "key", "dense", "sparse"])

    from pyspark.sql.pandas.types import to_arrow_type

    key = chunks.schema[ckey].dataType
    kind = to_arrow_type(key)
    out = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("key", key), T.StructField("dense", T.DoubleType()), T.StructField("sparse", T.DoubleType())])
    found = chunks.where(F.col(ckey).isNotNull()).select(F.col(ckey), F.col(text)).mapInArrow(run, out).distinct()
    places = [F.row_number().over(W.partitionBy("q").orderBy(F.desc(c), "key")) for c in ("dense", "sparse")]
    found = found.select("*", places[0].alias("d"), places[1].alias("s"))
    return found.where(f"(dense > 0 AND d <= {most}) OR (sparse > 0 AND s <= {most})").drop("d", "s")


def blocks(queries: DataFrame, qkey: str, text: str = "text") -> Iterator[list]:
    """The queries in blocks of about :data:`BLOCK`, one after another."""
    rows = queries.select(qkey, text)
    n = max(1, -(-rows.count() // BLOCK))
    for b in range(n):
        some = rows.where(F.pmod(F.xxhash64(qkey, text), F.lit(n)) == b) if n > 1 else rows
        if found := some.collect():
            yield found


def fused(queries: DataFrame, chunks: DataFrame, qkey: str, ckey: str, text: str = "text", k: int = TOP) -> DataFrame:
    """(qkey, ckey, dense, sparse, score): the weighted sum of reciprocal ranks, for chunks that hold the best ``k``.

    A chunk that is behind place m = k / DENSE in both lists has at most (DENSE + SPARSE) / m = DENSE / k, which the k best
    of the dense list exceed, so the first m places of both lists hold the best k. (With fewer than k chunks of a positive
    dense score, all of those are among them, and the others rank as in the sparse list.) The ranks of these candidates in
    the other list are counted exactly, over all chunks. A block of queries gives a bounded number of candidates, and what
    is shuffled are the best lists and one count for each task and candidate.
    """
    spark, most = chunks.sparkSession, int(k / DENSE) + 1
    out = None
    for rows in blocks(queries, qkey):
        block = asked(rows, chunks, text)
        names: list[list] = [[] for _ in rows]
        for r in best_lists(block, chunks, ckey, text, most).collect():  # 2 * most rows for each query of the block at most
            names[r.q].append((r.key, r.dense, r.sparse))
        block.better = {q: x for q, x in enumerate(names) if x}
        held = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            better = {q: np.zeros((2, len(x)), np.int64) for q, x in held.value.better.items()}
            for keys, _, dense, sparse in _batches(batches, held.value):
                for q, some in held.value.better.items():
                    for side, scores in enumerate((dense[:, q], sparse[:, q])):
                        ranked = np.sort(scores)
                        own = np.array([x[1 + side] for x in some])
                        high = np.searchsorted(ranked, own, side="right")
                        better[q][side] += len(ranked) - high
                        for i in np.flatnonzero(high > np.searchsorted(ranked, own)):
                            better[q][side, i] += int((keys[scores == own[i]] < some[i][0]).sum())
            for q, n in better.items():
                columns = [pa.array(np.full(n.shape[1], q, np.int32)), pa.array(np.arange(n.shape[1], dtype=np.int32)), pa.array(n[0]), pa.array(n[1])]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "i", "d", "s"])

        ranks = chunks.where(F.col(ckey).isNotNull()).select(F.col(ckey), F.col(text)).mapInArrow(count, "q int, i int, d bigint, s bigint")
        ranks = ranks.groupBy("q", "i").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
        kinds = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField(qkey, queries.schema[qkey].dataType), T.StructField(ckey, chunks.schema[ckey].dataType), T.StructField("dense", T.DoubleType()), T.StructField("sparse", T.DoubleType())])
        known = spark.createDataFrame([(q, i, rows[q][0], *x) for q, some in block.better.items() for i, x in enumerate(some)], kinds)
        part = [F.when(F.col(c) > 0, w / (1 + F.col(r))).otherwise(0.0) for c, w, r in (("dense", DENSE, "d"), ("sparse", SPARSE, "s"))]
        found = ranks.join(F.broadcast(known), ["q", "i"]).select(qkey, ckey, "dense", "sparse", F.round(part[0] + part[1], 9).alias("score"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = T.StructType([queries.schema[qkey], chunks.schema[ckey], *(T.StructField(c, T.DoubleType()) for c in ("dense", "sparse", "score"))])
        return spark.createDataFrame([], kinds)
    return out


def ranked_list(queries: DataFrame, chunks: DataFrame, qkey: str, ckey: str, by: str, text: str = "text", k: int = TOP) -> DataFrame:
    """(qkey, ckey, dense, sparse, rank): the ``k`` best chunks of each query by ``dense`` or ``sparse``."""
    spark, out = chunks.sparkSession, None
    for rows in blocks(queries, qkey):
        kinds = T.StructType([T.StructField("q", T.IntegerType()), queries.schema[qkey]])
        names = F.broadcast(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], kinds))  # the keys of a block
        found = best_lists(asked(rows, chunks, text), chunks, ckey, text, k).where(F.col(by) > 0).withColumnRenamed("key", ckey)
        found = top_k(found, "q", by, ckey, k).join(names, "q").drop("q")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = T.StructType([queries.schema[qkey], chunks.schema[ckey], T.StructField("dense", T.DoubleType()), T.StructField("sparse", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], kinds)
    return out


def nearest(queries: DataFrame, vectors: DataFrame, qkey: str, key: str, vector: str, k: int) -> DataFrame:
    """(qkey, key, score, rank): the k nearest vectors of each query vector by cosine; queries come in blocks.

    A null, zero or non-finite vector and one of other dimensions have a cosine of 0 with any. Ties go by key, a null one first.
    """
    out = None
    kinds = T.StructType([T.StructField(qkey, queries.schema[qkey].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    for rows in blocks(queries, qkey, vector):
        held = vectors.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            schema, names = to_arrow_schema(kinds), [r[0] for r in held.value]
            by: dict[int, list[int]] = {}
            for q, r in enumerate(held.value):
                by.setdefault(len(r[1] or ()), []).append(q)
            asked_ = {d: units([held.value[q][1] for q in qs], d) for d, qs in by.items()}
            for b in batches:
                given = b.column(1).to_pylist()
                order = np.empty(b.num_rows, np.int64)  # the place of each key
                order[pc.sort_indices(b.column(0), null_placement="at_start").to_numpy()] = np.arange(b.num_rows)
                for d, qs in by.items():
                    scores = np.round(units(given, d) @ asked_[d].T, 9)
                    for j, q in enumerate(qs):
                        on = np.lexsort((order, -scores[:, j]))[:k]
                        columns = [pa.array([names[q]] * len(on), schema.field(0).type), b.column(0).take(pa.array(on)), pa.array(scores[on, j])]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

        found = vectors.select(key, vector).mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    out = vectors.sparkSession.createDataFrame([], kinds) if out is None else out
    return top_k(out, qkey, "score", key, k)


def units(vectors: list, dims: int) -> np.ndarray:
    """Unit vectors as rows; zeros for what is null, of other dimensions, zero or not finite."""
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims and None not in v:
            x[i] = v
    size = np.sqrt((x * x).sum(1, keepdims=True))
    x[~np.isfinite(size[:, 0])] = 0
    return np.divide(x, size, out=np.zeros_like(x), where=np.isfinite(size) & (size > 0))


def top_k(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, with their rank."""
    order = W.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, qkey: str, dkey: str, text: str = "text", strategy: str = "local") -> DataFrame:
    """Candidates with ``rerank_score`` (shared terms and a bonus for the whole phrase) and the blended ``final``.

    The strategy ``none`` keeps the fused score.
    """
    if strategy == "none":
        return candidates.withColumn("rerank_score", F.lit(0.0)).withColumn("final", F.col("score"))
    if strategy != "local":
        raise ValueError(f"no reranker is called {strategy}")
    q = queries.select(qkey, F.col("text").alias("q"))
    d = chunks.select(dkey, F.col(text).alias("d"))
    met = candidates.join(q, qkey).join(d, dkey)
    qt = F.array_distinct(tokens(F.col("q")))
    overlap = F.size(F.array_intersect(qt, tokens(F.col("d")))) / F.greatest(F.size(qt), F.lit(1))
    bonus = F.when(F.contains(F.lower("d"), F.lower("q")), 0.15).otherwise(0.0)
    met = met.withColumn("rerank_score", F.least(overlap + bonus, F.lit(1.0)))
    return met.withColumn("final", F.round(0.7 * F.col("score") + 0.3 * F.col("rerank_score"), 9)).drop("q", "d")


def hybrid_search(queries: DataFrame, chunks: DataFrame, qkey: str = "item_id", ckey: str = "chunk_id", text: str = "chunk") -> DataFrame:
    """(qkey, ckey, dense, sparse, score, rerank_score, final, rank): fusion, the best 8 reranked, the best 5 kept."""
    best = top_k(fused(queries, chunks, qkey, ckey, text), qkey, "score", ckey, RERANKED).drop("rank")
    return top_k(rerank(best, queries, chunks, qkey, ckey, text), qkey, "final", ckey, FINAL)


def validation(results: DataFrame, qkey: str, score: str = "final", words: str = "n_words") -> DataFrame:
    """(qkey, level, sufficient, quality, completeness, confidence) of each query's results."""
    s = results.groupBy(qkey).agg(
        F.max(score).alias("best"), F.avg(score).alias("mean"), F.var_pop(score).alias("var"),
        F.count(F.lit(1)).alias("n"), F.sum(words).alias("words"),
    )
    one = F.lit(1.0)
    confidence = F.greatest(
        F.least(
            F.col("best") * 0.5 + F.col("mean") * 0.3 - F.least(F.col("var") * 2, F.lit(0.2)) + F.least(F.col("n") * 0.05, F.lit(0.15)),
            one,
        ),
        F.lit(0.0),
    )
    level = F.when(F.col("best") < 0.08, "low").when(F.col("n") == 1, "medium").when(F.col("best") >= 0.25, "high").otherwise("medium")
    return s.select(
        qkey,
        level.alias("level"),
        (F.col("best") >= 0.08).alias("sufficient"),
        F.round(F.least(F.col("mean") * (1 + 0.2 * F.ln(F.col("n") + 1)), one), 6).alias("quality"),
        F.round(F.least(F.col("mean") * (1 + 0.15 * F.ln(F.col("words") + 1)), one), 6).alias("completeness"),
        F.round(confidence, 6).alias("confidence"),
    )


def validated(queries: DataFrame, found: DataFrame, qkey: str) -> DataFrame:
    """The validation of every query; one without results has the level none."""
    row = queries.select(qkey).join(found, qkey, "left")
    return row.fillna("none", ["level"]).fillna(False, ["sufficient"]).fillna(0.0, ["quality", "completeness", "confidence"])


def prompts(results: DataFrame, queries: DataFrame, qkey: str = "item_id", text: str = "chunk", memory: DataFrame | None = None) -> DataFrame:
    """(qkey, prompt): the session's memory if there is any, numbered contexts, each under its label, then the question.

    ``results`` has rank, name, section and the text of each context; a query has FINAL contexts at most. ``memory`` has
    (qkey, memory).
    """
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" / "), "section")).otherwise("")
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("name", F.lit("unknown document")), section, F.lit("\n"), F.col(text))
    block = results.groupBy(qkey).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("c")))), lambda x: x["c"]), "\n\n").alias("block")
    )
    rows = queries.select(qkey, F.col("text").alias("q")).join(block, qkey, "left")
    rows = rows.join(memory, qkey, "left") if memory is not None else rows.withColumn("memory", F.lit(None).cast("string"))
    told = F.when(F.coalesce("memory", F.lit("")) != "", F.concat(F.lit("Session memory:\n"), "memory", F.lit("\n\n"))).otherwise("")
    return rows.select(
        qkey, F.concat(told, F.lit("Retrieved context:\n"), F.coalesce("block", F.lit("No retrieved context.")), F.lit("\n\nUser question: "), F.col("q")).alias("prompt")
    )


def extracted(results: DataFrame, queries: DataFrame, qkey: str, text: str = "chunk", words: int = 40) -> DataFrame:
    """(qkey, answer): the beginning of the best context with its citation; what stands in for a language model."""
    best = results.where("rank = 1").select(qkey, F.array_join(F.slice(F.split(text, " "), 1, words), " ").alias("a"))
    rows = queries.select(qkey).join(best, qkey, "left")
    return rows.select(qkey, F.coalesce(F.concat("a", F.lit(" [1]")), F.lit("No retrieved context.")).alias("answer"))


def turns(queries: DataFrame, answers: DataFrame, qkey: str) -> DataFrame:
    """(qkey, turn, role, content): what a session gains from a question: the question and its answer."""
    both = queries.select(qkey, F.col("text").alias("q")).join(answers, qkey)
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return both.select(qkey, F.posexplode(pair).alias("turn", "t")).select(qkey, "turn", "t.role", "t.content")
