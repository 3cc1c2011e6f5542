"""A stored inverted index: postings in blocks with their largest impact, and exact BM25 by MaxScore.

Chunks are numbered by key within shards of a bounded number of chunks. A block is a row: up to :data:`BLOCK` postings of a
term in a shard, with the largest count and the least length among them, which bound the block's scores whatever the average
length becomes. New chunks are new shards, with counts of their own for each term, so adding some reads none of the others.

A search takes a batch of questions to the shards that hold their terms. In a shard, a question's terms come by their
largest possible score. Once what is left of them can't lift a chunk that no term has named to the k-th best score so far,
only the chunks that still can get there are looked up, and blocks without such a chunk aren't decoded. A few shards come
first; the k-th best score that they give is where the others start.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions.text import tokens
from heronlake.operators.retrieval import K1, TOP, B
from heronlake.sources.scratch import stored
from heronlake.sources.store import Layout, Store

#: Chunks in a shard, about; postings in a block; questions in a batch; shards that a search begins with.
SHARD, BLOCK, ASKED, SEEDS = 16_384, 128, 2048, 4
#: What rounded scores and sums in another order may differ by.
SLACK = 1e-8


def layouts(key: str = "string", buckets: int = 8) -> dict[str, Layout]:
    """The tables of an index whose chunks have keys of some type."""
    return {
        "chunks": Layout(f"shard string, no int, key {key}, len int", ("shard", "no"), (), ("shard",), buckets),
        "postings": Layout("shard string, term string, block int, n int, top int, low int, first int, last int, nos array<int>, tfs array<int>, lens array<int>", ("shard", "term", "block"), (), ("shard",), buckets),
        "terms": Layout("term string, shard string, df bigint", ("term", "shard"), (), ("term",), buckets),
        "segments": Layout("segment string, n bigint, len bigint, shards int", ("segment",), (), (), 1),
    }


class Index:
    """An index below a path. Keys of chunks are of one type; they aren't null and come once."""

    def __init__(self, spark: SparkSession, path: str, key: str = "string", shard: int = SHARD, buckets: int = 8) -> None:
        self.store, self.shard = Store(spark, path, layouts(key, buckets)), shard

    def add(self, chunks: DataFrame, key: str, text: str) -> None:
        """Index new chunks; a chunk whose key is there already is left out, and so is one with a null key. Reads the keys that
        are there, but none of their texts or postings."""
        spark, segment = chunks.sparkSession, uuid.uuid4().hex[:12]
        rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).dropDuplicates(["key"])
        known = self.store.read("chunks").select("key")
        rows = rows.join(known, "key", "left_anti")
        shards = max(1, -(-rows.count() // self.shard))
        rows = rows.withColumn("shard", F.concat(F.lit(f"{segment}-"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string")))
        place = (F.row_number().over(W.partitionBy("shard").orderBy("key")) - 1).alias("no")
        lengths = rows.select("shard", place, "key", F.size("t").alias("len"))
        with self.store.change() as c:
            c.append("chunks", lengths)
            numbered = c.now.read("chunks", keys=spark.createDataFrame([(f"{segment}-{i}",) for i in range(shards)], "shard string")) if shards <= 4096 else c.now.read("chunks").where(F.col("shard").startswith(segment))
            counts = rows.select("key", F.explode("t").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
            postings = counts.join(numbered, "key")
            by = W.partitionBy("shard", "term")
            postings = postings.withColumn("block", F.floor((F.row_number().over(by.orderBy("no")) - 1) / BLOCK).cast("int"))
            one = F.array_sort(F.collect_list(F.struct("no", "tf", "len"))).alias("p")
            blocks = postings.groupBy("shard", "term", "block").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("top"), F.min("len").alias("low"), F.min("no").alias("first"), F.max("no").alias("last"), one)
            c.append("postings", blocks.select("*", F.col("p.no").alias("nos"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens")).drop("p"))
            new = c.now.read("postings").where(F.col("shard").startswith(segment))
            c.append("terms", new.groupBy("term", "shard").agg(F.sum("n").alias("df")))
            own = c.now.read("chunks").where(F.col("shard").startswith(segment)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
            c.append("segments", own.select(F.lit(segment).alias("segment"), "n", "len", F.lit(shards).alias("shards")))

    def stats(self) -> DataFrame:
        """(n, average): chunks, and their average length (1 at least)."""
        sums = self.store.read("segments").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
        return sums.select("n", F.greatest(F.lit(1.0), F.coalesce(F.col("len") / F.nullif("n", F.lit(0)), F.lit(1.0))).alias("average"))

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df): in how many chunks a term is, of all terms or some."""
        rows = self.store.read("terms", keys=terms.select("term") if terms is not None else None)
        return rows.groupBy("term").agg(F.sum("df").alias("df"))

    def weights(self, queries: DataFrame, qkey: str, text: str) -> DataFrame:
        """(qkey, term, weight): inverse document frequency times the count in the question; of terms that the index has."""
        asked = queries.select(qkey, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("qtf"))
        n = self.stats().first().n
        df = self.frequencies(asked.select("term").distinct())
        idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(df, "term").select(qkey, "term", (F.col("qtf") * idf).alias("weight"))

    def search(self, queries: DataFrame, qkey: str = "item_id", text: str = "text", k: int = TOP, read: list | None = None) -> DataFrame:
        """(qkey, key, score, rank): the k best chunks of each question by BM25, scores rounded to nine digits, ties by key.

        Questions come in batches of :data:`ASKED`. A question without a known term, or with a null key, has no rows. ``read``,
        if given, gets (postings decoded, postings of the questions' terms, postings of the index times questions) of each batch.
        """
        spark = queries.sparkSession
        weights = self.weights(queries.where(F.col(qkey).isNotNull()), qkey, text)
        ids = weights.select(qkey).distinct()
        batches = max(1, -(-ids.count() // ASKED))
        average = self.stats().first().average
        snap, out = self.store.snapshot(), None
        shards = snap.read("chunks").select("shard").distinct().orderBy(F.sha2("shard", 256)).limit(SEEDS + 1).collect()
        first = [r.shard for r in shards[:SEEDS]] if len(shards) > SEEDS else []
        for b in range(batches):
            some = weights.where(F.pmod(F.xxhash64(qkey), F.lit(batches)) == b).collect()  # the terms of a bounded number of questions
            names = {q: i for i, q in enumerate(dict.fromkeys(r[qkey] for r in some))}
            batch: dict[int, dict[str, float]] = {}
            for r in some:
                batch.setdefault(names[r[qkey]], {})[r.term] = r.weight
            least: dict[int, float] = {}
            parts = []
            for own in ([True, False] if first else [None]):
                postings = snap.read("postings")
                if own is not None:
                    postings = postings.where(F.col("shard").isin(first) if own else ~F.col("shard").isin(first))
                found = _scored(postings, batch, average, k, least)
                if own or read is not None:
                    found = stored(found, "scored")
                if own:
                    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
                    best = found.where("no IS NOT NULL").withColumn("r", place).where(F.col("r") == k)
                    least = {r.q: r.score for r in best.collect()}  # a row a question
                parts.append(found)
            met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            if read is not None:
                seen = met.where("no IS NULL").agg(F.sum("decoded").alias("a"), F.sum("had").alias("b")).first()
                every = snap.read("postings").agg(F.sum("n").alias("n")).first().n or 0
                read.append((seen.a or 0, seen.b or 0, every * len(names)))
            kinds = T.StructType([T.StructField("q", T.IntegerType()), queries.schema[qkey]])
            keys = spark.createDataFrame([(i, q) for q, i in names.items()], kinds)
            hits = met.where("no IS NOT NULL")
            near = hits.withColumn("r", F.rank().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k)  # with ties
            near = near.join(snap.read("chunks").select("shard", "no", "key"), ["shard", "no"])
            rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key"))
            near = near.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(keys), "q").select(qkey, "key", "score", "rank")
            out = near if out is None else out.unionByName(near)
        return out


def _scored(postings: DataFrame, batch: dict[int, dict[str, float]], average: float, k: int, least: dict[int, float]) -> DataFrame:
    """(shard, q, no, score, decoded, had): the best of each shard; a row without ``no`` tells of what was decoded."""
    spark = postings.sparkSession
    held = spark.sparkContext.broadcast((batch, least))  # of a bounded number of questions
    terms = spark.createDataFrame([(t,) for t in dict.fromkeys(t for x in batch.values() for t in x)], "term string")
    schema = "shard string, q int, no int, score double, decoded bigint, had bigint"

    def run(table: pa.Table) -> pa.Table:
        questions, start = held.value
        shard = Shard(table, average)
        rows: list[tuple] = []
        for q, weights in questions.items():
            nos, scores = shard.best(weights, k, start.get(q, 0.0))
            rows += [(shard.name, q, int(i), float(s), None, None) for i, s in zip(nos, scores, strict=True)]
        rows.append((shard.name, None, None, None, shard.decoded, shard.had))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.Table.from_arrays(columns, names=["shard", "q", "no", "score", "decoded", "had"])

    wanted = postings.join(terms, "term", "left_semi")
    return wanted.groupBy("shard").applyInArrow(run, schema)


class Shard:
    """The blocks of some terms in a shard."""

    def __init__(self, table: pa.Table, average: float) -> None:
        table = table.sort_by([("term", "ascending"), ("block", "ascending")])
        self.name = table.column("shard")[0].as_py()
        self.average, self.decoded, self.had = average, 0, 0
        lists = [table.column(c).combine_chunks() for c in ("nos", "tfs", "lens")]
        self.nos, self.tfs, self.lens = (x.flatten().to_numpy() for x in lists)
        self.n, self.first, self.last, top, low = (table.column(c).to_numpy() for c in ("n", "first", "last", "top", "low"))
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.bound = self.impact(top, low)
        terms = table.column("term").to_pylist()
        cuts = [i for i in range(len(terms)) if not i or terms[i] != terms[i - 1]]
        #: Of each term its blocks, from the first to behind the last.
        self.blocks = {terms[i]: (i, j) for i, j in zip(cuts, [*cuts[1:], len(terms)], strict=True)}
        self.chunks = int(self.last.max()) + 1
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(length, 1) / self.average))

    def open(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, impacts) of the postings of some blocks of a term."""
        a, z = self.start[i], self.start[j]
        self.decoded += int(z - a)
        if (i, j) not in self.known:
            self.known[i, j] = self.impact(self.tfs[a:z], self.lens[a:z])
        return self.nos[a:z], self.known[i, j]

    def best(self, weights: dict[str, float], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The chunks that can be among the k best by some terms, if no score below ``least`` can, and their scores."""
        terms = [(w * self.bound[slice(*self.blocks[t])].max(), w, self.blocks[t]) for t, w in weights.items() if t in self.blocks]
        terms.sort(key=lambda x: -x[0])
        rest = np.append(np.cumsum([x[0] for x in terms][::-1])[::-1], 0.0)
        self.had += int(sum(self.start[j] - self.start[i] for *_, (i, j) in terms))
        total = np.zeros(self.chunks)
        at = 0
        while at < len(terms) and rest[at] >= least - SLACK:  # a chunk that no term has named can still get there
            nos, impacts = self.open(*terms[at][2])
            total[nos] += terms[at][1] * impacts
            at += 1
            least = max(least, self._kth(total, k))
        some = np.flatnonzero((total > 0) & (total + rest[at] >= least - SLACK))
        for i in range(at, len(terms)):
            _, w, blocks = terms[i]
            for b in range(*blocks):
                a, z = np.searchsorted(some, (self.first[b], self.last[b] + 1))
                # of the chunks in this block's range, those that it can still lift far enough
                near = some[a:z][total[some[a:z]] + w * self.bound[b] + rest[i + 1] >= least - SLACK]
                if len(near):
                    nos, impacts = self.open(b, b + 1)
                    place = np.minimum(np.searchsorted(nos, near), len(nos) - 1)
                    same = nos[place] == near
                    total[near[same]] += w * impacts[place[same]]
            least = max(least, self._kth(total[some], k))
            some = some[total[some] + rest[i + 1] >= least - SLACK]
        scores = np.round(total[some], 9)
        order = np.lexsort((some, -scores))
        kept = order[scores[order] > 0]
        if len(kept) > k:  # with those that tie with the last
            kept = kept[scores[kept] >= scores[kept[k - 1]]]
        return some[kept], scores[kept]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> float:
        return float(np.partition(scores, -k)[-k]) if len(scores) >= k else 0.0

