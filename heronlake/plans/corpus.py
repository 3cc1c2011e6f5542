"""Queries over documents, benchmark items and embeddings. A document's tenant is its source, its knowledge base its lang."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions import tables as O
from heronlake.functions import text as X
from heronlake.functions.vectors import cosine
from heronlake.operators import activity as A
from heronlake.operators import chunkers, chunking, embedding, inverted, ivf, profile, retrieval
from heronlake.plans.registry import TOKENS, WORDS, query
from heronlake.sources import files
from heronlake.sources.scratch import once, scratch
from heronlake.sources.tables import table

BIG = "cast(count(*) as bigint)"


@query(f"SELECT source, lang, {BIG} AS n FROM documents GROUP BY ALL")
def doc_count_by_kb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT source, lang, cast(sum(CASE WHEN n = 0 THEN 0 ELSE greatest(ceil((n - 320) / 272.0), 0) + 1 END) AS bigint) AS n
FROM (SELECT source, lang, len({WORDS.format("text")}) AS n FROM documents) GROUP BY ALL""")
def chunk_count_by_kb(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = F.size(chunking.window_starts(F.size(X.words(F.col("text")))))
    return docs.groupBy("source", "lang").agg(F.sum(n).cast("bigint").alias("n"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src1' AND lang = 'en' ORDER BY doc_id")
def doc_list_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'src1' AND lang = 'en'").select("doc_id", "lang", "n_chars").orderBy("doc_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') AND source = 'src2'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """A conjunction over metadata keys; a missing key compares as None, a list holds any of its values."""
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    rows = table(spark, d, "documents").select("doc_id", meta.alias("m"))
    return rows.where(
        F.coalesce(F.col("m")["lang"], F.lit("None")).isin("fr", "de")
        & (F.coalesce(F.col("m")["source"], F.lit("None")) == "src2")
        & (F.coalesce(F.try_element_at("m", F.lit("absent")), F.lit("None")) == "None")
    ).select("doc_id")


@query(f"SELECT term, {BIG} AS n FROM (SELECT unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT term, {BIG} AS df FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents) GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"""SELECT doc_id, word, n, rank FROM (
  SELECT doc_id, word, {BIG} AS n, cast(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS int) AS rank
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, {WORDS.format("lower(text)")} AS w FROM documents)) WHERE length(word) > 4 GROUP BY doc_id, word)
WHERE rank <= 5""")
def keyword_top5(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.posexplode(X.words(F.lower("text"))).alias("i", "word"))
    n = w.where("length(word) > 4").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "i"))
    return n.withColumn("rank", rank).where("rank <= 5").select("doc_id", "word", "n", "rank")


@query(f"""SELECT doc_id, ordinal, sha1(concat_ws(':', doc_id::VARCHAR, ordinal::VARCHAR, chunk)) AS chunk_id, n_words FROM (
  SELECT doc_id, cast(i AS int) AS ordinal, array_to_string(w[i * 272 + 1 : i * 272 + 320], ' ') AS chunk,
         len(w[i * 272 + 1 : i * 272 + 320])::BIGINT AS n_words
  FROM (SELECT doc_id, w, unnest(range(0, cast(greatest(ceil((len(w) - 320) / 272.0), 0) AS bigint) + 1)) AS i
        FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents) WHERE len(w) > 0))""")
def sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sliding(table(spark, d, "documents")).select("doc_id", "ordinal", "chunk_id", "n_words")


def _windows_sql(x: str) -> str:
    return f"list_transform(range(0, greatest(ceil((len({x}) - 320) / 272.0), 0)::BIGINT + 1), lambda k: array_to_string(({x})[k * 272 + 1 : k * 272 + 320], ' '))"


_TAIL = "(held[greatest(len(held) - 47, 1) :] || w)"


_HIERARCHICAL = f"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS x FROM documents)
), lw AS (SELECT doc_id, i, {WORDS.format("line")} AS w FROM lines), s AS (
  SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS held, []::VARCHAR[] AS out FROM documents UNION ALL
  SELECT s.doc_id, lw.i, CASE WHEN len(held) + len(w) <= 320 AND len(w) <= 320 THEN held || w WHEN len(w) > 320 OR len({_TAIL}) > 320 THEN [] ELSE {_TAIL} END,
    CASE WHEN len(held) + len(w) <= 320 AND len(w) <= 320 THEN [] ELSE (CASE WHEN len(held) > 0 THEN [array_to_string(held, ' ')] ELSE [] END)
      || CASE WHEN len(w) > 320 THEN {_windows_sql("w")} WHEN len({_TAIL}) > 320 THEN {_windows_sql(_TAIL)} ELSE [] END END
  FROM s JOIN lw ON lw.doc_id = s.doc_id AND lw.i = s.i + 1
), ends AS (SELECT doc_id, i, out FROM s UNION ALL SELECT doc_id, i + 1, CASE WHEN len(held) > 0 THEN [array_to_string(held, ' ')] ELSE [] END FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1
), c AS (SELECT doc_id, i, unnest(range(1, len(out) + 1)) AS j, unnest(out) AS chunk FROM ends
), n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS ordinal, chunk FROM c)
SELECT doc_id, ordinal, 'General' AS section, chunk, sha1(doc_id || ':' || ordinal || ':' || chunk) AS chunk_id FROM n"""


@query(_HIERARCHICAL)
def chunk_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    return chunking.hierarchical(table(spark, d, "documents"))


@query(_HIERARCHICAL)
def packed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same chunks from documents whose lines are rows: an ordered fold over a partitioned table."""
    return chunkers.packed_lines(chunkers.lines(table(spark, d, "documents")))


@query(_HIERARCHICAL.replace("SELECT doc_id, ordinal, 'General'", "SELECT 'hierarchical' AS chunker, doc_id, ordinal, 'General'") + f"""
UNION ALL SELECT 'sliding', doc_id, ordinal, 'General', chunk, sha1(concat_ws(':', doc_id::VARCHAR, ordinal::VARCHAR, chunk)) FROM (
  SELECT doc_id, cast(i AS int) AS ordinal, array_to_string(w[i * 272 + 1 : i * 272 + 320], ' ') AS chunk
  FROM (SELECT doc_id, w, unnest(range(0, cast(greatest(ceil((len(w) - 320) / 272.0), 0) AS bigint) + 1)) AS i
        FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents) WHERE len(w) > 0))""")
def chunkers_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Both chunkers as table functions, joined laterally."""
    docs = table(spark, d, "documents")
    both = [chunkers.chunked(docs, by, text=x).withColumn("chunker", F.lit(by)) for by, x in (("hierarchical", "text"), ("sliding", chunkers.spaced()))]
    return both[0].unionByName(both[1])


CHUNKS = f"""chunks AS (SELECT doc_id, ordinal, chunk, sha1(concat_ws(':', doc_id::VARCHAR, ordinal::VARCHAR, chunk)) AS chunk_id, source, lang, n_words FROM (
  SELECT doc_id, source, lang, cast(i AS int) AS ordinal, array_to_string(w[i * 272 + 1 : i * 272 + 320], ' ') AS chunk,
    len(w[i * 272 + 1 : i * 272 + 320])::BIGINT AS n_words
  FROM (SELECT doc_id, source, lang, w, unnest(range(0, cast(greatest(ceil((len(w) - 320) / 272.0), 0) AS bigint) + 1)) AS i
        FROM (SELECT doc_id, source, lang, {WORDS.format("text")} AS w FROM documents) WHERE len(w) > 0)))"""


def _embedded(key: str, text: str, rows: str) -> str:
    return f"""terms AS (SELECT side, id, term, count(*) AS tf FROM (
  SELECT 0 AS side, {key}::VARCHAR AS id, unnest({TOKENS.format(text)}) AS term FROM {rows}
  UNION ALL SELECT 1, item_id::VARCHAR, unnest({TOKENS.format("text")}) FROM benchmark) GROUP BY ALL), raw AS (
  SELECT side, id, ('0x' || sha256(term)[1:8])::BIGINT % 384 AS slot,
         sum(tf * CASE WHEN ('0x' || sha256(term)[9:10])::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS raw
  FROM terms GROUP BY ALL), emb AS (
  SELECT side, id, slot, raw / sqrt(sum(raw * raw) OVER (PARTITION BY side, id)) AS value FROM raw WHERE raw <> 0)"""


def _sparse(where: str = "true") -> str:
    return f"""some_ AS (SELECT * FROM chunks WHERE {where}), stats AS (SELECT count(*) AS n, greatest(avg(len({TOKENS.format("chunk")})), 1) AS av FROM some_),
lens AS (SELECT chunk_id, len({TOKENS.format("chunk")}) AS len FROM some_),
df AS (SELECT term, count(*) AS df FROM terms JOIN lens ON lens.chunk_id = id WHERE side = 0 GROUP BY term), sparse AS (
  SELECT q.id::BIGINT AS item_id, d.id AS chunk_id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5))
         * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * greatest(len, 1) / av))), 9) AS sparse
  FROM terms q JOIN df USING (term) JOIN terms d ON d.term = q.term AND d.side = 0 JOIN lens ON lens.chunk_id = d.id, stats
  WHERE q.side = 1 GROUP BY ALL)"""


DENSE = f"""{CHUNKS}, {_embedded("chunk_id", "chunk", "chunks")}, dense AS (
  SELECT q.id::BIGINT AS item_id, d.id AS chunk_id, round(sum(q.value * d.value), 9) AS dense
  FROM emb q JOIN emb d ON q.side = 1 AND d.side = 0 AND q.slot = d.slot GROUP BY ALL)"""
FUSED = f"""{DENSE}, {_sparse()}, both_ AS (
  SELECT item_id, chunk_id, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse FROM dense FULL JOIN sparse USING (item_id, chunk_id)
), fused AS (SELECT item_id, chunk_id, dense, sparse, round(
    0.55 * CASE WHEN dense <= 0 THEN 0 ELSE 1.0::DOUBLE / row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, chunk_id) END
  + 0.45 * CASE WHEN sparse <= 0 THEN 0 ELSE 1.0::DOUBLE / row_number() OVER (PARTITION BY item_id ORDER BY sparse DESC, chunk_id) END, 9) AS score FROM both_)"""
HYBRID = f"""{FUSED}, best AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 8
), met AS (SELECT b.*, least(len(list_intersect(list_distinct({TOKENS.format("q.text")}), list_distinct({TOKENS.format("d.chunk")})))
         / greatest(len(list_distinct({TOKENS.format("q.text")})), 1)::DOUBLE
         + CASE WHEN contains(lower(d.chunk), lower(q.text)) THEN 0.15 ELSE 0 END, 1.0) AS rerank_score
  FROM best b JOIN benchmark q USING (item_id) JOIN chunks d USING (chunk_id)
), hybrid AS (SELECT item_id, chunk_id, score, rerank_score, round(0.7 * score + 0.3 * rerank_score, 9) AS final FROM met
), ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY final DESC, chunk_id) AS int) AS rank FROM hybrid
), final_ AS (SELECT * FROM ranked WHERE rank <= 5)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The questions, and the chunks of all documents with their names and sections, stored as an ingestion leaves them."""
    return table(spark, d, "benchmark"), once(spark, d, "documents", "chunks", lambda: chunking.sliding(table(spark, d, "documents"), also=("source", "lang")))


@query(f"WITH {_embedded('doc_id', 'text', 'documents')} SELECT id::BIGINT AS doc_id, slot, round(value, 6) AS value FROM emb WHERE side = 0")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.hash_embedding(table(spark, d, "documents"), "doc_id")
    return found.select("doc_id", "slot", F.round("value", 6).alias("value"))


@query(f"WITH {_embedded('doc_id', 'text', 'documents')} SELECT id::BIGINT AS doc_id, slot, round(value, 6) AS value FROM emb WHERE side = 0")
def embedding_store(spark: SparkSession, d: str) -> DataFrame:
    """The same vectors from a store that embeds each content once, filled in two steps."""
    docs, store = table(spark, d, "documents"), embedding.EmbeddingStore(spark, scratch(spark, "embeddings"), "hash")
    store.embed(docs.where("lang = 'en'"), "doc_id", "text")
    found = store.embed(docs, "doc_id", "text").select("doc_id", F.posexplode("vector").alias("slot", "value"))
    return found.where("value != 0").select("doc_id", F.col("slot").cast("bigint").alias("slot"), F.round("value", 6).alias("value"))


@query(f"""WITH {DENSE} SELECT item_id, chunk_id, round(dense, 6) AS dense, rank FROM (
SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, chunk_id) AS int) AS rank FROM dense WHERE dense > 0) WHERE rank <= 20""")
def dense_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk is scored against every question; the best 20 of each are the list that fusion ranks."""
    found = retrieval.ranked_list(*_sides(spark, d), "item_id", "chunk_id", "dense", "chunk")
    return found.select("item_id", "chunk_id", F.round("dense", 6).alias("dense"), "rank")


@query(f"""WITH {DENSE}, {_sparse()} SELECT item_id, chunk_id, round(sparse, 6) AS sparse, rank FROM (
SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY sparse DESC, chunk_id) AS int) AS rank FROM sparse) WHERE rank <= 20""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.ranked_list(*_sides(spark, d), "item_id", "chunk_id", "sparse", "chunk")
    return found.select("item_id", "chunk_id", F.round("sparse", 6).alias("sparse"), "rank")


@query(f"""WITH {DENSE}, {_sparse()} SELECT item_id, chunk_id, round(sparse, 6) AS sparse, rank FROM (
SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY sparse DESC, chunk_id) AS int) AS rank FROM sparse) WHERE rank <= 20""")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """By a stored index, to which the English chunks come first and the others later."""
    items, chunks = _sides(spark, d)
    index = inverted.Index(spark, scratch(spark, "index"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for some in (chunks.where(english), chunks.where(~english)):
        index.add(some, "chunk_id", "chunk")
    return index.search(items).select("item_id", F.col("key").alias("chunk_id"), F.round("score", 6).alias("sparse"), "rank")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents), f AS (SELECT unnest(list_distinct(t)) AS term FROM t)
SELECT term, {BIG} AS df, (SELECT count(*)::BIGINT FROM documents) AS n, (SELECT round(greatest(avg(len(t)), 1), 6) FROM t) AS average FROM f GROUP BY term""")
def index_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies and the average length as a stored index keeps them."""
    index = inverted.Index(spark, scratch(spark, "index"), "bigint")
    index.add(table(spark, d, "documents"), "doc_id", "text")
    n, average = index.stats().first()
    return index.frequencies().select("term", "df", F.lit(n).alias("n"), F.round(F.lit(average), 6).alias("average"))


@query(f"""WITH {DENSE}, {_sparse("lang = 'en'")} SELECT item_id, chunk_id, round(sparse, 6) AS sparse FROM sparse
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sparse DESC, chunk_id) <= 20""")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Statistics are those of the filtered candidates."""
    items, chunks = _sides(spark, d)
    found = retrieval.ranked_list(items, chunks.where("lang = 'en'"), "item_id", "chunk_id", "sparse", "chunk")
    return found.select("item_id", "chunk_id", F.round("sparse", 6).alias("sparse"))


@query(f"WITH {FUSED} SELECT item_id, chunk_id, round(score, 6) AS score FROM fused QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 20")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.fused(*_sides(spark, d), "item_id", "chunk_id", "chunk")
    return retrieval.top_k(found, "item_id", "score", "chunk_id", retrieval.TOP).select("item_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {HYBRID} SELECT item_id, chunk_id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score, round(final, 6) AS final, rank FROM final_")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.hybrid_search(*_sides(spark, d))
    rounded = [F.round(c, 6).alias(c) for c in ("score", "rerank_score", "final")]
    return found.select("item_id", "chunk_id", *rounded, "rank")


@query(f"""WITH {HYBRID} SELECT 'fusion' AS step, NULL::DOUBLE AS best, NULL::DOUBLE AS mean UNION ALL SELECT 'candidates', round(max(score), 6), round(avg(score), 6) FROM best
UNION ALL SELECT 'rerank', NULL, NULL UNION ALL SELECT 'results', round(max(final), 6), round(avg(final), 6) FROM final_""")
def search_profile(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a search with the best and the mean score, observed as the rows pass."""
    steps = profile.Profile(spark)
    profile.profiled_search(steps, *_sides(spark, d))
    return steps.table().select("step", *(F.round(F.col("counts")[c], 6).alias(c) for c in ("best", "mean")))


@query(f"WITH {HYBRID} SELECT item_id, chunk_id, round(rerank_score, 6) AS rerank_score, round(final, 6) AS final FROM hybrid")
def local_rerank(spark: SparkSession, d: str) -> DataFrame:
    items, chunks = _sides(spark, d)
    best = retrieval.top_k(retrieval.fused(items, chunks, "item_id", "chunk_id", "chunk"), "item_id", "score", "chunk_id", retrieval.RERANKED).drop("rank")
    found = retrieval.rerank(best, items, chunks, "item_id", "chunk_id", "chunk")
    return found.select("item_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.round("final", 6).alias("final"))


@query(f"""WITH {HYBRID} SELECT item_id, chunk_id, 'local' AS strategy, round(final, 6) AS final FROM hybrid
UNION ALL SELECT item_id, chunk_id, 'none', round(score, 6) FROM hybrid""")
def reranker_choice(spark: SparkSession, d: str) -> DataFrame:
    """Both strategies over the same candidates."""
    items, chunks = _sides(spark, d)
    best = retrieval.top_k(retrieval.fused(items, chunks, "item_id", "chunk_id", "chunk"), "item_id", "score", "chunk_id", retrieval.RERANKED).drop("rank")
    both = [
        retrieval.rerank(best, items, chunks, "item_id", "chunk_id", "chunk", x).select("item_id", "chunk_id", F.lit(x).alias("strategy"), F.round("final", 6).alias("final"))
        for x in ("local", "none")
    ]
    return both[0].unionByName(both[1])


@query(f"""WITH {HYBRID}, s AS (SELECT item_id, max(final) AS best, avg(final) AS mean, var_pop(final) AS var, count(*) AS n,
  sum(n_words) AS words FROM final_ JOIN chunks USING (chunk_id) GROUP BY item_id)
SELECT item_id, CASE WHEN n IS NULL THEN 'none' WHEN best < 0.08 THEN 'low' WHEN n = 1 THEN 'medium' WHEN best >= 0.25 THEN 'high' ELSE 'medium' END AS level,
  coalesce(best >= 0.08, false) AS sufficient, CASE WHEN n IS NULL THEN 0 ELSE round(least(mean * (1 + 0.2 * ln(n + 1)), 1), 6) END AS quality,
  CASE WHEN n IS NULL THEN 0 ELSE round(least(mean * (1 + 0.15 * ln(words + 1)), 1), 6) END AS completeness,
  CASE WHEN n IS NULL THEN 0 ELSE round(greatest(least(best * 0.5 + mean * 0.3 - least(var * 2, 0.2) + least(n * 0.05, 0.15), 1), 0), 6) END AS confidence
FROM (SELECT item_id FROM benchmark UNION ALL SELECT -1) LEFT JOIN s USING (item_id)""")
def retrieval_validation(spark: SparkSession, d: str) -> DataFrame:
    """With a question without any term, which has no results."""
    items, chunks = _sides(spark, d)
    items = items.unionByName(spark.createDataFrame([(-1, "???")], items.schema))
    n = chunks.select("chunk_id", "n_words")
    return retrieval.validated(items, retrieval.validation(retrieval.hybrid_search(items, chunks).join(n, "chunk_id"), "item_id"), "item_id")


def _contexts(items: DataFrame, chunks: DataFrame) -> DataFrame:
    found = retrieval.hybrid_search(items, chunks).join(chunks.select("chunk_id", "chunk", "source", "lang"), "chunk_id")
    return found.withColumnsRenamed({"source": "name", "lang": "section"})


@query(f"WITH {HYBRID} SELECT item_id, rank AS number, source AS document_name, lang AS section, chunk_id FROM final_ JOIN chunks USING (chunk_id)")
def citations(spark: SparkSession, d: str) -> DataFrame:
    found = _contexts(*_sides(spark, d))
    return found.select("item_id", F.col("rank").alias("number"), F.col("name").alias("document_name"), "section", "chunk_id")


_MEMORY = """memory AS (SELECT conv_id AS item_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS memory FROM (
SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8) GROUP BY conv_id)"""


@query(f"""WITH {HYBRID}, {_MEMORY} SELECT q.item_id, coalesce('Session memory:' || chr(10) || any_value(memory) || chr(10) || chr(10), '') || 'Retrieved context:' || chr(10)
  || coalesce(string_agg('[' || rank || '] ' || source || ' / ' || lang || chr(10) || d.chunk, chr(10) || chr(10) ORDER BY rank), 'No retrieved context.')
  || chr(10) || chr(10) || 'User question: ' || any_value(q.text) AS prompt
FROM benchmark q LEFT JOIN final_ USING (item_id) LEFT JOIN chunks d USING (chunk_id) LEFT JOIN memory ON memory.item_id = q.item_id GROUP BY q.item_id""")
def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The session of a question is the conversation of the same number."""
    items, chunks = _sides(spark, d)
    memory = A.memory(table(spark, d, "conversations"), 8).withColumnRenamed("conv_id", "item_id")
    return retrieval.prompts(_contexts(items, chunks), items, memory=memory)


@query(f"""WITH {HYBRID}, a AS (SELECT item_id, array_to_string(string_split(chunk, ' ')[1:40], ' ') || ' [1]' AS a FROM final_ JOIN chunks USING (chunk_id) WHERE rank = 1)
SELECT item_id, 0 AS turn, 'user' AS role, text AS content FROM benchmark
UNION ALL SELECT item_id, 1, 'assistant', coalesce(a, 'No retrieved context.') FROM benchmark LEFT JOIN a USING (item_id)""")
def ask(spark: SparkSession, d: str) -> DataFrame:
    """The turns that questions add to their sessions; the answer is extracted, as no language model is called."""
    items, chunks = _sides(spark, d)
    return retrieval.turns(items, retrieval.extracted(_contexts(items, chunks), items, "item_id"), "item_id")


EMB = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


@query(f"""WITH e AS ({EMB}) SELECT qid, vec_id, round(score, 6) AS score, rank FROM (
SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(q.v, e.v) AS score,
  cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS int) AS rank
FROM e q, e WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def cosine_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set (ids divisible by 100) against all vectors; a top-k list for each query."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return retrieval.nearest(q, e, "qid", "vec_id", "embedding", 10).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH e AS ({EMB}) SELECT qid, vec_id, round(score, 6) AS score, rank FROM (
SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(q.v, e.v) AS score,
  cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS int) AS rank
FROM e q, e WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def cosine_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same query set through the stored index of cells, exactly."""
    e = table(spark, d, "embeddings")
    index = ivf.VectorIndex(spark, scratch(spark, "vectors"), 64)
    index.build(e, "vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return index.search(q, "qid", "embedding", 10, exact=True).select("qid", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH e AS ({EMB}) SELECT qid, vec_id, round(score, 6) AS score, rank FROM (
SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(q.v, e.v) AS score,
  cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS int) AS rank
FROM e q, e WHERE q.vec_id % 100 = 0 AND e.label IN (1, 2, 3) AND round(list_cosine_similarity(q.v, e.v), 9) >= 0.1) WHERE rank <= 10""")
def cosine_filtered_indexed(spark: SparkSession, d: str) -> DataFrame:
    """With a threshold of the score and a filter on the payload."""
    e = table(spark, d, "embeddings")
    index = ivf.VectorIndex(spark, scratch(spark, "vectors"), 64, also="label int")
    index.build(e, "vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found = index.search(q, "qid", "embedding", 10, exact=True, threshold=0.1, where=F.col("label").isin(1, 2, 3))
    return found.select("qid", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH e AS ({EMB}) SELECT vec_id, round(s, 6) AS score FROM (
SELECT vec_id, list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 0)) AS s FROM e) WHERE s >= 0.05 ORDER BY round(s, 9) DESC, vec_id LIMIT 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """With a threshold of the score."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    met = e.join(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 9).alias("s"))  # one row
    return met.where("s >= 0.05").orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


@query("""SELECT label, cast(i AS int) AS i, round(avg(x), 6) AS value FROM (
SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL""")
def mean_pool_by_label(spark: SparkSession, d: str) -> DataFrame:
    return chunking.mean_vector(table(spark, d, "embeddings"), "label", "embedding").select("label", "i", F.round("value", 6).alias("value"))


@query(f"""WITH e AS ({EMB}), n AS (SELECT *, lag(v) OVER w AS p FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, label, cast(sum(CASE WHEN p IS NULL OR round(list_cosine_similarity(p, v), 9) >= 0.1 THEN 0 ELSE 1 END)
  OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS bigint) AS island FROM n""")
def semantic_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return chunking.semantic_islands(e, "label", "vec_id", "embedding", 0.1).select("vec_id", "label", "island")


@query(f"SELECT {BIG} AS n, round(greatest(avg(len({TOKENS.format('text')})), 1), 6) AS avg_len FROM documents")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(X.tokens(F.col("text")))
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.round(F.greatest(F.avg(n), F.lit(1.0)), 6).alias("avg_len"))


TRIGGERS = (
    "Ignore all previous instructions", "disregard above instructions", "system: you are now", "forget everything", "new rules",
    "act as if", "pretend to be", "role-play as", "you will now respond", "\n\nsystem:",
)
_PLANT = "CASE doc_id % 11 " + " ".join(f"WHEN {i + 1} THEN '{t}'" for i, t in enumerate(TRIGGERS)) + " ELSE '' END"


def _sql_injections(text: str) -> str:
    found = ", ".join(f"regexp_extract({text}, '(?i){p}', 0)" for p in X.INJECTIONS)
    return f"list_filter([{found}], lambda x: x <> '')"


@query(f"""SELECT doc_id, array_to_string(f, '|') AS found, len(f)::INT AS n FROM (
SELECT doc_id, {_sql_injections(f"text || ' ' || {_PLANT}")} AS f FROM documents) WHERE len(f) > 0""")
def injection_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every eleventh id but one has a planted trigger, so each pattern has hits."""
    plant = F.expr(_PLANT.replace("\n", "\\n"))
    found = X.injections(F.concat(F.col("text"), F.lit(" "), plant))
    rows = table(spark, d, "documents").select("doc_id", found.alias("f"))
    return rows.where(F.size("f") > 0).select("doc_id", F.concat_ws("|", "f").alias("found"), F.size("f").alias("n"))


_ENTITY = "text || CASE doc_id % 5 WHEN 0 THEN ' see https://example.com/a?b=1 or www.example.org/x' WHEN 1 THEN ' www.test.net +1-800-555-0100' ELSE '' END"


@query(f"""SELECT doc_id, array_to_string(full_ || list_filter(bare, lambda b: NOT list_bool_or([false] || list_transform(full_, lambda f: contains(f, b)))), ' ') AS urls,
  array_to_string(emails, ' ') AS emails, array_to_string(list_filter(phones, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7), '|') AS phones
FROM (SELECT doc_id, regexp_extract_all(t, '{X.URL}') AS full_, regexp_extract_all(t, '{X.BARE_URL}', 1) AS bare,
  regexp_extract_all(t, '{X.EMAIL}') AS emails, regexp_extract_all(t, '{X.PHONE}') AS phones FROM (SELECT doc_id, {_ENTITY} AS t FROM documents))""")
def entities(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.expr(_ENTITY).alias("t"))
    return t.select(
        "doc_id",
        F.array_join(X.urls(F.col("t")), " ").alias("urls"),
        F.array_join(X.emails(F.col("t")), " ").alias("emails"),
        F.array_join(X.phones(F.col("t")), "|").alias("phones"),
    )


_SCRIPT = "text || CASE doc_id % 7 WHEN 0 THEN repeat('سلام دنیا', 400) WHEN 1 THEN repeat('漢字仮名', 90) WHEN 2 THEN 'ひらがな' WHEN 3 THEN repeat('हिन्दी text', 60) ELSE '' END"


def _sql_share(p: str) -> str:
    return f"len(regexp_extract_all(t, '{p}')) / greatest(length(t), 1)::DOUBLE"


@query(f"""WITH s AS (SELECT doc_id, unnest([{", ".join(f"{{'share': {_sql_share(p)}, 'pri': {-i}, 'name': '{k}'}}" for i, (k, p) in enumerate(X.SCRIPTS.items()))}]) AS s
  FROM (SELECT doc_id, {_SCRIPT} AS t FROM documents))
SELECT doc_id, coalesce(max(s).name, 'english') AS language, round(coalesce(max(s).share, 1.0), 6) AS confidence, coalesce(mixed, false) AS mixed FROM (
  SELECT doc_id, max(CASE WHEN s.share > 0 THEN s END) AS s, count(*) FILTER (s.share > 0.2) > 1 AS mixed FROM s GROUP BY doc_id) GROUP BY doc_id, mixed""")
def script_language(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", X.script_language(F.expr(_SCRIPT)).alias("s"))
    return found.select("doc_id", "s.language", F.round("s.confidence", 6).alias("confidence"), "s.mixed")


_CLASSED = "text || CASE doc_id % 4 WHEN 0 THEN ' Invoice: amount due, subtotal and tax' WHEN 1 THEN ' patient diagnosis by the doctor' WHEN 2 THEN '' ELSE ' abstract and introduction' END"


def _sql_class() -> str:
    each = []
    for i, (name, keys) in enumerate(X.CLASSES.items()):
        hits = " + ".join(f"contains(t, '{k}')::INT" for k in keys)
        each.append(f"{{'score': round(({hits}) / {len(keys)}::DOUBLE, 4), 'pri': {-i}, 'name': '{name}'}}")
    return f"list_max([{', '.join(each)}])"


@query(f"""SELECT doc_id, CASE WHEN b.score = 0 THEN 'general' ELSE b.name END AS class, b.score AS score
FROM (SELECT doc_id, {_sql_class()} AS b FROM (SELECT doc_id, lower({_CLASSED}) AS t FROM documents))""")
def classify_doc(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", X.document_class(F.expr(_CLASSED)).alias("c"))
    return found.select("doc_id", F.col("c.name").alias("class"), "c.score")


@query(f"""SELECT doc_id, len({WORDS.format("text")})::INT AS n_words, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''))::INT AS n_lines,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(10)) <> ''))::INT AS n_paragraphs FROM documents""")
def text_shape(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    paragraphs = F.filter(F.split(t, "\n\n"), lambda x: F.trim(F.translate(x, "\n", " ")) != "")
    return table(spark, d, "documents").select("doc_id", F.size(X.words(t)).alias("n_words"), F.size(lines).alias("n_lines"), F.size(paragraphs).alias("n_paragraphs"))


_GATED = "CASE doc_id % 5 WHEN 0 THEN repeat(chr(65533), 20) || text WHEN 1 THEN '   ' ELSE text END"


@query(f"""SELECT doc_id, trim(t) <> '' AND NOT (length(t) > 100 AND (length(t) - length(replace(t, chr(65533), ''))) / length(t)::DOUBLE > 0.03) AS clean
FROM (SELECT doc_id, {_GATED} AS t FROM documents)""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    plant = F.expr("CASE doc_id % 5 WHEN 0 THEN repeat('�', 20) || text WHEN 1 THEN '   ' ELSE text END")
    return table(spark, d, "documents").select("doc_id", X.is_clean(plant).alias("clean"))


@query("""SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS first_id,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate FROM documents""")
def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    found = docs.join(first, "content_hash")
    return found.select("doc_id", "content_hash", "first_id", (F.col("doc_id") != F.col("first_id")).alias("duplicate"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+', ' ', 'g')) AS text FROM documents")
def whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("text"))


@query(f"""WITH e AS ({EMB}), n AS (SELECT *, lag(v) OVER w AS p FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)), i AS (
SELECT vec_id, label, v, sum(CASE WHEN p IS NULL OR round(list_cosine_similarity(p, v), 9) >= 0.1 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM n)
SELECT label, island, count(*)::BIGINT AS n, max(vec_id) AS last, string_agg('t' || vec_id, ' ' ORDER BY vec_id) AS text, round(avg(v[1]), 6) AS x, round(avg(v[64]), 6) AS y FROM i GROUP BY label, island""")
def semantic_merge(spark: SparkSession, d: str) -> DataFrame:
    """Alike neighbours as one chunk: text, mean vector, the last one's number."""
    e = table(spark, d, "embeddings").withColumn("t", F.concat(F.lit("t"), F.col("vec_id")))
    found = chunking.merged_islands(e, "label", "vec_id", "t", "embedding", 0.1)
    return found.select("label", "island", "n", "last", "text", F.round(F.col("vector")[0], 6).alias("x"), F.round(F.col("vector")[63], 6).alias("y"))


@query(r"""SELECT doc_id, 0 AS n, 'General' AS section, 'intro' AS body FROM documents UNION ALL SELECT doc_id, 1, 'Part ' || doc_id, trim(regexp_replace(replace(text, chr(13), ' '), '\s+', ' ', 'g')) FROM documents
UNION ALL SELECT doc_id, 2, 'End', 'x' FROM documents""")
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by headings, planted around each text; here with white space collapsed."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("intro\n  # Part "), F.col("doc_id"), F.lit(" \n"), "text", F.lit("\n###### End\nx")).alias("text"))
    found = O.apply(docs, "doc_id", "text", "n int, section string, body string", lambda t: [(i, a, " ".join(b.split())) for i, (a, b) in enumerate(chunking.sections(t))])
    return found


@query(f"""SELECT doc_id, count(*)::BIGINT AS words FROM (SELECT doc_id, unnest({WORDS.format("text")}) AS w FROM documents) GROUP BY doc_id""")
def chunk_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Words of all packed windows without those that are carried over: each word of a text once."""
    found = chunking.hierarchical(table(spark, d, "documents"), overlap=0)
    return found.groupBy("doc_id").agg(F.sum(F.size(X.words(F.col("chunk")))).alias("words"))


@query("""SELECT doc_id, 'doc-' || doc_id AS document_name, 'md' AS document_type, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS ocr_applied, lang FROM documents""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """A document's metadata: the reader's, with the caller's over it where both have a key."""
    base = F.create_map(F.lit("document_name"), F.concat(F.lit("doc-"), F.col("doc_id")), F.lit("document_type"), F.lit("txt"), F.lit("ocr_applied"), F.lit("no"))
    given = F.create_map(F.lit("document_type"), F.lit("md"), F.lit("lang"), F.col("lang"))
    given = F.when(F.col("doc_id") % 2 == 0, F.map_concat(given, F.create_map(F.lit("ocr_applied"), F.lit("yes")))).otherwise(given)
    m = files.merged(base, given)
    rows = table(spark, d, "documents").select("doc_id", m.alias("m"))
    return rows.select("doc_id", *(F.col("m")[k].alias(k) for k in ("document_name", "document_type", "ocr_applied", "lang")))


@query(r"""SELECT doc_id, 'ab ' || doc_id || ' ' || text || ' x' AS cleaned FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g')) AS text FROM documents)
WHERE NOT regexp_matches(text, '[<>]') AND nfc_normalize(text) = text AND regexp_matches(text, '^[\x00-\x7f]*$')""")
def llm_text_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Texts with planted full-width letters and tags, in compatibility form, without tags; those in ASCII, as SQL has no such form."""
    docs = table(spark, d, "documents").where(~F.col("text").rlike("[<>]") & F.col("text").rlike(r"^[\x00-\x7f\u00a0\u2000-\u200a\u3000]*$"))
    docs = docs.select("doc_id", F.concat(F.lit("ａｂ <b>"), F.col("doc_id"), F.lit("</b>　"), "text", F.lit(" x<br/>")).alias("text"))
    found = O.apply(docs, "doc_id", "text", "t string", lambda t: [(unicodedata.normalize("NFKC", t),)])
    return found.select("doc_id", X.untagged(F.col("t")).alias("cleaned"))


@query(f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(t, '{X.PHONE}'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7), '|') AS phones FROM (SELECT doc_id, text || ' +1-800-555-0100 or 555-12' AS t FROM documents)""")
def phone_filter(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.lit(" +1-800-555-0100 or 555-12"))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.phones(t), "|").alias("phones"))


@query(f"""SELECT doc_id, array_to_string(full_ || list_filter(bare, lambda b: NOT list_bool_or([false] || list_transform(full_, lambda f: contains(f, b)))), ' ') AS urls
FROM (SELECT doc_id, regexp_extract_all(t, '{X.URL}') AS full_, regexp_extract_all(t, '{X.BARE_URL}', 1) AS bare
  FROM (SELECT doc_id, text || ' https://www.a.example/x?d=' || doc_id || ' www.a.example www.b.example' AS t FROM documents))""")
def url_union(spark: SparkSession, d: str) -> DataFrame:
    """Full addresses, and bare ones that are no part of a full one; some are added to each text."""
    t = F.concat("text", F.lit(" https://www.a.example/x?d="), F.col("doc_id"), F.lit(" www.a.example www.b.example"))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.urls(t), " ").alias("urls"))


@query("SELECT doc_id, sha256(replace(text, chr(0), '') || '�x') AS h FROM documents WHERE doc_id IS NOT NULL AND NOT contains(text, chr(0))")
def load_text_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes as text: what isn't UTF-8, of which a byte is planted, becomes a replacement character."""
    docs = table(spark, d, "documents").where(~F.contains("text", F.lit("\0")))
    raw = docs.select("doc_id", F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF78"))).alias("raw"))
    found = files.read_bytes(raw, "doc_id", "raw", files.plain)
    return found.select("doc_id", F.sha2("text", 256).alias("h"))


@query("SELECT n_nationkey, n_nationkey || chr(9) || n_name || chr(9) || 'a, \"b' || chr(10) || 'x' || chr(9) AS text FROM nation")
def load_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a CSV file as lines, cells trimmed, empty rows left out."""
    line = F.concat(F.col("n_nationkey"), F.lit(" , "), F.col("n_name"), F.lit(',"a, ""b"\n\n , \nx,\n'))
    raw = table(spark, d, "nation").select("n_nationkey", F.encode(line, "UTF-8").alias("raw"))
    return files.read_bytes(raw, "n_nationkey", "raw", files.table_text)
