"""Queries that write keyed tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.functions import text as X
from heronlake.operators import merge, profile
from heronlake.plans.registry import query
from heronlake.sources.scratch import files, scratch
from heronlake.sources.store import Layout, Store
from heronlake.sources.tables import table
from heronlake.streaming import flows

#: Bytes of a table for each bucket, and the fewest buckets.
BUCKET_BYTES, BUCKETS = 256 << 20, 2


def _buckets(spark: SparkSession, folder: str, name: str) -> int:
    fs, target = files(spark, f"{folder}/{name}.parquet")
    return max(BUCKETS, fs.getContentSummary(target).getLength() // BUCKET_BYTES)


def layouts(n: int) -> dict[str, Layout]:
    """The tables of a knowledge store. Chunks lie in the bucket of their document."""
    return {
        "documents": Layout("doc_id bigint, tenant string, kb string, text string, n_chars bigint, state string, meta map<string,string>", ("doc_id",), ("tenant",), buckets=n),
        "chunks": Layout("chunk_id string, doc_id bigint, tenant string, kb string, ordinal int, chunk string, metadata_json string", ("chunk_id",), ("tenant",), ("doc_id",), n),
        "log": Layout("event_id bigint, level string, latency_ms double, details string", ("event_id",), ("level",), buckets=n),
        "points": Layout("point_id string, vec_id bigint, label int, vector array<float>, payload string", ("point_id",), ("label",), buckets=n),
    }


def _chunks(docs: DataFrame) -> DataFrame:
    """A chunk for each line of a document."""
    lines = docs.select("doc_id", "tenant", "kb", F.posexplode(F.split("text", "\n")).alias("ordinal", "chunk"))
    meta = F.to_json(F.struct(F.col("tenant").alias("tenant_id"), F.col("kb").alias("knowledge_base_id"), "ordinal"))
    return lines.select(F.sha1(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), "chunk")).alias("chunk_id"), "*", meta.alias("metadata_json"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    meta = F.map_from_arrays(F.array(F.lit("knowledge_base_id"), F.lit("source")), F.array("lang", "source"))
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant"), F.col("lang").alias("kb"), "text", "n_chars", F.lit("old").alias("state"), meta.alias("meta"))


def knowledge(spark: SparkSession, d: str, chunks: bool = True) -> Store:
    """A store with the documents of a folder and, if wanted, their chunks."""
    store = Store(spark, scratch(spark, "store"), layouts(_buckets(spark, d, "documents")))
    with store.change() as c:
        docs = _documents(spark, d)
        c.append("documents", docs)
        if chunks:
            c.append("chunks", _chunks(docs))
    return store


@query("""SELECT doc_id, 'old' AS state, len(string_split(text, chr(10)))::INT AS chunks, lang AS kb, source AS tenant FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'new', 2, 'upload', 'api' FROM labels""")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents written again, in another tenant, lose their old chunks in the same change."""
    store = knowledge(spark, d)
    words = F.array(F.lit("quality"), F.lit("toxic"))
    new = table(spark, d, "labels").select(
        "doc_id", F.lit("api").alias("tenant"), F.lit("upload").alias("kb"), F.concat_ws("\n", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("text"),
        F.lit(3).cast("bigint").alias("n_chars"), F.lit("new").alias("state"), F.map_from_arrays(words, F.array(F.col("quality").cast("string"), F.col("toxic").cast("string"))).alias("meta"),
    )
    with store.change() as c:
        c.delete("chunks", new, on=["doc_id"])
        c.upsert("documents", new)
        c.append("chunks", _chunks(new))
    now = store.snapshot()
    n = now.read("chunks").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunks"))
    return now.read("documents").join(n, "doc_id").select("doc_id", "state", "chunks", "kb", "tenant")


@query("""WITH c AS (SELECT doc_id, unnest(range(0, len(x)))::INT AS ordinal, unnest(x) AS chunk FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, ordinal, CASE WHEN ordinal = 0 AND doc_id IN (SELECT doc_id FROM labels) THEN chunk || '!' ELSE chunk END AS chunk, ordinal = 0 AND doc_id IN (SELECT doc_id FROM labels) AS again FROM c""")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks replaced by their id: the first of each labelled document, with a mark."""
    store = knowledge(spark, d)
    first = store.read("chunks", keys=table(spark, d, "labels").select("doc_id")).where("ordinal = 0")
    with store.change() as c:
        c.upsert("chunks", first.withColumns({"chunk": F.concat("chunk", F.lit("!")), "metadata_json": F.lit('{"again":true}')}))
    again = F.coalesce(F.get_json_object("metadata_json", "$.again") == "true", F.lit(False))
    return store.read("chunks").select("doc_id", "ordinal", "chunk", again.alias("again"))


@query("""SELECT doc_id, arg_max(n_chars, v) AS n_chars, max(v)::INT AS version FROM (
SELECT doc_id, n_chars, 1 AS v FROM documents UNION ALL SELECT doc_id, quality, 2 FROM labels) GROUP BY doc_id""")
def upsert_lww(spark: SparkSession, d: str) -> DataFrame:
    """Of the writes of a key within a batch and before it, the last counts."""
    old = table(spark, d, "documents").select("doc_id", "n_chars", F.lit(1).alias("version"))
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("n_chars"), F.lit(2).alias("version"))
    store = Store(spark, scratch(spark, "store"), {"rows": Layout("doc_id bigint, n_chars bigint, version int", ("doc_id",), buckets=_buckets(spark, d, "documents"))})
    for batch in (old.unionByName(old.withColumns({"version": F.lit(0), "n_chars": F.lit(-1).cast("bigint")})), new):
        with store.change() as c:
            c.upsert("rows", batch, order=["version"])
    return store.read("rows")


@query("""SELECT d.doc_id, count(*)::BIGINT AS chunks FROM documents d, unnest(string_split(text, chr(10))) WHERE source <> 'src5' GROUP BY d.doc_id""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that stay when a tenant's documents are deleted, document by document."""
    store = knowledge(spark, d)
    gone = store.read("documents", {"tenant": "src5"}).select("doc_id")
    with store.change() as c:
        c.delete("chunks", gone, on=["doc_id"])
        c.delete("documents", gone)
    return store.read("chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (3, 5, 8, 13)")
def delete_by_ids(spark: SparkSession, d: str) -> DataFrame:
    store = knowledge(spark, d, chunks=False)
    with store.change() as c:
        c.delete("documents", spark.createDataFrame([(3,), (5,), (8,), (13,)], "doc_id bigint"))
    return store.read("documents").select("doc_id")


def _points(spark: SparkSession, d: str) -> DataFrame:
    chunk = F.concat(F.lit("c"), F.col("vec_id"))
    return table(spark, d, "embeddings").select(
        merge.uuid5(chunk).alias("point_id"), "vec_id", "label", F.col("embedding").alias("vector"), F.to_json(F.struct(chunk.alias("chunk_id"), "label")).alias("payload")
    )


@query("SELECT vec_id FROM embeddings WHERE label IS DISTINCT FROM 3")
def vector_delete(spark: SparkSession, d: str) -> DataFrame:
    """A partition goes by the manifest alone."""
    store = Store(spark, scratch(spark, "store"), layouts(_buckets(spark, d, "embeddings")))
    with store.change() as c:
        c.append("points", _points(spark, d))
    with store.change() as c:
        c.clear("points", label=3)
    return store.read("points").select("vec_id")


@query("""SELECT e.vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id,
  CASE WHEN again THEN '{"chunk_id":"c' || e.vec_id || '","doc":' || e.vec_id || '}' ELSE '{"chunk_id":"c' || e.vec_id || '","label":' || label || '}' END AS payload,
  round(list_sum(embedding::DOUBLE[]) * CASE WHEN again THEN 2 ELSE 1 END, 5) AS total
FROM (SELECT *, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode('c' || vec_id)) AS h, vec_id IN (SELECT doc_id FROM labels) AS again FROM embeddings) e""")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Points of a vector store, with an id from the chunk's and a payload; those whose chunk is labelled come again, doubled."""
    store = Store(spark, scratch(spark, "store"), layouts(_buckets(spark, d, "embeddings")))
    points = _points(spark, d)
    with store.change() as c:
        c.upsert("points", points)
    again = points.join(table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    payload = F.to_json(F.struct(F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"), F.col("vec_id").alias("doc")))
    with store.change() as c:
        c.upsert("points", again.withColumns({"vector": F.transform("vector", lambda x: x * 2), "payload": payload}))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return store.read("points").select("vec_id", "point_id", "payload", F.round(total, 5).alias("total"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42")
def doc_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Reads the files of one bucket."""
    return knowledge(spark, d, chunks=False).read("documents", {"doc_id": 42}).select("doc_id", F.col("kb").alias("lang"), "n_chars")


@query("""SELECT doc_id, ordinal, sha1(concat_ws(':', doc_id::VARCHAR, ordinal::VARCHAR, chunk)) AS chunk_id, chunk, 'src2' AS tenant_id, 'en' AS knowledge_base_id
FROM (SELECT doc_id, unnest(range(0, len(x)))::INT AS ordinal, unnest(x) AS chunk FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE source = 'src2' AND lang = 'en'))""")
def chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a tenant's knowledge base, in order, with their metadata decoded; only the tenant's files are read."""
    rows = knowledge(spark, d).read("chunks", {"tenant": "src2", "kb": "en"})
    meta = F.from_json("metadata_json", "tenant_id string, knowledge_base_id string")
    return rows.select("doc_id", "ordinal", "chunk_id", "chunk", meta.alias("m")).select("doc_id", "ordinal", "chunk_id", "chunk", "m.*").orderBy("doc_id", "ordinal")


@query("SELECT source AS tenant, count(*)::BIGINT AS n FROM documents GROUP BY source")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each tenant, from the manifest alone."""
    return knowledge(spark, d, chunks=False).snapshot().counts("documents")


@query("""SELECT event_id, event_type AS level, value AS latency_ms, props AS details FROM events UNION ALL
SELECT (SELECT max(event_id) FROM events) + 1 + doc_id, CASE WHEN toxic = 1 THEN 'ERROR' ELSE 'INFO' END, round(quality * 1.23456, 2), '{"doc":' || doc_id || '}' FROM labels""")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """The stored log after new rows: their level in capitals, the latency to hundredths, details as JSON."""
    old = table(spark, d, "events").select("event_id", F.col("event_type").alias("level"), F.col("value").alias("latency_ms"), F.col("props").alias("details"))
    store = Store(spark, scratch(spark, "store"), layouts(_buckets(spark, d, "events")))
    with store.change() as c:
        c.append("log", old)
    last = store.read("log").agg(F.max("event_id")).first()[0]
    level = F.upper(F.when(F.col("toxic") == 1, "error").otherwise("info"))
    new = table(spark, d, "labels").select((F.lit(last + 1) + F.col("doc_id")).alias("event_id"), level.alias("level"), F.round(F.col("quality") * 1.23456, 2).alias("latency_ms"), F.to_json(F.struct(F.col("doc_id").alias("doc"))).alias("details"))
    with store.change() as c:
        c.append("log", new)
    return store.read("log")


_BLANK = r"regexp_matches(text, '^\s*$')"


@query(rf"""WITH b AS (SELECT doc_id, source, text, CASE WHEN {_BLANK} THEN 'no text' WHEN length(text) < 20 THEN 'text too short' END AS error FROM documents)
SELECT replace(source || '/' || doc_id, '/', '_') || '.txt' AS file, coalesce('ERROR: ' || error, text) AS content, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN error IS NULL THEN len(list_filter(regexp_split_to_array(text, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+'), lambda x: x <> '')) ELSE 0 END::BIGINT AS words,
  CASE WHEN error IS NULL THEN length(text) ELSE 0 END::BIGINT AS chars, count(*) FILTER (error IS NULL) OVER ()::BIGINT AS ok, count(*) FILTER (error IS NOT NULL) OVER ()::BIGINT AS failed FROM b""")
def batch_export(spark: SparkSession, d: str) -> DataFrame:
    """What a batch leaves, written and read back: texts (or errors) by file name, results as JSON, and a CSV summary of words
    and characters. A document without a text, or with less than twenty characters of it, is an error."""
    out = scratch(spark, "batch")
    text = F.col("text")
    error = F.when(text.rlike(r"^\s*$"), "no text").when(F.length(text) < 20, "text too short")
    rows = table(spark, d, "documents").select(F.concat(F.regexp_replace(F.concat_ws("/", "source", "doc_id"), r"[/\\]", "_"), F.lit(".txt")).alias("file"), text, error.alias("error"))
    good = F.col("error").isNull()
    rows = rows.withColumns({"content": F.coalesce(F.concat(F.lit("ERROR: "), "error"), "text"), "status": F.when(good, "ok").otherwise("error"), "words": F.when(good, F.size(X.words(text))).otherwise(0).cast("bigint"), "chars": F.when(good, F.length(text)).otherwise(0).cast("bigint")})
    rows.select("file", "content").write.parquet(f"{out}/texts")
    rows.select("file", "status", "error").write.json(f"{out}/results")
    rows.select("file", "words", "chars").write.option("header", True).csv(f"{out}/summary")
    results = spark.read.schema("file string, status string, error string").json(f"{out}/results")
    counts = results.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("failed")).first()
    summary = spark.read.schema("file string, words bigint, chars bigint").option("header", True).csv(f"{out}/summary")
    met = spark.read.parquet(f"{out}/texts").join(results.select("file", "status"), "file").join(summary, "file")
    return met.withColumns({"ok": F.lit(counts.ok), "failed": F.lit(counts.failed)})


@query(r"""SELECT count(*)::BIGINT AS came, count(*) FILTER (regexp_matches(text, '[^\s]'))::BIGINT AS with_text, sum(n_chars)::BIGINT AS chars, 100.0::DOUBLE AS progress FROM documents""")
def ingest_observed(spark: SparkSession, d: str) -> DataFrame:
    """A stream of documents into a table, whose counts and progress a listener hears batch by batch."""
    rows, path = flows.source(spark, d, "documents").select("doc_id", "text", "n_chars"), scratch(spark, "observed")
    total = table(spark, d, "documents").count()
    start = lambda s: s.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    heard = profile.ingested(rows, total, start, with_text=F.count_if(F.col("text").rlike(r"\S")), chars=F.sum("n_chars"))
    told = heard.table(spark)
    count = lambda c: F.sum(F.col("counts")[c]).cast("bigint").alias(c)
    return told.agg(count("came"), count("with_text"), count("chars"), F.max("progress").alias("progress"))
