"""Queries over sessions, logs, stored documents and the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions import text as X
from heronlake.operators import activity as A
from heronlake.operators import merge
from heronlake.plans.registry import query
from heronlake.sources.tables import table
from heronlake.streaming import flows, state


@query("SELECT conv_id, count(*)::BIGINT AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def session_last_n(spark: SparkSession, d: str) -> DataFrame:
    return A.last_turns(table(spark, d, "conversations"), 4).select("conv_id", "turn", "role")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS memory FROM (
SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8) GROUP BY conv_id""")
def session_memory(spark: SparkSession, d: str) -> DataFrame:
    return A.memory(table(spark, d, "conversations"), 8)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7 ORDER BY turn")
def session_transcript(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("conv_id = 7").orderBy("turn")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def session_retention(spark: SparkSession, d: str) -> DataFrame:
    """What a retention of ten days keeps, as of a fixed moment."""
    return table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-31' - INTERVAL 10 DAYS").select("event_id")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id <> 7")
def delete_session(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return merge.delete(t, t.where("conv_id = 7"), ["conv_id"]).select("conv_id", "turn")


@query("""SELECT user_id, string_agg(event_type || ': ' || value, chr(10) ORDER BY event_type) AS memory FROM (
SELECT user_id, event_type, arg_max(event_id, event_id) AS value FROM events GROUP BY ALL) GROUP BY user_id""")
def user_memory(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each key of a user, as lines by key; a user has as many lines as there are event types."""
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("value"), F.col("event_id").alias("o"))
    last = merge.last_write(rows, ["user_id", "event_type"], ["o"])
    lines = F.array_sort(F.collect_list(F.concat_ws(": ", "event_type", F.col("value").cast("string"))))
    return last.groupBy("user_id").agg(F.array_join(lines, "\n").alias("memory"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ingest_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Files that were not ingested yet."""
    return merge.delete(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src3')")
def cleanup_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Ingested documents whose file is gone."""
    files = table(spark, d, "documents").where("source <> 'src3'")
    return merge.delete(table(spark, d, "labels"), files, ["doc_id"]).select("doc_id")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def vector_scroll(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(100)


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS ingested, coalesce(l.quality, -1) AS quality, c.n AS chunks FROM documents d
LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT doc_id, len(string_split(text, chr(10)))::INT AS n FROM documents) c USING (doc_id)""")
def doc_inventory_left_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("chunks"))
    known = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("i"))
    return docs.join(known, "doc_id", "left").select(
        "doc_id", F.coalesce("i", F.lit(False)).alias("ingested"), F.coalesce("quality", F.lit(-1)).alias("quality"), "chunks"
    )


@query("""SELECT source, count(*)::BIGINT AS docs, count(*) FILTER (doc_id % 20 <> substr(source, 4)::INT)::BIGINT AS foreign_rows,
round(100.0 * count(*) FILTER (doc_id % 20 = substr(source, 4)::INT) / count(*), 4)::DOUBLE AS score FROM documents GROUP BY source""")
def isolation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each tenant that belong to another by the id's rule."""
    own = F.col("doc_id") % 20 == F.substring("source", 4, 9).cast("int")
    return table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(~own).alias("foreign_rows"), F.round(100.0 * F.count_if(own) / F.count(F.lit(1)), 4).alias("score")
    )


@query("SELECT count(DISTINCT source)::BIGINT AS tenants, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars FROM documents")
def system_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.countDistinct("source").alias("tenants"), F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, user_id FROM events WHERE user_id = 17 AND event_type = 'click' ORDER BY event_id DESC LIMIT 50")
def log_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("user_id = 17 AND event_type = 'click'")
    return rows.select("event_id", "user_id").orderBy(F.desc("event_id")).limit(50)


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def request_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "SELECT event_type, "
    + ", ".join(f"count(*) FILTER (value / 100 <= {b})::BIGINT AS le_{str(b).replace('.', '_')}" for b in A.BUCKETS)
    + ", count(*)::BIGINT AS n, round(sum(value / 100), 4) AS total FROM events GROUP BY event_type"
)
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(table(spark, d, "events").withColumn("v", F.col("value") / 100), "event_type", "v")


@query("""SELECT event_type, count(*)::BIGINT AS n, round(count(*) FILTER (value <= 400) / count(*)::DOUBLE, 6) AS success_rate,
round(coalesce(avg(value) FILTER (value <= 400), 0), 4) AS mean_ms, round(avg(len(string_split(props, ' '))), 4) AS mean_words,
count(DISTINCT user_id)::BIGINT AS clients FROM events GROUP BY event_type""")
def service_metrics(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("value") <= 400
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("value"))), F.lit(0.0)), 4).alias("mean_ms"),
        F.round(F.avg(F.size(F.split("props", " "))), 4).alias("mean_words"),
        F.countDistinct("user_id").alias("clients"),
    )


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS load FROM events""")
def sliding_request_load(spark: SparkSession, d: str) -> DataFrame:
    return A.load(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "load")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), w AS (
  SELECT user_id, event_id, r, true AS admitted, [t] AS held FROM e WHERE r = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.r, len(list_filter(held, lambda x: x > t - 43200000000)) < 2,
    list_filter(held, lambda x: x > t - 43200000000) || CASE WHEN len(list_filter(held, lambda x: x > t - 43200000000)) < 2 THEN [t] ELSE [] END
  FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1) SELECT user_id, event_id, admitted FROM w""")
def rate_limit_admission(spark: SparkSession, d: str) -> DataFrame:
    """Two requests of a client in twelve hours; rejected ones don't count."""
    return A.admitted(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 43_200)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), w AS (
  SELECT user_id, event_id, r, true AS admitted, [t] AS held FROM e WHERE r = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.r, len(list_filter(held, lambda x: x > t - 21600000000)) < 1,
    list_filter(held, lambda x: x > t - 21600000000) || CASE WHEN len(list_filter(held, lambda x: x > t - 21600000000)) < 1 THEN [t] ELSE [] END
  FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1) SELECT user_id, event_id, admitted FROM w""")
def stream_admission(spark: SparkSession, d: str) -> DataFrame:
    """A request of a client in six hours, over a stream whose state carries on from trigger to trigger."""
    live = state.arrivals(table(spark, d, "events"), "ts")
    return state.kept(state.admitted(live, "user_id", "ts", "event_id", 1, 21_600), "admitted")


@query("""SELECT user_id, event_id, least(60, 2 ** n)::DOUBLE AS backoff_s, round(1.1 * least(60, 2 ** n), 6)::DOUBLE AS most_s,
greatest(least(60, 2 ** n), CASE WHEN value > 90 THEN round(value, 2) ELSE 0 END)::DOUBLE AS wait_s FROM (
SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS n FROM (
SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) WHERE event_type <> 'purchase')""")
def stream_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Waits over consecutive failures of a client, in time order, by state that lasts over triggers; large values are what
    the answer asks for."""
    after = F.when(F.col("value") > 90, F.round("value", 2).cast("string")).otherwise("soon")
    rows = table(spark, d, "events").withColumns({"ok": F.col("event_type") == "purchase", "after": after})
    return state.kept(state.backoff(state.arrivals(rows, "ts"), "user_id", "ts", "event_id", "ok", "after"), "backoff")


@query("""SELECT user_id, event_id, least(60, 2 ** n)::DOUBLE AS backoff_s, round(1.1 * least(60, 2 ** n), 6)::DOUBLE AS most_s,
greatest(least(60, 2 ** n), CASE WHEN event_id % 10 = 0 THEN 90 WHEN event_id % 10 = 1 THEN 1 ELSE 0 END)::DOUBLE AS wait_s FROM (
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM (
SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events) WHERE event_type <> 'purchase')""")
def backoff_series(spark: SparkSession, d: str) -> DataFrame:
    """Exponential waits over consecutive failures of a client, with a tenth of jitter at most, and at least what the answer
    asks for; a success starts again."""
    after = F.when(F.col("event_id") % 10 == 0, "90").when(F.col("event_id") % 10 == 1, "1").when(F.col("event_id") % 10 == 2, "soon")
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"), after.alias("after"))
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = rows.withColumn("island", F.sum(F.col("ok").cast("int")).over(w)).where("NOT ok")
    n = F.row_number().over(W.partitionBy("user_id", "island").orderBy("event_id"))
    rows = rows.withColumn("backoff_s", F.least(F.lit(60.0), F.pow(F.lit(2.0), n)))
    asked = F.coalesce(F.col("after").try_cast("double"), F.lit(0.0))
    return rows.select("user_id", "event_id", "backoff_s", F.round(1.1 * F.col("backoff_s"), 6).alias("most_s"), F.greatest("backoff_s", asked).alias("wait_s"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def job_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def job_retention(spark: SparkSession, d: str) -> DataFrame:
    """The newest jobs that a bound on their number keeps."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@query("""SELECT conv_id, turn, len(c)::INT AS cited, len(list_filter(c, lambda i: i BETWEEN 1 AND 3))::INT AS valid,
  CASE WHEN len(c) = 0 OR len(list_filter(c, lambda i: i BETWEEN 1 AND 3)) = 0 THEN 'low'
       WHEN len(list_filter(c, lambda i: i BETWEEN 1 AND 3)) / len(c)::DOUBLE >= 0.8 THEN 'high' ELSE 'medium' END AS level FROM (
SELECT conv_id, turn, list_distinct(regexp_extract_all(text || CASE turn % 3 WHEN 0 THEN ' [1]' WHEN 1 THEN ' [2][9]' ELSE '' END,
  '\\[([0-9]+)\\]', 1)::BIGINT[]) AS c FROM conversations)""")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("text || CASE turn % 3 WHEN 0 THEN ' [1]' WHEN 1 THEN ' [2][9]' ELSE '' END")
    cited, n = X.citations(t), F.lit(3)
    valid = F.size(F.filter(cited, lambda i: (i >= 1) & (i <= 3)))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.size(cited).alias("cited"), valid.alias("valid"), X.citation_level(t, n)["level"].alias("level")
    )


@query("""SELECT event_type, ts_hour, count(*)::BIGINT AS n FROM (
SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts_hour FROM events) GROUP BY ALL""")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the events with a watermark, run until its input is used up."""
    return flows.window_counts(spark, d)


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return flows.content_hashes(spark, d)


@query("SELECT doc_id, length(text)::INT AS n FROM documents")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    return flows.ingest(spark, d)


@query("""SELECT '# TYPE requests_total counter' AS line UNION ALL SELECT 'requests_total{type="' || event_type || '"} ' || count(*) FROM events GROUP BY event_type
UNION ALL SELECT '# TYPE clients gauge' UNION ALL SELECT 'clients{type="' || event_type || '"} ' || count(DISTINCT user_id) FROM events GROUP BY event_type
UNION ALL SELECT '# TYPE latency_bucket histogram' UNION ALL SELECT 'latency_bucket{type="' || event_type || '",le="' || le || '"} ' || count(*) FILTER (value <= le) FROM events, (VALUES (10), (100), (400)) b(le) GROUP BY event_type, le""")
def prometheus_text(spark: SparkSession, d: str) -> DataFrame:
    """Counters, gauges and cumulative buckets as text."""
    e = table(spark, d, "events").withColumnRenamed("event_type", "type")
    counts = e.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("c"), *(F.count_if(F.col("value") <= b).alias(str(b)) for b in (10, 100, 400)))
    buckets = counts.select("type", F.explode(F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(str(b)).alias("n")) for b in (10, 100, 400)))).alias("b")).select("type", "b.le", "b.n")
    out = A.prometheus("requests_total", "counter", counts, ["type"], "n").unionByName(A.prometheus("clients", "gauge", counts, ["type"], "c"))
    return out.unionByName(A.prometheus("latency_bucket", "histogram", buckets, ["type", "le"], "n"))


@query("SELECT event_id, props->>'$.k' AS k, json_valid(props) AS ok FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))


@query("SELECT doc_id, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS json, lang FROM documents")
def metadata_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    js = F.to_json(F.struct("lang", "source"))
    return table(spark, d, "documents").select("doc_id", js.alias("json"), F.from_json(js, "lang string, source string")["lang"].alias("lang"))


@query("SELECT c_custkey FROM customer WHERE sha256('key-' || c_custkey) IN (SELECT sha256('key-' || doc_id) FROM labels)")
def api_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "labels").select(F.sha2(F.concat(F.lit("key-"), "doc_id"), 256).alias("h"))
    return table(spark, d, "customer").withColumn("h", F.sha2(F.concat(F.lit("key-"), "c_custkey"), 256)).join(keys, "h", "left_semi").select("c_custkey")


@query("""SELECT d.doc_id FROM documents d WHERE md5(d.text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))""")
def incremental_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content has no result yet."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    done = docs.join(table(spark, d, "labels"), "doc_id").select("h").distinct()
    return docs.join(done, "h", "left_anti").select("doc_id")


@query("""SELECT source, count(*)::BIGINT AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS chunks,
count(*) FILTER (doc_id IN (SELECT doc_id FROM labels))::BIGINT AS skipped, coalesce(string_agg(doc_id || ': too short', ',' ORDER BY doc_id) FILTER (n_chars < 100), '') AS errors FROM documents GROUP BY source""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    """With the list of errors, which is part of the report."""
    known = table(spark, d, "labels").select("doc_id", F.lit(1).alias("k")).distinct()
    docs = table(spark, d, "documents").join(known, "doc_id", "left")
    bad = F.array_sort(F.collect_list(F.when(F.col("n_chars") < 100, F.col("doc_id"))))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size(F.split("text", "\n"))).alias("chunks"), F.count_if(F.col("k").isNotNull()).alias("skipped"),
        F.array_join(F.transform(bad, lambda i: F.concat(i.cast("string"), F.lit(": too short"))), ",").alias("errors"),
    )


@query("SELECT quality, count(*) FILTER (toxic = 0)::BIGINT AS successful, count(*) FILTER (toxic = 1)::BIGINT AS failed FROM labels GROUP BY quality")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 0).alias("successful"), F.count_if(F.col("toxic") == 1).alias("failed"))


@query("""SELECT user_id, name, created_at, row_number() OVER (ORDER BY created_at DESC, user_id)::INT AS place FROM (
SELECT user_id, arg_max(event_type, event_id) AS name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events WHERE user_id % 9 <> 4 GROUP BY user_id)""")
def tenant_lww(spark: SparkSession, d: str) -> DataFrame:
    """Tenants after all their writes, each of which sets created_at anew, and some deletions; the newest first."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "event_id")
    kept = merge.delete(merge.last_write(e, ["user_id"], ["event_id"]), e.where("user_id % 9 = 4"), ["user_id"])
    # places within an hour, behind those of later hours, of which there is a row each
    kept = kept.withColumn("hour", F.substring("created_at", 1, 13))
    later = F.coalesce(F.sum("n").over(W.orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hours = kept.groupBy("hour").agg(F.count(F.lit(1)).alias("n")).select("hour", later.alias("later"))
    place = F.row_number().over(W.partitionBy("hour").orderBy(F.desc("created_at"), "user_id")) + F.col("later")
    return kept.join(hours, "hour").select("user_id", "name", "created_at", place.cast("int").alias("place"))


@query("SELECT user_id, arg_max(event_type, event_id) AS name FROM events WHERE sha256('key-' || user_id) IN (SELECT sha256('key-' || c_custkey) FROM customer WHERE c_custkey % 3 = 0) GROUP BY user_id")
def tenant_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Tenants whose key's hash is among the given ones."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("name"), "event_id")
    rows = merge.last_write(e, ["user_id"], ["event_id"]).withColumn("h", F.sha2(F.concat(F.lit("key-"), F.col("user_id")), 256))
    keys = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.sha2(F.concat(F.lit("key-"), F.col("c_custkey")), 256).alias("h"))
    return rows.join(keys, "h", "left_semi").select("user_id", "name")


@query("""SELECT a.event_id, CASE WHEN a.ts - s.ts <= INTERVAL 6 HOUR THEN s.event_id END AS cached FROM (SELECT * FROM events WHERE event_type <> 'view') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') s ON a.user_id = s.user_id AND a.ts >= s.ts""")
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    """What a client's cache holds at each of its requests: what was last set, for six hours."""
    e = table(spark, d, "events")
    found = A.valid_at(e.where("event_type = 'view'").select("user_id", "ts", "event_id"), e.where("event_type <> 'view'").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 6 * 3600)
    return found.select("event_id", "cached")


@query("""SELECT a.event_id, CASE WHEN a.ts - s.ts <= INTERVAL 6 HOUR THEN s.event_id END AS cached FROM (SELECT * FROM events WHERE event_type <> 'view') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') s ON a.user_id = s.user_id AND a.ts >= s.ts""")
def stream_cache(spark: SparkSession, d: str) -> DataFrame:
    """The same cache over a stream: a value by key, and a timer that clears it."""
    rows = table(spark, d, "events").withColumn("get", F.col("event_type") != "view")
    found = state.kept(state.cached(state.arrivals(rows, "ts"), "user_id", "ts", "event_id", "get", "event_id", 6 * 3600), "cache")
    return found.select("event_id", F.col("cached").cast("bigint").alias("cached"))


_JOBS = "(SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events)"


@query(f"""SELECT state, coalesce(before, '-') AS before, (CASE WHEN before IS NULL THEN state = 'pending' WHEN before = 'pending' THEN state IN ('running', 'failed')
  WHEN before = 'running' THEN state IN ('completed', 'failed') ELSE false END) AS allowed, count(*)::BIGINT AS n FROM (
SELECT state, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {_JOBS}) GROUP BY ALL""")
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How often each step of a job was taken, and whether it may be."""
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    found = A.transitions(table(spark, d, "events").select("user_id", "event_id", state.alias("state")), "user_id", "event_id", "state")
    return found.groupBy("state", F.coalesce("before", F.lit("-")).alias("before"), "allowed").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) FILTER (state = 'running')::BIGINT AS running, count(*) FILTER (state = 'running') < 40 AS free FROM (
SELECT arg_max(state, event_id) AS state FROM {_JOBS} GROUP BY user_id)""")
def job_limit(spark: SparkSession, d: str) -> DataFrame:
    """How many jobs run, and whether another may start."""
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    last = A.latest(table(spark, d, "events").withColumn("state", state), "user_id", "event_id", "state")
    return last.agg(F.count_if(F.col("state") == "running").alias("running")).select("running", (F.col("running") < 40).alias("free"))


@query("""SELECT doc_id, round(25 + (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) / (count(*) OVER (PARTITION BY source, lang))::DOUBLE * 70, 4) AS progress FROM documents""")
def ingest_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far an ingestion is when it comes to each document; one runs for each tenant and knowledge base."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    n = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(W.partitionBy("source", "lang").orderBy("doc_id")) - 1
    return docs.withColumn("i", at).join(n, ["source", "lang"]).select("doc_id", F.round(25 + F.col("i") / F.col("n") * 70, 4).alias("progress"))


@query("""SELECT doc_id, md5('/in/' || doc_id || ':' || (1700000000 + doc_id) || ':' || n_chars) AS cache_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def result_cache(spark: SparkSession, d: str) -> DataFrame:
    """Files without a result: the key is of path, time and size, and a file that changed has another."""
    key = lambda size: F.md5(F.concat_ws(":", F.concat(F.lit("/in/"), "doc_id"), (F.lit(1_700_000_000) + F.col("doc_id")).cast("string"), size.cast("string")))
    files = table(spark, d, "documents").select("doc_id", "n_chars", key(F.col("n_chars")).alias("cache_key"))
    done = files.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").select(key(F.col("n_chars") + F.col("toxic")).alias("cache_key"))
    return files.join(done, "cache_key", "left_anti").select("doc_id", "cache_key")


@query("""SELECT n_name, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def rel_join_agg(spark: SparkSession, d: str) -> DataFrame:
    met = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def rel_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
