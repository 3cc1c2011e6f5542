"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import bpe, centroids, decontam, dialogue, flat, jaccard, licenses, linededup, neardup, order, pieces, secrets, toxicity
from heronlake.llm.common import read


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.token_counts(read(spark, sf_dir, "documents"), vocabulary())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP2_SQL = r"""
WITH word_lists AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), windows AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM word_lists WHERE side = 1 AND len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT id AS doc_id, n, i, w[i : i + n - 1] AS phrase FROM (
    SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM word_lists, lengths WHERE side = 0 AND len(w) >= n)
), found AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows USING (n, phrase)
), hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1
), item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY 1)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word_lists LEFT JOIN hit ON hit.doc_id = id LEFT JOIN item ON item.doc_id = id WHERE side = 0
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n
"""


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode(read(spark, sf_dir, "documents"), vocabulary()))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL
), p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
), n AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id))::BIGINT AS component_id,
  vec_id = least(vec_id, coalesce(c, vec_id)) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    confirmed = F.filter("paragraphs", lambda p: p["confirmed"])
    return found.select(
        "doc_id",
        F.size("paragraphs").cast("long").alias("n_candidates"),
        F.size(confirmed).cast("long").alias("n_confirmed"),
        F.concat_ws(",", "families").alias("families"),
        F.concat_ws(
            ",", F.transform(confirmed, lambda p: F.concat_ws(":", p["line"].cast("string"), p["family"]))
        ).alias("matches"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(read(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string")))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_kept"),
        F.concat_ws(",", spans).alias("removed"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.training_order(read(spark, sf_dir, "documents"), vocabulary())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.reports(dialogue.damaged(read(spark, sf_dir, "conversations")), gone=F.col("gone"))


OP11_SQL = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS name FROM conversations
), crc AS (
  SELECT * EXCLUDE (name), xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, octet_length(name) + 1),
      lambda i: list_prepend(('0x' || substr(hex(name), 2 * i - 1, 2))::BIGINT, list_transform(range(8), lambda j: -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 20 AS kind FROM source
), rows_ AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM crc, range(2) AS copy(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)
), repeats AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows_
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS p FROM repeats
), judged AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS was,
    CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed
), ids AS (SELECT DISTINCT conv_id FROM conversations
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id
), steps(state, made, edits, cost) AS (  -- grammar states 0 start, 1 system, 2 user, 3 assistant; turns inserted before a row
  SELECT s, CASE WHEN k = 0 THEN s WHEN (s = 2) = (k = 1) THEN 3 ELSE 2 END, repeat('I', k::INT), 5 * k FROM range(4) AS a(s), range(3) AS b(k)
), walk AS (
  SELECT conv_id, 0::BIGINT AS p, 0::BIGINT AS state, 0::BIGINT AS cost, '' AS audit, '' AS done FROM ids
  UNION ALL
  SELECT * FROM (
    SELECT walk.conv_id, walk.p + 1 AS p, e.state_after AS state, walk.cost + steps.cost + e.cost AS cost, walk.audit || steps.edits || e.edit AS audit,
      walk.done || CASE steps.edits WHEN '' THEN '' WHEN 'I' THEN CASE steps.made WHEN 2 THEN 'u' ELSE 'a' END ELSE CASE steps.made WHEN 2 THEN 'au' ELSE 'ua' END END
        || e.role_after AS done
    FROM walk JOIN steps ON steps.state = walk.state JOIN judged ON judged.conv_id IS NOT DISTINCT FROM walk.conv_id AND judged.p = walk.p + 1,
      LATERAL (
        SELECT 'D' AS edit, steps.made AS state_after, 2 AS cost, 'x' AS role_after
        UNION ALL SELECT 'K', CASE judged.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'k'
          WHERE fault IN ('none', 'truncated') AND (judged.i = 's' AND steps.made = 0 OR judged.i = 'u' AND steps.made <> 2 OR judged.i = 'a' AND steps.made = 2)
        UNION ALL SELECT 'R', CASE steps.made WHEN 2 THEN 3 ELSE 2 END, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, CASE steps.made WHEN 2 THEN 'A' ELSE 'U' END
          WHERE fault IN ('none', 'truncated')
      ) AS e
    QUALIFY row_number() OVER (PARTITION BY walk.conv_id, e.state_after ORDER BY walk.cost + steps.cost + e.cost, walk.audit || steps.edits || e.edit) = 1
  )
), ends AS (
  SELECT conv_id, cost, audit, done FROM (
    SELECT walk.conv_id, walk.cost + steps.cost AS cost, walk.audit || steps.edits AS audit,
      walk.done || CASE steps.edits WHEN '' THEN '' WHEN 'I' THEN CASE steps.made WHEN 2 THEN 'u' ELSE 'a' END ELSE CASE steps.made WHEN 2 THEN 'au' ELSE 'ua' END END AS done
    FROM walk JOIN steps ON steps.state = walk.state AND steps.made IN (0, 3) LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM walk.conv_id
    WHERE walk.p = coalesce(n, 0))
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
), made AS (  -- done has a letter for each edit: its row's number is how many of x k A U (rows) came
  SELECT conv_id, cost, audit, done, unnest(range(1, len(done) + 1)) AS k FROM ends
), lines AS (
  SELECT made.conv_id, k, CASE substr(done, k, 1) WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' WHEN 'U' THEN 'user:' || text
    WHEN 'A' THEN 'assistant:' || text ELSE role || ':' || text END AS line
  FROM made LEFT JOIN judged ON judged.conv_id IS NOT DISTINCT FROM made.conv_id AND substr(done, k, 1) IN ('k', 'A', 'U')
    AND judged.p = len(regexp_replace(left(done, k::INT), '[ua]', '', 'g'))
  WHERE substr(done, k, 1) <> 'x'
), hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM lines GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN hashes ON hashes.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(read(spark, sf_dir, "documents"), piece_model())
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(*centroids.cluster(read(spark, sf_dir, "embeddings")))


def _op13_sql() -> str:
    near = """a{i} AS (
  SELECT vec_id, row_id, e, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT v.vec_id, v.row_id, v.e, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM v, c{i} AS c) GROUP BY vec_id, row_id, e)"""
    move = """, c{j} AS (
  SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} AS c LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS e FROM (
      SELECT cluster, i, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT cluster, unnest(e) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY cluster, i
    ) GROUP BY cluster) AS m ON m.cluster = c.c), """
    steps = "".join(near.format(i=i) + (move.format(i=i, j=i + 1) if i < 3 else "") for i in range(4))
    return f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v ORDER BY c LIMIT 16
), {steps}
SELECT a.vec_id, a.cluster::INT AS cluster, a.distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a3 AS a JOIN c3 AS c ON c.c = a.cluster
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_training_order": op10_training_order,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_centroids": op13_centroids,
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_embedding_neardup": op5_embedding_neardup,
    "op6_secrets": op6_secrets,
    "op9_line_dedup": op9_line_dedup,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
}
ORACLE: dict[str, str] = {
    "op11_conversation_repair": OP11_SQL,
    "op13_centroids": OP13_SQL,
    "op2_decontamination": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op5_embedding_neardup": OP5_SQL,
}
