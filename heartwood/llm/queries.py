"""The thin queries: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm.dialogues import damage, repair
from heartwood.llm.importance import importance_sample
from heartwood.llm.langid import identify
from heartwood.llm.lmscore import lm_scores
from heartwood.llm.mixing import mix
from heartwood.llm.neardup import embedding_groups
from heartwood.llm.packing import pack
from heartwood.llm.repetition import repetition
from heartwood.llm.simhash import simhash_groups
from heartwood.llm.substrings import drop_shared_windows
from heartwood.llm.suffixes import drop_repeated_substrings
from heartwood.llm.tokencount import token_counts
from heartwood.llm.tokens import read_token_files, write_token_files

#: Where the tokenizers' files lie, and the ids that end a document in each.
BYTE_BPE, BYTE_END = "byte_bpe_50k.json", 2
WORD_BPE, WORD_END = "word_bpe_49k.json", 0
PIECES = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_substrings(documents(spark, sf_dir), window=50)
    n_removed = F.col("n_bytes") - F.octet_length("kept").cast("long")
    n_spans = F.size("spans").cast("long")
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_shared_windows(documents(spark, sf_dir), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), order=3)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(documents(spark, sf_dir), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), power=0.5, copy_col="copy")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_files(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), BYTE_END)
    return read_token_files(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), capacity=2048, end_id=WORD_END)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, _ = repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return reports


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES), limit=4096)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_sample(documents(spark, sf_dir), benchmark, percent=25, least_words=20, buckets=10_000, seed=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_embedding_neardup,
        op2_suffix_dedup,
        op3_langid,
        op4_substring_dedup,
        op5_lm_score,
        op6_quality_rules,
        op7_simhash,
        op8_mix,
        op9_token_files,
        op10_packing,
        op11_conversation_repair,
        op12_token_counts,
        op13_importance_resampling,
    )
    return {query.__name__: query for query in every}


OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN degree USING (vec_id)
"""

OP2 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)
), first_doc AS (
  SELECT k, min(doc_id) AS m FROM w GROUP BY k
), hit AS (
  SELECT w.doc_id, w.i FROM w JOIN first_doc USING (k) WHERE m < w.doc_id
), marked AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS e,
         string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, i, hash(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)
), often AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), marked AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN often USING (k)
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 35 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 35 AS b FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS p FROM spans
), cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, max(b) AS e,
         list_concat(flatten(list(ws[p:a - 1] ORDER BY a)), any_value(ws)[max(b):]) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(array_to_string(coalesce(kept, ws), ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP11 = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), g AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), f AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295, list_reduce(list_transform(string_split(name, ''), lambda ch: ord(ch)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS d
  FROM g, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM f WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), named AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS ini,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, right(rtrim(text, E' \t\n\x0b\x0c\r'), 1) AS last
  FROM placed
), marked AS (
  SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated FROM named
), conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
         list({'ini': ini, 'goes': blank OR duplicate, 'cut': truncated::INT} ORDER BY i) AS rs, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
  FROM marked GROUP BY conv_id
), paths AS (
  -- the cheapest way to each place in the pattern, as cost in six digits and audit; '~' where there is none
  SELECT *, list_reduce(rs, lambda w, r: list_transform([[
      least(CASE WHEN w[1] < '~' THEN printf('%06d', left(w[1], 6)::INT + 3) || substr(w[1], 7) || 'D' ELSE '~' END),
      least(CASE WHEN w[2] < '~' THEN printf('%06d', left(w[2], 6)::INT + 3) || substr(w[2], 7) || 'D' ELSE '~' END,
            CASE WHEN NOT r.goes AND r.ini = 's' AND w[1] < '~' THEN printf('%06d', left(w[1], 6)::INT + r.cut) || substr(w[1], 7) || 'K' ELSE '~' END),
      least(CASE WHEN w[3] < '~' THEN printf('%06d', left(w[3], 6)::INT + 3) || substr(w[3], 7) || 'D' ELSE '~' END,
            CASE WHEN NOT r.goes AND r.ini = 'u' AND least(w[1], w[2], w[4]) < '~' THEN printf('%06d', left(least(w[1], w[2], w[4]), 6)::INT + r.cut) || substr(least(w[1], w[2], w[4]), 7) || 'K' ELSE '~' END,
            CASE WHEN NOT r.goes AND least(w[1], w[2], w[4]) < '~' THEN printf('%06d', left(least(w[1], w[2], w[4]), 6)::INT + 2 + r.cut) || substr(least(w[1], w[2], w[4]), 7) || 'R' ELSE '~' END),
      least(CASE WHEN w[4] < '~' THEN printf('%06d', left(w[4], 6)::INT + 3) || substr(w[4], 7) || 'D' ELSE '~' END,
            CASE WHEN NOT r.goes AND r.ini = 'a' AND w[3] < '~' THEN printf('%06d', left(w[3], 6)::INT + r.cut) || substr(w[3], 7) || 'K' ELSE '~' END,
            CASE WHEN NOT r.goes AND w[3] < '~' THEN printf('%06d', left(w[3], 6)::INT + 2 + r.cut) || substr(w[3], 7) || 'R' ELSE '~' END)
    ]], lambda v: [v[1], v[2],
      least(v[3], CASE WHEN least(v[1], v[2], v[4]) < '~' THEN printf('%06d', left(least(v[1], v[2], v[4]), 6)::INT + 2) || substr(least(v[1], v[2], v[4]), 7) || 'I' ELSE '~' END),
      least(v[4], CASE WHEN v[3] < '~' THEN printf('%06d', left(v[3], 6)::INT + 2) || substr(v[3], 7) || 'I' ELSE '~' END,
            CASE WHEN least(v[1], v[2]) < '~' THEN printf('%06d', left(least(v[1], v[2]), 6)::INT + 4) || substr(least(v[1], v[2]), 7) || 'II' ELSE '~' END)])[1],
    ['000000', '~', '000002I', '000004II']) AS w FROM conv
), chosen AS (
  SELECT *, left(least(w[1], w[4]), 6)::BIGINT AS cost, substr(least(w[1], w[4]), 7) AS audit FROM paths
), letters AS (
  SELECT conv_id, k, audit[k] AS e, roles, texts, k - len(replace(left(audit, k), 'I', '')) AS inserts, len(replace(left(audit, k), 'D', '')) AS place
  FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS k FROM chosen)
), turned AS (
  SELECT conv_id, k, e, place, roles[k - inserts] AS role, CASE WHEN e = 'I' THEN '' ELSE texts[k - inserts] END AS text,
         bool_or(e = 'K' AND left(roles[k - inserts], 1) = 's') OVER (PARTITION BY conv_id) AS led
  FROM letters WHERE e <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS body
  FROM turned GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN chosen c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
"""

OP13 = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), grams AS (
  SELECT row, g, count(*) AS n FROM (
    SELECT row, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM (SELECT row, ws FROM d UNION ALL SELECT NULL, ws FROM b)
  ) GROUP BY row, g
), hashed AS (
  SELECT g, xor(4294967295, list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)), crc
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (row IS NOT NULL), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (row IS NULL), 0)::DOUBLE AS t FROM grams JOIN hashed USING (g) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts
), weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM grams JOIN hashed USING (g) JOIN gains USING (bucket) WHERE row IS NOT NULL GROUP BY row
), scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (row)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB statements for the operators that SQL can express; tests/llm hold the others against brute force."""
    return {
        "op1_embedding_neardup": OP1,
        "op2_suffix_dedup": OP2,
        "op4_substring_dedup": OP4,
        "op11_conversation_repair": OP11,
        "op13_importance_resampling": OP13,
    }
