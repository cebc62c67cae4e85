"""One query per operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleflow.llm import (
    audit, langid, mixing, packing, pii, quality, repair, sharding, simhash, toxicity, vptree, warc,
    winnow,
)
from rippleflow.llm.common import documents, placed

#: Mixing: weights of the sources; any other source has weight 1.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
MIX_SEED = 17
#: The session setting that holds the key of the pseudonyms.
PII_KEY_SETTING = "rippleflow.pii.key"
SHARDS = 8
CAPACITY = 1024
#: What decides that a document is toxic.
TOXIC_AT = 0.4


def vocabulary_path() -> str:
    """The tokenizer file of the packing query."""
    import public_tokenizers

    return os.environ.get("RIPPLEFLOW_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def pii_key(spark: SparkSession) -> str:
    """The session's key; a session without one gets a random key, which nobody can look up."""
    key = spark.conf.get(PII_KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(PII_KEY_SETTING, key)
    return key


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir), SOURCE_WEIGHTS, seed=MIX_SEED).select(
        "doc_id", "source", "text", "rate", "copies", "copy", "shuffle_key")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs.where(~F.coalesce(held_out, F.lit(False))).select("lang", "text"))
    texts = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return langid.predict(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark))


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.write_shards(documents(spark, sf_dir), SHARDS)
    return written.select(
        "doc_id", "size",
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path(), CAPACITY).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, labels, {
        "low_quality": F.col("quality") == 0,
        "toxic": F.col("toxic") == 1,
        "toxic_low_quality": (F.col("toxic") == 1) & (F.col("quality") == 0)})
    return toxicity.score(docs, chain).select(
        "doc_id", F.col("low_quality").alias("low_quality_score"),
        F.col("toxic").alias("toxic_score"),
        F.col("toxic_low_quality").alias("toxic_low_quality_score"),
        (F.col("toxic") >= TOXIC_AT).alias("toxic"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summaries(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: placed(f) for f in (
    op1_poisson_mixing, op2_language_id, op3_vantage_point_trees, op4_feistel_pseudonyms,
    op5_external_shuffle, op6_weak_supervision, op7_simhash, op8_warc, op9_linear_grouping,
    op10_classifier_chain, op11_conversation_repair, op12_winnowing, op13_filter_audit)}


def _weights_sql() -> str:
    cases = " ".join(f"WHEN '={k}' THEN {v!r}::DOUBLE" for k, v in SOURCE_WEIGHTS.items())
    return f"CASE source_key {cases} ELSE 1.0::DOUBLE END"


ORACLES = {
    "op1_poisson_mixing": f"""
WITH RECURSIVE keyed AS (
  SELECT *, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS source_key,
         coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, ''))) AS identity
  FROM documents),
sizes AS (
  SELECT source_key, sum(coalesce(strlen(text), 0) + 1) AS size FROM keyed GROUP BY 1),
weighted AS (SELECT *, {_weights_sql()} AS weight FROM sizes),
rates AS (
  SELECT source_key, weight / (SELECT sum(weight) FROM weighted)
         * 1.0::DOUBLE * (SELECT sum(size) FROM weighted) / size AS rate FROM weighted),
parts AS (
  SELECT source_key, rate, greatest(ceil(rate / {mixing.RATE_PER_DRAW!r}), 1)::BIGINT AS draws
  FROM rates),
cdf AS (
  SELECT source_key, rate / draws AS r, 0 AS k, exp(-(rate / draws)) AS p,
         exp(-(rate / draws)) AS c FROM parts
  UNION ALL
  SELECT source_key, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf
  WHERE k < {mixing.TERMS}),
terms AS (SELECT source_key, list(c) AS cs FROM cdf GROUP BY 1),
drawn AS (
  SELECT d.doc_id, d.source, d.text, d.identity, p.rate,
         list_sum(list_transform(range(p.draws), lambda j: len(list_filter(t.cs, lambda c: c <=
           ('0x' || substr(md5('{MIX_SEED}|' || d.identity || '|' || j::VARCHAR), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE))))::INT AS copies
  FROM keyed d JOIN parts p USING (source_key) JOIN terms t USING (source_key)),
copied AS (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM drawn WHERE copies > 0)
SELECT doc_id, source, text, rate, copies, copy,
       substr(md5('{MIX_SEED}|' || identity || '|order|' || copy::VARCHAR), 1, 16) AS shuffle_key
FROM copied""",
    "op3_vantage_point_trees": """
WITH valid AS (
  SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (
  SELECT id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n
  FROM valid),
scored AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]),
                     lambda a, b: a + b) / (q.n * c.n) AS score
  FROM normed q JOIN normed c ON q.id % 50 = 0 AND c.id <> q.id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response'
            ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN firsts USING (payload_digest)""",
    "op11_conversation_repair": r"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           range(strlen(name)), lambda i: list_transform(range(8), lambda b:
             ((ascii(name[i + 1]) >> b) & 1)::BIGINT)))),
           lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS kind
  FROM spaced),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
           AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
numbered AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS past,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS same
  FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN same > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated'
                 ELSE '' END AS fault FROM numbered),
counts AS (
  SELECT conv_id, max(i) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (past IS NOT NULL AND past || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY 1),
puts(before, n, after) AS (VALUES
  ('-', 0, '-'), ('s', 0, 's'), ('u', 0, 'u'), ('a', 0, 'a'), ('-', 1, 'u'), ('-', 2, 'a'),
  ('s', 1, 'u'), ('s', 2, 'a'), ('u', 1, 'a'), ('a', 1, 'u')),
edits(before, letter, initial, after, price) AS (VALUES
  ('-', 'D', NULL, '-', 3), ('s', 'D', NULL, 's', 3), ('u', 'D', NULL, 'u', 3), ('a', 'D', NULL, 'a', 3),
  ('-', 'K', 's', 's', 0), ('-', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0),
  ('a', 'K', 'u', 'u', 0), ('-', 'R', NULL, 'u', 2), ('s', 'R', NULL, 'u', 2), ('u', 'R', NULL, 'a', 2),
  ('a', 'R', NULL, 'u', 2)),
walk AS (
  SELECT DISTINCT c.conv_id, 0::BIGINT AS i, p.after AS state,
         {'cost': 2 * p.n, 'path': repeat('I', p.n)} AS best
  FROM counts c, puts p WHERE p.before = '-'
  UNION ALL
  SELECT w.conv_id, f.i, p.after,
         min({'cost': w.best.cost + e.price + 2 * p.n
                      + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END,
              'path': w.best.path || e.letter || repeat('I', p.n)})
  FROM walk w
  JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN edits e ON e.before = w.state AND (e.initial IS NULL OR e.initial = f.role[1])
       AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  JOIN puts p ON p.before = e.after
  GROUP BY w.conv_id, f.i, p.after),
best AS (
  SELECT c.conv_id, min(w.best) AS best FROM counts c
  JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n AND w.state IN ('-', 'a')
  GROUP BY 1),
letters AS (
  SELECT conv_id, best.path AS path, unnest(range(1, strlen(best.path) + 1)) AS pos FROM best),
placed AS (
  SELECT *, path[pos] AS letter,
         strlen(replace(path[1:pos], 'I', '')) AS i, strlen(replace(path[1:pos], 'D', '')) AS o
  FROM letters),
written AS (
  SELECT l.conv_id, l.pos, l.letter, l.o, f.role, CASE l.letter WHEN 'I' THEN '' ELSE f.text END AS text,
         max(CASE WHEN l.o = 1 AND l.letter = 'K' AND f.role[1] = 's' THEN 1 ELSE 0 END)
           OVER (PARTITION BY l.conv_id) AS led
  FROM placed l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i
  WHERE l.letter <> 'D'),
shas AS (
  SELECT conv_id, sha256(string_agg(
           CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || text, chr(10) ORDER BY pos)) AS sha FROM written GROUP BY 1)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank,
       coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(b.best.cost, 0)::BIGINT AS cost,
       coalesce(b.best.path, '') AS audit, coalesce(s.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN shas s ON s.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_winnowing": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
runs AS (SELECT DISTINCT n, run FROM wanted),
hits AS (
  SELECT p.k, p.i, p.n, p.run FROM (
    SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS run FROM (
      SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i
      FROM d CROSS JOIN (SELECT DISTINCT n FROM items) WHERE len(w) >= n)) p
  SEMI JOIN runs ON runs.n = p.n AND runs.run = p.run),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (
  SELECT k, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
found AS (
  SELECT k, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT k, n, run FROM hits) JOIN wanted USING (n, run) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN found USING (k)""",
    "op13_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
          FROM labels GROUP BY 1),
verdicts AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INT + (100 * len(list_distinct(w)) < 50 * len(w))::INT * 2
         + (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT * 4
         + regexp_matches(text, '[#$%&*|]')::INT * 8
         + coalesce(doc_id > first, false)::INT * 16 AS mask
  FROM split JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS t FROM verdicts GROUP BY 1, 2),
letters(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.b + w.b + x.b + y.b + z.b = 31
    AND len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS c,
         (SELECT b FROM letters WHERE c = filter_order[step]) AS own,
         list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(filter_order[j]) - 65))) AS past
  FROM orders, range(1, 6) r(step)),
rows_ AS (
  SELECT part, filter_order, step, c, own, coalesce(past, 0)::BIGINT AS before, n, g, t, mask
  FROM steps, masks),
summed AS (
  SELECT part, filter_order, step, c,
         coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(t) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM rows_ GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley
FROM summed""",
}
