"""The queries that apply the operators to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import (
    alignment,
    byte_bpe,
    chat,
    jaccard,
    language,
    licenses,
    packing,
    prefix_forest,
    quality_classifier,
    quality_rules,
    repair,
    sharding,
    simhash,
)
from brindle.llm.texts import id_remainder
from brindle.sources import Tables

#: Phrases that op10 counts, and the labels they stand for.
NAMED_LICENSES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The same in DuckDB's SQL, for those that SQL can express.
SQL: dict[str, str] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


# sha256 of what was said, and the length of marks, texts and backslashes
SQL["op6_chat_grammar"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
                      ELSE 23 + length(role) END
         + length(text)
         + len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[TEXT\]'))
         + coalesce(list_sum(list_transform(regexp_extract_all(text, '\\+[\[<]?'),
                                            lambda x: length(x) - 1)), 0) AS chars
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# crc32 by its table of 256 steps, then running sums in the order of the shards
SQL["op9_prefix_sum_shards"] = """
WITH step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384)
                                                   ELSE c // 2 END, i) AS c
    FROM range(256) r(i))),
sized AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size,
         CAST(xor(list_reduce(
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                          lambda h: CAST('0x' || h AS BIGINT)),
           lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)
           AS BIGINT) AS text_crc32
  FROM documents, step),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size
                            ROWS UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER () AS total
  FROM sized),
cut AS (
  SELECT *, CAST((2 * upto - size) * 24 // (2 * total) AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1
         AS slot,
       CAST(NULL AS INT) AS grown_shard
FROM cut
"""

# crc32 by its table of 256 steps; then a step for each turn, in which each state takes the least
# (cost, audit, what was said) of those that lead to it
SQL["op11_audit_repair"] = r"""
WITH RECURSIVE step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384)
                                                   ELSE c // 2 END, i) AS c
    FROM range(256) r(i))),
told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(
           list_transform(regexp_extract_all(hex(encode(
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))),
             '..'), lambda h: CAST('0x' || h AS BIGINT)),
           lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)
           % 20 AS fate
  FROM conversations, step),
damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
           AS text,
         unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM told),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
                               ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text
                            ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN core = '' THEN 1 WHEN nth > 1 THEN 2
                 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1)
           NOT IN ('su', 'ua', 'au') AS odd
  FROM placed),
heard AS (
  SELECT conv_id, count(*) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (odd) AS illegal,
         list({'r': left(role, 1), 'f': fault, 'role': role, 'text': text} ORDER BY i) AS turns
  FROM judged GROUP BY conv_id),
ways AS (
  SELECT conv_id, n, turns, 0 AS i, {'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])} AS s0,
         {'c': 1000000, 'a': '', 'o': CAST([] AS VARCHAR[])} AS s1,
         {'c': 1000000, 'a': '', 'o': CAST([] AS VARCHAR[])} AS s2,
         {'c': 1000000, 'a': '', 'o': CAST([] AS VARCHAR[])} AS s3
  FROM heard
  UNION ALL
  SELECT conv_id, n, turns, i + 1,
         {'c': t0.c + 2, 'a': t0.a || 'D', 'o': t0.o},
         list_min([{'c': t1.c + 2, 'a': t1.a || 'D', 'o': t1.o},
                   {'c': t0.c + if(x.r = 's', k, 1000000), 'a': t0.a || 'K',
                    'o': list_append(t0.o, x.role || ':' || x.text)}]),
         list_min([{'c': t2.c + 2, 'a': t2.a || 'D', 'o': t2.o}]
           || list_transform([t0, t1, t3], lambda t:
                {'c': t.c + if(x.r = 'u', k, 1000000), 'a': t.a || 'K',
                 'o': list_append(t.o, x.role || ':' || x.text)})
           || list_transform([t0, t1, t3], lambda t:
                {'c': t.c + k + 1, 'a': t.a || 'R', 'o': list_append(t.o, 'user:' || x.text)})),
         list_min([{'c': t3.c + 2, 'a': t3.a || 'D', 'o': t3.o},
                   {'c': t2.c + if(x.r = 'a', k, 1000000), 'a': t2.a || 'K',
                    'o': list_append(t2.o, x.role || ':' || x.text)},
                   {'c': t2.c + k + 1, 'a': t2.a || 'R',
                    'o': list_append(t2.o, 'assistant:' || x.text)}])
  FROM (
    SELECT *, list_min([s3, {'c': t2.c + 5, 'a': t2.a || 'I',
                             'o': list_append(t2.o, 'assistant:')}]) AS t3
    FROM (
      SELECT conv_id, n, turns, i, turns[i + 1] AS x,
             CASE turns[i + 1].f WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000 END AS k,
             s0 AS t0, s1 AS t1, s3,
             list_min([s2] || list_transform([s0, s1, s3], lambda s:
               {'c': s.c + 5, 'a': s.a || 'I', 'o': list_append(s.o, 'user:')})) AS t2
      FROM ways WHERE i < n))),
best AS (
  SELECT conv_id, list_min([s0, s3,
    {'c': s2.c + 5, 'a': s2.a || 'I', 'o': list_append(s2.o, 'assistant:')},
    {'c': s1.c + 10, 'a': s1.a || 'II', 'o': s1.o || ['user:', 'assistant:']}]) AS b
  FROM ways WHERE i = n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
       coalesce(b.a, '') AS audit,
       sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN heard h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query
def op1_nearest_centroid_language(t: Tables) -> DataFrame:
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    model = language.train(t.documents, "doc_id", "text", "lang",
                           learnable=id_remainder("doc_id", 3) != 1)
    docs = t.documents.select("doc_id", held_out.alias("held_out"), "text")
    # the nearest language for every text with a letter; `rejected` tells which are far off
    return language.identify(docs, "text", model).select(
        "doc_id", "held_out", F.col("lang_nearest").alias("lang_pred"), "score", "rejected")


@query
def op2_vector_packing(t: Tables) -> DataFrame:
    return packing.pack_texts(
        t.documents, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=1,
        limits=packing.Limits(tokens=2048, segments=64, loss=2047)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op3_chunked_byte_bpe(t: Tables) -> DataFrame:
    return byte_bpe.encode_texts(
        t.documents.select("doc_id", "text"), "text",
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    ).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op4_divergence_rules(t: Tables) -> DataFrame:
    return quality_rules.apply_rules(
        t.documents.select("doc_id", "text", "lang"), "text", "lang").drop("text", "lang")


@query
def op5_chosen_path_join(t: Tables) -> DataFrame:
    return jaccard.jaccard_join(t.documents, "doc_id", "text")


@query
def op6_chat_grammar(t: Tables) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = t.spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], t.conversations.schema)
    formatted = chat.format_turns(t.conversations.unionByName(extra), "role", "text")
    return chat.read_back(formatted, "conv_id", "turn", "role", "text")


@query
def op7_prefix_forest_search(t: Tables) -> DataFrame:
    return prefix_forest.search(t.embeddings, "vec_id", "embedding", F.col("vec_id") % 20 == 0,
                                k=20)


@query
def op8_nb_svm_quality(t: Tables) -> DataFrame:
    model = quality_classifier.train(t.documents, t.labels, "doc_id", "text", "quality",
                                     learnable=id_remainder("doc_id", 5) != 0)
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    docs = t.documents.select("doc_id", held_out.alias("held_out"), "text")
    return quality_classifier.score_texts(docs, "text", model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_prefix_sum_shards(t: Tables) -> DataFrame:
    return sharding.byte_shards(t.documents, "doc_id", "text", shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_license_templates(t: Tables) -> DataFrame:
    return licenses.scan_licenses(
        t.documents.select("doc_id", "text"), "text", NAMED_LICENSES).drop("text")


@query
def op11_audit_repair(t: Tables) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    damaged = repair.damage(t.conversations, *names)
    audits, turns = repair.repair(
        damaged, "conv", "turn", "role", "text",
        conversations=t.conversations.select(F.col("conv_id").alias("conv")))
    said = repair.digests(turns).withColumnRenamed("conv", "conv_")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return audits.join(said, F.col("conv").eqNullSafe(F.col("conv_")), "left").select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


@query
def op12_gray_simhash(t: Tables) -> DataFrame:
    return simhash.simhash_join(t.documents, "doc_id", "text")


@query
def op13_csr_alignment(t: Tables) -> DataFrame:
    return alignment.align_documents(
        t.documents, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))
