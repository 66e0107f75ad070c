"""Registered queries of the operators: ``QUERIES`` and their ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (cotraining, curriculum, dom_model, filter_diagrams, hilbert_shards, learned_partitions, norm_buckets, probminhash,
               token_blocks, toxicity, unigram_pieces, whitening, zstd_language)
from .common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op5_toxicity")
def op5_toxicity(spark, d):
    return toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op9_probminhash")
def op9_probminhash(spark, d):
    return probminhash.near_duplicates(table(spark, d, "documents"))


@query("op10_curriculum")
def op10_curriculum(spark, d):
    plan = curriculum.plan_mix(table(spark, d, "documents"))
    every = F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda k: curriculum.pass_position(k))
    mixed = plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("passes")).cast("bigint").alias("taken"), "passes",
        F.when(F.col("passes") > 0, every).otherwise(F.array().cast("array<double>")).alias("positions"))
    first = F.get("positions", F.lit(0))
    return (mixed.withColumn("first_position", first).repartitionByRange(F.asc_nulls_last("first_position"), "doc_id")
            .sortWithinPartitions(F.asc_nulls_last("first_position"), "doc_id"))


@query("op8_unigram_pieces")
def op8_unigram_pieces(spark, d):
    return unigram_pieces.round_trip(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op3_cotraining")
def op3_cotraining(spark, d):
    return cotraining.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op2_token_blocks")
def op2_token_blocks(spark, d):
    path = shared_path(spark, "token-blocks")
    token_blocks.write_tokens(table(spark, d, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_blocks.document_digests(spark, path).withColumnRenamed("id", "doc_id")


@query("op4_norm_buckets")
def op4_norm_buckets(spark, d):
    return norm_buckets.inner_product_topk(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")


SQL["op4_norm_buckets"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op1_learned_partitions")
def op1_learned_partitions(spark, d):
    return learned_partitions.nearest_neighbours(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op6_hilbert_shards")
def op6_hilbert_shards(spark, d):
    return hilbert_shards.assign_shards(table(spark, d, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@query("op7_dom_model")
def op7_dom_model(spark, d):
    return dom_model.extract_pages(table(spark, d, "pages"), table(spark, d, "documents"))


@query("op11_zstd_language")
def op11_zstd_language(spark, d):
    return zstd_language.identify(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@query("op12_filter_diagrams")
def op12_filter_diagrams(spark, d):
    return filter_diagrams.filter_audit(table(spark, d, "documents"), table(spark, d, "labels"))


SQL["op12_filter_diagrams"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > firsts.first_id THEN 16 ELSE 0 END AS mask
  FROM w JOIN firsts ON w.t = firsts.t LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""


@query("op13_whitening")
def op13_whitening(spark, d):
    return whitening.whiten(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")
