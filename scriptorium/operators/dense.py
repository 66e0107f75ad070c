"""Dense retrieval inside an article: dot-product top-k, nesting, coverage,
and embedding hooks.

Brute-force top-k needs every (query, chunk) score of an article, but never
as rows: the chunks of an article are dealt into blocks of about ``block_rows``
vectors, and the article's queries are sent to each of its blocks (so a hot
article spreads over many tasks). Inside a task a block's vectors form a matrix
that is multiplied with batches of its queries, and every query keeps its best k
of the block. The final top-k per query merges ``blocks * k`` candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import DENSE_K, DENSE_KEEP

#: query vectors multiplied with a block at once
QUERY_ROWS = 1024
#: fixed value: tokens of a passage or query that encoders take
MAX_TOKENS = 512


def section_query_text(section, title):
    """``"{section} of {title}?"`` lower-cased."""
    return F.concat(F.lower(T._c(section)), F.lit(" of "), F.lower(T._c(title)), F.lit("?"))


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The whole vectors of an array column by their length: (row numbers,
    matrix of doubles). A null vector or one that holds a null is in none."""
    column = column.cast(pa.list_(pa.float64()))
    starts, flat = column.offsets.to_numpy(), column.values
    size = np.diff(starts)
    ok = ~column.is_null().to_numpy(zero_copy_only=False)
    holes = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
    ok &= holes[starts[1:]] == holes[starts[:-1]]
    flat = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    out = {}
    for length in np.unique(size[ok]).tolist():
        rows = np.flatnonzero(ok & (size == length))
        out[length] = rows, flat[starts[rows][:, None] + np.arange(length)]
    return out


def _best(score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, chunk) numbers of each query's k highest scores by (score rounded
    to 6 digits, ``place``); a missing score (NaN) comes last."""
    key = np.where(np.isnan(score), np.inf, -np.round(score, 6))
    q, n = key.shape
    k = min(k, n)
    bound = np.partition(key, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(key <= bound[:, None])  # ties at the bound included
    order = np.lexsort((place[col], key[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(q))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def _search_blocks(batches: Iterator[pa.RecordBatch], k: int, key: str, qid: str, cid: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and role (chunks before queries): the chunks of one
    block are kept, its queries are scored batch by batch. A task holds the
    vectors of one block at a time."""
    block, held, chunks = None, [], None
    for b in batches:
        number, role = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_no", "_role"))
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(role) != 0)) + 1
        cuts = np.unique(np.concatenate([[0], cuts, np.arange(0, b.num_rows, QUERY_ROWS), [b.num_rows]])).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = b.slice(lo, hi - lo)
            if number[lo] != block:
                block, held, chunks = number[lo], [], None
            if role[lo] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if chunks is None:
                held = pa.Table.from_batches(held).combine_chunks()
                ids = held.column(cid).chunk(0) if held.num_rows else pa.array([])
                chunks = ids, np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1], _matrices(held.column("_vec").chunk(0))
                held = True
            ids, place, by_length = chunks
            score = np.full((part.num_rows, len(ids)), np.nan)
            for length, (rows, vectors) in _matrices(part.column("_vec")).items():
                if length in by_length:
                    at, own = by_length[length]
                    score[np.ix_(rows, at)] = vectors @ own.T
            q, c = _best(score, place, k)
            value = score[q, c]
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(q)), part.column(qid).take(pa.array(q)), ids.take(pa.array(c)),
                 pa.array(value, mask=np.isnan(value))], names=[key, qid, cid, "score"])


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = DENSE_K,
               keep: int | None = DENSE_KEEP, *, key: str = "page_id",
               qid: str = "sec_pos", cid: str = "chunk_id",
               qvec: str = "query_embedding", cvec: str = "embedding",
               block_rows: int = 1024) -> DataFrame:
    """``(key, qid, rank, cid, score)``: the ``min(k, n)`` chunks of the
    query's article with the largest dot product (score rounded to 6 digits
    desc, chunk id asc), then cut to the first ``keep``. A pair without a product
    (a null vector, one that holds a null, two lengths) ranks last with a
    null score; articles without chunks and null keys give no rows."""
    limit = min(k, keep) if keep else k
    spark = chunks.sparkSession
    per_page = chunks.groupBy(key).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block_rows))).cast("bigint").alias("_nb"))
    ids = {c: dict(d.dtypes)[c] for d, c in ((queries, key), (queries, qid), (chunks, cid))}
    dealt = (chunks.join(per_page, key).withColumn("_blk", F.pmod(F.xxhash64(cid), F.col("_nb")))
             .select(key, "_blk", F.lit(0).alias("_role"), F.lit(None).cast(ids[qid]).alias(qid), cid, F.col(cvec).alias("_vec")))
    asked = (queries.join(per_page, key)
             .withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)))
             .select(key, "_blk", F.lit(1).alias("_role"), qid, F.lit(None).cast(ids[cid]).alias(cid), F.col(qvec).alias("_vec")))
    # rows of a block stand together; its number tells where the next one begins
    rows = dealt.unionByName(asked).withColumn("_no", F.xxhash64(key, "_blk"))
    rows = (rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key, "_blk")
            .sortWithinPartitions(key, "_blk", "_role").select(key, "_no", "_role", qid, cid, "_vec"))
    found = rows.mapInArrow(lambda it: _search_blocks(it, limit, key, qid, cid),
                            f"{key} {ids[key]}, {qid} {ids[qid]}, {cid} {ids[cid]}, score double")
    found = found.withColumn("score", T.round6("score"))
    w = Window.partitionBy(key, qid).orderBy(F.desc_nulls_last("score"), cid)
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .select(key, qid, F.col("rank").cast("bigint").alias("rank"), cid, "score"))


def nest_results(ranked: DataFrame, *, key: str = "page_id", qid: str = "sec_pos",
                 section: str = "section", cid: str = "chunk_id") -> DataFrame:
    """Per article: the section list and, in the same order, each section's
    ranked chunk ids (``sections ARRAY<STRING>``, ``top_chunks
    ARRAY<ARRAY<BIGINT>>``). The group is one article's outline."""
    per_sec = ranked.groupBy(key, qid, section).agg(
        F.sort_array(F.collect_list(F.struct("rank", cid))).alias("_r"))
    per_sec = per_sec.select(key, qid, section, F.transform("_r", lambda x: x[cid]).alias("_ids"))
    nested = per_sec.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(qid, section, "_ids"))).alias("_s"))
    return nested.select(key, F.transform("_s", lambda x: x[section]).alias("sections"),
                         F.transform("_s", lambda x: x["_ids"]).alias("top_chunks"))


def chunk_coverage(ranked: DataFrame, *, key: str = "page_id", cid: str = "chunk_id") -> DataFrame:
    """Distinct chunks used per article, and their mean over articles."""
    per = ranked.groupBy(key).agg(F.countDistinct(cid).alias("n_distinct"))
    return per.agg(F.count(F.lit(1)).alias("n_articles"),
                   F.sum("n_distinct").cast("bigint").alias("total_distinct"),
                   T.round6(F.avg("n_distinct")).alias("mean_distinct"))


def eligible_articles(chunks: DataFrame, sections: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Articles that have both stored embeddings and an outline."""
    c = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    s = sections.groupBy(key).agg(F.count(F.lit(1)).alias("n_sections"))
    return c.join(s, key)


def lookup_chunk_text(ranked: DataFrame, texts: DataFrame, *, on: list[str],
                      text: str = "content") -> DataFrame:
    """Chunk ids to chunk texts (an equi-join on the chunk key)."""
    return ranked.join(texts.select(*on, text), on)


def hash_embed(df: DataFrame, col: str = "content", dim: int = 64,
               out: str = "embedding") -> DataFrame:
    """Built-in encoder: feature hashing of tokens into ``dim`` buckets (the
    last 32 bits of a token's md5), counts L2-normalised. Map-only: tokens are
    cut and hashed by Spark, an Arrow batch of buckets is counted by numpy."""
    bucket = F.transform(T.tokens(F.coalesce(F.col(col), F.lit(""))),
                         lambda t: (F.conv(F.substr(F.md5(t), F.lit(25)), 16, 10).cast("bigint") % dim).cast("int"))

    @F.pandas_udf("array<float>")
    def count(buckets: pd.Series) -> pd.Series:
        n = buckets.map(len).to_numpy()
        row = np.repeat(np.arange(len(buckets)), n)
        flat = np.concatenate(buckets.tolist()) if n.sum() else np.zeros(0, int)
        counts = np.bincount(row * dim + flat, minlength=len(buckets) * dim).reshape(-1, dim).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return pd.Series(list((counts / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return df.withColumn(out, count(bucket))


def first_tokens(col, n: int):
    """The text up to the end of its ``n``-th word-and-punctuation token."""
    return F.regexp_extract(T._c(col), f"^(?:[{T.WS_CLASS}]*+(?:{T.TOKEN})){{0,{n}}}+", 0)


def embed_passages(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], *,
                   col: str = "content", out: str = "embedding", batch: int = 512,
                   max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """Hook for a user encoder: ``encoder(list_of_texts) -> (n, dim) array``,
    called on Arrow batches of at most ``batch`` rows inside the tasks. Encoders
    take passages (and section queries) of so many tokens: a longer text ends after
    its first ``max_tokens`` word-and-punctuation tokens (None: whole texts; chunks of
    the usual size are shorter)."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

    def run(it):
        for pdf in it:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch].copy()
                vecs = np.asarray(encoder(part["_passage"].tolist()), dtype=np.float32)
                part[out] = list(vecs)
                yield part.drop(columns="_passage")

    passage = F.coalesce(F.col(col), F.lit(""))
    return df.withColumn("_passage", passage if max_tokens is None else first_tokens(passage, max_tokens)).mapInPandas(run, schema)
