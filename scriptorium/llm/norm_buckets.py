"""Exact top-k inner products by norm buckets.

Vectors are grouped by length: a range partitioning on the norm, cut into
buckets of ``BUCKET`` vectors. A query's running threshold is its k-th best
product among the longest vectors (one bucket, so of bounded size). In a
bucket whose longest vector has length l, a product can only reach the
threshold t if the cosine is at least t / (|q| l), the *local threshold*:

* above 1 the query never visits the bucket;
* from ``COORD_FROM`` on, coordinate pruning: for the ``FOCUS`` largest
  coordinates f of the query, a candidate's normalised coordinate must lie
  where that cosine is possible at all, q_f p_f +- sqrt(1 - q_f^2) sqrt(1 - p_f^2);
* below, length pruning: only the vectors with |p| >= t / |q|.

What is left is verified by its exact integer product. Every bound is an upper
bound, so the result is exact, ties included. A query goes once to every
bucket it must visit; a task holds one bucket.

Defined cases: null ids, null vectors, vectors with null or non-finite
components, and vectors whose length is not the most frequent one take no
part. Zero vectors do (all their products are 0). Rows that repeat an id are
one candidate, the one with the larger product. Fewer than k candidates: all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import against_groups, best_per_query, clean_vectors, common_dim, matrix, smallest

BUCKET = 1024
COORD_FROM = 0.6
FOCUS = 3
SCALE = 256
LOWEST = -(2 ** 63)


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products ``[len(p), len(q)]``; beyond 64 bits they are cut
    to the nearest long."""
    if not p.size or not q.size:
        return np.zeros((len(p), len(q)), dtype=np.int64)
    if np.abs(p).max() * np.abs(q).max() * p.shape[1] < 2.0 ** 53:
        return np.rint(p @ q.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in p], dtype=object) @ np.array([[int(x) for x in r] for r in q], dtype=object).T
    return np.clip(exact, LOWEST, 2 ** 63 - 1).astype(np.int64)


def _feasible(p: np.ndarray, p_norm: np.ndarray, q: np.ndarray, cosine: float) -> np.ndarray:
    """Candidates that can reach ``cosine`` with the unit query q, judged by its
    largest coordinates."""
    keep = np.ones(len(p), dtype=bool)
    for f in np.argsort(-np.abs(q), kind="stable")[:FOCUS]:
        x = np.clip(p[:, f] / np.where(p_norm > 0, p_norm, 1), -1, 1)
        keep &= q[f] * x + np.sqrt(1 - min(q[f] ** 2, 1)) * np.sqrt(1 - x * x) >= cosine - 1e-9
    return keep


def candidates(p: np.ndarray, q: np.ndarray, limit: np.ndarray):
    """Per query that may reach its ``limit`` in the bucket: (its position, the
    candidates left by pruning, their products). ``p`` falls in length."""
    p_norm, q_norm = np.linalg.norm(p, axis=1), np.linalg.norm(q, axis=1)
    need = limit - 1e-6 * np.maximum(1.0, np.abs(limit))  # room for rounding in the bounds
    local = np.where(q_norm * p_norm[0] > 0, need / np.maximum(q_norm * p_norm[0], 1e-300), -1.0)
    by_length = np.flatnonzero(local < COORD_FROM)
    # one product for all queries with length pruning, up to the longest prefix any of them needs
    ends = [int(np.searchsorted(-p_norm, -need[j] / q_norm[j], side="right")) if need[j] > 0 and q_norm[j] > 0 else len(p)
            for j in by_length]
    top = products(p[:max(ends, default=0)], q[by_length])
    for col, (j, end) in enumerate(zip(by_length.tolist(), ends)):
        yield j, np.arange(end), top[:end, col]
    for j in np.flatnonzero((local >= COORD_FROM) & (local <= 1 + 1e-9)):
        at = np.flatnonzero(_feasible(p, p_norm, q[j] / q_norm[j], local[j]))
        yield j, at, products(p[at], q[j:j + 1])[:, 0]


def search_bucket(ids: np.ndarray, p: np.ndarray, q: np.ndarray, q_ids: np.ndarray, limit: np.ndarray, k: int):
    """(query ids, ids, products) of each query's k best in the bucket; None if
    no query can reach its limit."""
    order = np.lexsort((ids, -np.linalg.norm(p, axis=1)))
    ids, out = ids[order], []
    repeats = len(np.unique(ids)) < len(ids)
    for j, at, score in candidates(p[order], q, limit):
        own = ids[at]
        other = own != q_ids[j]
        own, score = own[other], score[other]
        if repeats:  # the better product of each id
            first = np.lexsort((-score, own))
            first = first[np.flatnonzero(np.diff(own[first], prepend=own[first[:1]] - 1))]
            own, score = own[first], score[first]
        exact = not len(score) or np.abs(score.astype(np.float64)).max() < 2.0 ** 53
        s = smallest(-score.astype(np.float64), own, k) if exact else np.lexsort((own, -score))[:k]
        out.append((np.full(len(s), q_ids[j]), own[s], score[s]))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def inner_product_topk(df: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id",
                       vec_col: str = "embedding", scale: int = SCALE, bucket: int = BUCKET) -> DataFrame:
    """``query_id, rank, id, score``: for every row whose id is divisible by
    ``query_every``, its k largest products of floor(scale * x) vectors."""
    spark = df.sparkSession
    raw = clean_vectors(df, id_col, vec_col)
    dim = common_dim(raw)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    whole = F.transform("vec", lambda x: F.floor(x * scale).cast("double"))
    ints = raw.filter(F.size("vec") == dim).select(F.col("id").cast("bigint").alias("id"), whole.alias("vec"))
    ints = ints.distinct()  # equal rows are one candidate and one query
    ints = ints.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def cut(batches):  # consecutive rows of one norm range to buckets
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            grp = (np.arange(seen, seen + b.num_rows) // bucket) + (part << 32)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(grp), *(b.column(c) for c in ("id", "vec", "norm"))],
                                             names=["grp", "id", "vec", "norm"])

    rows = staged(ints.repartitionByRange(n, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
                  .mapInArrow(cut, "grp long, id long, vec array<double>, norm double"), "norm-buckets")
    buckets = staged(rows.groupBy("grp").agg(F.max("norm").alias("longest"), F.count("*").alias("n")), "norm-lengths")
    # thresholds from the longest vectors: a bounded number, whatever the input
    seed = rows.orderBy(F.desc("norm"), "id").limit(bucket).select("id", "vec").toPandas()
    seed = seed.sort_values("id", kind="stable")
    seed_ids = seed["id"].to_numpy(np.int64)
    starts = np.flatnonzero(np.diff(seed_ids, prepend=seed_ids[:1] - 1))
    shared = spark.sparkContext.broadcast((seed_ids, np.vstack(seed["vec"].to_numpy())))
    queries = rows.filter(F.pmod("id", F.lit(query_every)) == 0).select("id", "vec", "norm")

    def thresholds(batches):
        ids, p = shared.value
        for b in batches:
            q, q_ids = matrix(b.column("vec"), dim), b.column("id").to_numpy(zero_copy_only=False)
            score = products(p, q).astype(np.float64)
            score[ids[:, None] == q_ids[None, :]] = -np.inf
            score = np.maximum.reduceat(score, starts, axis=0)  # the better product of each id
            limit = np.sort(score, axis=0)[-k] if len(score) >= k else np.full(len(q), -np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(limit)], names=["id", "vec", "norm", "lim"])

    queries = queries.mapInArrow(thresholds, "id long, vec array<double>, norm double, lim double")
    # a query block visits the buckets that are long enough for one of its queries
    lanes = n
    numbered = buckets.withColumn("lane", F.pmod(F.xxhash64("grp"), F.lit(lanes)))
    visits = (queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
              .join(numbered, "lane")
              .filter(F.col("norm") * F.col("longest") >= F.col("lim") - 1e-6 * F.greatest(F.lit(1.0), F.abs("lim")))
              .select("grp", F.lit(1).alias("role"), "id", "vec", "lim"))
    both = rows.select("grp", F.lit(0).alias("role"), "id", "vec", F.lit(0.0).alias("lim")).unionByName(visits)

    def search(ids, p, q, batch):
        found = search_bucket(ids, p, q, batch.column("id").to_numpy(zero_copy_only=False),
                      batch.column("lim").to_numpy(zero_copy_only=False), k)
        return None if found is None else pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "id", "score"])

    found = (both.repartition("grp").sortWithinPartitions("grp", "role")
             .mapInArrow(lambda it: against_groups(it, dim, search), "query_id long, id long, score long"))
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best_per_query(best, k, falling=True)
