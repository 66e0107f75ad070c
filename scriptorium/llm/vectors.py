"""Helpers for vector search: reading vectors, streaming groups, top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None, allow_zero: bool = True) -> DataFrame:
    """``id, vec`` (doubles): rows whose vector is not null, holds only finite
    numbers and, where ``dim`` is given, has that length."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = out.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    if dim is not None:
        out = out.filter(F.size(v) == dim)
    return out if allow_zero else out.filter(F.exists(v, lambda x: x != 0))


def common_dim(df: DataFrame) -> int:
    """The most frequent vector length (the smallest of several), 0 if none."""
    r = df.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return r["d"] if r else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def against_groups(batches: Iterator[pa.RecordBatch], dim: int,
                   search: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], pa.RecordBatch | None]):
    """Rows ordered by (grp, role): of every group the candidates (role 0) are
    kept, and its queries (role 1) are handed, batch by batch, to
    ``search(ids, vectors, query vectors, query rows)``. A task holds one
    group's candidates; groups are cut to a bounded size before."""
    group, ids, vecs = None, [], []
    for b in batches:
        grp, role = b.column("grp").to_numpy(zero_copy_only=False), b.column("role").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(grp) != 0) | (np.diff(role) != 0)) + 1
        for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, b.num_rows).tolist()):
            if hi <= lo:
                continue
            part = b.slice(lo, hi - lo)
            if grp[lo] != group:
                group, ids, vecs = grp[lo], [], []
            if role[lo] == 0:
                ids.append(part.column("id").to_numpy(zero_copy_only=False))
                vecs.append(matrix(part.column("vec"), dim))
                continue
            if not ids:
                continue
            ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
            out = search(ids[0], vecs[0], matrix(part.column("vec"), dim), part)
            if out is not None and out.num_rows:
                yield out


def smallest(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest keys, ties to smaller ids, in order."""
    if len(key) > k:
        at = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
    else:
        at = np.arange(len(key))
    return at[np.lexsort((ids[at], key[at]))[:k]]


def best_per_query(found: DataFrame, k: int, falling: bool) -> DataFrame:
    """``query_id, rank, id, score``: the k best of ``found (query_id, id, score)``,
    which holds a pair once."""
    order = [F.desc("score") if falling else F.asc("score"), F.asc("id")]
    w = Window.partitionBy("query_id").orderBy(*order)
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
