"""Approximate nearest neighbours by learned partitions.

*Fitting*, on a bounded sample: the sample's neighbour graph (each vector's
``GRAPH_K`` nearest, brute force) is cut into parts of equal size. The cut
starts from balanced random-projection splits and is improved by moving
vectors to the part that holds most of their neighbours while that part has
room. A small classifier (one hidden layer, trained here) then learns the part
of a vector; its targets are the parts of the vector's neighbours, so it
predicts where the neighbours are and not only where the vector is.

*Index*: every row of the table goes to its most probable part. A part is dealt
into cells of about ``CELL`` rows by hash, so neither a crowded part nor many
equal vectors gather in one task.

*Search*: a query visits all cells of its most probable parts, as many as reach
``target_recall`` on sampled queries that took no part in fitting, and is
compared with every vector there (reranked by the exact distance). A query that
finds fewer than k vectors, though there are more, then visits all parts.

Defined cases: null ids, null or zero vectors, vectors with null or non-finite
components and vectors whose length is not the most frequent one take no part.
Rows that repeat an id are one candidate, the nearer one. Fewer than k
candidates: all of them. Equal distances: smaller ids first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import against_groups, best_per_query, clean_vectors, common_dim, matrix, smallest

SAMPLE = 8192
GRAPH_K = 10
CELL = 1024
HIDDEN = 128
TARGET_RECALL = 0.95


# ---------------------------------------------------------------- fitting
def nearest(base: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Positions of the k nearest base vectors of each query, brute force."""
    out = []
    norm = (base * base).sum(axis=1)
    for lo in range(0, len(q), 512):
        d = norm[None, :] - 2 * q[lo:lo + 512] @ base.T
        if skip_self:
            d[np.arange(d.shape[0]), np.arange(lo, lo + d.shape[0])] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k])
    return np.vstack(out) if out else np.zeros((0, k), int)


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator,
                 room: float = 1.1, rounds: int = 8) -> np.ndarray:
    """Parts of the graph's vectors, none larger than ``room`` times the mean."""
    label = np.zeros(len(x), dtype=np.int64)
    for bit in range(int(np.log2(parts))):
        for p in range(1 << bit):
            at = np.flatnonzero(label == p)
            # split at the median along the main direction of the part
            y = x[at] - x[at].mean(axis=0) if len(at) else x[at]
            v = rng.normal(size=x.shape[1])
            for _ in range(5):
                v = y.T @ (y @ v)
                v /= max(np.linalg.norm(v), 1e-300)
            order = np.argsort(y @ v, kind="stable")
            label[at[order[len(at) // 2:]]] = p + (1 << bit)
    cap = int(np.ceil(len(x) / parts * room))
    size = np.bincount(label, minlength=parts)
    both = np.concatenate([np.column_stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]),
                           np.column_stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), dtype=np.int32)
        np.add.at(votes, (both[:, 0], label[both[:, 1]]), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < cap:
                size[label[i]] -= 1
                size[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = HIDDEN,
                 epochs: int = 30, rate: float = 2e-3) -> list[np.ndarray]:
    """Weights of a classifier with one hidden layer (Adam, cross-entropy);
    ``target`` holds a distribution over the parts for each vector."""
    dim, parts = x.shape[1], target.shape[1]
    scale = np.array([1.0 / max(x.std(), 1e-12)])
    w = [rng.normal(size=(dim, hidden)) / np.sqrt(dim), np.zeros(hidden), rng.normal(size=(hidden, parts)) / np.sqrt(hidden),
         np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            b = order[lo:lo + 128]
            xb = x[b] * scale
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[b]) / len(b)
            gh = (g @ w[2].T) * (h > 0)
            grads = [xb.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
            step += 1
            for a, (wa, ga) in enumerate(zip(w, grads)):
                m[a] = 0.9 * m[a] + 0.1 * ga
                v[a] = 0.999 * v[a] + 0.001 * ga * ga
                wa -= rate * (m[a] / (1 - 0.9 ** step)) / (np.sqrt(v[a] / (1 - 0.999 ** step)) + 1e-8)
    return [scale, *w]


def route(model: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores of the parts, larger is more probable."""
    scale, w0, b0, w1, b1 = model
    return np.maximum((x * scale) @ w0 + b0, 0) @ w1 + b1


def fit(sample: np.ndarray, parts: int, k: int, target_recall: float, seed: int = 7) -> tuple[list[np.ndarray], int]:
    """(router, number of parts to visit). An eighth of the sample is kept as
    queries; the parts to visit are the fewest that find ``target_recall`` of
    their k nearest in the rest."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))]
    n_test = min(1024, len(x) // 8)
    test, x = x[:n_test], x[n_test:]
    if parts < 2 or len(x) <= GRAPH_K or not n_test:
        return [np.ones(1), np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts)], parts
    graph = nearest(x, x, GRAPH_K, skip_self=True)
    label = balanced_cut(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += GRAPH_K / 2
    router = train_router(x, target / target.sum(axis=1, keepdims=True), rng)
    # where the index would put the neighbours of the test queries
    home = route(router, x).argmax(axis=1)
    want = home[nearest(x, test, k, skip_self=False)]
    order = np.argsort(-route(router, test), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")  # rank of each part for each query
    depth = np.take_along_axis(place, want, axis=1)
    for visits in range(1, parts + 1):
        if (depth < visits).mean() >= target_recall:
            return router, visits
    return router, parts


# ---------------------------------------------------------------- the operator
def nearest_neighbours(df: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id",
                       vec_col: str = "embedding", sample_rows: int = SAMPLE, parts: int | None = None,
                       cell: int = CELL, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``query_id, rank, id, score`` (Euclidean distance): for every row whose id
    is divisible by ``query_every``, its k nearest found. The router is fitted
    on about ``sample_rows`` vectors; ``parts`` (a power of 2) grows with the
    square root of the rows, up to one part per 128 sampled vectors."""
    spark = df.sparkSession
    raw = clean_vectors(df, id_col, vec_col, allow_zero=False)
    dim = common_dim(raw)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    rows = staged(raw.filter(F.size("vec") == dim).select(F.col("id").cast("bigint").alias("id"), "vec")
                  .distinct(), "ann-vectors")  # equal rows are one candidate and one query
    total, n_ids = rows.agg(F.count("*"), F.countDistinct("id")).first()
    scale = 1_000_000_000
    drawn = F.pmod(F.xxhash64("vec"), F.lit(scale)) < int(scale * min(1.0, sample_rows / total))
    sample = rows.filter(drawn).select("vec").dropDuplicates(["vec"]).orderBy(F.xxhash64("vec")).limit(2 * sample_rows)
    sample = sample.toPandas()["vec"].to_numpy()
    sample = np.vstack(sample) if len(sample) else np.zeros((0, dim))
    if parts is None:
        room = max(len(sample) // 128, 1)
        parts = 1 << int(np.log2(min(max(total ** 0.5 / 8, 1), room)))
    router, visits = fit(sample, parts, k, target_recall)
    shared = spark.sparkContext.broadcast(router)

    def assign(batches):
        for b in batches:
            part = route(shared.value, matrix(b.column("vec"), dim)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], names=["id", "vec", "part"])

    indexed = staged(rows.mapInArrow(assign, "id long, vec array<double>, part int"), "ann-index")
    cells = indexed.groupBy("part").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells"))
    grp = (F.col("part").cast("bigint") * (1 << 32)) + F.col("cell")
    stored = (indexed.join(cells, "part").withColumn("cell", F.pmod(F.xxhash64("id", "vec"), F.col("cells")))
              .select(grp.alias("grp"), F.lit(0).alias("role"), "id", "vec"))

    def probe(batches, visits):
        for b in batches:
            order = np.argsort(-route(shared.value, matrix(b.column("vec"), dim)), axis=1, kind="stable")[:, :visits]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * order.shape[1], pa.int32()),
                                             pa.array(order.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["id", "vec", "probes"])

    def search(ids, base, q, batch):
        q_ids, out = batch.column("id").to_numpy(zero_copy_only=False), []
        order = np.argsort(ids, kind="stable")
        ids, base = ids[order], base[order]
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        ids = ids[starts]
        for j in range(len(q)):
            # the nearer vector of each id, before the k nearest are taken
            d = np.minimum.reduceat(np.sqrt(((base - q[j]) ** 2).sum(axis=1)), starts)
            d[ids == q_ids[j]] = np.inf
            at = smallest(d, ids, k)
            at = at[np.isfinite(d[at])]
            out.append((np.full(len(at), q_ids[j]), ids[at], d[at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "id", "score"])

    def run(queries, visits):
        probes = (queries.mapInArrow(lambda it: probe(it, visits), "id long, vec array<double>, probes array<int>")
                  .select("id", "vec", F.explode("probes").alias("part")).join(cells, "part")
                  .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
                  .select(grp.alias("grp"), F.lit(1).alias("role"), "id", "vec"))
        found = (stored.unionByName(probes).repartition("grp").sortWithinPartitions("grp", "role")
                 .mapInArrow(lambda it: against_groups(it, dim, search), "query_id long, id long, score double"))
        return best_per_query(found.groupBy("query_id", "id").agg(F.min("score").alias("score")), k, falling=False)

    queries = rows.filter(F.pmod("id", F.lit(query_every)) == 0).select("id", "vec")
    best = staged(run(queries, visits), "ann-found")
    if visits < parts:
        enough = best.filter(F.col("rank") == min(k, n_ids - 1)).select(F.col("query_id").alias("id"))
        short = staged(queries.join(enough, "id", "left_anti"), "ann-short")
        if short.head(1):
            again = run(short, parts)
            best = best.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(again)
    return best
