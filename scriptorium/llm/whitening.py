"""Embedding whitening by mixed-precision refinement of eigenvectors.

Vectors become integers, x = floor(scale * c). The fit list holds each distinct
x once. Its covariance is a Spark job: a pass for the number of vectors and the
sums, and a pass that centres every vector at the integers nearest to the means,
multiplies blocks of rows in float64 (short enough that every sum of products
is an exact integer) and adds the blocks up in two exact halves. The rest of the
centring, a rank-one term, is done on the driver in integers of any length, so
that the covariance is the exact one, rounded once. Only matrices of the
vectors' dimension reach the driver, whatever the number of rows.

Its eigenvectors start as those that LAPACK finds in float32 and are corrected
by the Ogita-Aishima iteration: with R = I - X'X and S = X'AX, matrix products
in extended precision (``numpy.longdouble``, 64 bits of mantissa on x86), every
vector gets the part of the others that it lacks, X <- X + XE with

    E_ij = (S_ij + l_j R_ij) / (l_j - l_i)    l_i = S_ii / (1 - R_ii),

so that the error squares itself in each round. Where two eigenvalues are closer
than the present error tells apart, E_ij = R_ij / 2, which only makes the
vectors orthogonal: these form a cluster, a sub-solve diagonalises A - m I
projected on the cluster's space (m being its mean; the shift leaves the
differences with full precision), the cluster is turned to the result, and the
iteration goes on with its eigenvalues told apart.

Every row is then projected in one map-only pass; the covariance of the whitened
fit list is measured by another one and its distance from the identity returned.

Defined cases: vectors that are null or empty, hold a null or a non-finite
entry, have another length than most (the smallest of the most frequent lengths
counts) or an entry whose x is no long take no part. A null id is kept.
Rows that repeat a vector count once for the fit and each get their result.
Only components of positive eigenvalue (more than ``RANK`` of the largest) are
given, so a table of one distinct vector gives no rows, like an empty one.
Components of equal eigenvalue are some orthogonal basis of their space. A
deviation beyond a long is null. Columns of other names play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import common_dim, matrix

SCALE = 256
#: an eigenvalue below this share of the largest is taken as zero
RANK = 1e-13
WIDE = np.longdouble
#: products of integers below this are exact in float64, and so is the sum of two to the 53rd of them by their size
EXACT_BITS = 53
HALF = 2.0 ** 26
LONG = 2.0 ** 62


# ---------------------------------------------------------------- eigenvectors
def _clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Runs of two or more neighbouring eigenvalues at most ``delta`` apart."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Newton-Schulz steps towards the nearest matrix with orthonormal columns."""
    for _ in range(6):
        r = np.eye(x.shape[1], dtype=WIDE) - x.T @ x
        x = x + x @ r / 2
        if np.abs(r).max() < 1e-17:
            break
    return x


def refined_eigenvectors(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix in extended
    precision, by falling eigenvalue."""
    a = np.asarray(a, dtype=WIDE)
    n = len(a)
    unit = np.eye(n, dtype=WIDE)
    size = np.abs(a).max()
    if not size > 0:
        return np.zeros(n, WIDE), unit
    a = a / size
    # float32 gives the first vectors
    x = _orthonormal(np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE))
    norm = float(np.abs(np.linalg.eigvalsh(a.astype(np.float64))).max())
    floor = 8 * norm * n * float(np.finfo(WIDE).eps)  # what extended precision cannot tell apart
    settled = False
    for _ in range(rounds):
        ax = a @ x
        r, s = unit - x.T @ x, x.T @ ax
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        error = float(np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        delta = 2 * max(error, floor)
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= delta
        e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, WIDE(1), gap))
        x = x + x @ e
        turned = False
        for run in _clusters(value.astype(np.float64), delta):
            # the sub-solve: eigenvectors of the shifted matrix in the cluster's space
            own = _orthonormal(x[:, run])
            mean = value[run].sum() / len(run)
            small = own.T @ (a @ own - mean * own)
            small = (small + small.T) / 2
            spread = np.abs(small).max()
            if spread <= floor:  # equal eigenvalues: any basis
                x[:, run] = own
                continue
            turn = _orthonormal(np.linalg.eigh((small / spread).astype(np.float64))[1].astype(WIDE))
            x[:, run] = own @ turn
            turned = True
        if settled:
            break
        settled = not turned and float(np.abs(e).max()) < 1e-10  # one more round squares that
    x = _orthonormal(x)
    value = np.einsum("ij,ij->j", x, a @ x) * size
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


# ---------------------------------------------------------------- distributed sums
def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """(``id, vec`` with vec the integers as doubles, their dimension)."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).alias("id"), F.transform(
        F.col(vec_col).cast("array<double>"), lambda c: F.floor(c * scale).cast("double")).alias("vec"),
        F.col(vec_col).cast("array<double>").alias("raw"))
    bad = F.exists("raw", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) >= 2.0 ** 63))
    rows = rows.filter(F.col("raw").isNotNull() & (F.size("raw") > 0) & ~bad).select("id", "vec")
    dim = common_dim(rows)
    return rows.filter(F.size(v) == dim), dim


def _halves(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers as a multiple of ``HALF`` and the rest: both sums stay exact."""
    high = np.floor(columns / HALF) * HALF
    return high, columns - high


def _rows(at: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """Rows (i, hi, lo) of one task's sums, hi and lo being arrays."""
    width = high.shape[1]
    ends = pa.array(np.arange(len(at) + 1) * width, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (high, low))], names=["i", "hi", "lo"])


def _totals(parts: DataFrame, width: int) -> dict[int, tuple[list[float], list[float]]]:
    """Element by element sums of the tasks' rows, by row number."""
    summed = parts.groupBy("i").agg(
        F.array(*[F.sum(F.col("hi")[j]) for j in range(width)]).alias("hi"),
        F.array(*[F.sum(F.col("lo")[j]) for j in range(width)]).alias("lo"))
    return {r["i"]: (r["hi"], r["lo"]) for r in summed.collect()}


def _exact(total: tuple[list[float], list[float]]) -> np.ndarray:
    return np.array([int(h) + int(low) for h, low in zip(*total)], dtype=object)


def sums(fit: DataFrame, dim: int) -> tuple[int, np.ndarray, float]:
    """(vectors, exact sums per dimension, largest absolute entry)."""
    def add(batches):
        high, low, n, most = np.zeros(dim), np.zeros(dim), 0, 0.0
        for b in batches:
            x = matrix(b.column("vec"), dim)
            if len(x):
                h, rest = _halves(x)
                high, low, n, most = high + h.sum(axis=0), low + rest.sum(axis=0), n + len(x), max(most, np.abs(x).max())
        yield _rows(np.zeros(1), np.append(high, [n, 0.0])[None], np.append(low, [0.0, 0.0])[None])
        yield _rows(np.ones(1), np.full((1, dim + 2), most), np.zeros((1, dim + 2)))

    parts = fit.mapInArrow(add, "i long, hi array<double>, lo array<double>")
    parts = staged(parts, "whiten-sums")
    most = parts.filter("i = 1").agg(F.max(F.col("hi")[0])).first()[0]
    total = _totals(parts.filter("i = 0"), dim + 2).get(0)
    if total is None:
        return 0, np.zeros(dim, dtype=object), 0.0
    whole = _exact(total)
    return int(whole[dim]), whole[:dim], most


def covariance(fit: DataFrame, dim: int) -> tuple[int, np.ndarray, list[int], np.ndarray]:
    """(n, sums, integer centre, covariance in extended precision) of the fit list."""
    n, total, most = sums(fit, dim)
    if not n:
        return 0, total, [0] * dim, np.zeros((dim, dim), WIDE)
    centre = [int((2 * s + n) // (2 * n)) for s in total]  # nearest integer to the mean
    middle = np.array(centre, dtype=np.float64)
    # centred entries stay below 2 * most: so many rows have exact sums of products
    rows = int(max(1, min(8192, 2.0 ** EXACT_BITS // max(1.0, (2 * most) ** 2))))

    def products(batches):
        high, low = np.zeros((dim, dim)), np.zeros((dim, dim))
        for b in batches:
            y = matrix(b.column("vec"), dim) - middle
            for lo in range(0, len(y), rows):
                h, rest = _halves(y[lo:lo + rows].T @ y[lo:lo + rows])
                high, low = high + h, low + rest
        yield _rows(np.arange(dim), high, low)

    found = _totals(fit.mapInArrow(products, "i long, hi array<double>, lo array<double>"), dim)
    gram = np.vstack([_exact(found[i]) for i in range(dim)])
    off = total - n * np.array(centre, dtype=object)  # sums about the centre
    whole = n * gram - np.outer(off, off)  # n^2 times the covariance, exactly
    top = whole.astype(np.float64)
    rest = (whole - np.array([[int(v) for v in r] for r in top], dtype=object)).astype(np.float64)
    return n, total, centre, (top.astype(WIDE) + rest.astype(WIDE)) / WIDE(n) / WIDE(n)


# ---------------------------------------------------------------- the operator
def deviations(y: np.ndarray, n: int, off: np.ndarray) -> list:
    """Sum over dimensions of (n y - off)^2, exactly; None beyond a long."""
    bound = (n * (np.abs(y).max() if y.size else 0.0) + max(map(abs, off.tolist()), default=0)) ** 2 * y.shape[1]
    if bound < LONG:
        d = n * y.astype(np.int64) - off.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    out = []
    for row in y:
        s = sum((n * int(v) - t) ** 2 for v, t in zip(row, off.tolist()))
        out.append(s if s < 2 ** 63 else None)
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for
    every row that takes part and every one of the first ``components``."""
    rows, dim = integer_vectors(df, id_col, vec_col, scale)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = staged(rows.select("vec").distinct(), "whiten-fit")
    n, total, centre, v = covariance(fit, dim)
    value, vector = refined_eigenvectors(v) if n else (np.zeros(0), np.zeros((0, 0)))
    k = int((value[:components] > max(value[0], 0) * RANK).sum()) if len(value) else 0
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    middle = np.array(centre, dtype=np.float64)
    off = total - n * np.array(centre, dtype=object)
    rest = np.array([float(WIDE(int(o)) / WIDE(n)) for o in off])  # mean minus centre
    axes = (vector[:, :k] / np.sqrt(value[:k])).astype(np.float64)
    explained = [float(e) for e in value[:k] / np.trace(v)]

    def measure(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = (matrix(b.column("vec"), dim) - middle - rest) @ axes
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield _rows(np.arange(k + 1), np.vstack([second, first]), np.zeros((k + 1, k)))

    got = _totals(fit.mapInArrow(measure, "i long, hi array<double>, lo array<double>"), k)
    mean = np.array(got[k][0]) / n
    white = np.array([got[i][0] for i in range(k)]) / n - np.outer(mean, mean)
    error = float(np.abs(white - np.eye(k)).max())

    def project(batches):
        for b in batches:
            y = matrix(b.column("vec"), dim) - middle
            w, dev = (y - rest) @ axes, deviations(y, n, off)
            each = np.repeat(np.arange(len(y)), k)
            m = len(each)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                 pa.array(np.full(m, n)), pa.array(dev, pa.int64()).take(pa.array(each)), pa.array(w.ravel()),
                 pa.array(np.tile(explained, len(y))), pa.array(np.full(m, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
