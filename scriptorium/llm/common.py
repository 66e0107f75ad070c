"""Helpers shared by the operators: staging, 64-bit mixing, text slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Text handled at once inside a Python task, in characters (a longer text is
#: a slice of its own).
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; it is deleted when the
    application ends."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once,
    lineage cut, independent of the executors that made it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(col: str):
    """16 bytes that stand for a text: equal texts, equal keys."""
    return F.unhex(F.md5(text_or_empty(col)))


def crc32_fold(col: str, n: int = 5):
    """``crc32`` of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


# ---------------------------------------------------------------- 64-bit mixing
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit integers (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit_interval(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in [0, 1) from mixed 64-bit integers."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def distinct_codes(values: list[str]) -> tuple[np.ndarray, list[str]]:
    """(index of each string into the distinct strings, distinct strings in
    order of appearance)."""
    if "\0" in "".join(values):  # pandas compares strings up to the first NUL
        distinct = list(dict.fromkeys(values))
        index = dict(zip(distinct, range(len(distinct))))
        return np.fromiter(map(index.__getitem__, values), np.int64, len(values)), distinct
    codes, distinct = pd.factorize(np.array(values, dtype=object))
    return codes.astype(np.int64), distinct.tolist()


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of a list of strings."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes, distinct = distinct_codes(words)
    return mix64(pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False))[codes]


# ---------------------------------------------------------------- Arrow batches
def slices(batches: Iterator[pa.RecordBatch], text: str,
           chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``chars`` characters of ``text``, so
    a task's memory follows the longest text and not the batch's row count."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // chars
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def text_runs(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of about ``chars`` characters, for functions that get a
    whole Arrow batch as a column."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    return [t or "" for t in batch.column(text).to_pylist()]
