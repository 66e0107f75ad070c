"""Writers: datasets clustered by article key (never one file per article),
JSON lines, the over-budget reject side output, and tables in buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


# A7 / A9 --------------------------------------------------------------------
def write_dataset(df: DataFrame, path: str, key: str = "page_id", mode: str = "overwrite",
                  partitions: int | None = None) -> None:
    """Parquet, rows of an article together: rebalanced on ``key`` into files of
    the session's advisory partition size (a hot article is split over several
    files, small ones share one) and sorted within files. With ``partitions``
    the files are that many ranges of ``key`` instead, tied rows by a hash of
    the columns that can be hashed. No directory per article (there are too
    many)."""
    if partitions:
        plain = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        dealt = df.repartitionByRange(partitions, F.col(key), F.xxhash64(*plain))
    else:
        dealt = df.hint("rebalance", F.col(key))
    dealt.sortWithinPartitions(key).write.mode(mode).parquet(path)


# A8 -------------------------------------------------------------------------
def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line (one section per line)."""
    df.write.mode(mode).json(path)


# A10 ------------------------------------------------------------------------
def write_with_rejects(flagged: DataFrame, path: str, reject_path: str, flag: str = "accepted",
                       key: str = "page_id") -> dict[str, int]:
    """One pass over ``flagged``: accepted rows below ``path/<flag>=true``, rejected ones
    whole below ``path/<flag>=false`` (a null flag rejects), and the keys of rejected rows
    as JSON lines in ``reject_path`` (the fail log, read from the rejected rows only). The
    numbers of both kinds, counted on the way, are returned."""
    seen = Observation()
    ok = F.coalesce(F.col(flag), F.lit(False))
    rows = flagged.withColumn(flag, ok).observe(
        seen, F.count(F.when(F.col(flag), 1)).alias("accepted"), F.count(F.when(~F.col(flag), 1)).alias("rejected"))
    (rows.hint("rebalance", F.col(flag), F.col(key)).sortWithinPartitions(flag, key)
     .write.mode("overwrite").partitionBy(flag).parquet(path))
    rejected = flagged.sparkSession.read.schema(rows.schema).parquet(path).filter(~F.col(flag))
    rejected.select(key).write.mode("overwrite").json(reject_path)
    return {k: int(v) for k, v in seen.get.items()}


# A7 / A9 --------------------------------------------------------------------
def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int = 64) -> None:
    """A table of the session's catalog with its files below ``path``, in ``buckets`` by
    ``keys`` and sorted in them: joins and groupings by ``keys`` of such tables with
    equal buckets (chunks, vectors and texts by article and chunk) move nothing of the
    stored side. Keys that name a row, not an article alone, spread an article that
    holds much of a table over all buckets."""
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(table))
