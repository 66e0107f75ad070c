"""Skew-safe running offsets within a key.

A ``Window.partitionBy(key)`` running sum puts every row of a key into one
task; one hot key (a third of the rows) would then sort and spill in a single
task. Here the rows are range-partitioned on ``(key, order)``, which splits a
hot key across many partitions, and the sum is computed in two levels:

1. inside each (key, range partition) block, a running sum (bounded by the
   partition size);
2. per key, a running sum over block totals (one row per block: tiny).

The result is joined back on ``(key, block)``. Only the narrow
``(key, order, weight)`` projection is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def running_offset(df: DataFrame, key: str, order: str | list[str], weight: str,
                   out: str = "offset", partitions: int | None = None) -> DataFrame:
    """Rows ``(key, order, out)`` where ``out`` is the sum of ``weight`` over
    the rows of the same ``key`` with a smaller ``order`` (exclusive prefix
    sum). ``order`` may be several columns; ``(key, order)`` must be unique.
    NULL is a key like any other."""
    by = [order] if isinstance(order, str) else list(order)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(key, *by, F.col(weight).cast("bigint").alias("_w"))
    # Staged (narrow rows only) so that both branches below see one block
    # assignment: range bounds come from a sample of the input.
    ranged = stage(narrow.repartitionByRange(n, key, *by).withColumn("_blk", F.spark_partition_id()), "ranges")
    in_block = (Window.partitionBy(key, "_blk").orderBy(*by)
                .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumn(
        "_local", F.coalesce(F.sum("_w").over(in_block), F.lit(0)))
    totals = local.groupBy(key, "_blk").agg(F.sum("_w").alias("_tot"))
    across = (Window.partitionBy(key).orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select(
        F.col(key).alias("_key"), F.col("_blk").alias("_b"), F.coalesce(F.sum("_tot").over(across), F.lit(0)).alias("_base"))
    same = local[key].eqNullSafe(F.col("_key")) & (F.col("_blk") == F.col("_b"))
    return local.join(base, same).select(
        key, *by, (F.col("_local") + F.col("_base")).cast("bigint").alias(out))
