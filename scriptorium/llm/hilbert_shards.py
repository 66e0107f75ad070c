"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to ``BITS`` bits each, the cell is turned
into its index on the Hilbert curve, rows are sorted by that index, and the
order is cut into runs, one per shard. Cells that are near on the curve are
near in every dimension, so a shard covers a small box of the metadata and
files can be pruned by the minimum and maximum of any dimension.

Laws: ``rows`` cuts runs whose row counts differ by at most one; ``bytes`` cuts
where the cumulative size passes equal shares.

All steps are built-in functions. Positions are two-level prefix sums over a
range partitioning of (index, text hash, id): a crowded cell is spread over
many tasks, and only narrow rows are shuffled. Rows with equal metadata and
equal text are neighbours.

Defined cases: null numbers count as 0, null categories are a category of
their own, a null text has size ``OVERHEAD`` and CRC 0. Rows that repeat are
separate rows. Very long texts count by their size like others. Columns of other
names play no part. With fewer rows than shards, some shards stay empty; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: two cells to a doubling, so 7 bits hold every 63-bit number
BITS = 7
SHARDS = 40
OVERHEAD = 16


def category_cell(col: Column, bits: int = BITS) -> Column:
    """A category's cell: a hash, so no list of categories is needed; cell 0 is null's."""
    return F.when(col.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(col), F.lit((1 << bits) - 1)) + 1).cast("bigint")


def number_cell(col: Column, bits: int = BITS, per_doubling: int = 2) -> Column:
    """A number's cell: ``per_doubling`` cells for each power of two."""
    x = F.greatest(F.coalesce(col.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(F.log2(x + 1) * per_doubling), F.lit((1 << bits) - 1)).cast("bigint")


def hilbert_index(cell: Column, dims: int, bits: int = BITS) -> Column:
    """Index on the Hilbert curve of ``cell``, an array of ``dims`` numbers of
    ``bits`` bits. Coordinates are rotated bit plane by bit plane into the
    curve's orientation, Gray coded and interleaved."""
    def literal(values):
        return F.array(*[F.lit(v) for v in values])

    def xor(a, b):
        return a.bitwiseXOR(b)

    planes = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).cast("bigint").alias("q"), F.lit(i).alias("i")) for q in planes for i in range(dims)])

    def rotate(x, s):
        q, i = s["q"], s["i"]
        first, own = x[0], F.element_at(x, i + 1)
        low = q - 1
        is_set = own.bitwiseAND(q) != 0
        swap = xor(first, own).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(j == 0, F.when(is_set, xor(first, low)).otherwise(xor(first, swap)))
                           .when(j == i, F.when(is_set, v).otherwise(xor(v, swap))).otherwise(v))

    turned = F.aggregate(steps, cell, rotate) if planes else cell
    gray = turned
    if dims > 1:
        gray = F.aggregate(literal(range(1, dims)), turned,
                           lambda x, i: F.transform(x, lambda v, j: F.when(j == i, xor(v, F.element_at(x, i))).otherwise(v)))
    state = F.struct(gray.alias("x"), F.lit(0).cast("bigint").alias("t"))
    if planes:
        state = F.aggregate(F.array(*[F.lit(q).cast("bigint") for q in planes]), state, lambda a, q: F.struct(
            a["x"].alias("x"),
            F.when(F.element_at(a["x"], -1).bitwiseAND(q) != 0, xor(a["t"], q - 1)).otherwise(a["t"]).alias("t")))
    done = F.aggregate(F.array(state), F.array().cast("array<bigint>"),
                       lambda _, a: F.transform(a["x"], lambda v: xor(v, a["t"])))
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
    start = F.struct(done.alias("x"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(order, start, lambda a, s: F.struct(
        a["x"].alias("x"),
        (a["n"] * 2 + F.floor(F.element_at(a["x"], s["i"] + 1) / F.pow(F.lit(2.0), s["b"])).cast("bigint").bitwiseAND(1)).alias("n")),
        lambda a: a["n"])


def assign_shards(docs: DataFrame, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text",
                  categories: tuple[str, ...] = ("source", "lang"), bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: ``id, size, text_crc32, law, shard, slot,
    hilbert, cell``. The dimensions are the ``categories`` and the size."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    size = (F.octet_length(text) + OVERHEAD).cast("bigint")
    cell = F.array(*[category_cell(F.col(c), bits) for c in categories], number_cell(size - OVERHEAD, bits))
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("hash"), cell.alias("cell"))
    rows = rows.withColumn("hilbert", hilbert_index(F.col("cell"), len(categories) + 1, bits))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["hilbert", "hash", "id"]
    ranged = staged(rows.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()), "hilbert-blocks")
    weight = F.lit(1).cast("bigint") if law == "rows" else F.col("size")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    base = (ranged.groupBy("block").agg(F.sum(weight).alias("w"))
            .select("block", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base")))
    total = ranged.agg(F.sum(weight)).first()[0] or 0
    inside = Window.partitionBy("block").orderBy(*order)
    start = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("at", start).join(base, "block").withColumn("at", F.col("at") + F.col("base"))
    if law == "rows":
        shard = F.expr(f"(at * {shards}) div {max(total, 1)}")
        first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # position of the shard's first row
        out = placed.withColumn("shard", shard).withColumn("slot", F.col("at") - first)
    else:  # by the middle of a row's bytes; slots by a second prefix count
        placed = placed.withColumn("shard", F.least(F.expr(f"((2 * at + size) * {shards}) div {max(2 * total, 1)}"),
                                                    F.lit(shards - 1)))
        count = (placed.groupBy("shard", "block").agg(F.count("*").alias("c"))
                 .withColumn("skip", F.coalesce(F.sum("c").over(
                     Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c"))
        own = F.row_number().over(Window.partitionBy("block", "shard").orderBy(*order)) - 1
        out = placed.withColumn("own", own).join(count, ["shard", "block"]).withColumn("slot", F.col("own") + F.col("skip"))
    return out.select("id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("bigint").alias("slot"), "hilbert", "cell")
