"""Mixing sources to target weights along a time-varying curriculum.

Targets: every source has a weight; the sources share a budget of words (all
words of the input) in proportion to their weights, no source gets more than
``MAX_REPEATS`` times its own words, and what a capped source leaves is shared
again by weight. (All rounds of resharing come to one level L with
``target = min(cap, L * weight)``, found by prefix sums over the sources.)

Documents: a source's documents stand in an order drawn by hash. The order is
passed up to ``MAX_REPEATS`` times; a document is taken in a pass if all its
words lie before the target. The words that are then missing are covered as
nearly as possible by one more document of the last pass.

Curriculum: a source's share of training changes with time. Its weight
schedule, a piecewise linear function on [0, 1], is integrated into its
cumulative demand of words, and a document whose words begin at offset c of
the source is trained at the time when the demand reaches c. The schedule
is inverted segment by segment in closed form. The mix is the taken documents
range-sorted by that position.

Offsets are prefix sums in two levels over a range partitioning of
``(source, hash)``, so a source with a third of all rows is spread over many
tasks; only (id, source, size, hash) is shuffled for them.

Defined cases: a null text has size 0; documents of size 0 are never placed;
a null source is a source of its own, last in order; a source without words
has target 0. Rows that agree in id and text are separate documents with
neighbouring offsets; those that differ in another column (source, say) each
come as often as the plan takes them. Very long texts are only counted. Other
columns, whatever their names, are kept. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Schedules of the sources in order, repeating: (time, weight) knots. The
#: first kind fades out, the second is steady, the third fades in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
WORDS = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_no, source_size, target`` from ``sizes (source, size)``;
    one row per source, the windows run over the sources only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("w", w)
    per = per.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("w").over(after))
    # the level of the first source that is not capped holds for all later ones
    open_ = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(everything)
    per = per.withColumn("open", open_)
    return per.select("source", "source_no", "source_size",
                      F.least("cap", F.coalesce(F.col("open.level") * F.col("w"), F.col("cap"))).alias("target"))


def when_demanded(share: Column, source_no: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` of its
    total: the inverse of the integrated schedule."""
    out = None
    for kind, knots in enumerate(schedules):
        area = sum((b - a) * (f + g) / 2 for (a, f), (b, g) in zip(knots, knots[1:]))
        at, expr = 0.0, None
        for (a, f), (b, g) in zip(knots, knots[1:]):
            f, g = f / area, g / area
            rest, slope = F.greatest(share - at, F.lit(0.0)), (g - f) / (b - a)
            root = F.sqrt(F.greatest(F.lit(f * f) + 2 * slope * rest, F.lit(0.0)))
            time = F.least(F.lit(a) + F.when(root + f > 0, 2 * rest / (root + f)).otherwise(0.0), F.lit(b))
            at += (b - a) * (f + g) / 2
            expr = F.when(share <= at, time) if expr is None else expr.when(share <= at, time)
        expr = expr.otherwise(F.lit(float(knots[-1][0])))
        hit = F.pmod(source_no, F.lit(len(schedules))) == kind
        out = F.when(hit, expr) if out is None else out.when(hit, expr)
    return out


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row (maps as JSON)."""
    return F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, max_repeats: int = MAX_REPEATS, partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id, hash, row`` (the whole row's hash), ``size,
    source_no, source_size, target, start`` (offset in the source) and ``passes``
    (times taken)."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                              F.xxhash64(F.col(id_col), text).alias("hash"), row_hash(docs).alias("row"),
                              F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("size")), "mix-sizes")
    targets = staged(source_targets(rows, weights, max_repeats), "mix-targets")
    numbered = rows.join(targets.select("source", "source_no"), rows["source"].eqNullSafe(targets["source"]))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(numbered.select("id", "hash", "row", "size", "source_no")
                    .repartitionByRange(n, "source_no", "hash", "id", "row")
                    .withColumn("block", F.spark_partition_id()), "mix-blocks")
    inside = Window.partitionBy("source_no", "block").orderBy("hash", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    across = Window.partitionBy("source_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = (ranged.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
            .withColumn("base", F.coalesce(F.sum("words").over(across), F.lit(0))).drop("words"))
    placed = (local.join(base, ["source_no", "block"]).join(targets.drop("source"), "source_no")
              .withColumn("start", F.col("local") + F.col("base")))
    # whole passes before the target: start + k * source_size + size <= target
    fit = F.floor(F.try_divide(F.col("target") - F.col("start") - F.col("size"), F.col("source_size"))) + 1
    passes = F.when(F.col("size") > 0, F.greatest(F.least(fit, F.lit(max_repeats)), F.lit(0))).otherwise(0)
    placed = staged(placed.select("id", "hash", "row", "size", "source_no", "source_size", "target", "start",
                                  passes.cast("int").alias("passes")), "mix-placed")
    # the rest of each source goes to the document of the last pass that fits it best
    rest = targets.join(placed.groupBy("source_no").agg(F.sum(F.col("size") * F.col("passes")).alias("words")), "source_no")
    rest = rest.select("source_no", (F.col("target") - F.col("words")).alias("rest"),
                       F.floor(F.try_divide(F.col("target"), F.col("source_size"))).alias("last"))
    gap = F.abs(F.col("size") - F.col("rest"))
    best = (placed.filter("size > 0").join(rest, "source_no")
            .filter((F.col("passes") == F.col("last")) & (F.col("passes") < max_repeats) & (gap < F.col("rest")))
            .groupBy("source_no").agg(F.min(F.struct(gap.alias("gap"), "start")).alias("m"))
            .select("source_no", F.col("m.start").alias("start"), F.lit(1).alias("extra")))
    return (placed.join(best, ["source_no", "start"], "left")
            .withColumn("extra", F.when(F.col("size") > 0, F.coalesce("extra", F.lit(0))).otherwise(0))
            .withColumn("passes", F.col("passes") + F.col("extra")))


def pass_position(pass_no: Column, schedules=SCHEDULES) -> Column:
    """The training position of a planned document's pass (from 0)."""
    share = F.try_divide(F.col("start") + pass_no * F.col("source_size"), F.col("target"))
    return when_demanded(F.least(share, F.lit(1.0)), F.col("source_no"), schedules)


def positions(plan: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """One row per taken document and pass, with its training position. The
    document that fills up a source comes at the end of the source's demand."""
    each = plan.filter("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    return each.withColumn("position", pass_position(F.col("pass"), schedules))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   weights=WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by
    training position."""
    each = positions(plan_mix(docs, id_col, text_col, source_col, weights, max_repeats), schedules)
    each = each.select(F.col("row").alias("__row"), F.col("hash").alias("__hash"), F.col("pass").alias("__pass"),
                       F.col("position").alias("__position"))
    # rows that agree in all columns stand for each other
    rows = docs.withColumn("__own", F.xxhash64(F.col(id_col), text_or_empty(text_col))).withColumn("__all", row_hash(docs))
    rows = rows.dropDuplicates(["__own", "__all"])
    placed = rows.join(each.hint("shuffle_hash"), (F.col("__own") == F.col("__hash")) & (F.col("__all") == F.col("__row")))
    return (placed.repartitionByRange("__position", "__hash", "__pass").sortWithinPartitions("__position", "__hash", "__pass")
            .select(*[rows[f"`{c}`"] for c in docs.columns]))
