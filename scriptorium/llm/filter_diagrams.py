"""Audit of how filters interact, by count-weighted decision diagrams.

Every document is reduced to a mask of the filters it fails. Counts per (part,
mask), of all documents, good ones and toxic ones, are a Spark aggregation; a
part has at most 2^filters of them, whatever the input. From them a task builds
one decision diagram per part: a level tests one filter, its two edges lead to
the documents that pass and that fail, equal sub-diagrams are one node, and
every node carries the counts below it. No level is left out, so that a count
is the sum over one node's two edges.

Swapping two adjacent levels rebuilds only the nodes of these two levels. One
walk through all orders, each an adjacent swap from the one before
(Steinhaus-Johnson-Trotter), so visits every order of the filters with one
diagram. In an order, the path on which everything passes gives the steps: at
its k-th node the edge "fails" weighs what the k-th filter removes and the edge
"passes" what is kept.

The fifth condition of ``document_masks``, a text that a smaller id has too, is
found without gathering equal texts: per text the smallest id (combined before
the shuffle), joined back by text and id, so that copies are spread by their ids.

Defined cases: a null text is an empty one (no words; fails "few words" only,
and "copy" if a smaller id is empty too). A null part is the part named by the
empty string, together with parts that are empty strings. A null id is neither smaller nor
greater than another, so it never makes or is a copy, and has no labels; rows
that repeat an id are documents of their own, copies of each other only if a
smaller id has their text. A document with several labels counts as good or
toxic if one of them says so; null labels say nothing. Columns of other names
play no part. Empty input gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

SPACE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"
STEPS_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
                "good_lost long, toxic_lost long, shapley long")


# ---------------------------------------------------------------- masks
def text_conditions(text: Column, words: Column) -> list[Column]:
    """Failure conditions A to D of a text and its words."""
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * upper > 10 * F.length(text), text.rlike(SYMBOLS)]


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                   good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``part, mask, n, good, toxic``: counts of the documents by part and by
    the filters they fail (bit i for the i-th of ``FILTERS``)."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_conditions(F.col("text"), F.col("words")))]
    rows = staged(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), sum(bits[1:], bits[0]).alias("mask")), "audit-rows")
    known = rows.filter("id IS NOT NULL")
    apart = known.groupBy("id", "key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))  # a repeated row moves once
    first = known.groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.select(F.col(id_col).alias("id"), (F.col(good_col) == 1).cast("int").alias("good"),
                          (F.col(toxic_col) == 1).cast("int").alias("toxic"))
    marks = marks.filter("id IS NOT NULL AND (good = 1 OR toxic = 1)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    copies = 1 << (len(FILTERS) - 1)
    told = (apart.join(first, ["id", "key"], "left").join(marks, "id", "left")
            .select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(copies)).alias("mask"), "n",
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]))
    nameless = rows.filter("id IS NULL").select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return (told.unionByName(nameless).groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


# ---------------------------------------------------------------- diagrams
class Diagram:
    """Count-weighted decision diagram over ``order``, a list of filter numbers.
    A node is (passes, fails, weight); the last level's edges lead to leaves,
    which are weights. Weights are tuples of counts, added element by element."""

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        self.zero = tuple(0 for _ in next(iter(counts.values())))
        self.levels: list[dict[tuple, tuple]] = [{} for _ in range(filters)]
        self.root = self._grow(counts, 0)

    def _add(self, a, b):
        return tuple(x + y for x, y in zip(a, b))

    def weight(self, child) -> tuple[int, ...]:
        """The counts below an edge: a leaf is its own weight."""
        return child[2] if child and isinstance(child[0], tuple) else child

    def node(self, level: int, passes, fails) -> tuple:
        """The one node of this level with these edges."""
        table, key = self.levels[level], (passes, fails)
        if key not in table:
            table[key] = (passes, fails, self._add(self.weight(passes), self.weight(fails)))
        return table[key]

    def _grow(self, counts, level):
        if level == len(self.order):
            return counts.get(0, self.zero)
        bit = 1 << level
        halves = ({m & ~bit: c for m, c in counts.items() if bool(m & bit) == side} for side in (False, True))
        passes, fails = (self._grow(h, level + 1) for h in halves)
        return self.node(level, passes, fails)

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and ``level + 1``. A node there
        keeps what it stands for (the four sub-diagrams below it are dealt
        anew), so the levels above only take over the node's new form."""
        old = list(self.levels[level].values())
        self.order[level:level + 2] = self.order[level + 1], self.order[level]
        self.levels[level], self.levels[level + 1] = {}, {}
        new = {}
        for n in old:
            (pp, pf, _), (fp, ff, _) = n[0], n[1]
            new[n] = self.node(level, self.node(level + 1, pp, fp), self.node(level + 1, pf, ff))
        for above in range(level - 1, -1, -1):
            old, self.levels[above] = list(self.levels[above].values()), {}
            new = {n: self.node(above, new[n[0]], new[n[1]]) for n in old}
        self.root = new[self.root]

    def all_pass(self) -> list[tuple[int, tuple, tuple]]:
        """(filter, weight kept, weight removed) along the path where all pass."""
        out, at = [], self.root
        for f in self.order:
            out.append((f, self.weight(at[0]), self.weight(at[1])))
            at = at[0]
        return out


def adjacent_swaps(n: int):
    """Levels to swap, one after the other, so that all n! orders are passed
    once: the last element walks through every order of the rest."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the walker now stands before or behind the rest
        down = not down


def audit(counts: dict[int, tuple[int, int, int]], names: str) -> list[tuple]:
    """``(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley)`` for every order and step, from the counts (all,
    good, toxic) by mask."""
    d = Diagram(counts, len(names))
    walk = [(list(d.order), d.all_pass())]
    for level in adjacent_swaps(len(names)):
        d.swap(level)
        walk.append((list(d.order), d.all_pass()))
    fails, alone, shapley = {}, {}, dict.fromkeys(range(len(names)), 0)
    for order, path in walk:
        fails[order[0]] = path[0][2][0]  # as first filter it meets all
        alone[order[-1]] = path[-1][2][0]  # as last filter it meets what passes all others
        for f, _, removed in path:
            shapley[f] += removed[0]
    return [("".join(names[f] for f in order), step + 1, kept[0], removed[0], fails[f] - removed[0], alone[f],
             removed[1], removed[2], shapley[f])
            for order, path in walk for step, (f, kept, removed) in enumerate(path)]


# ---------------------------------------------------------------- the operator
def audit_filters(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``masks (part,
    mask, n, good, toxic)``: documents kept after the step, removed by it,
    failing its filter but removed before (redundant), failing its filter only
    (unique_fails), good and toxic ones removed by it, and its filter's
    removals summed over all orders (shapley)."""
    schema = STEPS_SCHEMA.split(", ")

    def diagrams(batches):
        for b in batches:
            for row in b.to_pylist():
                counts = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in row["counts"]}
                found = list(zip(*audit(counts, names)))
                columns = [[row["part"]] * len(found[0]), *found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if f.endswith("string") else pa.int32() if f.endswith("int") else pa.int64())
                     for c, f in zip(columns, schema)], names=[f.split()[0] for f in schema])

    per_part = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return per_part.mapInArrow(diagrams, STEPS_SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``audit_filters`` of the five conditions of ``document_masks``."""
    return audit_filters(document_masks(docs, labels, **columns))
