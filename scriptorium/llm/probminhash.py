"""Near-duplicate groups by ProbMinHash, banding and exact verification.

A text is the multiset of its runs of ``SHINGLE`` words (split at white
space); a shingle's weight is how often it occurs. Similarity of two texts is
the probability Jaccard index of their weights,

    J(v, w) = sum over shared d of 1 / sum over e of max(v_e / v_d, w_e / w_d),

which is the ordinary Jaccard index where all weights are equal.

*Signature*: every shingle starts a Poisson process whose rate is its weight;
each arrival picks one of ``BANDS * ROWS`` registers, and a register keeps the
shingle of its earliest arrival. Two texts agree in a register with probability
J. A shingle whose next arrival is later than all registers is done, so most
shingles of a long text end after one arrival.

*Banding*: texts that agree in all rows of a band share a bucket. A text of
similarity 0.8 or more misses every bucket with probability below 0.002.

*Verification* is exact, on whole texts, and no bucket is ever expanded into
all pairs: every text of a bucket is compared with the bucket's hub, the text
that meets the most others. Where texts compared with one hub are still in
different groups, a second pass compares those that may be alike by what they
have beyond the hub and by their sizes (``_unsettled``: bounds that hold for
every pair). No candidate pair with a link is lost.

Equal texts are one node from the start. Groups are the connected components,
found by alternating star contraction over staged edge tables.

Defined cases: a null text counts as empty; texts without words are alike only
where they are equal; a text of fewer than ``SHINGLE`` words is one shingle.
Repeated rows and null ids keep their rows; a group's id is the smallest
non-null id in it. Other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, hash_words, mix64, slices, staged, text_key, text_or_empty, texts_of, unit_interval

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 21, 6
#: Texts compared with one copy of a hub's text.
SALT_ROWS = 64
#: A shingle that so many and such a share of a hub's texts have counts as the
#: hub's. Any value is right; it only decides which of two joins finds a pair.
MANY_TEXTS, MANY_SHARE = 8, 0.05
#: ratio of neighbouring size slots
SLOT = 1.5


# ---------------------------------------------------------------- inside tasks
def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the texts as (text index, hash, weight), ordered by
    text and hash."""
    lists = [t.split() for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    flat = hash_words(list(chain.from_iterable(lists)))
    short = (n > 0) & (n < size)
    runs = np.where(n >= size, n - size + 1, short.astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), runs)
    first = np.repeat(np.cumsum(n) - n, runs) + np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    length = np.where(short, n, size)[doc]
    h = np.zeros(len(doc), dtype=np.uint64)
    for j in range(size):
        use = j < length
        step = mix64(h * GOLDEN + flat[np.minimum(first + j, len(flat) - 1)]) if len(flat) else h
        h = np.where(use, step, h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc))).astype(np.float64)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash registers ``[n_docs, m]``: the element of the earliest
    arrival in each register. Texts without elements keep zeros."""
    when = np.full(n_docs * m, np.inf)
    who = np.zeros(n_docs * m, dtype=np.uint64)
    latest = np.full(n_docs, np.inf)  # the latest register of each text
    time = np.zeros(len(doc))
    arrival = 0
    while len(doc):
        arrival += 1
        r = mix64(element + np.uint64(arrival * int(GOLDEN) % 2 ** 64))
        time = time - np.log1p(-unit_interval(r)) / weight
        live = time < latest[doc]
        doc, element, weight, time, r = doc[live], element[live], weight[live], time[live], r[live]
        slot = doc * m + (mix64(r + GOLDEN) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(time < when[slot])
        better = better[np.argsort(-time[better], kind="stable")]  # the earliest is written last
        when[slot[better]] = time[better]
        who[slot[better]] = element[better]
        touched = np.unique(doc[better])
        latest[touched] = when.reshape(n_docs, m)[touched].max(axis=1)
    return who.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(len(sig), bands, -1)
    h = np.zeros(rows.shape[:2], dtype=np.uint64)
    for j in range(rows.shape[2]):
        h = mix64(h * GOLDEN + rows[:, :, j])
    return h


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Probability Jaccard index of two weighted sets with sorted hashes.

    With the shared elements sorted by the ratio of their weights, both sums of
    maxima are prefix sums, so the index takes one sort."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    v, w = w1[i], w2[j]
    if (v == v[0]).all() and (w == w[0]).all() and len(i) == len(h1) == len(h2):
        return 1.0
    ratio = w / v
    order = np.argsort(ratio, kind="stable")
    v, w, ratio = v[order], w[order], ratio[order]
    # max(v_e / v_d, w_e / w_d): the second where e's ratio is larger than d's
    v_below = np.cumsum(v)
    w_above = w.sum() - np.cumsum(w)
    only1, only2 = w1.sum() - v.sum(), w2.sum() - w.sum()
    return float((1.0 / ((v_below + only1) / v + (w_above + only2) / w)).sum())


def _signed(batches, bands, rows):
    for b in slices(batches, "text"):
        texts = texts_of(b, "text")
        doc, h, w = shingles(texts)
        keys = band_keys(signatures(doc, h, w, len(texts), bands * rows), bands).view(np.int64)
        has = np.bincount(doc, minlength=len(texts)) > 0
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(np.where(has, bands, 0))), pa.int32()), pa.array(keys[has].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("key"), lists], names=["key", "bands"])


LINKS = ("key binary, hub binary, sim double, common long, weight double, core long, "
         "heavy array<struct<w: double, n: long>>, extra array<long>")


def _slack(threshold: float) -> float:
    """Largest sum of the shares that two alike texts have outside what they share."""
    return (1 - threshold) * (2 - threshold) + 1e-9


def _verified(batches, threshold):
    """Rows ordered by (hub, salt, role): a hub's text (role 0) and then the
    texts compared with it: ``common`` shingles of the text are in the hub,
    ``extra`` are the others; ``weight`` is the sum of its weights, ``heavy``
    how many shingles have each weight (falling), and ``core`` how many of its
    heaviest shingles a text alike to it must share at least."""
    hub, hub_h, hub_w = None, None, None
    for b in slices(batches, "text"):
        hubs, roles, keys = b.column("hub").to_pylist(), b.column("role").to_numpy(zero_copy_only=False), b.column("key")
        doc, h, w = shingles(texts_of(b, "text"))
        at = np.searchsorted(doc, np.arange(b.num_rows + 1))
        rows, out = [], []
        for i in range(b.num_rows):
            hi, wi = h[at[i]:at[i + 1]], w[at[i]:at[i + 1]]
            if roles[i] == 0:
                hub, hub_h, hub_w = hubs[i], hi.copy(), wi.copy()
            elif hubs[i] == hub:
                other = np.setdiff1d(hi, hub_h, assume_unique=True)
                value, n = np.unique(wi, return_counts=True)
                top = np.cumsum(np.sort(wi)[::-1])
                rows.append(i)
                out.append({"sim": similarity(hub_h, hub_w, hi, wi), "common": len(hi) - len(other), "weight": float(wi.sum()),
                            "core": int(np.searchsorted(top, (1 - _slack(threshold)) * wi.sum())) + 1,
                            "heavy": [{"w": a, "n": c} for a, c in zip(value[::-1].tolist(), n[::-1].tolist())],
                            "extra": other.view(np.int64)})
        found = pa.array(rows, pa.int64())
        fields = pa.schema([("sim", pa.float64()), ("common", pa.int64()), ("weight", pa.float64()), ("core", pa.int64()),
                            ("heavy", pa.list_(pa.struct([("w", pa.float64()), ("n", pa.int64())]))), ("extra", pa.list_(pa.int64()))])
        values = pa.RecordBatch.from_pylist(out, schema=fields)
        yield pa.RecordBatch.from_arrays([keys.take(found), b.column("hub").take(found), *values.columns],
                                         names=["key", "hub", *fields.names])


# ---------------------------------------------------------------- stages
def _verify(pairs: DataFrame, texts: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``key, hub, sim`` for distinct ``pairs (key, hub)``. A hub's text goes
    once to every ``SALT_ROWS`` texts that are compared with it, so neither a
    large group nor a long text gathers in one task."""
    per = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    salts = per.select("hub", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(salts, "hub").select(
        "key", "hub", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    hubs = salts.select(F.col("hub").alias("key"), "hub",
                        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = members.unionByName(hubs).join(reps, "key")
    same = wanted["key"].eqNullSafe(texts["key"]) & wanted["rep"].eqNullSafe(texts["id"])
    rows = (texts.join(wanted.hint("shuffle_hash"), same)
            .select("hub", "salt", "role", wanted["key"], "text")
            .repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role"))
    links = rows.mapInArrow(lambda it: _verified(it, threshold), LINKS)
    return staged(links.dropDuplicates(["key", "hub"]), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of the connected components of ``edges (u, v)``: large and
    small stars in turn until the edges are stars. Every round is staged."""
    def mark(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    cur = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = mark(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        cur = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        after = mark(cur)
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _unsettled(known: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """``key, hub``: pairs of texts compared with one hub that are in different
    groups and may still be alike.

    Let H be the hub's shingles and those that many of its texts have besides.
    If x and y share no shingle outside H, they share at most
    i = min(|x & H|, |y & H|), and the share of a text's weight outside what
    they share is at least out(i) = 1 - (its i largest weights) / weight. With
    weights normalised to p and q, every term of J is at most
    max(p_d, q_d) / sum of max(p, q), and J is at most the sum of min(p, q);
    together, J >= t needs

        out_x(i) + out_y(i) <= (1 - t) (2 - t).

    So the pairs are those that share a shingle outside H (joined on it) and
    those that fulfil this (joined on slots of ``core``); at least one of the
    two, x, is not in the hub's group."""
    own = roots.withColumnRenamed("node", "key")
    of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    star = (known.join(own, "key", "left").join(of_hub, "hub", "left")
            .withColumn("root", F.coalesce("root", "key")).withColumn("hub_root", F.coalesce("hub_root", "hub")))
    split = star.filter("root <> hub_root").select("hub").distinct()
    star = staged(star.join(split, "hub"), "near-apart")
    beyond = star.select("hub", "key", "root", "hub_root", F.explode("extra").alias("e"))
    texts = star.groupBy("hub").agg(F.count("*").alias("texts"))
    many = staged(beyond.groupBy("hub", "e").agg(F.count("*").alias("n")).filter(f"n >= {MANY_TEXTS}").join(texts, "hub")
                  .filter(F.col("n") >= F.col("texts") * MANY_SHARE).select("hub", "e"), "near-common")
    more = beyond.join(many, ["hub", "e"]).groupBy("hub", "key").agg(F.count("*").alias("more"))
    star = staged(star.drop("extra").join(more, ["hub", "key"], "left")
                  .withColumn("common", F.col("common") + F.coalesce("more", F.lit(0))).drop("more"), "near-apart")
    beyond = beyond.join(many, ["hub", "e"], "left_anti")
    apart = "rx <> ry AND x <> y"
    shared = (beyond.filter("root <> hub_root").select("hub", "e", F.col("key").alias("x"), F.col("root").alias("rx"))
              .join(beyond.select("hub", "e", F.col("key").alias("y"), F.col("root").alias("ry")), ["hub", "e"]).filter(apart))
    x = star.filter("root <> hub_root").withColumnRenamed("key", "x").withColumnRenamed("root", "rx")
    y = star.withColumnRenamed("key", "y").withColumnRenamed("root", "ry")
    def outside(i, p=""):
        top = F.aggregate(F.col(f"heavy{p}"), F.struct(i.cast("double").alias("left"), F.lit(0.0).alias("sum")),
                          lambda a, v: F.struct((a["left"] - F.least(a["left"], v["n"])).alias("left"),
                                                (a["sum"] + F.least(a["left"], v["n"]) * v["w"]).alias("sum")),
                          lambda a: a["sum"])
        return 1 - top / F.col(f"weight{p}")

    def slot(size):
        return F.floor(F.log(F.greatest(size, F.lit(1))) / float(np.log(SLOT)))

    i = F.least(F.col("common"), F.col("common_y"))
    plain = (F.col("heavy")[0]["w"] == 1) & (F.col("heavy_y")[0]["w"] == 1)  # J <= i / (|x| + |y| - i)
    sized = (x.withColumn("slot", F.explode(F.sequence(F.lit(0), slot(F.col("common")))))
             .select("hub", "slot", "x", "rx", "common", "weight", "heavy")
             .join(y.select("hub", slot(F.col("core")).alias("slot"), "y", "ry",
                            *[F.col(c).alias(f"{c}_y") for c in ("common", "weight", "heavy")]), ["hub", "slot"])
             .filter(apart).filter(F.when(plain, F.col("weight") + F.col("weight_y") <= (1 + 1 / threshold) * i + 1e-6)
                                   .otherwise(outside(i) + outside(i, "_y") <= _slack(threshold))))
    pairs = shared.select("x", "y").unionByName(sized.select("x", "y"))
    return pairs.select(F.greatest("x", "y").alias("key"), F.least("x", "y").alias("hub")).distinct()


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``key, rep, rep_rows, copies, root``: every distinct text, its smallest id,
    the rows with both, all its rows, and the smallest key of its group."""
    texts = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), text_or_empty(text_col).alias("text"))
    # band keys of every row, one row per distinct text
    signed = texts.select("key", "text").mapInArrow(lambda it: _signed(it, bands, rows), "key binary, bands array<long>")
    signed = signed.groupBy("key").agg(F.first("bands").alias("bands"))
    per_id = texts.groupBy("key", "id").agg(F.count("*").alias("n"))
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    reps = staged(per_id.groupBy("key").agg(smallest.alias("s"), F.sum("n").alias("copies"))
                  .select("key", F.col("s.id").alias("rep"), F.col("s.n").alias("rep_rows"), "copies"), "near-reps")
    member = staged(signed.select("key", F.posexplode("bands").alias("band", "bucket")), "near-bands")
    sizes = member.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = staged(member.join(sizes, ["band", "bucket"]), "near-crowded")
    # the hub of a bucket is the text that meets the most others over all its
    # buckets: among copies of one text, the text itself or what is nearest to it
    mass = crowded.groupBy("key").agg(F.sum("n").alias("mass"))
    ranked = crowded.join(mass, "key")
    hubs = ranked.groupBy("band", "bucket").agg(F.max(F.struct("mass", "key")).alias("h")).select(
        "band", "bucket", F.col("h.key").alias("hub"))
    shared = staged(crowded.drop("n").join(hubs, ["band", "bucket"]), "near-buckets")
    pairs = shared.filter("key <> hub").select("key", "hub").distinct()
    known = _verify(pairs, texts, reps.select("key", "rep"), threshold)
    links = known.filter(F.col("sim") >= threshold - 1e-9).select(F.col("key").alias("u"), F.col("hub").alias("v"))
    roots = staged(components(links), "near-roots")

    more = staged(_unsettled(known, roots, threshold), "near-more")
    if more.head(1):
        second = _verify(more, texts, reps.select("key", "rep"), threshold)
        links = links.unionByName(second.filter(F.col("sim") >= threshold - 1e-9)
                                  .select(F.col("key").alias("u"), F.col("hub").alias("v")))
        roots = staged(components(links), "near-roots")
    return (reps.join(roots.withColumnRenamed("node", "key"), "key", "left")
            .withColumn("root", F.coalesce("root", "key")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``id, class_id, class_size, kept`` per row: ``class_id`` is the smallest
    id of the group, ``class_size`` its rows, ``kept`` marks its row (all rows
    that repeat that id and text, if there are several)."""
    classes = staged(text_classes(docs, id_col, text_col, threshold), "near-classes")
    groups = classes.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("best"),
                                         F.sum("copies").alias("class_size"))
    groups = groups.select("root", F.col("best.rep").alias("class_id"), F.col("best.key").alias("best"), "class_size")
    by_key = classes.join(groups, "root").select("key", "rep", "class_id", "class_size",
                                                 (F.col("key") == F.col("best")).alias("of_best"))
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    return rows.join(by_key, "key").select(
        F.col("id").alias(id_col), "class_id", "class_size",
        (F.col("of_best") & F.col("id").eqNullSafe(F.col("rep"))).alias("kept"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each group: the one with the smallest id. Of
    rows that agree in id and text, one stays."""
    classes = staged(text_classes(docs, id_col, text_col, threshold), "near-classes")
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key", "rep_rows")).alias("best"))
    best = best.select(F.col("best.rep").alias("__rep"), F.col("best.key").alias("__key"), F.col("best.rep_rows").alias("__rows"))
    keyed = docs.withColumn("__own", text_key(text_col))
    kept = (keyed.join(best.hint("shuffle_hash"), (F.col("__own") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__rep")))
            .drop("__own", "__rep"))
    once = kept.filter("__rows = 1").drop("__rows", "__key")
    again = kept.filter("__rows > 1").drop("__rows").dropDuplicates(["__key"]).drop("__key")
    return once.unionByName(again)
