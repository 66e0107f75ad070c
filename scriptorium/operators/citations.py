"""Citation evaluation: cited units, citation ids, premises, NLI inputs,
a lexical support scorer, label regrouping, recall and precision.

A text is split into units at its ``[n]`` markers: a marker (and a lone
newline or empty piece) stays with the text before it, every other piece
starts a new unit. Splitting is done by marking each marker with U+0001
(RE2 and Java agree on it; neither needs lookaround).
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_MARK = "\u0001"


# E9 -------------------------------------------------------------------------
def split_units(df: DataFrame, keys: list[str], col: str = "text", outer: bool = False) -> DataFrame:
    """``keys, unit_pos, unit``: one row per cited unit, in text order. With
    ``outer`` a text without units keeps one row of nulls.

    Map-only, inside each row: the text is split into pieces (markers kept as
    pieces); a piece starts a unit unless it is a marker, '' or a lone
    newline; each unit is the run of pieces from its start to the next start
    (disjoint slices, so linear in the text). Pieces before the first start
    form a unit of their own when not empty."""
    marked = F.regexp_replace(T._c(col), f"({T.MARKER})", f"{_MARK}$1{_MARK}")
    p = df.select(*keys, F.split(marked, _MARK).alias("_p"))
    n = F.size("_p")

    def is_start(x):
        return (~x.rlike(f"^{T.MARKER}$")) & (x != "") & (x != "\n")

    p = p.withColumn("_b", F.filter(F.sequence(F.lit(1), n), lambda i: is_start(F.element_at("_p", i))))
    b = F.col("_b")
    nb = F.size(b)
    head_len = F.when(nb > 0, F.element_at(b, 1) - 1).otherwise(n)
    head = F.when(head_len > 0, F.array_join(F.slice("_p", 1, head_len), "")).otherwise(F.lit(""))
    rest = F.transform(b, lambda s, k: F.array_join(F.slice(
        "_p", s, F.coalesce(F.try_element_at(b, k + 2), n + 1) - s), ""))
    rest = F.when(nb > 0, rest).otherwise(F.array().cast("array<string>"))
    units = F.when(head != "", F.concat(F.array(head), rest)).otherwise(rest)
    explode = F.posexplode_outer if outer else F.posexplode
    return (p.select(*keys, explode(units).alias("unit_pos", "unit"))
            .withColumn("unit_pos", F.col("unit_pos").cast("bigint")))


# E10 ------------------------------------------------------------------------
def hypothesis(col) -> Column:
    """Unit text without its markers."""
    return F.regexp_replace(T._c(col), T.MARKER, "")


def cited_ids(col) -> Column:
    """0-based document ids of the unit's markers, in order, duplicates kept; a
    number beyond 64 bits is NULL, which is outside every list."""
    return F.transform(F.regexp_extract_all(T._c(col), F.lit("\\[([0-9]+)\\]"), 1),
                       lambda x: x.try_cast("bigint") - 1)


# E11 ------------------------------------------------------------------------
def cite_pairs(units: DataFrame, keys: list[str]) -> DataFrame:
    """One row per citation: ``keys, unit_pos, cite_pos, idx, hypothesis``."""
    return units.select(*keys, "unit_pos", hypothesis("unit").alias("hypothesis"),
                        F.posexplode(cited_ids("unit")).alias("cite_pos", "idx")) \
        .withColumn("cite_pos", F.col("cite_pos").cast("bigint"))


def attach_premises(pairs: DataFrame, refs: DataFrame, keys: list[str],
                    python_negative_index: bool = False, missing=" ",
                    only_listed: bool = False) -> DataFrame:
    """Premise of each citation from the unit's document list ``refs``
    (``keys, ref_pos, premise``); an id outside the list gives the premise
    ``missing`` (``' '``; an empty array when premises are word sets). With
    ``python_negative_index`` an id of -1 (marker ``[0]``) takes the last
    document, as list indexing would. ``only_listed`` drops the citations of
    texts or sections that have no list at all (sections beyond the lists)."""
    p = pairs.join(refs.select(*keys).distinct(), keys, "left_semi") if only_listed else pairs
    if python_negative_index:
        n = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        p = (p.join(n, keys, "left")
             .withColumn("_look", F.when(F.col("idx") < 0, F.col("idx") + F.col("_n")).otherwise(F.col("idx")))
             .drop("_n"))
    else:
        p = p.withColumn("_look", F.col("idx"))
    r = refs.select(*keys, F.col("ref_pos").alias("_look"), "premise")
    return (p.join(r, [*keys, "_look"], "left")
            .withColumn("premise", F.coalesce("premise", missing if isinstance(missing, Column)
                                              else F.lit(missing))).drop("_look"))


def cite_records(records: DataFrame, keys: list[str], text: str = "text", refs: str = "refs",
                 outer: bool = False) -> DataFrame:
    """``keys, unit_pos, hypothesis, cite_pos, idx, ref``: one row per citation of
    records that carry their own list ``refs`` (of texts, or of ids of texts that
    are joined later); ``ref`` is null outside the list. Map-only: text and list are
    one row. With ``outer`` units without citations and texts without units keep one
    row (null ``cite_pos``, null ``unit_pos``), as the scores need them."""
    u = split_units(records, [*keys, refs], text, outer)
    explode = F.posexplode_outer if outer else F.posexplode
    cited = u.select(*keys, "unit_pos", hypothesis("unit").alias("hypothesis"), refs, explode(cited_ids("unit")).alias("cite_pos", "idx"))
    ref = F.when(F.col("idx") >= 0, F.get(F.col(refs), F.when(F.col("idx") < F.size(refs), F.col("idx")).otherwise(-1).cast("int")))
    return cited.select(*keys, "unit_pos", "hypothesis", F.col("cite_pos").cast("bigint").alias("cite_pos"), "idx", ref.alias("ref"))


# E12 ------------------------------------------------------------------------
def nli_input(premise, hyp) -> Column:
    return F.concat(F.lit("premise: "), T._c(premise), F.lit(" hypothesis: "), T._c(hyp))


# E13 ------------------------------------------------------------------------
_WORD = "[\\p{L}\\p{N}_]+"


def word_set(col) -> Column:
    """Distinct lower-cased words (letters, digits, underscore) of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(T._c(col)), F.lit(_WORD), 0))


def lexical_support(premise, hyp, threshold: float = 0.5, premise_words: bool = False) -> Column:
    """Baseline scorer (lexical, not NLI): "1" when at least ``threshold`` of
    the hypothesis' distinct lower-cased words occur in the premise. With
    ``premise_words`` the premise is already a ``word_set`` column (compute it
    once per document, not once per citation)."""
    h = word_set(hyp)
    p = T._c(premise) if premise_words else word_set(premise)
    share = F.size(F.array_intersect(h, p)) / F.size(h)
    return F.when((F.size(h) > 0) & (share >= threshold), F.lit("1")).otherwise(F.lit("0"))


def score_pairs(df: DataFrame, scorer: Callable[[list[str], list[str]], list[str]], *,
                premise: str = "premise", hyp: str = "hypothesis", out: str = "label",
                batch: int = 8) -> DataFrame:
    """Hook for a user scorer ``scorer(premises, hypotheses) -> labels``,
    called on batches of ``batch`` pairs inside the tasks (Arrow)."""
    @F.pandas_udf("string")
    def run(p: pd.Series, h: pd.Series) -> pd.Series:
        labels: list[str] = []
        for i in range(0, len(p), batch):
            labels.extend(scorer(p.iloc[i:i + batch].tolist(), h.iloc[i:i + batch].tolist()))
        return pd.Series(labels, dtype="object")

    return df.withColumn(out, run(F.col(premise), F.col(hyp)))


# E14 ------------------------------------------------------------------------
def unit_labels(units: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, unit_pos, labels ARRAY<STRING>`` in citation order; a unit
    without citations keeps an empty list."""
    per = (labels.groupBy(*keys, "unit_pos")
           .agg(F.sort_array(F.collect_list(F.struct("cite_pos", "label"))).alias("_l"))
           .select(*keys, "unit_pos", F.transform("_l", lambda x: x["label"]).alias("labels")))
    return (units.select(*keys, "unit_pos").join(per, [*keys, "unit_pos"], "left")
            .withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))))


def labels_per_unit(cited: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, unit_pos, labels ARRAY<STRING>`` in citation order from labelled rows of
    ``cite_records(outer=True)`` (column ``label``); one grouping, uncited units keep
    an empty list and texts without units a null ``unit_pos``."""
    one = F.when(F.col("cite_pos").isNotNull(), F.struct("cite_pos", "label"))
    return (cited.groupBy(*keys, "unit_pos").agg(F.sort_array(F.collect_list(one)).alias("_l"))
            .select(*keys, "unit_pos", F.transform("_l", lambda x: x["label"]).alias("labels")))


# E15 ------------------------------------------------------------------------
def scores_of_units(unit_lbls: DataFrame, keys: list[str]) -> DataFrame:
    """``citation_scores`` from the rows of ``labels_per_unit``, which hold every
    article: no other table is read."""
    return citation_scores(unit_lbls, None, keys, unit_lbls)


def citation_scores(unit_lbls: DataFrame, articles: DataFrame | None, keys: list[str], every: DataFrame | None = None) -> DataFrame:
    """Recall (a unit with any "1") and precision (1 - share of "0") per unit;
    units without citations add 0 but count in the per-article denominator;
    per-article means, then means over all ``articles`` (those without units
    add 0)."""
    lab = F.col("labels")
    n = F.size(lab)
    zeros = F.size(F.filter(lab, lambda x: x == "0"))
    ones = F.size(F.filter(lab, lambda x: x == "1"))
    pre = F.when(n > 0, 1 - zeros / n).otherwise(F.lit(0.0))
    rec = F.when(ones > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    if every is not None:  # an article without units is a row with a null unit
        unit = F.col("unit_pos").isNotNull()
        all_art = every.groupBy(*keys).agg(F.avg(F.when(unit, pre)).alias("precision"), F.avg(F.when(unit, rec)).alias("recall"))
    else:
        per_art = unit_lbls.groupBy(*keys).agg(F.avg(pre).alias("precision"), F.avg(rec).alias("recall"))
        all_art = articles.select(*keys).distinct().join(per_art, keys, "left")
    return all_art.agg(
        F.count(F.lit(1)).alias("n_articles"),
        T.round6(F.avg(F.coalesce("recall", F.lit(0.0)))).alias("citation_recall"),
        T.round6(F.avg(F.coalesce("precision", F.lit(0.0)))).alias("citation_precision"))
