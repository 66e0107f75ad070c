"""Text-overlap metrics between a gold text and a candidate: BLEU, METEOR
(exact and stem stages), ROUGE-L (summary level), candidate length, and their
macro means.

A pair of texts is one row, and every metric is a function of that row alone:
they are computed in one map-only pass over Arrow batches. No n-gram, word or
sentence becomes a row and nothing is shuffled beyond the join that pairs the
texts. Inside a batch the words of all texts are numbered once and n-grams,
clipped counts and alignments are integer array operations on the whole batch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem
from ..functions.constants import (
    BLEU_WEIGHTS, FLOAT_MIN, METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA)
from .sentences import sentences as learned_sentences

#: characters of both texts of the pairs handled at once (a longer pair is alone)
BATCH_CHARS = 2_000_000
#: bits of the LCS rows that are kept for the walk back; beyond, rows are computed again block by block
ROW_BITS = 1 << 28
MAX_ORDER = 4


# E1 -------------------------------------------------------------------------
def flatten_text(col) -> Column:
    """A list of section texts joined by newline (a string stays as is, once
    normalised to a one-element list)."""
    return F.array_join(T._c(col), "\n")


def normalize_text_union(json_col, field: str = "text") -> Column:
    """A JSON field holding a string or a list of strings, as
    ``ARRAY<STRING>``."""
    raw = F.get_json_object(T._c(json_col), f"$.{field}")
    # a JSON string does not parse as an array, whatever it begins with
    items = F.from_json(T._c(json_col), f"struct<{field}:array<string>>")[field]
    return (F.when(raw.isNull(), F.array().cast("array<string>"))
            .when(items.isNotNull(), items)
            .otherwise(F.array(raw)))


# E2 -------------------------------------------------------------------------
def pair_texts(gold: DataFrame, cand: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched pairs ``keys, ref, cand``, gold keys without a candidate)."""
    pairs = gold.select(*keys, F.col("text").alias("ref")).join(
        cand.select(*keys, F.col("text").alias("cand")), keys)
    missing = gold.select(*keys).join(cand.select(*keys), keys, "left_anti")
    return pairs, missing


# E3, E4 ---------------------------------------------------------------------
class _Words:
    """The words of a batch of pairs, one after the other: of every pair the
    candidate's, then the reference's."""

    def __init__(self, cands: list[str], refs: list[str]):
        lists = pc.utf8_split_whitespace(pa.array([t for pair in zip(cands, refs) for t in pair], pa.large_string()))
        self.pairs = len(cands)
        words = lists.flatten()
        some = pc.greater(pc.binary_length(words), 0)  # white space at the ends leaves empty ones
        coded = words.filter(some).dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.vocabulary = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        text = np.repeat(np.arange(2 * self.pairs), pc.list_value_length(lists).to_numpy().astype(np.int64))
        self.text = text[some.to_numpy(zero_copy_only=False)]
        self.sizes = np.bincount(self.text, minlength=2 * self.pairs)

    def _numbered(self, form) -> np.ndarray:
        """The words numbered anew by a form of them."""
        number: dict[str, int] = {}
        again = np.array([number.setdefault(w, len(number)) for w in map(form, self.vocabulary)], dtype=np.int64)
        return again[self.code] if len(again) else self.code

    def lower(self) -> np.ndarray:
        return self._numbered(str.lower)

    def stems(self) -> np.ndarray:
        return self._numbered(lambda w: stem(w.lower()))

    def length(self, side: int) -> np.ndarray:
        """Words of every pair's candidate (side 0) or reference (side 1)."""
        return self.sizes[side::2]


def _clipped_hits(w: _Words) -> np.ndarray:
    """Per order 1 to 4 and pair: the candidate's n-grams that the reference
    has too, each as often as it occurs in both. An n-gram of order n is
    numbered from the number of its first n - 1 words and its last word."""
    size = len(w.vocabulary) + 1
    at = np.arange(len(w.code))
    gram, out = w.text // 2, np.zeros((MAX_ORDER, w.pairs), dtype=np.int64)
    for n in range(MAX_ORDER):
        whole = at + n < len(w.code)
        at, gram = at[whole], gram[whole]
        inside = w.text[at] == w.text[at + n]
        at, gram = at[inside], gram[inside]
        if not len(at):
            break
        gram, different = pd.factorize(gram * size + w.code[at + n])
        kinds, side = len(different), w.text[at] % 2
        both = np.minimum(np.bincount(gram[side == 0], minlength=kinds), np.bincount(gram[side == 1], minlength=kinds))
        owner = np.zeros(kinds, dtype=np.int64)
        owner[gram] = w.text[at] // 2
        out[n] = np.bincount(owner, weights=both, minlength=w.pairs)
        shared = both[gram] > 0  # a longer n-gram of both begins with a shorter one of both
        at, gram = at[shared], gram[shared]
    return out


def _bleu(w: _Words, orders: tuple[int, ...]) -> dict[str, np.ndarray]:
    hits, c, r = _clipped_hits(w), w.length(0), w.length(1)
    n = np.arange(MAX_ORDER)[:, None]
    precision = np.where(hits > 0, hits / np.maximum(1, c - n), FLOAT_MIN)
    brevity = np.where(c > r, 1.0, np.exp(1 - r / np.maximum(c, 1)))
    out = {}
    for o in orders:
        logs = sum(wt * np.log(p) for wt, p in zip(BLEU_WEIGHTS[o], precision) if wt)
        out[f"bleu_{o}"] = np.where(hits[0] > 0, brevity * np.exp(logs), 0.0)
    return out


def _from_last(key: np.ndarray) -> np.ndarray:
    """How many equal keys come after each key."""
    return pd.Series(key).groupby(key, sort=False).cumcount(ascending=False).to_numpy(dtype=np.int64)


def _matched(c: np.ndarray, r: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate places ``c`` and reference places ``r``: pairs of equal keys, the
    k-th last with the k-th last."""
    count = len(key) + 1
    one, two = (key[at] * count + _from_last(key[at]) if len(at) else at for at in (c, r))
    j = pd.Index(two).get_indexer(one)
    return c[j >= 0], r[j[j >= 0]]


def _meteor(w: _Words, alpha: float, beta: float, gamma: float, stages: tuple[str, ...] = ("exact",)) -> np.ndarray:
    """The aligner walks the candidate from its end and takes the last free
    reference occurrence of the same word, so the k-th last occurrence of a word
    in the candidate pairs with its k-th last in the reference. A later stage does
    the same with what is left and a coarser form of the words (their stems)."""
    free = [np.flatnonzero(w.text % 2 == side) for side in (0, 1)]
    found = [(free[0][:0], free[1][:0])]
    for stage in stages:
        code = w.lower() if stage == "exact" else w.stems()
        key, _ = pd.factorize((w.text // 2) * (len(w.vocabulary) + 1) + code)
        found.append(_matched(*free, key))
        open_ = np.ones(len(w.code), dtype=bool)
        open_[np.concatenate(found[-1])] = False
        free = [at[open_[at]] for at in free]
    c, r = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(c)
    c, r = c[order], r[order]
    pair = w.text[c] // 2
    matches = np.bincount(pair, minlength=w.pairs)
    go_on = (np.diff(c) == 1) & (np.diff(r) == 1) & (np.diff(pair) == 0)
    chunks = matches - np.bincount(pair[1:][go_on], minlength=w.pairs)
    some = np.maximum(matches, 1)
    precision, recall = some / np.maximum(w.length(0), 1), some / np.maximum(w.length(1), 1)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    return np.where(matches > 0, (1 - gamma * (chunks / some) ** beta) * mean, 0.0)


# E5 -------------------------------------------------------------------------
def sentences(text: str) -> list[list[str]]:
    """Pieces between full stops as lists of words (a blank piece holds one
    empty word)."""
    return [s.split() or [""] for s in text.split(".") if s]


def word_bits(words: list[str]) -> dict[str, int]:
    """For every word an integer whose bits are its positions."""
    out: dict[str, int] = {}
    for j, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << j
    return out


def lcs_words(ref: list[str], bits: dict[str, int], width: int, row_bits: int = ROW_BITS) -> set[str]:
    """Words of one longest common subsequence of ``ref`` and the words whose
    ``bits`` are given, ``width`` of them, found from the end: on a tie the step
    goes to the shorter candidate prefix.

    Bit-parallel: the table's row of a reference word is one integer whose bit j
    is 0 where the length grows at the candidate's word j, and follows from the
    row before by one addition. Walking back, the highest bit that matches or is
    0 says where a row is left. Rows that would take more than ``row_bits`` are
    kept at every so many words and computed again from there."""
    full = (1 << width) - 1
    every = max(1, len(ref) if len(ref) * width <= row_bits else isqrt(len(ref)))
    kept, row = [], full

    def rows_of(row: int, matches: list[int]) -> list[int]:
        rows = []
        for match in matches:
            hit = row & match
            if hit:
                row = (row + hit | row - hit) & full
            rows.append(row)
        return rows

    for start in range(0, len(ref), every):
        kept.append(row)
        if start + every < len(ref):
            row = rows_of(row, [bits.get(w, 0) for w in ref[start:start + every]])[-1]
    found, open_ = set(), full
    for block in range(len(kept) - 1, -1, -1):
        part = ref[block * every:(block + 1) * every]
        matches = [bits.get(w, 0) for w in part]
        for w, match, row in zip(reversed(part), reversed(matches), reversed(rows_of(kept[block], matches))):
            at = (match | ~row) & open_
            if not at:  # nothing in common before here
                return found
            top = at.bit_length()
            if match >> top - 1 & 1:
                found.add(w)
                open_ = (1 << top - 1) - 1
            else:
                open_ = (1 << top) - 1
    return found


def common_words(ref: list[str], cand: list[str], in_ref: set[str], in_cand: set[str]) -> set[str]:
    """As ``lcs_words``, of two sentences and their sets of words (or of those
    words of them that both texts have).

    Words of the candidate that are not in ``ref`` change no row of the table and
    are left out; of words of ``ref`` that are not in the candidate one of each run
    stays, as the walk back passes it. Where what both share of one side is a
    subsequence of the other's, it is the only longest one."""
    c = [w for w in cand if w in in_ref]
    r = [w for w in ref if w in in_cand]
    if c == r:
        return set(c)
    short, other = (c, iter(r)) if len(c) <= len(r) else (r, iter(c))
    if all(w in other for w in short):
        return set(short)
    if len(r) < len(ref):
        r, gap = [], False
        for w in ref:
            if w in in_cand:
                r.append(w)
                gap = False
            elif not gap:
                r.append(w)
                gap = True
    return lcs_words(r, word_bits(c), len(c))


def _nearest(places: list[int], i: int) -> Iterator[int]:
    """Ascending ``places``, the nearest to ``i`` first."""
    high = bisect_left(places, i)
    low = high - 1
    while low >= 0 or high < len(places):
        if high == len(places) or low >= 0 and i - places[low] <= places[high] - i:
            yield places[low]
            low -= 1
        else:
            yield places[high]
            high += 1


def union_lcs(refs: list[list[str]], cands: list[list[str]]) -> set[str]:
    """Words of the longest common subsequences of all pairs of sentences.

    A subsequence holds only words of both its sentences. So a reference
    sentence is compared with a candidate sentence only for a common word that
    is not found yet, the nearest sentences first."""
    common = set().union(*refs) & set().union(*cands)
    in_cand = [common.intersection(c) for c in cands]
    where: defaultdict[str, list[int]] = defaultdict(list)
    for j, words in enumerate(in_cand):
        for w in words:
            where[w].append(j)
    left = set(common)  # what is not found yet
    for i, r in enumerate(refs):
        wanted = left.intersection(r)
        if not wanted:
            continue
        of, tried = common.intersection(r), set()
        for w in wanted:
            if w not in left:
                continue
            for j in _nearest(where[w], i):
                if j in tried:
                    continue
                tried.add(j)
                left -= common_words(r, cands[j], of, in_cand[j])
                if w not in left:
                    break
    return common - left


def _rouge_l(cand: str, ref: str, model: dict | None = None) -> float:
    if model is None:
        refs, cands = sentences(ref), sentences(cand)
    else:
        refs, cands = ([s.split() for s in learned_sentences(t, model)] for t in (ref, cand))
    if not refs or not cands:
        return 0.0
    n = len(union_lcs(refs, cands))
    recall, precision = (n / len({w for x in side for w in x}) for side in (refs, cands))
    return 2.0 * (recall * precision) / (recall + precision + 1e-8)


# E3 to E6 -------------------------------------------------------------------
def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``BATCH_CHARS``."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
               for c in ("ref", "cand"))
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // BATCH_CHARS)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def overlap_scores(pairs: DataFrame, keys: list[str], metrics: tuple[str, ...] = ("bleu", "meteor", "rouge_l"), *,
                   orders: tuple[int, ...] = (1, 4), alpha: float = METEOR_ALPHA, beta: float = METEOR_BETA,
                   gamma: float = METEOR_GAMMA, stages: tuple[str, ...] = ("exact",),
                   sentence_model: dict | None = None) -> DataFrame:
    """``keys`` and the asked metrics (``bleu_<n>`` for each of ``orders``,
    ``meteor``, ``rouge_l``) of every row of ``pairs (keys, ref, cand)``, all in
    one map-only pass. A null text is an empty one; a pair without a common word
    scores 0, so an empty text does, too. Rows are scored one by one: repeated
    keys stay separate rows.

    * BLEU: sentence BLEU over whitespace words, clipped n-gram precision,
      brevity penalty, no smoothing (an order without a hit uses the smallest
      double as its precision).
    * METEOR over lower-cased words: ``stages`` are ``exact`` and, with what that leaves,
      ``stem`` (Porter stems).
    * ROUGE-L: summary level, sentences split at '.' (or by a ``sentence_model`` of
      ``sentences.learn``); the words of the longest
      common subsequences of all sentence pairs are united, ``F = 2PR / (P + R +
      1e-8)`` with ``P = |U| / |candidate's words|``, ``R = |U| / |reference's
      words|`` (distinct words)."""
    kept = pairs.select(*keys)
    names = [n for m in metrics for n in ([f"bleu_{o}" for o in orders] if m == "bleu" else [m])]
    schema = kept.schema
    for n in names:
        schema = schema.add(n, "double")

    def run(batches):
        for b in batches:
            for part in _runs(b):
                ref, cand = ([t or "" for t in part.column(c).to_pylist()] for c in ("ref", "cand"))
                words = _Words(cand, ref) if {"bleu", "meteor"} & set(metrics) else None
                found = _bleu(words, orders) if "bleu" in metrics else {}
                if "meteor" in metrics:
                    found["meteor"] = _meteor(words, alpha, beta, gamma, stages)
                if "rouge_l" in metrics:
                    found["rouge_l"] = np.array([_rouge_l(c, r, sentence_model) for c, r in zip(cand, ref)])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(found[n]) for n in names)],
                                                 names=[*keys, *names])

    scored = pairs.select(*keys, F.col("ref").cast("string").alias("ref"), F.col("cand").cast("string").alias("cand")).mapInArrow(run, schema)
    return scored.select(*keys, *[T.round6(n).alias(n) for n in names])


def bleu(pairs: DataFrame, keys: list[str], orders: tuple[int, ...] = (1, 4)) -> DataFrame:
    """``keys, bleu_<n>`` for each requested order."""
    return overlap_scores(pairs, keys, ("bleu",), orders=orders)


def meteor_exact(pairs: DataFrame, keys: list[str], **weights) -> DataFrame:
    """``keys, meteor``."""
    return overlap_scores(pairs, keys, ("meteor",), **weights)


def meteor(pairs: DataFrame, keys: list[str], **weights) -> DataFrame:
    """``keys, meteor`` with the exact and the stem stage."""
    return overlap_scores(pairs, keys, ("meteor",), stages=("exact", "stem"), **weights)


def rouge_l(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rouge_l``."""
    return overlap_scores(pairs, keys, ("rouge_l",))


# E7 / E8 --------------------------------------------------------------------
def candidate_length(col) -> Column:
    return T.token_count(col)


def macro_summary(scores: DataFrame, metrics: list[str], by: list[str] | None = None,
                  length: str | None = "length") -> DataFrame:
    """Mean of each metric over matched texts, in percent; mean length."""
    aggs = [F.count(F.lit(1)).alias("n_pairs")]
    aggs += [T.round6(F.avg(F.coalesce(F.col(m), F.lit(0.0))) * 100).alias(m) for m in metrics]
    if length:
        aggs.append(T.round6(F.avg(length)).alias(f"avg_{length}"))
    return scores.groupBy(*(by or [])).agg(*aggs)
