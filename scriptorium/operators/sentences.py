"""Sentences without trained data: what ends one is learned from the corpus itself
(after Kiss and Strunk, 2006).

A full stop ends a sentence unless it belongs to an abbreviation, an initial, a
number or an ellipsis. Whether a word is an abbreviation follows from counts over all texts: an
abbreviation stands with its full stop nearly always, is short, and may hold full
stops inside. Whether a word begins sentences follows from how often it stands
after a sure end: where such a word, capitalised, comes after an abbreviation, a
sentence ends there all the same.

Words are counted inside Arrow batches and summed by a Spark aggregation, so what moves and
what expressions are asked of are vocabularies; the two lists, at most ``LISTED``
entries each (the strongest), go to the tasks that split, and splitting is
map-only. A null text has no sentences; a corpus without full stops has no lists.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .sparse import text_runs

# --- fixed values of the method: how sure an abbreviation or a sentence starter must be
ABBREVIATION = 0.3
STARTER = 30.0
# ----------------------------------------------------------------------------
LISTED = 50_000
_CORE = "^[\"'(\\[{«„“‘]*(.*?)[\"')\\]}»”’]*$"
#: what ends a word that may end a sentence
_STOP = re.compile(r"(?<![.!?…])[.!?…]++[\"')\]}»”’]*+(?!\S)")
_SURE = re.compile(r"[!?]$|^[^.]{4,}\.$")
_WORD = re.compile(r"\S+")
_OPEN = "\"'([{«„“‘"
_CLOSE = "\"')]}»”’"


def _log_likelihood(k, n, p, q):
    """Dunning's ratio that ``k`` of ``n`` come from probability ``q`` rather than ``p``."""
    def log_l(x):
        return k * F.log(x) + (n - k) * F.log(1 - x)
    return 2 * (log_l(q) - log_l(p))


class _Sure(dict):
    """Whether a sentence surely ends with a word, found once for each."""

    def __missing__(self, word: str) -> bool:
        found = self[word] = bool(_SURE.search(re.match(_CORE, word)[1]))
        return found


def _counted(batches):
    """``word, n, after``: the words of a run of texts, how often they stand there and
    how often after a sure end."""
    for b in batches:
        for part in text_runs(b, "text"):
            sure, n, after = _Sure(), {}, {}
            for t in part.column("text").to_pylist():
                words = (t or "").split()
                for w in words:
                    n[w] = n.get(w, 0) + 1
                for w in [w for before, w in zip(words, words[1:]) if sure[before]]:
                    after[w] = after.get(w, 0) + 1
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64()),
                                              "after": pa.array([after.get(w, 0) for w in n], pa.int64())})


def _vocabulary(docs: DataFrame, col: str) -> DataFrame:
    """Every word without quotes and brackets: its lower-case ``type`` without a final
    full stop, whether it had one (``dot``), how often it stands in all texts (``n``)
    and how often after a sure end (``after``)."""
    counted = (docs.select(F.col(col).cast("string").alias("text")).mapInArrow(_counted, "word string, n long, after long")
               .groupBy("word").agg(F.sum("n").alias("n"), F.sum("after").alias("after")))
    x = F.regexp_extract("word", _CORE, 1)
    bare = F.regexp_replace("x", "[.,;:!?…]+$", "")
    return counted.select(x.alias("x"), "n", "after").select(
        F.lower(F.regexp_replace("x", "\\.$", "")).alias("type"), F.lower(bare).alias("bare"),
        F.col("x").rlike("[^.]\\.$").cast("int").alias("dot"), "n", "after")


def learn(docs: DataFrame, col: str = "text", listed: int = LISTED) -> dict[str, set[str]]:
    """``abbreviations`` (without their last full stop) and ``starters`` of a corpus."""
    words = stage(_vocabulary(docs, col), "words")
    total = words.agg(F.sum("n").alias("n"), F.sum(F.col("dot") * F.col("n")).alias("dots"), F.sum("after").alias("ends")).first()
    out = {"abbreviations": set(), "starters": set()}
    if not total["n"]:
        return out
    n = float(total["n"])
    if 0 < (total["dots"] or 0) < n:
        per = words.filter("type rlike '\\\\p{L}' AND NOT type rlike '[0-9]'").groupBy("type").agg(
            F.sum(F.col("dot") * F.col("n")).cast("double").alias("k"), F.sum("n").cast("double").alias("n")).filter("k > 0")
        letters = F.length(F.replace("type", F.lit("."), F.lit("")))
        inside = F.length("type") - letters
        ratio = _log_likelihood(F.col("k"), F.col("n"), F.lit(total["dots"] / n), F.lit(0.99))
        score = ratio * F.exp(-letters) * (inside + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -(F.col("n") - F.col("k")))
        found = per.select("type", score.alias("s")).filter(F.col("s") >= ABBREVIATION).orderBy(F.desc("s"), "type").limit(listed)
        out["abbreviations"] = {r["type"] for r in found.collect()}
    if 0 < (total["ends"] or 0) < n:
        p = total["ends"] / n
        per = words.filter("bare <> ''").groupBy("bare").agg(F.sum("after").cast("double").alias("k"), F.sum("n").cast("double").alias("n"))
        share = F.least(F.greatest(F.col("k") / F.col("n"), F.lit(1e-9)), F.lit(1 - 1e-9))
        ratio = _log_likelihood(F.col("k"), F.col("n"), F.lit(p), share)
        found = per.select("bare", ratio.alias("s")).filter((F.col("s") >= STARTER) & (F.col("k") / F.col("n") > p)).orderBy(F.desc("s"), "bare").limit(listed)
        out["starters"] = {r["bare"] for r in found.collect()}
    return out


def _ends(word: str, following: str, model: dict[str, set[str]]) -> bool:
    """Whether a sentence ends with ``word``, which ends with a stop."""
    core, after = word.lstrip(_OPEN).rstrip(_CLOSE), following.lstrip(_OPEN)
    if core.endswith(("!", "?")):
        return True
    if not after[:1].isupper() and not after[:1].isdigit():
        return False
    starts = after.rstrip(_CLOSE + ".,;:!?…").lower() in model["starters"] and after[:1].isupper()
    if core.endswith(("..", "…")):
        return after[:1].isupper()
    stem = core[:-1].lower()
    initial = len(core) == 2 and core[0].isupper()
    number = stem.replace(".", "").replace(",", "").isdigit()
    if initial:
        return False
    if stem in model["abbreviations"] or "." in stem and not number:
        return starts
    if number:  # an ordinal or the end of a number
        return starts or not after[:1].isdigit()
    return True


def sentences(text: str, model: dict[str, set[str]]) -> list[str]:
    """The sentences of a text, white space around them dropped. A blank line ends one, too."""
    out: list[str] = []
    for part in re.split(r"\n\s*\n", text):
        word = _WORD.search(part)
        if not word:
            continue
        start, last = word.start(), len(part.rstrip())
        for m in _STOP.finditer(part):
            begin, end = m.span()
            if end == last:
                break
            while begin > start and not part[begin - 1].isspace():
                begin -= 1
            following = _WORD.search(part, end)
            if _ends(part[begin:end], following.group(), model):
                out.append(part[start:end])
                start = following.start()
        out.append(part[start:last])
    return out


def split_sentences(df: DataFrame, model: dict[str, set[str]], col: str = "text", out: str = "sentences") -> DataFrame:
    """``df`` with the array of each text's sentences."""
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([sentences(t, model) if t is not None else None for t in texts])

    return df.withColumn(out, split(F.col(col).cast("string")))


def chunk_sentences(df: DataFrame, model: dict[str, set[str]], col: str = "content", size: int = 256, out: str = "chunks") -> DataFrame:
    """``df`` with chunks of whole sentences, up to ``size`` word-and-punctuation tokens each; a
    longer sentence is cut at the size. Sentences of a chunk are joined by a space."""
    token = re.compile(r"\w+|[^\w\s]")

    @F.pandas_udf("array<string>")
    def chunk(texts: pd.Series) -> pd.Series:
        rows = []
        for t in texts:
            found, held, n = [], [], 0
            for s in sentences(t or "", model):
                k, pieces = len(token.findall(s)), [s]
                if k > size:
                    ends = [m.end() for m in token.finditer(s)][size - 1::size]
                    pieces = [s[a:b].strip() for a, b in zip([0, *ends], [*ends, len(s)]) if s[a:b].strip()]
                for p in pieces:
                    k = len(token.findall(p)) if len(pieces) > 1 else k
                    if held and n + k > size:
                        found.append(" ".join(held))
                        held, n = [], 0
                    held.append(p)
                    n += k
            rows.append([*found, " ".join(held)] if held else found)
        return pd.Series(rows)

    return df.withColumn(out, chunk(F.col(col).cast("string")))
