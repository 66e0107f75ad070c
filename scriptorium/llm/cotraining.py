"""Quality classifier by co-training of a content view and a metadata view.

The content view sees only the text (``content_features``: repetition, symbol
runs, case, table cells, line structure and so on), the metadata view only the
record's other columns (``metadata_features``: language, source, length). Each
view has a logistic classifier. In every round each classifier labels the
unlabelled pool, and the labels it is confident of (a calibrated probability
beyond ``confident``) join the *other* view's training rows; both are then
trained again. At the end each view is calibrated on labelled rows that took
no part in training, and a last logistic model of the two calibrated log odds
gives the score of every document.

Fitting uses bounded samples (``sample_rows`` labelled texts and as many
unlabelled ones, those with the smallest hashes; the bound is a parameter).
Scoring covers all documents, whole texts, in one pass without a shuffle.

Defined cases: a null text is an empty one; a text without words scores 0 (it
is rejected). Null metadata is a value of its own. Several labels of one
document count as good if one does; null labels are ignored, equal texts train
once. If all labels agree, or there is none, every text with words scores that
rate (1 without labels).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, text_key, text_or_empty, texts_of
from .toxicity import logistic

RUNS = re.compile(r"([^\w\s])\1")
CELLS = re.compile(r"(?<!\S)[^\w\s](?!\S)")
ALNUM = re.compile(r"\w+")
DIGITS = re.compile(r"[0-9]+")
STOPS = re.compile(r"[.!?](?!\S)")
N_CONTENT = 14
#: hashed categories of the metadata view
CATEGORIES = 64


# ---------------------------------------------------------------- views
def content_features(text: str) -> list[float]:
    """Numbers in about [0, 1] that describe the whole text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * N_CONTENT
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    lower = text.lower()
    if len(lower) == size:
        upper = int((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                     != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)).sum())
    else:
        upper = sum(map(str.isupper, text))
    letters = sum(map(len, ALNUM.findall(text)))
    printed = sum(map(len, words))
    return [
        min(np.log1p(n) / 10, 1.5), min(printed / n / 10, 3.0), len(counts) / n, again / n,
        max(counts.values()) / n, upper / printed, min(upper / printed * 10, 1.0), 1 - letters / printed,
        min(len(RUNS.findall(text)) / n, 2.0), min(len(CELLS.findall(text)) / n, 1.0),
        sum(map(len, DIGITS.findall(text))) / printed, min(len(STOPS.findall(text)) / n, 1.0),
        len(set(lines)) / len(lines), min(len(lines) / n * 5, 1.0)]


def metadata_features(lang, source, n_chars) -> np.ndarray:
    """Length of the record and hashed one-hot columns of language and source."""
    out = np.zeros((len(lang), 2 * CATEGORIES + 2))
    rows = np.arange(len(lang))
    for j, col in enumerate((lang, source)):
        slot = np.array([zlib.crc32(str(v).encode()) % CATEGORIES if v is not None else CATEGORIES - 1 for v in col], dtype=int)
        out[rows, j * CATEGORIES + slot] = 1.0
    size = np.array([float(v) if v is not None and v == v else 0.0 for v in n_chars])
    out[:, -2] = np.log1p(np.maximum(size, 0)) / 10
    out[:, -1] = size < 50
    return out


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _content_design(x: np.ndarray) -> np.ndarray:
    """The features, and how far each lies beyond small values (symbols, runs
    and repeats matter from their first traces on)."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0)), x * x])


# ---------------------------------------------------------------- fitting
def cotrain(content: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_content: np.ndarray, pool_meta: np.ndarray,
            rounds: int = 5, confident: float = 0.97, grow: float = 0.1) -> dict | None:
    """Weights of both views, their calibrations and the combination. ``y`` is 0
    or 1; a third of the labelled rows is kept for calibration. Returns None
    where the labels do not hold both classes in both parts."""
    keep = np.arange(len(y)) % 3 == 0
    if any(len(np.unique(y[part])) < 2 for part in (keep, ~keep)):
        return None
    views, pools = (content, meta), (pool_content, pool_meta)
    extra = [(np.zeros(0, int), np.zeros(0)) for _ in views]  # pool rows and labels given to each view

    def train(v):
        at, labels = extra[v]
        x = np.vstack([views[v][~keep], pools[v][at]])
        w = logistic(x, np.append(y[~keep], labels), ridge=0.5)
        return w, logistic(_odds(views[v][keep], w)[:, None], y[keep], ridge=1e-2)

    models = [train(v) for v in (0, 1)]
    for _ in range(rounds):
        told = []
        for v in (0, 1):
            w, cal = models[v]
            p = 1 / (1 + np.exp(-_odds(_odds(pools[v], w)[:, None], cal)))
            sure = np.maximum(p, 1 - p)
            at = np.flatnonzero(sure >= confident)
            # each round admits a share of the pool, surest first, class by class
            most = max(1, int(len(p) * grow))
            picked = [c[np.argsort(-sure[c], kind="stable")[:most]] for c in (at[p[at] >= 0.5], at[p[at] < 0.5])]
            told.append((np.concatenate(picked), np.concatenate([np.ones(len(picked[0])), np.zeros(len(picked[1]))])))
        extra = [told[1], told[0]]
        models = [train(v) for v in (0, 1)]
    both = np.column_stack([_odds(_odds(views[v][keep], models[v][0])[:, None], models[v][1]) for v in (0, 1)])
    return {"views": models, "both": logistic(both, y[keep], ridge=1e-2)}


def predict(model: dict, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
    both = np.column_stack([_odds(_odds(x, w)[:, None], cal) for x, (w, cal) in zip((content, meta), model["views"])])
    return 1 / (1 + np.exp(-_odds(both, model["both"])))


def _described(batches):
    for b in slices(batches, "text"):
        x = [content_features(t) for t in texts_of(b, "text")]
        flat = pa.array(np.asarray(x, dtype=np.float64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * N_CONTENT, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "lang", "source", "n_chars", "label")), lists],
                                         names=["key", "lang", "source", "n_chars", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality",
        sample_rows: int = 20_000, rounds: int = 5) -> tuple[dict | None, float]:
    """(model, rate of good labels). About ``sample_rows`` labelled and
    ``sample_rows`` unlabelled texts take part."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .filter("label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label")))
    stats = marked.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    n_docs, n_marked = docs.count(), stats["n"]
    if not n_marked:
        return None, 1.0
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), text_or_empty(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
                       F.col(size_col).cast("double").alias("n_chars"))
    scale = 1_000_000_000
    draw = F.pmod(F.xxhash64("key"), F.lit(scale))

    def below(want, have):  # the same share of texts whatever the size of the input
        return draw < int(scale * min(1.0, want / max(have, 1)))

    known = rows.filter(below(sample_rows, n_marked)).join(marked.hint("shuffle_hash"), "id")
    pool = (rows.filter(below(sample_rows, n_docs - n_marked)).join(marked.select("id"), "id", "left_anti")
            .withColumn("label", F.lit(None).cast("int")))
    cols = ["key", "lang", "source", "n_chars", "label", "text"]
    sample = known.select(cols).unionByName(pool.select(cols))
    sample = staged(sample.mapInArrow(_described, "key binary, lang string, source string, n_chars double, label int, x array<double>"),
                    "quality-sample")
    once = sample.groupBy("key").agg(*[F.max_by(c, F.coalesce("label", F.lit(-1))).alias(c) for c in ("lang", "source", "n_chars", "x")],
                                     F.max("label").alias("label"))
    pdf = once.orderBy(F.xxhash64("key"), "key").limit(4 * sample_rows).toPandas()
    if not len(pdf):
        return None, float(stats["rate"])
    x = _content_design(np.vstack(pdf["x"].to_numpy()))
    meta = metadata_features(*(pdf[c].where(pdf[c].notna(), None).tolist() for c in ("lang", "source", "n_chars")))
    is_known = pdf["label"].notna().to_numpy()
    y = pdf["label"].to_numpy(dtype=float, na_value=0.0)[is_known]
    return cotrain(x[is_known], meta[is_known], y, x[~is_known], meta[~is_known], rounds), float(stats["rate"])


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality",
           sample_rows: int = 20_000) -> Column:
    """The score as a column of ``docs``."""
    model, rate = fit(docs, labels, id_col, text_col, lang_col, source_col, size_col, label_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        x = np.array([content_features(t or "") for t in text]).reshape(-1, N_CONTENT)
        words = x[:, 0] > 0
        if shared.value is None:
            return pd.Series(np.where(words, rate, 0.0))
        meta = metadata_features(*(c.astype(object).where(c.notna(), None).tolist() for c in (lang, source, n_chars)))
        return pd.Series(np.where(words, predict(shared.value, _content_design(x), meta), 0.0))

    return score(F.col(text_col).cast("string"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"),
                 F.col(size_col).cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """``id, score, predicted`` (1 good, 0 rejected) for every row."""
    scored = docs.select(F.col(id_col), scorer(docs, labels, id_col, **columns).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
