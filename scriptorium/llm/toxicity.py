"""Toxicity by class-conditional Kneser-Ney models.

Each class c (toxic, ordinary) has a Kneser-Ney model of the beginnings of
words, where their stems are: ``^`` and the first ``STEM`` letters in lower case
(a shorter word ends with ``$``), every symbol x given all before it (h):

    P_c(x|h) = [n_c(hx) - D_c]+ / n_c(h.)  +  D_c T_c(h) / n_c(h.) P(x|h')

n_c(hx) counts the words of the class's distinct texts that begin with hx
(a word counts once a text, copies of a text count once), T_c(h) the symbols
seen after h, D_c = n1 / (n1 + 2 n2) is the absolute discount from the counts of
counts. h' is h without its first symbol. What is discounted goes to a backoff that both
classes share: its counts are continuation counts over all labelled text,

    P(x|h) = [N(.hx) - D]+ / N(.h.)  +  D T(h) / N(.h.) P(x|h')

where N(.hx) is the number of symbols that stand before hx, N(.h.) their sum over x
and T(h) the number of x; the last backoff is uniform. So an expression
that neither class knows speaks for neither, a rare one is smoothed towards
silence, and an inflection of a known word has its evidence.

The rest of a word, up to its end ``$``, has a model of the same kind: ``~``,
the ``STEM`` - 1 letters before a symbol and the symbol. So every letter of a
text takes part, and the tables stay small, which tables of whole words,
about half of them unique, do not.

A word's evidence is the difference of its two log-likelihoods. A document is
described by that difference for all its distinct words divided by their number, by the mean evidence of its ``TOP`` most toxic words and by the most
toxic word (a long ordinary text must not hide a few insults), once for the
beginnings of its words and once for the whole words. A logistic
calibration turns these into a score; it is fitted on out-of-fold values (each
half of the training rows described by the counts of the other half), so it
never sees a text described by a model that counted it.

Counts and the model are Spark aggregations and joins over all labelled
training rows; the tables are joined and never gathered. Texts become
blocks (``BLOCK_PAIRS``) that hold their distinct words once. A block asks the
model for each string that these words are spelled by once and gets the answers
back: log P_toxic / P_ordinary of its last symbol and of the weight that the classes
give to the backoff after it; the latter is the evidence of any symbol there that
training text does not show.

Defined cases: a null or empty text, or one without words, has evidence 0 and
gets the calibration's bias as its score. Very long texts are described whole; a
block ends with the text that fills it. Several labels of one document count
as toxic if one does; labels that are null are ignored. Rows are scored one by
one, so repeated rows get equal scores; a null id is held out. If no training
row is toxic, or all are, every score is that rate. Columns of other names play
no part. Empty input gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_fold, distinct_codes, slices, staged, text_key, texts_of

#: letters of a word's beginning, and symbols of each string that spells its rest
STEM = 4
TOP = 3
WORD = re.compile(r"\w+")
#: each Latin-1 character in lower case, a space for those that words do not hold
LATIN = "".join(c.lower() if WORD.match(c) else " " for c in map(chr, range(256))).encode("latin-1")
#: count columns: class (1 toxic, 0 ordinary) by training half (a, b)
GROUPS = ("n1a", "n0a", "n1b", "n0b")
#: the counts that a view of the model uses: toxic, ordinary
VIEWS = {"all": ("n1a + n1b", "n0a + n0b"), "a": ("n1a", "n0a"), "b": ("n1b", "n0b")}
FEATURES = 3
#: distinct (text, word) pairs and texts of a block, about
BLOCK_PAIRS = 2_000_000


# ---------------------------------------------------------------- inside tasks
def _parted(text: str) -> str:
    """The words of a text in lower case, parted by spaces."""
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1")
    except UnicodeEncodeError:
        return " ".join(WORD.findall(text.lower()))


def _words(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of each distinct word of each text into the distinct words, distinct
    words, number of words per text)."""
    lists = pc.ascii_split_whitespace(pa.array([_parted(t) for t in texts], pa.large_string()))
    held = pc.not_equal(lists.flatten(), "")  # before the first word and after the last
    coded = lists.flatten().filter(held).dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if not distinct:
        return codes, distinct, np.zeros(len(texts), dtype=np.int64)
    doc = pc.list_parent_indices(lists).filter(held).to_numpy()
    pairs = np.sort(doc * len(distinct) + codes)
    doc, codes = np.divmod(pairs[np.append(True, pairs[1:] != pairs[:-1])], len(distinct))
    return codes, distinct, np.bincount(doc, minlength=len(texts))


def beginnings(symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[str, np.ndarray, list[np.ndarray]]:
    """``^`` with the first symbol of a word, the first two and so on: the mark, the word of
    each string and its symbols (0 where it has ended). ``symbols`` are those of all words with
    their ``$``, ``start`` and ``length`` their places."""
    n = np.minimum(length, STEM)
    word = np.repeat(np.arange(len(n)), n)
    last = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    first = start[word]
    return "^", word, [np.where(j <= last, symbols[first + np.minimum(j, last)], 0) for j in range(STEM)]


def rests(symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[str, np.ndarray, list[np.ndarray]]:
    """``~`` with each symbol after the first ``STEM`` and the letters before it, as ``beginnings``."""
    n = np.maximum(length - STEM, 0)
    word = np.repeat(np.arange(len(n)), n)
    first = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + 1
    return "~", word, [symbols[first + j] for j in range(STEM)]


def _spelled(words: list[str], spell) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word, index into the distinct strings) of each string that spells one of
    ``words``, the distinct strings."""
    symbols = np.frombuffer("".join(w + "$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    length = np.array([len(w) + 1 for w in words], dtype=np.int64)
    mark, word, columns = spell(symbols, np.cumsum(length) - length, length)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    codes, strings = np.zeros(len(word), np.int64), np.full((1, 1), ord(mark), "<u4")
    for column in columns:  # a code point has 21 bits
        codes, distinct = pd.factorize(codes << 21 | column)
        strings = np.hstack([strings[distinct >> 21], (distinct & (1 << 21) - 1).astype("<u4")[:, None]])
    return word, codes, np.ascontiguousarray(strings).view(f"<U{strings.shape[1]}").ravel().tolist()


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _packed_words(words: list[str]) -> bytes:
    return zlib.compress("\n".join(words).encode("utf-8", "surrogatepass"), 1)


def _unpacked_words(raw: bytes) -> list[str]:
    text = zlib.decompress(raw).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def _block(number: int, held: list[tuple]) -> pa.RecordBatch:
    """One row: the rows' values, the distinct words by falling
    frequency, and per text its words (packed differences of their positions)."""
    rows, words, codes, size = zip(*held)
    start = np.cumsum([0, *map(len, words)])
    same, distinct = distinct_codes([w for x in words for w in x])
    codes, size = same[np.concatenate([c + o for c, o in zip(codes, start)])], np.concatenate(size)
    order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(size)), size)
    codes = np.sort(doc * len(order) + place[codes]) % max(len(order), 1)
    step = np.diff(codes, prepend=0)
    step[np.flatnonzero(np.diff(doc, prepend=-1))] = codes[np.flatnonzero(np.diff(doc, prepend=-1))]
    rows = pa.concat_arrays(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
         pa.array([_packed_words([distinct[i] for i in order.tolist()])], pa.binary()),
         *(pa.array([_packed(x)], pa.binary()) for x in (size, step))],
        names=["block", "rows", "words", "sizes", "steps"])


def _blocks(batches):
    """The texts of a task in blocks."""
    number, held, pairs = TaskContext.get().partitionId() << 32, [], 0
    for b in slices(batches, "text"):
        codes, words, size = _words(texts_of(b, "text"))
        held.append((b.column("row"), words, codes, size))
        pairs += len(codes) + b.num_rows
        if pairs >= BLOCK_PAIRS:
            yield _block(number, held)
            number, held, pairs = number + 1, [], 0
    if held:
        yield _block(number, held)


def _pairs(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of one row: the word of each (text, word) pair and the bounds
    of the texts."""
    size, step = _unpacked(block.column("sizes")[0].as_py()), _unpacked(block.column("steps")[0].as_py())
    bounds, total = np.append(0, np.cumsum(size)), np.cumsum(step)
    return total - np.repeat(np.append(0, total)[bounds[:-1]], size), bounds


def _one_by_one(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1)


COUNT_SCHEMA = "gram string, " + ", ".join(f"{g} long" for g in GROUPS)


def _counter(spells):
    """A task's counts of the strings that spell the words of blocks with their
    ``picks (idx, grp)``, by each of ``spells``; a row per string and block."""
    def count(batches):
        for one in _one_by_one(batches):
            codes, bounds = _pairs(one)
            group, picks = np.full(len(bounds) - 1, -1), one.column("picks").flatten()
            group[picks.field("idx").to_numpy(zero_copy_only=False)] = picks.field("grp").to_numpy(zero_copy_only=False)
            group = np.repeat(group, np.diff(bounds))
            words = _unpacked_words(one.column("words")[0].as_py())
            known = group >= 0
            per_word = np.bincount(codes[known] * 4 + group[known], minlength=4 * len(words)).reshape(-1, 4)
            used = np.flatnonzero(per_word.any(axis=1))
            words = [words[i] for i in used.tolist()]
            for word, gram, grams in (_spelled(words, spell) for spell in spells):
                if not grams:
                    continue
                table = per_word[used][word]
                yield pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string())} | {
                    g: np.bincount(gram, weights=table[:, j], minlength=len(grams)).astype(np.int64) for j, g in enumerate(GROUPS)})

    return count


def features(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text, from the evidence of its distinct words: evidence per word, mean
    evidence of its TOP most toxic words, evidence of the most toxic one. A text
    without words gets 0s."""
    out = np.zeros((len(bounds) - 1, FEATURES))
    for i in range(len(out)):
        v = value[bounds[i]:bounds[i + 1]]
        if len(v):
            top = np.maximum(np.sort(np.partition(v, len(v) - min(TOP, len(v)))[-TOP:])[::-1], 0)
            # an exact sum, so that copies of a text agree whatever block they are in
            out[i] = math.fsum(v.tolist()) / len(v), top.sum() / TOP, top[0]
    return out


# ---------------------------------------------------------------- the model
def _discount(df: DataFrame, counts: list[str]) -> list[float]:
    """Kneser-Ney discounts n1 / (n1 + 2 n2) from the counts of counts of some columns."""
    r = df.agg(*[F.sum((F.expr(c) == k).cast("long")).alias(f"{k}_{i}") for i, c in enumerate(counts) for k in (1, 2)]).first()
    out = []
    for i in range(len(counts)):
        one, two = r[f"1_{i}"] or 0, r[f"2_{i}"] or 0
        out.append(min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.75)
    return out


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows (row, text)`` as blocks, staged."""
    kind = rows.schema["row"].dataType.simpleString()
    return staged(rows.select("row", "text").mapInArrow(
        _blocks, f"block long, rows array<{kind}>, words binary, sizes binary, steps binary"), "toxic-blocks")


def _without_last(col: str) -> Column:
    return F.expr(f"substring({col}, 1, length({col}) - 1)")


def backoff(grams_: DataFrame) -> DataFrame:
    """``s, p``: the shared model's P(x|h) for every string s = hx that ends one of
    the strings ``gram`` after its first symbol."""
    ends = grams_.select("gram", F.explode(F.sequence(F.lit(2), F.length("gram"))).alias("k"))
    ends = ends.select(F.expr("substring(gram, k)").alias("s"), F.expr("substring(gram, k - 1, 1)").alias("x")).distinct()
    counts = staged(ends.groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("h", _without_last("s")), "toxic-continuations")
    d = _discount(counts, ["n"])[0]
    symbols = counts.filter("length(s) = 1").count() + 1
    contexts = counts.groupBy("h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    counts = counts.join(contexts, "h").select(
        "s", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")).alias("own"), (d * F.col("types") / F.col("total")).alias("left"))
    level = counts.filter("length(s) = 1").select("s", (F.col("own") + F.col("left") / symbols).alias("p"))
    out = level = staged(level, "toxic-backoff")
    for n in range(2, STEM + 1):
        shorter = level.select(F.col("s").alias("end"), F.col("p").alias("low"))
        level = (counts.filter(F.length("s") == n).join(shorter, F.expr("substring(s, 2)") == F.col("end"))
                 .select("s", (F.col("own") + F.col("left") * F.col("low")).alias("p")))
        level = staged(level, "toxic-backoff")
        out = out.unionByName(level)
    return out


def counts(blocks: DataFrame, train: DataFrame, spells=(beginnings, rests)) -> DataFrame:
    """``gram, h`` and the counts of ``GROUPS`` of every string that spells the words of
    the texts ``train (block, idx, grp)`` of ``blocks``, ``grp`` being the position in
    ``GROUPS``; strings of all ``spells`` in one pass, so that blocks move once."""
    picks = train.groupBy("block").agg(F.collect_list(F.struct("idx", "grp")).alias("picks"))
    chosen = blocks.drop("rows").join(picks, "block")
    return staged(chosen.mapInArrow(_counter(spells), COUNT_SCHEMA).groupBy("gram").agg(*[F.sum(g).alias(g) for g in GROUPS])
                  .withColumn("h", _without_last("gram")), "toxic-grams")


def fit(blocks: DataFrame, train: DataFrame, spell=beginnings) -> DataFrame:
    """``fitted`` to the words of texts, spelled by ``spell`` alone."""
    return fitted(counts(blocks, train, (spell,)))


def fitted(counted: DataFrame) -> DataFrame:
    """The model from the ``counts`` of strings of one kind: for every ``gram`` that
    words are spelled by and each view v, ``v`` is log P_toxic / P_ordinary of its
    last symbol and ``v_after`` that of the backoff's weight after it."""
    sides = {f"{c}_{v}": e for v, two in VIEWS.items() for c, e in zip(("t", "o"), two)}
    d = dict(zip(sides, _discount(counted, list(sides.values()))))
    contexts = staged(counted.groupBy("h").agg(
        *[F.sum(F.expr(e)).alias(f"n_{s}") for s, e in sides.items()],
        *[F.sum(F.expr(f"cast({e} > 0 as long)")).alias(f"t_{s}") for s, e in sides.items()]), "toxic-contexts")
    shared = staged(backoff(counted), "toxic-shared")

    def left(s):
        return F.when(F.col(f"n_{s}") > 0, d[s] * F.col(f"t_{s}") / F.col(f"n_{s}")).otherwise(1.0)

    def own(s):
        return F.when(F.col(f"n_{s}") > 0, F.greatest(F.expr(sides[s]) - d[s], F.lit(0.0)) / F.col(f"n_{s}")).otherwise(0.0)

    ratio = lambda f, end: [F.log(f(f"t_{v}") / f(f"o_{v}")).cast("float").alias(v + end) for v in VIEWS]
    known = (counted.join(contexts, "h").join(shared, F.expr("substring(gram, 2)") == F.col("s"))
             .select("gram", *ratio(lambda s: own(s) + left(s) * F.col("p"), "")))
    after = contexts.select(F.col("h").alias("gram"), *ratio(left, "_after"))
    return staged(known.join(after, "gram", "full").fillna(0.0), "toxic-model")  # ^ alone and ~ with letters before are contexts only


def evidence(grams: list[str], known: dict[str, tuple], view: int) -> np.ndarray:
    """log P_toxic / P_ordinary of the last symbol of each of ``grams``, from what is
    ``known`` of them and of their contexts. After an unknown context it is 0."""
    none = (0.0,) * (view + 2)
    return np.array([known[g][view] if g in known else known.get(g[:-1], none)[view + 1] for g in grams])


def described(blocks: DataFrame, model: DataFrame, views: list[str], whole: bool = False) -> DataFrame:
    """``block, idx, row, x`` of every text of ``blocks``; x holds its features
    in each of the ``views``, one after the other: by the beginnings of its words
    and, if ``whole``, after these by the whole words."""
    kind = blocks.schema["rows"].dataType.elementType.simpleString()
    columns = [c for v in views for c in (v, f"{v}_after")]
    spells = [beginnings, rests] if whole else [beginnings]

    def ask(batches):
        for one in _one_by_one(batches):
            words = _unpacked_words(one.column("words")[0].as_py())
            grams = {g for spell in spells for g in _spelled(words, spell)[2]}
            asked = sorted(grams | {g[:-1] for g in grams})
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), one.column("block")[0].as_py())), pa.array(asked, pa.string())],
                                             names=["block", "gram"])

    asked = blocks.select("block", "words").mapInArrow(ask, "block long, gram string")
    answers = (asked.join(model.select("gram", *columns), "gram").groupBy("block")
               .agg(F.collect_list(F.struct("gram", *columns)).alias("answers")))

    def describe(batches):
        for one in _one_by_one(batches):
            codes, bounds = _pairs(one)
            words = _unpacked_words(one.column("words")[0].as_py())
            got, x = one.column("answers").flatten(), []
            known = dict(zip(got.field("gram").to_pylist(), zip(*(got.field(c).to_pylist() for c in columns))))
            parts = [_spelled(words, spell) for spell in spells]
            for v in range(len(views)):
                value = np.zeros(len(words))
                for word, gram, grams in parts:
                    if grams:
                        value = value + np.bincount(word, weights=evidence(grams, known, 2 * v)[gram], minlength=len(words))
                    x.append(features(value[codes], bounds))
            x = np.hstack(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), one.column("block")[0].as_py())), pa.array(np.arange(len(x), dtype=np.int32)),
                 one.column("rows").flatten(), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))],
                names=["block", "idx", "row", "x"])

    return (blocks.join(answers, "block", "left")
            .mapInArrow(describe, f"block long, idx int, row {kind}, x array<double>"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---------------------------------------------------------------- the operator
def training_rows(blocks: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``block, idx, grp, toxic, id, key``: every distinct labelled text outside the
    held-out fold, once. Only ids and keys of texts move."""
    rows = blocks.select("block", F.posexplode("rows").alias("idx", "row")).select("block", "idx", "row.id", "row.key")
    rows = rows.filter(~F.coalesce(crc32_fold("id") == 0, F.lit(True)))
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
              .filter("toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic")))
    reps = (rows.join(marked, "id").groupBy("key")
            .agg(F.min(F.struct("id", "block", "idx")).alias("rep"), F.max("toxic").alias("toxic")))
    half = F.when(crc32_fold("rep.id") <= 2, 0).otherwise(2)
    return reps.select("rep.block", "rep.idx", (half + 1 - F.col("toxic")).cast("int").alias("grp"), "toxic", "rep.id", "key")


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", calibration_rows: int = 20_000) -> DataFrame:
    """``id, key, score`` for every row of ``docs``, ``key`` being the
    ``text_key`` of its text. The counts take all labelled training rows, the
    calibration about ``calibration_rows`` of them (those with the smallest
    hashes)."""
    row = F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    rows = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    blocks = in_blocks(rows)
    train = staged(training_rows(blocks, labels, id_col, label_col), "toxic-training")
    by_class = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    total, toxic = sum(by_class.values()), by_class.get(1, 0)
    if not 0 < toxic < total:
        return blocks.select(F.explode("rows").alias("row")).select("row.*", F.lit(toxic / total if total else 0.0).alias("score"))
    counted = counts(blocks, train)
    model = fitted(counted.filter("gram LIKE '^%'")).unionByName(fitted(counted.filter("gram LIKE '~%'")))
    part = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, calibration_rows / total))
    # about calibration_rows ids, whatever the input
    sample = staged(train.filter(part).select("id", "key", "grp", "toxic"), "toxic-sample")
    chosen = rows.join(F.broadcast(sample.select("id", "key")), (F.col("row.id") == F.col("id")) & (F.col("row.key") == F.col("key")))
    # a repeated row is described once for each time it stands there; one of them is kept
    found = described(in_blocks(chosen.select("row", "text")), model, ["b", "a"], whole=True).select("row.id", "row.key", "x").groupBy("id", "key").agg(F.first("x").alias("x"))
    sample = sample.join(found, ["id", "key"]).select("toxic", "grp", "x", "key").orderBy("key").toPandas()
    x = np.vstack([np.zeros((0, 4 * FEATURES)), *sample["x"]]).reshape(-1, 2, 2 * FEATURES)
    x = x[np.arange(len(x)), sample["grp"].to_numpy() // 2]  # described by the other half
    weights = logistic(x, sample["toxic"].to_numpy(float)).tolist()
    z = sum((F.col("x")[j] * w for j, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    z = F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))
    return staged(described(blocks, model, ["all"], whole=True).select("row.*", (1 / (1 + F.exp(-z))).alias("score")), "toxic-scores")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", **bounds) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``."""
    held = F.coalesce(crc32_fold("id") == 0, F.lit(True))
    return scores(docs, labels, id_col, text_col, label_col, **bounds).select(
        F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def harmless(docs: DataFrame, labels: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` whose score is below one half; equal texts have
    equal scores, so the toxic ones are found again by their key."""
    scored = scores(docs, labels, text_col=text_col, **names)
    toxic = staged(scored.filter("score >= 0.5").select(F.col("key").alias("toxic text")).distinct(), "toxic-keys")
    return docs.join(toxic, text_key(text_col) == toxic["toxic text"], "left_anti")
