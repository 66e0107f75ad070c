"""Language by compression, filter audit and whitening: awkward rows, brute
force and held-out labels."""

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import filter_diagrams, whitening, zstd_language
from scriptorium.llm.common import table
from scriptorium.llm.queries import QUERIES, SQL

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "key", "text ", "part", "mask", "words", "held_out", "n", "good", "vec", "first", "share", "component"]
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
GOOD = "The river runs past the old town and the mill. People walk there in the evening, when it is cool."
FEIN = "Der Fluss zieht an der alten Stadt und an der Mühle vorbei. Dort gehen die Leute abends, wenn es kühl ist."
ROWS = [
    (4, GOOD, "en", "a", 10), (4, GOOD, "en", "a", 10), (2, GOOD, "de", None, None), (3, None, "en", "a", 0), (5, GOOD, None, "a", 1),
    (6, "", None, "b", 0), (7, "  \n\t ", "", "b", 5), (8, LONG, "en", "a", len(LONG)), (None, GOOD, "en", "c", 3),
    (None, None, None, None, None), (9, FEIN, "de", "c", 3), (10, "a\0b \x01 #'quoted' it's <|endoftext|> ▁x   y", "de", "c", 9),
    (11, "ONE two 12345 ² ½", "en", "a", 3), (12, "日本語のテキスト 🦙 ﬀ", "ja", "ä", 9), (13, "12 34 ² !?", "en", "a", 3),
    (14, "$ " + "x " * 120, "en", "a", 3), (14, "A B C", "en", "a", 3), (15, " ".join(map(str, range(100))), "de", "a", 1)]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(ROWS, DOC)
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(f"x{i}"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (2, 1, 1), (2, 0, None), (3, 0, 0), (8, 0, 1), (8, None, None), (None, 1, 1), (14, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("id", F.lit("x"))


# ---------------------------------------------------------------- filter audit
def masks_by_hand(rows):
    out = []
    for i, t, part, *_ in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search("[#$%&*|]", t)), copy]
        out.append((part or "", sum(f << k for k, f in enumerate(fails)), i))
    return out


def audit_by_hand(masks, good, toxic):
    """Apply every order to the documents, one after the other."""
    out = {}
    for part in {m[0] for m in masks}:
        docs = [(m, i) for p, m, i in masks if p == part]
        shapley = dict.fromkeys(range(5), 0)
        rows = {}
        for order in itertools.permutations(range(5)):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if d[0] >> f & 1]
                left = [d for d in left if not d[0] >> f & 1]
                shapley[f] += len(gone)
                all_fails = sum(m >> f & 1 for m, _ in docs)
                rows["".join("ABCDE"[x] for x in order), step + 1, f] = (
                    len(left), len(gone), all_fails - len(gone), sum(m == 1 << f for m, _ in docs),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone))
        out |= {(part, order, step): (*v, shapley[f]) for (order, step, f), v in rows.items()}
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_audit_of_awkward_rows(spark, awkward, labels):
    got = audited(filter_diagrams.filter_audit(awkward, labels))
    assert got == audit_by_hand(masks_by_hand(ROWS), {4, 2, 14}, {2, 8, 14})
    assert len(got) == 600 * len({r[2] or "" for r in ROWS})
    assert filter_diagrams.filter_audit(awkward.limit(0), labels).count() == 0
    no_labels = audited(filter_diagrams.filter_audit(awkward, labels.limit(0)))
    assert {k: v[:4] for k, v in no_labels.items()} == {k: v[:4] for k, v in got.items()}
    assert all(v[4] == v[5] == 0 for v in no_labels.values())


def test_audit_matches_sql(spark, smoke_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smoke_dir}/{t}.parquet')")
    rel = con.sql(SQL["op12_filter_diagrams"])
    df = QUERIES["op12_filter_diagrams"](spark, smoke_dir).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


@pytest.mark.parametrize("filters", [1, 2, 3, 4, 6])
def test_diagrams_of_any_number_of_filters(filters):
    rng = random.Random(filters)
    names = "ABCDEF"[:filters]
    for size in (1, 3, 2 ** filters):
        counts = {rng.randrange(2 ** filters): (rng.randrange(5), rng.randrange(3), 0) for _ in range(size)}
        rows = filter_diagrams.audit(counts, names)
        assert len(rows) == math.factorial(filters) * filters == len({(r[0], r[1]) for r in rows})
        for order, step, kept, removed, *_ in rows:
            before = sum(1 << names.index(f) for f in order[:step - 1])
            now = 1 << names.index(order[step - 1])
            assert kept == sum(c[0] for m, c in counts.items() if not m & (before | now))
            assert removed == sum(c[0] for m, c in counts.items() if m & now and not m & before)


def test_diagram_shares_equal_parts():
    """Filters that fail independently of each other need one node a level."""
    d = filter_diagrams.Diagram({m: (1,) for m in range(32)}, 5)
    assert [len(level) for level in d.levels] == [1] * 5
    for level in filter_diagrams.adjacent_swaps(5):
        d.swap(level)
        assert [len(x) for x in d.levels] == [1] * 5 and d.weight(d.root) == (32,)


# ---------------------------------------------------------------- language
def test_languages_of_awkward_rows(spark, awkward):
    rows = zstd_language.identify(awkward).collect()
    assert len(rows) == len(ROWS)
    learned = {r[2] for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[2] is not None and zstd_language.LETTER.search(r[1] or "")}
    text = {}
    for i, t, *_ in ROWS:
        text.setdefault(i, []).append(t)
    for r in rows:
        assert r.held_out == (r.id is None or zlib.crc32(str(r.id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in learned | {"und"} and r.lang_certain in (None, r.lang_pred)
        if len(text[r.id]) == 1:
            silent = not text[r.id][0] or not any(c.isalpha() for c in text[r.id][0])
            assert (r.lang_pred == "und") == silent
            assert not silent or (r.score, r.margin, r.lang_certain) == (0, 0, None)
    assert len({(r.lang_pred, r.score) for r in rows if r.id == 4}) == 1
    nothing = zstd_language.identify(awkward.limit(0))
    assert nothing.count() == 0
    unknown = zstd_language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    one = zstd_language.identify(awkward.withColumn("lang", F.lit("xx"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("xx", 1.0)}


def test_languages_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = QUERIES["op11_zstd_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert 0.25 < len(held) / len(found) < 0.42
    assert (held.lang_pred == held.lang).mean() > 0.98
    sure = held[held.lang_certain.notna()]
    assert len(sure) / len(held) > 0.95 and (sure.lang_certain == sure.lang).mean() > 0.99


def test_dictionaries_hold_a_language_each(spark):
    """Copies of a text fill a dictionary once; labels of held-out rows and the
    partitioning change nothing; bounds hold."""
    rows = [(i, GOOD if i % 2 else f"{FEIN} {i}", "en" if i % 2 else "de") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.col("doc_id") % 7 != 3
    made = zstd_language.dictionaries(df.repartition(5), learn, dict_bytes=20_000)
    assert list(made) == ["de", "en"] or list(made) == ["en", "de"]
    assert made["en"] == zstd_language.plain(GOOD) and 10_000 < len(made["de"]) <= 20_000
    other = df.withColumn("lang", F.when(learn, F.col("lang")).otherwise("fr")).coalesce(1)
    assert zstd_language.dictionaries(other, learn, dict_bytes=20_000) == made
    small = zstd_language.dictionaries(df, learn, total_bytes=4_000)
    assert all(len(v) <= 2_000 for v in small.values())
    assert len(zstd_language.dictionaries(df, learn, max_languages=1)) == 1


def test_narrow_margins_are_rejected():
    assert zstd_language.judged(np.array([100.0, 90.0, 120.0]))[0] == 1
    best, score, margin = zstd_language.judged(np.array([50.0, 50.0]))
    assert (best, score, margin) == (0, 0.5, 0.0)
    assert zstd_language.judged(np.array([7.0])) == (0, 1.0, 1.0)
    assert zstd_language.judged(np.array([1.0, 9_000.0]))[1] == pytest.approx(1.0)


# ---------------------------------------------------------------- whitening
def by_hand(vectors, k=4):
    """Plain numpy over the distinct integer vectors; exact deviations."""
    x = np.floor(256 * np.array(vectors, dtype=np.float32).astype(np.float64))
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    v = centred.T @ centred / n
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, dev, (x - s / n) @ vector[:, :k] / np.sqrt(value[:k]), value[:k] / np.trace(v)


def whitened(df, **kw):
    rows = whitening.whiten(df, **kw).collect()
    assert all(r.identity_error <= 1e-4 for r in rows)
    return rows


def agree(rows, ids, vectors, k=4):
    n, dev, white, explained = by_hand(vectors, k)
    got = {(r.id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    table_ = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    table_ *= np.sign((table_ * white).sum(axis=0))
    assert np.abs(table_ - white).max() < 1e-9
    for r in rows:
        assert r.n == n and r.deviation == dev[ids.index(r.id)]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(500, 12)) @ np.diag(np.linspace(0.2, 2, 12)) + 3).astype(np.float32)
    vectors[400:] = vectors[:100]  # repeats count once in the fit
    rows = list(zip(range(500), vectors.tolist()))
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
        agree(whitened(df), list(range(500)), vectors)


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i % 5) - 2, 1.0 + (i % 3) / 256, -0.0]) for i in range(60)]
    bad = [(200, None), (300, []), (400, [1.0, None, 2.0, 0.0]), (500, [nan, 1.0, 1.0, 0.0]), (600, [inf, 1.0, 1.0, 0.0]), (700, [1.0]), (800, [3e38, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(f"x{i}"))
    rows = whitened(df)
    agree(rows, list(range(60)), [v for _, v in good], k=3)  # the last dimension does not vary
    nameless = df.withColumn("vec_id", F.when(F.col("vec_id") > 50, F.lit(None)).otherwise(F.col("vec_id")))
    assert sum(r.id is None for r in whitened(nameless)) == 9 * 3
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 5")).count() == 0  # one distinct vector has no direction
    two = whitened(df.filter("vec_id in (5, 6)"))
    assert [(r.component, round(abs(r.whitened), 12)) for r in two] == [(1, 1.0)] * 2


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e15, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 7.0])], "vec_id long, embedding array<float>")
    assert {(r.id, r.deviation) for r in whitened(df)} >= {(1, None)}
    y, off = np.array([[3.0, -5.0]]), np.array([7, 2 ** 40], dtype=object)
    assert whitening.deviations(y, 10, off) == [None]
    assert whitening.deviations(y, 10, np.array([7, 2 ** 30], dtype=object)) == [23 ** 2 + (50 + 2 ** 30) ** 2]
    assert whitening.deviations(y, 10, np.array([7, 2], dtype=object)) == [23 ** 2 + 52 ** 2]


def spectrum(values, seed=0):
    """A symmetric matrix with these eigenvalues, and its eigenvectors."""
    rng = np.random.default_rng(seed)
    q = whitening._orthonormal(np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(whitening.WIDE))
    a = (q * np.array(values, dtype=whitening.WIDE)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("values,tolerance", [
    (np.linspace(5, 1, 40), 1e-16), (1 - np.arange(40) * 1e-9, 1e-9), (10.0 ** -np.arange(0, 6, 0.25), 1e-12),
    ([1, 1 - 1e-11, 1 - 2e-11, 0.5, 0.5 - 1e-10, 0.1, 0.05, 0.01], 1e-7)])
def test_eigenvectors_of_clusters(values, tolerance):
    """Eigenvalues far closer than float32 tells apart."""
    a, q = spectrum(values)
    value, x = whitening.refined_eigenvectors(a)
    assert np.abs(value - np.array(values, dtype=whitening.WIDE)).max() < 1e-17 * max(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(x * np.sign((x * q).sum(axis=0)) - q).max() < tolerance


def test_eigenvectors_of_equal_eigenvalues():
    a, _ = spectrum([3, 3, 3, 1, 1, 0.5, 0, 0])
    value, x = whitening.refined_eigenvectors(a)
    assert np.abs(a @ x - x * value).max() < 1e-17 and np.abs(x.T @ x - np.eye(8)).max() < 1e-17
    assert whitening.refined_eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
