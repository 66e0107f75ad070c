"""Every operator on awkward rows: nulls in any column, empty, blank and very
long texts, repeated rows, ties, other columns with clashing names, no rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import (cotraining, curriculum, dom_model, hilbert_shards, learned_partitions, norm_buckets, probminhash,
                             token_blocks, toxicity, unigram_pieces)
from scriptorium.llm.common import shared_path
from scriptorium.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "key", "hash", "size", "score", "label", "rank", "root", "hub", "part", "ids", "start", "grp", "rep", "position", "block"]
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
GOOD = "The river runs past the old town and the mill. People walk there in the evening, when it is cool. Nobody hurries."
ROWS = [
    (1, GOOD, "en", "a", 10), (1, GOOD, "en", "a", 10), (2, GOOD, "fr", None, None), (3, None, "en", "a", 0),
    (4, "", None, "b", 0), (5, "  \n\t ", "en", "b", 5), (6, LONG, "en", "a", len(LONG)), (None, "no id here at all my friend", "en", "c", 3),
    (None, None, None, None, None), (7, "one", "en", "c", 3), (8, "a\0b \x01 'quoted' it's <|endoftext|> ▁x   y", "de", "c", 9),
    (9, "one", "en", "a", 3), (10, "日本語のテキスト 🦙 ﬀ", "ja", "ä", 9)]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(ROWS, DOC)
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(f"x{i}"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 0, 0), (6, 0, 1), (6, None, None), (7, 1, 1), (9, 0, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_tokens(spark, awkward, nothing):
    path = shared_path(spark, "test-tokens")
    bpe = tokenizer_path("byte_bpe_50k.json")
    token_blocks.write_tokens(awkward, path, bpe)
    got = token_blocks.read_documents(spark, path).orderBy("start").collect()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe)
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert [r.id for r in got] == [r[0] for r in want]
    start = 0
    for g, r in zip(got, want):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        assert (g.start, g.ids) == (start, ids)
        start += len(ids)
    stream = [i for g in got for i in g.ids]
    part = token_blocks.read_range(spark, path, 1000, 3500).orderBy("position").collect()
    assert [(r.position, r.id) for r in part] == list(zip(range(1000, 3500), stream[1000:3500]))
    digest = {r.start: r.ids_crc32 for r in token_blocks.document_digests(spark, path).collect()}
    assert all(digest[g.start] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in g.ids)) for g in got)
    path = shared_path(spark, "test-tokens")
    token_blocks.write_tokens(nothing, path, bpe)
    assert token_blocks.document_digests(spark, path).count() == 0


def test_quality(awkward, nothing, labels, no_labels):
    for known in (labels, no_labels):
        rows = cotraining.quality_scores(awkward, known).collect()
        assert len(rows) == len(ROWS)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert all(r.predicted == 0 for r in rows if r.doc_id in (3, 4, 5))  # no words
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert cotraining.quality_scores(nothing, labels).count() == 0


def test_toxicity(awkward, nothing, labels, no_labels):
    for known in (labels, no_labels):
        rows = toxicity.toxicity_scores(awkward, known).collect()
        assert len(rows) == len(ROWS)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        for r in rows:
            assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.toxicity_scores(nothing, labels).count() == 0


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(awkward, nothing, law):
    rows = hilbert_shards.assign_shards(awkward, 4, law).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(4))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r.id, r.size, r.text_crc32) for r in rows} == {
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    assert hilbert_shards.assign_shards(nothing, 4, law).count() == 0


def test_pieces(awkward, nothing):
    path = tokenizer_path("piece_bpe_32k.model")
    ids = unigram_pieces.encode_texts(awkward, path, out="codes")
    back = unigram_pieces.decode_ids(ids, path, ids_col="codes", out="again").collect()
    assert sorted((r.text or "") for r in back) == sorted(r.again for r in back)
    assert all((r.text or "") == r.again for r in back)
    assert all(r.same for r in unigram_pieces.round_trip(awkward, path).collect())
    assert unigram_pieces.round_trip(nothing, path).count() == 0


def test_near_duplicates(awkward, nothing):
    rows = probminhash.near_duplicates(awkward).collect()
    assert len(rows) == len(ROWS)
    classes = {}
    for r in rows:
        classes.setdefault(r.doc_id, set()).add((r.class_id, r.class_size))
    assert classes[1] == classes[2] == {(1, 3)}
    assert classes[7] == classes[9] == {(7, 2)}
    assert classes[3] == classes[4] == {(3, 3)}  # null and empty are one text, with a null id among them
    assert classes[5] == {(5, 1)}
    kept = probminhash.one_per_group(awkward)
    assert kept.columns == awkward.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    assert got == [(False, 0), (True, 1), (True, 3), (True, 5), (True, 6), (True, 7), (True, 8), (True, 10)]
    assert probminhash.near_duplicates(nothing).count() == 0
    assert probminhash.one_per_group(nothing).count() == 0


def test_mix(awkward, nothing):
    plan = curriculum.plan_mix(awkward).collect()
    assert len(plan) == len(ROWS)
    assert all(r.passes == 0 for r in plan if r["size"] == 0)
    assert all(0 <= r.passes <= 3 for r in plan)
    order = curriculum.training_order(awkward)
    assert order.columns == awkward.columns
    assert order.count() == sum(r.passes for r in plan)
    assert curriculum.plan_mix(nothing).count() == 0
    assert curriculum.training_order(nothing).count() == 0


def test_pages(spark, awkward, nothing):
    rows = [(1, "http://x/en/1", "<article><p>" + GOOD), (2, None, None), (3, "", ""), (None, "http://x/en/6", "<p>" + LONG),
            (1, "http://x/en/1", "<article><p>" + GOOD), (4, "u", "<<<>>><p a='"), (5, "u", "<div>" * 3000 + "deep text that is here." + "</div>" * 10),
            (6, "http://x/99999999999999999999", "<nav>Menu</nav><article><p>It is &eacute;t&#233; &amp; more.</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = dom_model.extract_pages(pages, awkward).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == "" for r in got if r.page_id in (2, 3))
    assert {r.text for r in got if r.page_id == 1} == {GOOD}
    assert {r.text for r in got if r.page_id is None} == {LONG}
    assert {r.text for r in got if r.page_id == 6} == {"It is été & more."}
    assert dom_model.extract_pages(pages.limit(0), nothing).count() == 0


VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(0, 120)]
    rows += [(200, None), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [nan, 1.0, 1.0]), (600, [inf, 1.0, 1.0]),
             (700, [1.0]), (800, []), (None, [1.0, 1.0, 1.0]), (0, [0.0, -2.0, 1.0]), (900, [1.0, 1.0, 1.0]), (900, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], VEC)
    return df.withColumn("id", F.lit(1)).withColumn("vec", F.lit("x")).withColumn("norm", F.lit(0))


def plain(df, every, k, zero, score):
    """Brute force over the same rows."""
    import math
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding is not None and len(r.embedding) == 3
            and all(x is not None and math.isfinite(x) for x in r.embedding) and (zero or any(r.embedding))]
    out = []
    for q in {i for i, _ in rows if i % every == 0}:
        best = {}
        for own in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q:
                    s = score(own, v)
                    best[i] = min(best.get(i, s), s)
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda t: (t[1], t[0]))[:k])]
    return sorted(out)


def test_nearest(spark):
    import math
    df = vectors(spark)
    got = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in learned_partitions.nearest_neighbours(
        df, query_every=50, k=5, parts=4, target_recall=1.01).collect())
    want = [(q, n, i, round(s, 9)) for q, n, i, s in plain(df, 50, 5, False, lambda a, b: math.dist(a, b))]
    assert got == want
    few = df.filter("vec_id in (0, 1, 2)")
    assert learned_partitions.nearest_neighbours(few, k=10).filter("query_id = 0").count() == 2
    assert learned_partitions.nearest_neighbours(df.limit(0)).count() == 0


def test_products(spark):
    import math
    df = vectors(spark)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in norm_buckets.inner_product_topk(df, query_every=50, k=5, bucket=16).collect())
    want = plain(df, 50, 5, True, lambda a, b: -sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b)))
    assert got == [(q, n, i, -s) for q, n, i, s in want]
    assert norm_buckets.inner_product_topk(df.limit(0)).count() == 0


def test_products_of_repeated_rows(spark):
    """Every row k+1 times, and ids with more than k vectors."""
    import math
    rows = [(i, [float(i % 7) + i / 64, float(i % 5) - 2, 1.0]) for i in range(60)] * 6
    rows += [(i, [9.0 + j / 8, float(i % 3), 2.0]) for i in (61, 62) for j in range(7)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], VEC)
    want = plain(df, 10, 5, True, lambda a, b: -sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b)))
    for bucket in (8, 16, 1024):
        got = sorted((r.query_id, r["rank"], r.id, r.score) for r in norm_buckets.inner_product_topk(df, query_every=10, k=5, bucket=bucket).collect())
        assert got == [(q, n, i, -s) for q, n, i, s in want]


def test_nearest_of_repeated_rows(spark):
    """Every row ten times, and ids with more than k vectors."""
    import math
    rows = [(i, [float(i % 7) + i / 64, float(i % 5) - 2, 1.0]) for i in range(60)] * 10
    rows += [(i, [3.0 + j / 64, float(i % 3), 1.0]) for i in (61, 62) for j in range(9)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], VEC)
    want = [(q, n, i, round(s, 9)) for q, n, i, s in plain(df, 10, 5, False, lambda a, b: math.dist(a, b))]
    for parts, recall in ((4, 1.01), (1, 0.9)):
        got = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in learned_partitions.nearest_neighbours(
            df, query_every=10, k=5, parts=parts, target_recall=recall).collect())
        assert got == want


def test_pipeline_stages(spark, awkward, nothing, labels, no_labels, tmp_path):
    """Each stage on awkward rows, with clashing columns, and on none."""
    import corpus_pipeline
    for known, name in ((labels, "some"), (no_labels, "none")):
        d = str(tmp_path / name)
        known.withColumn("id", F.lit("clash")).write.parquet(f"{d}/labels.parquet")
        for stage, fn in corpus_pipeline.STAGES:
            if name == "none" and stage not in ("quality", "toxicity"):
                continue  # the others read no labels
            out = fn(spark, awkward, d)
            rows = out.collect()
            if stage != "pieces":
                assert out.columns == awkward.columns, stage
            ids = [r.doc_id for r in rows]
            if stage == "quality":
                assert not {3, 4, 5} & set(ids) and (name == "some" or len(ids) == sum(bool((r[1] or "").split()) for r in ROWS))
            elif stage == "toxicity":
                assert name == "some" or len(ids) == len(ROWS)
                assert ids.count(1) in (0, 2)
            elif stage == "mixing":
                assert not {3, 4, 5} & set(ids)
            elif stage == "pieces":
                assert len(ids) == len(ROWS) and all(r.same for r in rows)
            assert fn(spark, nothing, d).count() == 0, stage


def test_toxicity_moves_blocks_once_for_counts(awkward, labels, monkeypatch):
    """Beginnings and rests of words are counted in one pass over the blocks."""
    passes, counter = [], toxicity._counter
    monkeypatch.setattr(toxicity, "_counter", lambda spell: passes.append(spell) or counter(spell))
    assert toxicity.toxicity_scores(awkward, labels).count() == len(ROWS)
    assert len(passes) == 1
