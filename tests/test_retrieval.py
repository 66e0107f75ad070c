import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import dense, sparse

WORD = re.compile(r"[^\W]+|[^\w\s]", re.UNICODE)


def toks(t):
    return re.findall(r"[\w]+|[^\w\s]", t)


def py_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    corpus = [toks(d) for d in docs]
    n = len(corpus)
    avgdl = sum(map(len, corpus)) / n
    df = {}
    for d in corpus:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: (floor if v < 0 else v) for w, v in idf.items()}
    out = []
    for d in corpus:
        s = 0.0
        for q in toks(query):
            tf = d.count(q)
            s += idf.get(q, 0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avgdl))
        out.append(s)
    return out


def py_tfidf(docs, query):
    def terms(t):
        return re.findall(r"\w{2,}", t.lower())
    corpus = [terms(d) for d in docs]
    n = len(corpus)
    df = {}
    for d in corpus:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + f)) + 1 for w, f in df.items()}

    def vec(ts):
        v = {w: ts.count(w) * idf[w] for w in set(ts) if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}
    q = vec(terms(query))
    return [sum(q.get(w, 0) * x for w, x in vec(d).items()) for d in corpus]


def topk(scores, k):
    order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], 6), i))
    return [(i, round(scores[i], 6)) for i in order[:k]]


def build(spark, pages, queries):
    docs = [(p, i, i, t) for p, texts in pages.items() for i, t in enumerate(texts, start=100 * p)]
    d = spark.createDataFrame(docs, "page_id long, doc_id long, doc_pos long, content string")
    q = spark.createDataFrame(queries, "query_id long, page_id long, query string")
    return d, q


PAGES = {
    1: ["the cat sat on the mat", "a dog and a cat", "nothing here at all", "cat cat cat", "", "mat."],
    2: ["same words", "same words"],   # every term in every doc: negative idf, negative average
    3: ["alpha beta", "gamma delta", "alpha"],
}
QUERIES = [(1, 1, "the cat"), (2, 1, "zebra"), (3, 2, "same words words"), (4, 3, "alpha delta"), (5, 1, "cat mat")]


def test_bm25_and_padding_match_python(spark):
    d, q = build(spark, PAGES, QUERIES)
    got = {}
    for r in sparse.retrieve(q, d, k=5, method="BM25").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for qid, page, text in QUERIES:
        exp = topk(py_bm25(PAGES[page], text), 5)
        exp = [(rank, 100 * page + i, s) for rank, (i, s) in enumerate(exp, start=1)]
        assert sorted(got[qid]) == exp, (qid, got[qid], exp)


def test_tfidf_matches_python(spark):
    d, q = build(spark, PAGES, QUERIES)
    got = {}
    for r in sparse.retrieve(q, d, k=3, method="tfidf").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for qid, page, text in QUERIES:
        exp = topk(py_tfidf(PAGES[page], text), 3)
        exp = [(rank, 100 * page + i, s) for rank, (i, s) in enumerate(exp, start=1)]
        assert sorted(got[qid]) == exp, (qid, got[qid], exp)


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
def test_index_ranks_like_the_exhaustive_search(spark, tmp_path, method):
    """Negative weights, padding, queries without a match; a large article, of
    which only the blocks that can reach the top k are read."""
    rnd = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    large = [" ".join(rnd.choice(vocab, 12, p=np.arange(60, 0, -1) / 1830)) for _ in range(240)]
    large[17] = "rare gem " * 3
    large[230] = "rare gem w1"
    pages = dict(PAGES) | {4: large}
    queries = QUERIES + [(10, 4, "rare gem w0"), (11, 4, "w0 w1 w2"), (12, 4, "nothing"), (13, 4, "w59 w58")]
    d, q = build(spark, pages, queries)
    order = lambda df: sorted(tuple(r) for r in df.collect())
    for block_docs in (8,):
        path = str(tmp_path / f"{method}{block_docs}")
        sparse.build_index(d.repartition(3), path, method, block_docs=block_docs)
        for k in (2, 50):
            got = order(sparse.search_index(q, path, k, method))
            assert got == order(sparse.retrieve(q, d, k=k, method=method)), (method, block_docs, k)
        _, read = sparse.index_scores(q, spark, path, 2, method)
        blocks = spark.read.parquet(path + "/docs").filter("page_id = 4").select("blk").distinct().count()
        assert 0 < read.filter("query_id = 10").count() < blocks / 2


def test_postings_cut_like_spark(spark):
    """Tokens and terms counted in batches equal the column expressions."""
    texts = ["a b_c 12 ½ ² ǅ x", "Straße ÉCOLE i\u0307 日本語 テキスト!", None, "", "\x85 \u3000 a\x1cb", "a,b;;c", "\0 nul\0l"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").withColumn("page_id", F.lit(1))
    for cut, column in sparse.CUT_COLUMNS.items():
        want = sorted((i, t, n) for i, ts in df.select("doc_id", column(F.coalesce("content", F.lit(""))).alias("t")).collect()
                      for t, n in {t: ts.count(t) for t in ts}.items())
        rows = sparse.postings(df, cut).collect()
        assert sorted((r.doc_id, r.term, r.tf) for r in rows) == want
        whole = sparse.postings(df, cut, lengths=True).filter("term is null")
        assert whole.count() == len(texts)


def test_retrieve_indices_only(spark):
    d, q = build(spark, PAGES, QUERIES)
    cols = sparse.retrieve(q, d, k=2, method="bm25", indices=True).columns
    assert cols == ["query_id", "page_id", "rank", "doc_id"]


def test_dense_topk_blocks_match_numpy(spark):
    rnd = np.random.default_rng(3)
    rows, qrows = [], []
    for page in range(3):
        n = [50, 7, 1][page]
        for c in range(n):
            rows.append((page, page * 1000 + c, rnd.normal(size=8).astype(np.float32).tolist()))
        for s in range(4):
            qrows.append((page, s, rnd.normal(size=8).astype(np.float32).tolist()))
    chunks = spark.createDataFrame(rows, "page_id long, chunk_id long, embedding array<float>")
    qs = spark.createDataFrame(qrows, "page_id long, sec_pos long, query_embedding array<float>")
    got = {}
    for r in dense.dense_topk(qs, chunks, k=10, keep=5, block_rows=8).collect():
        got.setdefault((r.page_id, r.sec_pos), []).append((r.rank, r.chunk_id, r.score))
    for page, s, qv in qrows:
        cand = [(cid, sum(float(a) * float(b) for a, b in zip(qv, v))) for p, cid, v in rows if p == page]
        cand.sort(key=lambda x: (-round(x[1], 6), x[0]))
        exp = [(i + 1, cid, round(sc, 6)) for i, (cid, sc) in enumerate(cand[:5])]
        assert sorted(got[(page, s)]) == exp


def test_dense_topk_of_a_hot_article_and_wide_vectors(spark):
    """One article with most vectors, 768 dimensions, equal scores across blocks,
    vectors of two lengths and with nulls; any id type."""
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(40, 768)).astype(np.float32)
    rows = [("hot" if i < 300 else f"p{i % 5}", f"c{i:03d}", base[i % 40].tolist()) for i in range(330)]
    rows += [("hot", "x1", [1.0, 2.0]), ("hot", "x2", None), ("hot", "x3", [1.0] * 767 + [None])]
    asked = [("hot", s, rnd.normal(size=768).astype(np.float32).tolist()) for s in range(5)] + [("p1", 9, base[0].tolist()), ("none", 1, [1.0])]
    asked += [("hot", 10, [1.0, 1.0]), ("hot", 11, None)]
    chunks = spark.createDataFrame(rows, "page string, cid string, v array<float>")
    qs = spark.createDataFrame(asked, "page string, qid int, q array<float>")
    names = {"key": "page", "qid": "qid", "cid": "cid", "qvec": "q", "cvec": "v"}
    for block_rows in (16, 1024):
        got = {}
        for r in dense.dense_topk(qs, chunks, k=20, keep=None, block_rows=block_rows, **names).collect():
            got.setdefault((r.page, r.qid), []).append((r["rank"], r.cid, r.score))
        for page, qid, q in asked:
            cand = []
            for p, c, v in rows:
                if p == page:
                    whole = q is not None and v is not None and len(v) == len(q) and None not in v
                    cand.append((c, round(float(np.dot(np.array(q, float), np.array(v, float))), 6) if whole else None))
            cand.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
            want = [(i + 1, c, s) for i, (c, s) in enumerate(cand[:20])]
            assert [(a, b) for a, b, _ in sorted(got.get((page, qid), []))] == [(a, b) for a, b, _ in want]
            assert all(x[2] == (None if y[2] is None else pytest.approx(y[2], abs=2e-6)) for x, y in zip(sorted(got.get((page, qid), [])), want))
    assert dense.dense_topk(qs.limit(0), chunks, **names).count() == 0


def test_nest_coverage_and_section_query(spark):
    ranked = spark.createDataFrame(
        [(1, 0, "Intro", 1, 10), (1, 0, "Intro", 2, 11), (1, 1, "Life", 1, 11), (2, 0, "A", 1, 5)],
        "page_id long, sec_pos long, section string, rank long, chunk_id long")
    nested = {r.page_id: (r.sections, r.top_chunks) for r in dense.nest_results(ranked).collect()}
    assert nested[1] == (["Intro", "Life"], [[10, 11], [11]])
    cov = dense.chunk_coverage(ranked).first()
    assert (cov.n_articles, cov.total_distinct, cov.mean_distinct) == (2, 3, 1.5)
    df = spark.createDataFrame([("Early Life", "Ada Lovelace")], "s string, t string")
    assert df.select(dense.section_query_text("s", "t").alias("q")).first().q == "early life of ada lovelace?"


def test_hash_embed_unit_norm_and_hook(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, "")], "doc_id long, content string")
    rows = {r.doc_id: r.embedding for r in dense.hash_embed(df, dim=16).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-5
    assert rows[2] == [0.0] * 16
    enc = lambda texts: np.array([[len(t), 1.0] for t in texts])
    out = dense.embed_passages(df, enc, batch=1).orderBy("doc_id").collect()
    assert [list(r.embedding) for r in out] == [[7.0, 1.0], [0.0, 1.0]]


def test_dense_null_vector_ranks_last(spark):
    chunks = spark.createDataFrame([(1, 10, [1.0, 0.0]), (1, 11, None), (1, 12, [0.5, 0.0])],
                                   "page_id long, chunk_id long, embedding array<float>")
    qs = spark.createDataFrame([(1, 0, [1.0, 0.0])], "page_id long, sec_pos long, query_embedding array<float>")
    got = [(r.rank, r.chunk_id) for r in dense.dense_topk(qs, chunks, k=3, keep=3).orderBy("rank").collect()]
    assert got == [(1, 10), (2, 12), (3, 11)]


def test_passages_end_with_the_last_token_an_encoder_takes(spark):
    texts = ["one two, three", "", None, " lead  and\ttail ", "x " * 600, "a" * 5000, "é日 1_2;"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").withColumn("embedding ", F.lit(1))
    seen = lambda out: {r.doc_id: r.embedding[0] for r in out.collect()}
    enc = lambda ts: np.array([[len(t)] for t in ts])
    assert seen(dense.embed_passages(df, enc, max_tokens=3)) == {0: 8, 1: 0, 2: 0, 3: 15, 4: 5, 5: 5000, 6: 7}
    out = dense.embed_passages(df, enc)
    assert seen(out) == {0: 14, 1: 0, 2: 0, 3: 15, 4: 1023, 5: 5000, 6: 7} and "_passage" not in out.columns
    assert seen(dense.embed_passages(df, enc, max_tokens=None))[4] == 1200


def test_postings_move_in_blocks_of_documents(spark, tmp_path, monkeypatch):
    """Neither an index nor TF-IDF retrieval makes a row of a posting: a block's terms are
    counted once and stand in one row. Repeated ids and null ids or texts are taken as they come."""
    rows = [(i % 2, None if i == 7 else i // 2, i, None if i == 9 else f"shared w{i % 5} w{i % 3} only{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "page_id long, doc_id long, doc_pos long, content string")
    blocks = sparse.counted_blocks(docs, "terms", key="page_id", doc="doc_id", content="content", block_docs=8).collect()
    assert sum(len(b.docs) for b in blocks) == 40 and len({(b.page_id, b.blk) for b in blocks}) == len(blocks) < 10
    assert all(sorted(set(b.terms)) == sorted(b.terms) and sum(b.df) == len(b.tf) for b in blocks)
    queries = spark.createDataFrame([(1, 0, "shared w2 only4"), (2, 1, "w1 shared w4")], "query_id long, page_id long, query string")
    bm25 = sparse.retrieve(queries, docs, k=4, method="bm25").collect()
    monkeypatch.setattr(sparse, "postings", None)
    path = str(tmp_path / "index")
    for method in ("bm25", "tfidf"):
        wanted = bm25 if method == "bm25" else sparse.retrieve(queries, docs, k=4, method=method).collect()
        sparse.build_index(docs, f"{path}-{method}", method, block_docs=8)
        found = sparse.search_index(queries, f"{path}-{method}", 4, method).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, wanted)) and len(found) == 8


def test_index_of_rare_terms_stays_small(spark, tmp_path, monkeypatch):
    """Most terms of a text are rare, so that a term's blocks hold a posting or two: all are stored,
    a few bytes each, with the largest weight of their block, and found again."""
    rnd = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rnd.zipf(1.3, 150) if x < 10**6) for _ in range(600)]
    docs = spark.createDataFrame([(i % 2, i, i, t) for i, t in enumerate(texts)], "page_id long, doc_id long, doc_pos long, content string")
    queries = spark.createDataFrame([(1, 0, texts[8]), (2, 1, "w1 w2 w3"), (3, 1, texts[5][:40])], "query_id long, page_id long, query string")
    for method in ("bm25", "tfidf"):
        path = tmp_path / method
        monkeypatch.setattr(sparse, "RUN_CHARS", 100_000)
        sparse.build_index(docs, str(path), method, block_docs=16)
        pairs = sum(len(set(t.split())) for t in texts)
        size = sum(p.stat().st_size for p in path.rglob("*.parquet"))
        assert size < 12 * pairs, (size, pairs)
        stored = spark.read.parquet(f"{path}/postings").select("page_id", "term", F.explode("blocks").alias("b")).select("page_id", "term", "b.*")
        each = (stored.select("page_id", "term", "blk", "top", F.explode(F.arrays_zip("at", "tf")).alias("p")).select("*", "p.*")
                .join(spark.read.parquet(f"{path}/docs"), ["page_id", "blk", "at"]).join(spark.read.parquet(f"{path}/terms"), ["page_id", "term"]))
        weight = F.col("gain") * F.col("tf") / (F.col("tf") + F.col("norm") if method == "bm25" else F.col("norm"))
        rows = each.groupBy("page_id", "term", "blk").agg(F.max("top").alias("top"), F.max(weight).alias("most"), F.count("*").alias("n"))
        seen = rows.agg(F.sum("n"), F.min(F.col("top") - F.col("most")), F.max((F.col("top") - F.col("most")) / (1 + F.abs("most")))).first()
        assert seen[0] == pairs and seen[1] >= 0 and seen[2] < 1e-6, seen
        found, wanted = (sorted(map(tuple, x.collect())) for x in (sparse.search_index(queries, str(path), 5, method), sparse.retrieve(queries, docs, 5, method)))
        assert found == wanted and len(found) == 15


def test_index_keeps_the_rows_of_an_id_together(spark, tmp_path, monkeypatch):
    """Rows of one id are one document wherever runs and blocks end; rows without an id count and are not found."""
    rows = [(0, None if i % 9 == 0 else i // 4, i, f"shared w{i % 7} w{i % 3} only{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "page_id long, doc_id long, doc_pos long, content string")
    queries = spark.createDataFrame([(1, 0, "shared w2 only41"), (2, 0, "w6 w0 only3")], "query_id long, page_id long, query string")
    for method in ("bm25", "tfidf"):
        got = []
        for n, (chars, block_docs) in enumerate([(10**6, 200), (300, 3)]):
            monkeypatch.setattr(sparse, "RUN_CHARS", chars)
            path = str(tmp_path / f"{method}{n}")
            sparse.build_index(docs, path, method, block_docs=block_docs)
            of = spark.read.parquet(path + "/docs")
            assert of.count() == 120 and of.filter("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("blk").alias("n")).filter("n > 1").count() == 0
            scores, _ = sparse.index_scores(queries, spark, path, 50, method)
            got.append(sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in scores.collect()))
        assert got[0] and all(x == got[0] for x in got)
        assert all(doc is not None for _, doc, _ in got[0])
