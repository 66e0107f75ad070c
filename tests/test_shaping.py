from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.operators import shaping


def test_section_filters(spark):
    df = spark.createDataFrame([(["Intro", "See_also", "see also", "Notes", "External_links", "Citations"],)],
                               "o array<string>")
    r = df.select(shaping.drop_boilerplate("o").alias("a"), shaping.clean_outline("o").alias("b")).first()
    assert r.a == ["Intro"]
    assert r.b == ["Intro", "Citations"]


def test_fit_budget_clamps_at_zero(spark):
    df = spark.createDataFrame([("h1 h2\n", "b1\nb2  b3 b4", "\nt1 t2 t3")], "h string, b string, t string")
    r = df.select(*[shaping.fit_budget("h", "b", "t", n).alias(a) for n, a in ((7, "a"), (3, "z"), (9, "all"))]).first()
    assert r.a == "h1 h2\nb1\nb2\nt1 t2 t3"
    assert r.z == "h1 h2\n\nt1 t2 t3"
    assert r["all"] == "h1 h2\nb1\nb2  b3 b4\nt1 t2 t3"  # within the budget nothing changes


def test_response_without_choices(spark):
    df = spark.createDataFrame([('{"choices":[]}',), ("{}",), ("nonsense",), (None,)], "r string")
    assert [x.c for x in df.select(shaping.response_content("r").alias("c")).collect()] == [""] * 4


def test_numbered_and_messages(spark):
    df = spark.createDataFrame([(["x", "y"], ["T1", "T2"], ["u1", "u2"], "")],
                               "d array<string>, t array<string>, u array<string>, sys string")
    r = df.select(
        F.array_join(shaping.numbered(F.col("d"), "colon"), "\n").alias("c"),
        F.array_join(shaping.numbered(F.col("d"), "titled", F.col("t"), F.col("u")), "\n").alias("t"),
        shaping.writer_user_prompt(F.lit("K"), F.lit("S"), shaping.numbered(F.col("d"), "bracket"), "Chapter").alias("w"),
        shaping.outline_user_prompt(F.lit("K"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("r"))).alias("o"),
        shaping.messages(F.col("sys"), F.lit("hi")).alias("m1"),
        shaping.messages(F.lit("s"), F.lit("hi")).alias("m2")).first()
    assert r.c == "Document 1: x\nDocument 2: y"
    assert r.t == "Document [1] (Title: T1, u1) x\nDocument [2] (Title: T2, u2) y"
    assert r.w == "Keyword: K\nChapter: S\nDocument [1] x\nDocument [2] y\n"
    assert r.o == "Keyword: K\nOutline: A, Br\n"
    assert [m.role for m in r.m1] == ["user"] and [m.role for m in r.m2] == ["system", "user"]


def test_message_tokens_and_budget(spark):
    df = spark.createDataFrame([(1,)], "id int").select(
        shaping.messages(F.lit("a b"), F.lit("c, d")).alias("m"))
    n = df.select(shaping.message_tokens("m").alias("n")).first().n
    # 3 + (3 + 1 + 2) + (3 + 1 + 3)
    assert n == 16
    rows = spark.createDataFrame([(1, 10), (2, 5000), (3, 5000)], "page_id long, n_tokens long") \
        .withColumn("model", F.when(F.col("page_id") == 3, "gpt-4").otherwise("gpt-3.5-turbo"))
    ok, rej = shaping.split_by_budget(rows, tokens="n_tokens", reserve=800)
    assert [r.page_id for r in ok.collect()] == [1] and sorted(r.page_id for r in rej.collect()) == [2, 3]
    flagged = shaping.budget_flag(rows, "n_tokens", reserve=800, model_col="model")
    assert {r.page_id: r.accepted for r in flagged.collect()} == {1: True, 2: False, 3: True}
    assert dict(K.MODEL_WINDOWS)["gpt-4-32k"] == 32768


def test_parse_response_and_zip_and_outline(spark):
    df = spark.createDataFrame([('{"choices":[{"message":{"content":"  hi\\n"}}]}',), ("{}",), ("not json",), (None,)],
                               "r string")
    assert [r.c for r in df.select(shaping.response_content("r").alias("c")).collect()] == ["hi", "", "", ""]
    art = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"])], "page_id long, outline array<string>, gen array<string>")
    z = [(r.sec_pos, r.outline, r.gen) for r in shaping.zip_rows(art, "page_id", ["outline", "gen"]).collect()]
    assert z == [(0, "a", "x"), (1, "b", "y")]
    rep = spark.createDataFrame([(1, "Here:\n1. Introduction\n2.  Early life \n\n==History==\n== Legacy ==\nbye")],
                                "page_id long, reply string")
    got = [(r.sec_pos, r.section) for r in shaping.parse_outline(rep).orderBy("sec_pos").collect()]
    assert got == [(1, "Introduction"), (2, "Early life"), (4, "History"), (5, "Legacy")]


def test_section_context_zip_stops_at_shorter(spark):
    secs = spark.createDataFrame([(1, 0, "Intro"), (1, 1, "References"), (1, 2, "Life")],
                                 "page_id long, sec_pos long, section string")
    ranked = spark.createDataFrame([(1, 0, r, 100 + r) for r in range(1, 8)] + [(1, 1, 1, 5)],
                                   "page_id long, sec_pos long, rank long, chunk_id long")
    ctx = shaping.section_context(secs, ranked, keep=5)
    assert sorted((r.sec_pos, r.rank) for r in ctx.collect()) == [(0, k) for k in range(1, 6)]


def test_writer_requests_levels(spark):
    arts = spark.createDataFrame([(1, "cat", ["Intro", "Life"]), (2, "dog", [])],
                                 "page_id long, key string, outlines array<string>")
    refs = spark.createDataFrame([(1, 0, "T0", "u0", "a dog"), (1, 1, "T1", "u1", "the cat sat"), (1, 2, "T2", "u2", "a bird"),
                                  (2, 0, "D", "v", "dog dog")],
                                 "page_id long, doc_pos long, title string, url string, content string")
    van = {r.page_id: r for r in shaping.writer_requests(arts, "vanilla").collect()}
    assert van[1].messages[1].content == "Keyword: cat\n" and van[1].accepted
    bm = {r.page_id: r for r in shaping.writer_requests(arts, "BM25", refs=refs, num=1, given_outline=True).collect()}
    assert bm[1].messages[1].content == "Keyword: cat\nOutline: Intro, LifeDocument [1] (Title: T1, u1) the cat sat\n"
    assert bm[2].messages[1].content == "Keyword: dog\nDocument [1] (Title: D, v) dog dog\n"
    ret = spark.createDataFrame([(1, 2, "bé"), (1, 1, "a")], "page_id long, rank long, chunk string")
    pre = {r.page_id: r for r in shaping.writer_requests(arts, "dpr", retrieved=ret, reserve=4090).collect()}
    assert pre[1].messages[1].content == "Keyword: cat\nDocument [1] a\nDocument [2] b\n"
    assert pre[2].messages[1].content == "Keyword: dog\n"
    assert not pre[1].accepted


def test_regroup_sections_keeps_order(spark):
    rows = spark.createDataFrame([(1, 2, "C", "z"), (1, 0, "A", "x"), (1, 1, "B", "y"), (2, 0, "Q", "q")],
                                 "page_id long, sec_pos long, section string, text string")
    got = {r.page_id: (r.section, r.text) for r in shaping.regroup_sections(rows).collect()}
    assert got == {1: (["A", "B", "C"], ["x", "y", "z"]), 2: (["Q"], ["q"])}


def test_writer_requests_tfidf_level(spark):
    arts = spark.createDataFrame([(1, "Cat facts", ["Intro"])], "page_id long, key string, outlines array<string>")
    refs = spark.createDataFrame([(1, 0, "T0", "u0", "dogs bark"), (1, 1, "T1", "u1", "cat facts here"),
                                  (1, 2, "T2", "u2", "facts")],
                                 "page_id long, doc_pos long, title string, url string, content string")
    r = shaping.writer_requests(arts, "tfidf", refs=refs, num=2).first()
    assert r.messages[0].role == "system"
    assert r.messages[1].content == ("Keyword: Cat facts\nDocument [1] (Title: T1, u1) cat facts here\n"
                                     "Document [2] (Title: T2, u2) facts\n")
