import random

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import corpus
from scriptorium.operators.sequence import running_offset


def test_new_rows_null_safe_and_keeps_duplicates(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "id int, title string")
    new = spark.createDataFrame([(3, "a"), (4, None), (5, "b"), (6, "b"), (7, "c")], "id int, title string")
    out = sorted(r.id for r in corpus.new_rows(new, old).collect())
    assert out == [5, 6, 7]


def test_word_count_matches_python_split(spark):
    texts = ["a b  c", "  x y\n", "", "one", "\x1c\x1dz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in df.select(T.word_count("text").alias("n")).collect()]
    assert got == [len(t.split()) for t in texts]


def test_py_strip_and_tokens(spark):
    df = spark.createDataFrame([("  hi there!\n\t",)], "t string")
    r = df.select(T.py_strip("t").alias("s"), T.tokens("t").alias("k")).first()
    assert r.s == "hi there!"
    assert r.k == ["hi", "there", "!"]


def test_chunks_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, 0, "d0", "a b c d e"), (1, 1, "d1", ""), (1, 2, None, None), (1, 3, "d3", "x y z"),
         (2, 0, "e0", "p q")],
        "page_id long, doc_pos long, doc_id string, content string")
    rows = corpus.chunk_docs_numbered(docs, size=2).collect()
    got = sorted((r.page_id, r.chunk_id, r.doc_id, r.content) for r in rows)
    assert got == [(1, 0, "d0", "a b"), (1, 1, "d0", "c d"), (1, 2, "d0", "e"),
                   (1, 3, "d3", "x y"), (1, 4, "d3", "z"), (2, 0, "e0", "p q")]
    plain = corpus.chunk_docs(docs, size=2).filter("doc_id = 'd0'").orderBy("chunk_pos").collect()
    assert [r.content for r in plain] == ["a b", "c d", "e"]


def test_running_offset_hot_key_spread_over_partitions(spark):
    rnd = random.Random(7)
    rows = [(0, i, rnd.randint(0, 4)) for i in range(3000)]  # one hot key
    rows += [(k, i, rnd.randint(0, 4)) for k in range(1, 40) for i in range(rnd.randint(0, 30))]
    df = spark.createDataFrame(rows, "k long, o long, w long")
    got = {(r.k, r.o): r.offset for r in running_offset(df, "k", "o", "w", partitions=16).collect()}
    exp, acc = {}, {}
    for k, o, w in sorted(rows):
        exp[(k, o)] = acc.get(k, 0)
        acc[k] = acc.get(k, 0) + w
    assert got == exp


def test_html_to_text(spark):
    html = ('<html><head><style>p{x}</style><script>var a="</p>";</script></head><body>'
            '<!-- c --><p>Fish &amp; chips&nbsp;&lt;b&gt;</p><p>two</p></body></html>')
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(corpus.html_text("html").alias("t")).first().t == "Fish & chips <b> two"


def test_extract_sections_html_and_wiki(spark):
    df = spark.createDataFrame([(1, "<p>lead</p><h2>History</h2><p>old</p><h2>Now</h2>x")],
                               "page_id long, html string")
    got = [(r.sec_pos, r.section, r.text) for r in corpus.extract_sections(df).orderBy("sec_pos").collect()]
    assert got == [(0, "", "lead"), (1, "History", "old"), (2, "Now", "x")]
    wiki = spark.createDataFrame([(1, "intro\n==Early life==\nborn\n== Career ==\nwork")], "page_id long, html string")
    got = [(r.section, r.text) for r in corpus.extract_sections(wiki, form="wiki").orderBy("sec_pos").collect()]
    assert got == [("", "intro"), ("Early life", "born"), ("Career", "work")]


def test_keep_last_and_drop_empty(spark):
    df = spark.createDataFrame([(1, "u", 0, "old"), (1, "u", 3, "new"), (1, "v", 1, None), (1, "w", 2, " \n ")],
                               "page_id long, url string, pos long, text string")
    last = {r.url: r.text for r in corpus.keep_last(df, ["page_id", "url"], "pos").collect()}
    assert last == {"u": "new", "v": None, "w": " \n "}
    kept = [r.url for r in corpus.drop_empty_texts(df).collect()]
    assert sorted(kept) == ["u", "u"]
    blocked = corpus.drop_empty_texts(df, block_phrases=("NEW",)).collect()
    assert [r.text for r in blocked] == ["old"]


def test_explode_sections_stops_at_shorter(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"])], "page_id long, outlines array<string>, contents array<string>")
    got = [(r.sec_pos, r.section, r.content) for r in corpus.explode_sections(df).collect()]
    assert got == [(0, "a", "x"), (1, "b", "y")]


def test_character_references(spark):
    rows = [("&#8211; &eacute; &hellip; &#x27; &mdash; &amp;lt; &nope; AT&T &#xD800; &#99999999; 5 & 6; &lt;b&gt;",), ("",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "t string").select(corpus.unescape_entities("t").alias("t")).collect()]
    assert got == ["\u2013 \u00e9 \u2026 ' \u2014 &lt; &nope; AT&T &#xD800; &#99999999; 5 & 6; <b>", "", None]


def test_links_with_other_attributes_and_markup(spark):
    html = '<a class="x" href="/a">one <b>two</b></a><a href=\'/b\' id=q>t</a><a name="n">no</a><abbr href="/z">no</abbr>'
    rows = corpus.extract_links(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r.title, r.url) for r in rows] == [("one two", "/a"), ("t", "/b")]


def test_chunk_ids_with_null_and_equal_positions(spark):
    docs = spark.createDataFrame([(None, 0, "a", "x y"), (None, 1, "b", "z"), (1, 0, "c", "p q r"), (1, 0, "d", "s")],
                                 "page_id long, doc_pos long, doc_id string, content string")
    rows = corpus.chunk_docs_numbered(docs, size=2).collect()
    got = sorted((r.page_id or -1, r.chunk_id, r.doc_id) for r in rows)
    assert got == [(-1, 0, "a"), (-1, 1, "b"), (1, 0, "c"), (1, 1, "c"), (1, 2, "d")]


def test_articles_with_a_map_column_can_be_written(spark):
    import tempfile

    from scriptorium.sources.writers import write_dataset
    df = spark.createDataFrame([(1, {"a": "b"}), (2, None)], "page_id long, info_kv map<string,string>")
    out = tempfile.mkdtemp(prefix="map-") + "/ds"
    write_dataset(df, out)
    write_dataset(df, out + "2", partitions=2)
    assert spark.read.parquet(out).count() == spark.read.parquet(out + "2").count() == 2
