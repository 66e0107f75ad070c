"""Single large JSON files read by ranges, articles from a stream, resume by id,
page records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import corpus
from scriptorium.sources import json_split, readers
from scriptorium.streaming import ingest, regroup


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "397")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def nasty(rnd):
    return "".join(rnd.choice(['a', '"', "\\", ",", "[", "]", "{", "}", " ", "\n", "é", ":", "],", '\\"', "日"]) for _ in range(rnd.randint(0, 30)))


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_outline_map_by_ranges(spark, small_ranges, tmp_path, style):
    rnd = random.Random(4)
    maps = [{str(i): [nasty(rnd) for _ in range(rnd.randint(0, 6))] for i in range(lo, hi)} for lo, hi in ((0, 60), (60, 61), (0, 0))]
    maps[1]["60"] = ["x" * 1000, ",".join("abc") * 400]  # an element over many ranges
    for i, m in enumerate(maps):
        (tmp_path / f"{i}.json").write_text(("﻿" if i == 1 else "") + json.dumps(m, ensure_ascii=False, **style), encoding="utf-8")
    got = sorted(tuple(r) for r in json_split.read_outline_map_split(spark, str(tmp_path)).collect())
    assert got == sorted((int(k), j, s) for m in maps for k, v in m.items() for j, s in enumerate(v))
    n = spark.read.option("lineSep", ",").text(str(tmp_path / "0.json")).rdd.getNumPartitions()
    assert n > 4
    plain = readers.read_outline_map(spark, str(tmp_path / "0.json"))
    assert sorted(tuple(r) for r in plain.collect()) == sorted(r for r in got if r[0] < 60)


def test_broken_elements_go_aside(spark, small_ranges, tmp_path):
    (tmp_path / "1.json").write_text('{"1": ["a", "b"], "2": "no list", "3": [], "4": {"x": ["y", 1]}, "5": ["c"], 6: ["d"], "x": ["e"]}')
    rows, bad = json_split.read_outline_map_split(spark, str(tmp_path), with_rejects=True)
    got = sorted(((r.page_id, r.sec_pos, r.section) for r in rows.collect()), key=str)
    assert [r for r in got if r[0] in (1, 5)] == [(1, 0, "a"), (1, 1, "b"), (5, 0, "c")] and (None, 0, "e") in got
    assert {r.element.split(":")[0] for r in bad.collect()} >= {'"2"', '"4"'}
    items = [{"title": f"t{i}", "link": f"http://x/{i}?a=1,2", "text": 'q "w", [e] {r}' * (i % 4)} for i in range(30)]
    hits = tmp_path / "hits"
    hits.mkdir()
    (hits / "77.json").write_text(json.dumps(items[:20] + ["text", 5, [1, 2]] + items[20:]))
    (hits / "78.json").write_text("[]")
    (hits / "79.json").write_text(json.dumps(items[:1]))
    rows, bad = json_split.read_json_array_split(spark, str(hits), readers.SEARCH_HIT, with_rejects=True)
    got = sorted((r.page_id, r.title, r.link, r.text) for r in rows.collect())
    assert got == sorted([(77, x["title"], x["link"], x["text"]) for x in items] + [(79, "t0", items[0]["link"], "")])
    assert sorted(r.element for r in bad.collect()) == ['"text"', "5", "[1, 2]"]


def run_stream(spark, base, wait):
    stream = spark.readStream.schema(regroup.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    (regroup.regroup_stream(stream, wait).writeStream.format("parquet").option("path", f"{base}/out")
     .option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination())
    got = spark.read.schema(regroup._OUT).parquet(f"{base}/out")
    return sorted((r.page_id, tuple(r.sections), tuple(r.texts), r.missing, r.timed_out) for r in got.collect())


def test_late_and_unordered_responses(spark, tmp_path):
    """Responses before their requests, over several files, missing ones, repeated
    ones; state survives the end of a run."""
    base = str(tmp_path)
    at = lambda minute: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute))

    def file(minute, rows):
        df = spark.createDataFrame(rows, "page_id long, kind string, idx long, n long, section string, text string")
        df.withColumn("at", at(minute)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        return df.withColumn("at", at(minute))

    ask = lambda p, n: [(p, "request", i, n, f"s{i}", None) for i in range(n)]
    say = lambda p, i, t="": (p, "response", i, None, None, t or f"text {p}.{i}")
    events = file(0, [say(1, 2), say(1, 0), *ask(2, 2), say(3, 0)])
    events = events.unionByName(file(1, [*ask(1, 3), say(2, 1), *ask(3, 1)]))
    first = run_stream(spark, base, "1 hour")
    assert first == [(3, ("s0",), ("text 3.0",), 0, False)]
    events = events.unionByName(file(2, [say(1, 1), say(2, 1, "again"), *ask(4, 2), say(4, 1, "x")]))
    assert run_stream(spark, base, "1 hour")[0] == (1, ("s0", "s1", "s2"), ("text 1.0", "text 1.1", "text 1.2"), 0, False)
    file(10_000, [say(-1, 0)])  # time goes on: articles 2 and 4 end without their missing texts
    done = run_stream(spark, base, "1 hour")
    batch = sorted((r.page_id, tuple(r.sections), tuple(r.texts), r.missing, r.timed_out) for r in regroup.regroup_batch(events).collect())
    assert done == batch and [r[3] for r in done] == [0, 1, 0, 1]


def test_resume_by_id(spark, tmp_path):
    base = str(tmp_path)

    def file(ids):
        spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        ingest.ingest_new_ids(spark, f"{base}/in", "id long, v string", f"{base}/out", f"{base}/state", ["id"], max_files=1)
        return sorted(r.id for r in spark.read.schema("id long, v string").parquet(f"{base}/out").collect())

    file(range(10))
    assert run() == list(range(10))
    file(range(5, 15))  # a new file repeats finished ids
    file([14, 14, 15])
    assert run() == list(range(16))
    assert run() == list(range(16))
    # a run that was killed after its last write and before its commit is done again
    import os
    commits = sorted(os.listdir(f"{base}/state/commits"), key=lambda x: (len(x), x))
    last = [c for c in commits if c.isdigit()][-1]
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{base}/state/commits/{name}"):
            os.replace(f"{base}/state/commits/{name}", f"{base}/gone-{name}")
    assert run() == list(range(16))


def test_page_records(spark):
    html = ("<html><head><title>A &amp; B</title></head><h1>A &amp; B</h1><p>lead</p><h2>One</h2>x<h4>Deep</h4>y<h3>Mid</h3>z"
            "<a href='http://r/1'>l</a><h2>Two</h2><script><h2>no</h2></script><a href=\"http://r/1\">m</a><a href='http://r/2?a&amp;b'>n</a>")
    pages = [(1, html), (2, None), (3, "no heading &#00000038; more"), (4, "<h2>First</h2><h1>Big</h1>t<h2>Under</h2>"), (5, "<h1>Only</h1>text")]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("title", F.lit("clash"))
    got = {r.page_id: r for r in corpus.page_records(df).collect()}
    one = got[1]
    assert (one.title, one.summary) == ("A & B", "A & B lead") or (one.title, one.summary) == ("A & B", "lead")
    assert [(s.pos, s.level, s.path) for s in one.sections] == [
        (0, 2, ["One"]), (1, 4, ["One", "Deep"]), (2, 3, ["One", "Mid"]), (3, 2, ["Two"])]
    assert one.content_by_section == ["x", "y", "z l", "m n"] and one.references == ["http://r/1", "http://r/2?a&b"]
    assert (got[2].title, got[2].summary, got[2].sections, got[2].content) == ("", "", [], "")
    assert got[3].summary == "no heading & more" and got[3].sections == []
    assert [s.path for s in got[4].sections] == [["First"], ["Big"], ["Big", "Under"]]
    assert (got[5].title, got[5].summary, got[5].sections) == ("Only", "text", [])
    wiki = spark.createDataFrame([(1, "lead\n== A ==\na [https://x.org/1 t]\n=== B ===\nb https://x.org/1\n==== C ====\n== D ==\n")], "page_id long, w string")
    r = corpus.page_records(wiki, "w", "wiki").first()
    assert [(s.level, s.path) for s in r.sections] == [(2, ["A"]), (3, ["A", "B"]), (4, ["A", "B", "C"]), (2, ["D"])]
    assert r.summary == "lead" and r.content_by_section[2:] == ["", ""] and r.references == ["https://x.org/1"]


@pytest.mark.parametrize("text,want", [
    ("&#00000038;", "&"), ("&#x000026;", "&"), ("&#38;", "&"), ("&amp;lt;", "&lt;"), ("&#0;", "&#0;"), ("&nosuch;", "&nosuch;"),
    ("&#000000000000000000000000000000000000038; x", "& x"), ("&#X41;&#xe9;", "Aé"), ("& ; &;", "& ; &;")])
def test_character_references(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(corpus.unescape_entities("t").alias("t")).first().t == want
