import json
import os
import tempfile

from pyspark.sql import functions as F

from scriptorium.sources import readers, writers
from scriptorium.streaming.ingest import ingest_available


def _write(d, name, obj):
    with open(os.path.join(d, name), "w") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def test_articles_with_rejects(spark):
    d = tempfile.mkdtemp(prefix="arts-")
    _write(d, "70046138.json", {"id": 70046138, "key": "K", "outlines": ["A", "B"], "contents": ["a", "b"],
                                "info_kv": {}, "reference": [["t", "u", "x"]]})
    _write(d, "5.json", {"key": "no id", "outlines": [], "contents": []})
    _write(d, "broken.json", "{not json")
    good, bad = readers.read_articles(spark, d, with_rejects=True)
    got = sorted((r.page_id, r.key) for r in good.collect())
    assert got == [(5, "no id"), (70046138, "K")]
    assert len(bad.collect()) == 1  # count() would prune to the corrupt column only


def test_search_results_docs_and_retrieval(spark):
    d = tempfile.mkdtemp(prefix="search-")
    _write(d, "67048321.json", [{"title": "a", "link": "http://a", "text": "x"},
                                {"title": "b", "link": "http://b", "text": ""}])
    _write(d, "7.json", [])
    _write(d, "bad.json", "{")
    rows = sorted((r.page_id, r.pos, r.url) for r in readers.read_search_results(spark, d).collect())
    assert rows == [(67048321, 0, "http://a"), (67048321, 1, "http://b")]
    bad = [r._path for r in readers.rejected_array_files(spark, d).collect()]
    assert len(bad) == 1 and bad[0].endswith("bad.json")
    dd = tempfile.mkdtemp(prefix="docs-")
    _write(dd, "3.json", [{"doc_id": "d1", "content": "c"}, {"doc_id": "d2"}, {"content": "z"}])
    docs = sorted((r.doc_pos, r.doc_id, r.content) for r in readers.read_doc_lists(spark, dd).collect())
    assert docs == [(0, "d1", "c"), (1, "d2", ""), (2, None, "z")]
    rd = tempfile.mkdtemp(prefix="ret-")
    _write(rd, "top.json", [{"id": 9, "sections": ["S1", "S2"], "top-chunks": [["c1", "c2"], ["c3"]]}])
    ret = sorted((r.page_id, r.sec_pos, r.section, r.rank, r.chunk) for r in readers.read_retrieval_results(spark, rd).collect())
    assert ret == [(9, 0, "S1", 1, "c1"), (9, 0, "S1", 2, "c2"), (9, 1, "S2", 1, "c3")]


def test_outline_map(spark):
    d = tempfile.mkdtemp(prefix="outline-")
    _write(d, "outline.json", {"12": ["Intro", "Life"], "13": []})
    got = sorted((r.page_id, r.sec_pos, r.section) for r in readers.read_outline_map(spark, d).collect())
    assert got == [(12, 0, "Intro"), (12, 1, "Life")]


def test_writers_and_resume(spark):
    out = tempfile.mkdtemp(prefix="out-")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "page_id long, text string")
    writers.write_dataset(df, os.path.join(out, "ds"), partitions=2)
    assert spark.read.parquet(os.path.join(out, "ds")).count() == 3
    writers.write_jsonl(df, os.path.join(out, "jl"))
    assert spark.read.json(os.path.join(out, "jl")).count() == 3
    flagged = df.withColumn("accepted", F.col("page_id") != 2)
    flagged = flagged.unionByName(spark.createDataFrame([(9, "n")], df.schema).withColumn("accepted", F.lit(None).cast("boolean")))
    reads = spark.sparkContext.accumulator(0)

    def counted(it):
        for b in it:
            reads.add(b.num_rows)
            yield b

    once = flagged.mapInArrow(counted, flagged.schema)
    assert writers.write_with_rejects(once, os.path.join(out, "ok"), os.path.join(out, "fail")) == {"accepted": 2, "rejected": 2}
    assert reads.value == 4  # one pass over the input
    assert spark.read.parquet(os.path.join(out, "ok", "accepted=true")).count() == 2
    assert [r.page_id for r in spark.read.json(os.path.join(out, "fail")).orderBy("page_id").collect()] == [2, 9]
    done_dir = tempfile.mkdtemp(prefix="done-")
    for name in ("1.json", "x1.json", "3.jsonl"):
        _write(done_dir, name, "{}")
    done = readers.finished_ids(spark, done_dir)
    assert sorted(r.page_id for r in readers.pending(df, done).collect()) == [2]


def test_incremental_ingest_second_run_adds_nothing(spark):
    src = tempfile.mkdtemp(prefix="src-")
    spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string").write.mode("overwrite").parquet(src + "/b1")
    work = tempfile.mkdtemp(prefix="ingest-")
    schema = "page_id long, html string"
    ingest_available(spark, src + "/b1", schema, work + "/out", work + "/ckpt")
    ingest_available(spark, src + "/b1", schema, work + "/out", work + "/ckpt")
    assert spark.read.parquet(work + "/out").count() == 1


def test_read_snapshot_prunes_columns(spark):
    d = tempfile.mkdtemp(prefix="snap-")
    spark.createDataFrame([("1", "T", "x", "extra")], "id string, title string, text string, other string") \
        .write.mode("overwrite").parquet(d + "/s")
    df = readers.read_snapshot(spark, d + "/s")
    assert df.columns == ["id", "title", "text"]
    assert "other" not in df._jdf.queryExecution().executedPlan().toString()


def test_write_dataset_splits_a_hot_key(spark):
    out = tempfile.mkdtemp(prefix="hot-")
    df = spark.range(0, 4000).select((F.col("id") % 1).alias("page_id"), F.col("id").alias("doc_id"))
    writers.write_dataset(df, os.path.join(out, "ds"), partitions=4)
    back = spark.read.parquet(os.path.join(out, "ds"))
    files = back.select(F.input_file_name().alias("f")).distinct().count()
    assert back.count() == 4000 and files > 1


def test_buckets_spare_the_exchange(spark):
    """Joins of bucketed tables move nothing, whatever is small enough to broadcast."""
    out = tempfile.mkdtemp(prefix="buckets-")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 500).select((F.col("id") % 40).alias("page_id"), F.col("id").alias("chunk_id"), F.md5(F.col("id").cast("string")).alias("v"))
        for name in ("chunks", "vectors"):
            spark.sql(f"DROP TABLE IF EXISTS test_{name}")
            writers.write_bucketed(rows, f"test_{name}", os.path.join(out, name), ["page_id", "chunk_id"], 8)
        both = spark.table("test_chunks").join(spark.table("test_vectors").withColumnRenamed("v", "w"), ["page_id", "chunk_id"])
        assert both.count() == 500 and both.filter("v <> w").count() == 0
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        asked = rows.filter("chunk_id % 7 = 0").select("page_id", "chunk_id").repartition(3).join(spark.table("test_vectors"), ["page_id", "chunk_id"])
        assert asked.count() == 72
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("chunks", "vectors"):
            spark.sql(f"DROP TABLE IF EXISTS test_{name}")
