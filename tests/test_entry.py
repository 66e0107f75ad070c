
import os
import subprocess
import sys

import duckdb

import __spark_entry__ as E

# queries that run fast enough to check against the oracle at sf0.001 in the suite
FAST = ["scan_documents", "new_titles", "chunk_docs", "html_to_text", "url_keep_last", "link_union",
        "bm25_topk", "tfidf_topk", "dense_topk", "section_filter", "clean_outline", "section_prompt",
        "parse_response", "ordered_responses", "outline_parse", "citation_units", "citation_ids",
        "judge_scores", "judge_summary", "resume_pending"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "page_id", "rank", "doc_id", "score"]
    assert df.count() > 0


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 58
    plain = {k for k in q if not k.startswith("op") and k != "pipeline"} | {k for k in q if k.startswith("outline_")}
    assert plain - set(s) == {"rouge_l", "metric_summary_all", "meteor_stem", "sentence_chunks"}


def test_registry_without_session():
    """The registry can be read by a process that has no Spark session."""
    code = ("import __spark_entry__ as E; from pyspark import SparkContext; print(len(E.queries()), len(E.oracle_sql())); "
            "assert SparkContext._active_spark_context is None")
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(E.__file__)), capture_output=True, text=True,
                          timeout=120)
    assert said.returncode == 0, said.stderr[-2000:]
    assert said.stdout.split()[-2:] == [str(len(E.queries())), str(len(E.oracle_sql()))]


def test_registry_without_llm(monkeypatch):
    """The corpus operators are registered whether or not the training-data
    subpackage and the pipeline are there."""
    whole, sql = E.queries(), E.oracle_sql()
    for gone in ([m for m in sys.modules if m.startswith("scriptorium.llm")] + ["scriptorium.llm"]):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    rest, rest_sql = E.queries(), E.oracle_sql()
    assert rest == {k: f for k, f in whole.items() if k in rest} and len(rest) >= 58
    assert rest_sql == {k: s for k, s in sql.items() if k in rest}
    assert not [k for k in rest if k == "pipeline" or k.startswith("op") and k[2].isdigit()]


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def test_fast_queries_match_oracle(spark, smoke_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smoke_dir}/{t}.parquet')")
    for k in FAST:
        sdf = E.queries()[k](spark, smoke_dir)
        rel = con.sql(E.oracle_sql()[k])
        assert sorted(sdf.columns) == sorted(rel.columns), k
        order = [rel.columns.index(c) for c in sdf.columns]
        a = sorted(tuple(_norm(x) for x in r) for r in sdf.collect())
        b = sorted(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
        assert a == b, k
