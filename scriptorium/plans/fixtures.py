"""Inputs of the registered queries, derived by Spark from the given tables.

The given tables hold no articles, outlines, citations or judge replies, so
those shapes are derived here from whole tables (documents, pages,
embeddings, conversations, labels, benchmark). ``plans/oracle.py`` writes
the same derivations in DuckDB SQL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixture values: section names assigned to derived outlines by position
# (includes boilerplate names, with and without underscores).
SECTION_NAMES = (
    "Introduction", "History", "See also", "Design", "References",
    "Early life", "External_links", "Career", "Further reading", "Notes",
    "Legacy", "Bibliography",
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table (dealt out as the caller's options say, see ``spread``)."""
    from ..session import spread
    return spread(spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet"))


def page_of_source(col: str = "source"):
    return F.regexp_extract(F.col(col), "[0-9]+", 0).cast("bigint")


def article_docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as articles: ``source`` is the article, each document one of
    its reference docs, positioned by ``doc_id``."""
    return table(spark, d, "documents").select(
        page_of_source().alias("page_id"), "doc_id",
        F.col("doc_id").alias("doc_pos"), F.col("text").alias("content"))


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) snapshots of the corpus: the old titles are the first five
    words of each document; the new snapshot titles the same documents after
    non-ASCII characters were stripped."""
    docs = table(spark, d, "documents")
    old = docs.select(F.col("doc_id").alias("id"), T.first_words("text").alias("title"))
    new = docs.select(F.col("doc_id").alias("id"),
                      T.first_words(T.strip_non_ascii("text")).alias("title"))
    return old, new


def sparse_queries(spark: SparkSession, d: str) -> DataFrame:
    """benchmark items as queries; item ``i`` is asked against article
    ``i mod 20`` (the documents have 20 sources)."""
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.pmod(F.col("item_id"), F.lit(20)).alias("page_id"),
        F.col("text").alias("query"))


def url_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two crawls of every page as link rows: article = host, the full url,
    the page's text; the second crawl (positions from 10^9 on) found every
    text with a line before it."""
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")
    first = p.select(host, "url", F.col("page_id").alias("pos"), F.col("html").alias("text"))
    again = p.select(host, "url", (F.col("page_id") + 1_000_000_000).alias("pos"), F.concat(F.lit("second crawl\n"), "html").alias("text"))
    return first.unionByName(again)


def vector_page(col: str = "vec_id"):
    """The article of a vector: a third of all vectors belong to article 0, which
    grows with the table; of the others 200 consecutive ``vec_id`` are an article's
    chunks, so these articles grow in number and not in size."""
    return F.when(F.col(col) % 3 == 0, F.lit(0)).otherwise(F.floor(F.col(col) / 200) + 1)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as chunk vectors of the articles of ``vector_page``."""
    return table(spark, d, "embeddings").select(
        vector_page().alias("page_id"), F.col("vec_id").alias("chunk_id"), "embedding")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as section queries of their own article: of the large article 0
    those whose id is divisible by 50, of the others all; section name by
    position."""
    names = F.array(*[F.lit(n) for n in SECTION_NAMES])
    rows = table(spark, d, "embeddings").withColumn("page_id", vector_page())
    return rows.filter((F.col("page_id") > 0) | (F.col("vec_id") % 50 == 0)).select(
        "page_id", F.col("vec_id").alias("sec_pos"),
        F.element_at(names, (F.pmod("vec_id", F.lit(len(SECTION_NAMES))) + 1).cast("int")).alias("section"),
        F.col("embedding").alias("query_embedding"))


def conversation_sections(spark: SparkSession, d: str) -> DataFrame:
    """conversations as articles: ``conv_id`` = article, ``turn`` = section
    position, section name by turn; the article key is the first five words
    of turn 0."""
    c = table(spark, d, "conversations")
    names = F.array(*[F.lit(n) for n in SECTION_NAMES])
    keys = c.filter(F.col("turn") == 0).select(
        F.col("conv_id").alias("page_id"), T.first_words("text").alias("key"))
    rows = c.select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("sec_pos"),
        F.element_at(names, (F.pmod("turn", F.lit(len(SECTION_NAMES))) + 1).cast("int")).alias("section"),
        "role", "text")
    return rows.join(keys, "page_id", "left")


def conversation_articles(spark: SparkSession, d: str) -> DataFrame:
    """One record per conversation with parallel ``outlines``/``contents``
    arrays (the article file shape); the group is one conversation."""
    s = conversation_sections(spark, d)
    ordered = F.sort_array(F.collect_list(F.struct("sec_pos", "section", "text")))
    return (s.groupBy("page_id", "key").agg(ordered.alias("_s"))
            .select("page_id", "key",
                    F.transform("_s", lambda x: x["section"]).alias("outlines"),
                    F.transform("_s", lambda x: x["text"]).alias("contents")))


def wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    """conversations as wiki texts: turn 0 is the lead, every further turn a section
    of level 2, 3 or 4 by ``(turn * turn + conv_id) % 3``, with an address after
    every third turn."""
    s = conversation_sections(spark, d)
    marks = F.repeat(F.lit("="), (F.pmod(F.col("sec_pos") * F.col("sec_pos") + F.col("page_id"), F.lit(3)) + 2).cast("int"))
    link = F.when(F.pmod(F.col("sec_pos"), F.lit(3)) == 0, F.concat(F.lit("\n[https://example.org/"), F.pmod(F.col("sec_pos"), F.lit(4)).cast("string"), F.lit(" more]")))
    line = F.concat(F.when(F.col("sec_pos") > 0, F.concat(marks, F.lit(" "), F.col("section"), F.lit(" "), marks, F.lit("\n"))).otherwise(F.lit("")),
                    F.col("text"), F.coalesce(link, F.lit("")))
    return (s.withColumn("_line", line).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("sec_pos", "_line"))).alias("_l"))
            .select("page_id", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("wikitext")))


def page_key(col: str = "page_id"):
    """Title of a derived article."""
    return F.concat(F.lit("Topic "), F.col(col).cast("string"))


def section_ranks(spark: SparkSession, d: str, k: int = 50, keep: int | None = None) -> DataFrame:
    """Dense top-``k`` chunks per section query, the first ``keep`` of them."""
    from ..operators import dense
    return dense.dense_topk(vector_queries(spark, d), vectors(spark, d), k=k, keep=keep, block_rows=128)


def with_chunk_text(ranked: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Ranked chunks with their texts (the document whose ``doc_id`` is the chunk
    id; '' when there is none)."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"),
                                                F.col("text").alias("chunk"))
    return (ranked.join(texts, "chunk_id", "left")
            .withColumn("chunk", F.coalesce("chunk", F.lit(""))))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Chat responses: each conversation turn wrapped as a completion JSON
    (``idx`` = turn); a turn with ``(conv_id + turn) % 7 = 0`` failed (``{}``)."""
    c = table(spark, d, "conversations")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content"))
                                               .alias("message"))).alias("choices")))
    failed = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 0
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("idx"),
                    F.when(failed, F.lit("{}")).otherwise(body).alias("response"))


def generated_articles(spark: SparkSession, d: str) -> DataFrame:
    """Generated articles as JSON text: ``text`` is the list of assistant
    turns for an even ``conv_id``, one string (turns joined by a space) for
    an odd one."""
    c = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    per = (c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"))
           .select(F.col("conv_id").alias("page_id"), F.transform("_t", lambda x: x["text"]).alias("_l")))
    as_list = F.to_json(F.struct(F.col("_l").alias("text")))
    as_str = F.to_json(F.struct(F.array_join("_l", " ").alias("text")))
    return per.select("page_id", F.when(F.pmod("page_id", F.lit(2)) == 0, as_list)
                      .otherwise(as_str).alias("json"))


PAIR_KEYS = ["src", "page_id", "sec_pos"]


def without_sevenths(col: str) -> Column:
    """The words of a text but every 7th, joined by a space."""
    def kept(text):
        words = text.split()
        del words[6::7]
        return " ".join(words)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else kept(t) for t in texts], dtype=object)

    return run(col)


def text_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(gold, candidates) keyed by ``src, page_id, sec_pos``: a user turn is
    gold and the next assistant turn its candidate; every document is gold
    and the same document without every 7th word its candidate."""
    c = table(spark, d, "conversations")
    gold_c = c.filter(F.col("role") == "user").select(
        F.lit("conv").alias("src"), F.col("conv_id").alias("page_id"), F.col("turn").alias("sec_pos"), "text")
    cand_c = c.filter(F.col("role") == "assistant").select(
        F.lit("conv").alias("src"), F.col("conv_id").alias("page_id"),
        (F.col("turn") - 1).alias("sec_pos"), "text")
    docs = table(spark, d, "documents")
    gold_d = docs.select(F.lit("doc").alias("src"), F.col("doc_id").alias("page_id"),
                         F.lit(0).cast("bigint").alias("sec_pos"), "text")
    cand_d = docs.select(F.lit("doc").alias("src"), F.col("doc_id").alias("page_id"),
                         F.lit(0).cast("bigint").alias("sec_pos"), without_sevenths("text").alias("text"))
    return gold_c.unionByName(gold_d), cand_c.unionByName(cand_d)


SENTENCE = "[^.\\n]+[.\\n]?"


def cited_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a generated text with citations: sentence ``i``
    (from 1) is followed by ``[i % 7]`` unless ``i % 4 = 0``, and every fifth
    of those by ``[(i + 2) % 7]`` as well; ``[0]`` and ids above 5 point outside the 5-document list."""
    s = F.regexp_extract_all(F.col("text"), F.lit(SENTENCE), 0)
    second = lambda i: F.when(F.pmod(i + 1, F.lit(5)) == 0, F.concat(
        F.lit("["), F.pmod(i + 3, F.lit(7)).cast("string"), F.lit("]"))).otherwise(F.lit(""))
    marked = F.transform(s, lambda x, i: F.when(F.pmod(i + 1, F.lit(4)) != 0, F.concat(
        x, F.lit("["), F.pmod(i + 1, F.lit(7)).cast("string"), F.lit("]"), second(i))).otherwise(x))
    return table(spark, d, "documents").select("doc_id", F.array_join(marked, "").alias("text"))


def cited_records(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """``doc_id, text, refs``: the cited documents with their reference lists as ids,
    documents ``d+1`` .. ``d+n``."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("doc_id") + i)
    return cited_documents(spark, d).withColumn("refs", ids)


def generated_records(spark: SparkSession, d: str) -> DataFrame:
    """Generated articles as stored JSON: ``text`` and ``retrieve``. The sections of a
    conversation are its assistant turns, section ``i`` ends with ``[i % 4]`` and
    ``[1]``; the list of a section is the first user turn before it (or ``none``) and its own text. An
    even conversation has a list of texts and a list of lists, an odd one a single
    text (sections joined by newline) and the list of all user turns."""
    c = table(spark, d, "conversations")
    rows = (c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
            .select("conv_id", F.filter("_t", lambda x: x["role"] == "assistant").alias("_a"),
                    F.filter("_t", lambda x: x["role"] == "user").alias("_u")))
    marked = F.transform("_a", lambda x, i: F.concat(x["text"], F.lit("["), F.pmod(i, F.lit(4)).cast("string"), F.lit("][1]")))
    before = lambda x: F.concat(F.transform(F.filter("_u", lambda u: u["turn"] < x["turn"]), lambda u: u["text"]), F.array(F.lit("none")))
    lists = F.transform("_a", lambda x: F.array(F.element_at(before(x), 1), x["text"]))
    users = F.transform("_u", lambda u: u["text"])
    per = F.to_json(F.struct(marked.alias("text"), lists.alias("retrieve")))
    one = F.to_json(F.struct(F.array_join(marked, "\n").alias("text"), users.alias("retrieve")))
    return rows.filter(F.size("_a") > 0).select(F.col("conv_id").alias("page_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, per).otherwise(one).alias("json"))


def premise_lists(spark: SparkSession, d: str, n: int = 5, value=None) -> DataFrame:
    """The reference list of document ``d``: documents ``d+1`` .. ``d+n``
    (an equi-join on the computed id, no window). ``value`` (default the
    text) is computed once per document, before the join."""
    docs = table(spark, d, "documents")
    want = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                      F.lit(n - 1).cast("bigint"))).alias("ref_pos"))
    other = docs.select(F.col("doc_id").alias("_rid"),
                        (F.col("text") if value is None else value).alias("premise"))
    return (want.join(other, F.col("_rid") == F.col("doc_id") + 1 + F.col("ref_pos"))
            .select("doc_id", "ref_pos", "premise"))


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Judge replies for labelled documents: ``Fluency:a,Informativeness:b
    Faithfulness:c`` with a = doc_id % 8, b = 5 * quality + toxic, c =
    (7 * doc_id) % 10; every 11th document's reply is ``n/a``."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "text")
    reply = F.concat(F.lit("Fluency:"), F.pmod("doc_id", F.lit(8)).cast("string"),
                     F.lit(",Informativeness:"), (F.col("quality") * 5 + F.col("toxic")).cast("string"),
                     F.lit(" Faithfulness:"), F.pmod(F.col("doc_id") * 7, F.lit(10)).cast("string"))
    return lab.join(docs, "doc_id").select(
        "doc_id", T.first_words("text").alias("keyword"), "text",
        F.when(F.pmod("doc_id", F.lit(11)) == 0, F.lit("n/a")).otherwise(reply).alias("reply"))


def write_elements(elements: DataFrame, path: str, opening: str, closing: str) -> None:
    """JSON elements (a text column ``value``) as files that hold one JSON array or
    object each, an element per line."""
    def bracketed(batches):
        import pyarrow as pa
        one = lambda v: pa.RecordBatch.from_arrays([pa.array([v])], names=["value"])
        last, begin = None, opening
        for b in batches:
            for v in b.column(0).to_pylist():
                if last is not None:
                    yield one(last + ",")
                last, begin = begin + v, ""
        if last is not None:
            yield one(last + closing)

    elements.select("value").mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def write_outline_maps(articles: DataFrame, path: str) -> None:
    """``{"<page_id>": [section, ...], ...}`` in files of many articles each."""
    entry = F.to_json(F.create_map(F.col("page_id").cast("string"), F.col("outlines")))
    write_elements(articles.withColumn("_e", entry).select(F.expr("substring(_e, 2, length(_e) - 2)").alias("value")), path, "{", "}")
