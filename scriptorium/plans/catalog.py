"""Registered queries: one per operator of the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over whole tables (or data
Spark derives from them, see ``fixtures``). Output columns are plain
scalars (arrays are joined to strings) and doubles are rounded to 6 digits,
so the DuckDB oracle in ``oracle.py`` can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, dense, sparse
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- A / B
@query("scan_documents")
def q_scan_documents(spark, d):
    return X.table(spark, d, "documents").select(
        "doc_id", X.page_of_source().alias("page_id"), "lang", "n_chars")


@query("word_count_filter")
def q_word_count_filter(spark, d):
    docs = X.article_docs(spark, d)
    return corpus.word_count_between(docs, "content", 1000, 3000).select("doc_id", "page_id", "n_words")


@query("new_titles")
def q_new_titles(spark, d):
    old, new = X.snapshots(spark, d)
    return corpus.new_rows(new, old, "title").select("id", "title")


@query("token_counts")
def q_token_counts(spark, d):
    docs = X.article_docs(spark, d)
    return docs.select("doc_id", T.token_count("content").alias("n_tokens"))


@query("strip_non_ascii")
def q_strip_non_ascii(spark, d):
    docs = X.article_docs(spark, d)
    return docs.select("doc_id", T.strip_non_ascii("content").alias("text"))


@query("chunk_docs")
def q_chunk_docs(spark, d):
    return corpus.chunk_docs(X.article_docs(spark, d))


@query("sentence_chunks")
def q_sentence_chunks(spark, d):
    """Documents in chunks of whole sentences, by what the corpus shows to end one."""
    from ..operators import sentences
    docs = X.article_docs(spark, d)
    cut = sentences.chunk_sentences(docs, sentences.learn(docs, "content"))
    return cut.select("page_id", "doc_id", F.posexplode("chunks").alias("chunk_pos", "chunk")).withColumn("n_tokens", T.token_count("chunk"))


@query("chunk_ids")
def q_chunk_ids(spark, d):
    return corpus.chunk_docs_numbered(X.article_docs(spark, d))


@query("html_to_text")
def q_html_to_text(spark, d):
    return corpus.html_to_text(X.table(spark, d, "pages"), "html").select("page_id", "text")


@query("section_extract")
def q_section_extract(spark, d):
    return corpus.extract_sections(X.table(spark, d, "pages"), "html")


@query("page_sections")
def q_page_sections(spark, d):
    r = corpus.page_records(X.wiki_pages(spark, d), "wikitext", "wiki")
    return r.select("page_id", "summary", F.array_join("references", " ").alias("links"),
                    F.posexplode(F.arrays_zip("sections", "content_by_section")).alias("pos", "z")).select(
        "page_id", "summary", "links", F.col("pos").cast("bigint").alias("pos"), F.col("z.sections.level").cast("bigint").alias("level"),
        F.array_join("z.sections.path", " > ").alias("path"), F.col("z.content_by_section").alias("text"))


@query("drop_empty_pages")
def q_drop_empty_pages(spark, d):
    secs = corpus.extract_sections(X.table(spark, d, "pages"), "html")
    # of every four pages one was fetched; the others gave blanks, nothing and a block page
    kind = F.pmod("page_id", F.lit(4))
    secs = secs.withColumn("text", F.when(kind == 1, F.lit("  ")).when(kind == 2, F.lit(None).cast("string"))
                           .when(kind == 3, F.concat(F.lit("Access denied. "), "text")).otherwise(F.col("text")))
    return corpus.drop_empty_texts(secs, "text", ("access denied",)).select(
        "page_id", "sec_pos", F.length("text").cast("bigint").alias("n_chars"))


@query("url_keep_last")
def q_url_keep_last(spark, d):
    last = corpus.keep_last(X.url_rows(spark, d), ["host", "url"], "pos")
    return last.select("host", "url", "pos", F.md5("text").alias("text_md5"))


@query("link_union")
def q_link_union(spark, d):
    pages = X.table(spark, d, "pages")
    refs = corpus.extract_links(pages, "html")
    hits = pages.select(
        "page_id",
        corpus.html_text(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        "url")
    return corpus.collect_links(refs, hits)


@query("section_rows")
def q_section_rows(spark, d):
    arts = X.conversation_articles(spark, d)
    return corpus.explode_sections(arts, "page_id", "outlines", "contents")


# ---------------------------------------------------------------- C
def _sparse(spark, d, method, k):
    queries = X.sparse_queries(spark, d)
    docs = X.article_docs(spark, d)
    return sparse.retrieve(queries, docs, k=k, method=method)


@query("bm25_topk")
def q_bm25_topk(spark, d):
    return _sparse(spark, d, "bm25", 5)


@query("tfidf_topk")
def q_tfidf_topk(spark, d):
    return _sparse(spark, d, "tfidf", 5)


@query("topk_padded")
def q_topk_padded(spark, d):
    return _sparse(spark, d, "bm25", 60)


def _indexed(spark, d, method, k):
    path = _folder(spark, f"{method}-index")
    sparse.build_index(X.article_docs(spark, d), path, method)
    return sparse.search_index(X.sparse_queries(spark, d), path, k, method)


@query("bm25_index_topk")
def q_bm25_index_topk(spark, d):
    return _indexed(spark, d, "bm25", 5)


@query("tfidf_index_topk")
def q_tfidf_index_topk(spark, d):
    return _indexed(spark, d, "tfidf", 5)


@query("section_query_text")
def q_section_query_text(spark, d):
    s = X.conversation_sections(spark, d)
    return s.select("page_id", "sec_pos", dense.section_query_text("section", "key").alias("query_text"))


def _dense(spark, d, keep=5):
    # blocks small enough for the large article to take several at every size
    return dense.dense_topk(X.vector_queries(spark, d), X.vectors(spark, d), k=50, keep=keep, block_rows=128)


@query("dense_topk")
def q_dense_topk(spark, d):
    return _dense(spark, d)


@query("retrieval_nested")
def q_retrieval_nested(spark, d):
    ranked = _dense(spark, d).join(
        X.vector_queries(spark, d).select("page_id", "sec_pos", "section"), ["page_id", "sec_pos"])
    nested = dense.nest_results(ranked)
    return nested.select(
        "page_id",
        F.array_join("sections", "|").alias("sections"),
        F.array_join(F.transform("top_chunks", lambda x: F.array_join(x, ",")), ";").alias("top_chunks"))


@query("chunk_coverage")
def q_chunk_coverage(spark, d):
    return dense.chunk_coverage(_dense(spark, d))


@query("retrieval_eligible")
def q_retrieval_eligible(spark, d):
    # every vector stands for an article of its own: some have no outline, some outlines no vector
    vectors = X.vectors(spark, d).withColumn("page_id", F.col("chunk_id"))
    return dense.eligible_articles(vectors, X.conversation_sections(spark, d))


@query("chunk_text_lookup")
def q_chunk_text_lookup(spark, d):
    texts = X.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"),
                                                  F.col("text").alias("content"))
    return dense.lookup_chunk_text(_dense(spark, d), texts, on=["chunk_id"]).select(
        "page_id", "sec_pos", "rank", "chunk_id", "content")


@query("hash_embed")
def q_hash_embed(spark, d):
    docs = X.article_docs(spark, d)
    e = dense.hash_embed(docs, "content", 64)
    digits = F.transform("embedding", lambda x: F.round(x.cast("double") * 10_000).cast("bigint").cast("string"))
    return e.select("page_id", "doc_id", F.array_join(digits, ",").alias("embedding_e4"))


# ---------------------------------------------------------------- D
from ..functions import constants as K  # noqa: E402
from ..operators import citations, judge, overlap, shaping  # noqa: E402


@query("section_filter")
def q_section_filter(spark, d):
    arts = X.conversation_articles(spark, d)
    return arts.select("page_id", F.array_join(shaping.drop_boilerplate("outlines"), "|").alias("outline"))


@query("clean_outline")
def q_clean_outline(spark, d):
    arts = X.conversation_articles(spark, d)
    return arts.select("page_id", F.array_join(shaping.clean_outline("outlines"), "|").alias("outline"))


@query("outline_explode")
def q_outline_explode(spark, d):
    from ..sources import readers
    arts = X.conversation_articles(spark, d)
    as_json = arts.select(F.to_json(F.create_map(F.col("page_id").cast("string"), F.col("outlines")))
                          .alias("value"))
    return readers.explode_outline_map(as_json, "value")


def _contexts(spark, d, keep=5):
    """Per section: its first ``keep`` chunk texts (non-ASCII stripped), in rank order."""
    secs = X.vector_queries(spark, d).select("page_id", "sec_pos", "section")
    # ranked and cut on ids; texts are joined to what is left
    ctx = X.with_chunk_text(shaping.section_context(secs, X.section_ranks(spark, d, keep=keep), keep), spark, d)
    ctx = ctx.withColumn("chunk", T.strip_non_ascii("chunk"))
    return shaping.ordered_list(ctx, ["page_id", "sec_pos", "section"], "rank", "chunk", "docs")


@query("section_context")
def q_section_context(spark, d):
    secs = X.vector_queries(spark, d).select("page_id", "sec_pos", "section")
    return shaping.section_context(secs, X.section_ranks(spark, d, keep=5), 5).select(
        "page_id", "sec_pos", "section", "rank", "chunk_id")


@query("numbered_context")
def q_numbered_context(spark, d):
    c = _contexts(spark, d)
    return c.select("page_id", "sec_pos", F.array_join(shaping.numbered(F.col("docs"), "colon"), "\n")
                    .alias("context"))


def _section_prompts(spark, d):
    c = _contexts(spark, d)
    head = shaping.fill(K.SECTION_PROMPT_HEAD, keyword=X.page_key(), section=F.col("section"))
    body = F.array_join(shaping.numbered(F.col("docs"), "colon"), "\n")
    return c.select("page_id", "sec_pos", head.alias("head"), body.alias("body"),
                    F.lit(K.SECTION_PROMPT_TAIL).alias("tail"))


@query("fit_budget")
def q_fit_budget(spark, d):
    p = _section_prompts(spark, d)
    total = F.size(T.words("head")) + F.size(T.words("body")) + F.size(T.words("tail"))
    kept = F.size(T.words(shaping.fit_budget("head", "body", "tail", K.PROMPT_BUDGET)))
    return p.select("page_id", "sec_pos", total.cast("bigint").alias("n_before"),
                    kept.cast("bigint").alias("n_after"))


@query("section_prompt")
def q_section_prompt(spark, d):
    p = _section_prompts(spark, d)
    return p.select("page_id", "sec_pos", F.lit("").alias("sys_prompt"),
                    shaping.fit_budget("head", "body", "tail", K.PROMPT_BUDGET).alias("usr_prompt"))


@query("outline_prompt")
def q_outline_prompt(spark, d):
    from pyspark.sql import Window
    best = X.section_ranks(spark, d).groupBy("page_id", "chunk_id").agg(F.max("score").alias("best"))
    w = Window.partitionBy("page_id").orderBy(F.desc("best"), "chunk_id")
    top = best.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    top = X.with_chunk_text(top, spark, d).withColumn("chunk", T.strip_non_ascii("chunk"))
    docs = shaping.ordered_list(top, ["page_id"], "rank", "chunk", "docs")
    head = shaping.fill(K.OUTLINE_PROMPT_HEAD, keyword=X.page_key())
    body = F.array_join(shaping.numbered(F.col("docs"), "colon"), "\n")
    return docs.select("page_id", shaping.fit_budget(head, body, F.lit(K.OUTLINE_PROMPT_TAIL),
                                                     K.PROMPT_BUDGET).alias("usr_prompt"))


def _writer_messages(spark, d):
    c = _contexts(spark, d)
    refs = shaping.numbered(F.col("docs"), "bracket")
    system = F.when(F.col("section") == "Introduction", F.lit("")).otherwise(
        F.lit(K.WRITER_PROMPTS["writer_per_section"]))
    user = shaping.writer_user_prompt(X.page_key(), F.col("section"), refs, "Section")
    return c.select("page_id", "sec_pos", shaping.messages(system, user).alias("messages"))


@query("writer_messages")
def q_writer_messages(spark, d):
    m = _writer_messages(spark, d)
    last = F.element_at("messages", -1)
    return m.select("page_id", "sec_pos", F.size("messages").cast("bigint").alias("n_messages"),
                    F.when(F.size("messages") == 2, F.col("messages")[0]["content"]).otherwise(F.lit(""))
                    .alias("system"), last["content"].alias("user"))


def _two(df, keys, msgs):
    m = df.withColumn("_m", msgs)
    return m.select(*keys, F.size("_m").cast("bigint").alias("n_messages"), F.md5(F.col("_m")[0]["content"]).alias("system_md5"),
                    F.md5(F.col("_m")[1]["content"]).alias("user_md5"),
                    (shaping.message_tokens("_m") < dict(K.MODEL_WINDOWS)["gpt-3.5-turbo-0613"]).alias("accepted"))


@query("rewrite_requests")
def q_rewrite_requests(spark, d):
    s = X.conversation_sections(spark, d)
    arts = shaping.ordered_list(s, ["page_id", "key"], "sec_pos", "text", "_t").select(
        "page_id", "key", F.array_join("_t", "\n").alias("text"))
    return _two(arts, ["page_id"], shaping.rewrite_messages("key", "text"))


@query("outline_requests")
def q_outline_requests(spark, d):
    c = _contexts(spark, d)
    return _two(c, ["page_id", "sec_pos"], shaping.outline_messages(X.page_key(), "docs"))


@query("judge_requests")
def q_judge_requests(spark, d):
    r = X.judge_replies(spark, d)
    return _two(r, ["doc_id"], judge.judge_messages("keyword", "text"))


@query("prompt_records")
def q_prompt_records(spark, d):
    s = X.conversation_sections(spark, d)
    rows = s.select("page_id", "key", "sec_pos", "section", F.array("text").alias("docs"), F.lit("").alias("sys_prompt"),
                    F.concat_ws("\n", "section", "text").alias("usr_prompt"))
    r = shaping.prompt_record(rows)
    return r.select("page_id", "key", F.array_join("outline", "|").alias("outline"),
                    F.md5(F.array_join(F.flatten("retrieved_chunks"), "|")).alias("chunks_md5"),
                    F.size("sys_prompt").cast("bigint").alias("n_prompts"), F.md5(F.array_join("usr_prompt", "|")).alias("prompts_md5"))


@query("message_tokens")
def q_message_tokens(spark, d):
    m = _writer_messages(spark, d)
    return m.select("page_id", "sec_pos", shaping.message_tokens("messages").alias("n_tokens"))


@query("budget_split")
def q_budget_split(spark, d):
    m = _writer_messages(spark, d).select(
        "page_id", "sec_pos", shaping.message_tokens("messages").alias("n_tokens"))
    return shaping.budget_flag(m, "n_tokens", model="gpt-3.5-turbo-0613", reserve=800)


@query("parse_response")
def q_parse_response(spark, d):
    r = X.responses(spark, d)
    return r.select("page_id", "idx", shaping.response_content("response").alias("content"))


@query("ordered_responses")
def q_ordered_responses(spark, d):
    r = X.responses(spark, d).select("page_id", "idx", shaping.response_content("response").alias("content"))
    o = shaping.ordered_list(r, ["page_id"], "idx", "content", "contents")
    return o.select("page_id", F.size("contents").cast("bigint").alias("n_responses"),
                    F.array_join("contents", "\n").alias("text"))


@query("section_rows_from_article")
def q_section_rows_from_article(spark, d):
    s = X.conversation_sections(spark, d)
    outline = shaping.ordered_list(s, ["page_id"], "sec_pos", "section", "outline")
    gen = shaping.ordered_list(s.filter(F.col("role") == "assistant"), ["page_id"], "sec_pos", "text",
                               "generated_content")
    art = outline.join(gen, "page_id")
    return shaping.zip_rows(art, "page_id", ["outline", "generated_content"])


@query("article_regroup")
def q_article_regroup(spark, d):
    s = X.conversation_sections(spark, d)
    g = shaping.regroup_sections(s, values=("section", "text"))
    return g.select("page_id", F.size("section").cast("bigint").alias("n_sections"),
                    F.array_join("section", "|").alias("outline"), F.array_join("text", "\n").alias("text"))


@query("rewrite_merge")
def q_rewrite_merge(spark, d):
    s = X.conversation_sections(spark, d)
    arts = shaping.ordered_list(s.filter(F.col("role") == "assistant"), ["page_id", "key"], "sec_pos",
                                "text", "_t").select("page_id", "key", F.array_join("_t", "\n").alias("text"))
    r = X.responses(spark, d).select("page_id", "idx", shaping.response_content("response").alias("content"))
    latest = corpus.keep_last(r, ["page_id"], "idx")
    return arts.join(latest, "page_id").select(
        "page_id", "key", F.concat_ws("\n", "key", "text").alias("rewrite_input"),
        F.col("content").alias("text"))


@query("outline_parse")
def q_outline_parse(spark, d):
    s = X.conversation_sections(spark, d)
    line = F.when(F.pmod("page_id", F.lit(2)) == 1, F.concat(F.lit("=="), F.col("section"), F.lit("==")))\
        .otherwise(F.concat((F.col("sec_pos") + 1).cast("string"), F.lit(". "), F.col("section")))
    lines = shaping.ordered_list(s.withColumn("line", line), ["page_id"], "sec_pos", "line", "_l")
    # a reply begins and ends with lines that are no section names
    replies = lines.select("page_id", F.concat(F.lit("Here is the outline:\n\n"), F.array_join("_l", "\n"),
                                               F.lit("\nI hope it helps.")).alias("reply"))
    return shaping.parse_outline(replies, "reply")


# ---------------------------------------------------------------- E
PK = X.PAIR_KEYS


def _pairs(spark, d):
    return overlap.pair_texts(*X.text_pairs(spark, d), PK)[0]


@query("flatten_text")
def q_flatten_text(spark, d):
    g = X.generated_articles(spark, d)
    return g.select("page_id", overlap.flatten_text(overlap.normalize_text_union("json")).alias("text"))


@query("missing_candidates")
def q_missing_candidates(spark, d):
    gold, cand = X.text_pairs(spark, d)
    return overlap.pair_texts(gold, cand, PK)[1]


@query("bleu")
def q_bleu(spark, d):
    return overlap.bleu(_pairs(spark, d), PK, (1, 4))


@query("meteor_exact")
def q_meteor_exact(spark, d):
    return overlap.meteor_exact(_pairs(spark, d), PK)


@query("meteor_stem")
def q_meteor_stem(spark, d):
    return overlap.meteor(_pairs(spark, d), PK)


@query("rouge_l")
def q_rouge_l(spark, d):
    return overlap.rouge_l(_pairs(spark, d), PK)


def _summary(spark, d, metrics, names):
    pairs = _pairs(spark, d).withColumn("length", overlap.candidate_length("cand"))
    return overlap.macro_summary(overlap.overlap_scores(pairs, [*PK, "length"], metrics), names, by=["src"])


@query("metric_summary")
def q_metric_summary(spark, d):
    return _summary(spark, d, ("bleu", "meteor"), ["bleu_1", "bleu_4", "meteor"])


def _units(spark, d):
    return citations.split_units(X.cited_documents(spark, d), ["doc_id"], "text")


@query("metric_summary_all")
def q_metric_summary_all(spark, d):
    return _summary(spark, d, ("bleu", "meteor", "rouge_l"), ["bleu_1", "bleu_4", "meteor", "rouge_l"])


@query("citation_units")
def q_citation_units(spark, d):
    return _units(spark, d)


@query("citation_ids")
def q_citation_ids(spark, d):
    u = _units(spark, d)
    return u.select("doc_id", "unit_pos", citations.hypothesis("unit").alias("hypothesis"),
                    F.array_join(citations.cited_ids("unit"), ",").alias("cites"))


def _premises(spark, d):
    """Citations resolved to documents on narrow rows; texts are joined last."""
    cited = citations.cite_records(X.cited_records(spark, d), ["doc_id"])
    texts = X.table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.col("text").alias("premise"))
    return cited.join(texts, "ref", "left").withColumn("premise", F.coalesce("premise", F.lit(" ")))


@query("citation_premises")
def q_citation_premises(spark, d):
    p = _premises(spark, d)
    return p.select("doc_id", "unit_pos", "cite_pos", "idx", F.md5("premise").alias("premise_md5"),
                    F.length("premise").cast("bigint").alias("premise_chars"))


@query("nli_inputs")
def q_nli_inputs(spark, d):
    p = _premises(spark, d)
    s = citations.nli_input("premise", "hypothesis")
    return p.select("doc_id", "unit_pos", "cite_pos", F.md5(s).alias("input_md5"),
                    F.length(s).cast("bigint").alias("input_chars"))


def _labels(spark, d, outer=False):
    """Lexical support labels. Each document's word set is computed once and
    joined to its citations (a document is the premise of up to 5 others)."""
    cited = citations.cite_records(X.cited_records(spark, d), ["doc_id"], outer=outer)
    words = X.table(spark, d, "documents").select(F.col("doc_id").alias("ref"), citations.word_set("text").alias("premise"))
    p = cited.join(words, "ref", "left").withColumn("premise", F.coalesce("premise", F.array().cast("array<string>")))
    return p.select("doc_id", "unit_pos", "cite_pos",
                    citations.lexical_support("premise", "hypothesis", premise_words=True).alias("label"))


@query("lexical_support")
def q_lexical_support(spark, d):
    return _labels(spark, d)


@query("unit_labels")
def q_unit_labels(spark, d):
    ul = citations.labels_per_unit(_labels(spark, d, outer=True), ["doc_id"]).filter("unit_pos IS NOT NULL")
    return ul.select("doc_id", "unit_pos", F.array_join("labels", ",").alias("labels"))


@query("citation_scores")
def q_citation_scores(spark, d):
    return citations.scores_of_units(citations.labels_per_unit(_labels(spark, d, outer=True), ["doc_id"]), ["doc_id"])


@query("section_premises")
def q_section_premises(spark, d):
    """Citations of generated articles, each resolved in its own section's list."""
    from ..operators import articles
    secs = articles.sections_of(articles.generated(X.generated_records(spark, d), "json"), ["page_id"])
    p = citations.cite_records(secs, ["page_id", "sec_pos"], refs="retrieve")
    return p.select("page_id", "sec_pos", "unit_pos", "cite_pos", "idx", F.md5("hypothesis").alias("hypothesis_md5"),
                    F.md5(F.coalesce("ref", F.lit(" "))).alias("premise_md5"))


@query("judge_prompt")
def q_judge_prompt(spark, d):
    r = X.judge_replies(spark, d)
    p = judge.judge_prompt("keyword", "text")
    return r.select("doc_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("bigint").alias("prompt_chars"))


@query("judge_scores")
def q_judge_scores(spark, d):
    r = X.judge_replies(spark, d).select("doc_id", judge.parse_scores("reply").alias("s"))
    return r.select("doc_id", F.col("s")[0].alias("fluency"), F.col("s")[1].alias("informativeness"),
                    F.col("s")[2].alias("faithfulness"))


@query("judge_summary")
def q_judge_summary(spark, d):
    r = X.judge_replies(spark, d).select(judge.parse_scores("reply").alias("score"))
    return judge.score_means(r, "score")


# ---------------------------------------------------------------- A (resume, streaming)
@query("outline_map_split")
def q_outline_map_split(spark, d):
    """Outlines written as JSON objects on one line each, read by byte ranges."""
    from ..sources import json_split
    path = _folder(spark, "outline-map")
    X.write_outline_maps(X.conversation_articles(spark, d), path)
    return json_split.read_outline_map_split(spark, path)


@query("search_results_split")
def q_search_results_split(spark, d):
    """Pages as search results in JSON arrays on one line each, read by byte ranges."""
    from ..sources import json_split
    path = _folder(spark, "search-results")
    pages = X.table(spark, d, "pages").select(F.to_json(F.struct(
        F.col("page_id").cast("string").alias("title"), F.col("url").alias("link"), F.col("html").alias("text"))).alias("value"))
    X.write_elements(pages, path, "[", "]")
    hits = json_split.read_json_array_split(spark, path, "struct<title:string,link:string,text:string>")
    return hits.select(F.col("title").cast("bigint").alias("page_id"), F.col("link").alias("url"), F.md5("text").alias("text_md5"))


def _folder(spark, name):
    from ..session import scratch_folder
    return scratch_folder(spark, name)


@query("article_files")
def q_article_files(spark, d):
    """Articles written as JSON objects in files, with a broken file among them, and read
    back; the broken one goes aside."""
    from ..sources import readers
    path = _folder(spark, "article-files")
    a = X.conversation_articles(spark, d)
    X.write_elements(a.select(F.to_json(F.struct(F.col("page_id").alias("id"), "key", "outlines", "contents")).alias("value")), path, "[", "]")
    a.groupBy().agg(F.lit('{"id": 1, "outlines": ["cut').alias("value")).write.mode("append").text(path)
    good, bad = readers.read_articles(spark, path, with_rejects=True)
    good = good.select("page_id", "key", F.array_join("outlines", "|").alias("outlines"), F.md5(F.array_join("contents", "|")).alias("contents_md5"))
    return good.unionByName(bad.select(F.col("id").alias("page_id"), F.lit("rejected").alias("key"),
                                       F.col("_corrupt_record").alias("outlines"), F.lit(None).cast("string").alias("contents_md5")))


@query("search_files")
def q_search_files(spark, d):
    from ..sources import readers
    path = _folder(spark, "search-files")
    pages = X.table(spark, d, "pages").select(F.to_json(F.struct(
        F.col("page_id").cast("string").alias("title"), F.col("url").alias("link"), F.col("html").alias("text"))).alias("value"))
    X.write_elements(pages, path, "[", "]")
    return readers.read_search_results(spark, path).select(F.col("title").cast("bigint").alias("page_id"), "url", F.md5("text").alias("text_md5"))


@query("retrieval_files")
def q_retrieval_files(spark, d):
    from ..sources import readers
    path = _folder(spark, "retrieval-files")
    sections = X.vector_queries(spark, d).select("page_id", "sec_pos", "section")
    nested = dense.nest_results(_dense(spark, d).join(sections, ["page_id", "sec_pos"]))
    X.write_elements(nested.select(F.to_json(F.struct(F.col("page_id").alias("id"), "sections", F.col("top_chunks").alias("top-chunks"))).alias("value")), path, "[", "]")
    r = readers.read_retrieval_results(spark, path)
    return r.select("page_id", "sec_pos", "section", "rank", F.col("chunk").cast("bigint").alias("chunk_id"))


@query("dataset_files")
def q_dataset_files(spark, d):
    """Chunked documents written clustered by article, section rows as JSON lines, over-budget
    keys aside; all read back."""
    from ..sources import writers
    path = _folder(spark, "dataset-files")
    docs = X.article_docs(spark, d).select("page_id", "doc_id", F.length("content").cast("bigint").alias("n_chars"))
    writers.write_with_rejects(docs.withColumn("accepted", F.col("n_chars") < 2000), f"{path}/good", f"{path}/log", key="doc_id")
    writers.write_dataset(docs, f"{path}/all", "page_id")
    writers.write_jsonl(docs, f"{path}/lines")
    whole = spark.read.schema(docs.schema).parquet(f"{path}/all").withColumn("kind", F.lit("all"))
    good = spark.read.schema(docs.schema).parquet(f"{path}/good/accepted=true").withColumn("kind", F.lit("good"))
    lines = spark.read.schema(docs.schema).json(f"{path}/lines").withColumn("kind", F.lit("lines"))
    log = spark.read.schema("doc_id bigint").json(f"{path}/log").select(
        F.lit(None).cast("bigint").alias("page_id"), "doc_id", F.lit(None).cast("bigint").alias("n_chars"), F.lit("log").alias("kind"))
    return whole.unionByName(good).unionByName(lines).unionByName(log)


@query("chunk_text_lookup_bucketed")
def q_chunk_text_lookup_bucketed(spark, d):
    """The chunk lookup on stored tables in buckets by article and chunk: ranked chunks
    and chunk texts meet without an exchange of either."""
    import uuid
    from ..sources import writers
    path, name = _folder(spark, "buckets"), f"t{uuid.uuid4().hex}"
    texts = X.vectors(spark, d).select("page_id", "chunk_id").join(
        X.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    buckets, on = int(spark.conf.get("spark.sql.shuffle.partitions")), ["page_id", "chunk_id"]
    writers.write_bucketed(_dense(spark, d).select("page_id", "chunk_id", "sec_pos", "rank"), f"{name}_ranked", f"{path}/ranked", on, buckets)
    writers.write_bucketed(texts, f"{name}_texts", f"{path}/texts", on, buckets)
    found = dense.lookup_chunk_text(spark.table(f"{name}_ranked"), spark.table(f"{name}_texts"), on=on)
    return found.select("page_id", "sec_pos", "rank", "chunk_id", F.md5("content").alias("text_md5"))


@query("retrieve_indices")
def q_retrieve_indices(spark, d):
    return sparse.retrieve(X.sparse_queries(spark, d), X.article_docs(spark, d), k=5, method="TFIDF", indices=True)


@query("attach_responses")
def q_attach_responses(spark, d):
    """Requests of every conversation's user turns get the text of the turn after, other fields kept."""
    from ..operators import articles
    c = X.table(spark, d, "conversations")
    inputs = c.filter("role = 'user'").select("conv_id", "turn", F.upper("role").alias("kind"), F.md5("text").alias("asked_md5"), "text")
    replies = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return articles.attach_responses(inputs, replies, ["conv_id", "turn"])


@query("article_records")
def q_article_records(spark, d):
    """Section texts with the chunks that each was written from, as one record per article."""
    from ..operators import articles
    c = _contexts(spark, d)
    secs = c.select("page_id", "sec_pos", "section", F.concat(F.col("section"), F.lit(": "), F.element_at("docs", 1)).alias("text"), F.col("docs").alias("retrieve"))
    r = articles.article_records(secs, ["page_id"])
    return r.select("page_id", F.array_join("outline", "|").alias("outline"), F.md5(F.array_join("text", "|")).alias("text_md5"),
                    F.md5(F.array_join(F.transform("retrieve", lambda x: F.array_join(x, "~")), "|")).alias("retrieve_md5"))


def _events(spark, d):
    """Requests and responses of every conversation, in four files: a turn's response
    comes up to three files after (or before) its request; every seventh failed and
    has none. The last file holds a row that ends all waiting."""
    s = X.conversation_sections(spark, d)
    n = s.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    at = lambda file: F.timestamp_seconds(F.lit(1_700_000_000) + file * 60)
    ask = s.join(n, "page_id").withColumn("file", F.pmod(F.col("page_id") + F.col("sec_pos"), F.lit(2)))
    ask = ask.select("page_id", F.lit("request").alias("kind"), F.col("sec_pos").alias("idx"), "n", "section", F.lit(None).cast("string").alias("text"), at(F.col("file")).alias("at"), "file")
    got = s.filter(F.pmod(F.col("page_id") + F.col("sec_pos"), F.lit(7)) != 0).withColumn("file", F.pmod(F.col("page_id") + 3 * F.col("sec_pos"), F.lit(4)))
    got = got.select("page_id", F.lit("response").alias("kind"), F.col("sec_pos").alias("idx"), F.lit(None).cast("bigint").alias("n"),
                     F.lit(None).cast("string").alias("section"), "text", at(F.col("file")).alias("at"), "file")
    return ask.unionByName(got)


@query("article_stream")
def q_article_stream(spark, d):
    """Articles put together from a stream of several micro-batches."""
    from ..streaming import regroup
    base = _folder(spark, "article-stream")
    events = _events(spark, d)
    columns = [c.split()[0] for c in regroup.EVENT.split(", ")]
    # the files in their order: a reader takes one after the other
    for i in range(4):
        events.filter(F.col("file") == i).select(*columns).coalesce(1).write.mode("append").parquet(f"{base}/events")
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("page_id"), F.lit("response").alias("kind"), F.lit(0).cast("bigint").alias("idx"),
                                F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("text"),
                                F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"))
    end.coalesce(1).write.mode("append").parquet(f"{base}/events")
    stream = spark.readStream.schema(regroup.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
    (regroup.regroup_stream(stream, "1 hour", late="10 minutes").writeStream.format("parquet").option("path", f"{base}/out")
     .option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination())
    out = spark.read.schema("page_id bigint, sections array<string>, texts array<string>, missing bigint, timed_out boolean").parquet(f"{base}/out")
    return out.select("page_id", F.array_join("sections", "|").alias("sections"), F.md5(F.array_join("texts", "|")).alias("texts_md5"),
                      "missing", F.col("timed_out").cast("int").alias("timed_out"))


@query("ingest_new_ids")
def q_ingest_new_ids(spark, d):
    """Pages in three files, the last of which repeats ids of the first ones; run twice."""
    from ..streaming import ingest
    base = _folder(spark, "ingest-ids")
    pages = X.table(spark, d, "pages").select("page_id", "url")
    for part in (F.pmod("page_id", F.lit(2)) == 0, F.pmod("page_id", F.lit(2)) == 1, F.pmod("page_id", F.lit(3)) == 0):
        pages.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        ingest.ingest_new_ids(spark, f"{base}/in", "page_id BIGINT, url STRING", f"{base}/out", f"{base}/state", ["page_id"])
    return spark.read.schema("page_id BIGINT, url STRING").parquet(f"{base}/out").select("page_id", "url")


@query("resume_pending")
def q_resume_pending(spark, d):
    from ..sources import readers
    lab = X.table(spark, d, "labels")
    # output file names of finished documents; a name that is not an integer is ignored
    names = lab.select(F.when(F.col("toxic") == 1, F.concat(F.lit("tmp_"), F.col("doc_id").cast("string")))
                       .otherwise(F.col("doc_id").cast("string")).alias("_stem"))
    done = names.select(F.concat(F.lit("/out/"), "_stem", F.lit(".json")).alias("_path")) \
        .select(readers.file_key("_path").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    todo = X.table(spark, d, "documents").select("doc_id", "source")
    return readers.pending(todo, done, "doc_id")


@query("incremental_ingest")
def q_incremental_ingest(spark, d):
    from ..streaming.ingest import ingest_available
    run = _folder(spark, "ingest")
    schema = "page_id BIGINT, url STRING, html STRING"

    def to_text(df):
        return df.select("page_id", "url", F.length(corpus.html_text("html")).cast("bigint").alias("n_chars"))

    for _ in range(2):  # the second run finds no new file and adds nothing
        ingest_available(spark, f"{d.rstrip('/')}/pages*.parquet", schema, f"{run}/out", f"{run}/ckpt", to_text)
    return spark.read.parquet(f"{run}/out")
