"""Outline, context and response shaping (section filters, numbered context,
token budgets, chat messages, response parsing and ordered regrouping).

Lists keep an explicit position column through every shuffle and are
rebuilt with ``sort_array(collect_list(struct(pos, ...)))``; a group is one
article's sections or one section's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import (
    MODEL_WINDOWS, OUTLINE_EXCLUDED_SECTIONS, PROMPT_BUDGET, PROMPT_EXCLUDED_SECTIONS,
    TOKENS_BASE, TOKENS_PER_MESSAGE, TOKENS_PER_NAME, WRITER_PROMPTS)


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# D2 -------------------------------------------------------------------------
def is_boilerplate(section, names=PROMPT_EXCLUDED_SECTIONS) -> Column:
    return F.array_contains(_names(names), F.lower(T._c(section)))


def drop_boilerplate(outline, names=PROMPT_EXCLUDED_SECTIONS) -> Column:
    """Array form: keep section names not in ``names`` (case-insensitive)."""
    return F.filter(T._c(outline), lambda s: ~F.array_contains(_names(names), F.lower(s)))


# D3 -------------------------------------------------------------------------
def clean_outline(outline) -> Column:
    """``_`` becomes a space, then six boilerplate names are dropped."""
    spaced = F.transform(T._c(outline), lambda s: F.replace(s, F.lit("_"), F.lit(" ")))
    return F.filter(spaced, lambda s: ~F.array_contains(_names(OUTLINE_EXCLUDED_SECTIONS), F.lower(s)))


# D4 -------------------------------------------------------------------------
def section_context(sections: DataFrame, ranked: DataFrame, keep: int = 5, *,
                    key: str = "page_id", sec: str = "sec_pos") -> DataFrame:
    """Sections (after the boilerplate filter) joined with their ranked chunks,
    first ``keep`` per section. An inner join: a section without a chunk list
    (or chunks without a section) is dropped, as a zip stops at the shorter."""
    s = sections.filter(~is_boilerplate("section"))
    return s.join(ranked.filter(F.col("rank") <= keep), [key, sec])


# D5 -------------------------------------------------------------------------
def numbered(docs: Column, style: str = "colon", titles: Column | None = None,
             urls: Column | None = None) -> Column:
    """``Document 1: d`` (colon), ``Document [1] d`` (bracket) or ``Document
    [1] (Title: t, u) d`` (titled) lines joined by newline."""
    if style == "colon":
        lines = F.transform(docs, lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"),
                                                       F.lit(": "), d))
    elif style == "bracket":
        lines = F.transform(docs, lambda d, i: F.concat(F.lit("Document ["), (i + 1).cast("string"),
                                                       F.lit("] "), d))
    elif style == "titled":
        z = F.arrays_zip(docs.alias("d"), titles.alias("t"), urls.alias("u"))
        lines = F.transform(z, lambda x, i: F.concat(
            F.lit("Document ["), (i + 1).cast("string"), F.lit("] (Title: "), x["t"], F.lit(", "),
            x["u"], F.lit(") "), x["d"]))
    else:
        raise ValueError(style)
    return lines


def ordered_list(df: DataFrame, keys: list[str], pos: str, value: str, out: str) -> DataFrame:
    """Per ``keys`` the ``value`` list ordered by ``pos``."""
    return (df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("_l"))
            .select(*keys, F.transform("_l", lambda x: x[value]).alias(out)))


# D6 -------------------------------------------------------------------------
def fit_budget(head, body, tail, max_tokens: int = PROMPT_BUDGET) -> Column:
    """``head + body + tail``, with ``body`` cut after the last word that fits
    the budget (never below zero words); ``head``, ``tail`` and what is kept of
    ``body`` stay as they are, white space included. Word tokens stand in for a
    model's BPE tokens."""
    h, b, t = T._c(head), T._c(body), T._c(tail)
    room = F.greatest(F.lit(0), F.lit(max_tokens) - F.size(T.words(h)) - F.size(T.words(t)))
    cut = F.array_join(F.slice(F.regexp_extract_all(b, F.lit(T.SPACED_WORD), 0), 1, room), "")
    return F.concat(h, F.when(F.size(T.words(b)) <= room, b).otherwise(cut), t)


def fill(template: str, **cols) -> Column:
    """Put columns into a ``{name}`` template."""
    parts, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(T._c(cols[rest[i + 1:j]]))
        rest = rest[j + 1:]
    return F.concat(*parts)


# D9 / D10 -------------------------------------------------------------------
def writer_user_prompt(key, subtitle=None, refs=None, chapter_word: str = "Section") -> Column:
    """``Keyword: k\\n`` + ``{chapter_word}: s\\n`` (a string subtitle) or
    ``Outline: a, b`` (an array subtitle, no newline) + refs joined by
    newline, then a newline (when there are refs)."""
    parts = [F.lit("Keyword: "), T._c(key), F.lit("\n")]
    if subtitle is not None:
        sub = T._c(subtitle)
        parts.append(F.when(sub.isNull() | (sub == ""), F.lit("")).otherwise(
            F.concat(F.lit(f"{chapter_word}: "), sub, F.lit("\n"))))
    prompt = F.concat(*parts)
    return prompt if refs is None else add_refs(prompt, refs)


def outline_user_prompt(key, outline, refs=None) -> Column:
    o = T._c(outline)
    prompt = F.concat(F.lit("Keyword: "), T._c(key), F.lit("\n"),
                      F.when(F.size(o) > 0, F.concat(F.lit("Outline: "), F.array_join(o, ", ")))
                      .otherwise(F.lit("")))
    return prompt if refs is None else add_refs(prompt, refs)


def add_refs(prompt: Column, refs) -> Column:
    r = T._c(refs)
    return F.when(F.size(r) > 0, F.concat(prompt, F.array_join(r, "\n"), F.lit("\n"))).otherwise(prompt)


def messages(system, user) -> Column:
    """``[{role, content}]``: the system message is omitted when empty."""
    s, u = T._c(system), T._c(user)
    sys_msg = F.struct(F.lit("system").alias("role"), s.alias("content"))
    usr_msg = F.struct(F.lit("user").alias("role"), u.alias("content"))
    return F.when(s.isNull() | (s == ""), F.array(usr_msg)).otherwise(F.array(sys_msg, usr_msg))


def rewrite_messages(key, text) -> Column:
    """The request to rewrite an article: its title and text as one passage."""
    passage = F.concat(F.lit("Original Passage:\n"), T._c(key), F.lit("\n"), T._c(text))
    return messages(F.lit(WRITER_PROMPTS["rewrite"]), passage)


def outline_messages(key, docs) -> Column:
    """The request for an outline from retrieved documents."""
    refs = numbered(T._c(docs), "bracket")
    return messages(F.lit(WRITER_PROMPTS["outline"]), writer_user_prompt(key, None, refs))


def prompt_record(sections: DataFrame, *, key: str = "page_id", title: str = "key", pos: str = "sec_pos",
                  section: str = "section", docs: str = "docs", system: str = "sys_prompt",
                  user: str = "usr_prompt") -> DataFrame:
    """Section rows to one record per article: ``key, outline,
    retrieved_chunks, sys_prompt, usr_prompt`` as parallel arrays in section
    order. The group is one article's outline."""
    fields = (section, docs, system, user)
    packed = sections.groupBy(key, title).agg(F.sort_array(F.collect_list(F.struct(pos, *fields))).alias("_s"))
    names = ("outline", "retrieved_chunks", "sys_prompt", "usr_prompt")
    return packed.select(key, F.col(title).alias("key"), *[
        F.transform("_s", (lambda field: lambda x: x[field])(f)).alias(n) for f, n in zip(fields, names)])


# D12 ------------------------------------------------------------------------
def message_tokens(msgs) -> Column:
    """3 + per message (3 + tokens of every value, + 1 for a ``name``); word
    and punctuation tokens stand in for BPE."""
    m = T._c(msgs)
    return F.aggregate(
        m, F.lit(TOKENS_BASE).cast("bigint"),
        lambda acc, x: acc + TOKENS_PER_MESSAGE + T.token_count(x["role"]) + T.token_count(x["content"]))


def message_tokens_named(msgs) -> Column:
    """As ``message_tokens`` for messages that carry a ``name`` field."""
    m = T._c(msgs)
    return F.aggregate(
        m, F.lit(TOKENS_BASE).cast("bigint"),
        lambda acc, x: acc + TOKENS_PER_MESSAGE + T.token_count(x["role"]) + T.token_count(x["content"])
        + F.when(x["name"].isNotNull(), T.token_count(x["name"]) + TOKENS_PER_NAME).otherwise(0))


# D13 / A10 ------------------------------------------------------------------
def model_windows(spark) -> DataFrame:
    """The 8-row model window table (a fixed-size broadcast side)."""
    return spark.createDataFrame(list(MODEL_WINDOWS), "model string, window bigint")


def budget_flag(df: DataFrame, tokens: str = "n_tokens", model: str = "gpt-3.5-turbo-0613",
                reserve: int = 800, model_col: str | None = None) -> DataFrame:
    """``accepted = tokens < window[model] - reserve`` (strict). With
    ``model_col`` each row names its model; the window table (8 rows) is
    broadcast."""
    windows = dict(MODEL_WINDOWS)
    if model_col is None:
        return df.withColumn("accepted", F.col(tokens) < F.lit(windows[model] - reserve))
    w = F.broadcast(model_windows(df.sparkSession).withColumnRenamed("model", model_col))
    return (df.join(w, model_col, "left")
            .withColumn("accepted", F.coalesce(F.col(tokens) < F.col("window") - reserve, F.lit(False)))
            .drop("window"))


def split_by_budget(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows): two filters over one flagged plan."""
    flagged = budget_flag(df, **kw)
    return (flagged.filter("accepted").drop("accepted"),
            flagged.filter("NOT accepted").drop("accepted"))


# D14 ------------------------------------------------------------------------
RESPONSE_SCHEMA = "struct<choices:array<struct<message:struct<content:string>>>>"


def response_content(col) -> Column:
    """First choice's message content, stripped; '' when absent or failed."""
    parsed = F.from_json(T._c(col), RESPONSE_SCHEMA)
    content = F.try_element_at(parsed["choices"], F.lit(1))["message"]["content"]
    return F.coalesce(T.py_strip(content), F.lit(""))


# D16 ------------------------------------------------------------------------
def zip_rows(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Parallel arrays to one row per position, cut to the shortest (a bare
    ``arrays_zip`` would pad with NULL)."""
    n = F.least(*[F.size(a) for a in arrays])
    zipped = F.arrays_zip(*[F.slice(a, 1, n).alias(a) for a in arrays])
    return (df.select(key, F.posexplode(zipped).alias("sec_pos", "_z"))
            .select(key, F.col("sec_pos").cast("bigint").alias("sec_pos"),
                    *[F.col(f"_z.{a}").alias(a) for a in arrays]))


# D19 ------------------------------------------------------------------------
_NUMBERED_LINE = "^ *[0-9]+\\. *(.*?) *$"
_HEADING_LINE = "^ *==+ *(.*?) *==+ *$"


def parse_outline(df: DataFrame, reply: str = "reply", key: str = "page_id") -> DataFrame:
    """Reply text to ordered section names, from ``n. Name`` or ``==Name==``
    lines; other and blank lines are dropped; ``sec_pos`` is the line index."""
    lines = df.select(key, F.posexplode(F.split(F.col(reply), "\n")).alias("sec_pos", "_l"))
    line = F.regexp_replace("_l", "\r$", "")
    name = F.when(line.rlike(_HEADING_LINE), F.regexp_extract(line, _HEADING_LINE, 1)) \
        .when(line.rlike(_NUMBERED_LINE), F.regexp_extract(line, _NUMBERED_LINE, 1))
    return (lines.select(key, F.col("sec_pos").cast("bigint").alias("sec_pos"), name.alias("section"))
            .filter(F.col("section").isNotNull() & (F.col("section") != "")))


# D11 ------------------------------------------------------------------------
def writer_requests(articles: DataFrame, level: str, *, refs: DataFrame | None = None,
                    retrieved: DataFrame | None = None, num: int = 5, given_outline: bool = False,
                    model: str = "gpt-3.5-turbo-0613", reserve: int = 800,
                    key: str = "page_id", title: str = "key", outline: str = "outlines") -> DataFrame:
    """Writer requests per article at a retrieval level, flagged against the
    model's token budget (``accepted``; rejected rows are the fail log), with the
    documents used (``retrieve``, empty without references) as the written article
    keeps them.

    * ``vanilla``: no references;
    * ``tfidf`` / ``bm25``: the top ``num`` of the article's own reference docs
      (``refs``: key, doc_pos, title, url, content) for the article title,
      written ``Document [i] (Title: t, u) doc``;
    * any other level: pre-retrieved chunks (``retrieved``: key, rank, chunk),
      non-ASCII stripped, first ``num``, written ``Document [i] doc``.
    """
    from ..functions.constants import WRITER_PROMPTS
    from . import sparse

    base = articles.select(key, title, outline)
    lv = level.lower()
    if lv == "vanilla":
        system = WRITER_PROMPTS["vanilla_given_outline" if given_outline else "vanilla"]
        lines = docs_used = None
        req = base
    else:
        system = WRITER_PROMPTS["writer_given_outline" if given_outline else "writer"]
        if lv in ("tfidf", "bm25"):
            q = base.select(key, F.col(key).alias("_qid"), F.col(title).alias("_query"))
            docs = refs.select(key, F.col("doc_pos").alias("_doc"), "doc_pos", "title", "url", "content")
            top = sparse.retrieve(q, docs, k=num, method=lv, key=key, qid="_qid", doc="_doc",
                                  query="_query", content="content")
            top = top.join(docs, [key, "_doc"]).select(key, "rank", "title", "url", "content")
            per = (top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "title", "url", "content")))
                                        .alias("_r")))
            docs_used = F.transform("_r", lambda x: x["content"])
            lines = numbered(docs_used, "titled",
                             F.transform("_r", lambda x: x["title"]), F.transform("_r", lambda x: x["url"]))
        else:
            r = retrieved.filter(F.col("rank") <= num).withColumn("chunk", T.strip_non_ascii("chunk"))
            per = r.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "chunk"))).alias("_r"))
            docs_used = F.transform("_r", lambda x: x["chunk"])
            lines = numbered(docs_used, "bracket")
        req = base.join(per, key, "left")
    refs_col = None if lines is None else F.coalesce(lines, F.array().cast("array<string>"))
    if given_outline:
        user = outline_user_prompt(title, outline, refs_col)
    else:
        user = writer_user_prompt(title, None, refs_col)
    none = F.array().cast("array<string>")
    used = none if docs_used is None else F.coalesce(docs_used, none)
    out = req.select(key, messages(F.lit(system), user).alias("messages"), used.alias("retrieve"))
    out = out.withColumn("n_tokens", message_tokens("messages"))
    return budget_flag(out, "n_tokens", model=model, reserve=reserve)


# D15 / D17 ------------------------------------------------------------------
def regroup_sections(rows: DataFrame, *, key: str = "page_id", pos: str = "sec_pos",
                     values: tuple[str, ...] = ("section", "text")) -> DataFrame:
    """Section rows back to one row per article, each value a list in section
    order (responses restored to request order, per-section texts to an
    article). A group is one article's sections."""
    packed = F.sort_array(F.collect_list(F.struct(pos, *values))).alias("_s")
    g = rows.groupBy(key).agg(packed)
    return g.select(key, *[_field_list("_s", v) for v in values])


def _field_list(col: str, field: str) -> Column:
    return F.transform(col, lambda x: x[field]).alias(field)
