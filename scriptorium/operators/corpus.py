"""Corpus building: snapshot difference, length filter, sections, links,
page text, chunking.

Every operator takes and returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import CHUNK_SIZE
from .sequence import running_offset

# --- fixed values: the HTML entities of the given pages, for the oracle's SQL;
# "&amp;" goes last so that "&amp;lt;" becomes the text "&lt;".
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"),
    ("&copy;", "©"), ("&amp;", "&"),
)

_SCRIPT = "(?is)<script[^>]*>.*?</script[^>]*>"
_STYLE = "(?is)<style[^>]*>.*?</style[^>]*>"
_COMMENT = "(?s)<!--.*?-->"
_TAG = "<[^>]*>"
_HEADING = "(?is)<h[1-6][^>]*>(.*?)</h[1-6][^>]*>"
_WIKI_HEADING = "(?m)^==+ *([^=\\n]+?) *==+ *$"


# B1 -------------------------------------------------------------------------
def new_rows(new: DataFrame, old: DataFrame, key: str = "title") -> DataFrame:
    """Rows of ``new`` whose ``key`` does not occur in ``old``. Every such row
    is kept (no de-duplication). NULL is a value like any other (a set of
    titles may hold None), so the comparison is null-safe."""
    old_keys = old.select(F.col(key).alias("_old_key")).distinct()
    return new.join(old_keys, new[key].eqNullSafe(old_keys["_old_key"]), "left_anti")


# B2 -------------------------------------------------------------------------
def word_count_between(df: DataFrame, col: str = "text", lo: int = 1000,
                       hi: int = 3000, out: str | None = "n_words") -> DataFrame:
    """Keep rows whose whitespace word count is within ``[lo, hi]``."""
    n = T.word_count(col)
    if out:
        return df.withColumn(out, n).filter(F.col(out).between(lo, hi))
    return df.filter(n.between(lo, hi))


# B6 -------------------------------------------------------------------------
def strip_markup(col) -> Column:
    """Drop scripts, styles, comments; every tag becomes one space."""
    c = T._c(col)
    for pat in (_SCRIPT, _STYLE, _COMMENT):
        c = F.regexp_replace(c, pat, " ")
    return F.regexp_replace(c, _TAG, " ")


def unescape_entities(col) -> Column:
    """Decode named, decimal and hexadecimal character references (in one pass,
    so ``&amp;lt;`` becomes the text ``&lt;``); unknown ones stay as they are."""
    named = F.create_map(*[F.lit(x) for n, ch in html.entities.html5.items() if n.endswith(";") for x in (n[:-1], ch)])
    parts = F.split(T._c(col), "&")

    def number(digits, base):
        n = F.try_conv(digits, base) if hasattr(F, "try_conv") else F.conv(digits, base, 10).try_cast("bigint")
        good = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def decode(p):
        name = F.regexp_extract(p, "^(#[xX]?0*[0-9A-Fa-f]{1,8}|[0-9A-Za-z]{1,32});", 1)
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        ch = (F.when(name.rlike("^#[xX]0*[0-9A-Fa-f]{1,6}$"), number(digits, 16))
              .when(name.rlike("^#0*[0-9]{1,7}$"), number(digits, 10))
              .when(name != "", F.try_element_at(named, name)))
        return F.when(ch.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(ch, F.substr(p, F.length(name) + 2)))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decode)
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def html_text(col) -> Column:
    """Readable text of an HTML document, whitespace collapsed."""
    return T.collapse_ws(unescape_entities(strip_markup(col)))


def html_to_text(df: DataFrame, col: str = "html", out: str = "text") -> DataFrame:
    return df.withColumn(out, html_text(col))


# B3 -------------------------------------------------------------------------
def extract_sections(df: DataFrame, col: str = "html", form: str = "html",
                     key: str = "page_id") -> DataFrame:
    """One row per section ``(key, sec_pos, section, text)``. Section 0 is the
    text before the first heading (its name is ''). ``form='html'`` splits at
    ``<h1>``..``<h6>``; ``form='wiki'`` at ``==NAME==`` lines."""
    c = T._c(col)
    if form == "html":
        for pat in (_SCRIPT, _STYLE, _COMMENT):
            c = F.regexp_replace(c, pat, " ")
        marked = F.regexp_replace(c, _HEADING, "\u0001$1\u0002")
    elif form == "wiki":
        marked = F.regexp_replace(c, _WIKI_HEADING, "\u0001$1\u0002")
    else:
        raise ValueError(f"unknown form {form!r}")
    parts = df.select(key, F.posexplode(F.split(marked, "\u0001")).alias("sec_pos", "_part"))
    has_name = F.col("sec_pos") > 0
    name_raw = F.when(has_name, F.substring_index("_part", "\u0002", 1)).otherwise(F.lit(""))
    body_raw = F.when(has_name, F.regexp_replace("_part", "^[^\u0002]*\u0002", "")).otherwise(F.col("_part"))
    clean = html_text if form == "html" else T.collapse_ws
    return parts.select(
        key, F.col("sec_pos").cast("bigint").alias("sec_pos"),
        clean(name_raw).alias("section"), clean(body_raw).alias("text"))


_LEVEL_HEADING = "(?is)<h([1-6])[^>]*>(.*?)</h[1-6][^>]*>"
_LEVEL_WIKI = "(?m)^(==+) *([^=\\n]+?) *==+ *$"
_REF_URL = "https?://[^\\s<>\"'\\]\\[|}]+"


def page_records(df: DataFrame, col: str = "html", form: str = "html", key: str = "page_id") -> DataFrame:
    """One record per page: ``key, title, summary, sections, content,
    content_by_section, references``.

    ``sections`` is an array of ``pos, level, name, path``; a heading's path holds
    the names of the headings it lies under and its own: its parent is the last
    heading before it of a smaller level (``<h1>``..``<h6>``, or the number of ``=``
    signs). ``title`` is the ``<title>`` or else the first ``<h1>`` (a wiki page's is
    empty), ``summary`` the text before the first section (an ``<h1>`` that is the
    title's heading begins none), ``content_by_section`` the sections' texts in their order,
    ``content`` all text, ``references`` the distinct addresses of links in order of
    appearance. A null page is an empty one; a page is one row and its headings a
    running array of it, so nothing is shuffled."""
    c = F.coalesce(T._c(col).cast("string"), F.lit(""))
    if form == "html":
        for pat in (_SCRIPT, _STYLE, _COMMENT):
            c = F.regexp_replace(c, pat, " ")
        heading, clean = _LEVEL_HEADING, html_text
        found = html_text(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1))
        first = html_text(F.regexp_extract(c, "(?is)<h1[^>]*>(.*?)</h1[^>]*>", 1))
        title = F.when(found != "", found).otherwise(first)
        body = F.regexp_replace(c, "(?is)<title[^>]*>.*?</title>", " ")
        links = F.transform(F.regexp_extract_all(c, F.lit(_ANCHOR), 1), unescape_entities)
    elif form == "wiki":
        heading, clean, title, body = _LEVEL_WIKI, T.collapse_ws, F.lit(""), c
        links = F.regexp_extract_all(c, F.lit(_REF_URL), 0)
    else:
        raise ValueError(f"unknown form {form!r}")
    parts = F.split(F.regexp_replace(body, heading, "\u0001$1\u0002$2\u0003"), "\u0001")
    rows = df.select(key, title.alias("title"), links.alias("links"), parts.alias("parts"))
    mark = F.substring_index
    level = lambda x: mark(x, "\u0002", 1)
    heads = F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: F.struct(
        (level(x).cast("int") if form == "html" else F.length(level(x))).alias("level"),
        clean(mark(mark(x, "\u0003", 1), "\u0002", -1)).alias("name"),
        clean(F.regexp_replace(x, "^[^\u0003]*\u0003", "")).alias("text")))
    rows = rows.select(key, "title", "links", clean(F.element_at("parts", 1)).alias("lead"), heads.alias("heads"))
    # the heading that repeats the page's title begins no section
    own = (F.size("heads") > 0) & (F.element_at("heads", 1)["level"] == 1) if form == "html" else F.lit(False)
    rows = rows.withColumn("own", own).withColumn("h", F.when(F.col("own"), F.slice("heads", 2, F.greatest(F.size("heads") - 1, F.lit(0)))).otherwise(F.col("heads")))
    start = F.struct(F.array().cast("array<struct<level:int,name:string>>").alias("open"),
                     F.array().cast("array<struct<pos:int,level:int,name:string,path:array<string>>>").alias("all"))

    def under(a, x):
        open_ = F.concat(F.filter(a["open"], lambda o: o["level"] < x["level"]), F.array(F.struct(x["level"].alias("level"), x["name"].alias("name"))))
        return F.struct(open_.alias("open"), F.concat(a["all"], F.array(F.struct(
            F.size(a["all"]).alias("pos"), x["level"].alias("level"), x["name"].alias("name"), F.transform(open_, lambda o: o["name"]).alias("path")))).alias("all"))

    summary = T.collapse_ws(F.concat_ws(" ", F.col("lead"), F.when(F.col("own"), F.element_at("heads", 1)["text"])))
    every = F.concat(F.array(F.col("lead")), F.flatten(F.transform("heads", lambda x: F.array(x["name"], x["text"]))))
    return rows.select(
        key, "title", summary.alias("summary"), F.aggregate("h", start, under, lambda a: a["all"]).alias("sections"),
        F.array_join(F.filter(every, lambda x: x != ""), "\n").alias("content"),
        F.transform("h", lambda x: x["text"]).alias("content_by_section"), F.array_distinct("links").alias("references"))


# B4 -------------------------------------------------------------------------
def explode_sections(df: DataFrame, key: str = "page_id", names: str = "outlines",
                     contents: str = "contents") -> DataFrame:
    """Parallel ``outlines``/``contents`` arrays to ``(key, sec_pos, section,
    content)``; the shorter array decides the count."""
    n = F.least(F.size(names), F.size(contents))
    zipped = F.arrays_zip(F.slice(names, 1, n).alias("section"),
                          F.slice(contents, 1, n).alias("content"))
    return df.select(key, F.posexplode(zipped).alias("sec_pos", "_z")).select(
        key, F.col("sec_pos").cast("bigint").alias("sec_pos"),
        F.col("_z.section").alias("section"), F.col("_z.content").alias("content"))


# B5 -------------------------------------------------------------------------
def collect_links(references: DataFrame, search_hits: DataFrame,
                  key: str = "page_id") -> DataFrame:
    """Union of an article's own references (tagged 'Wikipedia') and its
    search hits (tagged 'Google') as ``(key, title, url, source)``."""
    cols = [key, "title", "url"]
    return (references.select(*cols).withColumn("source", F.lit("Wikipedia"))
            .unionByName(search_hits.select(*cols).withColumn("source", F.lit("Google"))))


_ANCHOR = "(?is)<a\\s(?:[^>]*\\s)?href\\s*=\\s*[\"']([^\"'>]*)[\"'][^>]*>(.*?)</a>"


def extract_links(df: DataFrame, col: str = "html", key: str = "page_id") -> DataFrame:
    """``(key, title, url)`` for every anchor with a quoted address, whatever
    its other attributes; the title is the readable text of its content."""
    c = T._c(col)
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(_ANCHOR), 1).alias("url"),
                        F.regexp_extract_all(c, F.lit(_ANCHOR), 2).alias("title"))
    return (df.select(key, F.explode(both).alias("_a"))
            .select(key, html_text(F.col("_a.title")).alias("title"), F.col("_a.url").alias("url")))


def explode_references(articles: DataFrame, key: str = "page_id",
                       col: str = "reference") -> DataFrame:
    """``reference`` triples ``[title, url, text]`` to rows."""
    r = F.col("_r")
    return articles.select(key, F.explode(col).alias("_r")).select(
        key, F.element_at(r, 1).alias("title"), F.element_at(r, 2).alias("url"),
        F.element_at(r, 3).alias("text"))


# B7 -------------------------------------------------------------------------
def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` (a later
    duplicate overwrites the value). An aggregate with map-side partial
    ``max_by`` rather than a window, so a hot key is pre-reduced before the
    shuffle."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.max_by(packed, F.col(order)).alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others]))


# B8 -------------------------------------------------------------------------
def drop_empty_texts(df: DataFrame, col: str = "text",
                     block_phrases: tuple[str, ...] = ()) -> DataFrame:
    """Drop failed fetches (NULL) and texts of only whitespace; optionally
    texts matching any block-page phrase (case-insensitive)."""
    c = F.col(col)
    out = df.filter(c.isNotNull() & (T.py_strip(c) != ""))
    if block_phrases:
        import re
        alt = "|".join(re.escape(p) for p in block_phrases)
        out = out.filter(~F.lower(c).rlike(f"({alt.lower()})"))
    return out


# B9 -------------------------------------------------------------------------
def tokenize(df: DataFrame, col: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, T.tokens(col))


# B10 ------------------------------------------------------------------------
def chunk_array(tok_col, size: int = CHUNK_SIZE) -> Column:
    """Consecutive windows of ``size`` tokens of an already materialised token
    array column, each joined by one space; the last may be shorter; no tokens
    gives an empty array. (A lambda re-evaluates any expression it captures
    once per element, so the tokens must be a column, not an expression.)"""
    tok = T._c(tok_col)
    n = F.size(tok)
    n_chunks = F.floor((n + (size - 1)) / size)
    windows = F.transform(
        F.sequence(F.lit(0), n_chunks - 1),
        lambda i: F.array_join(F.slice(tok, i * size + 1, size), " "))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def chunk_docs(docs: DataFrame, size: int = CHUNK_SIZE, key: str = "page_id",
               doc: str = "doc_id", content: str = "content") -> DataFrame:
    """``(key, doc, chunk_pos, content)``: one row per chunk; a missing
    content counts as ''. Map-only: no shuffle."""
    text = F.coalesce(F.col(content), F.lit(""))
    return (docs.select(key, doc, T.tokens(text).alias("_tok"))
            .select(key, doc, F.posexplode(chunk_array("_tok", size)).alias("chunk_pos", "content"))
            .withColumn("chunk_pos", F.col("chunk_pos").cast("bigint")))


# B11 ------------------------------------------------------------------------
def chunk_docs_numbered(docs: DataFrame, size: int = CHUNK_SIZE, key: str = "page_id",
                        doc: str = "doc_id", order: str = "doc_pos",
                        content: str = "content", staging: str | None = None) -> DataFrame:
    """Chunks with ``chunk_id`` continuous from 0 across all documents of a
    ``key``, in ``order`` (the document's position in its article).

    Documents are tokenized and cut once; the per-document chunk arrays are
    staged as a parquet table (``staging``, default a fresh folder under the
    shared checkpoint folder), which also cuts the lineage. The chunk counts
    are then read back as a narrow column and prefix-summed with the
    skew-safe two-level scheme of ``running_offset``; the offsets are joined
    at document level, before the explode."""
    from ..session import scratch_folder
    spark = docs.sparkSession
    text = F.coalesce(F.col(content), F.lit(""))
    per_doc = (docs.select(key, order, doc, T.tokens(text).alias("_tok"))
               .select(key, order, doc, chunk_array("_tok", size).alias("_chunks"))
               .withColumn("_n", F.size("_chunks")))
    path = staging or scratch_folder(spark, "chunks")
    per_doc.write.mode("overwrite").parquet(path)
    staged = spark.read.parquet(path)
    offsets = running_offset(staged, key, [order, doc], "_n", out="_off")
    same = staged[key].eqNullSafe(offsets[key]) & staged[order].eqNullSafe(offsets[order]) & staged[doc].eqNullSafe(offsets[doc])
    return (staged.join(offsets, same)
            .select(staged[key], staged[doc], "_off", F.posexplode("_chunks").alias("chunk_pos", "content"))
            .select(key, (F.col("_off") + F.col("chunk_pos")).cast("bigint").alias("chunk_id"),
                    doc, "content"))
