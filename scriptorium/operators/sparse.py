"""Sparse retrieval inside an article: TF-IDF cosine and Okapi BM25 top-k.

The corpus of a query is the set of documents of one article (``key``).
Scoring is an inverted-index join: query terms meet the postings of the
same ``(key, term)``; documents that share no term with the query are never
paired with it. Texts are cut into terms and counted inside Arrow batches;
document frequencies are aggregated with map-side combination, so a hot article
or a hot term is reduced before any shuffle; AQE splits skewed join partitions.
TF-IDF retrieval and the index stage the documents' counted terms, a row per run of
blocks of documents (``counted_blocks``); BM25 retrieval writes no corpus-size intermediate.

Top-k always returns ``min(k, n)`` documents of the article: documents that
match nothing score 0 and are filled in by document order.

``build_index`` weighs all postings once and stores them in blocks of documents
with the largest weight of every block; ``search_index`` asks it many times and
scores only blocks that can still reach a query's top k.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import BM25_B, BM25_EPSILON, BM25_K1, SPARSE_K
from ..session import scratch_folder, stage

#: characters of text that are counted at once (a longer text is alone)
BATCH_CHARS = 2_000_000
#: characters of text in a run of blocks that shares one list of terms
RUN_CHARS = 4_000_000
#: hash values by which stored terms are sieved before they meet those of the queries
SIEVE = 1 << 18
#: Python's word class holds the letters, digits and underscore of ``T.TOKEN``, ``T.TERM``
_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_TOKEN = re.compile(f"\\w+|[^\\w{_SPACE}]")
_TERM = re.compile("\\w{2,}")
CUTS = {"tokens": _TOKEN.findall, "terms": lambda text: _TERM.findall(text.lower())}
#: the same in Spark, for the queries
CUT_COLUMNS = {"tokens": T.tokens, "terms": T.terms}


def _counted(texts: list[str], cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(text, term number, count of every distinct term of a text; the terms; tokens per text)."""
    number: dict[str, int] = {}
    codes, size = [], []
    for t in texts:
        found = cut(t)
        size.append(len(found))
        codes.extend([number.setdefault(w, len(number)) for w in found])
    size = np.array(size, dtype=np.int64)
    pair, count = np.unique(np.repeat(np.arange(len(texts)), size) * max(1, len(number)) + np.array(codes, dtype=np.int64), return_counts=True)
    return pair // max(1, len(number)), pair % max(1, len(number)), count, list(number), size


def text_runs(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``BATCH_CHARS`` of ``text``."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(size) // BATCH_CHARS)) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def postings(docs: DataFrame, cut: str, *, key: str = "page_id", doc: str = "doc_id", content: str = "content",
             lengths: bool = False) -> DataFrame:
    """``(key, doc, dl, term, tf)`` for every distinct term of a document, in one
    map-only pass. With ``lengths`` every document has one more row with a null
    term, so that aggregating by term counts documents and their lengths, too."""
    types = dict(docs.dtypes)

    def run(batches):
        for b in batches:
            for part in text_runs(b, "_text"):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                row, code, count, terms, size = _counted(texts, CUTS[cut])
                term = pa.array(terms, pa.string()).take(pa.array(code))
                if lengths:
                    row, count = np.append(row, np.arange(len(texts))), np.append(count, np.zeros(len(texts), np.int64))
                    term = pa.concat_arrays([term, pa.nulls(len(texts), pa.string())])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(at), part.column(doc).take(at), pa.array(size[row]), term, pa.array(count.astype(np.int64))],
                    names=[key, doc, "dl", "term", "tf"])

    return docs.select(key, doc, F.col(content).cast("string").alias("_text")).mapInArrow(
        run, f"{key} {types[key]}, {doc} {types[doc]}, dl bigint, term string, tf bigint")


def _query_terms(queries: DataFrame, cut: str, key: str, qid: str, query: str) -> DataFrame:
    tok = CUT_COLUMNS[cut](F.coalesce(F.col(query), F.lit("")))
    return (queries.select(qid, key, F.explode(tok).alias("term"))
            .groupBy(qid, key, "term").agg(F.count(F.lit(1)).alias("qn")))


# ---------------------------------------------------------------- blocks of documents
def _listed(values: pa.Array, offsets=None) -> pa.ListArray:
    """``values`` as one list, or cut at ``offsets``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)] if offsets is None else offsets, pa.int32()), values)


def counted_blocks(docs: DataFrame, cut: str, *, key: str, doc: str, content: str, order: str | None = None, block_docs: int = 128) -> DataFrame:
    """One row per run of blocks, staged in buckets by ``key, blk``, so that what is
    joined by these moves to it and it stays where it is.

    An article's documents are dealt by a hash of their ids into blocks of about
    ``block_docs``, rows of one id into one block; a run is as many blocks of an article
    as hold about ``RUN_CHARS`` characters. ``blk`` is the number of its first block,
    ``docs`` are its rows with their lengths ``dl``, their block ``nth`` in the run and
    their ``orders`` (if asked for), ``terms`` its distinct terms with the number of rows
    that hold them (``df``), and ``doc_at, tf`` its postings, term after term: the place
    of the row and the count. Terms lie in the order of ``buckets`` (a hash of the term),
    which begin at ``cuts``. Texts move once; a posting is two numbers and no row."""
    types = dict(docs.dtypes)
    # the partitions are counted by the session, so that adaptive joining of small ones does not put all blocks in one task
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [key, "blk", "docs", "dl", "nth", *(["orders"] if order else []), "terms", "df", "buckets", "cuts", "doc_at", "tf"]
    kinds = {key: types[key], "blk": "bigint", "docs": f"array<{types[doc]}>", "dl": "array<bigint>", "terms": "array<string>", "df": "array<bigint>"}
    kinds |= {"orders": f"array<{types[order]}>"} if order else {}
    schema = ", ".join(f"{c} {kinds.get(c, 'array<int>')}" for c in names)

    def counted(blk: int, held: list[pa.RecordBatch]) -> tuple[int, pa.RecordBatch]:
        number: dict[str, int] = {}
        parts, first = [], 0
        for b in held:
            row, code, count, terms, size = _counted([t or "" for t in b.column("_text").to_pylist()], CUTS[cut])
            code = np.array([number.setdefault(t, len(number)) for t in terms], dtype=np.int64)[code] if len(code) else code
            parts.append((row + first, code, count, size))
            first += b.num_rows
        row, code, count, size = (np.concatenate(x) for x in zip(*parts))
        ids = pa.concat_arrays([b.column("_doc") for b in held])
        # a row begins a document unless the row before has its id
        same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy(zero_copy_only=False)
        begins = np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(ids))))
        nth = np.unique(begins // block_docs, return_inverse=True)[1]
        terms = pa.array(list(number), pa.string())
        bucket = np.fromiter((zlib.crc32(t.encode()) % n for t in number), np.int64, len(number))
        by = pc.sort_indices(pa.table({"b": bucket, "t": terms}), sort_keys=[("b", "ascending"), ("t", "ascending")]).to_numpy()
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        code = rank[code]
        sort = np.lexsort((row, code))
        buckets, cuts = np.unique(bucket, return_counts=True)
        lists = [ids, pa.array(size, pa.int64()), pa.array(nth.astype(np.int32))]
        lists += [pa.concat_arrays([b.column("_order") for b in held])] if order else []
        lists += [terms.take(pa.array(by)), pa.array(np.bincount(code, minlength=len(by)).astype(np.int64)),
                  pa.array(buckets.astype(np.int32)), pa.array(np.append(0, np.cumsum(cuts)).astype(np.int32)),
                  pa.array(row[sort].astype(np.int32)), pa.array(count[sort].astype(np.int32))]
        return blk + int(nth[-1]) + 1, pa.RecordBatch.from_arrays([held[0].column("_key").slice(0, 1), pa.array([blk], pa.int64()), *map(_listed, lists)], names=names)

    def run(batches):
        blk, held, chars, last = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            for b in text_runs(batch, "_text"):
                size = pc.fill_null(pc.binary_length(b.column("_text")), 0).to_pylist()
                first = 0
                for i, now in enumerate(zip(b.column("_key").to_pylist(), b.column("_doc").to_pylist())):
                    if last and (now[0] != last[0] or chars >= RUN_CHARS and (now[1] is None or now[1] != last[1])):
                        held += [b.slice(first, i - first)] if i > first else []
                        blk, out = counted(blk, held)
                        yield out
                        held, chars, first = [], 0, i
                    chars, last = chars + size[i], now
                held.append(b.slice(first))
        if held:
            yield counted(blk, held)[1]

    rows = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(doc).alias("_doc"), *([F.col(order).alias("_order")] if order else []), F.col(content).cast("string").alias("_text"))
    # ids in the order of their hash; rows without one anywhere
    rows = rows.withColumn("_at", F.when(F.col("_doc").isNull(), F.xxhash64("_text")).otherwise(F.xxhash64("_doc")))
    rows = rows.repartitionByRange(n, "_key", "_at").sortWithinPartitions("_key", "_at", "_doc").drop("_at").mapInArrow(run, schema)
    name, path = f"t{uuid.uuid4().hex}", scratch_folder(docs.sparkSession, "term-blocks")
    (rows.write.mode("overwrite").bucketBy(n, key, "blk").option("compression", "zstd").option("path", path).saveAsTable(name))
    return docs.sparkSession.table(name)


def block_terms(blocks: DataFrame, key: str) -> DataFrame:
    """``key, blk, at, term, df`` of every distinct term of a block."""
    return blocks.select(key, "blk", F.posexplode(F.arrays_zip("terms", "df")).alias("at", "_t")).select(
        key, "blk", "at", F.col("_t.terms").alias("term"), F.col("_t.df").alias("df"))


def weighed_blocks(blocks: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """``key, term, docs (doc, w)`` of the blocks' terms that ``terms (key, term, idf,
    wanted)`` wants. A run of blocks asks for its terms once and gets the answers back;
    a posting's weight is ``tf * idf``, divided by the document's norm. Rows of the same
    id are one document. Null ids have no postings."""
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    answers = (block_terms(blocks, key).join(terms, [key, "term"]).groupBy(key, "blk")
               .agg(F.collect_list(F.struct("at", "idf", "wanted")).alias("answers")))
    rows = blocks.select(key, "blk", "docs", "terms", "df", "doc_at", "tf").join(answers, [key, "blk"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                lists = {c: b.column(c).flatten() for c in ("docs", "terms", "df", "doc_at", "tf", "answers")}
                df_, row, tf = (lists[c].to_numpy(zero_copy_only=False) for c in ("df", "doc_at", "tf"))
                code = np.repeat(np.arange(len(df_)), df_)
                got = {c: lists["answers"].field(c).to_numpy(zero_copy_only=False) for c in ("at", "idf", "wanted")}
                idf, wanted = np.zeros(len(df_)), np.zeros(len(df_), dtype=bool)
                idf[got["at"]], wanted[got["at"]] = got["idf"], got["wanted"]
                coded, own, n = _owners(lists["docs"])
                w, owner = tf * idf[code], own[row]
                norm = _norms(w, owner, n)
                keep = (owner >= 0) & wanted[code]
                if not keep.any():
                    continue
                pair, back = np.unique(code[keep].astype(np.int64) * n + owner[keep], return_inverse=True)
                w = np.bincount(back, weights=w[keep]) / norm[pair % n]
                first = np.flatnonzero(np.append(True, np.diff(pair // n) != 0))
                listed = _listed(pa.StructArray.from_arrays([coded.take(pa.array(pair % n)), pa.array(w)], names=["doc", "w"]), np.append(first, len(pair)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(pa.array(np.zeros(len(first), dtype=np.int64))), lists["terms"].take(pa.array(pair[first] // n)), listed], names=[key, "term", "docs"])

    return rows.mapInArrow(run, f"{key} {dict(blocks.dtypes)[key]}, term string, docs array<struct<doc:{kind},w:double>>")


def _owners(docs: pa.Array) -> tuple[pa.Array, np.ndarray, int]:
    """The distinct ids, every row's number among them (-1: no id), how many (1 at least)."""
    coded = docs.dictionary_encode()
    return coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))


def _norms(w: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The Euclidean norm of every document's weights."""
    return np.sqrt(np.bincount(owner[owner >= 0], weights=(w * w)[owner >= 0], minlength=n))


# ---------------------------------------------------------------- weights
def bm25_terms(docs: DataFrame, *, key: str = "page_id", doc: str = "doc_id", content: str = "content",
               epsilon: float = BM25_EPSILON) -> tuple[DataFrame, DataFrame]:
    """(``key, term, idf``, ``key, avgdl``): ``idf = ln(N - df + 0.5) - ln(df + 0.5)``;
    a negative one is replaced by ``epsilon * mean(idf over the article's terms)``."""
    counts = (postings(docs, "tokens", key=key, doc=doc, content=content, lengths=True)
              .groupBy(key, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl")))
    stats = counts.filter("term IS NULL").select(key, F.col("df").alias("n_docs"), (F.col("dl") / F.col("df")).alias("avgdl"))
    return _bm25_idf(counts.filter("term IS NOT NULL"), stats, key, epsilon), stats.select(key, "avgdl")


def _bm25_idf(counts: DataFrame, stats: DataFrame, key: str, epsilon: float) -> DataFrame:
    idf = counts.join(stats, key).select(
        key, "term", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    floor = idf.groupBy(key).agg((F.avg("idf") * epsilon).alias("eps"))
    return idf.join(floor, key).select(key, "term", F.when(F.col("idf") < 0, F.col("eps")).otherwise(F.col("idf")).alias("idf"))


def _bm25_weight(k1: float, b: float) -> Column:
    tf, norm = F.col("tf"), F.col("dl") / F.col("avgdl")
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))


def bm25_scores(queries: DataFrame, docs: DataFrame, *, key: str = "page_id",
                qid: str = "query_id", query: str = "query", doc: str = "doc_id",
                content: str = "content", k1: float = BM25_K1, b: float = BM25_B,
                epsilon: float = BM25_EPSILON) -> DataFrame:
    """``(qid, key, doc, score)`` for documents sharing a token with the query.

    Okapi BM25 over word-and-punctuation tokens, case kept: every query token (with
    repeats) adds ``idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))``.

    Document frequencies and lengths are one aggregation (what moves are
    vocabularies), and only tokens that a query of the same article asks for become
    postings."""
    names = {"key": key, "doc": doc, "content": content}
    idf, stats = bm25_terms(docs, epsilon=epsilon, **names)
    qt = _query_terms(queries, "tokens", key, qid, query)
    asked = qt.select(key, "term").distinct()
    post = postings(docs, "tokens", **names).join(asked, [key, "term"], "left_semi")
    known = idf.join(asked, [key, "term"], "left_semi").join(stats, key)
    return (qt.join(known, [key, "term"]).join(post, [key, "term"])
            .groupBy(qid, key, doc).agg(F.sum(F.col("qn") * _bm25_weight(k1, b)).alias("score")))


def tfidf_terms(blocks: DataFrame, key: str) -> DataFrame:
    """``key, term, idf`` of ``counted_blocks`` with ``idf = ln((1 + n) / (1 + df)) + 1`` (smoothed)."""
    n = blocks.groupBy(key).agg(F.sum(F.size("docs")).alias("n_docs"))
    df_ = block_terms(blocks, key).groupBy(key, "term").agg(F.sum("df").alias("df"))
    return df_.join(n, key).select(key, "term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_scores(queries: DataFrame, docs: DataFrame, *, key: str = "page_id",
                 qid: str = "query_id", query: str = "query", doc: str = "doc_id",
                 content: str = "content") -> DataFrame:
    """``(qid, key, doc, score)``: cosine of L2-normalised TF-IDF vectors.

    Terms are lower-cased runs of 2+ word characters; query terms outside the
    article's vocabulary are dropped. Blocks of documents get the idf of their terms,
    so norms are sums inside a block, and only terms that a query of the same article
    asks for become postings."""
    blocks = counted_blocks(docs, "terms", key=key, doc=doc, content=content)
    idf = stage(tfidf_terms(blocks, key), "idf")
    qt = stage(_query_terms(queries, "terms", key, qid, query), "query-terms")
    qw = qt.join(idf, [key, "term"]).withColumn("qw", F.col("qn") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy(qid, key)))
    qw = qw.select(qid, key, "term", (F.col("qw") / norm).alias("qw"))
    asked = qt.select(key, "term", F.lit(True).alias("wanted")).distinct()
    terms = idf.join(asked, [key, "term"], "left").fillna(False, ["wanted"])
    post = weighed_blocks(blocks, terms, key)
    return (qw.join(post, [key, "term"]).select(qid, key, "qw", F.explode("docs").alias("p"))
            .groupBy(qid, key, F.col("p.doc").alias(doc)).agg(F.sum(F.col("qw") * F.col("p.w")).alias("score")))


# ---------------------------------------------------------------- top k
def topk_padded(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int = SPARSE_K, *,
                key: str = "page_id", qid: str = "query_id", doc: str = "doc_id",
                order: str = "doc_pos", allow_negative: bool = True) -> DataFrame:
    """``(qid, key, rank, doc, score)``: the ``min(k, n)`` best documents of
    the query's article by (score rounded to 6 digits desc, ``order`` asc);
    documents without a score count 0.

    Candidates are the scored documents plus the first ``k`` documents of the
    article; when some scores are negative (BM25 with a negative idf floor)
    the prefix grows by the number of negative scores of that query, which
    is exact: past it, k non-negative documents precede any unscored one.
    With ``allow_negative=False`` (cosine scores) that extension is skipped."""
    q = queries.select(qid, key).distinct()
    d = docs.select(key, doc, order)
    first_k = (d.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(order, doc)))
               .filter(F.col("_p") <= k).drop("_p"))
    fill = q.join(first_k, key)
    if allow_negative:
        # the scores feed three branches below: computed once, lineage cut
        scores = stage(scores, "scores")
        neg = (scores.filter(F.col("score") < 0).groupBy(qid, key)
               .agg(F.count(F.lit(1)).alias("_n_neg")))
        most = neg.agg(F.max("_n_neg")).first()[0]
        if most:  # a literal limit, so each task keeps only so many rows of an article
            neg_docs = (d.join(neg.select(key).distinct(), key, "left_semi")
                        .withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(order, doc)))
                        .filter(F.col("_p") <= k + most))
            fill_more = (neg.join(neg_docs, key).filter(F.col("_p") <= k + F.col("_n_neg"))
                         .select(qid, key, doc, order))
            fill = fill.unionByName(fill_more)
    scored = scores.join(d, [key, doc]).select(qid, key, doc, order, "score", F.lit(1).alias("_s"))
    cand = (fill.select(qid, key, doc, order, F.lit(0.0).alias("score"), F.lit(0).alias("_s"))
            .unionByName(scored)
            .groupBy(qid, key, doc, order).agg(F.max_by("score", "_s").alias("score")))
    w = Window.partitionBy(qid, key).orderBy(F.desc("_r"), F.col(order), F.col(doc))
    return (cand.withColumn("_r", T.round6("score"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(qid, key, F.col("rank").cast("bigint").alias("rank"), doc,
                    F.col("_r").alias("score")))


def retrieve(queries: DataFrame, docs: DataFrame, k: int = SPARSE_K, method: str = "tfidf",
             indices: bool = False, **cols) -> DataFrame:
    """Dispatch on a case-insensitive method name; ``indices=True`` keeps only
    the ranked document ids."""
    fns = {"tfidf": tfidf_scores, "bm25": bm25_scores}
    fn = fns[method.lower()]
    order = cols.pop("order", "doc_pos")
    keys = {c: cols[c] for c in ("key", "qid", "doc") if c in cols}
    scores = fn(queries, docs, **cols)
    out = topk_padded(scores, queries, docs, k, order=order, allow_negative=fn is bm25_scores, **keys)
    if indices:
        return out.select(keys.get("qid", "query_id"), keys.get("key", "page_id"), "rank",
                          keys.get("doc", "doc_id"))
    return out


# ---------------------------------------------------------------- a stored index
def frequencies(blocks: DataFrame, key: str) -> DataFrame:
    """``key, blk, bucket, df, terms, term_df``, staged: for every bucket of a run of
    blocks the number of the article's rows that hold each of its terms, in the order of
    the run's terms, and every term of the article with that number once, in one of the
    rows. What moves is a row per run and bucket."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(blocks.dtypes)[key]

    def asked(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                lists = {c: b.column(c).flatten() for c in ("buckets", "cuts", "terms", "df")}
                same = pa.array(np.zeros(len(lists["buckets"]), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(same), b.column("blk").take(same), lists["buckets"], *(_listed(lists[c], lists["cuts"]) for c in ("terms", "df"))],
                    names=[key, "blk", "bucket", "terms", "df"])

    def summed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cuts = np.append(0, np.cumsum(b.column("terms").value_lengths().to_numpy()))
        coded = b.column("terms").flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        total = np.bincount(code, weights=b.column("df").flatten().to_numpy()).astype(np.int64)
        first = np.unique(code, return_index=True)[1]
        # terms are numbered as they come, so their first places rise
        return pa.RecordBatch.from_arrays(
            [b.column(key), b.column("blk"), b.column("bucket"), _listed(pa.array(total[code]), cuts),
             _listed(coded.dictionary, np.searchsorted(first, cuts)), _listed(pa.array(total), np.searchsorted(first, cuts))],
            names=[key, "blk", "bucket", "df", "terms", "term_df"])

    def answered(batches):
        held, last = [], None
        for b in batches:
            at = list(zip(b.column("bucket").to_pylist(), b.column(key).to_pylist()))
            cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and at[lo] != last:
                    yield summed(held)
                    held = []
                if hi > lo:
                    last = at[lo]
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield summed(held)

    asks = blocks.select(key, "blk", "buckets", "cuts", "terms", "df").mapInArrow(asked, f"{key} {kind}, blk bigint, bucket int, terms array<string>, df array<bigint>")
    rows = asks.repartition(n, "bucket").sortWithinPartitions("bucket", key)
    return stage(rows.mapInArrow(answered, f"{key} {kind}, blk bigint, bucket int, df array<bigint>, terms array<string>, term_df array<bigint>"), "frequencies")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_index(docs: DataFrame, path: str, method: str = "bm25", *, block_docs: int = 128, key: str = "page_id",
                doc: str = "doc_id", content: str = "content", order: str = "doc_pos", k1: float = BM25_K1, b: float = BM25_B,
                epsilon: float = BM25_EPSILON) -> None:
    """Write an inverted index of every article's documents below ``path``:

    * ``docs``: ``key, doc, order, blk, at, norm, times``, an article's documents dealt
      into blocks of about ``block_docs`` with their place in the block, what length does
      to their weights, and how many rows have the document's id;
    * ``terms``: ``key, term, idf, gain``, of all its terms;
    * ``postings``: ``key, term, blocks (blk, top, at, tf)``, the blocks of a term's
      postings with the largest weight in each (rounded up to a float), the places of its
      documents and their counts. A term has a row for every run of ``counted_blocks``.

    A posting's weight is ``gain * tf / (tf + norm)`` with BM25 and ``gain * tf / norm`` else,
    once for each row of the id. A document's score for a query is the sum over query
    terms of that weight times the query's own (see ``search_index``)."""
    blocks = counted_blocks(docs, "tokens" if method == "bm25" else "terms", key=key, doc=doc, content=content, order=order, block_docs=block_docs)
    found = frequencies(blocks, key)
    counts = found.select(key, F.explode(F.arrays_zip("terms", "term_df")).alias("t")).select(key, F.col("t.terms").alias("term"), F.col("t.term_df").alias("df"))
    stats = stage(blocks.groupBy(key).agg(F.sum(F.size("docs")).alias("n_docs"), F.sum(F.aggregate("dl", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("dl"))
                  .select(key, "n_docs", (F.col("dl") / F.col("n_docs")).alias("avgdl"), F.lit(None).cast("double").alias("eps")), "index-stats")

    def idf(df: Column) -> Column:
        if method != "bm25":
            return F.log((1 + F.col("n_docs")) / (1 + df)) + 1
        plain = F.log(F.col("n_docs") - df + 0.5) - F.log(df + 0.5)
        return F.when(plain < 0, F.coalesce("eps", plain)).otherwise(plain)

    if method == "bm25":
        floor = counts.join(stats, key).groupBy(key).agg((F.avg(idf(F.col("df"))) * epsilon).alias("eps"))
        stats = stage(stats.drop("eps").join(floor, key, "left"), "index-stats")
    scale = k1 + 1 if method == "bm25" else 1.0
    _stored(counts.join(stats, key).select(key, "term", idf(F.col("df")).alias("idf"), (idf(F.col("df")) * scale).alias("gain")), f"{path}/terms")

    answers = (found.groupBy(key, "blk").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "df"))), lambda x: x["df"])).alias("held"))
               .join(stats, key).select(key, "blk", F.transform("held", lambda x: idf(x) * scale).alias("gain"), "avgdl"))
    # runs without a term have no answers
    rows = blocks.join(answers, [key, "blk"], "left")
    kind, types = dict(blocks.dtypes)[key], dict(docs.dtypes)

    def numbers(row: pa.RecordBatch, name: str) -> np.ndarray:
        return row.column(name).flatten().to_numpy(zero_copy_only=False)

    def weighed(row: pa.RecordBatch):
        """(number of the document, norm, rows of its id) of every row; (term, row, count, weight) of every posting."""
        _, own, n = _owners(row.column("docs").flatten())
        code, at, tf = np.repeat(np.arange(len(row.column("df").flatten())), numbers(row, "df")), numbers(row, "doc_at"), numbers(row, "tf")
        w = numbers(row, "gain")[code] * tf if len(code) else np.zeros(0)
        if method == "bm25":
            norm = k1 * (1 - b + b * (numbers(row, "dl") / row.column("avgdl")[0].as_py())) if len(code) else np.zeros(len(own))
            w = w / (tf + norm[at])
        else:
            norm = _norms(w, own[at], n)[own]
            w = w / np.where(own[at] >= 0, norm[at], 1)
        return own, norm, np.bincount(own[own >= 0], minlength=n)[own], code, at, tf, w

    def rows_of_docs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                nth = numbers(row, "nth")
                own, norm, times = weighed(row)[:3]
                begin = np.searchsorted(nth, nth)
                yield pa.RecordBatch.from_arrays(
                    [row.column(key).take(pa.array(np.zeros(len(nth), dtype=np.int64))), row.column("docs").flatten(), row.column("orders").flatten(),
                     pa.array(row.column("blk")[0].as_py() + nth.astype(np.int64)), pa.array((np.arange(len(nth)) - begin).astype(np.int32)),
                     pa.array(norm), pa.array(times.astype(np.int64))], names=[key, "_doc", "_order", "blk", "at", "norm", "times"])

    def rows_of_terms(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                nth = numbers(row, "nth").astype(np.int64)
                own, _, times, code, at, tf, w = weighed(row)
                keep = own[at] >= 0
                if not keep.any():
                    continue
                code, at, tf, w = code[keep], at[keep], tf[keep], w[keep]
                begins = lambda *by: np.flatnonzero(np.append(True, np.any([np.diff(x) != 0 for x in by], axis=0)))
                # postings lie term after term, in the order of the rows: by block, then by document
                doc, blk = begins(code, own[at]), begins(code, nth[at])
                top = np.maximum.reduceat(np.add.reduceat(w, doc) * times[at[doc]], np.searchsorted(doc, blk))
                up = top.astype(np.float32)
                up = np.where(up < top, np.nextafter(up, np.float32(np.inf)), up)
                cuts, place = np.append(blk, len(code)), (at - np.searchsorted(nth, nth[at])).astype(np.int32)
                held = pa.StructArray.from_arrays(
                    [pa.array(row.column("blk")[0].as_py() + nth[at[blk]]), pa.array(up, pa.float32()), _listed(pa.array(place), cuts), _listed(pa.array(tf.astype(np.int32)), cuts)],
                    names=["blk", "top", "at", "tf"])
                term = begins(code[blk])
                yield pa.RecordBatch.from_arrays(
                    [row.column(key).take(pa.array(np.zeros(len(term), dtype=np.int64))), row.column("terms").flatten().take(pa.array(code[blk[term]])),
                     _listed(held, np.append(term, len(blk)))], names=[key, "term", "blocks"])

    stored = rows.drop("terms").mapInArrow(rows_of_docs, f"{key} {kind}, _doc {types[doc]}, _order {types[order]}, blk bigint, at int, norm double, times bigint")
    _stored(stored.select(key, F.col("_doc").alias(doc), *([F.col("_order").alias(order)] if order != doc else []), "blk", "at", "norm", "times"), f"{path}/docs")
    _stored(rows.drop("orders").mapInArrow(rows_of_terms, f"{key} {kind}, term string, blocks array<struct<blk:bigint,top:float,at:array<int>,tf:array<int>>>"), f"{path}/postings")


def _sieved(stored: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows of ``stored`` whose article and term have a hash value that one of
    ``asked`` has: all that can be joined with it, and little else if few are asked.
    There are ``SIEVE`` values, so however much is asked, they fit in every task."""
    value = lambda: F.pmod(F.xxhash64(key, "term"), F.lit(SIEVE))
    return stored.withColumn("_v", value()).join(F.broadcast(asked.select(value().alias("_v")).distinct()), "_v", "left_semi").drop("_v")


def index_scores(queries: DataFrame, spark: SparkSession, path: str, k: int, method: str = "bm25", *, key: str = "page_id",
                 qid: str = "query_id", query: str = "query", doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(``qid, key, doc, score`` of every document that can be among a query's top
    k, the blocks read ``qid, key, blk, bound``).

    A block's documents score at most ``bound``, the sum of its terms' largest
    weights. The k blocks with the highest bounds are scored first; their k-th best
    score is a limit that a document of the top k reaches, so of the others only
    blocks whose bound reaches it are read."""
    qt = stage(_query_terms(queries, "tokens" if method == "bm25" else "terms", key, qid, query), "index-terms")
    known = qt.join(_sieved(spark.read.parquet(f"{path}/terms"), qt, key), [key, "term"])
    if method == "bm25":
        qw = known.select(qid, key, "term", "gain", F.col("qn").cast("double").alias("qw"))
    else:
        known = known.withColumn("qw", F.col("qn") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy(qid, key)))
        qw = known.select(qid, key, "term", "gain", (F.col("qw") / norm).alias("qw"))
    qw = stage(qw, "index-queries")
    postings = _sieved(spark.read.parquet(f"{path}/postings"), qw, key)
    tops = postings.select(key, "term", F.col("blocks.blk").alias("blk"), F.col("blocks.top").alias("top"))
    bounds = (qw.join(tops, [key, "term"]).select(qid, key, "qw", F.explode(F.arrays_zip("blk", "top")).alias("p"))
              .groupBy(qid, key, F.col("p.blk").alias("blk")).agg(F.sum(F.greatest(F.col("qw") * F.col("p.top"), F.lit(0.0))).alias("bound")))
    falling = Window.partitionBy(qid, key).orderBy(F.desc("bound"), "blk")
    bounds = stage(bounds.withColumn("nth", F.row_number().over(falling)), "index-bounds")
    # a block's documents in the order of their places
    held = spark.read.parquet(f"{path}/docs").groupBy(key, "blk").agg(F.sort_array(F.collect_list(F.struct("at", F.col(doc).alias("doc"), "norm", "times"))).alias("held"))

    def scored(blocks: DataFrame) -> DataFrame:
        wanted = qw.join(blocks.select(qid, key, "blk"), [qid, key])
        found = postings.select(key, "term", F.explode("blocks").alias("p")).select(key, "term", "p.*").drop("top")
        found = wanted.join(found, [key, "term", "blk"]).join(held, [key, "blk"])

        def weight(p: Column) -> Column:
            d, tf = F.get("held", p["at"]), p["tf"]
            return F.struct(d["doc"].alias("doc"), (F.col("qw") * d["times"] * F.col("gain") * tf / (tf + d["norm"] if method == "bm25" else d["norm"])).alias("w"))

        return (found.select(qid, key, F.explode(F.transform(F.arrays_zip("at", "tf"), weight)).alias("p"))
                .groupBy(qid, key, F.col("p.doc").alias(doc)).agg(F.sum("p.w").alias("score")))

    seeds = stage(scored(bounds.filter(F.col("nth") <= k)), "index-seeds")
    best = Window.partitionBy(qid, key).orderBy(F.desc("score"))
    limit = (seeds.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k)
             .select(qid, key, F.greatest(F.col("score"), F.lit(0.0)).alias("limit")))
    # scores are rounded to 6 digits before ranking: what could tie there is read as well
    rest = bounds.filter(F.col("nth") > k).join(limit, [qid, key], "left").filter(
        F.col("bound") >= F.coalesce("limit", F.lit(0.0)) - 1e-6)
    rest = stage(rest.select(qid, key, "blk", "bound"), "index-rest")
    read = bounds.filter(F.col("nth") <= k).select(qid, key, "blk", "bound").unionByName(rest)
    return seeds.unionByName(scored(rest)), read


def search_index(queries: DataFrame, path: str, k: int = SPARSE_K, method: str = "bm25", *, key: str = "page_id",
                 qid: str = "query_id", query: str = "query", doc: str = "doc_id", order: str = "doc_pos") -> DataFrame:
    """``(qid, key, rank, doc, score)`` from an index of ``build_index``: the same
    rows as ``retrieve`` over the documents."""
    spark = queries.sparkSession
    scores, _ = index_scores(queries, spark, path, k, method, key=key, qid=qid, query=query, doc=doc)
    return topk_padded(scores, queries, spark.read.parquet(f"{path}/docs"), k, key=key, qid=qid, doc=doc, order=order,
                       allow_negative=method == "bm25")
