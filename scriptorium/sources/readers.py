"""Readers for the article, search-result, outline and retrieval-result
files, with declared schemas (no inference) and a corrupt-record side output.

Files hold one JSON object (an article) or one JSON array (search results,
retrieval results) each; the article key often lives in the file name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE_SCHEMA = (
    "id BIGINT, key STRING, url STRING, text STRING, unikey STRING, summary STRING, "
    "outlines ARRAY<STRING>, contents ARRAY<STRING>, info_kv MAP<STRING,STRING>, "
    "reference ARRAY<ARRAY<STRING>>, source STRING"
)
SEARCH_HIT = "struct<title:string,link:string,url:string,text:string>"
DOC_ITEM = "struct<doc_id:string,content:string>"
RETRIEVAL_ITEM = "struct<id:bigint,sections:array<string>,`top-chunks`:array<array<string>>>"
CHUNK_ITEM = "struct<chunk_id:bigint,doc_id:string,content:string>"

_FILE_ID = "([^/]+?)(\\.[^./]*)?$"


def file_key(col: str = "_path"):
    """The integer file name of a path (``.../123.json`` -> 123); NULL when
    the name is not an integer."""
    return F.regexp_extract(F.col(col), _FILE_ID, 1).try_cast("bigint")


# A1 / A6 --------------------------------------------------------------------
def read_articles(spark: SparkSession, path: str, with_rejects: bool = False):
    """One JSON object per file. With ``with_rejects`` returns ``(good,
    rejected)``: a file that does not parse yields one rejected row (its path
    and raw text) instead of failing the job."""
    schema = ARTICLE_SCHEMA + ", _corrupt_record STRING"
    df = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
          .withColumn("_path", F.col("_metadata.file_path")))
    df = df.withColumn("page_id", F.coalesce(F.col("id"), file_key()))
    good = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record", "_path")
    if not with_rejects:
        return good
    # a data column is kept next to the corrupt record: Spark refuses a raw
    # JSON query that references only the corrupt-record column
    bad = df.filter(F.col("_corrupt_record").isNotNull()).select("_path", "id", "_corrupt_record")
    return good, bad


def rejected_array_files(spark: SparkSession, path: str, item: str = SEARCH_HIT) -> DataFrame:
    """Files under ``path`` that do not parse as a JSON array of ``item``
    (path and raw text): the log-and-continue side output of the array
    readers, which skip such files."""
    raw = (spark.read.text(path, wholetext=True)
           .withColumn("_path", F.col("_metadata.file_path")))
    return raw.filter(F.from_json(F.col("value"), f"array<{item}>").isNull()).select("_path", "value")


def _read_arrays(spark: SparkSession, path: str, item: str) -> DataFrame:
    """One JSON array per file, elements with their position and the file's
    integer name; a file that is not an array of ``item`` gives no rows (see
    ``rejected_array_files``)."""
    raw = (spark.read.text(path, wholetext=True)
           .withColumn("_path", F.col("_metadata.file_path")))
    items = F.from_json(F.col("value"), f"array<{item}>")
    return raw.select(file_key().alias("page_id"), "_path",
                      F.posexplode(F.coalesce(items, F.array())).alias("pos", "_i")) \
        .select("page_id", "_path", F.col("pos").cast("bigint").alias("pos"), "_i.*")


# A2 -------------------------------------------------------------------------
def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, pos, title, url, text)``; the url field is ``link`` in
    stored results and ``url`` in link lists; either is read."""
    df = _read_arrays(spark, path, SEARCH_HIT)
    return df.select("page_id", "pos", "title", F.coalesce("url", "link").alias("url"), "text")


def read_doc_lists(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned reference docs ``(page_id, doc_pos, doc_id, content)``; a
    missing content is '' and a missing doc_id NULL."""
    df = _read_arrays(spark, path, DOC_ITEM)
    return df.select("page_id", F.col("pos").alias("doc_pos"), "doc_id",
                     F.coalesce("content", F.lit("")).alias("content"))


def read_chunk_lists(spark: SparkSession, path: str) -> DataFrame:
    df = _read_arrays(spark, path, CHUNK_ITEM)
    return df.select("page_id", "chunk_id", "doc_id", "content")


# A4 -------------------------------------------------------------------------
def explode_outline_map(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON text ``{"<page_id>": [section, ...], ...}`` to ``(page_id,
    sec_pos, section)``."""
    m = F.from_json(F.col(col), "map<string,array<string>>")
    per_page = df.select(F.explode(m).alias("_k", "_s"))
    return per_page.select(F.col("_k").try_cast("bigint").alias("page_id"),
                           F.posexplode("_s").alias("sec_pos", "section")) \
        .withColumn("sec_pos", F.col("sec_pos").cast("bigint"))


def read_outline_map(spark: SparkSession, path: str) -> DataFrame:
    return explode_outline_map(spark.read.text(path, wholetext=True), "value")


# A5 -------------------------------------------------------------------------
def read_retrieval_results(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval records ``[{id, sections, top-chunks}]`` as flat rows
    ``(page_id, sec_pos, section, rank, chunk)`` (rank from 1); a lookup by
    id becomes a join on ``page_id``."""
    df = _read_arrays(spark, path, RETRIEVAL_ITEM)
    n = F.least(F.size("sections"), F.size("`top-chunks`"))
    z = F.arrays_zip(F.slice("sections", 1, n).alias("section"),
                     F.slice("`top-chunks`", 1, n).alias("chunks"))
    per_sec = df.select(F.col("id").alias("page_id"), F.posexplode(z).alias("sec_pos", "_z"))
    return per_sec.select("page_id", F.col("sec_pos").cast("bigint").alias("sec_pos"),
                          F.col("_z.section").alias("section"),
                          F.posexplode("_z.chunks").alias("rank", "chunk")) \
        .withColumn("rank", (F.col("rank") + 1).cast("bigint"))


# A9 -------------------------------------------------------------------------
def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunk vectors ``(page_id, chunk_id, embedding ARRAY<FLOAT>)``."""
    return spark.read.parquet(path)


# A11 ------------------------------------------------------------------------
def finished_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of articles whose output file exists (integer file names only)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_path"))
    return files.select(file_key().alias("page_id")).filter(F.col("page_id").isNotNull()).distinct()


def pending(todo: DataFrame, done: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of ``todo`` whose key is not finished yet (resume)."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


# A3 -------------------------------------------------------------------------
def read_snapshot(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "title", "text")) -> DataFrame:
    """A corpus snapshot table (``id, title, text``); only the named columns
    are read (column pruning reaches the parquet scan)."""
    return spark.read.parquet(path).select(*columns)
