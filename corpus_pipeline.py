"""From documents to token ids: quality filter, toxicity filter, near-duplicate
removal, mixing to target weights, piece encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works
on all that the stage before kept. All stages but the last return the columns
of documents. ``run`` writes each result as Parquet to the shared folder and
reads it back for the next stage, so a lost executor costs at most one stage.

Defined cases, in all stages: a null text is an empty one. Texts without words are rejected by
the first stage; toxicity keeps them, near-duplicates are one class of them, mixing never takes
them. Null ids, languages and sources are values like others. Rows that repeat are kept or dropped
alike; of rows with one text the near-duplicate stage keeps one. Very long texts are worked
on whole. Columns of other names, whatever they are called, are kept up to the last stage,
which keeps id, language, source and length. Without labels nothing with words is rejected as of
low quality and nothing as toxic. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import cotraining, curriculum, probminhash, toxicity, unigram_pieces
from scriptorium.llm.common import staged, table
from scriptorium.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    return docs.filter(cotraining.scorer(docs, table(spark, sf_dir, "labels")) >= 0.5)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not call toxic."""
    return toxicity.harmless(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return probminhash.one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in training order."""
    return curriculum.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again in the same pass: ``text_crc32``
    of the decoded text, and whether it is the ``same`` as the text. Of the other
    columns ``doc_id, lang, source, n_chars`` are kept."""
    ids = unigram_pieces.encode_texts(docs, tokenizer_path("piece_bpe_32k.model"),
                                      columns=["doc_id", "lang", "source", "n_chars"], decoded=True)
    return ids.withColumn("n_pieces", F.size("ids").cast("bigint"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_harmless),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix),
    ("pieces", encode),
]

#: The stages are trained models and random signatures, which SQL cannot
#: express; the tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
