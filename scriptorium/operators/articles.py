"""Generated articles as stored: ``text`` is a string or a list of strings (one per
section), ``retrieve`` a list of documents or a list of lists (one per section).
They are read as VARIANT, whose own types say which it is, and brought to one
form; later steps never look at the stored form again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _texts(value, of) -> tuple:
    """(the field as an array of strings, whether it is a list)."""
    listed = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(listed, of("array<string>")).otherwise(F.array(of("string"))), listed


def generated(df: DataFrame, col: str = "json", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep, key, outline, text ARRAY<STRING>, retrieve ARRAY<ARRAY<STRING>>,
    per_section BOOLEAN`` of records ``{key, outline, text, retrieve}`` in a JSON text column.
    A whole-article text is an array of one with its one list. A field that is absent, or JSON that
    does not parse, gives an empty array; a string in place of a list is a list of one."""
    rows = df.select(*keep, F.try_parse_json(col).alias("_v"))
    field = lambda name: lambda kind: F.try_variant_get("_v", f"$.{name}", kind)
    text, per_section = _texts(field("text")("variant"), field("text"))
    kind = F.schema_of_variant(field("retrieve")("variant"))
    nested = kind.startswith("ARRAY<ARRAY")
    flat, _ = _texts(field("retrieve")("variant"), field("retrieve"))
    lists = F.when(nested, field("retrieve")("array<array<string>>")).when(
        kind.isNull() | (per_section & (F.size(flat) == 0)), F.array().cast("array<array<string>>")).otherwise(F.array(flat))
    outline = field("outline")("array<string>")
    none = F.array().cast("array<string>")
    return rows.select(*keep, field("key")("string").alias("key"), F.coalesce(outline, none).alias("outline"),
                       F.when(field("text")("variant").isNull(), none).otherwise(text).alias("text"),
                       F.coalesce(lists, F.array().cast("array<array<string>>")).alias("retrieve"),
                       F.coalesce(per_section, F.lit(False)).alias("per_section"))


def sections_of(articles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sec_pos, text, retrieve``: one row per section text with its own list,
    up to the shorter of the two; a whole-article text is section 0, with an empty
    list if it has none."""
    lists = F.when(F.col("per_section") | (F.size("retrieve") > 0), F.col("retrieve")).otherwise(F.array(F.array().cast("array<string>")))
    n = F.least(F.size("text"), F.size(lists))
    pairs = F.arrays_zip(F.slice("text", 1, n).alias("text"), F.slice(lists, 1, n).alias("retrieve"))
    return articles.select(*keys, F.posexplode(pairs).alias("sec_pos", "_z")).select(
        *keys, F.col("sec_pos").cast("bigint").alias("sec_pos"), F.col("_z.text").alias("text"), F.col("_z.retrieve").alias("retrieve"))


def attach_responses(inputs: DataFrame, responses: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``inputs`` with ``text`` replaced by the response of the same ``keys``, all
    other fields kept; inputs without a response are left out, as they were not
    written. Of several responses to a key the one with the greatest ``text`` counts."""
    one = responses.groupBy(*keys).agg(F.max(text).alias("_response"))
    return inputs.join(one, keys).withColumn(text, F.col("_response")).drop("_response")


def article_records(sections: DataFrame, keys: list[str], pos: str = "sec_pos") -> DataFrame:
    """Records ``keys, outline, text, retrieve`` with the documents used, from section rows
    ``section, text, retrieve`` (a list of documents each): parallel arrays in section order, the form
    that evaluation reads. The group is one article's sections."""
    packed = F.sort_array(F.collect_list(F.struct(pos, "section", "text", "retrieve")))
    return sections.groupBy(*keys).agg(packed.alias("_s")).select(
        *keys, F.transform("_s", lambda x: x["section"]).alias("outline"), F.transform("_s", lambda x: x["text"]).alias("text"),
        F.transform("_s", lambda x: x["retrieve"]).alias("retrieve"))
