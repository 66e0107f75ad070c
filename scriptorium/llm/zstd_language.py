"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with pieces of
its training texts. A text is encoded once with each dictionary; the language
whose dictionary makes it smallest explains it best. Texts and pieces are
encoded in lower case with every run of other characters than letters as one
space, so that case, digits and symbols, which no language owns, do not count.
Equal sizes go to the language with more training documents.

The margin is what the second smallest encoding is larger by, as a share of the
smallest. Where it is narrow (under ``MIN_MARGIN``) the guess is rejected:
``lang_certain`` is null then, while ``lang_pred`` still names the best guess.
The score is the share of the chosen language if every byte halves a language's
weight: 1 over the sum of 2^-(size - smallest).

Fitting: the dictionaries are a bounded sample of the labelled rows,
``DICT_BYTES`` for each of at most ``MAX_LANGUAGES`` languages (the most
frequent ones), ``TOTAL_BYTES`` together; counts of languages take all rows. A
distinct text gives at most one piece, of ``PIECE`` characters from a place drawn by its
hash; the pieces are those with the smallest hashes, so the same table gives the
same dictionaries whatever its partitioning. Encoding covers every whole
text in one pass without a shuffle.

Defined cases: a null text and one without a letter are ``und`` with score and
margin 0; so is every text if there is nothing to learn from (no rows, no
language, no letters). With one learned language every text with a letter is
of that language, score and margin 1. A null id is held out and never learned
from; null languages are not learned. Rows are encoded one by one, so repeated
rows agree; copies of a text fill a dictionary once. Very long texts are encoded
whole, one at a time. Columns of other names play no part. Empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_fold, slices

UNKNOWN = "und"
DICT_BYTES = 131_072
TOTAL_BYTES = 64 << 20
MAX_LANGUAGES = 2_000
PIECE = 1_024
#: least mean length of pieces, in characters, that their number is reckoned with
SHORT = 16
LEVEL = 6
MIN_MATCH = 4
MIN_MARGIN = 0.01
OTHER = regex.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    """Lower-case letters, runs of anything else as one space."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


# ---------------------------------------------------------------- fitting
def dictionaries(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES,
                 total_bytes: int = TOTAL_BYTES, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """Dictionary content of every learned language, more frequent languages
    first, from the rows of ``docs`` for which ``learn`` holds."""
    text = F.col(text_col).cast("string")
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & text.rlike("\\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("key"), text.alias("text"))
    langs = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("texts"),
                                     F.avg(F.least(F.length("text"), F.lit(PIECE))).alias("chars"))
             .orderBy(F.desc("n"), "lang").limit(max_languages).collect())
    if not langs:
        return {}
    size = min(dict_bytes, total_bytes // len(langs))
    # pieces for twice the bytes, as plain pieces are shorter than their texts; four
    # times as many are drawn by expectation, of which the smallest hashes are taken
    wanted = {r["lang"]: int(2 * size / max(r["chars"], SHORT)) + 1 for r in langs}
    share = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, 4 * wanted[r["lang"]] / max(1, r["texts"])), wanted[r["lang"]]) for r in langs],
        "lang string, share double, pieces int")
    place = (F.pmod(F.col("key"), F.greatest(F.length("text") - PIECE + 1, F.lit(1))) + 1).cast("int")
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.col("share") * float(1 << 40)
    found = (rows.join(F.broadcast(share), "lang").filter(drawn)
             .select("lang", "key", "pieces", F.col("text").substr(place, F.lit(PIECE)).alias("piece"))
             .groupBy("lang", "key", "pieces").agg(F.min("piece").alias("piece"))
             .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")))
             .filter(F.col("nth") <= F.col("pieces")).orderBy("lang", "nth").collect())
    content = {r["lang"]: [] for r in langs}
    for r in found:
        content[r["lang"]].append(plain(r["piece"]))
    return {k: b" ".join(v)[:size] for k, v in content.items() if v}


# ---------------------------------------------------------------- inside tasks
def encoders(content: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in content.values():
        raw = raw.rjust(8)  # the library ignores shorter dictionaries
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(raw), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        out.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                            compression_params=params))
    return out


def judged(size: np.ndarray) -> tuple[int, float, float]:
    """(number of the smallest size, score, margin)."""
    if len(size) == 1:
        return 0, 1.0, 1.0
    best = int(np.argmin(size))
    second = np.partition(size, 1)[1]
    return best, float(1 / (0.5 ** np.minimum(size - size[best], 60.0)).sum()), float(second / size[best] - 1)


# ---------------------------------------------------------------- the operator
def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3,
             held_fold: int = 1, min_margin: float = MIN_MARGIN, **bounds) -> DataFrame:
    """``id, held_out, lang_pred, score, margin, lang_certain`` for every row of ``docs``."""
    held = F.coalesce(crc32_fold(id_col, folds) == held_fold, F.lit(True))
    content = dictionaries(docs, ~held, text_col, lang_col, **bounds)
    names = list(content)
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        made = encoders(content)
        for b in slices(batches, "text"):
            found = []
            for t in b.column("text"):
                t = t.as_py()
                if not made or t is None or not LETTER.search(t):
                    found.append((UNKNOWN, 0.0, 0.0, None))
                    continue
                raw = plain(t)
                best, score, margin = judged(np.array([len(c.compress(raw)) for c in made], dtype=float))
                found.append((names[best], score, margin, names[best] if margin >= min_margin else None))
            lang, score, margin, certain = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(margin, pa.float64()), pa.array(certain, pa.string())],
                names=["id", "held_out", "lang_pred", "score", "margin", "lang_certain"])

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, margin double, lang_certain string")
