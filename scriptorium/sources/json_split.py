"""Large JSON files read by many tasks.

A file that holds one JSON object or array is one line, so a whole-file read is
one row and one task. Here Spark's text source cuts it at commas instead: it
deals byte ranges of the file to tasks, each beginning after the first comma of
its range, in any store that Spark reads. What a range means depends on the
state it begins in (inside a string or not, how deep), so there are two passes:

1. every range says what it does to either state: where it ends if it began
   outside a string, and inside one, and by how much the depth changes;
2. the ranges' summaries (a row each) are chained by a running window per file;
   with its state known, every range is cut at the commas between elements.

An element that ends in a later range is put together from the pieces that the
ranges left at their ends; whole elements never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .readers import file_key

_PIECES = "path string, start long, kind string, text string"


def _outside(fragment: str, inside: bool) -> tuple[list[str], bool]:
    """(the parts of a fragment that lie outside strings, whether it ends inside
    one). A backslash escapes the character after it, never the comma at which
    fragments are cut."""
    if "\\" in fragment:
        fragment = fragment.replace("\\\\", "").replace('\\"', "")
    parts = fragment.split('"')
    return parts[1 if inside else 0::2], inside ^ (len(parts) % 2 == 0)


def _depth(parts: list[str]) -> int:
    return sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Batches as (range, fragments); the fragments of a range follow each other."""
    for b in batches:
        at, found = None, []
        for path, start, value in zip(*(b.column(c).to_pylist() for c in ("path", "start", "value"))):
            if (path, start) != at:
                if found:
                    yield at, found
                at, found = (path, start), []
            found.append(value)
        if found:
            yield at, found


def _summaries(batches):
    known: dict[tuple[str, int], list] = {}
    for at, fragments in _ranges(batches):
        state = known.setdefault(at, [False, 0, True, 0])  # ends inside and depth, if it began outside, inside a string
        for f in fragments:
            for k in (0, 2):
                parts, state[k] = _outside(f, state[k])
                state[k + 1] += _depth(parts)
    rows = [(*at, *state) for at, state in known.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                         names=["path", "start", "out_ends", "out_depth", "in_ends", "in_depth"])


def _pieces(batches):
    """Elements that a range holds whole, its beginning up to the first cut
    (``head``) and its end after the last one (``tail``), or all of it without a
    cut (``middle``). Rows carry the state their range begins in."""
    held: dict[tuple[str, int], list] = {}

    def batch(rows):
        path, start, kind, text = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(start), pa.array(kind), pa.array(text, pa.string())],
                                          names=["path", "start", "kind", "text"])

    for b in batches:
        out = []
        for path, start, inside, depth, value in zip(*(b.column(c).to_pylist() for c in ("path", "start", "inside", "depth", "value"))):
            state = held.setdefault((path, start), [inside, depth, [], False])
            parts, state[0] = _outside(value, state[0])
            state[1] += _depth(parts)
            state[2].append(value)
            if state[1] == 1 and not state[0]:  # the comma after this fragment stands between two elements
                out.append((path, start, "whole" if state[3] else "head", ",".join(state[2])))
                state[2], state[3] = [], True
        if out:
            yield batch(out)
    # a range that ends at a cut leaves nothing: a null, which takes no comma when pieces are joined
    rest = [(*at, "tail" if cut else "middle", ",".join(parts) if parts else None) for at, (_, _, parts, cut) in held.items()]
    if rest:
        yield batch(rest)


def read_json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(_path, element)``: the text of every element of the JSON array or object
    in each file under ``path`` (of an object ``"name": value``). White space around
    elements is dropped, blank ones with it; what lies after the closing bracket is not read."""
    text = (spark.read.option("lineSep", ",").text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"))
    rows = text.mapInArrow(_summaries, "path string, start long, out_ends boolean, out_depth long, in_ends boolean, in_depth long")
    order = Window.partitionBy("path").orderBy("start")
    ranges = F.sort_array(F.collect_list(F.struct("start", "out_ends", "out_depth", "in_ends", "in_depth")))
    first = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("depth"),
                     F.array().cast("array<struct<start:bigint,inside:boolean,depth:bigint>>").alias("all"))
    chained = F.aggregate("ranges", first, lambda a, r: F.struct(
        F.when(a["inside"], r["in_ends"]).otherwise(r["out_ends"]).alias("inside"),
        (a["depth"] + F.when(a["inside"], r["in_depth"]).otherwise(r["out_depth"])).alias("depth"),
        F.concat(a["all"], F.array(F.struct(r["start"].alias("start"), a["inside"].alias("inside"), a["depth"].alias("depth")))).alias("all")))
    # a file's ranges are one row: its bytes by the size of a split
    states = stage(rows.groupBy("path").agg(ranges.alias("ranges")).select("path", F.inline(chained["all"])), "json-ranges")
    pieces = stage(text.join(F.broadcast(states), ["path", "start"]).mapInArrow(_pieces, _PIECES), "json-pieces")
    ends = pieces.filter("kind <> 'whole'")
    # the beginning of a range belongs to the element that the last cut before it began
    begun = F.last(F.when(F.col("kind") == "tail", F.col("start")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marks = ends.groupBy("path", "start").agg(F.max((F.col("kind") == "tail").cast("int")).alias("t")).select(
        "path", "start", F.when(F.col("t") == 1, "tail").otherwise("middle").alias("kind")).withColumn("begun", begun).drop("kind")
    owner = F.when(F.col("kind") == "tail", F.col("start")).otherwise(F.coalesce("begun", F.lit(-1).cast("bigint")))
    joined = (ends.join(marks, ["path", "start"]).withColumn("owner", owner).groupBy("path", "owner")
              .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("p")))
    content = F.array_join(F.transform("p", lambda x: x["text"]), ",")
    content = F.when(F.col("owner") == -1, F.regexp_replace(content, "^[\\s\\x{FEFF}]*[\\[{]", "")).otherwise(content)
    last = ~F.exists("p", lambda x: x["kind"] == "head")
    content = F.when(last, F.regexp_replace(content, "[\\]}]\\s*(,\\s*)?$", "")).otherwise(content)
    whole = pieces.filter("kind = 'whole'").select("path", "text").unionByName(joined.select("path", content.alias("text")))
    return whole.select(F.col("path").alias("_path"), F.trim(F.regexp_replace("text", "^\\s+|\\s+$", "")).alias("element")).filter("element <> ''")


def _split_rejects(parsed: DataFrame, value: str, with_rejects: bool):
    good = parsed.filter(F.col(value).isNotNull())
    if not with_rejects:
        return good
    return good, parsed.filter(F.col(value).isNull()).select("_path", "element")


def read_outline_map_split(spark: SparkSession, path: str, with_rejects: bool = False):
    """``(page_id, sec_pos, section)`` like ``readers.read_outline_map``, each file
    read by many tasks. An entry that is not ``"id": [names]`` gives no rows; with
    ``with_rejects`` it is returned on the side, with its file."""
    entries = read_json_elements(spark, path)
    parsed = entries.withColumn("_m", F.from_json(F.concat(F.lit("{"), "element", F.lit("}")), "map<string,array<string>>"))
    parsed = parsed.withColumn("_m", F.when(F.exists(F.map_values("_m"), lambda v: v.isNull()), None).otherwise(F.col("_m")))
    if with_rejects:
        parsed = stage(parsed, "outline-entries")
    out = _split_rejects(parsed, "_m", with_rejects)
    good, bad = out if with_rejects else (out, None)
    rows = (good.select(F.explode("_m").alias("_k", "_s"))
            .select(F.col("_k").try_cast("bigint").alias("page_id"), F.posexplode("_s").alias("sec_pos", "section"))
            .withColumn("sec_pos", F.col("sec_pos").cast("bigint")))
    return (rows, bad) if with_rejects else rows


def read_json_array_split(spark: SparkSession, path: str, item: str, with_rejects: bool = False):
    """``(page_id, <fields of item>)`` of every element of the JSON arrays under
    ``path``, each file read by many tasks; ``page_id`` is the file's integer name.
    An element that is not an ``item`` (a struct type) gives no row; with
    ``with_rejects`` it is returned on the side, with its file."""
    fields = f"{item.rstrip('>')},_corrupt_record:string>"
    parsed = read_json_elements(spark, path).withColumn(
        "_i", F.from_json("element", fields, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    parsed = parsed.withColumn("_i", F.when(F.col("_i._corrupt_record").isNull() & F.col("element").startswith("{"), F.col("_i")))
    if with_rejects:
        parsed = stage(parsed, "array-elements")
    out = _split_rejects(parsed, "_i", with_rejects)
    good, bad = out if with_rejects else (out, None)
    rows = good.select(file_key().alias("page_id"), "_i.*").drop("_corrupt_record")
    return (rows, bad) if with_rejects else rows
