"""Token ids as patched frame-of-reference blocks.

Texts are encoded with a public tokenizer, every document ends with an end id,
and the ids of all documents, in id order, form one stream. The stream is kept
in blocks of ``BLOCK`` ids: a block's minimum is subtracted, the differences
are packed at the width that holds ``KEEP`` of them, and the others are listed
as exceptions (position, value). Blocks are indexed by the position of their
first id and of their first byte.

*Files*: ``path/chunks`` is a Parquet table. A row is a chunk: whole documents
of one range partition up to about ``CHUNK`` ids, with the packed bytes, the
block index and the document index, so it can be decoded by itself. Files and
rows are in document order. ``path/index`` has one row per range partition with
its first position in the whole stream.

*Encoding*: a text's ids are the ids of the words into which the tokenizer's
pattern lets it be cut; a worker encodes a distinct word once (``Encoder``). This holds
for byte-level files without a normaliser, whose added tokens begin with ``<|``
(``cut_in_pieces`` reads the file); with any other file whole texts are encoded.

One shuffle moves the texts into id order; encoding, packing and reading back
are map-only.

Defined cases: a null text is an empty one and has the end id alone. Repeated
ids are kept, ordered by their text; null ids come first. Special tokens in a
text are read as the tokenizer reads them. A very long text is a slice of its own and
may be a chunk of its own. Columns of other names play no part. Empty input writes no chunks.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, text_or_empty

BLOCK = 1024
KEEP = 0.9
CHUNK = 1 << 18
END_ID = 2
#: characters encoded together
SLICE = 8_000_000
#: bytes of text in one range partition
PARTITION_BYTES = 64 << 20
#: white space beyond ASCII, as numbers of its UTF-8 bytes
WIDE_SPACES = [int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))]
#: bytes before which a space is no cut (control characters, white space and "<"), and first bytes of ``WIDE_SPACES``
NO_CUT = np.array([c <= 32 or c == 0x3C for c in range(256)])
NO_CUT_WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: ASCII letters, and marks that are cut off them
LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
MARKS = ".,;:!?"
MARK = np.isin(np.arange(256), list(MARKS.encode()))
#: words that may be joined by line breaks to be encoded together, that many in one call
SIMPLE = r"^ ?[^\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"
JOINED = 1000
#: distinct words a worker remembers before it starts anew, and their bytes
KNOWN_WORDS = 2_000_000
KNOWN_BYTES = 64 << 20


# ---------------------------------------------------------------- encoding
def cut_in_pieces(tokenizer_json: str) -> bool:
    """Whether a tokenizer file cuts texts as ``Encoder`` does: byte-level pieces by the
    usual pattern, nothing that changes a text before or joins pieces after."""
    spec = json.loads(tokenizer_json)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = (before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
             and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    return plain and all(t["content"].startswith("<|") and len(_words(pa.array([t["content"]]))[0]) == 1 and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word"))
                         for t in spec.get("added_tokens") or [])


class Encoder:
    """Ids of whole texts by the tokenizers library, word by word.

    The pattern of byte-level tokenizers cuts a text before the last white space
    of a run (a space goes with the characters after it, a line break stands
    alone) and between a letter and a mark, and ids never cross these cuts. So the bytes of a batch are cut
    there, its distinct words are found by Arrow, and the library encodes only
    words that the worker does not remember, many in one call. A space or line
    break before a ``<`` is no cut: white space before a special token is a run
    of its own."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = not cut_in_pieces(tokenizer_json)
        self.newline = self._plain(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        #: words (with the space before them), their ids and bounds
        self.words = pa.array([], pa.binary())
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Encode words that are not known yet and remember them; their numbers."""
        text = new.cast(pa.string())
        joined = pc.and_(pc.match_substring_regex(text, SIMPLE), pc.invert(pc.match_substring(text, "<|")))
        if len(self.newline) != 1:
            joined = pa.array(np.zeros(len(new), dtype=bool))
        simple, rest = text.filter(joined), text.filter(pc.invert(joined)).to_pylist()
        flat, lengths = [self.ids], [np.zeros(0, np.int64)]
        starts = np.append(np.arange(0, len(simple), JOINED), len(simple)).astype(np.int32)
        for group in pc.binary_join(pa.ListArray.from_arrays(starts, simple), "\n").to_pylist() if len(simple) else []:
            row = np.array(self._plain([group])[0], dtype=np.uint32)  # a line break between words is an id of its own
            breaks = np.flatnonzero(row == self.newline[0])
            lengths.append(np.diff(np.concatenate([[-1], breaks, [len(row)]])) - 1)
            flat.append(np.delete(row, breaks))
        for ids in self._plain(rest):
            lengths.append(np.array([len(ids)], dtype=np.int64))
            flat.append(np.array(ids, dtype=np.uint32))
        number, together = np.empty(len(new), dtype=np.int64), joined.to_numpy(zero_copy_only=False)
        number[np.append(np.flatnonzero(together), np.flatnonzero(~together))] = np.arange(len(self.words), len(self.words) + len(new))
        self.words = pa.concat_arrays([self.words, new.filter(joined), new.filter(pc.invert(joined))])
        self.ids = np.concatenate(flat)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(lengths))])
        return number

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, bounds of the texts in them); a null text is empty."""
        column = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.whole:
            found = self._plain(column.to_pylist())
            flat = [np.array(x, dtype=np.uint32) for x in found]
            return np.concatenate([np.zeros(0, np.uint32), *flat]), np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)
        if len(self.words) > KNOWN_WORDS or self.words.nbytes > KNOWN_BYTES:
            self._forget()
        words, first = _words(column)
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        new = pc.is_null(known)
        known = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        known[new.to_numpy(zero_copy_only=False)] = self._learn(coded.dictionary.filter(new))
        row = known[coded.indices.to_numpy()]
        length = np.diff(self.bounds)[row]
        return self.ids[_ranges(self.bounds[row], length)], np.append(0, np.cumsum(length))[first]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts as slices of their bytes, the number of each text's first word and
    of all words). A cut is before a space or line break that is the last white space
    of its run, after such a line break, and between an ASCII letter and one of ``MARKS``."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    base = int(bounds[0])
    raw = np.frombuffer(data, np.uint8)[base:int(bounds[-1])] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - base
    at = np.flatnonzero((raw == 32) | (raw == 10))
    ends = np.zeros(len(raw) + 1, dtype=bool)
    ends[bounds] = True
    at = at[~ends[at + 1]]  # white space at a text's end is no cut
    after = raw[at + 1]
    at = at[NO_CUT[after] == 0]
    wide = np.flatnonzero(NO_CUT_WIDE[raw[at + 1]])
    if len(wide):
        tail = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32)
        i = at[wide] + 1
        two = tail[i] << 8 | tail[i + 1]
        spaces = np.isin(two, WIDE_SPACES) | np.isin(two << 8 | tail[i + 2], WIDE_SPACES)
        at = np.delete(at, wide[spaces])
    ends[at] = True
    ends[at[raw[at] == 10] + 1] = True
    mark = np.flatnonzero(MARK[raw])
    mark = mark[mark > 0]
    ends[mark[LETTER[raw[mark - 1]]]] = True
    cuts = np.flatnonzero(ends)
    word_offsets = pa.py_buffer((cuts + base).astype(np.int32))
    words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, word_offsets, data if data is not None else pa.py_buffer(b"")])
    return words, np.searchsorted(cuts, bounds)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder; its known pieces serve all of the worker's tasks."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = Encoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + length."""
    shift = np.cumsum(length) - length
    return np.repeat(start - shift, length) + np.arange(int(length.sum()))


# ---------------------------------------------------------------- blocks
LOW_WORD = np.uint64(0xFFFFFFFF)


def _pack(values: np.ndarray, width: int) -> bytes:
    """Rows of values as little-endian bit strings, each row in whole bytes."""
    if width == 0 or not values.size:
        return b""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    n = values.shape[1]
    groups = -(-n // 32)
    padded = np.zeros((len(values), groups * 32), dtype=np.uint64)
    padded[:, :n] = values
    turns = padded.reshape(len(values), groups, 32)
    words = np.zeros((len(values), groups, width + 1), dtype=np.uint64)  # 32 values fill ``width`` words of 32 bits
    for j in range(32):
        word, shift = divmod(j * width, 32)
        part = turns[:, :, j] << np.uint64(shift)
        words[:, :, word] |= part & LOW_WORD
        words[:, :, word + 1] |= part >> np.uint64(32)
    rows = words[:, :, :width].astype("<u4").reshape(len(values), -1).view(np.uint8)
    return rows[:, :-(-n * width // 8)].tobytes()


def _unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """``[rows, n]`` values from rows of bytes."""
    if width == 0:
        return np.zeros((len(data), n), dtype=np.uint32)
    if width in (8, 16, 32):
        return np.ascontiguousarray(data).view(f"<u{width // 8}").astype(np.uint32)
    groups = -(-n // 32)
    whole = np.zeros((len(data), groups * width * 4), dtype=np.uint8)
    whole[:, :data.shape[1]] = data
    words = np.zeros((len(data), groups, width + 1), dtype=np.uint64)
    words[:, :, :width] = whole.view("<u4").reshape(len(data), groups, width)
    out = np.empty((len(data), groups, 32), dtype=np.uint32)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        out[:, :, j] = (words[:, :, word] | words[:, :, word + 1] << np.uint64(32)) >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out.reshape(len(data), -1)[:, :n]


def pack_blocks(ids: np.ndarray, block: int = BLOCK, keep: float = KEEP) -> dict:
    """The packed form of ``ids``: ``payload`` and per block ``byte_start``,
    ``low``, ``width``, ``exceptions``."""
    n = len(ids)
    rows = -(-n // block)
    padded = np.append(ids, np.full(rows * block - n, ids[-1] if n else 0)).astype(np.uint32).reshape(rows, block)
    low = padded.min(axis=1) if rows else np.zeros(0, np.uint32)
    rest = padded - low[:, None]
    kept = np.partition(rest, int(np.ceil(keep * block)) - 1, axis=1)[:, int(np.ceil(keep * block)) - 1] if rows else low
    width = np.ceil(np.log2(kept.astype(np.float64) + 1)).astype(np.int64)
    over = rest >> np.minimum(width, 31)[:, None].astype(np.uint32) != 0
    over[width >= 32] = False
    count = over.sum(axis=1)
    bodies: list[bytes] = [b""] * rows
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        packed = _pack(np.where(over[at], 0, rest[at]), int(w))
        step = len(packed) // len(at)
        for j, i in enumerate(at):
            bodies[i] = packed[j * step:(j + 1) * step]
    of, where = np.nonzero(over)
    places, values = where.astype("<u2").tobytes(), rest[of, where].astype("<u4").tobytes()
    end = np.cumsum(count).tolist()
    parts, start, total = [], np.zeros(rows, dtype=np.int64), 0
    for i, (lo, hi) in enumerate(zip([0, *end], end)):
        start[i] = total
        parts += [bodies[i], places[2 * lo:2 * hi], values[4 * lo:4 * hi]]
        total += len(bodies[i]) + 6 * (hi - lo)
    return {"payload": b"".join(parts), "byte_start": start, "low": low.astype(np.int64), "width": width, "exceptions": count}


def unpack_blocks(payload: bytes, byte_start, low, width, exceptions, n: int, block: int = BLOCK) -> np.ndarray:
    data = np.frombuffer(payload, dtype=np.uint8)
    byte_start, low, width, exceptions = (np.asarray(x, dtype=np.int64) for x in (byte_start, low, width, exceptions))
    out = np.zeros((len(low), block), dtype=np.uint32)
    size = -(-block * width // 8)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        body = data[byte_start[at][:, None] + np.arange(size[at[0]])] if w else np.zeros((len(at), 0), np.uint8)
        out[at] = _unpack(body, block, int(w))
    for i in np.flatnonzero(exceptions):
        a = byte_start[i] + size[i]
        m = a + 2 * exceptions[i]
        where = data[a:m].view("<u2") if a % 2 == 0 else np.frombuffer(data[a:m].tobytes(), "<u2")
        out[i, where] = np.frombuffer(data[m:m + 4 * exceptions[i]].tobytes(), "<u4")
    return (out + low[:, None].astype(np.uint32)).ravel()[:n]


# ---------------------------------------------------------------- files
def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, block: int = BLOCK, chunk: int = CHUNK) -> None:
    """Write the ids of all texts, in id order, below ``path``. ``tokenizer`` is
    the path of its JSON file, read on the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        tokens = encoder(shared.value)
        part, number, position = TaskContext.get().partitionId(), 0, 0
        for b in slices(batches, "text", SLICE):
            ids, bounds = tokens.encode(b.column("text"))
            n_docs = b.num_rows
            length = np.diff(bounds) + 1
            ends = np.cumsum(length)
            stream = np.full(int(ends[-1]), end_id, dtype=np.uint32)
            body = np.ones(len(stream), dtype=bool)
            body[ends - 1] = False
            stream[body] = ids
            cuts = np.append(0, np.flatnonzero(np.diff((ends - 1) // chunk)) + 1)
            out = []
            for lo, hi in zip(cuts, np.append(cuts[1:], n_docs)):
                first = int(ends[lo] - length[lo])
                packed = pack_blocks(stream[first:int(ends[hi - 1])], block)
                out.append({
                    "part": part, "chunk": number, "part_start": position + first, "n_ids": int(ends[hi - 1]) - first,
                    "docs": b.column("id").slice(lo, hi - lo).to_pylist(),
                    "doc_start": ends[lo:hi] - length[lo:hi] - first,
                    "block_start": np.arange(0, int(ends[hi - 1]) - first, block), **packed})
                number += 1
            position += int(ends[-1])
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    lists = ["doc_start", "block_start", "byte_start", "low", "width", "exceptions"]
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()),
                       ("docs", pa.list_(to_arrow_type(rows.schema["id"].dataType))),
                       *[(c, pa.list_(pa.int64())) for c in lists], ("payload", pa.binary())])
    schema = (f"part int, chunk int, part_start long, n_ids long, docs array<{id_type}>, "
              + ", ".join(f"{c} array<long>" for c in lists) + ", payload binary")
    chunks = (rows.repartitionByRange(n, F.col("id")).sortWithinPartitions("id", "text").mapInArrow(run, schema))
    chunks.write.parquet(f"{path}/chunks")
    parts = spark.read.schema(chunks.schema).parquet(f"{path}/chunks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first")).write.parquet(f"{path}/index")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    chunks, index = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/index")
    return chunks.join(index, "part").withColumn("start", F.col("first") + F.col("part_start")).drop("first", "part_start")


def _decode(batch: pa.RecordBatch, block: int):
    """(row, ids, document bounds) of every chunk."""
    for r in batch.to_pylist():
        ids = unpack_blocks(r["payload"], r["byte_start"], r["low"], r["width"], r["exceptions"], r["n_ids"], block)
        yield r, ids, np.append(r["doc_start"], r["n_ids"]).astype(np.int64)


def read_documents(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``id, start, ids`` per document; ``start`` counts the ids before it."""
    chunks = _chunks(spark, path)
    kind = chunks.schema["docs"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for r, ids, at in _decode(b, block):
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(r["docs"], type=b.schema.field("docs").type.value_type), "start": at[:-1] + r["start"],
                    "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))})

    return chunks.mapInArrow(run, f"id {kind}, start long, ids array<long>")


def document_digests(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` per document, read from the files."""
    chunks = _chunks(spark, path)
    kind = chunks.schema["docs"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for r, ids, at in _decode(b, block):
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(r["docs"], type=b.schema.field("docs").type.value_type), "start": at[:-1] + r["start"],
                    "n_tokens": np.diff(at), "ids_crc32": [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(at[:-1], at[1:])]})

    return chunks.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, first: int, stop: int, block: int = BLOCK) -> DataFrame:
    """``position, id`` of the ids ``first <= position < stop`` of the stream:
    chunks are found by the index, and only the blocks that overlap are decoded."""
    hit = _chunks(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > first))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                lo, hi = max(first - r["start"], 0), min(stop - r["start"], r["n_ids"])
                i, j = lo // block, -(-hi // block)
                ids = unpack_blocks(r["payload"], *(r[c][i:j] for c in ("byte_start", "low", "width", "exceptions")),
                                    min(j * block, r["n_ids"]) - i * block, block)
                yield pa.RecordBatch.from_pydict({"position": np.arange(lo, hi) + r["start"],
                                                  "id": ids[lo - i * block:hi - i * block].astype(np.int64)})

    return hit.mapInArrow(run, "position long, id long")
