"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary file names the pieces; every piece has a log score, and a text
is cut into the pieces with the largest sum of scores. A file of merge ranks
has no probabilities; its pieces get Zipf's law, log(1 / rank) normalised
(``scores="zipf"``), a file of log probabilities keeps its own
(``scores="file"``).

*Marker*: white space is written as ``MARK`` and a text gets one in front;
decoding turns it back and drops the first. *Byte fallback*: a character that
no piece covers is written as the pieces of its UTF-8 bytes. A ``MARK`` that
stands in the text itself is also written as bytes, so decoding returns every
text exactly.

*Speed*: no piece holds a marker after another character, so the best cut of a
text is the concatenation of the best cuts of its units (markers, then other
characters). A task cuts every distinct unit of a slice once; trie steps, the
forward pass and backtracking run over all units together. The trie is checked
on the driver and broadcast (it is as large as the vocabulary).

Defined cases: a null or empty text has no pieces and decodes to ''. Unpaired
surrogates cannot occur in Spark strings. Units of any length are cut whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType

from .common import SLICE_CHARS, distinct_codes, slices, text_runs, texts_of

MARK = "▁"
#: added to the lowest score for a character written as bytes
UNKNOWN = -10.0
#: the code between units; no piece holds it
GAP = 256
#: units up to this many bytes go through the joint forward pass
SHORT = 64
#: characters encoded at once: the cutter holds some hundred bytes for each
ENCODE_CHARS = 1_000_000
UNIT = re.compile(r" +[^ ]*|[^ ]+")


def read_pieces(path: str, scores: str = "zipf") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces by id, log scores, kinds: 0 ordinary, 1 byte, 2 other)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0
                      for i in range(n)])
    if scores == "file":
        return pieces, np.array([sp.get_score(i) for i in range(n)], dtype=np.float64), kinds
    rank = np.cumsum(kinds == 0)
    return pieces, np.where(kinds == 0, -np.log(np.maximum(rank, 1)) - np.log((1 / np.maximum(rank, 1))[kinds == 0].sum()), 0.0), kinds


def double_array(words: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, id) of a double-array trie: the child of state s by byte b
    is base[s] + b + 1 if check of it is s; id is -1 where no word ends."""
    children: list[dict[int, int]] = [{}]
    ends = {}
    for w, i in zip(words, ids):
        node = 0
        for b in w:
            nxt = children[node].get(b)
            if nxt is None:
                nxt = len(children)
                children[node][b] = nxt
                children.append({})
            node = nxt
        ends[node] = i
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    free = np.ones(size, dtype=bool)
    free[0] = False
    place = {0: 0}
    low = 1
    for node in range(len(children)):  # parents come before children
        s = place[node]
        value[s] = ends.get(node, -1)
        if not children[node]:
            continue
        codes = np.array(sorted(children[node]), dtype=np.int64) + 1
        while not free[low]:
            low += 1
        b = max(low - int(codes[0]), 0)
        while True:
            if b + 300 >= len(free):
                grow = len(free)
                free = np.append(free, np.ones(grow, dtype=bool))
                base, check, value = (np.append(a, np.full(grow, f, np.int64)) for a, f in ((base, 0), (check, -1), (value, -1)))
            starts = np.flatnonzero(free[b + codes[0]:b + codes[0] + 4096]) + b
            ok = starts[(starts + codes[-1] < len(free))]
            fit = ok[np.all(free[ok[:, None] + codes[None, :]], axis=1)] if len(ok) else ok
            if len(fit):
                b = int(fit[0])
                break
            b = int(b + 4096) if not len(ok) or ok[-1] + codes[-1] + 1 < len(free) else b + 4096
        base[s] = b
        check[b + codes] = s
        free[b + codes] = False
        for c in codes:
            place[children[node][int(c) - 1]] = b + int(c)
    last = int(np.flatnonzero(~free)[-1]) + 300
    pad = max(0, last - len(base))
    return tuple(np.append(a, np.full(pad, f, np.int64))[:last] for a, f in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    """A vocabulary with its trie; sent to the tasks."""

    def __init__(self, path: str, scores: str = "zipf"):
        pieces, self.score, kinds = read_pieces(path, scores)
        usable = [i for i in range(len(pieces)) if kinds[i] == 0 and pieces[i]]
        # units are independent only if no piece holds a marker after another character
        self.by_unit = not any(MARK in pieces[i].lstrip(MARK) for i in usable)
        self.base, self.check, self.value = (a.astype(np.int32) for a in double_array(
            [pieces[i].replace(MARK, " ").encode() for i in usable], usable))
        self.depth = max(len(pieces[i].replace(MARK, " ").encode()) for i in usable)
        self.unknown = float(self.score[usable].min()) + UNKNOWN
        byte_ids = {int(pieces[i][1:-1], 16): i for i in range(len(pieces)) if kinds[i] == 1}
        self.byte_id = np.array([byte_ids[b] for b in range(256)], dtype=np.int64)
        raw = [bytes([int(p[1:-1], 16)]) if kinds[i] == 1 else b"" if kinds[i] == 2 else p.replace(MARK, " ").encode()
               for i, p in enumerate(pieces)]
        self.raw_len = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)

    # -------------------------------------------------------------- encoding
    def _edges(self, data: np.ndarray):
        """All (start, length, id, score) of pieces in ``data``, and one edge of
        length 0 and id -1 for every character (written as its bytes)."""
        start = np.flatnonzero(((data & 0xC0) != 0x80) & (data != GAP)).astype(np.int32)
        out = [(start, np.zeros(len(start), np.uint16), np.full(len(start), -1, np.int32), np.full(len(start), self.unknown))]
        state, at = np.zeros(len(start), np.int32), start
        for step in range(self.depth):
            nxt = self.base[state] + data[at + step] + 1  # a gap leads nowhere
            live = np.flatnonzero(self.check[nxt] == state)
            if not len(live):
                break
            state, at = nxt[live], at[live]
            ids = self.value[state]
            hit = np.flatnonzero(ids >= 0)
            out.append((at[hit], np.full(len(hit), step + 1, np.uint16), ids[hit], self.score[ids[hit]]))
        return [np.concatenate(c) for c in zip(*out)]

    def cut(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, bounds of the units in them)."""
        n = len(units)
        size = np.array([len(u) for u in units], dtype=np.int64)
        begin = np.cumsum(size + 1) - size - 1  # every unit is followed by a gap
        data = np.full(int(size.sum()) + n + self.depth, GAP, dtype=np.int32)
        filled = np.ones(len(data), dtype=bool)
        filled[begin + size] = False
        filled[len(data) - self.depth:] = False
        data[filled] = np.frombuffer(b"".join(units), dtype=np.uint8)
        owner = np.repeat(np.arange(n, dtype=np.int32), size + 1)
        start, length, ids, score = self._edges(data)
        lead = data[start]
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        end = start + np.where(length > 0, length, width).astype(np.int32)
        best = np.full(len(data), -np.inf)
        via = np.full(len(data), -1, dtype=np.int32)
        best[begin] = 0.0
        unit = owner[start]
        reach = end - begin[unit]
        short = size[unit] <= SHORT
        # edges with one end position and one length belong to different units,
        # so a unit's best cut at a position is updated length by length
        order = np.flatnonzero(short)
        key = (reach[order] * 256 + length[order]).astype(np.uint16)
        order = order[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        for e in np.split(order, np.flatnonzero(np.diff(key)) + 1):
            value, to = best[start[e]] + score[e], end[e]
            won = np.flatnonzero(value > best[to])
            best[to[won]], via[to[won]] = value[won], e[won]
        long = np.flatnonzero(~short)
        long = long[np.argsort(end[long], kind="stable")]
        for e, f, t, v in zip(long.tolist(), start[long].tolist(), end[long].tolist(), score[long].tolist()):
            v += best[f]
            if v > best[t]:
                best[t], via[t] = v, e
        # back from the ends, all units together
        chosen = np.full(len(data), -1, dtype=np.int32)
        node = (begin + size)[size > 0]
        while len(node):
            e = via[node]
            node = start[e]
            chosen[node] = e
            node = node[via[node] >= 0]
        edge = chosen[chosen >= 0]
        # characters without a piece become their bytes
        copies = np.where(ids[edge] >= 0, 1, end[edge] - start[edge])
        pos = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        edge = np.repeat(edge, copies)
        out = np.where(ids[edge] >= 0, ids[edge], self.byte_id[np.minimum(data[start[edge] + pos], 255)])
        return out, np.searchsorted(owner[start[edge]], np.arange(n + 1))

    def _units(self, text: str) -> list[str]:
        if not text:
            return []
        return UNIT.findall(" " + text) if self.by_unit else [" " + text]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, bounds of the texts in them)."""
        lists = [self._units(t) for t in texts]
        flat = [u for x in lists for u in x]
        n = np.array([len(x) for x in lists], dtype=np.int64)
        if not flat:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        codes, distinct = distinct_codes(flat)
        ids, bounds = self.cut([u.encode() for u in distinct])
        length = np.diff(bounds)[codes]
        pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out = ids[np.repeat(bounds[codes], length) + pos]
        return out, np.append(0, np.cumsum(length))[np.append(0, np.cumsum(n))]

    # -------------------------------------------------------------- decoding
    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts from ``encode``'s result; bytes that are no UTF-8 become U+FFFD."""
        length = self.raw_len[ids]
        at = np.append(0, np.cumsum(length))
        pos = np.arange(at[-1]) - np.repeat(at[:-1], length)
        data = self.raw[np.repeat(self.raw_at[ids], length) + pos].tobytes()
        cut = at[bounds]
        out = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            t = data[lo:hi].decode("utf-8", "replace")
            out.append(t[1:] if t.startswith(" ") else t)
        return out


# ---------------------------------------------------------------- the operator
def encode_texts(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", scores: str = "zipf",
                 columns: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The ``columns`` of ``docs`` (all, unless named) and ``out``, the piece ids
    of each text. ``decoded`` also decodes the ids in the same pass and adds
    ``text_crc32`` (of the decoded text) and ``same`` (the decoded text is the
    text). Columns of ``docs`` that are called like added ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(path, scores))
    added = [out, "text_crc32", "same"] if decoded else [out]
    keep = [c for c in columns or docs.columns if c not in added]
    text = "__text"
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    schema = rows.drop(text).schema.add(out, ArrayType(IntegerType()))
    if decoded:
        schema = schema.add("text_crc32", LongType()).add("same", BooleanType())

    def run(batches):
        for b in slices(batches, text, ENCODE_CHARS):
            texts = texts_of(b, text)
            ids, bounds = shared.value.encode(texts)
            new = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))]
            if decoded:
                back = []
                for lo, hi in text_runs(texts, SLICE_CHARS // 16):  # decoding holds several numbers for each byte
                    back += shared.value.decode(ids[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
                new += [pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([a == t for a, t in zip(back, texts)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, *added])

    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out: str = "text", scores: str = "zipf") -> DataFrame:
    """``df`` with the column ``out``, the text of each list of piece ids (null: '')."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces(path, scores))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(ids), 256):
            lists = [np.asarray(x if x is not None else [], dtype=np.int64) for x in ids.iloc[lo:lo + 256]]
            bounds = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
            out += shared.value.decode(np.concatenate(lists), bounds)
        return pd.Series(out, dtype=object)

    return df.withColumn(out, decode(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """``id, n_pieces, n_bytes`` (pieces of single bytes), ``ids_crc32`` (ids as
    little-endian 32-bit integers), ``text_crc32`` (of the decoded text) and
    ``same`` (the decoded text is the text) per row, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(path, scores))

    def run(batches):
        pieces = shared.value
        is_byte = np.zeros(len(pieces.raw_len), dtype=bool)
        is_byte[pieces.byte_id] = True
        for b in slices(batches, "text"):
            texts = texts_of(b, "text")
            ids, bounds = pieces.encode(texts)
            decoded = pieces.decode(ids, bounds)
            raw = ids.astype("<u4").tobytes()
            fallback = np.append(0, np.cumsum(is_byte[ids]))[bounds]
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "n_pieces": np.diff(bounds), "n_bytes": np.diff(fallback),
                "ids_crc32": [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(bounds[:-1], bounds[1:])],
                "text_crc32": [zlib.crc32(t.encode()) for t in decoded],
                "same": [a == t for a, t in zip(decoded, texts)]})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {kind}, n_pieces long, n_bytes long, ids_crc32 long, text_crc32 long, same boolean")
            .withColumnRenamed("id", id_col))
