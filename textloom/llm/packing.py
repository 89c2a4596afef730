"""Packing token sequences into fixed windows: bounded-space online best fit."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.kernels import release
from textloom.runtime import materialize, small_batches

#: Word pieces whose ids an encoder keeps in each of two generations.
_GENERATION = 200_000
#: Partitions whose leftover windows meet in one merge task: at most 16 * open_windows * max_tokens ids.
_MERGE = 16


#: ASCII letters and digits, and ASCII punctuation: between one of the first and one of the second
#: the pre-tokenizer always cuts, so that a space there changes no id.
_ALNUM, _PUNCT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"abcdefghijklmnopqrstuvwxyz0123456789", bytes(b for b in range(33, 127) if not chr(b).isalnum())))
_encoders: dict[str, WordEncoder] = {}


class _Pieces(dict):
    """ids by piece. A new piece is encoded when asked for; two generations of bounded size are kept."""

    def __init__(self, tokenizer):
        super().__init__()
        self._tok, self._model, self._old = tokenizer, tokenizer.model, {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self._bytes = {b: 256 + k for k, b in enumerate(rest)}
        self._apart = all(self.whole(w) == self._by_model(w.encode()) for w in ("the", "thinger", "na\u00efve", "stra\u00dfe"))

    def _by_model(self, word: bytes) -> bytes:
        ids = [t.id for t in self._model.tokenize(word.decode("latin-1").translate(self._bytes))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        ids = self._tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= _GENERATION:
            self._old = dict(self)
            self.clear()
        got = self._old.get(piece)
        if got is None:
            text = piece.decode()
            if self._apart and text.isalpha() and max(text) < "\u0250" and text == text.lower() and unicodedata.is_normalized("NFC", text):
                # one word in normal form: the tokenizer's own steps would hand it to its model as it is
                got = self._by_model(piece)
            else:
                got = self.whole(text)
        self[piece] = got
        return got


class WordEncoder:
    """ids of whole texts by a tokenizers file that lower-cases, drops white space and cuts words from punctuation.

    Such a tokenizer encodes each piece between white space alone, so each distinct piece goes through
    it once and its ids are kept for all tasks of a worker. A text that holds an added token's string
    is encoded whole, as that string may span pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self._pieces = _Pieces(tokenizer)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        data = np.frombuffer(b"\n".join([t.replace(b"\n", b" ").lower() for t in texts]), np.uint8)
        data = np.insert(data, np.flatnonzero(_PUNCT[data[1:]] & _ALNUM[data[:-1]]) + 1, 32)
        get = self._pieces.__getitem__
        out = [b"".join(map(get, t.split())) for t in data.tobytes().split(b"\n")]
        for k, text in enumerate(texts):
            if any(a in text for a in self._added):
                out[k] = self._pieces.whole(text.decode())
        return out


class OpenWindows:
    """At most `most` open windows of `size` ids; pieces of a window are given out when it closes."""

    def __init__(self, size: int, most: int, spare: int, first_id: int):
        self.size, self.most, self.spare, self.next_id = size, most, spare, first_id
        self.free: list[int] = []
        self.pieces: list[list[tuple]] = []

    def _close(self, k: int) -> Iterator[tuple]:
        self.free.pop(k)
        sequence, self.next_id = self.next_id, self.next_id + 1
        for piece, offset in self.pieces.pop(k):
            yield (*piece, sequence, offset)

    def _put(self, k: int, piece: tuple, n: int) -> None:
        self.pieces[k].append((piece, self.size - self.free[k]))
        self.free[k] -= n

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """Place one document; yields (doc, start, ids, total, sequence, offset) of windows that close."""
        total = len(ids) // 4
        at = 0
        while at < total:
            rest = total - at
            n = min(rest, self.size)
            fits = [(f, k) for k, f in enumerate(self.free) if f >= n]
            if fits:
                k = min(fits)[1]
            elif len(self.free) < self.most:
                k = len(self.free)
                self.free.append(self.size)
                self.pieces.append([])
            else:  # the fullest window goes out, topped up if its gap is worth a cut
                k = min(range(len(self.free)), key=self.free.__getitem__)
                if self.free[k] > self.spare:
                    n = self.free[k]
                    self._put(k, (doc, at, ids[4 * at : 4 * (at + n)], total), n)
                    at += n
                yield from self._close(k)
                continue
            self._put(k, (doc, at, ids[4 * at : 4 * (at + n)], total), n)
            at += n
            if not self.free[k]:
                yield from self._close(k)

    def leftovers(self) -> Iterator[tuple]:
        while self.free:
            yield from self._close(len(self.free) - 1)


def merge_leftovers(pieces: list[tuple], size: int, first_id: int) -> Iterator[tuple]:
    """Lay leftover pieces end to end, cut at each `size` ids; the tail fills windows of powers of two.

    pieces: (doc, start, ids, total). A window at a power of two needs no padding.
    """
    left = sum(len(p[2]) // 4 for p in pieces)
    room = fill = 0
    sequence = first_id - 1
    for doc, start, ids, total in pieces:
        at, n = 0, len(ids) // 4
        while at < n:
            if fill == room:
                room, fill, sequence = size if left >= size else 1 << (left.bit_length() - 1), 0, sequence + 1
            take = min(n - at, room - fill)
            yield doc, start + at, ids[4 * at : 4 * (at + take)], total, sequence, fill
            at, fill, left = at + take, fill + take, left - take


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    end_id: int = 1,
    open_windows: int = 64,
    spare: int = 16,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document's ids (then end_id) into windows of at most max_tokens ids.

    Each partition keeps open_windows windows and places a piece in the one it fits best; when none
    fits, the fullest goes out, topped up by a cut if more than `spare` ids are free. What stays open
    at a partition's end is merged, sixteen partitions at a time, without padding. No ids cross a
    shuffle but those leftovers.

    Returns a row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    piece's ids if with_ids. Null text counts as empty (one piece, the end id); null or repeated ids
    are packed row by row; texts of any length are cut as needed; an empty table gives no rows; other
    columns, whatever their names, are not read. Reruns over the same files agree.
    """
    small_batches(docs)
    id_type = docs.schema[id_col].dataType
    shape = T.StructType(
        [T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("merge", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    )
    arrow = _arrow(shape)

    def rows(found: Iterator[tuple], merge: int | None) -> Iterator[tuple]:
        for doc, start, ids, total, sequence, offset in found:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, merge, ids if with_ids or merge is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, windows, end = WordEncoder.of(tokenizer), OpenWindows(max_tokens, open_windows, spare, part << 32), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = batch.column(0).to_pylist()
            for lo in range(0, len(keys), 128):
                out = [r for key, ids in zip(keys[lo : lo + 128], encoder.encode(texts[lo : lo + 128]), strict=True) for r in rows(windows.add(key, ids + end), None)]
                yield _batch(out, arrow)
        yield _batch(list(rows(windows.leftovers(), part // _MERGE)), arrow)
        release()

    def merged(table: pa.Table) -> pa.Table:
        p = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        found = merge_leftovers([(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in p], max_tokens, (1 << 61) + (p[0]["merge"] << 32))
        return pa.Table.from_batches([_batch(list(rows(((*f,) for f in found), p[0]["merge"])), arrow)])

    placed = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape), "pack")
    whole, left = placed.where("merge is null"), placed.where("merge is not null")
    out = whole.unionByName(left.groupBy("merge").applyInArrow(merged, shape))
    return out.select(F.col("doc_id").alias(id_col), *shape.fieldNames()[1:7], *(["ids"] if with_ids else []))


def _arrow(shape: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(shape)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
