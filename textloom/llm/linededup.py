"""Line deduplication across documents: a deletion-neighbourhood join on words, bounded to one edit."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.substring import _keys
from textloom.runtime import materialize, settled, small_batches

_WHOLE, _DELETED, _REPLACED = 0, 1, 2
#: Variants that are made at once.
_VARIANTS = 1 << 16


class _Lines:
    """The lines of a chunk of documents: words, hashes and running sums of Rabin-Karp hashes under one base."""

    def __init__(self, column: pa.Array):
        self.data, off = K.texts_of(column)
        begin, end, _ = K.word_spans(self.data, off)
        cut = np.flatnonzero(self.data == 10) + 1
        starts = np.concatenate([off[:-1], cut])
        self.doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, cut - 1, "right") - 1])
        order = np.lexsort((starts, self.doc))
        starts, self.doc = starts[order], self.doc[order]
        self.number = np.arange(len(starts)) - np.searchsorted(self.doc, self.doc, "left")
        self.first = np.searchsorted(begin, starts)
        self.last = np.append(self.first[1:], len(begin))
        self.n = self.last - self.first
        self.begin, self.end = begin, end
        self.words = K.word_hashes(self.data, begin, end)

    def under(self, base: int) -> _Lines:
        """The same lines, hashed to a base. A word's power is its place in its own line, so tables are as long as a line."""
        self = copy(self)
        at = np.arange(len(self.words)) - np.repeat(self.first, self.n)
        most = int(self.n.max(initial=0)) + 1
        self.power, self.back = K.powers(base, most), pow(base, -1, K.PRIME)
        self.sums = K.prefix(K.times(K.fold(self.words), self.power[at]))
        return self

    def head(self, line: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Hash of the first `to` words of each line."""
        return K.minus(self.sums[self.first[line] + to], self.sums[self.first[line]])

    def tail(self, line: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the last n words of each line, as head() has it of those words alone."""
        to = self.first[line] + self.n[line]
        return K.times(K.minus(self.sums[to], self.sums[to - n]), K.powers(self.back, len(self.power))[self.n[line] - n])

    def without(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of each line without its word `at`, as head() has it of the shorter line."""
        first = self.first[line]
        rest = K.minus(self.sums[first + self.n[line]], self.sums[first + at + 1])
        return K.fold(self.head(line, at) + K.times(rest, self.back))

    def text(self, line: np.ndarray) -> list[bytes]:
        """The words of each line joined by one space."""
        out = []
        for lo, hi in zip(self.first[line].tolist(), self.last[line].tolist(), strict=True):
            out.append(b" ".join(self.data[self.begin[lo] : self.end[hi - 1]].tobytes().split()) if hi > lo else b"")
        return out


def _key(h: np.ndarray, n: np.ndarray, kind: int, at: np.ndarray | int = 0) -> np.ndarray:
    tag = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xC2B2AE3D27D4EB4F & K._MASK)
    if not np.isscalar(at):
        tag += at.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return K.mix(h ^ K.mix(tag)).view(np.int64)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two sequences of words is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


_SCANNED = "h bigint, h2 bigint, doc bigint, line int, text_hash bigint, text_check bigint, n int, again boolean, p0 bigint, s0 bigint, p1 bigint, s1 bigint"
_VARIED = "key bigint, check bigint, kind tinyint, doc bigint, line int, text_hash bigint, text_check bigint, words binary"


def _scan(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct lines at their first place, with the keys of their halves; other places as repeats."""
    for batch in K.chunks(batches, "text"):
        order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
        batch = batch.take(pa.array(order))
        ids, texts, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        x = _Lines(batch.column(3))
        line = np.flatnonzero(x.n)
        if not len(line):
            continue
        n, number = x.n[line], x.number[line]
        doc, text, check = (v[x.doc[line]] for v in (ids, texts, checks))
        h2 = _key(x.under(K.BASES[1]).head(line, n), n, 9)
        x = x.under(K.BASES[0])
        h = _key(x.head(line, n), n, 9)
        order = np.lexsort((check, text, number, doc, h2, h))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        again = np.zeros(len(line), bool)
        again[order] = (doc[order] != doc[lead]) | (number[order] != number[lead]) | (text[order] != text[lead]) | (check[order] != check[lead])
        halves = []
        for p, s in ((n // 2, n - n // 2), ((n - 1) // 2, (n - 1) - (n - 1) // 2)):
            halves += [_key(x.head(line, p), p, 10), _key(x.tail(line, s), s, 11)]
        short = n < min_words
        none = lambda v: pa.array(v, mask=again | short)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(h2), pa.array(doc), pa.array(number.astype(np.int32)), pa.array(text), pa.array(check), pa.array(n.astype(np.int32)), pa.array(again), *map(none, halves)],
            ["h", "h2", "doc", "line", "text_hash", "text_check", "n", "again", "p0", "s0", "p1", "s1"],
        )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each candidate line: itself with its words, and each variant with one word deleted where the other half is shared."""
    for batch in K.chunks(batches, "text"):
        x = _Lines(batch.column(3))
        at_doc = np.searchsorted(x.doc, np.arange(batch.num_rows))
        wanted = batch.column(4)
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(wanted).to_numpy())
        flat = wanted.flatten()
        number, tail, head = (flat.field(c).to_numpy().astype(np.int64) for c in ("line", "tail", "head"))
        line = at_doc[row] + number
        places = [batch.column(c).to_numpy(zero_copy_only=False)[row] for c in range(3)]
        n = x.n[line]
        # word positions an edit can have: from `tail` on behind a shared prefix, below `head` before a shared suffix
        upto = np.cumsum(n)

        def rows(keys: list[np.ndarray], kind: np.ndarray, src: np.ndarray, text: list[bytes] | None) -> pa.RecordBatch:
            doc, text_hash, text_check = (p[src] for p in places)
            words = pa.array(text, pa.binary()) if text is not None else pa.nulls(len(src), pa.binary())
            cols = [pa.array(keys[0]), pa.array(keys[1]), pa.array(kind.astype(np.int8)), pa.array(doc), pa.array(number[src].astype(np.int32)), pa.array(text_hash), pa.array(text_check), words]
            return pa.RecordBatch.from_arrays(cols, ["key", "check", "kind", "doc", "line", "text_hash", "text_check", "words"])

        hashed = [x.under(base) for base in K.BASES]
        yield rows([_key(h.head(line, n), n, 12) for h in hashed], np.full(len(line), _WHOLE), np.arange(len(line)), x.text(line))
        for lo in range(0, int(n.sum()), _VARIANTS):
            position = np.arange(lo, min(lo + _VARIANTS, int(upto[-1])))
            each = np.searchsorted(upto, position, "right")
            at = position - (upto[each] - n[each])
            use = (at >= tail[each]) | (at < head[each])
            each, at = each[use], at[use]
            keys = []
            for h in hashed:
                v = h.without(line[each], at)
                keys.append(np.concatenate([_key(v, n[each] - 1, 12), _key(v, n[each] - 1, 13, at + 1)]))
            yield rows(keys, np.repeat([_DELETED, _REPLACED], len(each)), np.concatenate([each, each]), None)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines (columns 0 to 3) whose words (4) are within one edit of their rival's (5)."""
    for batch in batches:
        near = [within_one_edit(a.split(b" "), b.split(b" ")) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        keep = batch.filter(pa.array(near, pa.bool_()))
        yield pa.RecordBatch.from_arrays(keep.columns[:4], ["doc", "line", "text_hash", "text_check"])


def _with_words(pairs: DataFrame, words: DataFrame, side: str, name: str) -> DataFrame:
    """pairs with the words of the line at the place `side`; one that many share is split by Spark's skew join."""
    theirs = words.select(F.struct("doc", "line", "text_hash", "text_check").alias(side), F.col("words").alias(name))
    return pairs.join(theirs, side)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """(doc, text_hash, text_check, line): each line that equals an earlier line or is one word edit from one.

    Lines compare by their words; equal lines meet first, within a task and then over all, by two
    hashes, so each distinct line goes on once, at its first place. Two lines within one edit share one
    half of their words exactly, so only lines whose half some other line has emit their deletion
    neighbourhood: the line itself and all variants without one word, as hashed keys. Variants join
    where they are equal with equal deleted positions (a replacement), or where a variant is a whole
    line (an insertion or deletion). In a group of equal keys each later line meets the earliest one
    alone, so no pairs are made, and goes if the edit distance of their words is one at most.
    """
    small_batches(docs)
    rows = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))
    seen = materialize(rows.mapInArrow(lambda b: _scan(b, min_words), _SCANNED), "lines")
    spot = ("doc", "line", "text_hash", "text_check")
    place = F.struct(*spot)
    per_task = seen.where("not again").select("h", "h2", "n", "p0", "s0", "p1", "s1", place.alias("place"))
    lines = per_task.groupBy("h", "h2").agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in ("n", "p0", "s0", "p1", "s1")))
    lines = materialize(lines, "distinct_lines")
    equal = per_task.select("h", "h2", "place").join(lines.select("h", "h2", F.col("place").alias("least")), ["h", "h2"]).where("place != least").select("place.*")

    half = F.floor(F.col("n") / 2).cast("int")
    less = F.floor((F.col("n") - 1) / 2).cast("int")
    prefix = lambda key, p: F.struct(F.col(key).alias("half"), p.alias("tail"), F.lit(0).alias("head"))
    suffix = lambda key, s: F.struct(F.col(key).alias("half"), F.lit(1 << 30).alias("tail"), (F.col("n") - s).alias("head"))
    halves = F.array_distinct(F.array(prefix("p0", half), prefix("p1", less), suffix("s0", F.col("n") - half), suffix("s1", F.col("n") - 1 - less)))
    keyed = lines.where("p0 is not null").select("place", F.explode(halves).alias("x")).select("place", "x.*")
    shared = keyed.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half")
    wanted = keyed.join(shared, "half").groupBy("place").agg(F.min("tail").alias("tail"), F.max("head").alias("head"))
    by_doc = wanted.groupBy("place.doc", "place.text_hash", "place.text_check").agg(F.collect_set(F.struct("place.line", "tail", "head")).alias("wanted"))
    emitted = rows.join(by_doc.hint("merge"), ["doc", "text_hash", "text_check"]).select("doc", "text_hash", "text_check", "text", "wanted")
    emitted = materialize(emitted.mapInArrow(_variants, _VARIED), "variants")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, place))
    earliest = emitted.groupBy("key", "check").agg(of(_WHOLE).alias("whole"), of(_DELETED).alias("deleted"), of(_REPLACED).alias("replaced"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    earliest = earliest.where("lo != hi").select("key", "check", "whole", "deleted", "replaced")
    linked = emitted.select("key", "check", "kind", place.alias("place")).join(earliest, ["key", "check"])
    rival = F.when(F.col("kind") == _WHOLE, F.col("deleted")).when(F.col("kind") == _DELETED, F.col("whole")).otherwise(F.col("replaced"))
    pairs = linked.select("place", rival.alias("rival")).where("place > rival").distinct()
    words = emitted.where(F.col("kind") == _WHOLE).select(*spot, "words")
    met = _with_words(_with_words(pairs, words, "place", "a"), words, "rival", "b").select("place.*", "a", "b")
    near = met.mapInArrow(_verified, "doc bigint, line int, text_hash bigint, text_check bigint")
    again = seen.where("again").select(*spot)
    return again.unionByName(equal).unionByName(near).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, report: bool = False) -> DataFrame:
    """docs with repeated lines taken out of text_col; with report, instead (id_col, n_lines, n_removed, kept).

    A line (text between line feeds) goes if an earlier line - of a smaller integer id, or earlier in
    its own text - has the same words, or differs by one inserted, deleted or replaced word; lines of
    fewer than min_words words go only as equal ones, blank lines never. Lines are judged on the
    input. A null id comes before all others; rows with one id are ordered by their text's hash, and
    rows with one id and one text count as one document and keep the same lines. A null text stays
    null and has no lines; an empty one has one blank line; an empty table gives no rows. All columns
    come back, whatever their names; only text_col changes.
    """
    by_doc = lambda: repeated_lines(docs, id_col, text_col, min_words).groupBy("doc", "text_hash", "text_check").agg(F.collect_list("line").alias("gone"))
    gone = settled(by_doc, docs.sparkSession, "gone")

    @F.pandas_udf("string")
    def keep(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(text, gone, strict=True):
            drop = set(g)
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))
        return pd.Series(out, dtype="object")

    key = [c.alias(f"__{i}") for i, c in enumerate(_keys(id_col, text_col))]
    rows = docs.select(F.struct("*").alias("row"), *key).join(gone.toDF("__0", "__1", "__2", "gone").hint("merge"), ["__0", "__1", "__2"], "left")
    text = F.col(f"row.`{text_col}`")
    kept = F.when(F.col("gone").isNull(), text).otherwise(keep(F.coalesce(text, F.lit("")), F.coalesce("gone", F.array().cast("array<int>"))))
    if report:
        lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("bigint")
        return rows.select(F.col(f"row.`{id_col}`").alias(id_col), lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"), kept.alias("kept"))
    return rows.select(F.col("row").withField(f"`{text_col}`", kept).alias("row")).select("row.*")
