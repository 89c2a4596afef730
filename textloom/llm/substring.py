"""Substring deduplication: Rabin-Karp hashes of every window of k words, repeats merged to removal spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.runtime import materialize, parts_for, small_batches

#: A run of neighbouring windows that go to one bucket: document (its id's rank as an order-keeping
#: 64-bit number, two hashes of its text), first window, number of windows.
_RUN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("check", "<i8"), ("start", "<i4"), ("n", "<i4")])
#: Width in words of the anchors whose minimum names a window's bucket.
_ANCHOR = 4
_NULL_ID = -(1 << 63)


def _spans(doc: np.ndarray, text: np.ndarray, check: np.ndarray, start: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Windows of k words merged into maximal spans [start, end) of words per document."""
    order = np.lexsort((start, check, text, doc))
    doc, text, check, start = doc[order], text[order], check[order], start[order].astype(np.int64)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (check[1:] != check[:-1]) | (start[1:] > start[:-1] + k)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return {"doc": doc[first], "text": text[first], "check": check[first], "start": start[first], "end": start[last] + k}


def _repeats(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one with a smaller (doc, start)."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    hit = np.zeros(len(h), bool)
    hit[1:] |= same
    hit[:-1] |= same
    order = order[hit]
    order = order[np.lexsort((start[order], doc[order], hashes[order]))]
    h, d, s = hashes[order], doc[order], start[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    out = np.zeros(len(hashes), bool)
    out[order[(d != d[first]) | (s != s[first])]] = True
    return out


def _runs(docs: np.ndarray, text: np.ndarray, check: np.ndarray, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Where a new run begins: another document, a gap, or another bucket."""
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (text[1:] != text[:-1]) | (check[1:] != check[:-1]) | (start[1:] != start[:-1] + 1) | (bucket[1:] != bucket[:-1])
    return np.flatnonzero(fresh)


def _anchors(words: np.ndarray, k: int) -> np.ndarray:
    """The least hash of a run of _ANCHOR words in each window of k words."""
    width = min(_ANCHOR, k)
    return K.sliding_min(K.window_hashes(words, width, 0x5851F42D4C957F2D), k - width + 1)


def _windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the windows of k words that lie in one text, their texts)."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    most = max(0, len(row) - k + 1)
    keep = np.flatnonzero(row[:most] == row[len(row) - most :])
    return keep, row[keep]


def bucket_parts(docs: DataFrame, text_col: str, k: int, buckets: int, bins: int = 1 << 16) -> np.ndarray:
    """Into how many parts each bin of buckets is cut, so that parts have about as many windows each.

    A phrase that many documents hold in different surroundings draws their windows into one bucket; all
    windows of all documents are counted by bin, bucket modulo `bins`, a sum per task and bin.
    """
    bins = min(bins, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in K.chunks(batches, "text"):
            data, off = K.texts_of(batch.column(0))
            begin, end, first = K.word_spans(data, off)
            keep, _ = _windows(first, k)
            if len(keep):
                bucket = K.mix(_anchors(K.word_hashes(data, begin, end), k)[keep]) % np.uint64(buckets)
                total += np.bincount((bucket % np.uint64(bins)).astype(np.int64), minlength=bins)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bin", "n"])

    # a row per bin: 65,536 at most
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(bins, np.int64)
    found[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return np.maximum(1, -(-found // max(1, 2 * (int(found.sum()) // bins))))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, bucket_bytes: int = 2 << 20) -> DataFrame:
    """(doc, text_hash, text_check, start, end): the maximal spans of words that windows of k words starting earlier elsewhere repeat.

    A task hashes every window of its documents and settles repeats among them at once, so that a
    passage that many documents share leaves a task once. What remains goes, in runs of neighbouring
    windows, to the bucket that the least anchor inside the window names; equal windows have equal
    anchors and so meet. A bucket that a frequent phrase would fill is cut into parts by the windows' own
    hashes. There each hash is counted and all its places but the first become spans.
    """
    small_batches(docs)
    buckets = parts_for(docs, text_col, bucket_bytes, 8)
    parts = bucket_parts(docs, text_col, k, buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in K.chunks(batches, "text"):
            order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
            batch = batch.take(pa.array(order))
            ids, texts, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            data, off = K.texts_of(batch.column(3))
            begin, end, first = K.word_spans(data, off)
            words = K.word_hashes(data, begin, end)
            keep, row = _windows(first, k)
            if not len(keep):
                continue
            anchor, hashes = _anchors(words, k)[keep], K.window_hashes(words, k)[keep]
            start = (keep - first[row]).astype(np.int64)
            doc, text, check = ids[row], texts[row], checks[row]
            again = _repeats(hashes, doc, start)
            found = _spans(doc[again], text[again], check[again], start[again], k)
            turn += 1
            bucket = (K.mix(anchor) % np.uint64(buckets)).astype(np.int64)
            part = (K.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) % parts[bucket % len(parts)].astype(np.uint64)).astype(np.int64)
            bucket += buckets * part
            left = np.flatnonzero(~again)
            hashes, doc, text, check, start, bucket = (x[left] for x in (hashes, doc, text, check, start, bucket))
            at = _runs(doc, text, check, start, bucket)
            n = np.diff(np.append(at, len(doc)))
            run = np.empty(len(at), _RUN)
            run["doc"], run["text"], run["check"], run["start"], run["n"] = doc[at], text[at], check[at], start[at], n
            by = np.argsort(bucket[at], kind="stable")
            edge = np.flatnonzero(np.diff(bucket[at][by])) + 1
            out_bucket, heads, bodies = [], [], []
            for part in np.split(by, edge) if len(by) else []:
                out_bucket.append(int(bucket[at[part[0]]]))
                heads.append(run[part].tobytes())
                size = n[part]
                place = np.repeat(at[part] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                bodies.append(hashes[place].tobytes())
            if len(found["doc"]):
                out_bucket.append(turn % buckets)
                heads.append(np.rec.fromarrays([found["doc"], found["text"], found["check"], found["start"], found["end"] - found["start"]], dtype=_RUN).tobytes())
                bodies.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["bucket", "runs", "hashes"])

    def settle(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(x, _RUN) for x in table.column("runs").to_pylist()]
        bodies = table.column("hashes").to_pylist()
        done = [h for h, b in zip(heads, bodies, strict=True) if b is None]
        open_ = [(h, np.frombuffer(b, np.uint64)) for h, b in zip(heads, bodies, strict=True) if b is not None]
        out = {c: [x[c].astype(np.int64) for x in done] for c in ("doc", "text", "check", "start")} | {"end": [x["start"].astype(np.int64) + x["n"] for x in done]}
        if open_:
            run, hashes = np.concatenate([h for h, _ in open_]), np.concatenate([b for _, b in open_])
            size = run["n"].astype(np.int64)
            start = np.repeat(run["start"] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            doc, text, check = (np.repeat(run[c], size) for c in ("doc", "text", "check"))
            again = _repeats(hashes, doc, start)
            for c, v in _spans(doc[again], text[again], check[again], start[again], k).items():
                out[c].append(v)
        cols = [np.concatenate([*out[c], np.zeros(0, np.int64)]) for c in ("doc", "text", "check", "start", "end")]
        return pa.table([*map(pa.array, cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])], names=["doc", "text_hash", "text_check", "start", "end"])

    rows = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))
    sent = rows.mapInArrow(scan, "bucket bigint, runs binary, hashes binary")
    return materialize(sent.groupBy("bucket").applyInArrow(settle, "doc bigint, text_hash bigint, text_check bigint, start int, end int"), "spans")


def _keys(id_col: str, text_col: str) -> list:
    """A row's place in the order of documents, and two hashes of its text, which tell rows with one id apart."""
    text = F.col(text_col)
    return [F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(1), text).alias("text_check")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """(id_col, n_words, n_removed, kept) of every row of docs; kept is the words left, joined by one space.

    A word goes if a window of k words that covers it starts earlier too: in a document with a smaller
    id, or earlier in its own. Windows are judged on the input. Ids are integers; a null id comes
    before all others; rows with one id are neither before nor after each other, so the same start
    in both counts as one place. Null text has no words; shorter texts than k lose nothing; an empty
    table gives no rows; other columns are not read.
    """
    spans = repeated_spans(docs, id_col, text_col, k)
    by_doc = spans.groupBy("doc", "text_hash", "text_check").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text_col), F.col(text_col).alias("text"))
    joined = rows.join(by_doc.hint("merge"), ["doc", "text_hash", "text_check"], "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            n, gone, kept = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                n.append(len(words))
                if spans.is_valid and len(spans.values):
                    drop = np.zeros(len(words) + 1, np.int64)
                    s, e = (spans.values.field(i).to_numpy() for i in (0, 1))
                    np.add.at(drop, s, 1)
                    np.add.at(drop, e, -1)
                    words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
