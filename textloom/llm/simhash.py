"""SimHash near-duplicates: fingerprints, compared exactly tile by tile.

near_duplicates() links 64-bit fingerprints within a radius, nothing else. near_sets() finds candidates
among 128-bit fingerprints the same way and links those whose shingle sets are similar.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.operators.graph import connected_components
from textloom.runtime import materialize, settled, small_batches

#: A fingerprint's four lanes of 16 bits; their population counts name its cell, of which there are 17^4 at most.
_LANES, _LANE_BITS = 4, 16
_BLOCK = 1 << 17

#: At similarity 0.8 the 128 bits of two sets differ in 19.4 places on average, with a deviation of 4.1; 34 lose one pair
#: in 10,000. The first half alone has 9.7 and 2.9; unrelated sets differ in 64 and 32.
_RADIUS, _HALF_RADIUS = 34, 22
#: Set sizes fall into cells by their logarithm, so many to a factor of 1 / similarity.
_SIZE_CELLS = 4


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: A-Z lower-cased, word shingles with repeats, XXH64; majority of each bit."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start, digest = np.concatenate(([0], end[:-1]))[:n].tolist(), xxhash.xxh64_digest
    end = (end - 1)[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        got = b"".join([digest(joined[a:b], seed) for a, b in zip(start[lo : lo + (1 << 16)], end[lo : lo + (1 << 16)], strict=True)])
        ones += np.unpackbits(np.frombuffer(got, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles: at most len(a) + len(b) - 1 pairs, not every pair."""
    one = a is b
    ca, cb = np.arange(len(a)), np.arange(len(b)) + (0 if one else len(a))
    out = []
    step = max(1, _BLOCK // max(1, len(b)))
    for lo in range(0, len(a), step):
        near = np.bitwise_count(a[lo : lo + step, None] ^ b[None, :]) <= radius
        if one:
            near &= np.arange(len(b))[None, :] > np.arange(lo, lo + len(near))[:, None]
        for i in np.flatnonzero(near.any(1)):
            hits = np.flatnonzero(near[i])
            mine = ca[lo + i]
            other, at = np.unique(cb[hits], return_index=True)
            for c, k in zip(other.tolist(), at.tolist(), strict=True):
                if c != mine:
                    out.append((int(a[lo + i]), int(b[hits[k]])))
                    ca[ca == c] = mine
                    if not one:
                        cb[cb == c] = mine
            if one:
                cb = ca
    return out


def link_fingerprints(fps: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """(src, dst) links that connect exactly what Hamming distances of at most radius connect; fps has distinct fp.

    Fingerprints are gathered into tiles by the population counts of their lanes, a tile having about
    `tile` of them. The counts of two fingerprints at distance d differ by at most d over all lanes,
    so only tiles whose counts differ by at most radius meet; those are compared by exclusive-or and
    bit counts, all against all, in numpy. Of each pair of tiles a spanning forest is kept.
    """
    lanes = [F.bit_count(F.shiftrightunsigned("fp", k * _LANE_BITS).bitwiseAND((1 << _LANE_BITS) - 1)) for k in range(_LANES)]
    cell = sum((c * 32**k for k, c in enumerate(lanes)), F.lit(0)).cast("int")
    x = materialize(fps.select("fp", cell.alias("cell")), "fp")
    # one row per cell: 17^4 at most, whatever the input
    subs = x.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("subs"))
    tiles = x.join(F.broadcast(subs), "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), "subs").cast("int").alias("sub")).agg(F.collect_list("fp").alias("b"))
    tiles = materialize(tiles, "tiles")
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=_LANES) if sum(map(abs, d)) <= radius]
    steps = sorted({sum(v * 32**k for k, v in enumerate(d)) for d in steps})
    near = F.explode(F.array(*(F.col("cell") + s for s in steps if s >= 0)))
    sent = tiles.select(F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"), F.col("b").alias("a"), near.alias("cell"))
    sent = sent.join(F.broadcast(subs), "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    pairs = sent.where("cell != cell_a or sub >= sub_a").join(tiles, ["cell", "sub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                a = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                found += tile_links(a, a if same else b.values.to_numpy(zero_copy_only=False).view(np.uint64), radius)
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["src", "dst"])

    same = (F.col("cell") == F.col("cell_a")) & (F.col("sub") == F.col("sub_a"))
    return pairs.select("a", "b", same.alias("same")).mapInArrow(run, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 3, shingle: int = 3, tile: int = 4096) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of docs; component_id is the least id reachable by links.

    Copies meet first: only distinct fingerprints are compared. Null text counts as empty and empty
    texts share fingerprint zero; rows with a null id take part and get the least other id of their
    group, null if there is none; repeated rows stay, each with its result; an empty table gives no
    rows; other columns are not read.
    """
    signed = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    fps = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = settled(lambda: connected_components(link_fingerprints(fps.select("fp"), radius, tile)), docs.sparkSession, "linked")
    groups = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = groups.join(least, "component").select("fp", "component_id")
    out = signed.join(by_fp, "fp")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles, in order; A-Z lower-cased, a shorter text is one shingle."""
    data, off = K.texts_of(column)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    begin, end, first = K.word_spans(data, off)
    words, n = K.word_hashes(data, begin, end), np.diff(first)
    each = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    row = np.repeat(np.arange(len(n), dtype=np.int32), each)
    at = np.repeat(first[:-1] - (np.cumsum(each) - each), each) + np.arange(len(row))
    x = np.zeros(len(row), np.uint64)
    last = first[1:][row]
    for k in range(shingle):
        inside = at + k < last
        x = np.where(inside, K.mix(x + words[np.minimum(at + k, len(words) - 1)]), x)
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, row = x[fresh], row[fresh]
    return x, np.searchsorted(row, np.arange(len(n) + 1))


def _majorities(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits per set: those that over half of its hashes have; block by block, so that a long text needs little memory."""
    ones = np.zeros((len(start), 64), np.int64)
    for lo in range(0, len(x), _BLOCK):
        bits = np.unpackbits(np.ascontiguousarray(x[lo : lo + _BLOCK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # the sets that the block begins in and ends in, and where each of them goes on
        a, b = np.searchsorted(start, [lo, lo + len(bits) - 1], "right") - 1
        ones[a : b + 1] += np.add.reduceat(bits, np.maximum(start[a : b + 1] - lo, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


_SKETCHED = "node string, cell int, size bigint, lo bigint, hi bigint"


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of each text its set's name, two sums of hashes, the set's size and its 128-bit fingerprint; none without words."""
    for batch in K.chunks(batches, "text"):
        x, off = shingle_sets(batch.column(1), shingle)
        size = np.diff(off)
        some = np.flatnonzero(size)
        none = size == 0
        longs = np.zeros((4, batch.num_rows), np.uint64)
        if len(some):
            start = off[some]
            for k in range(2):
                longs[k, some] = np.add.reduceat(K.mix(x + np.uint64(k + 1)), start)
                longs[2 + k, some] = _majorities(K.mix(x ^ np.uint64(0x51ED270B * (k + 1))), start, size[some])
        cell = np.floor(np.log(np.maximum(size, 1)) * (_SIZE_CELLS / -np.log(similarity)) + 1e-9).astype(np.int32)
        node = [f"{a:016x}{b:016x}" for a, b in zip(longs[0].tolist(), longs[1].tolist(), strict=True)]
        masked = lambda v: pa.array(v, mask=none)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), masked(cell), pa.array(size.astype(np.int64)), masked(longs[2].view(np.int64)), masked(longs[3].view(np.int64))], ["key", "node", "cell", "size", "lo", "hi"])


def _close(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row of a, rows of b within the radius); a and b are pairs of 64-bit halves, in a tile of its own only later rows."""
    step = max(1, _BLOCK // max(1, b.shape[1]))
    for lo in range(0, a.shape[1], step):
        near = np.bitwise_count(a[0, lo : lo + step, None] ^ b[0][None, :]) <= _HALF_RADIUS
        i, j = np.nonzero(near)
        if same:
            later = j > i + lo
            i, j = i[later], j[later]
        d = np.bitwise_count(a[0, lo + i] ^ b[0, j]) + np.bitwise_count(a[1, lo + i] ^ b[1, j])
        i, j = i[d <= _RADIUS], j[d <= _RADIUS]
        if len(i):
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                yield lo + int(i[part[0]]), j[part]


def _similar_links(a: np.ndarray, b: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray], similarity: float, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius whose sets have the similarity; connected ones are not compared again."""
    ca = np.arange(len(sets_a))
    cb = ca if same else np.arange(len(sets_a), len(sets_a) + len(sets_b))
    out = []
    for i, hits in _close(a, b, same):
        u = sets_a[i]
        for j in hits.tolist():
            if ca[i] == cb[j]:
                continue
            v = sets_b[j]
            if min(len(u), len(v)) < similarity * max(len(u), len(v)) - 1e-9:
                continue
            both = len(np.intersect1d(u, v, assume_unique=True))
            if both >= similarity * (len(u) + len(v) - both) - 1e-9:
                out.append((i, j))
                old, new = cb[j], ca[i]
                ca[ca == old] = new
                if not same:
                    cb[cb == old] = new
    return out


def near_sets(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tile: int = 4096, set_bytes: int = 16 << 20) -> DataFrame:
    """(key, component) of every row of docs (key, text): rows of one component are linked by similar sets of shingles.

    Equal sets meet first. Distinct sets are gathered into tiles by the cell of their size; only cells
    whose sizes allow the similarity meet. Tiles are compared all against all, by exclusive-or and bit
    counts; where fingerprints are within the radius, the sets themselves are brought to the pair of
    tiles, each once, and decide. A tile has `tile` sets at most, and about `set_bytes` of them. A pair of
    tiles gives a spanning forest of its links, never every pair.
    """
    small_batches(docs)
    kind = docs.schema["key"].dataType.simpleString()
    signed = materialize(docs.mapInArrow(lambda b: _sketches(b, shingle, similarity), f"key {kind}, {_SKETCHED}"), "sketches")
    nodes = materialize(signed.where("cell is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("cell", "size", "lo", "hi")), F.min("key").alias("key")), "sets")
    # one row per cell: some 4 for each factor of 1.25 in size, about 400 whatever the input
    subs = nodes.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("size") * 8 / set_bytes)).cast("int").alias("subs"))
    part = F.pmod(F.xxhash64("node"), "subs").cast("int").alias("sub")
    members = F.array_sort(F.collect_list(F.struct("node", "lo", "hi"))).alias("b")
    tiles = materialize(nodes.join(F.broadcast(subs), "cell").groupBy("cell", part).agg(members), "tiles")
    near = F.explode(F.sequence(F.col("cell"), F.col("cell") + _SIZE_CELLS)).alias("cell")
    sent = tiles.select(F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"), F.col("b").alias("a"), near).join(F.broadcast(subs), "cell")
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).where("cell != cell_a or sub >= sub_a")
    same = ((F.col("cell") == F.col("cell_a")) & (F.col("sub") == F.col("sub_a"))).alias("same")
    pair = F.concat_ws(" ", "cell_a", "sub_a", "cell", "sub").alias("pair")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of a pair of tiles that have one of the other side within the radius."""
        for batch in batches:
            for k in range(batch.num_rows):
                halves, names = [], []
                for c in ("a", "b"):
                    x = batch.column(batch.schema.get_field_index(c))[k].values
                    names.append(x.field("node"))
                    halves.append(np.array([x.field(h).to_numpy().view(np.uint64) for h in ("lo", "hi")]))
                own = batch.column(batch.schema.get_field_index("same"))[k].as_py()
                hit = [np.zeros(len(n), bool) for n in names]
                for i, j in _close(halves[0], halves[1], own):
                    hit[0][i] = True
                    hit[1][j] = True
                if own:
                    hit = [hit[0] | hit[1]]
                for side, h in enumerate(hit):
                    found = np.flatnonzero(h)
                    if len(found):
                        n = len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch.column(batch.schema.get_field_index("pair"))[k].as_py()] * n), pa.array([side if not own else 2] * n, pa.int8()), names[side].take(pa.array(found)), *(pa.array(halves[side][r][found].view(np.int64)) for r in range(2))],
                            ["pair", "side", "node", "lo", "hi"],
                        )

    wanted = sent.join(tiles, ["cell", "sub"]).select("a", "b", same, pair).mapInArrow(candidates, "pair string, side tinyint, node string, lo bigint, hi bigint")
    wanted = materialize(wanted, "candidates")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            x, off = shingle_sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["node", "set"])

    keys = nodes.join(wanted.select("node").distinct(), "node").select("node", "key")
    sets = docs.join(keys, "key").select("node", "text").mapInArrow(sets_of, "node string, set binary")
    sets = materialize(sets.dropDuplicates(["node"]), "shingles")

    def decide(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        parts = [table.filter(pa.array(side == s)) for s in ((2,) if side[0] == 2 else (0, 1))]
        halves = [np.array([p.column(h).to_numpy().view(np.uint64) for h in ("lo", "hi")]) for p in parts]
        names = [p.column("node").to_pylist() for p in parts]
        own = [[np.frombuffer(x.as_buffer(), np.uint64) for x in p.column("set")] for p in parts]
        links = _similar_links(halves[0], halves[-1], own[0], own[-1], similarity, len(parts) == 1)
        return pa.table([pa.array([names[0][i] for i, _ in links], pa.string()), pa.array([names[-1][j] for _, j in links], pa.string())], names=["src", "dst"])

    links = wanted.join(sets, "node").groupBy("pair").applyInArrow(decide, "src string, dst string")
    linked = settled(lambda: connected_components(links), docs.sparkSession, "linked")
    return signed.select("key", "node").join(linked, "node", "left").select("key", F.coalesce("component", "node").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float | None = None, **how) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the least (id, hash of its text).

    Groups are those of near_duplicates() or, if a similarity is given, of near_sets(). Null and blank
    texts are equal. Null ids come after all others, so such a row stays only if its group has no other
    id. Of rows with one id and one text, any one stays. All columns of docs come back, whatever their names.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("key")
    if similarity is None:
        found = near_duplicates(docs.select(key, F.col(text_col)), "key", text_col, **how)
        kept = found.where(F.col("key").eqNullSafe(F.col("component_id"))).select(_flat("key")).distinct()
    else:
        order = F.from_json("key", f"none boolean, id {docs.schema[id_col].dataType.simpleString()}, h bigint")

        def least() -> DataFrame:
            found = near_sets(docs.select(key, F.col(text_col).alias("text")).select(_flat("key"), "text"), similarity=similarity, **how)
            return found.groupBy("component").agg(F.min_by("key", order).alias("key")).select("key")

        kept = settled(least, docs.sparkSession, "kept")
    rows = docs.select(F.struct("*").alias("row"), key).select("row", _flat("key")).join(kept, "key")
    first = Window.partitionBy("key").orderBy("key")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")


def _flat(key: str):
    """A struct key as one binary-comparable string without nulls, for joins."""
    return F.to_json(key, {"ignoreNullFields": "false"}).alias("key")
