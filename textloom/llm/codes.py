"""Vector code compression: product codes whose codebooks are fitted by the filtering form of Lloyd's method."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize, small_batches

#: Vectors whose trees are built together, and points of a leaf at most.
CHUNK, LEAF = 32_768, 16
#: Numbers are kept within this, so that squared distances fit 64 bits; only components beyond two thousand million / SCALE reach it.
_MOST = 1 << 27
SCALE = 256
#: Pairs of points and entries that are compared at once.
_PAIRS = 1 << 20


@dataclass
class Level:
    """The nodes of one depth: ranges of the tree's order, bounding boxes and sums."""

    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


@dataclass
class Tree:
    """A balanced kd-tree of integer points; node i of a level has the children 2i and 2i + 1."""

    points: np.ndarray
    order: np.ndarray
    levels: list[Level]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halve each node at the median of its box's widest side until leaves have `leaf` points at most; sums and boxes are cached."""
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    order, levels = np.arange(n), []
    for d in range(depth + 1):
        start = (np.arange((1 << d) + 1) * n) >> d
        x = points[order]
        low, high = np.minimum.reduceat(x, start[:-1]), np.maximum.reduceat(x, start[:-1])
        levels.append(Level(start, low, high, np.add.reduceat(x, start[:-1])))
        if d < depth:
            node = np.repeat(np.arange(1 << d), np.diff(start))
            order = order[np.lexsort((x[np.arange(n), (high - low).argmax(1)[node]], node))]
    return Tree(points, order, levels)


def _candidates(low: np.ndarray, high: np.ndarray, entries: np.ndarray, able: np.ndarray) -> np.ndarray:
    """Of each box, which of its able entries may be nearest to a point in it, ties going to the lower index.

    An entry goes if the one nearest to the box's middle is nearer at the corner that lies farthest
    towards the entry, as the difference of both distances is linear in the point.
    """
    middle, double = low + high, 2 * entries
    far = np.zeros(able.shape, np.int64)
    for c in range(entries.shape[1]):
        far += (double[None, :, c] - middle[:, None, c]) ** 2
    best = np.where(able, far, np.iinfo(np.int64).max).argmin(1)
    gain = np.zeros(able.shape, np.int64)
    for c in range(entries.shape[1]):
        z, b = entries[None, :, c], entries[best, c][:, None]
        corner = np.where(z > b, high[:, None, c], low[:, None, c])
        gain += (z - corner) ** 2 - (b - corner) ** 2
    index = np.arange(len(entries))[None, :]
    able = able & ((gain < 0) | (gain == 0) & (index < best[:, None]))
    able[np.arange(len(best)), best] = True
    return able


def assign(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(entry, count, sums, ranges or points) by whole subtrees and, in leaves that several entries share, by points.

    The last is an array of (start, end) in the tree's order; each range is nearest to its entry.
    """
    able = np.ones((1, len(entries)), bool)
    node = np.zeros(1, np.int64)
    for d, level in enumerate(tree.levels):
        able = _candidates(level.low[node], level.high[node], entries, able)
        single = able.sum(1) == 1
        done = node[single]
        if len(done):
            start, end = level.start[done], level.start[done + 1]
            yield able[single].argmax(1), end - start, level.total[done], np.column_stack([start, end])
        node, able = node[~single], able[~single]
        if d + 1 < len(tree.levels):
            node, able = np.column_stack([2 * node, 2 * node + 1]).ravel(), np.repeat(able, 2, 0)
    start, end = tree.levels[-1].start[node], tree.levels[-1].start[node + 1]
    step = max(1, _PAIRS // (len(entries) * LEAF))
    for lo in range(0, len(node), step):
        of = np.repeat(np.arange(lo, min(lo + step, len(node))), (end - start)[lo : lo + step])
        at = np.concatenate([np.arange(i, j) for i, j in zip(start[lo : lo + step], end[lo : lo + step], strict=True)])
        x = tree.points[tree.order[at]]
        row, entry = np.nonzero(able[of])
        far = ((x[row] - entries[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        # the least distance of a point's candidates, and the first of them that has it
        least = np.minimum.reduceat(far, first)
        hit = np.flatnonzero(far == least[row])
        hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        yield entry[hit], np.ones(len(at), np.int64), x, np.column_stack([at, at + 1])


def sums(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the points nearest to each entry."""
    n, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    for entry, count, part, _ in assign(tree, entries):
        np.add.at(n, entry, count)
        np.add.at(total, entry, part)
    return n, total


def nearest(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """The entry nearest to each point, ties to the lower index."""
    out = np.empty(len(tree.points), np.int64)
    for entry, _, _, ranges in assign(tree, entries):
        size = ranges[:, 1] - ranges[:, 0]
        at = np.arange(size.sum()) + np.repeat(ranges[:, 0] - np.cumsum(size) + size, size)
        out[tree.order[at]] = np.repeat(entry, size)
    return out


def whole(vector: Column) -> Column:
    """Components as integers: floor(SCALE * x), within bounds that only components beyond half a million reach."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(x.cast("double") * SCALE).cast("bigint"))).cast("int"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A partition's rows, CHUNK at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def fit(rows: DataFrame, parts: int, start: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x width) after `rounds` of Lloyd's method from `start`; rows have a column x of integers.

    Each task builds trees over the parts of its rows, CHUNK at a time, and gives an entry's count and
    sums; Spark adds these up, and only they come to the driver.
    """
    books = start
    width = start.shape[2]
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)

        def partial(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(sent.value.shape[:2], np.int64), np.zeros(sent.value.shape, np.int64)
            for table in _chunks(batches):
                x = _matrix(table.column(0).chunk(0))
                for p, entries in enumerate(sent.value):
                    a, b = sums(build(x[:, p * width : (p + 1) * width]), entries)
                    n[p] += a
                    total[p] += b
            p, e = np.nonzero(n)
            if len(p):
                rows = [np.repeat(v, width) for v in (p, e)] + [np.tile(np.arange(width), len(p)), np.repeat(n[p, e], width), total[p, e].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows], ["part", "entry", "place", "n", "total"])

        found = rows.select("x").mapInArrow(partial, "part bigint, entry bigint, place bigint, n bigint, total bigint")
        found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
        part, entry, place, n, total = (found.column(c).to_numpy() for c in ("part", "entry", "place", "n", "total"))
        books = books.copy()
        books[part, entry, place] = total // n
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 16, size: int = 64, rounds: int = 2) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every vector without null or non-finite components.

    Components become floor(256 * x); vectors are cut into `parts` equal parts. A part's codebook starts
    from that part of the `size` least ids (fewer rows: fewer entries) and takes `rounds` rounds of
    Lloyd's method with exact integer means, floored; an entry that no part is nearest to stays. code has
    two hex digits a part; error is the vector's squared distance to its entries; label_error adds it up
    over equal labels, nulls together; the digest is of all entries' components.

    Other lengths than the most common (of several the longest) that `parts` divides are dropped as null
    vectors are: they have no such parts. Components beyond half a million count as half a million.
    Null ids come last among the least ids, equal ids in order of their vectors; repeated rows stay. An
    empty table gives no rows; other columns are not read.
    """
    small_batches(vectors, 4096)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    fine = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine).select("id", "label", whole(v).alias("x"), F.size(v).alias("d"))
    rows = materialize(rows, "vectors")
    common = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    kinds = {c: vectors.schema[x].dataType.simpleString() for c, x in (("id", id_col), ("label", label_col))}
    if common is None:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    rows = rows.where(F.col("d") == common.d).drop("d")
    width = common.d // parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(size).select("x").collect()
    start = np.array([r.x for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = fit(rows, parts, start, rounds)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            x = _matrix(table.column("x").chunk(0))
            near, error = np.empty((len(x), parts), np.uint8 if size <= 256 else np.int64), np.zeros(len(x), np.int64)
            for p, entries in enumerate(sent.value):
                part = x[:, p * width : (p + 1) * width]
                near[:, p] = best = nearest(build(part), entries)
                error += ((part - entries[best]) ** 2).sum(1)
            codes = ["".join(f"{e:02x}" for e in row) for row in near.tolist()]
            yield pa.RecordBatch.from_arrays([*(table.column(c).chunk(0) for c in ("id", "label")), pa.array(codes, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Book k + 1 from book k, as SQL."""
    return f"""near{k} AS (
  SELECT r, p, min(d * 64 + e) % 64 AS e FROM (
    SELECT r, part.p, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - b[i]) * (v[i] - b[i]))) AS d FROM part JOIN book{k} ON part.p = book{k}.p) GROUP BY r, p
), mean{k} AS (
  SELECT p, e, list(m ORDER BY place) AS b FROM (
    SELECT p, e, place, floor(sum(v[place]) / count(*))::BIGINT AS m FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS place FROM near{k} JOIN part USING (r, p)) GROUP BY p, e, place) GROUP BY p, e
), book{k + 1} AS (
  SELECT p, e, coalesce(mean{k}.b, book{k}.b) AS b FROM book{k} LEFT JOIN mean{k} USING (p, e)
)"""


#: op12's codes with two rounds written out; all vectors have one length.
SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT r, vec_id, label, x, p, list_slice(x, p * (len(x) // 16) + 1, (p + 1) * (len(x) // 16)) AS v FROM kept, range(16) AS q(p)
), book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, x) - 1 AS e, v AS b FROM part QUALIFY e < 64
), {_round(0)}, {_round(1)}, near2 AS (
  SELECT r, p, min(d * 64 + e) % 64 AS e, min(d) AS d FROM (
    SELECT r, part.p, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - b[i]) * (v[i] - b[i]))) AS d FROM part JOIN book2 ON part.p = book2.p) GROUP BY r, p
), coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""
