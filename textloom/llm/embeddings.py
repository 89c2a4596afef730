"""Embedding near-duplicates: an inverted multi-index visited by multi-sequence traversal, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import connected_components
from textloom.runtime import materialize, settled, small_batches

#: Vectors that fit the codebooks and the traversal, and so many for each codeword where there are many; every vector is indexed.
SAMPLE, PER_WORD = 16_384, 16
#: Vectors that a cell of the grid has on average, and codewords of a half at most: beyond some four thousand million vectors cells grow.
PER_CELL, WORDS = 256, 4096
_TILE = 2048
#: Cells whose sizes are broadcast; a larger grid's are joined.
_BROADCAST = 1 << 18


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, however large or small their numbers."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([np.zeros(0, int), *(_distances(x[lo : lo + step], c).argmin(1) for lo in range(0, len(x), step))])


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


@dataclass
class MultiIndex:
    """Codebooks of a vector's two halves; cell (i, j) of their product grid has number i * k + j."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _distances(x[:, :h], self.first), _distances(x[:, h:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return _nearest(x[:, :h], self.first) * len(self.second) + _nearest(x[:, h:], self.second)

    def traverse(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """The `visits` nearest cells of each row, nearest first: both halves' sequences, merged.

        The cell of the i-th and j-th nearest codewords comes behind i * j - 1 others at least, so only
        the hyperbola i * j <= visits is looked at, for a few rows at a time.
        """
        t = min(most or self.visits, len(self.first) * len(self.second))
        step = max(1, (1 << 20) // (t * max(1, t.bit_length())))
        if len(x) > step:
            return np.concatenate([self.traverse(x[lo : lo + step], t) for lo in range(0, len(x), step)])
        a, b = self.halves(x)
        at, bt = np.argsort(a, 1, kind="stable")[:, :t], np.argsort(b, 1, kind="stable")[:, :t]
        i, j = (v.ravel() for v in np.meshgrid(np.arange(at.shape[1]), np.arange(bt.shape[1]), indexing="ij"))
        use = (i + 1) * (j + 1) <= t
        i, j = i[use], j[use]
        far = np.take_along_axis(a, at, 1)[:, i] + np.take_along_axis(b, bt, 1)[:, j]
        order = np.argsort(far, 1, kind="stable")[:, :t]
        return np.take_along_axis(at, i[order], 1) * len(self.second) + np.take_along_axis(bt, j[order], 1)


    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Of each row, how many cells are nearer than the given one, or as near; counted over sorted halves, without the grid."""
        a, b = self.halves(x)
        row = np.arange(len(x))
        target = a[row, cells // len(self.second)] + b[row, cells % len(self.second)] + 1e-9
        b.sort(1)
        return np.array([int(np.searchsorted(q, t - p, "right").sum()) for p, q, t in zip(a, b, target, strict=True)]) - 1


def codewords(rows: int) -> int:
    """How many codewords a half has: the grid's cells grow with the input."""
    return int(np.clip(np.sqrt(rows / PER_CELL), 1, WORDS))


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float) -> MultiIndex:
    """Codebooks from unit vectors, and how many cells to visit for the recall wanted.

    It is met by two kinds of pairs: the sample's own pairs at or above the threshold, and sampled
    vectors with copies turned to a cosine drawn evenly between the threshold and one. A pair counts
    as found once either of its vectors visits the other's cell.
    """
    rng = np.random.default_rng(11)
    h = sample.shape[1] // 2
    k = codewords(rows)
    index = MultiIndex(k_means(sample[:, :h], k), k_means(sample[:, h:], k))
    x = sample[rng.choice(len(sample), min(1024, len(sample)), replace=False)]
    cos = rng.uniform(threshold, 1, len(x))[:, None]
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    pairs = [(x, unit(cos * x + np.sqrt(1 - cos**2) * unit(turn)))]
    q, y = np.nonzero(x @ sample.T >= threshold)
    other = np.flatnonzero(np.abs(x[q] - sample[y]).max(1, initial=0) > 0)
    some = rng.choice(other, min(4096, len(other)), replace=False)
    if len(some) >= 30:
        pairs.append((x[q[some]], sample[y[some]]))
    for a, b in pairs:
        ranks = np.minimum(index.ranks(a, index.cells(b)), index.ranks(b, index.cells(a)))
        index.visits = max(index.visits, int(np.quantile(ranks, recall, method="higher")) + 1)
    return index


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of a boolean matrix between rows and columns."""
    rows, cols = near.shape
    ca, cb = np.arange(rows), np.arange(rows, rows + cols)
    out = []
    for i in np.flatnonzero(near.any(1)):
        hits = np.flatnonzero(near[i])
        mine = ca[i]
        other, at = np.unique(cb[hits], return_index=True)
        for c, k in zip(other.tolist(), at.tolist(), strict=True):
            if c != mine:
                out.append((int(i), int(hits[k])))
                ca[ca == c] = mine
                cb[cb == c] = mine
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.9, recall: float = 0.97) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row: links are pairs found with cosine >= threshold.

    Equal vectors meet first. Each distinct one lives in one cell of the grid and visits the cells
    nearest to it; a cell's residents and visitors are compared in tiles of bounded size, in double
    precision. A pair that two visits find counts in one of them. Tiles give counts and a spanning
    forest of their links, never all pairs.

    Vectors that are null, zero, hold null or non-finite numbers, or are not as long as most, link
    with nothing and are their own component. component_id is the least id reachable, a row's own id
    included; a null id never is one where there is another. Repeated rows stay and link with each
    other. An empty table gives no rows; other columns are not read. kept says component_id = id.
    """
    small_batches(vectors, 2048)
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    size = F.size(v)
    common = rows.where(fine).groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    d = common["size"] if common else -1
    rows = rows.withColumn("key", F.when(fine & (size == d), F.xxhash64("v")))
    unique = materialize(rows.where("key is not null").groupBy("key").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("n")), "vectors")
    count = unique.count()

    none = rows.where("key is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    if count:
        low, wanted = -(1 << 63), max(SAMPLE, PER_WORD * codewords(count))
        cut = min((1 << 63) - 1, low + int((1 << 64) * min(1.0, wanted / count)))
        sample = unique.where(F.col("key") <= cut).select("v").toArrow()
        index = fit(unit(_matrix(sample.column(0))), count, threshold, recall) if sample.num_rows else None
        if index is None:
            index = fit(unit(_matrix(unique.limit(SAMPLE).select("v").toArrow().column(0))), count, threshold, recall)
        small = len(index.first) * len(index.second) <= _BROADCAST
        links, edges = _links(unique, spark.sparkContext.broadcast(index), threshold, small)
        found = settled(lambda: connected_components(edges), spark, "linked").withColumnRenamed("node", "key")
        by_key = unique.select("key", "least", "n").join(links, "key", "left").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
        least = by_key.groupBy("component").agg(F.min("least").alias("component_id"))
        by_key = by_key.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id")
        none = none.unionByName(rows.where("key is not null").select("id", "key").join(by_key, "key").select("id", "n_links", "component_id"))
    return none.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(unique: DataFrame, index, threshold: float, small: bool) -> tuple[DataFrame, DataFrame]:
    """(key, links) and edges (src, dst) among distinct vectors; small says that the grid's sizes may be broadcast."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column(1)))
                cells = index.value.cells(x).astype(np.int32)
                visits = index.value.traverse(x).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(list(visits), pa.list_(pa.int32()))], ["key", "v", "n", "own", "visits"])

    kind = unique.schema["v"].dataType.simpleString()
    placed = materialize(unique.select("key", "v", "n").mapInArrow(place, f"key bigint, v {kind}, n bigint, own int, visits array<int>"), "placed")
    cells = F.explode(F.array_union("visits", F.array("own"))).alias("cell")
    # one row per cell of the grid
    tiles = lambda t, c: t.groupBy("cell").agg(F.ceil(F.count("*") / _TILE).cast("int").alias(c))
    sizes = tiles(placed.select(F.col("own").alias("cell")), "rts").join(tiles(placed.select(cells), "vts"), "cell")
    sizes = materialize(sizes, "cells")
    sizes = F.broadcast(sizes) if small else sizes
    mine = lambda c: F.pmod(F.xxhash64("key"), c).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["cell", "rt", "vt", "visitor", "key", "v", "n", "own", "visits"]
    residents = placed.withColumn("cell", F.col("own")).join(sizes, "cell").withColumn("rt", mine("rts")).withColumn("vt", upto("vts")).withColumn("visitor", F.lit(False))
    visitors = placed.select("*", cells).join(sizes, "cell").withColumn("vt", mine("vts")).withColumn("rt", upto("rts")).withColumn("visitor", F.lit(True))
    visitors = visitors.withColumn("visits", F.array().cast("array<int>"))

    def verify(table: pa.Table) -> pa.Table:
        flags = table.column("visitor").to_numpy()
        r, q = table.filter(pa.array(~flags)), table.filter(pa.array(flags))
        out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        if r.num_rows and q.num_rows:
            near = unit(_matrix(q.column("v"))) @ unit(_matrix(r.column("v"))).T >= threshold
            (qk, qn, qo), (rk, rn, ro) = (([x.column(c).to_numpy() for c in ("key", "n", "own")]) for x in (q, r))
            here = qo == ro[0]
            near[here] &= qk[here][:, None] < rk[None, :]
            # a pair that both vectors' visits find counts in the cell with the larger number
            both = np.zeros(near.shape, bool)
            homes, home = np.unique(qo, return_inverse=True)
            place = {int(c): k for k, c in enumerate(homes)}
            seen = np.zeros((len(homes), r.num_rows), bool)
            for k, cells in enumerate(r.column("visits").to_pylist()):
                seen[[place[c] for c in cells if c in place], k] = True
            both = seen[home]
            near &= ~(both & ~here[:, None] & (qo > ro[0])[:, None])
            counts = near.astype(np.float64)
            for keys, links in ((qk, counts @ rn), (rk, qn @ counts)):
                hit = links > 0
                out.append(np.column_stack([np.zeros(hit.sum(), np.int64), keys[hit], links[hit].astype(np.int64)]))
            pairs = forest(near)
            if pairs:
                i, j = np.array(pairs).T
                out.append(np.column_stack([np.ones(len(i), np.int64), qk[i], rk[j]]))
        kind, a, b = np.concatenate(out).T
        return pa.table([pa.array(kind.astype(np.int8)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    found = residents.select(columns).unionByName(visitors.select(columns)).groupBy("cell", "rt", "vt").applyInArrow(verify, "kind tinyint, a bigint, b bigint")
    found = materialize(found, "found")
    links = found.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("links"))
    return links, found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"))
