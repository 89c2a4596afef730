"""Clusters by clustering features: a balanced tree of sums per task, merged by adding, then Ward's linkage of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.neighbours import _matrix, _points
from textloom.runtime import materialize, settled

#: Subclusters of a task at most; where more are needed the tree is built anew under a higher threshold.
MOST = 1024
#: Trees that meet in one merge.
_FAN = 16


class _Node:
    """Entries of sums, up to `branching`; inner nodes have a child for each."""

    __slots__ = ("n", "ls", "ss", "children", "size")

    def __init__(self, branching: int, d: int, leaf: bool):
        self.n, self.ls, self.ss = np.zeros(branching + 1), np.zeros((branching + 1, d)), np.zeros(branching + 1)
        self.children: list[_Node] | None = None if leaf else []
        self.size = 0

    def add(self, n, ls, ss, child=None) -> None:
        k = self.size
        self.n[k], self.ls[k], self.ss[k] = n, ls, ss
        if self.children is not None:
            self.children.append(child)
        self.size += 1

    def total(self):
        k = self.size
        return self.n[:k].sum(), self.ls[:k].sum(0), self.ss[:k].sum()


class FeatureTree:
    """The tree of Zhang et al. (1996): an entry takes in what leaves its radius within the threshold."""

    def __init__(self, d: int, threshold: float, branching: int = 50):
        self.d, self.threshold, self.branching = d, threshold, branching
        self.root, self.leaves = _Node(branching, d, True), 0

    def insert(self, n: float, ls: np.ndarray, ss: float) -> None:
        node, path = self.root, []
        while node.children is not None:
            k = int(((node.ls[: node.size] / node.n[: node.size, None] - ls / n) ** 2).sum(1).argmin())
            path.append((node, k))
            node = node.children[k]
        done = False
        if node.size:
            k = int(((node.ls[: node.size] / node.n[: node.size, None] - ls / n) ** 2).sum(1).argmin())
            m, s, q = node.n[k] + n, node.ls[k] + ls, node.ss[k] + ss
            if q / m - (s / m) @ (s / m) <= self.threshold**2 + 1e-12:
                node.n[k], node.ls[k], node.ss[k], done = m, s, q, True
        if not done:
            node.add(n, ls, ss)
            self.leaves += 1
        for parent, k in path:
            parent.n[k] += n
            parent.ls[k] += ls
            parent.ss[k] += ss
        while node.size > self.branching:
            halves = self._split(node)
            if path:
                parent, k = path.pop()
                parent.n[k], parent.ls[k], parent.ss[k] = halves[0].total()
                parent.children[k] = halves[0]
                parent.add(*halves[1].total(), halves[1])
                node = parent
            else:
                self.root = node = _Node(self.branching, self.d, False)
                for h in halves:
                    node.add(*h.total(), h)

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        """Two nodes around the entries that lie furthest apart."""
        c = node.ls[: node.size] / node.n[: node.size, None]
        far = ((c[:, None] - c[None]) ** 2).sum(2)
        i, j = np.unravel_index(far.argmax(), far.shape)
        halves = [_Node(self.branching, self.d, node.children is None) for _ in "ab"]
        mine = far[i] <= far[j]
        mine[i], mine[j] = True, False
        for k in range(node.size):
            halves[0 if mine[k] else 1].add(node.n[k], node.ls[k].copy(), node.ss[k], node.children[k] if node.children is not None else None)
        return halves[0], halves[1]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, sums, sums of squares) of the leaves' entries."""
        todo, out = [self.root], []
        while todo:
            node = todo.pop()
            if node.children is None:
                out.append((node.n[: node.size], node.ls[: node.size], node.ss[: node.size]))
            else:
                todo += node.children[::-1]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def reduce(tree: FeatureTree, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, most: int = MOST) -> FeatureTree:
    """The tree with these features in it; one with over `most` leaves is built anew from its entries, half as fine again, until it has not."""
    for k in range(len(n)):
        tree.insert(n[k], ls[k], ss[k])
        while tree.leaves > most:
            old = tree.entries()
            tree = FeatureTree(tree.d, max(1.5 * tree.threshold, 1e-6), tree.branching)
            for m, s, q in zip(*old, strict=True):
                tree.insert(m, s, q)
    return tree


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k groups of the rows by Ward's linkage, numbered by their first rows; ties go to the first pair."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    size, of = np.ones(n), np.arange(n)
    low, at = d.min(1), d.argmin(1)
    for _ in range(n - max(1, min(k, n))):
        i = int(low.argmin())
        j = int(at[i])
        i, j = min(i, j), max(i, j)
        row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        row[[i, j]] = np.inf
        row[~np.isfinite(d[i])] = np.inf
        row[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
        of[of == j] = i
        low[j] = np.inf
        # only rows that pointed at either, or are nearer to the merged one now, change
        for r in [i, *np.flatnonzero(np.isin(at, (i, j)))]:
            low[r], at[r] = d[r].min(), d[r].argmin()
        nearer = row < low
        low[nearer], at[nearer] = row[nearer], i
    return np.unique(of, return_inverse=True)[1]


def features(points: DataFrame, threshold: float = 0.5, branching: int = 50, most: int = MOST) -> DataFrame:
    """(part, n, ls, ss, threshold) of points (id, v): the subclusters of all tasks, merged 16 tasks at a time down to one tree.

    Features only add up, so that counts and sums don't depend on how rows are dealt out; which rows share
    a subcluster may. A subcluster's radius stays within its tree's threshold, which grows by half where
    more than `most` would be needed, so that no task holds more than 16 * most of them.
    """
    first = points.first()
    d = len(first.v) if first else 0
    schema = "part bigint, n double, ls array<double>, ss double, threshold double"

    def frame(tree: FeatureTree, part: int) -> pd.DataFrame:
        n, ls, ss = tree.entries()
        return pd.DataFrame({"part": part, "n": n, "ls": list(ls), "ss": ss, "threshold": tree.threshold})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = FeatureTree(d, threshold, branching)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                tree = reduce(tree, np.ones(len(x)), x, (x * x).sum(1), most)
        if tree.leaves:
            f = frame(tree, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(f[c].tolist(), t) for c, t in (("part", pa.int64()), ("n", pa.float64()), ("ls", pa.list_(pa.float64())), ("ss", pa.float64()), ("threshold", pa.float64()))], list(f.columns))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "n", "ss"], kind="stable")
        tree = FeatureTree(d, rows["threshold"].max(), branching)
        return frame(reduce(tree, rows["n"].to_numpy(), np.stack(rows["ls"]), rows["ss"].to_numpy(), most), int(key[0]))

    found = materialize(points.select("v").mapInArrow(run, schema), "features")
    while True:
        parts = found.select("part").distinct().count()
        if parts <= 1:
            return found
        # parts in order of their numbers, _FAN to a group: numbers are dense enough, as they come from task numbers
        found = materialize(found.withColumn("group", F.floor(F.col("part") / _FAN)).groupBy("group").applyInPandas(merge, schema), "features")


def birch(vecs: DataFrame, k: int = 3, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.5, branching: int = 50, metric: str = "euclidean", most: int = MOST) -> DataFrame:
    """(id_col, label) of every vector: the group of its nearest subcluster; groups are k, by Ward's linkage of the subclusters' means.

    Subclusters are MOST at most, so that their means go to every task. Vectors that are null, hold null or
    non-finite numbers or have another length than most get -1; an empty table gives no rows.
    """
    spark = vecs.sparkSession

    def run() -> DataFrame:
        points = _points(vecs, id_col, vector_col, metric)
        kind = points.schema["id"].dataType.simpleString()
        found = features(points, threshold, branching, most).orderBy("n", "ss").collect()
        if found:
            c = np.array([np.array(r.ls) / r.n for r in found])
            sent = spark.sparkContext.broadcast((c, ward(c, k)))

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                c, label = sent.value
                for batch in batches:
                    x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, c.shape[1]))
                    best = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label[best].astype(np.int32))], ["id", "label"])

            labels = points.mapInArrow(near, f"id {kind}, label int")
        else:
            labels = points.select("id", F.lit(-1).alias("label"))
        return vecs.select(F.col(id_col).alias("id")).join(labels, "id", "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"))

    return settled(run, spark, "birch")
