"""Approximate nearest neighbours of vectors: neighbour descent over joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize, settled, small_batches

#: Rows of a bucket of the first guess at most, in expectation.
_BUCKET = 64


def _points(vecs: DataFrame, id_col: str, vector_col: str, metric: str) -> DataFrame:
    """(id, v) of vectors without null or non-finite numbers, of the most common length; unit vectors for cosines."""
    small_batches(vecs, 128)  # a row of lists holds some eighty vectors
    v = F.col("v")
    x = vecs.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda a: a.cast("double")).alias("v"))
    x = x.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))))
    common = x.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = x.where(F.size(v) == (common.d if common else 0))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))
        x = x.where(F.exists(v, lambda a: a != 0)).withColumn("norm", norm).select("id", F.transform("v", lambda a: a / F.col("norm")).alias("v"))
    return materialize(x, "points")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _lists(lists: DataFrame, k: int, kind: str, metric: str, changed: bool) -> DataFrame:
    """Each row is a list of (id, v, old): of each member the k nearest others in the list, as (src, dst, distance).

    If changed is set, pairs of two old members are left out, as an earlier round has compared them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0)
            member = c.flatten()
            ids, x, old = member.field("id"), _matrix(member.field("v")) if len(member) else None, member.field("old").to_numpy(zero_copy_only=False)
            off, src, dst, far = c.offsets.to_numpy() - c.offsets[0].as_py(), [], [], []
            for i, j in zip(off[:-1], off[1:]):
                if j - i < 2:
                    continue
                y = x[i:j]
                if metric == "cosine":
                    d = np.maximum(0.0, 1 - y @ y.T)
                else:
                    n = (y * y).sum(1)
                    d = np.sqrt(np.maximum(0.0, n[:, None] + n[None, :] - 2 * y @ y.T))
                np.fill_diagonal(d, np.inf)
                if changed:
                    d[np.ix_(old[i:j], old[i:j])] = np.inf
                m = min(k, j - i - 1)
                at = np.argpartition(d, m - 1, 1)[:, :m]
                row, col = np.repeat(np.arange(j - i), m), at.ravel()
                use = np.isfinite(d[row, col])
                src.append(i + row[use])
                dst.append(i + col[use])
                far.append(d[row[use], col[use]])
            if src:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(src))), ids.take(pa.array(np.concatenate(dst))), pa.array(np.concatenate(far))], ["src", "dst", "distance"])

    return lists.mapInArrow(run, f"src {kind}, dst {kind}, distance double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src, ties to the lower id. A first cut per task keeps the shuffle small."""
    nearest = Window.partitionBy("src").orderBy("distance", "dst")
    pairs = pairs.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.max("old").alias("old"))
    return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def nearest_graph(vecs: DataFrame, k: int = 15, *, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "euclidean", rounds: int = 8, tables: int = 4, width: int = 30, sample: int = 14) -> DataFrame:
    """(src, dst, distance, rank): the k nearest others of every vector, found by neighbour descent (Dong et al. 2011).

    The first guess compares vectors that share a bucket of signed random projections, in `tables` tables;
    a crowded bucket is dealt out by hash, so that none exceeds some 64 rows; and all meet some others at random. In each round a vector
    introduces its neighbours and those that have it as one, `sample` of either kind picked by hash, to
    each other; `width` neighbours are kept meanwhile, as vectors of many dimensions need more than k to go by; pairs that met before are not compared again. It ends after `rounds` rounds or once
    no more than a thousandth of all neighbours changes. Vectors travel in
    single precision, of which distances are made. Seeded: reruns agree.

    Null ids and vectors with null or non-finite numbers, of other lengths than the most common, or zero
    under cosines, take no part. Repeated ids are distinct only if ids are; an empty table gives no rows.
    """
    spark, width = vecs.sparkSession, max(k, width)
    points = _points(vecs, id_col, vector_col, metric)
    kind = points.schema["id"].dataType.simpleString()
    short = F.col("v").cast("array<float>").alias("v")
    n = points.count()
    first = points.first()
    d = len(first.v) if first else 1
    bits = max(0, int(np.ceil(np.log2(max(1, n) / (_BUCKET / 2)))))
    planes = np.random.default_rng(17).normal(size=(tables, bits, d))
    centre = np.array(points.agg(*[F.avg(F.col("v")[i]) for i in range(d)]).first() if n else [0.0] * d)
    sent = spark.sparkContext.broadcast((planes, centre))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, centre = sent.value
        for batch in batches:
            x = _matrix(batch.column(1)) - centre if batch.num_rows else np.zeros((0, d))
            for t in range(tables):
                bucket = ((x @ planes[t].T > 0) << np.arange(bits)).sum(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), t, np.int32)), pa.array(bucket)], ["id", "v", "t", "bucket"])
            # a last table of one bucket, dealt out by hash: a vector that is alone elsewhere meets some here
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), tables, np.int32)), pa.array(np.zeros(len(x), np.int64))], ["id", "v", "t", "bucket"])

    placed = materialize(points.mapInArrow(hashed, f"id {kind}, v array<double>, t int, bucket bigint"), "hashed")
    crowd = placed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / _BUCKET).cast("int").alias("parts"))
    dealt = placed.join(crowd, ["t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id", "t"), F.col("parts")))
    lists = dealt.withColumn("v", short).groupBy("t", "bucket", "part").agg(F.collect_list(F.struct("id", "v", F.lit(False).alias("old"))).alias("c")).select("c")
    graph = materialize(_best(_lists(lists, width, kind, metric, False).withColumn("old", F.lit(False)), width), "graph")
    for r in range(rounds):
        # a neighbour is old once it has been introduced; of the new ones and of the old ones up to `sample` go out
        pick = Window.partitionBy("src", "old").orderBy("h")
        out = graph.withColumn("h", F.xxhash64("src", "dst", F.lit(r))).withColumn("nth", F.row_number().over(pick)).where(F.col("nth") <= sample).select("src", "dst", "old", "h")
        back = Window.partitionBy("dst", "old").orderBy("h")
        into = out.withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= sample)
        members = out.select(F.col("src").alias("host"), F.col("dst").alias("id"), "old").unionByName(into.select(F.col("dst").alias("host"), F.col("src").alias("id"), "old"))
        members = members.groupBy("host", "id").agg(F.min("old").alias("old"))
        lists = members.join(points.select("id", short), "id").groupBy("host").agg(F.collect_list(F.struct("id", "v", "old")).alias("c")).select("c")
        found = _lists(lists, width, kind, metric, True).withColumn("old", F.lit(False))
        gone = out.select("src", "dst", F.lit(True).alias("went"))
        kept = graph.join(gone, ["src", "dst"], "left").select("src", "dst", "distance", (F.col("old") | F.coalesce("went", F.lit(False))).alias("old"))
        before = graph
        graph = materialize(_best(kept.unionByName(found), width), "graph")
        fresh = graph.join(before.select("src", "dst"), ["src", "dst"], "left_anti").count()
        if fresh <= 0.001 * n * width:
            break
    return graph.where(F.col("rank") <= k).select("src", "dst", "distance", F.col("rank").cast("int").alias("rank"))


def settled_graph(vecs: DataFrame, k: int = 15, **how) -> DataFrame:
    """nearest_graph(), stored, without the tables that led to it."""
    return settled(lambda: nearest_graph(vecs, k, **how), vecs.sparkSession, "neighbours")
