"""Manifold layout of vectors: fuzzy weights of a neighbour graph and a seeded force layout (McInnes et al. 2018)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.neighbours import _points, nearest_graph
from textloom.operators.topics import project
from textloom.runtime import materialize, settled

#: Nodes of which each round's pushes are drawn; their positions go to every task.
_PUSHERS = 64
_CLIP = 4.0


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a * d^2b), nearest to a curve that is 1 up to min_dist and falls as exp(-(d - min_dist) / spread) from there."""
    d = np.linspace(0, 3 * spread, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    best, a, b, width = np.inf, 1.5, 1.0, np.array([1.4, 0.6])
    for _ in range(12):
        for x in a + width[0] * np.linspace(-1, 1, 15):
            for y in b + width[1] * np.linspace(-1, 1, 15):
                if x > 0 and y > 0 and (e := float(((1 / (1 + x * d ** (2 * y)) - want) ** 2).sum())) < best:
                    best, at = e, (x, y)
        (a, b), width = at, width * 0.5
    return float(a), float(b)


def fuzzy_weights(graph: DataFrame) -> DataFrame:
    """(u, v, w), u < v, of a neighbour graph (src, dst, distance, rank): how surely two points are linked.

    A point's links weigh exp(-(d - rho) / sigma): rho is its nearest neighbour's positive distance, and
    sigma is such that they add up to log2 of their number and one. Both ends' weights are joined as
    a + b - ab. A point's distances, at most as many as the graph has neighbours, meet in one row.
    """
    kind = graph.schema["src"].dataType.simpleString()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = batch.column(1).to_pylist()
            most = max(map(len, far), default=0)
            d = np.array([x + [np.inf] * (most - len(x)) for x in far], float).reshape(len(far), most)
            rho = np.where(d > 0, d, np.inf).min(1, initial=np.inf)
            rho[~np.isfinite(rho)] = 0.0
            over = np.maximum(0.0, d - rho[:, None])
            target = np.log2(np.isfinite(d).sum(1) + 1.0)
            low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
            for _ in range(64):
                much = np.exp(-over / sigma[:, None]).sum(1) > target
                high, low = np.where(much, sigma, high), np.where(much, low, sigma)
                sigma = np.where(np.isfinite(high), (low + high) / 2, 2 * sigma)
            sigma = np.maximum(sigma, 1e-3 * np.where(np.isfinite(d), d, 0.0).sum(1) / np.maximum(1, np.isfinite(d).sum(1)) + 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rho), pa.array(sigma)], ["src", "rho", "sigma"])

    scale = graph.groupBy("src").agg(F.sort_array(F.collect_list("distance")).alias("d")).mapInArrow(fit, f"src {kind}, rho double, sigma double")
    w = F.exp(-F.greatest(F.lit(0.0), F.col("distance") - F.col("rho")) / F.col("sigma"))
    one = graph.join(scale, "src").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), w.alias("w"))
    a, b = F.max("w"), F.when(F.count("*") > 1, F.min("w")).otherwise(0.0)
    return one.groupBy("u", "v").agg((a + b - a * b).alias("w"))


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(-_CLIP), F.least(F.lit(_CLIP), x))


def layout(edges: DataFrame, start: DataFrame, epochs: int = 40, *, min_dist: float = 0.1, pushes: int = 5, rate: float = 1.0) -> DataFrame:
    """(id, position) of start's nodes after `epochs` rounds of pulls along edges (u, v, w) and pushes from others.

    All nodes move at once by the mean of their pulls, by weight, and of `pushes` pushes; steps shrink to
    nothing. Who pushes is drawn by hash from a round's _PUSHERS nodes of lowest hash, so that reruns
    agree up to rounding. A round sends each edge once, with one end's position.
    """
    a, b = curve(min_dist)
    links = materialize(edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "w")), "links")
    at = materialize(start.select("id", "position"), "positions")
    first = at.first()
    dims = len(first.position) if first else 0
    zero = F.array(*[F.lit(0.0)] * dims) if dims else F.array().cast("array<double>")
    apart = lambda p, q: F.zip_with(p, q, lambda x, y: x - y)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    for epoch in range(epochs if dims else 0):
        step = rate * (1 - epoch / epochs)
        ends = links.join(at.select(F.col("id").alias("dst"), F.col("position").alias("q")), "dst").join(at.select(F.col("id").alias("src"), F.col("position").alias("p")), "src")
        ends = ends.withColumn("d", apart("p", "q")).withColumn("r", square(F.col("d")))
        pull = F.when(F.col("r") > 0, -2 * a * b * F.pow("r", F.lit(b - 1)) / (1 + a * F.pow("r", F.lit(b)))).otherwise(0.0)
        ends = ends.withColumn("pull", pull)
        pulls = ends.groupBy("src").agg(F.sum("w").alias("mass"), *[F.sum(F.col("w") * _clipped(F.col("pull") * F.col("d")[i])).alias(f"f{i}") for i in range(dims)])
        hashed = F.xxhash64("id", F.lit(epoch))
        table = F.array(*[F.array(*map(F.lit, r.position)) for r in at.orderBy(hashed, "id").limit(_PUSHERS).select("position").collect()])
        x = at.join(pulls, F.col("id") == F.col("src"), "left")
        force = F.array(*[F.coalesce(F.col(f"f{i}") / F.col("mass"), F.lit(0.0)) for i in range(dims)])
        x = x.select("id", "position", force.alias("force"), F.transform(F.sequence(F.lit(1), F.lit(pushes)), lambda k: F.get(table, F.pmod(F.xxhash64("id", k, F.lit(epoch)), F.size(table)).cast("int"))).alias("others"))

        def push(q: Column) -> Column:
            d = apart(F.col("position"), q)
            c = 2 * b / ((0.001 + square(d)) * (1 + a * F.pow(square(d), F.lit(b))))
            return F.transform(d, lambda y: _clipped(c * y))

        x = x.select("id", "position", "force", F.transform("others", push).alias("away"))
        away = F.aggregate("away", zero, lambda acc, y: F.zip_with(acc, y, lambda m, n: m + n / pushes))
        moved = F.zip_with(F.zip_with("position", "force", lambda p, f: p + f * step), away, lambda p, g: p + g * step)
        at = materialize(x.select("id", moved.alias("position")), "positions")
    return at


def embed(vecs: DataFrame, dims: int = 2, *, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = 15, metric: str = "cosine", min_dist: float = 0.1, epochs: int = 40) -> DataFrame:
    """(id_col, position) of the vectors in `dims` dimensions, near ones near: principal components, then the layout of their fuzzy neighbour graph.

    `neighbours` counts the vector itself. Vectors that nearest_graph() leaves out have no row; an empty
    table gives no rows.
    """
    spark = vecs.sparkSession

    def run() -> DataFrame:
        points = _points(vecs, id_col, vector_col, metric)
        graph = nearest_graph(points, neighbours - 1, id_col="id", vector_col="v", metric=metric)
        edges = materialize(fuzzy_weights(graph), "fuzzy")
        if points.isEmpty():
            return points.select(F.col("id").alias(id_col), F.col("v").alias("position"))
        start = project(points.withColumnRenamed("v", "embedding"), dims)
        widest = start.select(F.max(F.array_max(F.transform("position", F.abs)))).first()[0] or 1.0
        start = start.select("id", F.transform("position", lambda x: x * (10.0 / widest)).alias("position"))
        return layout(edges, start, epochs, min_dist=min_dist).select(F.col("id").alias(id_col), "position")

    return settled(run, spark, "manifold")
