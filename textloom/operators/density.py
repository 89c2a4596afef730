"""Clusters by density: a spanning forest over mutual reachability and the condensed tree of its components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.neighbours import nearest_graph
from textloom.operators.ranking import ranked
from textloom.runtime import materialize, settled

#: The density of points at distance zero.
_TOP = 1e12


def mutual_reachability(graph: DataFrame, min_samples: int) -> DataFrame:
    """(u, v, w), u < v, of a neighbour graph (src, dst, distance, rank): the largest of the distance and both core distances.

    A point's core distance is the distance to its min_samples-th nearest other point, or to its furthest if it has fewer.
    """
    core = graph.where(F.col("rank") <= min_samples).groupBy(F.col("src").alias("id")).agg(F.max("distance").alias("core"))
    e = graph.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "distance").groupBy("u", "v").agg(F.min("distance").alias("distance"))
    e = e.join(core.toDF("u", "cu"), "u", "left").join(core.toDF("v", "cv"), "v", "left")
    return e.select("u", "v", F.greatest("distance", "cu", "cv").alias("w"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least spanning forest of (u, v, w), and (node, root) of every node: Boruvka's rounds.

    In a round each component picks its least edge out, by weight and then by both ends, so that picks
    make no circle but pairs that picked each other; components are then joined by doubling pointers.
    At least half of them go in a round. Each round is a min-aggregation with map-side combine and
    joins; parallel edges between two components are cut down to the least one.
    """
    e = materialize(edges.where("u != v").select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"), "edges")
    nodes = materialize(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    tree = None
    while not e.isEmpty():
        out = e.select("a", "b", "w", "u", "v").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "u", "v"))
        best = materialize(out.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("x")).select("a", F.col("x.b").alias("p"), "x.w", "x.u", "x.v"), "best")
        part = materialize(best.select("u", "v", "w").distinct(), "tree")
        tree = part if tree is None else tree.unionByName(part)
        # of two that picked each other the lower one is the root
        p = best.select("a", "p")
        p = p.join(p.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.when((F.col("q") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p"))
        while True:
            p = materialize(p, "pointers")
            far = materialize(p.join(p.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", "p", "q"), "pointers")
            if far.where("p != q").isEmpty():
                break
            p = far.select("a", F.col("q").alias("p"))
        nodes = materialize(nodes.join(p.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "nodes")
        e = e.join(p.select("a", F.col("p").alias("pa")), "a").join(p.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").where("pa != pb")
        e = e.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("x")).select("a", "b", "x.w", "x.u", "x.v")
        e = materialize(e, "edges")
    return (e.select("u", "v", "w") if tree is None else tree), nodes


def _merge(least: int, nth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One root's edges of one range of weights, in order: what becomes of the nodes at their ends."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["w", "u", "v"])
        root, out, seq = rows["root"].iloc[0], [], 0
        parent: dict = {}
        size: dict = {}
        cluster: dict = {}
        waiting: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def fall(x, into: str, density: float) -> None:
            for node in waiting[x]:
                out.append((1, node, None, None, into, None, density))
            waiting[x] = []

        for side, n, c in (("a", "sa", "ca"), ("b", "sb", "cb")):
            for x, s, k in zip(rows[side], rows[n], rows[c], strict=True):
                parent[x], size[x], cluster[x] = x, s, k if isinstance(k, str) else None
                waiting[x] = [] if cluster[x] else [x]
        nodes = list(parent)
        for w, a, b in zip(rows["w"], rows["a"], rows["b"], strict=True):
            a, b, density = find(a), find(b), 1 / w if w > 1 / _TOP else _TOP
            if size[a] < size[b]:
                a, b = b, a
            total = size[a] + size[b]
            if cluster[a] and cluster[b]:
                name, seq = f"{root}:{nth}:{seq}", seq + 1
                for x in (a, b):
                    out.append((2, None, None, int(size[x]), cluster[x], name, density))
                cluster[a] = name
            elif cluster[a]:
                fall(b, cluster[a], density)
            elif total >= least:
                cluster[a], seq = f"{root}:{nth}:{seq}", seq + 1
                fall(a, cluster[a], density)
                fall(b, cluster[a], density)
            else:
                waiting[a] += waiting[b]
            parent[b], size[a] = a, total
        for x in nodes:
            r = find(x)
            out.append((0, x, r, int(size[r]), cluster[r], None, None))
        frame = pd.DataFrame(out, columns=["kind", "node", "other", "size", "cluster", "parent", "density"])
        return frame.astype({"node": object, "other": object, "size": object})

    return run


def condensed_tree(tree: DataFrame, nodes: DataFrame, least: int, most_edges: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(clusters, points) of a spanning forest (u, v, w) with (node, root): its components by falling density.

    clusters has (root, cluster, parent, birth, size); a cluster is a component of `least` points or more,
    and is another one's child if it joins a second such component; birth is the density, 1 / w, at which
    it does, 0 for a root's last one. points has (node, root, cluster, density): where each point leaves a
    cluster as density rises; nulls for points of roots below `least`.

    Edges go by ranges of weight with some most_edges each: in a range, a root's edges are merged in one
    task between the components that the ranges before have left, so that memory is bounded. Ranges
    follow each other, so that time grows with the points of the largest root.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    tree = materialize(tree, "tree")
    n = tree.count()
    bins = max(1, -(-n // most_edges))
    cuts = sorted(set(tree.approxQuantile("w", [k / bins for k in range(1, bins)], 0.1 / bins))) if bins > 1 else []
    points = materialize(nodes.select("node", "root", F.col("node").alias("at"), F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("string").alias("now"), F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("double").alias("density")), "points")
    links = None
    for nth, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        some = tree.where((F.lit(True) if low is None else F.col("w") > low) & (F.lit(True) if high is None else F.col("w") <= high))
        ends = lambda side, u: points.select(F.col("node").alias(u), *([F.col("root")] if u == "u" else []), F.col("at").alias(side), F.col("size").alias(f"s{side}"), F.col("now").alias(f"c{side}"))
        some = some.join(ends("a", "u"), "u").join(ends("b", "v"), "v")
        out = some.groupBy("root").applyInPandas(_merge(least, nth), f"kind int, node {kind}, other {kind}, size bigint, cluster string, parent string, density double")
        out = materialize(out, "merged")
        moved = out.where("kind = 0").select(F.col("node").alias("at"), F.col("other").alias("to"), F.col("size").alias("grown"), F.col("cluster").alias("is"))
        fell = out.where("kind = 1").select(F.col("node").alias("at"), F.col("cluster").alias("left"), F.col("density").alias("when"))
        link = out.where("kind = 2").select(F.split("cluster", ":")[0].alias("root"), "cluster", "parent", F.col("density").alias("birth"), "size")
        links = link if links is None else links.unionByName(link)
        points = points.join(moved, "at", "left").join(fell, "at", "left")
        points = points.select("node", "root", F.coalesce("to", "at").alias("at"), F.coalesce("grown", "size").alias("size"), F.coalesce("is", "now").alias("now"), F.coalesce("cluster", "left").alias("cluster"), F.coalesce("density", "when").alias("density"))
        points = materialize(points, "points")
    tops = points.where("now is not null").select(F.col("root").cast("string").alias("root"), F.col("now").alias("cluster"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("birth"), "size").distinct()
    return materialize(links.unionByName(tops), "clusters"), points.select("node", "root", "cluster", "density")


def _choose(method: str, single: bool, roots: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of one root's clusters: the chosen one that each belongs to."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # children come before parents
        order = rows["cluster"].str.split(":").map(lambda x: (int(x[-2]), int(x[-1])))
        rows = rows.iloc[np.argsort([a << 40 | b for a, b in order], kind="stable")]
        parent = dict(zip(rows["cluster"], rows["parent"], strict=True))
        own = dict(zip(rows["cluster"], rows["stability"], strict=True))
        inner: dict[str, float] = {}
        chosen = {}
        for c in rows["cluster"]:
            top = not isinstance(parent[c], str)
            if method == "leaf":
                chosen[c] = c not in inner
            else:
                chosen[c] = own[c] >= inner.get(c, 0.0)
            if top and roots == 1 and not single:
                chosen[c] = False
            best = own[c] if chosen[c] else inner.get(c, 0.0)
            if not top:
                inner[parent[c]] = inner.get(parent[c], 0.0) + best
        of: dict[str, str | None] = {}
        for c in rows["cluster"][::-1]:
            above = of.get(parent[c]) if isinstance(parent[c], str) else None
            of[c] = above or (c if chosen[c] else None)
        return pd.DataFrame({"cluster": list(of), "chosen": list(of.values())})

    return run


def hdbscan(graph: DataFrame, least: int = 5, min_samples: int | None = None, *, method: str = "eom", single: bool = False, most_edges: int = 1 << 20) -> DataFrame:
    """(id, label, probability) of every point of a neighbour graph (src, dst, distance, rank), after Campello et al. (2013).

    label is -1 for noise and else counts clusters from 0 by their least ids; probability is a point's
    density over the highest in its cluster, 1 at most. Clusters have `least` points or more; method
    `eom` chooses them by excess of mass, `leaf` takes those without children. A root is no cluster
    unless `single` is set or the graph falls into several parts: what no link joins is never one cluster.

    The graph should hold min_samples (`least`, if not given) neighbours of each point. A point without
    any link is noise and not returned: it has no row in a graph. Equal weights are taken by their ends,
    so that reruns agree. An empty graph gives no rows. A root's clusters, not its points, meet in one task.
    """
    kind = graph.schema["src"].dataType.simpleString()
    tree, nodes = spanning_forest(mutual_reachability(graph, min_samples or least))
    clusters, points = condensed_tree(tree, nodes, least, most_edges)
    points = materialize(points, "points")
    births = clusters.select("cluster", "birth")
    mass = points.where("cluster is not null").select("cluster", "density", F.lit(1).cast("bigint").alias("n")).unionByName(clusters.where("parent is not null").select(F.col("parent").alias("cluster"), F.col("birth").alias("density"), F.col("size").alias("n")))
    mass = mass.join(births, "cluster").groupBy("cluster").agg(F.sum((F.col("density") - F.col("birth")) * F.col("n")).alias("stability"), F.max("density").alias("peak"))
    roots = clusters.where("parent is null").count()
    chosen = clusters.join(mass, "cluster").groupBy("root").applyInPandas(_choose(method, single, roots), "cluster string, chosen string")
    chosen = materialize(chosen, "chosen").join(mass.select(F.col("cluster").alias("chosen"), "peak"), "chosen", "left")
    found = points.join(chosen, "cluster", "left").select(F.col("node").alias("id"), "chosen", F.when(F.col("chosen").isNotNull(), F.least(F.lit(1.0), F.col("density") / F.col("peak"))).otherwise(0.0).alias("probability"))
    found = materialize(found, "found")
    labels = ranked(found.where("chosen is not null").groupBy("chosen").agg(F.min("id").alias("first")), F.col("first"), rank="label")
    return found.join(labels.select("chosen", (F.col("label") - 1).cast("int").alias("label")), "chosen", "left").select(F.col("id").cast(kind).alias("id"), F.coalesce("label", F.lit(-1)).alias("label"), "probability")


def cluster_vectors(vecs: DataFrame, least: int = 5, min_samples: int | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "euclidean", neighbours: int = 15, **how) -> DataFrame:
    """(id_col, label, probability) of every vector: hdbscan() over its nearest neighbours; a vector that takes no part in these is noise."""
    spark = vecs.sparkSession
    k = max(neighbours, min_samples or least)

    def run() -> DataFrame:
        graph = nearest_graph(vecs, k, id_col=id_col, vector_col=vector_col, metric=metric)
        found = hdbscan(graph, least, min_samples, **how)
        return vecs.select(F.col(id_col).alias("id")).join(found, "id", "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"))

    return settled(run, spark, "hdbscan")
