"""Neighbour descent, spanning forests and density clusters against plain numpy."""

import numpy as np
import pytest

from textloom.operators.density import cluster_vectors, hdbscan, spanning_forest
from textloom.operators.neighbours import nearest_graph

TOP = 1e12


def distances(x):
    d = np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(2)))
    np.fill_diagonal(d, np.inf)
    return d


def blobs(seed, n=40, noise=20, d=3, centres=4):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-20, 20, (centres, d))
    return np.concatenate([*(m + rng.normal(size=(n + 7 * k, d)) * (0.5 + k) for k, m in enumerate(c)), rng.uniform(-25, 25, (noise, d))])


def complete(spark, x):
    d = distances(x)
    rows = [(i, int(j), float(d[i, j]), r + 1) for i in range(len(x)) for r, j in enumerate(np.argsort(d[i], kind="stable")[:-1])]
    return spark.createDataFrame(rows, "src bigint, dst bigint, distance double, rank int").repartition(5)


def plain_tree(w):
    """Kruskal over all pairs, by weight and then by both ends."""
    n = len(w)
    edges = sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    of, tree = list(range(n)), []
    for e, i, j in edges:
        a, b = of[i], of[j]
        if a != b:
            tree.append((e, i, j))
            of = [a if c == b else c for c in of]
    return tree


def plain_hdbscan(x, least, samples, method="eom", single=False):
    """From the top: take the heaviest edge away, again and again."""
    d = distances(x)
    core = np.sort(d, 1)[:, samples - 1]
    tree = plain_tree(np.maximum(d, np.maximum(core[:, None], core[None])))
    density = lambda w: 1 / w if w > 1 / TOP else TOP
    clusters, leaves = [], {}

    def parts(nodes, edges):
        by = {v: [] for v in nodes}
        for _, i, j in edges:
            by[i].append(j)
            by[j].append(i)
        seen, out = set(), []
        for v in nodes:
            if v not in seen:
                todo, mine = [v], set()
                while todo:
                    y = todo.pop()
                    if y not in mine:
                        mine.add(y)
                        todo += by[y]
                seen |= mine
                out.append((mine, [e for e in edges if e[1] in mine]))
        return out

    def grow(nodes, edges, birth, parent):
        me = len(clusters)
        clusters.append({"parent": parent, "birth": birth, "mass": 0.0, "peak": 0.0, "children": []})
        c = clusters[me]
        while edges:
            heavy, edges = edges[-1], edges[:-1]
            lam = density(heavy[0])
            c["peak"] = max(c["peak"], lam)
            (a, ea), (b, eb) = parts(nodes, edges)
            if len(a) >= least and len(b) >= least:
                c["mass"] += (lam - birth) * len(nodes)
                for p, e in ((a, ea), (b, eb)):
                    c["children"].append(grow(p, e, lam, me))
                return me
            for p in (a, b):
                if len(p) < least:
                    c["mass"] += (lam - birth) * len(p)
                    leaves.update({v: (me, lam) for v in p})
            rest = [(p, e) for p, e in ((a, ea), (b, eb)) if len(p) >= least]
            if not rest:
                return me
            nodes, edges = rest[0]
        return me

    if len(x) >= least:
        grow(set(range(len(x))), tree, 0.0, None)
    chosen = {}
    for k in range(len(clusters) - 1, -1, -1):
        c = clusters[k]
        inner = sum(clusters[j]["best"] for j in c["children"])
        chosen[k] = (not c["children"]) if method == "leaf" else c["mass"] >= inner
        if c["parent"] is None and not single:
            chosen[k] = False
        c["best"] = c["mass"] if chosen[k] else inner
    label, prob = np.full(len(x), -1), np.zeros(len(x))
    for v, (k, lam) in leaves.items():
        top = None
        while k is not None:
            top = k if chosen[k] else top
            k = clusters[k]["parent"]
        if top is not None:
            label[v], prob[v] = top, min(1.0, lam / clusters[top]["peak"])
    first = sorted({int(c): int(np.flatnonzero(label == c)[0]) for c in set(label) - {-1}}.items(), key=lambda t: t[1])
    names = {c: k for k, (c, _) in enumerate(first)} | {-1: -1}
    return [names[int(c)] for c in label], prob


@pytest.mark.parametrize("seed, least, samples, method, edges", [(1, 5, 5, "eom", 1 << 20), (2, 8, 3, "eom", 40), (3, 5, 5, "leaf", 25)])
def test_equals_brute_force(spark, seed, least, samples, method, edges):
    x = blobs(seed)
    got = {r.id: r for r in hdbscan(complete(spark, x), least, samples, method=method, most_edges=edges).collect()}
    label, prob = plain_hdbscan(x, least, samples, method)
    assert [got[k].label for k in range(len(x))] == label and len(set(label)) >= 4
    assert np.allclose([got[k].probability for k in range(len(x))], prob)


def test_forest_is_kruskals(spark):
    rng = np.random.default_rng(8)
    w = {(i, j): float(rng.integers(1, 30)) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.12 and (i < 30) == (j < 30)}
    df = spark.createDataFrame([(i, j, x) for (i, j), x in w.items()], "u bigint, v bigint, w double").repartition(4)
    tree, nodes = spanning_forest(df)
    of, want = {v: v for e in w for v in e}, set()
    for (i, j), x in sorted(w.items(), key=lambda t: (t[1], t[0])):
        if of[i] != of[j]:
            want.add((i, j, x))
            a, b = of[i], of[j]
            of = {v: a if c == b else c for v, c in of.items()}
    assert {(r.u, r.v, r.w) for r in tree.collect()} == want
    roots = {r.node: r.root for r in nodes.collect()}
    assert len(set(roots.values())) == len(set(of.values())) and all((roots[a] == roots[b]) == (of[a] == of[b]) for a in of for b in of)
    empty, none = spanning_forest(df.limit(0))
    assert empty.collect() == [] and none.collect() == []


def test_graph_and_clusters_of_vectors(spark):
    x = blobs(5, n=60, noise=10, d=8)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0]), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    graph = nearest_graph(df, 10).collect()
    d = distances(x)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i])[:10]}
    got = {(r.src, r.dst) for r in graph}
    assert len(got) == 10 * len(x) and len(got & want) >= 0.95 * len(want)
    assert all(abs(r.distance - d[r.src, r.dst]) < 1e-4 for r in graph)
    found = cluster_vectors(df, 10)
    assert found.count() == len(rows)
    label = {r.vec_id: r.label for r in found.collect()}
    assert label[900] == label[901] == label[902] == label[None] == -1
    truth, _ = plain_hdbscan(x, 10, 10)
    same = [(label[i] == label[j]) == (truth[i] == truth[j]) for i in range(len(x)) for j in range(i)]
    assert np.mean(same) >= 0.95
    assert cluster_vectors(df.limit(0)).collect() == [] and nearest_graph(df.limit(0)).collect() == []


def test_recall_on_all_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    ids = [r.vec_id for r in rows]
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:15]}
    got = nearest_graph(df, 15, metric="cosine").collect()
    assert len(want & {(r.src, r.dst) for r in got}) >= 0.9 * len(want)
    again = nearest_graph(df.repartition(3), 15, metric="cosine").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
