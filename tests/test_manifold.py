"""Fuzzy weights against plain numpy, and layouts that keep neighbours near."""

import numpy as np

from tests.test_density import blobs, distances
from textloom.operators.manifold import curve, embed, fuzzy_weights
from textloom.operators.neighbours import nearest_graph


def trustworthiness(x, y, k):
    d, e = distances(x), distances(y)
    n = len(x)
    rank = np.argsort(np.argsort(d, 1), 1)
    near = np.argsort(e, 1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, near, 1) + 1 - k).sum()


def test_curve():
    a, b = curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01


def test_fuzzy_weights(spark):
    x = blobs(3, n=20, noise=5)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    graph = nearest_graph(df, 8).collect()
    one = {}
    for i in range(len(x)):
        far = sorted(r.distance for r in graph if r.src == i)
        rho = min([d for d in far if d > 0], default=0.0)
        low, high = 1e-6, 1e6
        for _ in range(200):
            s = (low + high) / 2
            low, high = (low, s) if sum(np.exp(-max(0, d - rho) / s) for d in far) > np.log2(len(far) + 1) else (s, high)
        one |= {(i, r.dst): np.exp(-max(0, r.distance - rho) / s) for r in graph if r.src == i}
    want = {}
    for i, j in one:
        p, q = one[i, j], one.get((j, i), 0.0)
        want[min(i, j), max(i, j)] = p + q - p * q
    got = {(r.u, r.v): r.w for r in fuzzy_weights(spark.createDataFrame(graph)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_layout_keeps_neighbours(spark):
    x = blobs(5, n=40, noise=0, d=8)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(999, None)], "vec_id bigint, embedding array<double>").repartition(3)
    got = {r.vec_id: r.position for r in embed(df, metric="euclidean", epochs=25).collect()}
    assert len(got) == len(x) and all(len(p) == 2 and np.isfinite(p).all() for p in got.values())
    y = np.array([got[k] for k in range(len(x))])
    assert trustworthiness(x, y, 8) >= 0.93
    again = {r.vec_id: r.position for r in embed(df.repartition(5), metric="euclidean", epochs=25).collect()}
    assert max(np.abs(np.array(again[k]) - got[k]).max() for k in got) < 1e-3
    assert embed(df.limit(0)).collect() == []
