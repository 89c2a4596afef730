"""Clustering features: sums, radii, Ward's linkage against plain merging, and labels."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators.birch import FeatureTree, birch, features, reduce, ward


def cloud(seed, n=60, d=4, centres=3):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-30, 30, (centres, d))
    return np.concatenate([m + rng.normal(size=(n, d)) for m in c]), np.repeat(np.arange(centres), n)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.sampled_from([0.0, 0.3, 1.0, 5.0]), st.sampled_from([2, 5, 50]))
def test_sums_and_radii(seed, n, threshold, branching):
    x = np.random.default_rng(seed).normal(size=(n, 3)).round(1)
    tree = reduce(FeatureTree(3, threshold, branching), np.ones(n), x, (x * x).sum(1), most=40)
    m, s, q = tree.entries()
    assert m.sum() == n and np.allclose(s.sum(0), x.sum(0)) and np.isclose(q.sum(), (x * x).sum()) and len(m) == tree.leaves <= 40
    assert (q / m - ((s / m[:, None]) ** 2).sum(1) <= tree.threshold**2 + 1e-9).all() and tree.threshold >= threshold


def plain_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 25), st.integers(1, 6))
def test_ward(seed, n, k):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    label = ward(x, k)
    assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label)} == plain_ward(x, k)


def test_dealing_out_changes_no_totals(spark):
    x, truth = cloud(4)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id bigint, v array<double>")
    for parts in (1, 3, 40):
        found = features(df.repartition(parts), threshold=1.5).collect()
        n, s, q = np.array([r.n for r in found]), np.array([r.ls for r in found]), np.array([r.ss for r in found])
        assert n.sum() == len(x) and np.allclose(s.sum(0), x.sum(0)) and np.isclose(q.sum(), (x * x).sum()) and len({r.part for r in found}) == 1
        assert (q / n - ((s / n[:, None]) ** 2).sum(1) <= max(r.threshold for r in found) ** 2 + 1e-9).all()


def test_labels(spark):
    x, truth = cloud(9)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(900, None), (901, [float("inf")] * 4), (None, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = {r.vec_id: r.label for r in birch(df, 3, threshold=2.0).collect()}
    assert len(got) == len(rows) and got[900] == got[901] == got[None] == -1
    assert all((got[i] == got[j]) == (truth[i] == truth[j]) for i in range(len(x)) for j in range(i))
    assert birch(df.limit(0)).collect() == []
