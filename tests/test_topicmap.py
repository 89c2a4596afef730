"""Distances, coordinates and diverse words of topics against numpy."""

import numpy as np

from textloom.operators.topicmap import coordinates, diverse_words, term_profiles, topic_coordinates, topic_distances
from textloom.operators.topics import hierarchy, intertopic_map


def test_distances_and_coordinates(spark):
    rng = np.random.default_rng(2)
    rows = [(int(t), f"w{int(w)}") for t in range(5) for w in rng.integers(3 * t, 3 * t + 9, 60)] + [(9, "alone")] * 4
    df = spark.createDataFrame(rows, "topic int, term string").repartition(4)
    topics, words = sorted({t for t, _ in rows}), sorted({w for _, w in rows})
    p = np.array([[rows.count((t, w)) for w in words] for t in topics], float)
    p /= p.sum(1, keepdims=True)

    def js(a, b):
        m = (a + b) / 2
        k = lambda x: (x[x > 0] * np.log(x[x > 0] / m[x > 0])).sum()
        return (k(a) + k(b)) / 2

    d = np.array([[js(a, b) for b in p] for a in p])
    got = {(r.topic1, r.topic2): r.distance for r in topic_distances(df).collect()}
    assert len(got) == 15 and all(abs(got[t, u] - d[i, j]) < 2e-6 for i, t in enumerate(topics) for j, u in enumerate(topics) if t < u)
    out = {r.topic: r for r in topic_coordinates(df).collect()}
    xy = coordinates(d)
    assert all(np.allclose((out[t].x, out[t].y), xy[k], atol=1e-4) for k, t in enumerate(topics)) and abs(sum(r.share for r in out.values()) - 100) < 0.01
    flat = rng.normal(size=(8, 2))
    far = np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(2))
    back = coordinates(far)
    assert np.allclose(np.sqrt(((back[:, None] - back[None]) ** 2).sum(2)), far)
    assert topic_distances(df.limit(0)).collect() == [] and topic_coordinates(df.limit(0)).collect() == []


def test_diverse_words(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k:02}" for k in range(40)]
    vec = {w: rng.normal(size=5) for w in words[:-1]}
    weight = {(t, w): float(rng.integers(1, 9)) for t in range(3) for w in words if rng.random() < 0.8}
    got = diverse_words(spark.createDataFrame([(t, w, x) for (t, w), x in weight.items()], "topic int, term string, score double"), spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "term string, v array<double>"), 6, diversity=0.4, pool=12).collect()
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else 0.0
    for t in range(3):
        pool = sorted((w for u, w in weight if u == t), key=lambda w: (-weight[t, w], w))[:12]
        v = {w: vec.get(w, np.zeros(5)) for w in pool}
        topic = sum(weight[t, w] * v[w] for w in pool)
        taken = []
        while len(taken) < 6:
            value = lambda w: 0.6 * cos(v[w], topic) - 0.4 * max(cos(v[w], v[x]) for x in taken) if taken else cos(v[w], topic)
            taken.append(max((w for w in pool if w not in taken), key=lambda w: (round(value(w), 12), -pool.index(w))))
        assert [r.term for r in sorted(got, key=lambda r: r.rank) if r.topic == t] == taken


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (3, "a", 4.0), (2, "b", 1.0)], "topic int, term string, score double")
    assert {r.term: r.v for r in term_profiles(df).collect()} == {"a": [2.0, 0.0, 4.0], "b": [0.0, 1.0, 0.0]}


def test_map_and_hierarchy_use_all_terms(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k:03}" for k in range(120)]
    x = rng.integers(0, 9, (6, 120)).astype(float)
    x[:, 60:] += np.repeat([[0.0], [7.0]], 3, 0)
    df = spark.createDataFrame([(t, w, float(x[t, k])) for t in range(6) for k, w in enumerate(words) if x[t, k]], "topic int, term string, score double").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u - u.mean(0)
    left, s, _ = np.linalg.svd(c, full_matrices=False)
    p = (left * s)[:, :2]
    nodes = {r.topic: r for r in intertopic_map(df, spark.createDataFrame([(t, 10 * t) for t in range(6)], "topic int, count bigint"))[0].collect()}
    got = np.array([[nodes[t].x, nodes[t].y] for t in range(6)])
    assert np.allclose(np.abs(got), np.abs(p / np.abs(p).max() * 5), atol=1e-6) and [round(nodes[t].size) for t in (0, 5)] == [20, 70]
    d, groups, want = 1 - u @ u.T, {i: [i] for i in range(6)}, []
    while len(groups) > 1:
        far, a, b = min((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in groups for b in groups if a < b)
        k = 6 + len(want)
        groups[k] = groups.pop(a) + groups.pop(b)
        heavy = sorted(range(120), key=lambda j: (-round(x[groups[k]].sum(0)[j], 9), j))[:5]
        want.append((len(want), a, b, round(float(far), 4), len(groups[k]), " ".join(words[j] for j in heavy)))
    assert sorted(map(tuple, hierarchy(df).collect())) == want
    assert hierarchy(df.limit(0)).collect() == []
