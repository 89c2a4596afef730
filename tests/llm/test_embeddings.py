import numpy as np
import pytest

from textloom.llm.embeddings import MultiIndex, codewords, fit, k_means, near_duplicates, unit

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, v int"


def brute(rows):
    """{row number: (links, component)} by comparing all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = unit(np.array([np.array(rows[i][1], np.float32) for i in ok])) if ok else np.zeros((0, 1))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = list(range(len(rows)))
    for a, b in zip(*np.nonzero(near), strict=True):
        x, y = comp[ok[a]], comp[ok[b]]
        comp = [min(x, y) if c in (x, y) else c for c in comp] if x != y else comp
    links = dict(zip(ok, near.sum(1).tolist(), strict=True))
    least = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return [(rows[i][0], links.get(i, 0), least.get(comp[i])) for i in range(len(rows))]


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (v * 3 + rng.normal(size=8) * 0.02).tolist()) for i, v in enumerate(base[:10])]
    rows += [(5, base[5].tolist()), (5, base[5].tolist()), (None, base[6].tolist()), (None, None), (70, None), (71, [0.0] * 8), (72, [float("nan")] * 8), (73, [float("inf")] + [1.0] * 7), (74, [None] + [1.0] * 7), (75, []), (76, (base[7] * 1e30).tolist()), (77, (base[7] * 1e-30).tolist())]
    df = spark.createDataFrame([(i, v, 1, "k", 2) for i, v in rows], SCHEMA).repartition(5)
    got = near_duplicates(df, recall=1.0).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, brute(rows)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("n", [1, 2])
def test_few(spark, n):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(n)], "vec_id int, embedding array<double>")
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(i, n - 1, 0, i == 0) for i in range(n)]


def test_recall_against_brute_force(spark):
    """Vectors in loose groups around the threshold: nine in ten links found, none below it."""
    rng = np.random.default_rng(9)
    centre = unit(rng.normal(size=(500, 32)))
    x = np.repeat(centre, 6, 0)
    x = unit(x + 0.055 * rng.normal(size=x.shape)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    u = unit(x)
    true = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= true).all() and links.sum() >= 0.9 * true.sum()
    assert true.sum() > 5000


def test_one_large_group(spark):
    rng = np.random.default_rng(4)
    x = unit(np.ones((3000, 16)) + 0.01 * rng.normal(size=(3000, 16)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = near_duplicates(df).collect()
    assert all(r.component_id == 0 for r in got) and np.mean([r.n_links for r in got]) >= 0.9 * 2999


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(400, 10)))
    index = fit(x, 10240, 0.9, 0.95)
    a, b = index.halves(x[:20])
    for t in (1, 3, 7, 36):
        seen = index.traverse(x[:20], t)
        for r in range(20):
            far = (a[r][:, None] + b[r][None, :]).ravel()
            assert np.allclose(np.sort(far)[:t], far[seen[r]])


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranks_are_places_in_the_traversal():
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(900, 12)))
    index = MultiIndex(k_means(x[:, :6], 11), k_means(x[:, 6:], 11))
    cells = index.cells(x[200:400])
    want = (index.traverse(x[:200], 121) == cells[:, None]).argmax(1)
    got = index.ranks(x[:200], cells)
    assert (got >= want).all() and (got - want).max() <= 1 and (got == want).mean() > 0.9


def test_codebooks_grow_with_the_input():
    assert [codewords(n) for n in (1, 256 * 100, 256 * 10**6, 10**12)] == [1, 10, 1000, 4096]
