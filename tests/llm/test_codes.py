"""Product codes against plain Lloyd's method on integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import codes
from textloom.llm.codes import assign, build, compress, nearest, sums


def plain_nearest(x, entries):
    return ((x[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)


def plain(rows, parts=16, size=64, rounds=2):
    """rows: (id, label, vector)."""
    kept = [(i, lab, [math.floor(256 * float(c)) for c in v]) for i, lab, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:size]
    x = np.array([v for _, _, v in kept])
    books = []
    for p in range(parts):
        book, mine = np.array([v for _, _, v in first])[:, p * width : (p + 1) * width], x[:, p * width : (p + 1) * width]
        for _ in range(rounds):
            near, book = plain_nearest(mine, book), book.copy()
            for e in set(near):
                book[e] = mine[near == e].sum(0) // (near == e).sum()
        books.append(book)
    near = [plain_nearest(x[:, p * width : (p + 1) * width], b) for p, b in enumerate(books)]
    error = sum(((x[:, p * width : (p + 1) * width] - b[n]) ** 2).sum(1) for p, (b, n) in enumerate(zip(books, near, strict=True)))
    by = defaultdict(int)
    for (_, lab, _), e in zip(kept, error, strict=True):
        by[lab] += int(e)
    digest = hashlib.sha256(",".join(str(c) for b in books for row in b for c in row).encode()).hexdigest()
    return sorted(((i, "".join(f"{n[k]:02x}" for n in near), int(error[k]), by[lab], digest) for k, (i, lab, _) in enumerate(kept)), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 40), st.integers(1, 5), st.sampled_from([2, 4, 50, 5000]))
def test_filtering_is_exact(seed, n, k, width, spread):
    rng = np.random.default_rng(seed)
    x, entries = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (k, width))
    if spread == 50:
        x[: n // 2] = x[0]
    want = plain_nearest(x, entries)
    tree = build(x, leaf=4)
    assert (nearest(tree, entries) == want).all()
    count, total = sums(tree, entries)
    assert (count == np.bincount(want, minlength=k)).all()
    assert (total == np.array([x[want == e].sum(0) for e in range(k)])).all()


def test_subtrees_go_at_once():
    rng = np.random.default_rng(3)
    entries = rng.integers(-4000, 4000, (64, 4))
    x = entries[rng.integers(0, 64, 20_000)] + rng.integers(-40, 41, (20_000, 4))
    steps = [len(entry) for entry, *_ in assign(build(x), entries)]
    assert sum(steps) < 0.5 * len(x)
    assert (nearest(build(x), entries) == plain_nearest(x, entries)).all()


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(map(tuple, compress(df.repartition(7)).collect()), key=repr)
    assert got == plain([(r.vec_id, r.label, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("chunk", [8, 32_768])
def test_awkward_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(codes, "CHUNK", chunk)
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(int(i) if i else None, int(i % 3) or None, [float(np.float32(c)) for c in rng.normal(size=16)]) for i in rng.integers(0, 40, 60)]
    rows += [(1, 1, None), (2, None, [nan] * 16), (3, 1, [inf] + [0.0] * 15), (4, 2, [None] + [0.0] * 15), (5, 2, [0.0] * 16), (5, 2, [0.0] * 16), (-7, None, [-1e-9] * 16), (-9, 1, [2000.0] * 16)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id bigint, label int, embedding array<float>, x string, d int").repartition(3)
    want = plain([(i, lab, v if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, lab, v in rows], size=20)
    assert sorted(map(tuple, compress(df, size=20).collect()), key=repr) == want
    odd = spark.createDataFrame([(1, 1, [1.0] * 32), (2, 1, [1.0] * 16), (3, 1, [2.0] * 16), (4, 1, [1.0] * 7), (5, 1, []), (6, 1, [1e30] * 16)], "vec_id bigint, label int, embedding array<float>")
    assert sorted(r.vec_id for r in compress(odd).collect()) == [2, 3, 6]
    assert compress(df.limit(0)).collect() == [] and compress(df.where("embedding is null")).collect() == []
