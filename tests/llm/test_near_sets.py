"""The pipeline's near-dedup: every pair of five-word shingle sets at similarity 0.8 or more is linked."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.conftest import words
from textloom.llm.simhash import _majorities, near_sets


def shingles(text):
    w = words(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    comp = {i: i for i, _ in rows}
    s = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((comp[i], comp[j]))
                comp = {d: x if c == y else c for d, c in comp.items()}
    return sorted(set(comp.values()))


def test_copies_from_0_8_on(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 120, 300)))]
        for edits in (0, 0, 1, 2, 3, 4, 6, 9, 14):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), "a few words"), (len(rows) + 1, "A few  words"), (len(rows) + 2, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = kept(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df.repartition(5), DATA).collect()) == want
    assert len(want) < len(rows) - 24


@pytest.mark.parametrize("tile", [3, 4096])
def test_tiles_lose_no_link(spark, tile):
    """Copies of every degree, in small tiles and in large, against all pairs; long texts, short ones and ties."""
    rng = random.Random(8)
    rows = []
    for size in (5, 6, 9, 14, 40, 200, 3000):
        for _ in range(3):
            base = [f"w{rng.randrange(900)}" for _ in range(size)]
            for edits in (0, 1, 1, 2, 3, 7):
                w = list(base)
                for _ in range(edits):
                    k = rng.randrange(len(w))
                    w[k : k + 1] = rng.choice(([], [f"x{rng.randrange(10**6)}"], [w[k], "more"]))
                rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([(f"{i:04}", t) for i, t in rows], "key string, text string").repartition(7)
    least = {}
    for r in near_sets(df, tile=tile).collect():
        least.setdefault(r.component, []).append(int(r.key))
    assert sorted(map(min, least.values())) == kept(rows)


def test_fingerprints_of_halves():
    """The bits that over half of a set's hashes have, whatever the blocks."""
    rng = np.random.default_rng(4)
    size = np.array([1, 2, 5, 300000, 3, 70000, 1])
    x = rng.integers(0, 2**64, size.sum(), dtype=np.uint64)
    start = np.append(0, np.cumsum(size)[:-1])
    got = _majorities(x, start, size)
    for a, n, g in zip(start, size, got.tolist(), strict=True):
        assert g == sum(1 << b for b in range(64) if 2 * int((x[a : a + n] >> np.uint64(b) & np.uint64(1)).sum()) > n)
