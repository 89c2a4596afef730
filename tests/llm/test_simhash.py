import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import words
from textloom.llm.simhash import drop_near_duplicates, fingerprint_of, link_fingerprints, near_duplicates, tile_links


def plain(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBÉß \n\t\x0b\x85 z"), max_size=60))
def test_fingerprint(text):
    assert fingerprint_of(text.encode()) == plain(text)


def components(fps):
    comp = {f: f for f in fps}
    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_connect_what_distances_do(spark, tile):
    """Random fingerprints, each with close ones around, in small tiles and in large."""
    rng = np.random.default_rng(2)
    fps = set()
    for base in rng.integers(0, 2**64, 60, dtype=np.uint64).tolist():
        fps.add(base)
        for _ in range(int(rng.integers(0, 9))):
            x = base
            for bit in rng.integers(0, 64, int(rng.integers(1, 6))).tolist():
                x ^= 1 << bit
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = link_fingerprints(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), 3, tile).collect()
    assert all(bin((e.src ^ e.dst) & (2**64 - 1)).count("1") <= 3 for e in edges)
    want, comp = components(fps), {f: f for f in fps}
    for e in edges:
        a, b = comp[e.src & (2**64 - 1)], comp[e.dst & (2**64 - 1)]
        comp = {k: min(a, b) if v in (a, b) else v for k, v in comp.items()}
    part = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert part(comp) == part(want)


def test_forest_of_a_dense_tile():
    a = np.array([1 << k for k in range(60)], np.uint64)
    assert len(tile_links(a, a, 3)) == 59


def test_awkward_rows(docs):
    rows = docs.collect()
    got = near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), f"{plain(r.text):016x}") for r in rows)
    comp = components({plain(r.text) for r in rows})
    least = {}
    for r in rows:
        if r.doc_id is not None:
            c = comp[plain(r.text)]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(comp[int(r.fingerprint, 16)]) for r in got)
    kept = drop_near_duplicates(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(comp[plain(r.text)] for r in kept.collect()) == sorted(set(comp.values()))


def test_empty(nothing):
    assert near_duplicates(nothing).collect() == [] and drop_near_duplicates(nothing).collect() == []
