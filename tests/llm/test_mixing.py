import heapq
from collections import defaultdict

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import words
from textloom.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 120))
def test_seats_by_highest_quotients(entries, seats):
    votes, caps = (np.array(x) for x in zip(*entries, strict=True))
    heap = [(-v, i, 0) for i, (v, c) in enumerate(entries) if v and c]
    heapq.heapify(heap)
    want = [0] * len(entries)
    for _ in range(seats):
        if not heap:
            break
        _, i, k = heapq.heappop(heap)
        want[i] += 1
        if k + 1 < caps[i]:
            heapq.heappush(heap, (-(votes[i] / (2 * k + 3)), i, k + 1))
    assert mixing.sainte_lague(votes, caps, seats).tolist() == want


def targets(sizes):
    """Share and cap again and again until no target is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        even = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if even[s] > 2 * sizes[s]}
        if not over:
            return out | even
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(df, near=0.03, **how):
    got = mixing.mix(df, **how).collect()
    rows = df.select("doc_id", "text", "source").collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r.doc_id), len(words(r.text))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = targets(sizes)
    by_size = defaultdict(int)
    seen = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by_size[r.source_size, round(r.target, 3)] += r.taken
        seen[r.source_size] = r.target
    assert sorted({(s, round(want[k], 6)) for k, s in sizes.items()}) == sorted({(r.source_size, round(r.target, 6)) for r in got})
    for (size, target), taken in by_size.items():
        n = sum(1 for k in sizes if (sizes[k], round(want[k], 3)) == (size, target))
        assert abs(taken - n * target) <= max(2 * n, near * n * target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(6), **how).collect()))
    mixed = mixing.mixed_documents(df, **how).collect()
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in got)
    texts = {" ".join(words(r.text)) for r in rows}
    assert all(any(t.startswith(" ".join(words(r.text))) for t in texts) for r in mixed[:50])


def test_awkward_rows(docs):
    check(docs)


def test_table_and_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    df = spark.read.parquet(path)
    check(df)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(con.sql(mixing.SQL).fetchall()) == sorted(map(tuple, mixing.mix(df).collect()))


def test_many_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(df, near=0.05, shard_words=2000)


def test_empty(nothing):
    assert mixing.mix(nothing).collect() == [] and mixing.mixed_documents(nothing).collect() == []
