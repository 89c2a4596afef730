"""Span joins against every pair, in texts with nested, crossing, empty and very long spans."""

import random

import pytest

from textloom.operators.frameworks import conflicts, merge_annotations, merge_distinct
from textloom.operators.intervals import first_holder, holders, overlapping


def some(seed, n=150, longest=60):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = rng.randint(0, 900)
        out.append((rng.choice(["x", "y", None]), a, a + rng.choice([0, 1, rng.randint(0, longest), 900]), "AB"[k % 2]))
    return out + [("x", None, 3, "A"), ("y", 4, None, "B")]


def pairs(a, b, test):
    return sorted((x, y) for x in a for y in b if x[0] is not None and x[0] == y[0] and None not in (x[1], x[2], y[1], y[2]) and test(x[1], x[2], y[1], y[2]))


@pytest.mark.parametrize("width", [7, 64, 5000])
def test_span_joins(spark, width):
    a, b = some(1), some(2)
    da = spark.createDataFrame(a, "doc_id string, start int, end int, label string").repartition(3)
    db = spark.createDataFrame(b, "doc_id string, other_start int, other_end int, other string").repartition(3)
    got = sorted(((r.doc_id, r.start, r.end, r.label), (r.doc_id, r.other_start, r.other_end, r.other)) for r in overlapping(da, db, width).collect())
    assert got == pairs(a, b, lambda s, e, p, q: s < q and p < e) and len(got) > 500
    spans = [(d, k + 1, s, e) for k, (d, s, e, _) in enumerate(b)]
    ds = spark.createDataFrame(spans, "doc_id string, nth int, start int, end int").repartition(3)
    hold = [[k for d, k, s, e in spans if d is not None and d == x[0] and None not in (x[1], s, e) and s <= x[1] < e] for x in a]
    got = sorted((str(tuple(r)[:4]), r.nth) for r in first_holder(da.select("doc_id", "start", "end", "label"), ds, width=width).collect())
    assert got == sorted((str(x), min(h, default=0)) for x, h in zip(a, hold, strict=True))
    got = sorted((str((r.doc_id, r.start, r.end, r.label)), r.nth) for r in holders(da, ds, width=width).collect())
    assert got == sorted((str(x), k) for x in a for d, k, s, e in spans if d is not None and d == x[0] and None not in (*x[1:3], s, e) and s <= x[1] and x[2] <= e)
    assert overlapping(da.limit(0), db).collect() == [] and holders(da.limit(0), ds).collect() == [] and first_holder(da.limit(0), ds).collect() == []


def test_annotations(spark):
    a, b = [x for x in some(3) if None not in x], [x for x in some(4) if None not in x]
    b += a[:20] + [(d, s, e, "C") for d, s, e, _ in a[:5]]
    da, db = (spark.createDataFrame(x, "doc_id string, start int, end int, label string") for x in (a, b))
    free = [y for y in b if not any(x[0] == y[0] and y[1] < x[2] and x[1] < y[2] for x in a)]
    assert sorted(map(tuple, merge_annotations(da, db).collect())) == sorted(a + free)
    assert sorted(map(tuple, merge_distinct(da, db).collect())) == sorted(a + [y for y in b if y not in a])
    cross = lambda x, y: x[0] == y[0] and (x[1] < y[1] < x[2] < y[2] or y[1] < x[1] < y[2] < x[2])
    got = sorted(map(tuple, conflicts(da, db).collect()))
    assert got == sorted(y for y in b if any(cross(x, y) for x in a)) and got
    plan = conflicts(da, db)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
