"""Reliability over combinations of ratings: awkward spans against plain Python, and what is shuffled."""

import random
from itertools import combinations, permutations

import pytest

from textloom.operators import reliability as rel
from textloom.plans import agreement

DATA = "/root/testdata/sf0.001"


def test_measures_against_characters(spark):
    rng = random.Random(3)
    lengths = [(i, rng.randrange(1, 12)) for i in range(20)]
    spans = [(i, rng.choice("123"), a, a + rng.randrange(0, 5), rng.choice("AB")) for i, _ in lengths for a in (rng.randrange(0, 9),) for _ in range(6)]
    s = spark.createDataFrame(spans, "doc_id bigint, coder string, start int, end int, label string").repartition(3)
    r = rel.ratings(s, spark.createDataFrame(lengths, "doc_id bigint, n_chars int"), ["1", "2", "3"])
    rated = [tuple("".join(str(int(any(d == i and k == c and a <= p < e and x == y for d, k, a, e, y in spans))) for x in "AB") for c in "123") for i, n in lengths for p in range(n)]
    want = {(a + 1, b + 1): sum(x[a] == x[b] for x in rated) * 100 / len(rated) for a, b in combinations(range(3), 2)}
    assert {(int(x.coder1), int(x.coder2)): x.agreement for x in rel.percent_agreement(r).collect()} == pytest.approx(want, abs=1e-4)
    o = {}
    for x in rated:
        for a, b in permutations(x, 2):
            o[a, b] = o.get((a, b), 0) + 0.5
    assert {(x.c, x.k): x.o for x in rel.coincidences(r).collect()} == pytest.approx(o)
    p = sum((len([1 for a, b in permutations(x, 2) if a == b])) / 6 for x in rated) / len(rated)
    assert rel.fleiss_kappa(r).first().p == pytest.approx(p, abs=1e-4)


def test_gold_with_unknown_places(spark):
    rows = [(1, "1", 0, 2, "A"), (1, "2", 0, 2, "A"), (1, "2", 0, 2, "A"), (1, "3", 1, 2, "A"), (2, "1", 0, 1, None), (2, "2", 0, 1, None), (3, "1", 5, 6, "B")]
    got = rel.precision_recall(spark.createDataFrame(rows, "doc_id bigint, coder string, start int, end int, label string"), "1")
    assert sorted((r.coder, str(r.label), r.tp, r.fp, r.fn) for r in got.collect()) == [("2", "*", 1, 1, 2), ("2", "A", 1, 0, 0), ("2", "B", 0, 0, 1), ("2", "None", 0, 1, 1), ("3", "*", 0, 1, 3), ("3", "A", 0, 1, 1), ("3", "B", 0, 0, 1), ("3", "None", 0, 0, 1)]


def test_ratings_shuffle_texts_alone(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = rel.ratings(agreement.spans(spark, DATA), agreement.lengths(spark, DATA), agreement.CODERS)
        plan = rel.units(r)._jdf.queryExecution().executedPlan().toString()
        # the counts of combinations, and texts where they are dealt out: never tokens, spans or segments
        keys = [x.split("hashpartitioning(")[1].split("#")[0] for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert set(keys) == {"ratings", "doc_id"} and plan.count("REPARTITION_BY_NUM") == len(keys) - 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
