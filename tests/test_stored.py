"""n-grams over the stream of all texts, and the stored sketch index."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import freq, sketch
from textloom.operators.ranking import offsets
from textloom.operators.tokens import annotate

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("length", [3, 50, 1 << 16])
def test_ngrams_across_texts(spark, monkeypatch, length):
    rng = random.Random(length)
    stream = [(t, i, rng.choice("abcd"), rng.choice(["N", "V"])) for t in range(40) for i in range(rng.choice([0, 1, 2, 9]))]
    df = spark.createDataFrame(stream, "text_id int, tok_idx int, text string, pos string").repartition(6)
    plain = freq._stretches
    monkeypatch.setattr(freq, "_stretches", lambda t, most: plain(t, most, length))
    got = Counter((r.n, r.ngram) for r in freq.ngrams(df, (2, 4), cross_text=True).collect())
    words = [w for _, _, w, _ in stream]
    assert got == Counter((n, " ".join(words[k : k + n])) for n in (2, 4) for k in range(len(words) - n + 1))
    some = freq.ngrams(df, (2,), cross_text=True, pos=freq.PosFilter(("N",)))
    assert Counter(r.ngram for r in some.collect()) == Counter(a[2] + " " + b[2] for a, b in zip(stream, stream[1:], strict=False) if a[3] == b[3] == "N")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert freq.ngrams(df.limit(0), (2,), cross_text=True).collect() == []


def test_stored_sketches(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tokens, path = annotate(docs), f"file://{tmp_path}/sketches"
    sketch.store_index(tokens, path, buckets=16, marginals="corpus")
    direct = sketch.scores(sketch.relations(tokens), marginals="corpus").persist()
    lemmas = [r.word1_lemma for r in direct.groupBy("word1_lemma").count().orderBy(F.desc("count"), "word1_lemma").limit(3).collect()]
    for lemma in [*lemmas, "nosuchword"]:
        got = sketch.stored_sketch(spark, path, lemma, k=1000)
        assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(map(tuple, direct.where(F.col("word1_lemma") == lemma).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(word1_lemma,nosuchword)" in plan
    direct.unpersist()
    sketch.store_index(tokens.limit(0), path + "0", marginals="corpus")
    assert sketch.stored_sketch(spark, path + "0", "a").collect() == []


def test_offsets(spark):
    rows = [(k, (k * 7) % 5) for k in range(200)] + [(500, 0)]
    got = {r.k: r.offset for r in offsets(spark.createDataFrame(rows, "k int, n bigint").repartition(6), "n", F.col("k")).collect()}
    assert got == {k: sum(n for j, n in rows if j < k) for k, _ in rows}
    assert offsets(spark.createDataFrame([], "k int, n bigint"), "n", F.col("k")).collect() == []


def test_tokens_without_a_text_come_first(spark):
    t = spark.createDataFrame([(None, 0, "a"), (None, 1, "b"), (2, 5, "e"), (1, 3, "c"), (1, 9, "d")], "text_id int, tok_idx int, text string")
    assert sorted(r.ngram for r in freq.ngrams(t, (2,), cross_text=True).collect()) == ["a b", "b c", "c d", "d e"]
