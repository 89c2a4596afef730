"""Topic models against numpy on a small table; strategies for outliers; sentences held together."""

import random

import numpy as np
import pytest

from textloom.functions.sentences import sentence_spans
from textloom.operators import topics

TEXTS = "text_id bigint, terms array<string>"


@pytest.fixture(scope="module")
def bags(spark):
    rng = random.Random(4)
    fields = ["sea boat fish net wave".split(), "loom yarn weave cloth dye".split(), "pot fire clay glaze kiln".split()]
    rows = []
    for i in range(60):
        rows.append((i + (1 << 33), [rng.choice(fields[i % 3]) for _ in range(12)] + [rng.choice(rng.choice(fields)) for _ in range(3)]))
    return spark.createDataFrame(rows, TEXTS).repartition(3)


def matrix(bags, unit):
    rows = sorted(bags.collect(), key=lambda r: r.text_id)
    words = sorted({w for r in rows for w in r.terms})
    n = np.array([[r.terms.count(w) for w in words] for r in rows], float)
    x = n * (np.log((1 + len(rows)) / (1 + (n > 0).sum(0))) + unit)
    return (x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x), words


def test_lsa_is_the_singular_value_decomposition(bags):
    x, words = matrix(bags, 0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    found, share = topics.lsa(bags, 3, top=5)
    assert np.allclose([r.explained for r in sorted(share.collect())], s[:3] ** 2 / (s**2).sum(), rtol=1e-4)
    for t in range(3):
        top = sorted((r for r in found.collect() if r.topic == t), key=lambda r: r["rank"])
        want = sorted(range(len(words)), key=lambda i: -abs(v[t, i]))[:5]
        assert top[0].weight > 0 and np.allclose([abs(r.weight) for r in top], np.abs(v[t, want]), atol=1e-3)


def test_lsa_first_k_that_explains_enough(bags):
    rows = topics.optimise_lsa(bags, 15, 0.9).collect()
    best = [r for r in rows if r.best]
    assert len(best) == 1 and best[0].explained >= 0.9 and all(r.explained < 0.9 for r in rows if r.k < best[0].k)


def test_nmf_factors_the_whole_matrix(bags):
    x, words = matrix(bags, 1)
    found, docs, measures = topics.nmf(bags, 3, top=len(words), tolerance=1e-4)
    w = np.array([r.distribution for r in sorted(docs.collect(), key=lambda r: r.text_id)])
    h = np.zeros((3, len(words)))
    for r in found.collect():
        h[r.topic, words.index(r.keyword)] = r.weight
    assert (w >= 0).all() and (h >= 0).all()
    assert measures["reconstruction_error"] == pytest.approx(np.linalg.norm(x - w @ h), rel=1e-6)
    _, s, _ = np.linalg.svd(x)
    least = np.sqrt((s[3:] ** 2).sum())  # what no factors of this rank can beat
    assert least <= measures["reconstruction_error"] <= 1.1 * least
    assert measures["sparsity"] == pytest.approx(((w < 1e-9).mean() + (h < 1e-9).mean()) / 2)
    top = {frozenset(words[i] for i in np.argsort(-row)[:5]) for row in h}
    assert top == {frozenset(f.split()) for f in ("sea boat fish net wave", "loom yarn weave cloth dye", "pot fire clay glaze kiln")}


def test_best_number_of_topics(bags):
    rows = {r.k: r for r in topics.optimise_nmf(bags, range(2, 4)).collect()}
    assert rows[3].best and not rows[2].best and rows[3].reconstruction_error < rows[2].reconstruction_error
    lda = topics.optimise_topics(bags, range(2, 4), passes=3).collect()
    assert sum(r.best for r in lda) == 1 and max(lda, key=lambda r: r.coherence).best


def test_no_texts(spark):
    none = spark.createDataFrame([], TEXTS)
    assert topics.nmf(none, 2)[0].collect() == [] and topics.lsa(none, 2)[0].collect() == []


def test_outliers_by_terms(spark):
    rows = [(1, 0, i, w) for i, w in enumerate("sea boat sea fish".split())] + [(2, 1, i, w) for i, w in enumerate("loom yarn dye".split())]
    rows += [(3, -1, i, w) for i, w in enumerate("boat fish net".split())] + [(4, -1, 0, "unheard")]
    t = spark.createDataFrame(rows, "doc_id bigint, topic int, tok_idx int, term string")
    docs = t.select("doc_id", "topic").distinct()
    for scores in (topics.class_scores(t), topics.window_scores(t)):
        got = {r.doc_id: (r.old_topic, r.topic) for r in topics.reassign(docs, scores, 0.1).collect()}
        assert got == {1: (0, 0), 2: (1, 1), 3: (-1, 0), 4: (-1, -1)}


def test_stops_that_do_not_end_a_sentence():
    cut = lambda t: [t[a:b] for a, b in sentence_spans(t)]
    assert cut("It was J. Doe who came. Then (K. Roe) left.") == ["It was J. Doe who came.", "Then (K. Roe) left."]
    assert cut("See https://x.org/a. Or www.b.org. Done") == ["See https://x.org/a. Or www.b.org. Done"]
    assert cut("  3. Third item here. Next") == ["3. Third item here.", "Next"]
    assert cut("We saw 3. Then we left.") == ["We saw 3.", "Then we left."]
    assert cut("Write to a.b@c.org. Then wait.") == ["Write to a.b@c.org.", "Then wait."]


def test_lda_reads_its_texts_once(spark, bags):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    found, docs, _ = topics.lda(bags.mapInArrow(seen, TEXTS), 3, passes=2)
    assert found.count() == 30 and docs.count() == 60
    assert read.value == 60


def test_lda_measures_are_sparks(bags):
    x, words, _ = topics._counted(bags)
    from pyspark.ml.clustering import LDA

    model = LDA(k=3, maxIter=5, seed=1, optimizer="online", featuresCol="features").fit(x)
    measures = topics._Measures(model, x)
    assert measures["log_likelihood"] == pytest.approx(model.logLikelihood(x), rel=1e-4)
    assert measures["log_perplexity"] == pytest.approx(model.logPerplexity(x), rel=1e-4)


def test_lda_options_share_one_table_of_texts(spark, bags):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = topics.optimise_topics(bags.mapInArrow(seen, TEXTS), range(2, 4), passes=2).collect()
    assert [r.k for r in rows] == [2, 3] and sum(r.best for r in rows) == 1 and read.value == 60


def test_lda_topics_need_no_pass_for_measures(bags, monkeypatch):
    monkeypatch.setattr(topics, "_bound", lambda *a: pytest.fail("measures were not asked for"))
    assert {r["rank"] for r in topics.lda(bags, 3, passes=2, top=4)[0].collect()} == {1, 2, 3, 4}
