"""Topic models and what is drawn from them: vectors, c-TF-IDF, evolution, flows, similarity, hierarchy."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.predicates import PosFilter, form, without_stopwords
from textloom.runtime import materialize


def preprocess(tokens: DataFrame, *, pos: PosFilter | None = None, stopwords: bool = True, min_length: int = 2, target: str = "lemma", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, terms, original, after_pos, after_stop, final) per text: cleaned terms in order, and how many each filter left."""
    word = F.lower(F.regexp_replace(F.regexp_replace(form(target), r"^[^\p{L}\p{N}_]+", ""), r"[^\p{L}\p{N}_]+$", ""))
    kept = pos.tokens(F.col("pos")) if pos else F.lit(True)
    t = tokens.where("not coalesce(is_punct, false)").select("text_id", "tok_idx", word.alias("w"), kept.alias("p"))
    s = F.col("p") & without_stopwords(F.col("w"), stopwords, exclude)
    f = s & (F.length("w") >= min_length)
    g = t.groupBy("text_id").agg(F.sort_array(F.collect_list(F.when(f, F.struct("tok_idx", "w")))).alias("x"), F.count("*").alias("original"), F.count_if("p").alias("after_pos"), F.count_if(s).alias("after_stop"), F.count_if(f).alias("final"))
    return g.select("text_id", F.transform("x", lambda x: x["w"]).alias("terms"), "original", "after_pos", "after_stop", "final")


def vectors(terms: DataFrame, *, min_df: int = 1, max_df: float = 1.0, vocab: int | None = None, ngram: int = 1, tf_idf: bool = False):
    """(frame with `features`, vocabulary): counts or TF-IDF of term arrays; min_df texts at least, max_df of all at most.

    All such terms count, or, for models that a driver should hold, the `vocab` most frequent of them.
    """
    from pyspark.ml.feature import IDF, CountVectorizer, NGram

    column = "terms"
    if ngram > 1:
        terms, column = NGram(n=ngram, inputCol="terms", outputCol="grams").transform(terms), "grams"
    count = CountVectorizer(inputCol=column, outputCol="counts", minDF=float(min_df), vocabSize=vocab or (1 << 31) - 1)
    model = (count.setMaxDF(float(max_df)) if max_df < 1 else count).fit(terms)
    out = model.transform(terms)
    return (IDF(inputCol="counts", outputCol="features").fit(out).transform(out) if tf_idf else out.withColumn("features", F.col("counts"))), model.vocabulary


class _Measures(Mapping):
    """log_perplexity and log_likelihood of an LDA model on its texts, worked out together when one is first asked for."""

    def __init__(self, model, x: DataFrame):
        self._model, self._x, self._found = model, x, None

    def _all(self) -> dict[str, float]:
        if self._found is None:
            bound, counts = _bound(self._model, self._x)
            self._found = {"log_perplexity": -bound / counts, "log_likelihood": bound}
        return self._found

    def __getitem__(self, key: str) -> float:
        return self._all()[key]

    def __iter__(self):
        return iter(("log_perplexity", "log_likelihood"))

    def __len__(self) -> int:
        return 2


def _digamma(x: np.ndarray) -> np.ndarray:
    """Above zero, by its recurrence up to six and the asymptotic series from there."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(y) for y in x.ravel().tolist()]).reshape(x.shape)


def _bound(model, x: DataFrame) -> tuple[float, float]:
    """(variational bound on the texts' log likelihood, number of terms), as Spark's logLikelihood() defines it.

    The texts' distributions are inferred once, by the model. Their parameters follow, as these add up to the prior's
    and the text's terms; sums over a text's terms are taken in numpy.
    """
    from pyspark.ml.functions import vector_to_array

    k, alpha = model.getK(), model.estimatedDocConcentration().toArray()
    eta = model.getTopicConcentration() if model.isDefined("topicConcentration") else 1.0 / k
    lam = model.topicsMatrix().toArray()
    logs = _digamma(lam) - _digamma(lam.sum(0))
    whole = ((eta - lam) * logs).sum() + (_lgamma(lam) - math.lgamma(eta)).sum() + k * math.lgamma(eta * len(lam)) - _lgamma(lam.sum(0)).sum()
    spark = x.sparkSession
    sent = spark.sparkContext.broadcast(np.exp(logs - logs.max(1, keepdims=True)))
    peak = spark.sparkContext.broadcast(logs.max(1))

    def run(batches):
        bound = total = 0.0
        for batch in batches:
            for i, n, share in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                i, n, share = i.values.to_numpy(), n.values.to_numpy(), share.values.to_numpy()
                size = n.sum()
                gamma = share * (size + alpha.sum())
                about = _digamma(gamma) - _digamma(gamma.sum())
                bound += float(n @ (peak.value[i] + np.log(sent.value[i] @ np.exp(about))))
                bound += float(((alpha - gamma) * about).sum() + (_lgamma(gamma) - _lgamma(alpha)).sum() + math.lgamma(alpha.sum()) - math.lgamma(gamma.sum()))
                total += float(size)
        yield pa.RecordBatch.from_arrays([pa.array([bound]), pa.array([total])], ["bound", "n"])

    sparse = F.unwrap_udt("features")  # counts are sparse vectors
    texts = model.transform(x).select(sparse["indices"].alias("i"), sparse["values"].alias("n"), vector_to_array("topicDistribution").alias("share")).where("size(i) > 0")
    found = texts.mapInArrow(run, "bound double, n double").agg(F.sum("bound"), F.sum("n")).first()
    return float(whole + (found[0] or 0.0)), float(found[1] or 0.0)


def _counted(terms: DataFrame, **how) -> tuple[DataFrame, list[str], DataFrame]:
    """(texts' vectors, vocabulary, texts' terms): both tables are written, as a model reads its texts once a pass."""
    bags = materialize(terms.select("text_id", "terms"), "bags")
    x, words = vectors(bags, **how)
    return materialize(x.select("text_id", "features"), "vectors"), words, bags


def lda(terms: DataFrame, k: int = 10, *, passes: int = 10, seed: int = 42, top: int = 10, **how):
    """(topics, doc_topics, measures): keywords with weights by topic, distributions by text, log perplexity."""
    x, words, _ = _counted(terms, **how)
    return _lda(x, words, k, passes, seed, top)


def _lda(x: DataFrame, words: list[str], k: int, passes: int = 10, seed: int = 42, top: int = 10):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array

    model = LDA(k=k, maxIter=passes, seed=seed, optimizer="online", featuresCol="features").fit(x)
    best = model.describeTopics(top).collect()  # topics by `top`
    rows = [(r.topic, n + 1, words[i], float(w)) for r in best for n, (i, w) in enumerate(zip(r.termIndices, r.termWeights, strict=True))]
    t = x.sparkSession.createDataFrame(rows, "topic int, rank int, keyword string, weight double")
    d = model.transform(x).select("text_id", vector_to_array("topicDistribution").alias("distribution"))
    d = d.withColumn("dominant_topic", F.array_position("distribution", F.array_max("distribution")) - 1)
    return t, d, _Measures(model, x)


def optimise_topics(terms: DataFrame, ks: range, top: int = 10, *, passes: int = 10, seed: int = 42, **how) -> DataFrame:
    """(k, log_perplexity, coherence, best): a model per number of topics; the best has the highest mean UMass coherence, the least k of equals."""
    x, words, bags = _counted(terms, **how)
    out = []
    for k in ks:
        topics, _, measures = _lda(x, words, k, passes, seed, top)
        best = F.array(*(F.lit(r.keyword) for r in topics.select("keyword").distinct().collect())).cast("array<string>")  # k * top words
        each = bags.select("text_id", F.explode(F.array_intersect("terms", best)).alias("term"))
        mean = coherence(each, topics.withColumnRenamed("keyword", "term")).agg(F.avg("coherence")).first()[0]
        out.append((k, measures["log_perplexity"], mean))
    best = min(out, key=lambda r: (-(r[2] if r[2] is not None else -np.inf), r[0]))[0] if out else None
    return terms.sparkSession.createDataFrame([(*r, r[0] == best) for r in out], "k int, log_perplexity double, coherence double, best boolean")


def weighted(terms: DataFrame, *, min_df: int = 1, max_df: float = 1.0, vocab: int | None = None, unit: bool = False) -> DataFrame:
    """(text_id, term, v): TF-IDF with idf ln((1 + texts) / (1 + df)); with unit, idf gets one more and texts have length one.

    The `vocab` terms with the highest counts, ties by term, or all.
    """
    n = terms.select("text_id", F.explode("terms").alias("term")).groupBy("text_id", "term").agg(F.count("*").alias("n"))
    df = n.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    texts = terms.agg(F.count("*").alias("texts"))
    df = df.crossJoin(F.broadcast(texts)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("texts")))  # texts is one row
    df = df.orderBy(F.desc("total"), "term").limit(vocab) if vocab else df
    x = n.join(df, "term").withColumn("v", F.col("n") * (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + int(unit)))
    if unit:
        x = x.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("text_id"))))
    return x.select("text_id", "term", "v")


def lsa(terms: DataFrame, k: int = 10, top: int = 10, vocab: int = 10_000, *, rounds: int = 60, tolerance: float = 1e-7, seed: int = 42, **how):
    """(topics, variance): leading terms of the first singular vectors of the TF-IDF matrix; the share of variance each explains.

    Subspace iteration: a round multiplies the matrix of terms and k + 10 directions by X'X, each task
    summing its texts' part, until the k leading values rest. Only that matrix, bounded by vocab, passes
    through the driver. A topic's sign makes its heaviest term positive.
    """
    spark = terms.sparkSession
    x = materialize(weighted(terms, vocab=vocab, **how), "weighted")
    words = sorted(r[0] for r in x.select("term").distinct().collect())  # `vocab` at most
    names = spark.createDataFrame(list(enumerate(words)), "i int, term string")
    docs = x.join(names, "term").groupBy("text_id").agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v")).select("i", "v")
    docs = materialize(docs, "texts")
    whole = x.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    size = min(len(words), k + 10)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(words), size)))[0] if words else np.zeros((0, 0))
    values = np.zeros(size)

    def product(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q)

        def run(batches):
            total = np.zeros(sent.value.shape)
            for batch in batches:
                for i, v in zip(batch.column(0), batch.column(1), strict=True):
                    i, v = i.values.to_numpy(), v.values.to_numpy()
                    total[i] += np.outer(v, v @ sent.value[i])
            some = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total[some].T)], ["i", *(f"c{n}" for n in range(total.shape[1]))])

        parts = docs.mapInArrow(run, "i int, " + ", ".join(f"c{n} double" for n in range(q.shape[1])))
        got = parts.groupBy("i").agg(*(F.sum(f"c{n}").alias(f"c{n}") for n in range(q.shape[1]))).toArrow()
        out = np.zeros(q.shape)
        out[got.column(0).to_numpy()] = np.column_stack([got.column(n + 1).to_numpy() for n in range(q.shape[1])])
        return out

    for _ in range(rounds if size else 0):
        y = product(q)
        w, r = np.linalg.eigh(q.T @ y)
        order = np.argsort(-w, kind="stable")
        w, v = w[order], (q @ r)[:, order]
        rest = np.abs(w[:k] - values[:k]).max(initial=0) <= tolerance * max(w[0], 1e-300)
        values = w
        if rest:
            break
        q = np.linalg.qr(y)[0]
    out = []
    for t in range(min(k, size)):
        best = np.argsort(-np.abs(v[:, t]), kind="stable")[:top]
        sign = np.sign(v[best[0], t]) or 1.0
        out += [(t, n + 1, words[i], float(sign * v[i, t])) for n, i in enumerate(best)]
    share = [(t, float(values[t] / whole) if whole else 0.0) for t in range(min(k, size))]
    return spark.createDataFrame(out, "topic int, rank int, keyword string, weight double"), spark.createDataFrame(share, "topic int, explained double")


def optimise_lsa(terms: DataFrame, most: int = 20, wanted: float = 0.9, **how) -> DataFrame:
    """(k, explained, best): the variance that the first k topics explain; the best is the first k with `wanted` of it, else the last."""
    share = sorted(lsa(terms, most, **how)[1].collect(), key=lambda r: r.topic)
    total = np.cumsum([r.explained for r in share])
    best = next((i for i, t in enumerate(total) if t >= wanted), len(total) - 1)
    return terms.sparkSession.createDataFrame([(i + 1, float(t), i == best) for i, t in enumerate(total)], "k int, explained double, best boolean")


def nmf(terms: DataFrame, k: int = 10, *, rounds: int = 200, tolerance: float = 1e-3, top: int = 10, seed: int = 42, **how):
    """(topics, doc_topics, measures): non-negative factors of the whole TF-IDF matrix, its zeros included, by multiplicative updates.

    A round joins the matrix's entries with either factor and sums by the other key; beyond that only
    the factors' k x k Gram matrices are needed, so zeros cost nothing. It ends when the error falls by less
    than `tolerance` of itself. Measures are the reconstruction error and the mean share of zeros in the factors.
    """
    spark = terms.sparkSession
    x = materialize(weighted(terms, unit=True, **how), "weighted")
    n = range(k)
    mean = x.agg(F.avg("v")).first()[0] or 0.0
    start = lambda key: F.array(*(F.pmod(F.xxhash64(F.lit(seed + i), key), F.lit(1_000_003)) / 1_000_003.0 * (mean / k) ** 0.5 + 1e-3 for i in n))
    factors = {"text_id": x.select("text_id").distinct().withColumn("f", start("text_id")), "term": x.select("term").distinct().withColumn("f", start("term"))}
    square = x.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0

    def gram(f: DataFrame) -> np.ndarray:
        return np.array(f.agg(F.array(*(F.sum(F.col("f")[i] * F.col("f")[j]) for i in n for j in n))).first()[0]).reshape(k, k)

    def update(mine: str, other: str) -> np.ndarray:
        g = gram(factors[other])
        sums = x.join(factors[other].select(other, "f"), other).groupBy(mine).agg(F.array(*(F.sum(F.col("v") * F.col("f")[i]) for i in n)).alias("s"))
        below = [sum((F.col("f")[j] * float(g[i, j]) for j in n), F.lit(1e-12)) for i in n]
        new = factors[mine].select(mine, "f").join(sums, mine).select(mine, F.array(*(F.col("f")[i] * F.col("s")[i] / below[i] for i in n)).alias("f"), "s")
        factors[mine] = materialize(new, "factor")
        return g

    error, zero = square**0.5, 0.0
    for _ in range(rounds if square else 0):
        update("term", "text_id")
        g = update("text_id", "term")
        fit = factors["text_id"].agg(F.sum(sum((F.col("f")[i] * F.col("s")[i] for i in n), F.lit(0.0)))).first()[0]
        now = max(0.0, square - 2 * fit + float((g * gram(factors["text_id"])).sum())) ** 0.5
        done, error = error - now <= tolerance * error, now
        if done:
            break
    sparse = [factors[c].agg(F.avg(sum(((F.col("f")[i] < 1e-9).cast("int") for i in n), F.lit(0)) / k)).first()[0] or 0.0 for c in factors]
    items = factors["term"].select(F.col("term").alias("keyword"), F.posexplode("f").alias("topic", "weight"))
    first = Window.partitionBy("topic").orderBy(F.desc("weight"), "keyword")
    topics = items.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).select("topic", "rank", "keyword", "weight")
    return topics, factors["text_id"].select("text_id", F.col("f").alias("distribution")), {"reconstruction_error": error, "sparsity": sum(sparse) / 2}


def optimise_nmf(terms: DataFrame, ks: range, **how) -> DataFrame:
    """(k, reconstruction_error, sparsity, best): a model per number of topics; the best has the least error."""
    out = [(k, *nmf(terms, k, **how)[2].values()) for k in ks]
    best = min(out, key=lambda r: (r[1], r[0]))[0] if out else None
    return terms.sparkSession.createDataFrame([(*r, r[0] == best) for r in out], "k int, reconstruction_error double, sparsity double, best boolean")


def class_tf_idf(terms: DataFrame, top: int | None = 10) -> DataFrame:
    """(topic, term, frequency, score, rank): tf * ln(1 + A / f), A the mean number of terms a topic; terms are (topic, term).

    The first `top` terms of each topic, or all.
    """
    n = terms.groupBy("topic", "term").agg(F.count("*").alias("frequency"))
    f = n.groupBy("term").agg(F.sum("frequency").alias("f"))
    size = n.groupBy("topic").agg(F.sum("frequency").alias("size"))
    mean = size.agg(F.avg("size").alias("a"))
    x = n.join(f, "term").join(size, "topic").crossJoin(F.broadcast(mean))  # mean is one row
    x = x.withColumn("score", F.round(F.col("frequency") / F.col("size") * F.log(1 + F.col("a") / F.col("f")), 6))
    first = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    x = x.withColumn("rank", F.row_number().over(first).cast("bigint"))
    x = x.where(F.col("rank") <= top) if top else x
    return x.select("topic", "term", "frequency", "score", "rank")


def topic_similarity(weights: DataFrame) -> DataFrame:
    """(topic1, topic2, similarity): cosines of topics over (topic, term, score), cut to [0, 1]; by joins on shared terms."""
    norm = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    w = weights.select("topic", "term", "score").join(norm, "topic").select("topic", "term", (F.col("score") / F.col("norm")).alias("w"))
    a, b = w.toDF("topic1", "term", "a"), w.toDF("topic2", "term", "b")
    s = a.join(b, "term").groupBy("topic1", "topic2").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    ids = weights.select("topic").distinct()
    grid = ids.toDF("topic1").crossJoin(F.broadcast(ids.toDF("topic2")))  # topics by topics
    return grid.join(s, ["topic1", "topic2"], "left").select("topic1", "topic2", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("s", F.lit(0.0)))), 4).alias("similarity"))


def time_slices(dates: DataFrame, bins: int | None = None) -> DataFrame:
    """(date, slice): each distinct date's slice, the latest slice date not after it; every (n // bins)-th date starts one, and the last."""
    d = dates.select("date").where("date is not null").distinct()
    w = Window.orderBy("date")  # one row per distinct date
    d = d.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    if bins:
        step = F.floor(F.col("n") / bins)
        start = F.when(F.col("n") > bins, (F.col("i") % step == 0) & (F.col("i") / step < bins) | (F.col("i") == F.col("n") - 1)).otherwise(True)
    else:
        start = F.lit(True)
    return d.withColumn("start", start).select("date", F.last(F.when(F.col("start"), F.col("date")), ignorenulls=True).over(w).alias("slice"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it, and SQL's doubles: nothing by nothing is NaN, all else by nothing infinite."""
    return F.when(b == 0, F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))).otherwise(a / b)


def rounded(c: Column, places: int) -> Column:
    """c rounded as SQL's doubles are: scaled, rounded to a whole number, scaled back; F.round() would round the shortest decimal."""
    return F.round(c * 10.0**places) / 10.0**places


def topic_evolution(doc_topics: DataFrame, dates: DataFrame, bins: int | None = None) -> DataFrame:
    """(slice, topic, weight, docs): mean weights per slice; doc_topics (doc_id, topic, weight), dates (doc_id, date). Undated texts are left out."""
    s = dates.join(time_slices(dates, bins), "date").select("doc_id", "slice")
    docs = s.groupBy("slice").agg(F.count_distinct("doc_id").alias("docs"))
    w = doc_topics.join(s, "doc_id").groupBy("slice", "topic").agg(F.sum("weight").alias("w"))
    return w.join(docs, "slice").select("slice", "topic", F.round(F.col("w") / F.col("docs"), 4).alias("weight"), "docs")


def topic_sankey(doc_topics: DataFrame, dates: DataFrame, bins: int | None = None, least: float = 0.01) -> DataFrame:
    """(slice, next_slice, source, target, value): products of the shares of neighbouring slices, above `least`."""
    s = dates.join(time_slices(dates, bins), "date").select("doc_id", "slice")
    w = doc_topics.join(s, "doc_id").groupBy("slice", "topic").agg(F.sum("weight").alias("w"))
    w = w.withColumn("p", ratio(F.col("w"), F.sum("w").over(Window.partitionBy("slice"))))
    order = w.select("slice").distinct().withColumn("next_slice", F.lead("slice").over(Window.orderBy("slice")))  # one row per slice
    a = w.join(order, "slice").select("slice", "next_slice", F.col("topic").alias("source"), F.col("p").alias("a"))
    b = w.select(F.col("slice").alias("next_slice"), F.col("topic").alias("target"), F.col("p").alias("b"))
    v = F.col("a") * F.col("b")
    return a.join(b, "next_slice").where(v > least).select("slice", "next_slice", "source", "target", F.round(v, 4).alias("value"))


def topics_over_time(docs: DataFrame, normalise: bool = False) -> DataFrame:
    """(topic, date, frequency, share): documents (topic, date) per topic and date; the share is of the date, or zero unless asked."""
    n = docs.groupBy("topic", "date").agg(F.count("*").alias("frequency"))
    share = F.round(F.col("frequency") / F.sum("frequency").over(Window.partitionBy("date")), 4) if normalise else F.lit(0.0)
    return n.select("topic", "date", "frequency", share.alias("share"))


def document_flow(docs: DataFrame) -> DataFrame:
    """(source, topic, documents): how many texts of a source are in a topic."""
    return docs.groupBy("source", "topic").agg(F.count("*").alias("documents"))


def date_coverage(docs: DataFrame) -> DataFrame:
    """(with_date, without_date, parse_errors, first, last, distinct, usable) of (raw, date); usable needs two distinct dates."""
    raw = F.col("raw").isNotNull() & (F.trim("raw") != "")
    s = docs.agg(F.count_if(F.col("date").isNotNull()).alias("with_date"), F.count_if(~raw).alias("without_date"), F.count_if(raw & F.col("date").isNull()).alias("parse_errors"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("distinct_dates"))
    return s.withColumn("usable", (F.col("with_date") >= 2) & (F.col("distinct_dates") >= 2))


def centroids(vecs: DataFrame) -> DataFrame:
    """(topic, i, c): mean of unit vectors per topic, by component."""
    unit = _unit(vecs).select("topic", F.posexplode("u").alias("i", "x"))
    return unit.groupBy("topic", "i").agg(F.avg("x").alias("c"))


def _unit(vecs: DataFrame, column: str = "embedding") -> DataFrame:
    v = F.transform(column, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vecs.withColumn("u", F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def reduce_outliers(vecs: DataFrame, least: float = 0.0) -> DataFrame:
    """(vec_id, old_topic, topic, similarity): outliers (topic -1) go to the topic of the nearest centroid, if at least `least` alike.

    Centroids are one row per topic and go to every task.
    """
    c = centroids(vecs.where("topic != -1")).groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("c"))
    c = c.select(F.col("topic").alias("near"), F.transform("c", lambda x: x / F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, y: a + y * y))).alias("c"))
    x = _unit(vecs.where("topic = -1")).crossJoin(F.broadcast(c)).withColumn("s", F.round(_dot("u", "c"), 6))
    best = x.groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("near")).alias("n"))).alias("b"))
    moved = best.select("vec_id", F.lit(-1).alias("old_topic"), F.when(F.col("b.s") >= least, -F.col("b.n")).otherwise(-1).cast("int").alias("topic"), F.round("b.s", 4).alias("similarity"))
    stay = vecs.where("topic != -1").select("vec_id", F.col("topic").alias("old_topic"), "topic", F.lit(1.0).alias("similarity"))
    return stay.unionByName(moved)


def reassign(docs: DataFrame, scores: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc_id, old_topic, topic, similarity): outliers of docs (doc_id, topic), topic -1, go to their best topic of scores (doc_id, topic, score), if above `least`.

    Any strategy's scores will do: class_scores(), window_scores(), or a model's probabilities. Scores
    that agree to six places are ties and go to the least topic; similarity is the score, rounded once.
    """
    best = scores.groupBy("doc_id").agg(F.max_by("topic", F.struct(F.round("score", 6).alias("s"), (-F.col("topic")).alias("t"))).alias("near"), F.max("score").alias("s"))
    x = docs.join(best, "doc_id", "left").withColumn("moves", (F.col("topic") == -1) & (F.coalesce("s", F.lit(0.0)) > least))
    similarity = F.when(F.col("topic") == -1, F.coalesce("s", F.lit(0.0))).otherwise(1.0)
    return x.select("doc_id", F.col("topic").alias("old_topic"), F.when(F.col("moves"), F.col("near")).otherwise(F.col("topic")).alias("topic"), rounded(similarity, 4).alias("similarity"))


def class_scores(terms: DataFrame) -> DataFrame:
    """(doc_id, topic, score): cosines of each outlier's terms with the topics' c-TF-IDF; terms are (doc_id, topic, term)."""
    w = class_tf_idf(terms.where("topic != -1").select("topic", "term"), None).select("topic", "term", "score")
    norm = w.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    n = terms.where("topic = -1").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    size = n.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    s = n.join(w, "term").groupBy("doc_id", "topic").agg(F.sum(F.col("n") * F.col("score")).alias("s"))
    return s.join(norm, "topic").join(size, "doc_id").select("doc_id", "topic", (F.col("s") / (F.col("norm") * F.col("size"))).alias("score"))


def window_scores(terms: DataFrame, window: int = 4) -> DataFrame:
    """(doc_id, topic, score): an outlier's topic distribution, summed over its windows of `window` terms; terms are (doc_id, topic, tok_idx, term).

    A window's score for a topic is the mean c-TF-IDF of its terms; a term lies in up to `window` windows.
    """
    w = class_tf_idf(terms.where("topic != -1").select("topic", "term"), None).select("topic", "term", "score")
    t = terms.where("topic = -1")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("tok_idx"))
    t = t.withColumn("n", n).withColumn("at", at)
    inside = F.least(F.col("at"), F.col("n") - F.col("at") + 1, F.lit(window), F.greatest(F.lit(1), F.col("n") - window + 1))
    s = t.select("doc_id", "term", inside.alias("times")).join(w, "term").groupBy("doc_id", "topic").agg(F.sum(F.col("times") * F.col("score")).alias("s"))
    return s.select("doc_id", "topic", (F.col("s") / F.sum("s").over(Window.partitionBy("doc_id"))).alias("score"))


def merge_topics(terms: DataFrame, groups: dict[int, int], top: int = 10) -> DataFrame:
    """c-TF-IDF anew after topics are mapped onto others."""
    into = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv)) if groups else None
    return class_tf_idf(terms.withColumn("topic", F.coalesce(into[F.col("topic")], F.col("topic"))) if groups else terms, top)


def rename_topics(topics: DataFrame, labels: DataFrame) -> DataFrame:
    """topics with label: the given one, else the first three terms joined by underscores."""
    own = topics.where("rank <= 3").groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "_").alias("own"))
    return topics.join(own, "topic").join(labels, "topic", "left").withColumn("label", F.coalesce("label", F.concat_ws("_", F.col("topic").cast("string"), "own"))).drop("own")


def coherence(terms: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, coherence): UMass over a topic's terms in rank order, from document frequencies and pair counts; terms (text_id, term)."""
    wanted = topics.select("term").distinct()
    t = terms.join(wanted, "term", "left_semi").select("text_id", "term").distinct()
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    pairs = topics.alias("a").join(topics.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("b.rank") < F.col("a.rank"))).select("a.topic", F.col("a.term").alias("w"), F.col("b.term").alias("v"))
    docs = t.join(pairs.select("w", "v").distinct(), F.col("term") == F.col("w")).select("text_id", "w", "v").join(t.withColumnRenamed("term", "v"), ["text_id", "v"]).groupBy("w", "v").agg(F.count("*").alias("both"))
    x = pairs.join(docs, ["w", "v"], "left").join(df.toDF("v", "df"), "v")
    return x.groupBy("topic").agg(F.round(F.avg(F.log((F.coalesce("both", F.lit(0)) + 1.0) / F.col("df"))), 4).alias("coherence"))


def relevance(terms: DataFrame, lam: float = 0.6, top: int = 10) -> DataFrame:
    """(topic, term, relevance, rank): lam * log p(term | topic) + (1 - lam) * log lift."""
    n = terms.groupBy("topic", "term").agg(F.count("*").alias("n"))
    size, f = Window.partitionBy("topic"), n.groupBy("term").agg(F.sum("n").alias("f"))
    total = n.agg(F.sum("n").alias("total"))
    x = n.withColumn("size", F.sum("n").over(size)).join(f, "term").crossJoin(F.broadcast(total))  # total is one row
    p = F.col("n") / F.col("size")
    x = x.withColumn("relevance", F.round(lam * F.log(p) + (1 - lam) * F.log(p / (F.col("f") / F.col("total"))), 4))
    x = x.withColumn("rank", F.row_number().over(size.orderBy(F.desc("relevance"), "term")).cast("bigint"))
    return x.where(F.col("rank") <= top).select("topic", "term", "relevance", "rank")


def project(vecs: DataFrame, k: int = 2) -> DataFrame:
    """vecs with `position`, the first k principal components of embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = vecs.withColumn("v", array_to_vector(F.transform("embedding", lambda a: a.cast("double"))))
    return PCA(k=k, inputCol="v", outputCol="p").fit(x).transform(x).withColumn("position", vector_to_array("p")).drop("v", "p")


def cluster(vecs: DataFrame, k: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """vecs with `topic`: k-means, or bisecting k-means in place of tree-based clusterings."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    x = vecs.withColumn("v", array_to_vector(F.transform("embedding", lambda a: a.cast("double"))))
    model = (KMeans if method == "kmeans" else BisectingKMeans)(k=k, seed=seed, featuresCol="v", predictionCol="topic").fit(x)
    return model.transform(x).drop("v")


def _cosines(weights: DataFrame) -> tuple[list, np.ndarray]:
    """Topics in order and the matrix of their cosines over (topic, term, score), from joins on shared terms: topics by topics."""
    norm = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    w = weights.select("topic", "term", "score").join(norm, "topic").select("topic", "term", F.when(F.col("norm") > 0, F.col("score") / F.col("norm")).otherwise(0.0).alias("w"))
    a, b = w.toDF("topic1", "term", "a"), w.toDF("topic2", "term", "b")
    found = a.join(b, "term").groupBy("topic1", "topic2").agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect()
    names = sorted({r.topic1 for r in found})
    at = {t: k for k, t in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in found:
        out[at[r.topic1], at[r.topic2]] = r.s
    return names, (out + out.T) / 2


def intertopic_map(weights: DataFrame, sizes: DataFrame, links: float = 0.3, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): topics on two principal axes scaled to [-5, 5] with sizes 20 .. 70; pairs of cosine at least `links`.

    weights is (topic, term, score) with any number of terms; only the cosines of topics come to the
    driver, and the principal axes of unit vectors follow from these.
    """
    names, g = _cosines(weights)
    n = len(names)
    h = np.eye(n) - 1 / max(1, n)
    value, vector = np.linalg.eigh(h @ g @ h) if n else (np.zeros(0), np.zeros((0, 0)))
    p = np.zeros((n, 2))
    for k, j in enumerate(np.argsort(-value)[:2]):
        v = vector[:, j] * np.sqrt(max(0.0, value[j]))
        p[:, k] = v * (1 if v[np.abs(v).argmax()] >= 0 else -1)
    p = p / max(1e-12, np.abs(p).max(initial=0.0)) * 5
    of = dict(sizes.select("topic", "count").collect())
    count = np.array([of.get(t, 0) for t in names], float)
    size = 20 + 50 * (count - count.min(initial=0.0 if not n else np.inf)) / max(1.0, float(np.ptp(count)) if n else 1.0)
    spark = weights.sparkSession
    nodes = spark.createDataFrame([(t, float(a), float(b), float(z)) for t, (a, b), z in zip(names, p, size, strict=True)], f"topic {weights.schema['topic'].dataType.simpleString()}, x double, y double, size double")
    pairs = topic_similarity(weights).where(F.col("topic1") < F.col("topic2")).where(F.col("similarity") >= links).orderBy(F.desc("similarity"), "topic1", "topic2").limit(most)
    return nodes, pairs


def hierarchy(weights: DataFrame) -> DataFrame:
    """(step, left, right, distance, size, terms): average linkage over cosine distances of the topics' weights; terms are the five heaviest of the leaves' mean.

    weights is (topic, term, score) with any number of terms. The matrix of topics by topics is worked on
    the driver, the terms of each step by a join of its leaves.
    """
    names, g = _cosines(weights)
    d = 1 - g
    groups = {i: [i] for i in range(len(names))}
    steps, leaves, nxt = [], [], len(names)
    while len(groups) > 1:
        order = sorted(groups)
        far, a, b = min((float(d[np.ix_(groups[p], groups[q])].mean()), p, q) for i, p in enumerate(order) for q in order[i + 1 :])
        groups[nxt] = groups.pop(a) + groups.pop(b)
        steps.append((nxt - len(names), a, b, round(far, 4), len(groups[nxt])))
        leaves += [(nxt - len(names), names[i]) for i in groups[nxt]]
        nxt += 1
    spark = weights.sparkSession
    kind = weights.schema["topic"].dataType.simpleString()
    of = spark.createDataFrame(leaves, f"step int, topic {kind}")
    best = Window.partitionBy("step").orderBy(F.desc("s"), "term")
    mean = weights.join(of, "topic").groupBy("step", "term").agg(F.round(F.sum("score"), 9).alias("s")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= 5)
    terms = mean.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("nth", "term"))).alias("x")).select("step", F.array_join(F.transform("x", lambda x: x["term"]), " ").alias("terms"))
    return spark.createDataFrame(steps, "step int, left int, right int, distance double, size int").join(terms, "step", "left")
