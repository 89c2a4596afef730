"""Keyness of a study corpus against a reference corpus or a frequency list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import stats


def counts(tokens: DataFrame, word: str = "word") -> DataFrame:
    return tokens.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("freq"))


def keyness(study: DataFrame, reference: DataFrame, measure: str = "log_likelihood", *, min_study: int = 3, min_reference: int = 3, negative: bool = True, min_score: float | None = None, max_p: float | None = None, min_effect: float = 0.0) -> DataFrame:
    """(word, study_freq, ref_freq, study_norm, ref_norm, score, direction, effect_size, p_value, significance).

    study and reference are (word, freq); their full outer join is the vocabulary. A word goes only if
    both counts are below their least. Sizes are one row each.
    """
    size = lambda t, name: t.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("bigint").alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    t = study.select("word", F.col("freq").alias("a")).join(reference.select("word", F.col("freq").alias("b")), "word", "full_outer")
    t = t.select("word", zero("a").alias("study_freq"), zero("b").alias("ref_freq")).where((F.col("study_freq") >= min_study) | (F.col("ref_freq") >= min_reference))
    t = t.crossJoin(F.broadcast(size(study, "n1"))).crossJoin(F.broadcast(size(reference, "n2"))).where("n1 > 0 and n2 > 0")
    raw = stats.MEASURES[measure](F.col("study_freq"), F.col("n1"), F.col("ref_freq"), F.col("n2"))
    t = t.withColumn("raw", raw)
    a, b = F.col("study_freq") / F.col("n1") * 1e6, F.col("ref_freq") / F.col("n2") * 1e6
    mark, p = stats.stars(F.col("raw"), measure)
    effect = stats.log_ratio(F.col("study_freq"), F.col("n1"), F.col("ref_freq"), F.col("n2"))
    out = t.select(
        "word", "study_freq", "ref_freq", F.round(a, 2).alias("study_norm"), F.round(b, 2).alias("ref_norm"), F.round("raw", 4).alias("score"),
        F.when(a >= b, "positive").otherwise("negative").alias("direction"), F.round(effect, 4).alias("effect_size"), p.alias("p_value"), mark.alias("significance"),
    )
    out = out.where(F.abs("effect_size") >= min_effect)
    if not negative:
        out = out.where("direction = 'positive'")
    if min_score is not None:
        out = out.where(F.abs("score") >= min_score)
    return out.where(F.col("p_value") <= max_p) if max_p is not None else out


def resource_counts(rows: DataFrame, exclude: tuple[str, ...] = (), remove_stopwords: bool = False) -> DataFrame:
    """(word, freq) of a word,lemma,pos,freq list: bad numbers count 0, parts of speech are summed.

    Excluded words leave the list only together with stop words.
    """
    from textloom.operators.predicates import without_stopwords

    t = rows.select(F.lower("word").alias("word"), F.coalesce(F.expr("try_cast(freq as bigint)"), F.lit(0)).alias("freq"))
    t = t.where(without_stopwords(F.col("word"), True, exclude)) if remove_stopwords else t
    return t.groupBy("word").agg(F.sum("freq").cast("bigint").alias("freq"))
