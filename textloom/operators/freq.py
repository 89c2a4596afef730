"""Word frequencies and n-grams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.predicates import PosFilter, between, content, form, lines_of, search, without_stopwords
from textloom.operators.ranking import offsets, ranked


def share(n: str, total: str, name: str = "percentage"):
    return F.round(F.col(n) * 100.0 / F.col(total), 4).alias(name)


def word_frequency(tokens: DataFrame, *, target: str = "word", lowercase: bool = True, pos: PosFilter | None = None, least: int = 1, most: int | None = None, kind: str = "all", value: str = "", stopwords: bool = False, exclude: Iterable[str] | str = ()) -> DataFrame:
    """(word, frequency, percentage, rank): counts, then the range, then stop words and the search; shares of what is left."""
    t = content(tokens) if "is_punct" in tokens.columns else tokens
    t = t.where(pos.tokens(F.col("pos"))) if pos else t
    word = F.lower(form(target)) if lowercase else form(target)
    counts = t.groupBy(word.alias("word")).agg(F.count("*").alias("frequency")).where(between("frequency", least, most))
    counts = counts.where(without_stopwords(F.col("word"), stopwords, exclude) & search(F.col("word"), kind, value))
    out = ranked(counts, F.desc("frequency"), F.asc("word"))
    total = out.agg(F.sum("frequency").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("word", "frequency", share("frequency", "total"), "rank")  # total is one row


def word_totals(tokens: DataFrame, **spec) -> DataFrame:
    """(total_tokens, unique_words): tokens before any filter, types after."""
    counts = word_frequency(tokens, **spec).agg(F.count("*").alias("unique_words"))
    return content(tokens).agg(F.count("*").alias("total_tokens")).crossJoin(F.broadcast(counts))


def ngrams(tokens: DataFrame, sizes: Iterable[int] = (2,), *, target: str = "word", lowercase: bool = True, pos: PosFilter | None = None, min_length: int = 1, cross_text: bool = False) -> DataFrame:
    """(n, ngram) occurrences: windows of consecutive words without punctuation, of each size in 2..6, else 2.

    Windows stay inside a text; cross_text runs over all texts joined in order of their ids, dealt out by
    stretches of the stream.
    """
    sizes = sorted({n for n in sizes if 2 <= n <= 6}) or [2]
    t = content(tokens) if "is_punct" in tokens.columns else tokens
    word = F.lower(form(target)) if lowercase else form(target)
    t = t.select("text_id", "tok_idx", word.alias("w"), *(["pos"] if pos else []))
    most = max(sizes)
    w = Window.partitionBy("text_id").orderBy("tok_idx")
    if cross_text:
        t, w = _stretches(t, most), Window.partitionBy("stretch").orderBy("place")
    ahead = lambda c: [F.lead(c, k).over(w).alias(f"{c}{k}") for k in range(1, most)]
    t = t.select("*", *ahead("w"), *(ahead("pos") if pos else []))
    out = None
    cases = []
    for n in sizes:
        parts = [F.col("w"), *(F.col(f"w{k}") for k in range(1, n))]
        ok = parts[-1].isNotNull()
        if min_length > 1:
            for p in parts:
                ok &= F.length(p) >= min_length
        if pos:
            ok &= pos.window(F.array("pos", *(f"pos{k}" for k in range(1, n))))
        cases.append(F.when(ok, F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *parts).alias("ngram"))))
    t = t.where("own") if cross_text else t
    return t.select(F.explode(F.array_compact(F.array(*cases))).alias("x")).select("x.*")


def _stretches(tokens: DataFrame, most: int, length: int = 1 << 16) -> DataFrame:
    """tokens with their place in the stream of all texts, by stretches of `length` places: the first most - 1
    tokens of a stretch also stand, not as its own, at the end of the one before.

    Only texts are put in order, by id with their numbers of tokens; a token's place is its text's offset and its
    own rank in the text. Tokens without a text come first, as one text.
    """
    sizes = tokens.groupBy("text_id").agg(F.count("*").alias("__n"))
    starts = offsets(sizes, "__n", F.asc_nulls_first("text_id")).select("text_id", F.col("offset").alias("__before"))
    t = tokens.withColumn("__nth", F.row_number().over(Window.partitionBy("text_id").orderBy("tok_idx"))).join(starts, "text_id", "left")
    place = F.coalesce("__before", F.lit(0)) + F.col("__nth")
    t = t.withColumn("place", place.cast("bigint")).drop("__nth", "__before").withColumn("at", F.floor((F.col("place") - 1) / length))
    early = (F.col("place") - 1) % length < most - 1
    t = t.withColumn("stretch", F.explode(F.when(early & (F.col("at") > 0), F.array("at", F.col("at") - 1)).otherwise(F.array("at"))))
    return t.withColumn("own", F.col("stretch") == F.col("at"))


def ngram_frequency(tokens: DataFrame, sizes: Iterable[int] = (2,), *, least: int = 1, most: int | None = None, kind: str = "all", value: str = "", exclude: Iterable[str] | str = (), **how) -> DataFrame:
    """(n, ngram, frequency, percentage, rank) over all sizes; searches see the n-gram, lists any of its words."""
    counts = ngrams(tokens, sizes, **how).groupBy("n", "ngram").agg(F.count("*").alias("frequency")).where(between("frequency", least, most))
    words = F.split("ngram", " ")
    if kind in ("wordlist", "contains_word") and value:
        counts = counts.where(F.arrays_overlap(words, F.array(*map(F.lit, lines_of(value)))))
    else:
        counts = counts.where(search(F.col("ngram"), kind, value))
    if dropped := lines_of(exclude):
        counts = counts.where(~F.arrays_overlap(words, F.array(*map(F.lit, dropped))))
    out = ranked(counts, F.desc("frequency"), F.asc("n"), F.asc("ngram"))
    total = out.agg(F.sum("frequency").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("n", "ngram", "frequency", share("frequency", "total"), "rank")  # total is one row


def nested_ngrams(counts: DataFrame) -> DataFrame:
    """(parent_n, parent, n, ngram, frequency): each shorter n-gram under the longer ones that hold it, word for word.

    Every longer n-gram emits its shorter windows and an equi-join finds them; no pair is tried that
    does not match.
    """
    words, size = F.split("ngram", " "), F.col("n")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    parents = counts.where("n > 2").select(size.alias("parent_n"), F.col("ngram").alias("parent"), F.explode(F.array_distinct(inner)).alias("ngram"))
    return parents.join(counts.select("n", "ngram", "frequency"), "ngram").select("parent_n", "parent", "n", "ngram", "frequency")
