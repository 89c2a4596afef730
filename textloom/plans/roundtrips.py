"""Registered queries: what is written, read back; validation of patterns made of the documents' words; rules held against whole tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import stats
from textloom.operators import catalog, cql, freq, sketch
from textloom.operators.tokens import annotate, corpus_tokens
from textloom.plans import frequency, keys, sketches
from textloom.plans.frequency import docs
from textloom.plans.sql import TOKENS
from textloom.runtime import shared_dir
from textloom.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _path(s, name):
    return f"{shared_dir(s)}/textloom/{name}-{uuid.uuid4().hex}"


def _tokens(s, d):
    """The token table, a folder per corpus; the reader sees the corpus in the folders' names."""
    path = _path(s, "tokens")
    writers.write_tokens(annotate(docs(s, d)), path)
    return s.read.parquet(path).select("text_id", F.col("corpus").cast("string").alias("corpus"), "tok_idx", "sent_idx", "word", "lemma", "pos", "head", "dep")


QUERIES["tokens_written"] = _tokens
SQL["tokens_written"] = f"WITH {TOKENS} SELECT text_id, corpus, tok_idx::INT AS tok_idx, sent_idx, word, lemma, pos, head::INT AS head, dep FROM tokens"


def _frequencies(s, d):
    path = _path(s, "lists") + "/documents_words.csv"
    writers.write_frequencies(writers.build_frequencies(annotate(docs(s, d)).where("not is_punct")), path)
    return readers.read_frequencies(s, path).select("word", "lemma", "pos", "freq")


QUERIES["frequencies_written"] = _frequencies
SQL["frequencies_written"] = f"WITH {TOKENS} SELECT word, lower(lemma) AS lemma, pos, count(*) AS freq FROM tokens WHERE NOT is_punct GROUP BY ALL"


def _exported(s, d):
    path = _path(s, "export")
    counts = freq.word_frequency(corpus_tokens(docs(s, d)))
    writers.write_table(counts.withColumn("letters", F.split("word", "")), path, "tsv")
    back = s.read.csv(path, header=True, sep="\t", schema="word string, frequency bigint, percentage double, rank bigint, letters string")
    return back.select("word", "frequency", "percentage", "rank", F.size(F.from_json("letters", "array<string>")).alias("letters"))


QUERIES["results_exported"] = _exported
SQL["results_exported"] = f"SELECT *, length(word)::INT AS letters FROM ({frequency.SQL['word_frequency']})"


def _inserted(s, d):
    """A library of two thirds of the parts takes in half of them: those it lacks, each once, and each of those without a number."""
    p = s.read.parquet(f"{d}/part.parquet").select(F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey").cast("string")).alias("unique_id"), "p_partkey", "p_name")
    old = p.where("p_partkey % 3 != 0").select("unique_id", F.col("p_name").alias("title"))
    new = p.where("p_partkey % 2 = 0").select("unique_id", F.concat(F.lit("new "), "p_name").alias("title"))
    return catalog.append_new(old, new.unionByName(new.where("title LIKE '%s%'")))


QUERIES["biblio_inserted"] = _inserted
SQL["biblio_inserted"] = """WITH p AS (SELECT CASE WHEN p_partkey % 10 != 0 THEN p_partkey::VARCHAR END AS unique_id, p_partkey, p_name FROM part)
SELECT unique_id, p_name AS title FROM p WHERE p_partkey % 3 != 0
UNION ALL SELECT unique_id, 'new ' || p_name FROM p WHERE p_partkey % 2 = 0 AND (unique_id IS NULL OR p_partkey % 3 = 0)
UNION ALL SELECT NULL, 'new ' || p_name FROM p WHERE p_partkey % 10 = 0 AND p_name LIKE '%s%'"""


@F.pandas_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("pattern_count", T.IntegerType())]))
def _validated(queries: pd.Series) -> pd.DataFrame:
    found = [cql.validate(q) for q in queries]
    return pd.DataFrame({"valid": [f["valid"] for f in found], "pattern_count": [f["pattern_count"] for f in found]})


def _patterns(s, d):
    """A pattern of each document's first word, right or wrong by its number."""
    w = F.regexp_extract("text", r"[a-z]+", 0)
    forms = [F.concat(F.lit('[word="'), w, F.lit('"] []{0,2} [pos="NOUN"]')), F.concat(F.lit('"'), w, F.lit('"')), F.concat(F.lit('[word="'), w, F.lit('"')), F.concat(F.lit("["), w, F.lit('x="1"]')), F.concat(F.lit('[lemma="'), w, F.lit('" & pos!="AUX"]? [word="x"]'))]
    t = s.read.parquet(f"{d}/documents.parquet").where(F.col("text").rlike("[a-z]"))
    pattern = F.get(F.array(*forms), (F.col("doc_id") % 5).cast("int"))
    return t.select("doc_id", _validated(pattern).alias("x")).select("doc_id", "x.valid", "x.pattern_count")


QUERIES["cql_validate_documents"] = _patterns
SQL["cql_validate_documents"] = "SELECT doc_id, ([true, true, false, false, true])[doc_id % 5 + 1] AS valid, ([3, 1, 0, 0, 2])[doc_id % 5 + 1]::INT AS pattern_count FROM documents WHERE regexp_matches(text, '[a-z]')"


def _options(s, d):
    """Each part of speech's relations, and how many instances the corpus has of them."""
    options = s.createDataFrame([(c, r) for c in dict.fromkeys(p[0] for p in sketch.patterns()) for r in sketch.relation_names(c)], "word1_pos string, relation string")
    n = sketch.relations(annotate(docs(s, d), 4)).groupBy("word1_pos", "relation").agg(F.count("*").alias("instances"))
    return options.join(n, ["word1_pos", "relation"], "left").select(F.col("word1_pos").alias("center_pos"), "relation", F.coalesce("instances", F.lit(0)).alias("instances"))


QUERIES["sketch_options_used"] = _options
SQL["sketch_options_used"] = sketches._BASE + """, o AS (SELECT center_pos, relation FROM p UNION SELECT 'VERB', 'usage_patterns' UNION SELECT 'NOUN', 'noun_usage_patterns'), n AS (SELECT word1_pos, relation, count(*) AS instances FROM relations GROUP BY ALL)
SELECT center_pos, o.relation, coalesce(instances, 0) AS instances FROM o LEFT JOIN n ON word1_pos = center_pos AND n.relation = o.relation"""


_MEASURES = [m for m in sorted(stats.THRESHOLDS) if f"keyness_{m}" in keys.SQL]


def _thresholds(s, d):
    """How many words of one corpus against another reach each measure's own threshold, of all that it scores."""
    out = None
    for m in _MEASURES:
        reach = F.count_if(F.abs("score") >= stats.THRESHOLDS[m])
        one = keys.QUERIES[f"keyness_{m}"](s, d).agg(F.lit(m).alias("measure"), F.count("*").alias("words"), reach.alias("reach"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["thresholds_reached"] = _thresholds
# The least score that counts, by measure.
_LEAST = {"chi_squared": 6.63, "dice": 0.0, "fisher": 2.0, "log_likelihood": 6.63, "log_ratio": 1.0, "mi": 0.0, "mi3": 0.0, "simple": 0.0, "t_score": 1.96}
SQL["thresholds_reached"] = " UNION ALL ".join(f"SELECT '{m}' AS measure, count(*) AS words, count(*) FILTER (abs(score) >= {_LEAST[m]}) AS reach FROM ({keys.SQL[f'keyness_{m}']})" for m in _MEASURES)
