"""Registered queries: word frequencies and n-grams over `documents`."""

from __future__ import annotations

from textloom.operators import freq
from textloom.operators.predicates import PosFilter
from textloom.operators.tokens import annotate, corpus_tokens
from textloom.plans.sql import STOPS, TOKENS, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _frequency(name, tokens, cte, source, key, where="true", having="true", after="true", **spec):
    QUERIES[name] = lambda s, d: freq.word_frequency(tokens(docs(s, d)), **spec)
    SQL[name] = f"""WITH {cte}, c AS (SELECT {key} AS word, count(*) AS frequency FROM {source} WHERE {where} GROUP BY 1 HAVING {having})
SELECT word, frequency, round(frequency * 100.0 / sum(frequency) OVER (), 4)::DOUBLE AS percentage, row_number() OVER (ORDER BY frequency DESC, encode(word)) AS rank
FROM c WHERE {after}"""


_frequency("word_frequency", corpus_tokens, WORDS, "words", "word")
_frequency("word_frequency_range_stopwords", corpus_tokens, WORDS, "words", "word", having="count(*) BETWEEN 3 AND 500", after=f"word NOT IN ({STOPS}, 'thing')", least=3, most=500, stopwords=True, exclude="Thing\n")
_frequency("word_frequency_starts", corpus_tokens, WORDS, "words", "word", after="word LIKE 'th%'", kind="starts", value="TH")
_frequency("word_frequency_ends", corpus_tokens, WORDS, "words", "word", after="word LIKE '%ing'", kind="ends", value="ing")
_frequency("word_frequency_contains", corpus_tokens, WORDS, "words", "word", after="word LIKE '%tion%'", kind="contains", value="tion")
_frequency("word_frequency_regex", corpus_tokens, WORDS, "words", "word", after="regexp_matches(word, '^(the|an).*(ing|ed)$')", kind="regex", value="^(the|an).*(ing|ed)$")
_frequency("word_frequency_wordlist", corpus_tokens, WORDS, "words", "word", after="word IN ('the', 'of', 'and', 'und', 'que')", kind="wordlist", value="the\nof\nAnd\nund\nque")
_frequency("word_frequency_case", corpus_tokens, WORDS, "words", "text", lowercase=False)
_frequency("word_frequency_lemma_pos", annotate, TOKENS, "tokens", "lemma", where="pos IN ('NOUN', 'VERB')", target="lemma", pos=PosFilter(("NOUN", "VERB")))
_frequency("word_frequency_pos_drop", annotate, TOKENS, "tokens", "word", where="NOT is_punct AND pos NOT IN ('DET', 'NUM')", pos=PosFilter(("DET", "NUM"), keep=False))

QUERIES["word_totals"] = lambda s, d: freq.word_totals(annotate(docs(s, d)), least=2)
SQL["word_totals"] = f"""WITH {WORDS} SELECT (SELECT count(*) FROM words) AS total_tokens, (SELECT count(*) FROM (SELECT word FROM words GROUP BY word HAVING count(*) >= 2)) AS unique_words"""


def _lead(n):
    return " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, n))])


def _ngram_sql(sizes, source="words", least=1, where="true", after="true"):
    grams = " UNION ALL ".join(f"SELECT {n} AS n, {_lead(n)} AS ngram, text_id, tok_idx FROM {source} WINDOW w AS (PARTITION BY text_id ORDER BY tok_idx)" for n in sizes)
    return f""", g AS ({grams}), c AS (SELECT n, ngram, count(*) AS frequency FROM g WHERE ngram IS NOT NULL AND {where} GROUP BY n, ngram HAVING count(*) >= {least})"""


_NGRAM_OUT = " SELECT n, ngram, frequency, round(frequency * 100.0 / sum(frequency) OVER (), 4)::DOUBLE AS percentage, row_number() OVER (ORDER BY frequency DESC, n, encode(ngram)) AS rank FROM c WHERE "


def _ngrams(name, sizes, least=1, after="true", **spec):
    QUERIES[name] = lambda s, d: freq.ngram_frequency(corpus_tokens(docs(s, d)), sizes, least=least, **spec)
    SQL[name] = "WITH " + WORDS + _ngram_sql(sizes, least=least) + _NGRAM_OUT + after


_ngrams("ngram_2", (2,), least=2)
_ngrams("ngram_multi", (2, 3, 4, 5, 6), least=3)
_ngrams("ngram_search", (2, 3), least=2, after="list_has_any(string_split(ngram, ' '), ['the', 'of']) AND NOT list_has_any(string_split(ngram, ' '), ['and'])", kind="wordlist", value="the\nof", exclude=["and"])
_ngrams("ngram_search_regex", (2,), least=2, after="regexp_matches(ngram, '^the .*ing$')", kind="regex", value="^the .*ing$")

QUERIES["ngram_cross_text"] = lambda s, d: freq.ngram_frequency(corpus_tokens(docs(s, d).repartition("doc_id")), (2, 3), least=2, cross_text=True)  # texts are dealt out, not tokens
SQL["ngram_cross_text"] = "WITH " + WORDS + _ngram_sql((2, 3), least=2).replace("PARTITION BY text_id ORDER BY tok_idx", "ORDER BY text_id, tok_idx") + _NGRAM_OUT + "true"

QUERIES["ngram_pos_filter"] = lambda s, d: freq.ngram_frequency(annotate(docs(s, d)), (2,), least=2, pos=PosFilter(("NOUN", "VERB", "ADJ")), min_length=3)
SQL["ngram_pos_filter"] = f"""WITH {TOKENS}, g AS (
  SELECT 2 AS n, word || ' ' || lead(word) OVER w AS ngram, least(length(word), length(lead(word) OVER w)) AS short, pos IN ('NOUN', 'VERB', 'ADJ') AND lead(pos) OVER w IN ('NOUN', 'VERB', 'ADJ') AS ok
  FROM tokens WHERE NOT is_punct WINDOW w AS (PARTITION BY text_id ORDER BY tok_idx)
), c AS (SELECT n, ngram, count(*) AS frequency FROM g WHERE ok AND short >= 3 GROUP BY n, ngram HAVING count(*) >= 2)""" + _NGRAM_OUT + "true"

QUERIES["ngram_nested"] = lambda s, d: freq.nested_ngrams(freq.ngram_frequency(corpus_tokens(docs(s, d)), (2, 3, 4), least=4))
SQL["ngram_nested"] = "WITH " + WORDS + _ngram_sql((2, 3, 4), least=4) + """
SELECT p.n AS parent_n, p.ngram AS parent, c.n, c.ngram, c.frequency FROM c p JOIN c ON c.n < p.n AND contains(' ' || p.ngram || ' ', ' ' || c.ngram || ' ')"""
