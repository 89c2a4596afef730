"""Shared common table expressions of the DuckDB equivalents."""

from __future__ import annotations

from textloom.operators.tokens import STOPWORDS

STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)

#: Word tokens: text_id, corpus, lang, tok_idx, word.
WORDS = r"""words AS (
  SELECT text_id, corpus, lang, tok_idx, lower(text) AS word, text FROM (
    SELECT doc_id AS text_id, source AS corpus, lang, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS tok_idx
    FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws FROM documents)))"""

#: The surrogate annotation.
TOKENS = r"""raw AS (
  SELECT text_id, corpus, lang, tok_idx, text, lower(text) AS word, NOT regexp_matches(text, '^[\p{L}\p{N}_]') AS is_punct FROM (
    SELECT doc_id AS text_id, source AS corpus, lang, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS tok_idx
    FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS ws FROM documents))
), tagged AS (
  SELECT *, CASE WHEN length(word) > 4 AND word LIKE '%ing' THEN left(word, length(word) - 3)
                 WHEN length(word) > 4 AND (word LIKE '%ed' OR word LIKE '%ly') THEN left(word, length(word) - 2)
                 WHEN length(word) > 4 AND word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS lemma,
         CASE WHEN is_punct THEN 'PUNCT' WHEN regexp_matches(word, '^\p{N}+$') THEN 'NUM'
              WHEN word IN ('i', 'he', 'it', 'we', 'she', 'you', 'they') THEN 'PRON' WHEN word IN ('of', 'for', 'by', 'with', 'on', 'in', 'to') THEN 'ADP' WHEN word LIKE '%ly' THEN 'ADV'
              WHEN word LIKE '%ed' OR word LIKE '%ing' THEN 'VERB' WHEN word LIKE '%ion' OR word LIKE '%er' OR word LIKE '%s' THEN 'NOUN'
              WHEN length(word) <= 3 THEN 'DET' ELSE 'ADJ' END AS pos,
         coalesce(sum((text IN ('.', '!', '?'))::INT) OVER (PARTITION BY text_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sent_idx
  FROM raw
), headed AS (
  SELECT *, coalesce(last_value(CASE WHEN pos = 'VERB' THEN tok_idx END IGNORE NULLS) OVER (PARTITION BY text_id, sent_idx ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), tok_idx) AS head FROM tagged
), tokens AS (
  SELECT *, CASE WHEN is_punct THEN 'punct' WHEN pos = 'VERB' THEN CASE WHEN head = tok_idx THEN 'ROOT' ELSE 'conj' END
                 WHEN pos IN ('NOUN', 'PRON') THEN CASE WHEN head = tok_idx THEN 'nsubj' ELSE 'dobj' END
                 WHEN pos = 'ADP' THEN CASE WHEN head = tok_idx THEN 'case' WHEN word IN ('on', 'in', 'to') THEN 'prt' ELSE 'prep' END
                 WHEN pos = 'ADV' THEN 'advmod' WHEN pos = 'ADJ' THEN CASE WHEN head = tok_idx THEN 'amod' ELSE 'acomp' END ELSE 'det' END AS dep,
         left(pos, 2) || right(word, 1) AS tag
  FROM headed
)"""
