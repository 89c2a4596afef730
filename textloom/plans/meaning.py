"""Registered queries: semantic domains, metaphor, theme. Tags and marks are surrogates of the data, as the tokens are."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import metaphor, semantic, theme
from textloom.operators.predicates import PosFilter
from textloom.operators.tokens import annotate
from textloom.plans.frequency import docs
from textloom.plans.sql import TOKENS

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LETTERS = "ABCEFGHIKLMNOPQSTWXYZ"


def tagged(s, d):
    """Tokens with surrogate candidates, chosen tag, Penn-like tags and metaphor marks."""
    t = annotate(docs(s, d))
    n = F.length("word")
    letter = lambda i: F.substring(F.lit(_LETTERS), (i % 21 + 1).cast("int"), F.lit(1))
    first = F.concat(letter(n), (n % 4 + 1).cast("string"), F.when(F.col("word").endswith("th"), "+").otherwise(""))
    second = F.concat(letter(n + F.col("tok_idx")), F.lit("2.1"))
    tags = F.when(F.col("is_punct"), F.array(F.lit("PUNCT"))).when(F.col("word").endswith("tion"), F.array(F.concat(first, F.lit("/"), second, F.lit("_MWE")))).when(n % 3 == 0, F.array(first)).otherwise(F.array(first, second))
    penn = F.create_map(*(F.lit(x) for kv in {"NUM": "CD", "VERB": "VBD", "NOUN": "NN", "ADV": "RB", "ADJ": "JJ", "ADP": "IN", "DET": "DT", "PRON": "PRP", "PUNCT": "."}.items() for x in kv))
    mark = ~F.col("is_punct") & (F.col("tok_idx") % 7 == 0)
    source = F.when(F.col("tok_idx") % 2 == 0, "rule:x").when(F.col("tok_idx") % 3 == 0, "hitz").otherwise("odd")
    return t.withColumn("usas_tags", tags).withColumn("usas_tag", tags[0]).withColumn("tag", penn[F.col("pos")]).withColumn("is_metaphor", mark).withColumn("metaphor_source", source)


_TAGGED = f"""WITH {TOKENS.replace("left(pos, 2) || right(word, 1) AS tag", "CASE pos WHEN 'NUM' THEN 'CD' WHEN 'VERB' THEN 'VBD' WHEN 'NOUN' THEN 'NN' WHEN 'ADV' THEN 'RB' WHEN 'ADJ' THEN 'JJ' WHEN 'ADP' THEN 'IN' WHEN 'DET' THEN 'DT' WHEN 'PRON' THEN 'PRP' ELSE '.' END AS tag")}, c AS (
  SELECT *, substr('{_LETTERS}', (length(word) % 21 + 1)::INT, 1) || (length(word) % 4 + 1) || CASE WHEN word LIKE '%th' THEN '+' ELSE '' END AS t1, substr('{_LETTERS}', ((length(word) + tok_idx) % 21 + 1)::INT, 1) || '2.1' AS t2 FROM tokens
), t AS (
  SELECT *, CASE WHEN is_punct THEN ['PUNCT'] WHEN word LIKE '%tion' THEN [t1 || '/' || t2 || '_MWE'] WHEN length(word) % 3 = 0 THEN [t1] ELSE [t1, t2] END AS usas_tags,
         CASE WHEN is_punct THEN ['PUNCT'] WHEN word LIKE '%tion' THEN list_distinct_ordered([t1 || '_MWE', t2 || '_MWE']) WHEN length(word) % 3 = 0 OR t1 = t2 THEN [t1] ELSE [t1, t2] END AS cands,
         CASE WHEN is_punct THEN 'PUNCT' WHEN word LIKE '%tion' THEN t1 || '/' || t2 || '_MWE' ELSE t1 END AS usas_tag, NOT is_punct AND tok_idx % 7 = 0 AS is_metaphor,
         CASE WHEN tok_idx % 2 = 0 THEN 'rule' WHEN tok_idx % 3 = 0 THEN 'hitz' ELSE 'unknown' END AS source FROM c
)""".replace("list_distinct_ordered([t1 || '_MWE', t2 || '_MWE'])", "CASE WHEN t1 = t2 THEN [t1 || '_MWE'] ELSE [t1 || '_MWE', t2 || '_MWE'] END")
_DOMAINS = _TAGGED + """, d AS (SELECT text_id, tok_idx, word, is_metaphor, unnest(CASE WHEN word LIKE '%tion' THEN [t1 || '_MWE', t2 || '_MWE'] ELSE [t1] END) AS domain FROM t WHERE NOT is_punct)"""
_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in semantic.CATEGORIES.items()) + "}"
_NAMED = f"upper(left(domain, 1)) AS category, {_NAMES}[upper(left(domain, 1))] AS category_name"

QUERIES["semantic_domains"] = lambda s, d: semantic.domain_frequency(semantic.domains(tagged(s, d)), least=2)
SQL["semantic_domains"] = _DOMAINS + f""", n AS (SELECT domain, count(*) AS frequency FROM d GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT domain, array_to_string(list(word ORDER BY encode(word)), ' ') AS words FROM (SELECT domain, word, row_number() OVER (PARTITION BY domain ORDER BY encode(word)) AS nth FROM (SELECT DISTINCT domain, word FROM d)) WHERE nth <= 50 GROUP BY 1)
SELECT row_number() OVER (ORDER BY frequency DESC, encode(domain)) AS rank, domain, {_NAMED}, frequency, round(frequency * 100.0 / sum(frequency) OVER (), 4)::DOUBLE AS percentage, words FROM n JOIN w USING (domain)"""
QUERIES["semantic_words"] = lambda s, d: semantic.word_domains(semantic.domains(tagged(s, d), "contains", "th"), least=2)
SQL["semantic_words"] = _DOMAINS + f""", n AS (SELECT word, domain, count(*) AS frequency, bool_or(is_metaphor) AS is_metaphor FROM d WHERE contains(word, 'th') GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT row_number() OVER (ORDER BY frequency DESC, encode(word), encode(domain)) AS rank, word, domain, {_NAMED}, frequency, round(frequency * 100.0 / sum(frequency) OVER (), 4)::DOUBLE AS percentage, is_metaphor FROM n"""
QUERIES["semantic_domain_words"] = lambda s, d: semantic.domain_words(semantic.domains(tagged(s, d)), "G2+")
SQL["semantic_domain_words"] = _DOMAINS + " SELECT word, count(*) AS frequency, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS percentage FROM d WHERE domain = 'G2+' GROUP BY word"
_DIST = """, e AS (SELECT text_id, upper(left(unnest(cands), 1)) AS category FROM t), n AS (SELECT text_id, category, count(*) AS count FROM e GROUP BY 1, 2),
q AS (SELECT *, count / sum(count) OVER (PARTITION BY text_id) AS part, row_number() OVER (PARTITION BY text_id ORDER BY count DESC, category) AS nth FROM n)"""
QUERIES["semantic_distribution"] = lambda s, d: semantic.domain_distribution(tagged(s, d))
SQL["semantic_distribution"] = _TAGGED + _DIST + " SELECT text_id, category, count, round(part, 4)::DOUBLE AS share, nth = 1 AND part > 0.2 AS dominant FROM q"
_DISAMBIGUATED = _TAGGED + _DIST + """, main AS (SELECT text_id, category AS main FROM q WHERE nth = 1 AND part > 0.2), v AS (SELECT text_id, lower(lemma) AS low, cands[1] AS voted, count(*) AS n FROM t WHERE lemma != '' GROUP BY 1, 2, 3),
vv AS (SELECT text_id, low, voted FROM (SELECT *, n / sum(n) OVER (PARTITION BY text_id, low) AS part FROM v) WHERE part > 0.5),
j AS (SELECT t.*, list_filter(cands, lambda x: starts_with(replace(x, '_MWE', ''), 'B2'))[1] AS p1, list_filter(cands, lambda x: upper(left(x, 1)) = main)[1] AS p2, CASE WHEN list_contains(cands, voted) THEN voted END AS p3
  FROM t LEFT JOIN main USING (text_id) LEFT JOIN vv ON vv.text_id = t.text_id AND vv.low = lower(t.lemma)),
dis AS (SELECT * EXCLUDE (usas_tag), CASE WHEN len(cands) = 1 THEN cands[1] ELSE coalesce(p1, p2, p3, cands[1]) END AS usas_tag,
  CASE WHEN len(cands) = 1 THEN 'single' WHEN p1 IS NOT NULL THEN 'priority' WHEN p2 IS NOT NULL THEN 'domain' WHEN p3 IS NOT NULL THEN 'ospc' ELSE 'default' END AS method FROM j)"""
QUERIES["usas_disambiguation"] = lambda s, d: semantic.disambiguate(tagged(s, d), ("B2",)).groupBy("text_id", "usas_tag", "method").count().withColumnRenamed("count", "tokens")
SQL["usas_disambiguation"] = _DISAMBIGUATED + " SELECT text_id, usas_tag, method, count(*) AS tokens FROM dis GROUP BY ALL"
QUERIES["sense_propagation"] = lambda s, d: semantic.propagate_senses(semantic.disambiguate(tagged(s, d), ("B2",))).groupBy("text_id", "usas_tag", "propagated").count().withColumnRenamed("count", "tokens")
SQL["sense_propagation"] = _DISAMBIGUATED + """, pv AS (SELECT text_id, lower(lemma) AS low, usas_tag, count(*) AS n FROM dis WHERE lemma != '' AND NOT is_punct AND usas_tag != 'Z99' GROUP BY 1, 2, 3),
pm AS (SELECT text_id, low, usas_tag AS major FROM (SELECT *, sum(n) OVER (PARTITION BY text_id, low) AS total FROM pv) WHERE total >= 2 AND n / total > 0.6)
SELECT dis.text_id, coalesce(major, usas_tag) AS usas_tag, coalesce(major != usas_tag, false) AS propagated, count(*) AS tokens FROM dis LEFT JOIN pm ON pm.text_id = dis.text_id AND pm.low = lower(dis.lemma) GROUP BY ALL"""


def _accuracy(s, d):
    f = semantic.domains(tagged(s, d)).groupBy(F.concat_ws("|", "word", "domain").alias("tag"), (F.col("text_id") % 2).alias("half")).agg(F.count("*").alias("freq"))
    return semantic.tag_accuracy(f.where("half = 0"), f.where("half = 1"))


QUERIES["tag_accuracy"] = _accuracy
SQL["tag_accuracy"] = _DOMAINS + """, f AS (SELECT word || '|' || domain AS tag, count(*) FILTER (text_id % 2 = 0) AS a, count(*) FILTER (text_id % 2 = 1) AS b FROM d GROUP BY 1)
SELECT sum(least(a, b))::BIGINT AS matched, sum(a)::BIGINT AS total, round(sum(least(a, b)) * 100.0 / sum(a), 2)::DOUBLE AS accuracy FROM f"""

_COUNTED = _TAGGED + r", k AS (SELECT * FROM t WHERE regexp_matches(word, '^\p{L}+$'))"
QUERIES["metaphor_words"] = lambda s, d: metaphor.metaphor_words(tagged(s, d), pos=PosFilter(("NOUN", "VERB", "ADJ")), least=2)
SQL["metaphor_words"] = _COUNTED + """, p AS (SELECT * FROM k WHERE pos IN ('NOUN', 'VERB', 'ADJ')), n AS (SELECT word, is_metaphor, count(*) AS frequency, arg_max(lemma, (text_id, tok_idx)) AS lemma, arg_max(pos, (text_id, tok_idx)) AS pos FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT word, is_metaphor, arg_min(source, (-n, source)) AS source FROM (SELECT word, is_metaphor, source, count(*) AS n FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY frequency DESC, encode(word), is_metaphor) AS rank, word, is_metaphor, frequency, round(frequency * 100.0 / (SELECT count(*) FROM p), 4)::DOUBLE AS percentage, source, lemma, pos FROM n JOIN m USING (word, is_metaphor)"""
QUERIES["metaphor_statistics"] = lambda s, d: metaphor.metaphor_statistics(tagged(s, d))
SQL["metaphor_statistics"] = _COUNTED + " SELECT count(*) AS total_tokens, count(*) FILTER (is_metaphor) AS metaphor_tokens, count(*) FILTER (NOT is_metaphor) AS literal_tokens, round(count(*) FILTER (is_metaphor) / count(*), 4) AS metaphor_rate FROM k"
QUERIES["metaphor_sources"] = lambda s, d: metaphor.metaphor_sources(tagged(s, d))
SQL["metaphor_sources"] = _COUNTED + " SELECT source, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS percentage FROM k WHERE is_metaphor GROUP BY source"
QUERIES["metaphor_contexts"] = lambda s, d: metaphor.word_contexts(tagged(s, d), True)
SQL["metaphor_contexts"] = _COUNTED + """, m AS (SELECT * FROM k WHERE is_metaphor), x AS (SELECT word, text_id, sent_idx, row_number() OVER (PARTITION BY word ORDER BY text_id, sent_idx) AS nth FROM (SELECT DISTINCT word, text_id, sent_idx FROM m)),
y AS (SELECT word, array_to_string(list(text_id || ':' || sent_idx ORDER BY nth), ' ') AS contexts FROM x WHERE nth <= 3 GROUP BY 1) SELECT word, count(*) AS frequency, any_value(contexts) AS contexts FROM m JOIN y USING (word) GROUP BY word"""
QUERIES["mipvu_rules"] = lambda s, d: metaphor.literal_rules(tagged(s, d), ("thing", "erth")).groupBy("literal_rule").count().withColumnRenamed("count", "tokens")
SQL["mipvu_rules"] = _TAGGED + """, r AS (SELECT CASE WHEN word IN ('thing', 'erth') THEN 'filter' WHEN tag IN ('CD', 'NNP', 'NNPS', 'SYM') THEN 'pos_' || tag WHEN word = 'to' AND lead(tag) OVER (PARTITION BY text_id, sent_idx ORDER BY tok_idx) LIKE 'VB%' THEN 'infinitive_to'
  WHEN dep = 'agent' OR (dep = 'det' AND word IN ('the', 'a', 'an', 'some', 'no', 'any')) OR (dep = 'advmod' AND word IN ('so', 'just', 'when', 'very', 'only', 'really', 'too', 'more')) THEN 'dep_word_' || dep || '_' || word END AS literal_rule FROM t)
SELECT literal_rule, count(*) AS tokens FROM r GROUP BY 1"""
QUERIES["theme_rheme"] = lambda s, d: theme.themes(annotate(docs(s, d)))
SQL["theme_rheme"] = f"""WITH {TOKENS}, x AS (SELECT *, dep IN ('nsubj', 'nsubjpass', 'csubj', 'expl') OR pos IN ('NOUN', 'PROPN', 'PRON', 'NUM') OR (dep = 'ROOT' AND pos = 'VERB') AS closes FROM tokens),
s AS (SELECT text_id, sent_idx, min(tok_idx) FILTER (NOT is_punct AND closes) AS c, arg_min(pos, tok_idx) FILTER (NOT is_punct AND closes) AS cpos, min(tok_idx) FILTER (NOT is_punct) AS f, max(tok_idx) AS l FROM x GROUP BY 1, 2),
a AS (SELECT *, coalesce(c, f) AS pt FROM s WHERE f IS NOT NULL),
b AS (SELECT a.text_id, a.sent_idx, any_value(pt) AS pt, CASE WHEN any_value(cpos) IS NOT NULL AND any_value(cpos) != 'VERB' THEN coalesce(min(x.tok_idx) FILTER (x.tok_idx > pt AND x.dep NOT IN ('compound', 'flat', 'amod', 'acomp', 'det', 'nummod', 'poss', 'case', 'prep', 'pobj')) - 1, any_value(l)) ELSE any_value(pt) END AS boundary
  FROM a JOIN x ON x.text_id = a.text_id AND x.sent_idx = a.sent_idx GROUP BY 1, 2)
SELECT text_id, sent_idx, boundary::INT AS boundary, theme, CASE WHEN length(rheme) > 1 THEN rheme ELSE '' END AS rheme, has_textual FROM (
  SELECT b.text_id, b.sent_idx, any_value(boundary) AS boundary, coalesce(string_agg(x.text, ' ' ORDER BY x.tok_idx) FILTER (x.tok_idx <= boundary), '') AS theme, coalesce(string_agg(x.text, ' ' ORDER BY x.tok_idx) FILTER (x.tok_idx > boundary), '') AS rheme,
         bool_or(x.tok_idx < pt AND (x.dep IN ('cc', 'mark', 'advmod') OR x.pos IN ('CCONJ', 'SCONJ', 'ADV'))) AS has_textual FROM b JOIN x ON x.text_id = b.text_id AND x.sent_idx = b.sent_idx GROUP BY 1, 2)"""
