"""Registered queries: keyness and keyword extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import keyness, keywords
from textloom.operators.predicates import without_stopwords
from textloom.operators.tokens import annotate, corpus_tokens
from textloom.plans.frequency import docs
from textloom.plans.sql import STOPS, TOKENS, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}

_CELLS = """, v AS (
  SELECT coalesce(s.word, r.word) AS word, coalesce(s.freq, 0)::BIGINT AS study_freq, coalesce(r.freq, 0)::BIGINT AS ref_freq,
         (SELECT sum(freq) FROM st)::DOUBLE AS n1, (SELECT sum(freq) FROM rf)::DOUBLE AS n2
  FROM st s FULL JOIN rf r ON s.word = r.word
), k AS (
  SELECT *, study_freq::DOUBLE AS o11, n1 - study_freq AS o12, ref_freq::DOUBLE AS o21, n2 - ref_freq AS o22, n1 + n2 AS n,
         n1 * (study_freq + ref_freq) / (n1 + n2) AS e11, n1 * (n1 + n2 - study_freq - ref_freq) / (n1 + n2) AS e12,
         n2 * (study_freq + ref_freq) / (n1 + n2) AS e21, n2 * (n1 + n2 - study_freq - ref_freq) / (n1 + n2) AS e22,
         study_freq / n1 * 1e6 AS a, ref_freq / n2 * 1e6 AS b,
         log2(((study_freq + 0.5) / (n1 + 1)) / ((ref_freq + 0.5) / (n2 + 1))) AS effect
  FROM v WHERE study_freq >= 3 OR ref_freq >= 3
)"""
_FORMULAS = {
    "log_likelihood": "2 * (" + " + ".join(f"(CASE WHEN o{c} > 0 AND e{c} > 0 THEN o{c} * ln(o{c} / e{c}) ELSE 0 END)" for c in (11, 12, 21, 22)) + ")",
    "chi_squared": " + ".join(f"(CASE WHEN e{c} > 0 THEN pow(abs(o{c} - e{c}) - 0.5, 2) / e{c} ELSE 0 END)" for c in (11, 12, 21, 22)),
    "log_ratio": "effect",
    "dice": "2.0 * o11 / (n1 + o11 + o21)",
    "mi": "CASE WHEN o11 > 0 THEN log2(o11 * n / (n1 * (o11 + o21))) ELSE 0 END",
    "mi3": "CASE WHEN o11 > 0 THEN log2(o11 * o11 * o11 * n / (n1 * (o11 + o21))) ELSE 0 END",
    "t_score": "CASE WHEN o11 > 0 THEN (o11 - n1 * (o11 + o21) / n) / sqrt(o11) ELSE 0 END",
    "simple": "CASE WHEN o21 > 0 THEN (o11 / n1) / (o21 / n2) ELSE o11 / n1 * 1e6 END",
}


def _keyness_sql(measure, cte, study, reference):
    tested = measure in ("log_likelihood", "chi_squared")
    p = "CASE WHEN raw >= 10.83 THEN 0.001 WHEN raw >= 6.64 THEN 0.01 WHEN raw >= 3.84 THEN 0.05 ELSE 1.0 END" if tested else "0.0"
    mark = "CASE WHEN raw >= 10.83 THEN '***' WHEN raw >= 6.64 THEN '**' WHEN raw >= 3.84 THEN '*' ELSE '' END" if tested else "''"
    return f"""WITH {cte}, st AS ({study}), rf AS ({reference}){_CELLS}
SELECT word, study_freq, ref_freq, round(a, 2) AS study_norm, round(b, 2) AS ref_norm, round(raw, 4)::DOUBLE AS score, CASE WHEN a >= b THEN 'positive' ELSE 'negative' END AS direction,
       round(effect, 4) AS effect_size, ({p})::DOUBLE AS p_value, {mark} AS significance FROM (SELECT *, ({_FORMULAS[measure]})::DOUBLE AS raw FROM k)"""




def _study(s, d, value):
    t = docs(s, d).join(s.read.parquet(f"{d}/labels.parquet").where(F.col("quality") == value).select("doc_id"), "doc_id")
    return keyness.counts(corpus_tokens(t))


_SIDE = "SELECT word, count(*) AS freq FROM words JOIN labels ON text_id = doc_id WHERE quality = {} GROUP BY 1"


def _keyness(measure):
    QUERIES[f"keyness_{measure}"] = lambda s, d: keyness.keyness(_study(s, d, 1), _study(s, d, 0), measure)
    if measure in _FORMULAS:
        SQL[f"keyness_{measure}"] = _keyness_sql(measure, WORDS, _SIDE.format(1), _SIDE.format(0))


for _m in ("log_likelihood", "chi_squared", "log_ratio", "dice", "mi", "mi3", "t_score", "simple", "fisher"):
    _keyness(_m)

QUERIES["keyness_positive"] = lambda s, d: keyness.keyness(_study(s, d, 1), _study(s, d, 0), negative=False, min_score=6.63, max_p=0.01, min_effect=0.5)
SQL["keyness_positive"] = f"SELECT * FROM ({_keyness_sql('log_likelihood', WORDS, _SIDE.format(1), _SIDE.format(0))}) WHERE direction = 'positive' AND abs(score) >= 6.63 AND p_value <= 0.01 AND abs(effect_size) >= 0.5"


def _resource(s, d):
    rows = corpus_tokens(s.read.parquet(f"{d}/benchmark.parquet").selectExpr("item_id as doc_id", "text", "'b' as source", "'en' as lang")).groupBy("word").agg(F.count("*").cast("string").alias("freq"))
    return keyness.resource_counts(rows, exclude=("and",), remove_stopwords=True)


QUERIES["keyness_resource"] = lambda s, d: keyness.keyness(keyness.counts(corpus_tokens(docs(s, d)).where(without_stopwords(F.col("word"), True))), _resource(s, d))
SQL["keyness_resource"] = _keyness_sql(
    "log_likelihood", WORDS + r", b AS (SELECT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS word FROM benchmark)",
    f"SELECT word, count(*) AS freq FROM words WHERE word NOT IN ({STOPS}) GROUP BY 1", f"SELECT word, count(*) AS freq FROM b WHERE word NOT IN ({STOPS}) GROUP BY 1",
)


def _terms(s, d):
    return corpus_tokens(docs(s, d)).where(without_stopwords(F.col("word"), True) & (F.length("word") > 1)).select("text_id", F.col("word").alias("term"))


QUERIES["tfidf_keywords"] = lambda s, d: keywords.tf_idf(_terms(s, d))
SQL["tfidf_keywords"] = f"""WITH {WORDS}, t AS (SELECT text_id, word AS term FROM words WHERE word NOT IN ({STOPS}) AND length(word) > 1),
tf AS (SELECT text_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT text_id) AS n FROM t),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS frequency FROM tf GROUP BY 1 ORDER BY frequency DESC, encode(term) LIMIT 150),
w AS (SELECT text_id, term, frequency, n, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
x AS (SELECT term, frequency, n, w / sqrt(sum(w * w) OVER (PARTITION BY text_id)) AS x FROM w)
SELECT term AS keyword, round(0.6 * sum(x) / max(n) + 0.4 * max(x), 4) AS score, frequency FROM x GROUP BY term, frequency ORDER BY score DESC, encode(keyword) LIMIT 50"""
QUERIES["tf_keywords"] = lambda s, d: keywords.term_share(_terms(s, d))
SQL["tf_keywords"] = f"""WITH {WORDS}, t AS (SELECT word FROM words WHERE word NOT IN ({STOPS}) AND length(word) > 1)
SELECT word AS keyword, round(count(*) / (SELECT count(*) FROM t), 4) AS score, count(*) AS frequency FROM t GROUP BY 1 ORDER BY score DESC, encode(keyword) LIMIT 50"""


def _rank_words(s, d):
    return corpus_tokens(docs(s, d)).where(without_stopwords(F.col("word"), True))


QUERIES["textrank_keywords"] = lambda s, d: keywords.text_rank(_rank_words(s, d))
SQL["textrank_keywords"] = f"""WITH RECURSIVE {WORDS}, t AS (SELECT text_id, tok_idx, word FROM words WHERE word NOT IN ({STOPS})),
p AS (SELECT word AS x, unnest([lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w]) AS y FROM t WINDOW w AS (PARTITION BY text_id ORDER BY tok_idx)),
e AS MATERIALIZED (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS weight FROM p WHERE y IS NOT NULL AND x != y GROUP BY 1, 2),
d AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e),
l AS MATERIALIZED (SELECT a, b, (weight / sum(weight) OVER (PARTITION BY a))::DOUBLE AS p FROM d UNION ALL SELECT DISTINCT a, a, 0.0::DOUBLE FROM d),
n AS MATERIALIZED (SELECT count(DISTINCT a) AS n FROM l),
r AS (SELECT 0 AS i, a, 1.0::DOUBLE / n AS r, 1e9::DOUBLE AS moved FROM (SELECT DISTINCT a FROM l), n UNION ALL
      SELECT i, a, r, sum(abs(r - last)) OVER () FROM (
        SELECT any_value(r.i) + 1 AS i, l.b AS a, any_value((1 - 0.85::DOUBLE) / n.n) + 0.85::DOUBLE * sum(l.p * r.r) AS r, max(CASE WHEN l.a = l.b THEN r.r END) AS last
        FROM l JOIN r USING (a), n WHERE r.i < 100 AND r.moved >= n.n * 1e-6::DOUBLE GROUP BY l.b))
SELECT a AS keyword, round(r, 6) AS score FROM r WHERE i = (SELECT max(i) FROM r) ORDER BY score DESC, encode(keyword) LIMIT 50"""
QUERIES["cooccurrence_pairs"] = lambda s, d: keywords.cooccurrences(_rank_words(s, d), 4)
SQL["cooccurrence_pairs"] = f"""WITH {WORDS}, t AS (SELECT text_id, tok_idx, word FROM words WHERE word NOT IN ({STOPS})),
p AS (SELECT word AS x, unnest([lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w]) AS y FROM t WINDOW w AS (PARTITION BY text_id ORDER BY tok_idx))
SELECT CASE WHEN encode(x) < encode(y) THEN x ELSE y END AS a, CASE WHEN encode(x) < encode(y) THEN y ELSE x END AS b, count(*) AS weight FROM p WHERE y IS NOT NULL AND x != y GROUP BY 1, 2"""
QUERIES["rake_keywords"] = lambda s, d: keywords.rake(annotate(docs(s, d)))
SQL["rake_keywords"] = f"""WITH {TOKENS}, t AS (SELECT *, is_punct OR word IN ({STOPS}) AS stop FROM tokens),
i AS (SELECT *, sum(stop::INT) OVER (PARTITION BY text_id ORDER BY tok_idx) AS island FROM t),
p AS (SELECT words, count(*) AS frequency FROM (SELECT list(word ORDER BY tok_idx) AS words FROM i WHERE NOT stop GROUP BY text_id, island) WHERE len(words) <= 5 GROUP BY 1),
e AS (SELECT words, frequency, unnest(words) AS word FROM p), s AS (SELECT word, sum(frequency * len(words)) / sum(frequency) AS s FROM e GROUP BY 1),
c AS (SELECT words, frequency, sum(s) AS raw FROM e JOIN s USING (word) GROUP BY 1, 2)
SELECT array_to_string(words, ' ') AS keyword, round(raw / (max(raw) OVER () + 0.001), 4) AS score, frequency FROM c ORDER BY score DESC, encode(keyword) LIMIT 50"""
QUERIES["yake_keywords"] = lambda s, d: keywords.yake(annotate(docs(s, d)))
QUERIES["yake_phrases"] = lambda s, d: keywords.yake_phrases(annotate(docs(s, d)))
