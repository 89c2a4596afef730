"""Registered queries: inter-coder reliability. Three surrogate coders mark runs of tokens; a token counts as a character."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import reliability as rel
from textloom.operators.tokens import corpus_tokens
from textloom.plans.frequency import docs
from textloom.plans.sql import WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}
CODERS = ["1", "2", "3"]


def _texts(s, d):
    """Documents dealt out by text, so that spans and segments are not shuffled, to tasks small enough to sort them in memory."""
    return docs(s, d).repartition(4 * int(s.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def spans(s, d):
    t = corpus_tokens(_texts(s, d)).select(F.col("text_id").alias("doc_id"), F.col("tok_idx").alias("start"), F.length("word").alias("n"))
    t = t.withColumn("coder", F.explode(F.array(*map(F.lit, CODERS)))).withColumn("k", F.col("coder").cast("int"))
    label = F.when((F.col("n") + F.when(F.col("start") % 4 == 0, F.col("k")).otherwise(0)) % 5 == 0, "A").when(F.col("n") % 7 == F.when(F.col("start") % 6 == 0, F.col("k")).otherwise(1), "B")
    return t.withColumn("label", label).where("label is not null").select("doc_id", "coder", "start", (F.col("start") + 1 + F.when(F.col("label") == "B", F.col("k") % 2).otherwise(0)).alias("end"), "label")


def lengths(s, d):
    return corpus_tokens(_texts(s, d)).groupBy(F.col("text_id").alias("doc_id")).agg(F.count("*").cast("int").alias("n_chars"))


_SPANS = f"""WITH {WORDS}, k(coder) AS (VALUES ('1'), ('2'), ('3')), x AS (SELECT text_id AS doc_id, coder, tok_idx AS start, length(word) AS n, coder::INT AS k FROM words, k),
y AS (SELECT *, CASE WHEN (n + CASE WHEN start % 4 = 0 THEN k ELSE 0 END) % 5 = 0 THEN 'A' WHEN n % 7 = CASE WHEN start % 6 = 0 THEN k ELSE 1 END THEN 'B' END AS label FROM x),
spans AS (SELECT doc_id, coder, start::INT AS start, (start + 1 + CASE WHEN label = 'B' THEN k % 2 ELSE 0 END)::INT AS "end", label FROM y WHERE label IS NOT NULL)"""
_RATINGS = _SPANS + """, chars AS (SELECT text_id AS doc_id, coder, tok_idx AS pos FROM words, k),
marks AS (SELECT DISTINCT doc_id, coder, unnest(range(start, "end")) AS pos, label FROM spans),
r AS (SELECT c.doc_id, c.coder, c.pos, (bool_or(coalesce(m.label = 'A', false)))::INT::VARCHAR || (bool_or(coalesce(m.label = 'B', false)))::INT::VARCHAR AS category FROM chars c LEFT JOIN marks m USING (doc_id, coder, pos) GROUP BY 1, 2, 3)"""
_PAIRS = _RATINGS + ", p AS (SELECT a.coder AS coder1, b.coder AS coder2, a.category AS c1, b.category AS c2, count(*)::DOUBLE AS n FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.coder < b.coder GROUP BY ALL)"


def _rated(f, *args):
    return lambda s, d: f(rel.ratings(spans(s, d), lengths(s, d), CODERS), *args)


QUERIES["percent_agreement"] = _rated(rel.percent_agreement)
SQL["percent_agreement"] = _PAIRS + " SELECT coder1, coder2, round(sum(n) FILTER (c1 = c2) * 100.0 / sum(n), 4) AS agreement FROM p GROUP BY 1, 2"
QUERIES["cohens_kappa"] = _rated(rel.cohens_kappa)
SQL["cohens_kappa"] = _PAIRS + """, t AS (SELECT coder1, coder2, sum(n) AS total, sum(n) FILTER (c1 = c2) AS same FROM p GROUP BY 1, 2), a AS (SELECT coder1, coder2, c1 AS c, sum(n) AS m1 FROM p GROUP BY ALL), b AS (SELECT coder1, coder2, c2 AS c, sum(n) AS m2 FROM p GROUP BY ALL),
e AS (SELECT coder1, coder2, sum(m1 * m2) AS both_ FROM a JOIN b USING (coder1, coder2, c) GROUP BY 1, 2), kap AS (SELECT coder1, coder2, (same / total - both_ / (total * total)) / (1 - both_ / (total * total)) AS k FROM t JOIN e USING (coder1, coder2))
SELECT coder1, coder2, round(k, 4) AS kappa, CASE WHEN k >= 0.8 THEN 'almost perfect' WHEN k >= 0.6 THEN 'substantial' WHEN k >= 0.4 THEN 'moderate' WHEN k >= 0.2 THEN 'fair' WHEN k >= 0 THEN 'slight' ELSE 'poor' END AS band FROM kap"""
QUERIES["fleiss_kappa"] = _rated(rel.fleiss_kappa)
SQL["fleiss_kappa"] = _RATINGS + """, u AS (SELECT doc_id, pos, category, count(*)::DOUBLE AS n FROM r GROUP BY ALL), p AS (SELECT avg(x) AS p FROM (SELECT sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS x FROM u GROUP BY doc_id, pos)),
e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS pe FROM (SELECT category, sum(n) AS n FROM u GROUP BY 1)) SELECT round(p, 4) AS p, round(pe, 4) AS pe, round((p - pe) / (1 - pe), 4) AS kappa FROM p, e"""
_ALPHA = _RATINGS + """, pr AS (SELECT a.category AS c, b.category AS k, sum(1.0 / 2) AS o FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.coder != b.coder GROUP BY 1, 2), o AS (SELECT c, k, o::DOUBLE AS o FROM pr),
m AS (SELECT c, sum(o) AS n FROM o GROUP BY 1), i AS (SELECT c, n, row_number() OVER (ORDER BY c) - 1 AS i, sum(n) OVER (ORDER BY c) - n AS below FROM m),
g AS (SELECT a.n AS cn, b.n AS kn, a.i AS ci, b.i AS ki, abs(a.below - b.below) + CASE WHEN a.i > b.i THEN a.n ELSE b.n END - (a.n + b.n) / 2 AS spread, coalesce(o.o, 0) AS o FROM i a CROSS JOIN i b LEFT JOIN o ON o.c = a.c AND o.k = b.c),
dd AS (SELECT CASE WHEN ci = ki THEN 0.0 ELSE {delta} END::DOUBLE AS d, * FROM g), s AS (SELECT sum(o * d) / (SELECT sum(n) FROM m) AS do_, sum(cn * kn * d) / ((SELECT sum(n) FROM m) * ((SELECT sum(n) FROM m) - 1)) AS de FROM dd)
SELECT '{level}' AS level, round(1 - do_ / de, 4) AS alpha, round(do_, 4) AS observed, round(de, 4) AS expected FROM s"""
for _level, _delta in (("nominal", "1.0"), ("ordinal", "spread * spread"), ("interval", "(ci - ki) * (ci - ki)"), ("ratio", "((ci - ki) / (ci + ki)) * ((ci - ki) / (ci + ki))")):
    QUERIES[f"krippendorff_{_level}"] = _rated(rel.krippendorff_alpha, _level)
    SQL[f"krippendorff_{_level}"] = _ALPHA.replace("{delta}", _delta).replace("{level}", _level)
QUERIES["precision_recall"] = lambda s, d: rel.precision_recall(spans(s, d), "1")
SQL["precision_recall"] = _SPANS + """, g AS (SELECT DISTINCT doc_id, start, "end", label FROM spans WHERE coder = '1'), h AS (SELECT DISTINCT coder, doc_id, start, "end", label FROM spans WHERE coder != '1'),
gg AS (SELECT coder, g.* FROM g, (SELECT DISTINCT coder FROM h)), j AS (SELECT coalesce(h.coder, gg.coder) AS coder, coalesce(h.label, gg.label) AS label, h.coder IS NOT NULL AS hit, gg.coder IS NOT NULL AS gold FROM h FULL JOIN gg ON h.coder = gg.coder AND h.doc_id = gg.doc_id AND h.start = gg.start AND h."end" = gg."end" AND h.label = gg.label),
n AS (SELECT coder, coalesce(label, '*') AS label, count(*) FILTER (hit AND gold) AS tp, count(*) FILTER (NOT gold) AS fp, count(*) FILTER (NOT hit) AS fn FROM j GROUP BY GROUPING SETS ((coder, label), (coder))),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM n)
SELECT coder, label, tp, fp, fn, round(p, 4)::DOUBLE AS "precision", round(r, 4)::DOUBLE AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 4) ELSE 0 END::DOUBLE AS f1 FROM m"""
QUERIES["annotation_units"] = lambda s, d: rel.unit_table(spans(s, d), 3)
SQL["annotation_units"] = _SPANS + """ SELECT doc_id, start, "end", arg_min(label, (coder, label)) AS label, count(DISTINCT coder) AS coders, round(count(DISTINCT coder) / 3, 4)::DOUBLE AS rate, count(DISTINCT label) = 1 AS agreed FROM spans GROUP BY 1, 2, 3"""
QUERIES["position_details"] = lambda s, d: rel.position_details(spans(s, d), CODERS)
SQL["position_details"] = _SPANS + """, u AS (SELECT DISTINCT doc_id, start, "end" FROM spans), f AS (SELECT doc_id, start, "end", coder, min(label) AS label FROM spans GROUP BY ALL)
SELECT doc_id, start, "end", coder, label IS NOT NULL AS annotated, coalesce(label, '') AS label FROM (SELECT * FROM u, k) LEFT JOIN f USING (doc_id, start, "end", coder)"""
QUERIES["confusion_matrix"] = lambda s, d: rel.confusion(spans(s, d), "1", "2")
SQL["confusion_matrix"] = _SPANS + """, f AS (SELECT doc_id, start, "end", coalesce(min(label) FILTER (coder = '1'), '') AS label1, coalesce(min(label) FILTER (coder = '2'), '') AS label2 FROM spans GROUP BY 1, 2, 3)
SELECT label1, label2, count(*) AS n FROM f WHERE label1 != '' OR label2 != '' GROUP BY 1, 2"""
def _fuzzy(s, d):
    # edit distances at every place cost far more than moving the texts, so these are dealt out first
    t = s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id as text_id", "text").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    return rel.fuzzy_find(t, "the ondth", 0.75)


QUERIES["fuzzy_match"] = _fuzzy


def _windows_sql(table, m):
    return f"""SELECT doc_id, i AS start, i + {m} AS e, CASE WHEN x = '' THEN 0 ELSE 1 - levenshtein(x, 'the ondth') / greatest(length(x), 9) END AS s
FROM (SELECT doc_id, base + k AS i, trim(regexp_replace(lower(substr(piece, k + 1, {m})), '\\s+', ' ', 'g')) AS x FROM (SELECT *, unnest(range(0, least(512, length(piece) - {m} + 1))) AS k FROM {table}))"""


SQL["fuzzy_match"] = f"""WITH p AS MATERIALIZED (SELECT doc_id, base, substr(text, base + 1, 523) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 512)) AS base FROM documents)),
f AS MATERIALIZED (SELECT * FROM ({_windows_sql("p", 9)}) WHERE s >= 0.75), q AS MATERIALIZED (SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM f)),
v AS ({" UNION ALL ".join(f"SELECT * FROM ({_windows_sql('q', m)}) WHERE s >= 0.75" for m in range(6, 13))})
SELECT doc_id AS text_id, start::INT AS start, e::INT AS "end", round(s, 4)::DOUBLE AS similarity FROM (SELECT * FROM f UNION ALL SELECT * FROM v)"""
