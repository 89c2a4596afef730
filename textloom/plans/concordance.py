"""Registered queries: keyword in context and token patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import kwic
from textloom.operators.predicates import PosFilter
from textloom.operators.tokens import annotate
from textloom.plans.frequency import docs
from textloom.plans.sql import TOKENS

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LINES = """, texts AS (SELECT text_id, list(text ORDER BY tok_idx) AS w FROM tokens WHERE text_id IN (SELECT text_id FROM m) GROUP BY text_id), lines AS (
  SELECT m.text_id, start, length, array_to_string(w[start + 1:start + length], ' ') AS keyword, w[greatest(start - 4, 1):start] AS "left", w[start + length + 1:start + length + 5] AS "right" FROM m JOIN texts USING (text_id))"""
_OUT = """ SELECT text_id, start::INT AS start, keyword, array_to_string("left", ' ') AS "left", array_to_string("right", ' ') AS "right" FROM lines"""


def _kwic(name, mode, value, m, **how):
    def run(s, d):
        t = annotate(docs(s, d))
        return kwic.flat(kwic.concordance(t, kwic.find(t, mode, value, **how))).select("text_id", "start", "keyword", "left", "right")

    QUERIES[name] = run
    SQL[name] = f"WITH {TOKENS}, m AS ({m}){_LINES}{_OUT}"


_one = lambda where: f"SELECT text_id, tok_idx AS start, 1 AS length FROM tokens WHERE NOT is_punct AND {where}"
_kwic("kwic_simple", "simple", "Thing|threa", _one("(text = 'Thing' OR lemma = 'Thing')") + " UNION ALL " + _one("(text = 'threa' OR lemma = 'threa')"))
_kwic("kwic_wildcard", "simple", "th?n*ing", _one("(regexp_matches(word, '^th.n.*ing$') OR regexp_matches(lower(lemma), '^th.n.*ing$'))"), lowercase=True)
_kwic("kwic_lemma", "lemma", "tion", _one("lemma = 'tion'"))
_kwic("kwic_word", "word", "onth", _one("text = 'onth' AND pos IN ('ADJ', 'NOUN')"), pos=PosFilter(("ADJ", "NOUN")))
_kwic("kwic_character", "character", "ç", _one("contains(word, 'ç') AND pos NOT IN ('DET', 'ADP')"), lowercase=True, pos=PosFilter(("DET", "ADP"), keep=False))
_PHRASE = """SELECT text_id, start, length FROM (SELECT text_id, tok_idx AS start, word = 'of' AND lead(word) OVER w = 'the' AND lead(word, 2) OVER w LIKE 'th%' AS hit, lead(tok_idx, 2) OVER w - tok_idx + 1 AS length
  FROM tokens WHERE NOT is_punct WINDOW w AS (PARTITION BY text_id ORDER BY tok_idx)) WHERE hit"""
_kwic("kwic_phrase", "phrase", "of the th*", _PHRASE, lowercase=True)
_SIMPLE_PHRASE = _PHRASE.replace("word = 'of' AND lead(word) OVER w = 'the' AND lead(word, 2) OVER w LIKE 'th%'", "(text = 'and' OR lemma = 'and') AND (lead(text) OVER w = 'the' OR lead(lemma) OVER w = 'the')").replace("lead(tok_idx, 2)", "lead(tok_idx, 1)")
_kwic("kwic_simple_phrase", "simple", "and the", _SIMPLE_PHRASE)

_kwic("kwic_cql_fixed", "cql", '[pos="NOUN"] [pos="ADP" & word!="of"] "the"', """SELECT text_id, tok_idx AS start, 3 AS length FROM (
  SELECT *, lead(pos) OVER w AS p1, lead(word) OVER w AS w1, lead(word, 2) OVER w AS w2 FROM tokens WINDOW w AS (PARTITION BY text_id ORDER BY tok_idx)) WHERE pos = 'NOUN' AND p1 = 'ADP' AND w1 != 'of' AND w2 = 'the'""")
_RUN = "coalesce(min(CASE WHEN NOT ({}) THEN tok_idx END) OVER (PARTITION BY text_id ORDER BY tok_idx DESC), count(*) OVER (PARTITION BY text_id)) - tok_idx"
_kwic("kwic_cql_repeat", "cql", '[pos="VERB"] [pos!="VERB" & pos!="PUNCT"]{0,2} [lemma=="the" | pos="PRON"]', f"""
  WITH r AS (SELECT text_id, tok_idx, {_RUN.format("pos = 'VERB'")} AS a, {_RUN.format("pos NOT IN ('VERB', 'PUNCT')")} AS b, {_RUN.format("lower(lemma) = 'the' OR pos = 'PRON'")} AS c FROM tokens)
  SELECT x.text_id, x.tok_idx AS start, (1 + least(coalesce(y.b, 0), 2) + 1)::INT AS length FROM r x LEFT JOIN r y ON y.text_id = x.text_id AND y.tok_idx = x.tok_idx + 1
  JOIN r z ON z.text_id = x.text_id AND z.tok_idx = x.tok_idx + 1 + least(coalesce(y.b, 0), 2) WHERE x.a >= 1 AND z.c >= 1""")
_kwic("cql_head_attributes", "cql", '[pos="NOUN" & headlemma="th.*" & headpos=="verb" & !dep="nsubj"]', """SELECT t.text_id, t.tok_idx AS start, 1 AS length FROM tokens t JOIN tokens h ON h.text_id = t.text_id AND h.tok_idx = t.head
  WHERE t.pos = 'NOUN' AND lower(h.lemma) LIKE 'th%' AND h.pos = 'VERB' AND t.dep != 'nsubj'""")


def _sorted(name, by, order, value="erth", m=_one("(text = 'erth' OR lemma = 'erth')"), most=None, extra="", cols="", **how):
    def run(s, d):
        t = annotate(docs(s, d))
        out = kwic.sort(kwic.concordance(t, kwic.find(t, "simple", value)), by, **how)
        return kwic.flat(kwic.page(out, most) if most else out).select("text_id", "start", "keyword", "left", "right", "rank", *(["total"] if most else []))

    QUERIES[name] = run
    total = ", count(*) OVER () AS total" if most else ""
    SQL[name] = f"""WITH {TOKENS}, m AS ({m}){_LINES}, x AS (SELECT *, count(*) OVER (PARTITION BY keyword) AS kn FROM lines), y AS (
      SELECT text_id, start::INT AS start, keyword, array_to_string("left", ' ') AS "left", array_to_string("right", ' ') AS "right", row_number() OVER (ORDER BY {order}, text_id, start) AS rank{total} FROM x)
      SELECT * FROM y{f" WHERE rank <= {most}" if most else ""}"""


_sorted("kwic_sort_levels", ["1L:word:ignoreCase", "2R::retrograde", "loc"], """encode(lower(coalesce("left"[-1], ''))), encode(reverse(coalesce("right"[2], ''))), start""")
_sorted("kwic_sort_frequency", "frequency", "kn DESC", value="on*ing", m=_one("(regexp_matches(text, '^on.*ing$') OR regexp_matches(lemma, '^on.*ing$'))"), most=100)
_sorted("kwic_sort_left", "left", """encode(lower(array_to_string(list_reverse("left"), ' ')))""")
_sorted("kwic_sort_right", "right", """encode(lower(array_to_string("right", ' ')))""", most=50)


def _extended(s, d):
    t = docs(s, d).selectExpr("doc_id as text_id", "text")
    at = F.locate("the", F.col("text"))
    return kwic.extended_context(t, t.where(at > 0).select("text_id", (at - 1).alias("begin"), (at + 2).alias("end")))


QUERIES["kwic_extended_context"] = _extended
SQL["kwic_extended_context"] = r"""SELECT doc_id AS text_id, (p - 1)::INT AS "begin", (p + 2)::INT AS "end", substr(t, greatest(1, p - 200), p - greatest(1, p - 200)) AS before, substr(t, p, 3) AS matched, substr(t, p + 3, 200) AS after
FROM (SELECT doc_id, text AS t, strpos(text, 'the') AS p FROM documents) WHERE p > 0"""


def _metaphor_lines(s, d):
    t = annotate(docs(s, d))
    lines = kwic.concordance(t, kwic.find(t, "simple", "erth"))
    return kwic.flat(kwic.mark_metaphors(lines, t.where("pos = 'ADJ' and tok_idx % 3 = 0"))).select("text_id", "start", "keyword", "is_metaphor")


QUERIES["kwic_metaphor"] = _metaphor_lines
SQL["kwic_metaphor"] = f"WITH {TOKENS} SELECT text_id, tok_idx::INT AS start, text AS keyword, pos = 'ADJ' AND tok_idx % 3 = 0 AS is_metaphor FROM tokens WHERE NOT is_punct AND (text = 'erth' OR lemma = 'erth')"
