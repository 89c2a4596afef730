"""Personal data: fixed forms, and identifiers that bootstrapped lexical contexts discover. DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize

KINDS = ("email", "ip", "card", "phone")
#: The fixed forms, written so that a long run of their characters is read once: a match starts where the last ended or where
#: no such character stands before it, and what can't be given back to any use is kept (possessive).
_LOCAL = "A-Za-z0-9._%+-"
FORMS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same forms for an engine that reads in linear time anyway.
PLAIN_FORMS = {
    "email": rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
_BLANK = r"\x20\x09-\x0D"
#: What may be an identifier: a run of characters other than white space with a digit, an at sign or an at in brackets, and the
#: runs behind it that begin with digits. The second is for an engine that reads in linear time anyway.
MENTION = rf"(?<![^{_BLANK}])[^{_BLANK}]*?(?:[0-9@]|[\[(]at[\])])[^{_BLANK}]*+(?:\x20\(?[0-9][^{_BLANK}]*+)*+"
PLAIN_MENTION = rf"[^{_BLANK}]*?(?:[0-9@]|[\[(]at[\])])[^{_BLANK}]*(?:\x20\(?[0-9][^{_BLANK}]*)*"
#: An identifier within a mention, by kind: looser than the fixed forms, for an engine that reads in linear time anyway.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]+(?:@|[\[(]at[\])])[A-Za-z0-9.-]*[A-Za-z0-9](?:[\[(]dot[\])][A-Za-z0-9-]+)*",
    "ip": r"[0-9A-Fa-f]+(?:[.:]+[0-9A-Fa-f]+){3,}",
    "card": r"[0-9](?:[\x20.-]?[0-9]){11,18}",
    "phone": r"[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}",
}
#: The same, so that a mention of any length is read in linear time: as the fixed forms, from the start of a run and possessive.
LOOSE_ONCE = LOOSE | {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@|[\[(]at[\])])[A-Za-z0-9.-]*[A-Za-z0-9](?:[\[(]dot[\])][A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]++(?:[.:]++[0-9A-Fa-f]++){3,}+",
}
WORD = rf"[^{_BLANK}]+"
#: Characters of a mention that the SQL discovers at most and of an instance that is kept as it is, a longer one goes by its
#: digest; and those of a context to either side.
LONGEST, LEFT, RIGHT = 80, 60, 40
_EDGES = ".,;:!?()[]{}<>\"'"
_ONE = 1_000_000


@dataclass(frozen=True)
class Bootstrap:
    """How contexts are learned. Scores are whole millionths, so that sums don't depend on their order.

    A pattern is a word or two before a mention, or the word after it. Its confidence for a kind is the
    scores of the distinct instances it stands with, added up, over their number and `smooth`; it counts
    from `support` whole scores and `confidence` on. An instance's score is the noisy-or of its best
    pattern on either side; from `accept` on it is an identifier wherever it stands.
    """

    rounds: int = 3
    support: int = 5
    smooth: int = 2
    confidence: int = 600_000
    accept: int = 750_000


def _matches(text: Column, form: str) -> Column:
    return F.regexp_extract_all(text, F.lit(form), F.lit(0))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i) - F.when(value(i) > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a fixed form holds."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(IP_PARTS)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts, stored: per row of docs the matches of each form and the lengths of the gaps between them,
    and the mentions with the words around them. Texts are not read again."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text.alias("t"))
    t = F.col("t")
    gaps = lambda form, has: F.when(t.rlike(has), F.transform(F.split(t, form, -1), F.length))
    has = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}
    out = []
    for k in KINDS:
        out += [F.when(t.rlike(has[k]), _matches(t, FORMS[k])).alias(f"m_{k}"), gaps(FORMS[k], has[k]).alias(f"g_{k}")]
    some = r"[0-9@]|[\[(]at[\])]"
    around = lambda g: F.struct(F.length(g).alias("n"), _matches(F.lower(F.right(g, F.lit(LEFT))), WORD).alias("before"), F.regexp_extract(F.lower(F.left(g, F.lit(RIGHT))), WORD, 0).alias("after"))
    out += [F.when(t.rlike(some), _matches(t, MENTION)).alias("m_mention"), F.when(t.rlike(some), F.transform(F.split(t, MENTION, -1), around)).alias("g_mention")]
    return materialize(rows.select("rid", "id", *out), "marks")


def _placed(rows: DataFrame) -> DataFrame:
    """Starts of matches in code points: (rid, kind, nth, gap, match) with the sum of all gaps and matches before."""
    before = Window.partitionBy("rid", "kind").orderBy("nth")
    n = F.length("match")
    return rows.withColumn("start", F.sum(F.col("gap") + n).over(before) - n)


def base_spans(marks: DataFrame) -> DataFrame:
    """(rid, kind, start, end) of the fixed forms' matches that hold; kind by its place in KINDS."""
    rows = None
    for k, kind in enumerate(KINDS):
        one = marks.where(F.size(f"m_{kind}") > 0).select("rid", F.lit(k).alias("kind"), F.posexplode(F.arrays_zip(F.col(f"m_{kind}").alias("m"), F.slice(f"g_{kind}", 1, F.size(f"m_{kind}")).alias("g"))).alias("nth", "x"))
        one = one.select("rid", "kind", "nth", F.col("x.g").cast("bigint").alias("gap"), F.col("x.m").alias("match"))
        rows = one if rows is None else rows.unionByName(one)
    holds = reduce(lambda a, b: a | b, [(F.col("kind") == k) & valid(kind, F.col("match")) for k, kind in enumerate(KINDS)])
    return _placed(rows).where(holds).select("rid", "kind", "start", (F.col("start") + F.length("match")).alias("end"))


def mentions(marks: DataFrame, longest: int | None = LONGEST) -> DataFrame:
    """(rid, start, match, instance, seed, can, patterns) of every mention.

    seed is the kind of a fixed form within it, can the kinds that it may be of otherwise, none if it has
    over longest characters (None: any number may be of a kind); patterns are what stands before and after:
    l and a word, ll and two words, r and a word; ^ stands for none.
    """
    rows = marks.where(F.size("m_mention") > 0).select("rid", F.posexplode(F.arrays_zip(F.col("m_mention").alias("m"), F.slice("g_mention", 1, F.size("m_mention")).alias("g"), F.slice("g_mention", 2, F.size("m_mention")).alias("h"))).alias("nth", "x"))
    rows = rows.select("rid", F.lit(0).alias("kind"), "nth", F.col("x.g.n").cast("bigint").alias("gap"), F.col("x.m").alias("match"), F.col("x.g.before").alias("before"), F.col("x.h.after").alias("after"))
    m, same = F.col("match"), F.btrim(F.lower("match"), F.lit(_EDGES))
    last = lambda k: F.coalesce(F.try_element_at("before", F.lit(-k)), F.lit("^"))
    seed = F.coalesce(*[F.when(valid(k, F.regexp_extract(m, FORMS[k], 0)) & (F.regexp_extract(m, FORMS[k], 0) != ""), F.lit(i)) for i, k in enumerate(KINDS)])
    short, whole = (F.length(same) <= LONGEST, same) if longest is None else (F.length(m) <= longest, m)
    may = F.lit(True) if longest is None else short
    can = F.filter(F.array(*[F.when(may & m.rlike(LOOSE_ONCE[k]), F.lit(i)) for i, k in enumerate(KINDS)]), lambda x: x.isNotNull())
    instance = F.when(short, same).otherwise(F.concat(F.lit("#"), F.sha2(whole, 256)))
    after = F.when(F.col("after") == "", "^").otherwise(F.col("after"))
    patterns = F.array(F.concat(F.lit("l "), last(1)), F.concat(F.lit("ll "), last(2), F.lit(" "), last(1)), F.concat(F.lit("r "), after))
    return _placed(rows).select("rid", "start", "match", instance.alias("instance"), seed.alias("seed"), can.alias("can"), patterns.alias("patterns"))


def score(found: DataFrame, how: Bootstrap) -> DataFrame:
    """(instance, kind, score) of the instances that are no seeds and have a pattern that counts, after the last round.

    Pattern-instance edges are stored once. A round is two joins along them and two aggregations with
    map-side combine; a pattern that a third of all mentions share is split as a skewed side of its join.
    """
    edges = materialize(found.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "edges")
    seeds = found.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).select("instance", "kind", F.lit(_ONE).cast("bigint").alias("score"))
    able = found.groupBy("instance").agg(F.max(F.col("seed").isNotNull()).alias("known"), F.max("can").alias("can")).where("not known").select("instance", F.explode("can").alias("kind"))
    seeds, able = materialize(seeds, "seeds"), materialize(able, "able")
    sizes = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    known = scores = None
    for _ in range(how.rounds):
        known = seeds if scores is None else seeds.unionByName(scores)
        sums = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("total")).where(F.col("total") >= how.support * _ONE)
        confidence = F.floor(F.col("total") / (F.col("n") + how.smooth)).cast("bigint")
        sure = sums.join(sizes, "pattern").select("pattern", "kind", confidence.alias("confidence")).where(F.col("confidence") >= how.confidence)
        best = lambda side: F.coalesce(F.max(F.when(F.col("pattern").startswith("r ") == (side == "r"), F.col("confidence"))), F.lit(0))
        reach = edges.join(sure, "pattern").groupBy("instance", "kind").agg(best("l").alias("l"), best("r").alias("r"))
        either = (_ONE - F.floor((_ONE - F.col("l")) * (_ONE - F.col("r")) / _ONE)).cast("bigint")
        scores = materialize(reach.join(able, ["instance", "kind"]).select("instance", "kind", either.alias("score")), "scores")
    return scores


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Bootstrap | None = None, longest: int | None = LONGEST) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs, from its whole text.

    Counts and digest are of the fixed forms; spans adds the identifiers that sure contexts discover and
    that overlap none of these, as kind:start:end in code points. An instance that two kinds claim goes
    to the one with the higher score, ties to the first. A null or empty text has none; rows with null or
    repeated ids each get their result; an empty table gives no rows; other columns are not read.
    Mentions of over longest characters are never discovered; with None, as the query has it, they are,
    whatever their length. Fixed forms have any length.
    """
    how = how or Bootstrap()
    marks = _marks(docs, id_col, text_col)
    base = materialize(base_spans(marks), "base")
    found = materialize(mentions(marks, longest), "mentions")
    scores = score(found, how).where(F.col("score") >= how.accept)
    taken = scores.groupBy("instance").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("x")).select("instance", F.col("x.kind").alias("kind"))
    core = reduce(lambda a, k: a.when(F.col("kind") == k, F.regexp_extract("match", LOOSE_ONCE[KINDS[k]], 0)), range(1, 4), F.when(F.col("kind") == 0, F.regexp_extract("match", LOOSE_ONCE["email"], 0)))
    more = found.where(F.col("seed").isNull() & (F.size("can") > 0)).join(taken, "instance").select("rid", "kind", "start", "match", core.alias("core"))
    begin = F.col("start") + F.instr("match", F.col("core")) - 1
    more = more.select("rid", "kind", begin.alias("start"), (begin + F.length("core")).alias("end"))
    both = base.withColumn("fixed", F.lit(True)).unionByName(more.withColumn("fixed", F.lit(False)))
    # an added span that overlaps a fixed one goes: of those that begin before it the furthest end, of the others the next start
    rows = Window.partitionBy("rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = lambda c: F.when(F.col("fixed"), F.col(c))
    both = both.withColumn("reach", F.max(fixed("end")).over(rows.orderBy("start", F.desc("fixed"), "end", "kind"))).withColumn("next", F.min(fixed("start")).over(rows.orderBy(F.desc("start"), F.desc("fixed"), F.desc("end"), F.desc("kind"))))
    both = both.where(F.col("fixed") | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))))
    spans = both.groupBy("rid").agg(*[F.count_if(F.col("fixed") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.array_sort(F.collect_list(F.struct("kind", "start", "end", "fixed"))).alias("all"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = spans.select("rid", *[f"n_{k}" for k in KINDS], text(F.filter("all", lambda s: s["fixed"])).alias("base"), text(F.col("all")).alias("spans"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return marks.select("rid", "id").join(out, "rid", "left").select(F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), empty("spans"))


def _luhn_sql(digits: str) -> str:
    return f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: reverse({digits})[i]::INT * (2 - i % 2) - CASE WHEN i % 2 = 0 AND reverse({digits})[i]::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0"


def _valid_sql(kind: str, match: str) -> str:
    digits = f"regexp_replace({match}, '[^0-9]', '', 'g')"
    return {"email": "TRUE", "ip": f"regexp_matches({match}, '{IP_PARTS}')", "phone": f"len({digits}) BETWEEN 8 AND 15", "card": f"CASE WHEN len({digits}) BETWEEN 16 AND 19 THEN {_luhn_sql(digits)} ELSE FALSE END"}[kind]


def _round_sql(r: int, how: Bootstrap) -> str:
    known = "SELECT instance, kind, score FROM seeds" + (f" UNION ALL SELECT instance, kind, score FROM scores{r - 1}" if r else "")
    return f"""sure{r} AS MATERIALIZED (
  SELECT * FROM (SELECT pattern, kind, (total // (n + {how.smooth}))::BIGINT AS confidence FROM (
    SELECT pattern, kind, sum(score)::BIGINT AS total FROM edges JOIN ({known}) USING (instance) GROUP BY pattern, kind) JOIN sizes USING (pattern)
    WHERE total >= {how.support * _ONE}) WHERE confidence >= {how.confidence}
), scores{r} AS MATERIALIZED (
  SELECT instance, kind, {_ONE} - (({_ONE} - l) * ({_ONE} - r)) // {_ONE} AS score FROM (
    SELECT instance, kind, coalesce(max(confidence) FILTER (NOT starts_with(pattern, 'r ')), 0) AS l, coalesce(max(confidence) FILTER (starts_with(pattern, 'r ')), 0) AS r
    FROM edges JOIN sure{r} USING (pattern) GROUP BY instance, kind) JOIN able USING (instance, kind)
)"""


def sql(how: Bootstrap | None = None) -> str:
    """find() over the table documents, its rounds written out."""
    how = how or Bootstrap()
    quoted = lambda x: x.replace("'", "''")
    forms = [*PLAIN_FORMS.values(), PLAIN_MENTION]
    raw = " UNION ALL ".join(f"SELECT rid, {k} AS kind, regexp_extract_all(t, '{quoted(f)}') AS m, regexp_split_to_array(t, '{quoted(f)}') AS g FROM d" for k, f in enumerate(forms))
    holds = " OR ".join(f"kind = {k} AND {_valid_sql(name, 'm')}" for k, name in enumerate(KINDS))
    first = lambda k: f"regexp_extract(m, '{PLAIN_FORMS[k]}')"
    seed = ", ".join(f"CASE WHEN {first(k)} != '' AND {_valid_sql(k, first(k))} THEN {i} END" for i, k in enumerate(KINDS))
    can = ", ".join(f"CASE WHEN len(m) <= {LONGEST} AND regexp_extract(m, '{LOOSE[k]}') != '' THEN {i} END" for i, k in enumerate(KINDS))
    core = " ".join(f"WHEN {i} THEN regexp_extract(m, '{LOOSE[k]}')" for i, k in enumerate(KINDS))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    counts = ", ".join(f"(count(*) FILTER (fixed AND kind = {i}))::BIGINT AS n_{k}" for i, k in enumerate(KINDS))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), raw AS ({raw}
), placed AS MATERIALIZED (
  SELECT rid, kind, m, g, h, (sum(len(g) + len(m)) OVER (PARTITION BY rid, kind ORDER BY nth) - len(m))::BIGINT AS start FROM (
    SELECT rid, kind, nth, m[nth] AS m, g[nth] AS g, g[nth + 1] AS h FROM (SELECT *, unnest(range(1, len(m) + 1)) AS nth FROM raw WHERE len(m) > 0))
), base AS (
  SELECT rid, kind, start, start + len(m) AS stop FROM placed WHERE kind < 4 AND ({holds})
), mentions AS MATERIALIZED (
  SELECT rid, start, m, coalesce({seed}) AS seed, list_filter([{can}], lambda x: x IS NOT NULL) AS can,
         CASE WHEN len(m) <= {LONGEST} THEN trim(lower(m), '{quoted(_EDGES)}') ELSE '#' || sha256(m) END AS instance,
         ['l ' || coalesce(w[-1], '^'), 'll ' || coalesce(w[-2], '^') || ' ' || coalesce(w[-1], '^'), 'r ' || CASE WHEN a = '' THEN '^' ELSE a END] AS patterns
  FROM (SELECT rid, start, m, regexp_extract_all(lower("right"(g, {LEFT})), '{WORD}') AS w, regexp_extract(lower("left"(h, {RIGHT})), '{WORD}') AS a FROM placed WHERE kind = 4)
), edges AS MATERIALIZED (
  SELECT DISTINCT unnest(patterns) AS pattern, instance FROM mentions
), seeds AS MATERIALIZED (
  SELECT instance, min(seed) AS kind, {_ONE} AS score FROM mentions WHERE seed IS NOT NULL GROUP BY instance
), able AS MATERIALIZED (
  SELECT instance, unnest(can) AS kind FROM (SELECT instance, max(can) AS can FROM mentions GROUP BY instance HAVING count(seed) = 0)
), sizes AS (
  SELECT pattern, count(*) AS n FROM edges GROUP BY pattern
), {", ".join(_round_sql(r, how) for r in range(how.rounds))}, taken AS (
  SELECT instance, kind FROM scores{how.rounds - 1} WHERE score >= {how.accept} QUALIFY row_number() OVER (PARTITION BY instance ORDER BY score DESC, kind) = 1
), more AS (
  SELECT rid, kind, start + instr(m, core) - 1 AS start, start + instr(m, core) - 1 + len(core) AS stop FROM (
    SELECT rid, kind, start, m, CASE kind {core} END AS core FROM mentions JOIN taken USING (instance) WHERE seed IS NULL AND len(can) > 0)
), spans AS (
  SELECT *, TRUE AS fixed FROM base UNION ALL
  SELECT *, FALSE FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = more.rid AND base.start < more.stop AND more.start < base.stop)
), joined AS (
  SELECT rid, {counts}, string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY kind, start, stop) FILTER (fixed) AS base,
         string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY kind, start, stop) AS spans FROM spans GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (rid)
"""
