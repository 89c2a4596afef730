"""Registered queries: annotation files, tagged corpora, tag maps, reliability reports, catalogue changes, preprocessed files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import catalog, semantic
from textloom.operators import reliability as rel
from textloom.operators.tokens import annotate
from textloom.plans import agreement
from textloom.plans.files import _written
from textloom.plans.frequency import docs
from textloom.plans.longtail import SQL as _LONGTAIL
from textloom.plans.meaning import _DISAMBIGUATED, _TAGGED, tagged
from textloom.plans.sql import TOKENS
from textloom.runtime import shared_dir
from textloom.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _usas_files(s, d):
    """Each text's tokens as a file: an annotation, one inside a transcript, or a transcript's in segments of fifty."""
    t = tagged(s, d)
    token = F.struct("text", "pos", "lemma", "usas_tag", "usas_tags")
    cut = t.groupBy("text_id", F.floor(F.col("tok_idx") / 50).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("tok_idx", token.alias("t")))).alias("x"))
    cut = cut.withColumn("tokens", F.transform("x", lambda x: x["t"]))
    whole = cut.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("seg", "tokens"))).alias("x")).withColumn("tokens", F.flatten(F.transform("x", lambda x: x["tokens"])))
    parts = F.map_from_entries(F.transform("x", lambda x: F.struct(F.concat(F.lit("s"), x["seg"].cast("string")).alias("k"), F.struct((x["seg"] * 1.0).alias("segment_start"), x["tokens"].alias("tokens")).alias("v"))))
    form = lambda n, value: F.when(F.col("text_id") % 3 == n, value)
    held = F.when(F.col("text_id") % 3 > 0, F.struct(form(1, F.col("tokens")).alias("tokens"), form(2, parts).alias("segments")))
    return _written(s, whole.select(form(0, F.col("tokens")).alias("tokens"), held.alias("usas_annotations")), "json", maxRecordsPerFile=1)


QUERIES["read_usas"] = lambda s, d: readers.read_usas(s, _usas_files(s, d)).groupBy("text", "pos", "lemma", "usas_tag", F.array_join("usas_tags", " ").alias("tags"), F.col("segment_id").alias("segment")).agg(F.count("*").alias("n"), F.sum("tok_idx").alias("places"))
SQL["read_usas"] = _TAGGED + """ SELECT text, pos, lemma, usas_tag, array_to_string(usas_tags, ' ') AS tags, CASE WHEN text_id % 3 = 2 THEN 's' || (tok_idx // 50) END AS segment, count(*) AS n, sum(tok_idx)::BIGINT AS places FROM t GROUP BY ALL"""


def _mipvu_files(s, d):
    """Each text's sentences as a file: an annotation, one inside a transcript, or one segment a sentence, of which every fifth failed."""
    t = tagged(s, d)
    token = F.struct(F.col("text").alias("word"), "lemma", "pos", "tag", "dep", F.when(F.col("is_metaphor"), True).alias("is_metaphor"), "metaphor_source")
    sent = t.groupBy("text_id", "sent_idx").agg(F.sort_array(F.collect_list(F.struct("tok_idx", token.alias("t")))).alias("x")).withColumn("s", F.struct(F.transform("x", lambda x: x["t"]).alias("tokens")))
    whole = sent.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "s"))).alias("x"))
    ok, sentences = F.col("text_id") % 7 != 0, F.transform("x", lambda x: x["s"])
    segments = F.transform("x", lambda x: F.struct(F.struct((x["sent_idx"] % 5 != 4).alias("success"), F.array(x["s"]).alias("sentences")).alias("mipvu_data")))
    form = lambda n, value: F.when(F.col("text_id") % 3 == n, value)
    held = F.when(F.col("text_id") % 3 > 0, F.struct(form(1, ok).alias("success"), form(1, sentences).alias("sentences"), form(2, segments).alias("segments")))
    return _written(s, whole.select(form(0, ok).alias("success"), form(0, sentences).alias("sentences"), held.alias("mipvu_annotations")), "json", maxRecordsPerFile=1)


QUERIES["read_mipvu"] = lambda s, d: readers.read_mipvu(s, _mipvu_files(s, d)).groupBy("word", "lemma", "pos", "tag", "dep", "is_metaphor", "metaphor_source").agg(F.count("*").alias("n"), F.sum("tok_idx").alias("places"), F.sum("sent_idx").alias("sentences"))
SQL["read_mipvu"] = _TAGGED + """, k AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY tok_idx) - 1 AS i, dense_rank() OVER (PARTITION BY text_id ORDER BY sent_idx) - 1 AS j FROM t WHERE CASE WHEN text_id % 3 = 2 THEN sent_idx % 5 != 4 ELSE text_id % 7 != 0 END)
SELECT text AS word, lemma, pos, tag, dep, is_metaphor, CASE WHEN tok_idx % 2 = 0 THEN 'rule:x' WHEN tok_idx % 3 = 0 THEN 'hitz' ELSE 'odd' END AS metaphor_source, count(*) AS n, sum(i)::BIGINT AS places, sum(j)::BIGINT AS sentences FROM k GROUP BY ALL"""


# Surrogate tags in the two tag sets, by part of speech.
_CLAWS = {"NOUN": "NN2", "VERB": "VVN-AJ0", "DET": "at0", "ADP": "PRP", "ADV": "AV0", "ADJ": "AJ0", "PRON": "PNP", "NUM": "CRD"}
_BROWN = {"NOUN": "NN$", "VERB": "vbd-hl", "DET": "AT", "ADP": "in", "ADV": "rb", "ADJ": "jj-tl", "PRON": "ppss$", "NUM": "odd"}
_AS_PENN = {"NOUN": ("NNS", "NN"), "VERB": ("VBN", "VBD"), "DET": ("DT", "DT"), "ADP": ("IN", "IN"), "ADV": ("RB", "RB"), "ADJ": ("JJ", "JJ"), "PRON": ("PRP", "PRP"), "NUM": ("CD", "NN")}


def _tag_of(table):
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("pos")]


def _penn_sql(nth):
    return "CASE pos " + " ".join(f"WHEN '{k}' THEN '{v[nth]}'" for k, v in _AS_PENN.items()) + " ELSE 'NN' END"


def _brown(s, d):
    t = annotate(docs(s, d))
    pair = F.when(F.col("is_punct"), F.col("text")).otherwise(F.concat_ws("/", "text", F.coalesce(_tag_of(_BROWN), F.lit("xx"))))
    lines = t.groupBy("text_id", "sent_idx").agg(F.array_join(F.collect_list(pair), " ").alias("value")).select("value")
    return readers.read_brown(s, _written(s, lines)).groupBy("word", "lemma", "tag").agg(F.count("*").alias("n"))


QUERIES["read_brown"] = _brown
SQL["read_brown"] = f"WITH {TOKENS} SELECT text AS word, word AS lemma, {_penn_sql(1)} AS tag, count(*) AS n FROM tokens WHERE NOT is_punct GROUP BY ALL"


def _oanc(s, d):
    """Texts as XML whose word elements have one name or another, with the tag under one name, another or none."""
    t = annotate(docs(s, d)).where("not is_punct")
    name = F.element_at(F.array(*map(F.lit, ("tok", "token", "word", "w"))), (F.col("tok_idx") % 4 + 1).cast("int"))
    tag = F.when(F.col("tok_idx") % 3 == 0, F.concat(F.lit(' pos="'), "pos", F.lit('"'))).when(F.col("tok_idx") % 3 == 1, F.concat(F.lit(' type="'), "pos", F.lit('"'))).otherwise("")
    lemma = F.when(F.col("tok_idx") % 2 == 0, F.concat(F.lit(' lemma="'), "lemma", F.lit('"'))).otherwise("")
    one = F.concat(F.lit("<"), name, F.lit(' id="1"'), tag, lemma, F.lit(">"), "text", F.lit("</"), name, F.lit(">"))
    texts = t.groupBy("text_id").agg(F.array_join(F.collect_list(one), "").alias("x"))
    return readers.read_oanc(s, _written(s, texts.select(F.concat(F.lit("<doc>"), "x", F.lit("</doc>")).alias("value")), maxRecordsPerFile=1)).groupBy("word", "lemma", "tag").agg(F.count("*").alias("n"))


QUERIES["read_oanc"] = _oanc
SQL["read_oanc"] = f"WITH {TOKENS} SELECT text AS word, CASE WHEN tok_idx % 2 = 0 THEN lemma ELSE word END AS lemma, CASE WHEN tok_idx % 3 < 2 THEN pos ELSE 'NN' END AS tag, count(*) AS n FROM tokens WHERE NOT is_punct GROUP BY ALL"
QUERIES["read_plain_words"] = lambda s, d: readers.read_plain_words(s, _written(s, docs(s, d).where("text is not null").select(F.col("text").alias("value"))), 2).groupBy("word").agg(F.count("*").alias("n"))
SQL["read_plain_words"] = r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM documents) WHERE regexp_matches(word, '^\p{L}{2,}$') GROUP BY 1"


def _penn(s, d):
    t = annotate(docs(s, d)).groupBy("pos").agg(F.count("*").alias("n"))
    claws, brown = text.claws_to_penn(_tag_of(_CLAWS)), text.brown_to_penn(_tag_of(_BROWN))
    return t.select("pos", "n", claws.alias("claws"), brown.alias("brown"), text.penn_to_wordnet(claws).alias("wordnet"))


QUERIES["tags_to_penn"] = _penn
SQL["tags_to_penn"] = f"""WITH {TOKENS}, x AS (SELECT pos, count(*) AS n, {_penn_sql(0)} AS claws, {_penn_sql(1)} AS brown FROM tokens GROUP BY pos)
SELECT *, CASE left(claws, 1) WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'R' THEN 'r' ELSE 'n' END AS wordnet FROM x"""

_TYPES = [*semantic.TEXT_TYPES, "Legal Document", "unheard of"]


def _by_type(s, d):
    t = tagged(s, d).withColumn("text_type", F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("text_id") % len(_TYPES) + 1).cast("int")))
    return semantic.disambiguate(t, semantic.priority_of(F.col("text_type"))).groupBy("text_type", "usas_tag", "method").agg(F.count("*").alias("tokens"))


_PREFERRED = "[" + ", ".join(str(list(semantic.TEXT_TYPES.get(semantic.TEXT_TYPE_NAMES.get(x, x), ()))) + "::VARCHAR[]" for x in _TYPES) + "]"
QUERIES["usas_text_types"] = _by_type
SQL["usas_text_types"] = (
    _DISAMBIGUATED.replace("list_filter(cands, lambda x: starts_with(replace(x, '_MWE', ''), 'B2'))[1] AS p1", f"list_filter(list_transform({_PREFERRED}[text_id % {len(_TYPES)} + 1], lambda p: list_filter(cands, lambda x: starts_with(replace(x, '_MWE', ''), p))[1]), lambda y: y IS NOT NULL)[1] AS p1")
    + f" SELECT {_TYPES}[text_id % {len(_TYPES)} + 1] AS text_type, usas_tag, method, count(*) AS tokens FROM dis GROUP BY ALL"
)

QUERIES["gold_summary"] = lambda s, d: rel.gold_summary(rel.precision_recall(agreement.spans(s, d), "1"))
SQL["gold_summary"] = f"""WITH n AS (SELECT coder, label, tp, fp, fn FROM ({agreement.SQL["precision_recall"]})),
u AS (SELECT 'coder' AS kind, coder AS item, tp, fp, fn FROM n WHERE label = '*' UNION ALL SELECT 'label', label, sum(tp), sum(fp), sum(fn) FROM n WHERE label != '*' GROUP BY label),
m AS (SELECT kind, item, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM u),
a AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m), b AS (SELECT * FROM a UNION ALL SELECT 'mean', '*', avg(p), avg(r), avg(f) FROM a WHERE kind = 'coder'),
c AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS h FROM b)
SELECT kind, item, round(p, 4)::DOUBLE AS "precision", round(r, 4)::DOUBLE AS recall, round(f, 4)::DOUBLE AS f1,
CASE WHEN h >= 0.9 THEN 'excellent' WHEN h >= 0.8 THEN 'good' WHEN h >= 0.7 THEN 'fair' WHEN h >= 0.6 THEN 'moderate' WHEN h >= 0.5 THEN 'poor' ELSE 'very poor' END AS band FROM c"""
QUERIES["reliability_report"] = lambda s, d: rel.report(agreement.spans(s, d), agreement.lengths(s, d), agreement.CODERS, "1")
_BAND = "CASE WHEN {0} >= 0.8 THEN 'almost perfect' WHEN {0} >= 0.6 THEN 'substantial' WHEN {0} >= 0.4 THEN 'moderate' WHEN {0} >= 0.2 THEN 'fair' WHEN {0} >= 0 THEN 'slight' ELSE 'poor' END"
SQL["reliability_report"] = " UNION ALL ".join(
    [
        f"SELECT 'percent_agreement' AS measure, coder1 || '-' || coder2 AS item, agreement AS value, NULL::VARCHAR AS band FROM ({agreement.SQL['percent_agreement']})",
        f"SELECT 'cohens_kappa', coder1 || '-' || coder2, kappa, band FROM ({agreement.SQL['cohens_kappa']})",
        f"SELECT 'fleiss_kappa', '*', kappa, {_BAND.format('kappa')} FROM ({agreement.SQL['fleiss_kappa']})",
        *(f"SELECT 'krippendorff_alpha', level, alpha, {_BAND.format('alpha')} FROM ({agreement.SQL[f'krippendorff_{x}']})" for x in ("nominal", "ordinal", "interval", "ratio")),
        *(f"""SELECT '{m}', kind || ':' || item, "{m}", {'band' if m == 'f1' else 'NULL'} FROM ({SQL['gold_summary']})""" for m in ("precision", "recall", "f1")),
    ]
)

QUERIES["reliability_page"] = lambda s, d: rel.report_page(QUERIES["reliability_report"](s, d), "Agreement of three coders")
_HEADINGS = "CASE measure " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in rel.TITLES.items()) + " END"
_PLACES = "CASE measure " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(rel.TITLES)) + " END"
SQL["reliability_page"] = f"""WITH r AS ({SQL["reliability_report"]}), x AS (SELECT measure, string_agg('<tr><td>' || item || '</td><td>' || printf('%.4f', value) || '</td><td>' || coalesce(band, '-') || '</td></tr>', '' ORDER BY item) AS rows,
  floor((2 * sum(round(value * 10000)::BIGINT) + count(*)) / (2 * count(*))) / 10000 AS mean FROM r GROUP BY 1)
SELECT 0 AS nth, '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Agreement of three coders</title></head><body><h1>Agreement of three coders</h1>' AS html
UNION ALL SELECT {_PLACES}, '<section><h2>' || {_HEADINGS} || '</h2><table><tr><th>Item</th><th>Value</th><th>Band</th></tr>' || rows
  || CASE WHEN measure IN ('percent_agreement', 'cohens_kappa') THEN '<tr><td>mean</td><td>' || printf('%.4f', mean) || '</td><td>-</td></tr>' ELSE '' END || '</table></section>' FROM x
UNION ALL SELECT 2147483647, '<section><h2>Reading kappa and alpha</h2><table><tr><th>Value</th><th>Band</th></tr><tr><td>0.8 and more</td><td>almost perfect</td></tr><tr><td>0.6 to 0.8</td><td>substantial</td></tr><tr><td>0.4 to 0.6</td><td>moderate</td></tr><tr><td>0.2 to 0.4</td><td>fair</td></tr><tr><td>0 to 0.2</td><td>slight</td></tr><tr><td>below 0</td><td>poor</td></tr></table></section></body></html>'"""


def _catalog(s, d):
    """Texts, their tags and a task for each order, of which customers are the texts."""
    texts = docs(s, d).select(F.col("doc_id").alias("text_id"), F.col("source").alias("corpus_id"))
    labels = s.read.parquet(f"{d}/labels.parquet")
    tags = labels.selectExpr("doc_id text_id", "concat('q', quality) tag").unionByName(labels.selectExpr("doc_id text_id", "concat('t', toxic) tag"))
    o = s.read.parquet(f"{d}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
    at = F.col("o_orderdate").cast("timestamp")
    tasks = o.select(
        F.col("o_orderkey").alias("task_id"), F.concat(F.lit("src"), (F.col("o_custkey") % 10).cast("string")).alias("corpus_id"), F.col("o_custkey").alias("text_id"), status.alias("status"), F.col("o_orderpriority").alias("message"),
        at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at"),
    )
    return texts, tags, tasks


_TASKS = """tasks AS (SELECT o_orderkey AS task_id, 'src' || (o_custkey % 10) AS corpus_id, o_custkey AS text_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status, o_orderpriority AS message,
  o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP AS updated_at, NULL::TIMESTAMP AS completed_at FROM orders)"""
_DAYS = "epoch(created_at)::BIGINT AS created, epoch(updated_at)::BIGINT AS updated, epoch(completed_at)::BIGINT AS completed"
_NOW = "timestamp'1996-07-01 00:00:00'"


def _flat_tasks(t):
    return t.select("task_id", "corpus_id", "text_id", "status", "message", *(F.unix_timestamp(f"{c}_at").alias(c) for c in ("created", "updated", "completed")))


def _removed(s, d):
    texts, tags, tasks = _catalog(s, d)
    gone = s.createDataFrame([("src3",), ("src7",), ("none",)], "corpus_id string")
    texts, tags, tasks = catalog.remove_corpora(texts, tags, tasks, gone)
    rows = [texts.select(F.lit("text").alias("kind"), F.col("text_id").alias("id"), F.col("corpus_id").alias("value"), F.lit(None).cast("bigint").alias("of"))]
    rows += [tags.select(F.lit("tag").alias("kind"), F.col("text_id").alias("id"), F.col("tag").alias("value"), F.lit(None).cast("bigint").alias("of"))]
    rows += [tasks.select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.col("corpus_id").alias("value"), F.col("text_id").alias("of"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES["catalog_remove"] = _removed
SQL["catalog_remove"] = f"""WITH {_TASKS}, lost AS (SELECT doc_id FROM documents WHERE source IN ('src3', 'src7'))
SELECT 'text' AS kind, doc_id AS id, source AS value, NULL::BIGINT AS of FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lost)
UNION ALL SELECT 'tag', doc_id, unnest(['q' || quality, 't' || toxic]), NULL FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM lost)
UNION ALL SELECT 'task', task_id, CASE WHEN corpus_id NOT IN ('src3', 'src7') THEN corpus_id END, CASE WHEN text_id NOT IN (SELECT doc_id FROM lost) THEN text_id END FROM tasks"""


def _retagged(s, d):
    _, tags, _ = _catalog(s, d)
    new = tags.where("tag = 'q1'").select("text_id", F.explode(F.array(F.lit("good"), F.lit("q1"))).alias("tag"))
    return catalog.remove_tags(catalog.add_tags(tags, new), tags.where("tag = 't0'"))


QUERIES["catalog_retag"] = _retagged
SQL["catalog_retag"] = """WITH t AS (SELECT doc_id AS text_id, unnest(['q' || quality, 't' || toxic]) AS tag FROM labels) SELECT DISTINCT text_id, tag FROM (SELECT * FROM t UNION ALL SELECT text_id, 'good' FROM t WHERE tag = 'q1') WHERE tag != 't0'"""


def _tasks(s, d):
    _, _, tasks = _catalog(s, d)
    changes = tasks.where("task_id % 3 = 0").select("task_id", F.when(F.col("task_id") % 2 == 0, "completed").alias("status"), F.when(F.col("task_id") % 2 == 1, "half way").alias("message"))
    return _flat_tasks(catalog.update_tasks(tasks, changes, F.expr(_NOW)))


QUERIES["task_updates"] = _tasks
SQL["task_updates"] = f"""WITH {_TASKS}, x AS (SELECT task_id, corpus_id, text_id, CASE WHEN task_id % 6 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN task_id % 6 = 3 THEN 'half way' ELSE message END AS message, created_at,
  CASE WHEN task_id % 3 = 0 THEN TIMESTAMP '1996-07-01' ELSE updated_at END AS updated_at, CASE WHEN task_id % 6 = 0 THEN TIMESTAMP '1996-07-01' END AS completed_at FROM tasks) SELECT task_id, corpus_id, text_id, status, message, {_DAYS} FROM x"""
QUERIES["tasks_active"] = lambda s, d: _flat_tasks(catalog.active_tasks(_catalog(s, d)[2], "src5", F.expr(_NOW), "40 days"))
SQL["tasks_active"] = f"WITH {_TASKS} SELECT task_id, corpus_id, text_id, status, message, {_DAYS} FROM tasks WHERE corpus_id = 'src5' AND (status != 'completed' OR updated_at > TIMESTAMP '1996-07-01' - INTERVAL 40 DAY)"
QUERIES["tasks_stale"] = lambda s, d: _flat_tasks(catalog.fail_stale(_catalog(s, d)[2], F.expr(_NOW)))
SQL["tasks_stale"] = f"""WITH {_TASKS}, x AS (SELECT * REPLACE (CASE WHEN status != 'completed' THEN 'failed' ELSE status END AS status, CASE WHEN status != 'completed' THEN 'Task interrupted (server restart)' ELSE message END AS message,
  CASE WHEN status != 'completed' THEN TIMESTAMP '1996-07-01' ELSE updated_at END AS updated_at) FROM tasks) SELECT task_id, corpus_id, text_id, status, message, {_DAYS} FROM x"""


def _preprocessed(s, d):
    path = f"{shared_dir(s)}/textloom/preprocessed-{uuid.uuid4().hex}"
    tokens = text.preprocess(F.col("text"), patterns=[r"\d+", "(bad"], normalise=False).alias("tokens")
    writers.write_preprocessed(docs(s, d).select(F.col("doc_id").alias("text_id"), tokens), path, {"language": "en", "lowercase": "true"})
    return readers.read_preprocessed(s, path).select(F.col("text_id").cast("bigint").alias("doc_id"), F.array_join("tokens", " ").alias("tokens"), "text", "word_count", F.col("config")["language"].alias("language"))


QUERIES["preprocessed_files"] = _preprocessed
SQL["preprocessed_files"] = f"SELECT doc_id, tokens, tokens AS text, coalesce(len(string_split(nullif(tokens, ''), ' ')), 0) AS word_count, 'en' AS language FROM ({_LONGTAIL['preprocess_pipeline']})"
