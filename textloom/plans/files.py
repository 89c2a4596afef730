"""Registered queries: readers and text functions. A query writes files in a reader's form to the shared folder and reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import stats, text
from textloom.functions.sentences import chunks, sentences, shifted
from textloom.operators import cql, kwic
from textloom.operators.tokens import annotate
from textloom.plans.concordance import _LINES, _one
from textloom.plans.frequency import docs
from textloom.plans.sql import TOKENS
from textloom.runtime import shared_dir
from textloom.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _written(spark, lines: DataFrame, form: str = "text", **options) -> str:
    """The folder that the lines went to."""
    path = f"{shared_dir(spark)}/textloom/files-{uuid.uuid4().hex}"
    getattr(lines.write.options(**options), form)(path)
    return path


def _parts(s, d):
    return s.read.parquet(f"{d}/part.parquet")


def _wos_files(s, d):
    """Each part as a record: two authors, keywords in two fields, an address, one of three fields for citations."""
    size = F.col("p_size").cast("string")
    cited = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("TC "), size)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("TC x\nZ9 "), size)).otherwise(F.concat(F.lit("U1 "), size))
    keys = F.when(F.col("p_size") % 4 == 0, F.lit("ZZ none")).otherwise(F.concat(F.lit("DE "), F.col("p_type"), F.lit("; corpus;\nID CORPUS; "), F.col("p_type")))
    record = F.concat_ws(
        "\n", F.lit("PT J"), F.concat(F.lit("AU Brand, "), F.col("p_brand")), F.concat(F.lit("   Second, "), size), F.concat(F.lit("TI The study of "), F.col("p_name"), F.lit(" with measured numbers")),
        F.lit("SO Journal of Parts"), F.concat(F.lit("PY "), F.col("p_size") + 1960), F.lit("BP 11"), F.lit("EP 19"), keys, F.concat(F.lit("C1 [A, B] "), F.col("p_type"), F.lit(", Main St, Bergen, N-5007 Norway 12.")), cited,
        F.concat(F.lit("UT WOS:"), F.col("p_partkey")), F.lit("ER\n"),
    )
    return readers.read_whole(s, _written(s, _parts(s, d).select(record.alias("value"))))


def _wos(s, d):
    t = readers.read_wos(_wos_files(s, d))
    lists = {c: F.array_join(c, "|").alias(c) for c in ("authors", "institutions", "countries", "keywords")}
    return t.select("title", *lists.values(), "journal", "year", "doc_type", "citation_count", "unique_id", "pages")


QUERIES["read_wos"] = _wos
SQL["read_wos"] = """SELECT 'The study of ' || p_name || ' with measured numbers' AS title, 'Brand, ' || p_brand || '|Second, ' || p_size AS authors, p_type AS institutions, 'N-5007 Norway' AS countries,
CASE WHEN p_size % 4 = 0 THEN array_to_string(list_filter(regexp_extract_all(lower('The study of ' || p_name || ' with measured numbers'), '[a-z]{4,}'), lambda w: w NOT IN ('with', 'this', 'that', 'from', 'were', 'been', 'these', 'those', 'using', 'based'))[1:5], '|')
     ELSE p_type || '|corpus|CORPUS' END AS keywords,
'Journal of Parts' AS journal, p_size + 1960 AS year, 'Journal Article' AS doc_type, p_size::BIGINT AS citation_count, 'WOS:' || p_partkey AS unique_id, '11-19' AS pages FROM part"""


def _marked(s, d):
    """Documents with marks of exports behind texts of any length; some have both kinds."""
    n = F.col("doc_id") % 7
    marks = F.when(n == 0, "\nER\n").when(n == 1, "\nDS CNKI\nx").when(n == 2, "\nCN 11-1").when(n == 3, "\nUT KJD:1").when(n == 4, "\nDS CNKI\nER").when(n == 5, "\nCN 1\nUT WOS:1").otherwise(" CN 1 ERx")
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), marks).alias("value"))


QUERIES["source_types"] = lambda s, d: _marked(s, d).select("doc_id", readers.source_type(F.col("value")).alias("type"))
SQL["source_types"] = "SELECT doc_id, (['WOS', 'CNKI', 'CNKI', 'WOS', 'WOS', 'CNKI', NULL])[doc_id % 7 + 1] AS type FROM documents"


def _cnki_files(s, d):
    n = s.read.parquet(f"{d}/supplier.parquet")
    record = F.concat_ws(
        "\n", F.when(F.col("s_nationkey") % 2 == 0, "RT Journal Article").otherwise("RT Dissertation"), F.concat(F.lit("A1 王"), F.col("s_name"), F.lit(";李二")), F.concat(F.lit("T1 标题"), F.col("s_suppkey")), F.lit("  续行"),
        F.lit("JF 期刊"), F.concat(F.lit("YR "), F.col("s_nationkey") + 1990), F.lit("K1 语料;工具"), F.lit("AD 大学;学院"), F.lit(""),
    )
    return readers.read_whole(s, _written(s, n.select(record.alias("value"))))


QUERIES["read_cnki"] = lambda s, d: readers.read_cnki(_cnki_files(s, d)).select("title", F.array_join("authors", "|").alias("authors"), F.array_join("institutions", "|").alias("institutions"), F.array_join("keywords", "|").alias("keywords"), "journal", "year", "doc_type")
SQL["read_cnki"] = "SELECT '标题' || s_suppkey || ' 续行' AS title, '王' || s_name || '|李二' AS authors, '大学|学院' AS institutions, '语料|工具' AS keywords, '期刊' AS journal, s_nationkey + 1990 AS year, CASE WHEN s_nationkey % 2 = 0 THEN 'Journal Article' ELSE 'Dissertation' END AS doc_type FROM supplier"


def _encoded(s, d):
    """Files in three encodings, told apart by their bytes."""
    n = s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("名"), "n_name").alias("x"))
    gbk = F.concat(F.unhex(F.lit("C3FB")), F.encode(F.expr("substr(x, 2)"), "UTF-8"))
    latin = F.concat(F.unhex(F.lit("E920FF")), F.encode(F.expr("substr(x, 2)"), "UTF-8"))
    return n.select(F.explode(F.array(F.encode("x", "UTF-8"), gbk, latin)).alias("content")).select(readers.decoded("content").alias("value")).groupBy("value").agg(F.count("*").alias("n"))


QUERIES["encodings"] = _encoded
SQL["encodings"] = "SELECT '名' || n_name AS value, 2::BIGINT AS n FROM nation UNION ALL SELECT 'é ÿ' || n_name, 1 FROM nation"


def _sidecar(s, d):
    """A text's tokens in one annotation file; every other one cut into segments, whose heads count from the segment's start."""
    t = annotate(docs(s, d))
    token = F.struct("tok_idx", F.struct("text", F.lit(0).alias("start"), F.lit(1).alias("end"), "pos", "tag", "lemma", "dep", (F.col("head") - F.when(F.col("text_id") % 2 == 1, F.floor(F.col("tok_idx") / 50) * 50).otherwise(0)).cast("int").alias("head"), "is_punct").alias("t"))
    seg = t.groupBy("text_id", F.floor(F.col("tok_idx") / 50).alias("seg")).agg(F.sort_array(F.collect_list(token)).alias("x")).withColumn("tokens", F.transform("x", lambda x: x["t"]))
    whole = seg.where("text_id % 2 = 0").groupBy("text_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seg", "tokens"))), lambda x: x["tokens"])).alias("tokens")).select("text_id", "tokens", F.lit(None).cast("map<string, struct<segment_start: double, segment_end: double, tokens: array<struct<text: string, start: int, `end`: int, pos: string, tag: string, lemma: string, dep: string, head: int, is_punct: boolean>>>>").alias("segments"))
    body = F.struct((F.col("seg") * 1.0).alias("segment_start"), (F.col("seg") + 1.0).alias("segment_end"), "tokens")
    cut = seg.where("text_id % 2 = 1").groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seg").cast("string"), body))).alias("segments")).select("text_id", F.lit(None).cast(whole.schema["tokens"].dataType).alias("tokens"), "segments")
    return readers.read_tokens(s, _written(s, whole.unionByName(cut).drop("text_id"), "json", maxRecordsPerFile=1))


_TOKEN_FILES = "text, pos, tag, lemma, dep, is_punct"
QUERIES["read_tokens"] = lambda s, d: _sidecar(s, d).groupBy("text", "pos", "tag", "lemma", "dep", "is_punct").agg(F.count("*").alias("n"))
SQL["read_tokens"] = f"WITH {TOKENS} SELECT {_TOKEN_FILES}, count(*) AS n FROM tokens GROUP BY ALL"


def _bnc(s, d):
    """Each text as one document of word elements."""
    c5 = F.when(F.col("pos") == "NOUN", "NN1").when(F.col("pos") == "DET", "AT0").otherwise("XX0")
    w = F.format_string('<w c5="%s" hw="%s">%s </w>', c5, F.lower("lemma"), F.lower("text"))
    texts = annotate(docs(s, d)).where("not is_punct").groupBy("text_id").agg(F.array_join(F.collect_list(w), "").alias("w"))
    lines = texts.select(F.concat(F.lit("<bncDoc>"), "w", F.lit("</bncDoc>")).alias("value"))
    return readers.read_bnc(s, _written(s, lines, maxRecordsPerFile=1)).groupBy("word", "lemma", "tag").agg(F.count("*").alias("n"))


QUERIES["read_bnc"] = _bnc
SQL["read_bnc"] = f"WITH {TOKENS} SELECT word, lower(lemma) AS lemma, CASE pos WHEN 'NOUN' THEN 'NN' WHEN 'DET' THEN 'DT' ELSE 'RB' END AS tag, count(*) AS n FROM tokens WHERE NOT is_punct GROUP BY ALL"
QUERIES["read_tagged"] = lambda s, d: readers.read_tagged(s, _written(s, annotate(docs(s, d)).groupBy("text_id", "sent_idx").agg(F.array_join(F.collect_list(F.when(F.col("is_punct"), F.col("text")).otherwise(F.concat_ws("_", "text", "pos"))), " ").alias("value")).select("value"))).groupBy("word", "tag").agg(F.count("*").alias("n"))
SQL["read_tagged"] = f"WITH {TOKENS} SELECT text AS word, CASE WHEN NOT is_punct THEN pos END AS tag, count(*) AS n FROM tokens WHERE text != '_' GROUP BY ALL"
QUERIES["read_frequencies"] = lambda s, d: readers.read_frequencies(s, _written(s, _parts(s, d).select(F.col("p_name").alias("word"), F.col("p_brand").alias("lemma"), F.col("p_type").alias("pos"), F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("freq")), "csv", header=True)).select("word", "lemma", "pos", "freq")
SQL["read_frequencies"] = "SELECT p_name AS word, p_brand AS lemma, p_type AS pos, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END::BIGINT AS freq FROM part"
QUERIES["read_accuracy_list"] = lambda s, d: readers.read_accuracy_list(s, _written(s, _parts(s, d).select(F.upper("p_name").alias("w"), F.col("p_brand").alias("t"), F.col("p_size").alias("n")), "csv", header=True, sep="\t"))
SQL["read_accuracy_list"] = "SELECT lower(p_name) AS word, p_brand AS tag, p_size::BIGINT AS freq FROM part"


def _archives(s, d):
    """Each segment of a conversation as an archive, with positions under the two names in use."""
    c = s.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    new = F.struct(F.expr("left(text, 4)").alias("text"), F.lit(0).alias("startPosition"), F.lit(4).alias("endPosition"), F.col("role").alias("label"))
    one = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("text").alias("type"), F.lit("Roles").alias("framework"), F.col("conv_id").cast("string").alias("textId"), F.array(new).alias("annotations"))
    old = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("text").alias("type"), F.array(F.struct(F.expr("substr(text, 4, 3)").alias("text"), F.lit(3).alias("position"), F.upper("role").alias("label"))).alias("annotations"))
    video = old.withColumn("type", F.lit("video"))
    rows = one.select(F.to_json(F.struct("*")).alias("value")).unionByName(old.select(F.to_json(F.struct("*")).alias("value"))).unionByName(video.select(F.to_json(F.struct("*")).alias("value")))
    path = _written(s, rows)
    return s, path


def _read_archives(s, d):
    spark, path = _archives(s, d)
    return readers.read_archives(spark, path, "text", lines=True)


QUERIES["read_archives"] = _read_archives
SQL["read_archives"] = """WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id::VARCHAR AS doc_id, conv_id || '-' || turn AS coder, 0 AS start, 4 AS "end", role AS label, 'Roles' AS framework FROM c UNION ALL SELECT conv_id || '-' || turn, conv_id || '-' || turn, 3, 3 + length(substr(text, 4, 3))::INT, upper(role), NULL FROM c"""
QUERIES["read_dictionaries"] = lambda s, d: readers.read_dictionaries(s, _written(s, _parts(s, d).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", F.lower("p_name"), "p_partkey"), F.struct(F.col("p_name").alias("word"), F.col("p_type").alias("content"))))).alias("entries")).repartition(32, "p_brand").select("entries"), "json", maxRecordsPerFile=1)).select("key", "word", "content")
SQL["read_dictionaries"] = "SELECT lower(p_name) || ' ' || p_partkey AS key, p_name AS word, p_type AS content FROM part"

_QUERIES = ['[pos="NOUN"] []{0,2} [lemma=="be" & pos!="AUX"]', '"word"', '[]?[word="x"]', "", '[pos="N"', '[foo="x"]', "abc"]
QUERIES["cql_validate"] = lambda s, d: s.createDataFrame([(q, (v := cql.validate(q))["valid"], v["pattern_count"]) for q in _QUERIES], "query string, valid boolean, pattern_count int")
SQL["cql_validate"] = """SELECT unnest(['[pos="NOUN"] []{0,2} [lemma=="be" & pos!="AUX"]', '"word"', '[]?[word="x"]', '', '[pos="N"', '[foo="x"]', 'abc']) AS query, unnest([true, true, true, false, false, false, false]) AS valid, unnest([3, 1, 2, 0, 0, 0, 0]) AS pattern_count"""


def _kwic_by(by):
    def run(s, d):
        t = annotate(docs(s, d))
        return kwic.flat(kwic.sort(kwic.concordance(t, kwic.find(t, "simple", "erth")), by))

    return run


QUERIES["kwic_sort_position"] = lambda s, d: _kwic_by("position")(s, d).select("text_id", "start", "keyword", "rank")
SQL["kwic_sort_position"] = f"WITH {TOKENS}, m AS ({_one("(text = 'erth' OR lemma = 'erth')")}){_LINES} SELECT text_id, start::INT AS start, keyword, row_number() OVER (ORDER BY text_id, start, encode(keyword)) AS rank FROM lines"
# a seeded order: every line once, the ranks without gaps, and not the order of places
QUERIES["kwic_sort_random"] = lambda s, d: _kwic_by("random")(s, d).agg(F.count("*").alias("lines"), F.count_distinct("rank").alias("ranks"), F.max("rank").alias("last"), (F.count_distinct("text_id", "start")).alias("places"))
SQL["kwic_sort_random"] = f"WITH {TOKENS}, m AS ({_one("(text = 'erth' OR lemma = 'erth')")}) SELECT count(*) AS lines, count(*) AS ranks, count(*) AS last, count(*) AS places FROM m"

QUERIES["text_context"] = lambda s, d: docs(s, d).where("length(text) > 5").select("doc_id", *(c.alias(n) for c, n in zip(text.context(F.col("text"), F.lit(40), F.lit(45)), ("before", "after"), strict=True)))
SQL["text_context"] = "SELECT doc_id, substr(text, 11, 30) AS before, substr(text, 46, 30) AS after FROM documents WHERE length(text) > 5"
QUERIES["list_coercion"] = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.array_join(text.list_of(F.when(F.col("c_custkey") % 3 == 0, F.concat_ws("; ", "c_name", "c_mktsegment", F.lit("x"))).when(F.col("c_custkey") % 3 == 1, F.concat_ws(",", "c_name", "c_mktsegment")).otherwise(F.col("c_name"))), "|").alias("items"))
SQL["list_coercion"] = "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name || '|' || c_mktsegment ELSE c_name END AS items FROM customer"


def _addresses(s, d):
    line = F.concat(F.lit("[Doe, J; Roe, A] Univ "), "s_name", F.lit(", Dept X, Town, "), F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws(" ", "n_name", F.lit("12345."))).otherwise(F.col("n_name")))
    inst, country = text.address_parts(line)
    t = s.read.parquet(f"{d}/supplier.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    return t.select("s_suppkey", inst.alias("institution"), country.alias("country"))


QUERIES["address_parts"] = _addresses
SQL["address_parts"] = "SELECT s_suppkey, 'Univ ' || s_name AS institution, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey"
QUERIES["default_thresholds"] = lambda s, d: s.createDataFrame(sorted(stats.THRESHOLDS.items()), "measure string, threshold double")
SQL["default_thresholds"] = "SELECT unnest(['log_likelihood', 'chi_squared', 'log_ratio', 'dice', 'mi', 'mi3', 't_score', 'simple', 'fisher']) AS measure, unnest([6.63, 6.63, 1.0, 0.0, 0.0, 0.0, 1.96, 0.0, 2.0])::DOUBLE AS threshold"
QUERIES["tag_maps"] = lambda s, d: s.createDataFrame([("claws", *x) for x in text.CLAWS_TO_PENN.items()] + [("wordnet", *x) for x in text.PENN_TO_WORDNET.items()], "map string, tag string, mapped string").where("tag like 'N%' or map = 'wordnet'")
SQL["tag_maps"] = "SELECT unnest(['claws', 'claws', 'claws', 'claws', 'claws', 'claws', 'wordnet', 'wordnet', 'wordnet', 'wordnet']) AS map, unnest(['NN0', 'NN1', 'NN2', 'NP0', 'NP1', 'NP2', 'J', 'V', 'N', 'R']) AS tag, unnest(['NN', 'NN', 'NNS', 'NNP', 'NNP', 'NNPS', 'a', 'v', 'n', 'r']) AS mapped"


def _plain_sentences(s, d):
    """Words made into sentences of three with a stop, so that SQL can say where they end."""
    t = docs(s, d).select("doc_id", F.regexp_extract_all("text", F.lit("[a-z]{7,}"), F.lit(0)).alias("w")).where("size(w) >= 3")
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1), lambda i: F.concat(F.lit("X"), F.array_join(F.slice("w", i * 3 + 1, 3), " "), F.lit(".")))
    return t.select("doc_id", F.array_join(each, " ").alias("text"))


QUERIES["sentence_spans"] = lambda s, d: _plain_sentences(s, d).select("doc_id", "text", F.posexplode(shifted(sentences("text"), F.lit(100))).alias("nth", "x")).select("doc_id", "nth", "x.start", "x.end", F.expr("substr(text, x.start - 99, x.end - x.start)").alias("sentence"))
SQL["sentence_spans"] = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-z]{7,}') AS w FROM documents), p AS (SELECT doc_id, unnest(range(len(w) // 3)) AS nth, w FROM w WHERE len(w) >= 3),
x AS (SELECT doc_id, nth, 'X' || array_to_string(w[nth * 3 + 1:nth * 3 + 3], ' ') || '.' AS sentence FROM p), y AS (SELECT *, (100 + sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY nth) - length(sentence) - 1)::INT AS start FROM x)
SELECT doc_id, nth::INT AS nth, start, (start + length(sentence))::INT AS "end", sentence FROM y"""
QUERIES["text_chunks"] = lambda s, d: docs(s, d).select("doc_id", "text", F.posexplode(chunks(F.col("text"), 400)).alias("nth", "x")).groupBy("doc_id").agg(F.sum(F.col("x.end") - F.col("x.start")).alias("chars"), F.min("x.start").alias("first"), F.max("x.end").alias("last"), F.max(F.col("x.end") - F.col("x.start") <= 480).alias("bounded"))
SQL["text_chunks"] = "SELECT doc_id, length(text) AS chars, 0 AS first, length(text)::INT AS last, true AS bounded FROM documents WHERE length(text) > 0"
