"""Registered queries: text functions, dates, catalogue, dictionary, resources, frameworks, media, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import dates, text
from textloom.operators import catalog, dictionary, frameworks, freq, intervals, keyness, media, segmentation
from textloom.operators.tokens import annotate, corpus_tokens
from textloom.plans.frequency import docs
from textloom.plans.sql import STOPS, TOKENS
from textloom.runtime import shared_dir
from textloom.sources import writers
from textloom.streaming import counts

QUERIES: dict = {}
SQL: dict[str, str] = {}
_PUNCT = r"[!-/:-@\[-`{-~\x{3000}-\x{303E}\x{FF00}-\x{FFEE}]"

QUERIES["preprocess_pipeline"] = lambda s, d: docs(s, d).select("doc_id", F.array_join(text.preprocess(F.col("text"), patterns=[r"\d+", "(bad"], normalise=False), " ").alias("tokens"))
SQL["preprocess_pipeline"] = rf"""WITH c AS (SELECT doc_id, regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '\d+', '', 'g'), '\s+', ' ', 'g'), '\p{{Cc}}', '', 'g'))), '{_PUNCT}', '', 'g') AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({STOPS})), ' ') AS tokens FROM c"""
QUERIES["preprocess_nfkc"] = lambda s, d: docs(s, d).select("doc_id", text.nfkc("text").alias("text"))
QUERIES["text_word_counts"] = lambda s, d: docs(s, d).select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("words"))
SQL["text_word_counts"] = r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents"


def _raw_dates(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate")
    forms = [F.date_format(day, f) for f in ("yyyy-MM-dd", "yyyy/M/d", "yyyy.MM.dd", "yyyyMMdd", "yyyy")] + [F.lit("n/a"), F.lit("1998-02-31 x"), F.lit("  12345 ")]
    k = F.col("o_orderkey") % len(forms)
    raw = forms[-1]
    for i, f in enumerate(forms[:-1]):
        raw = F.when(k == i, f).otherwise(raw)
    return o.select("o_orderkey", raw.alias("raw"))


_RAW = """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%-m/%-d') WHEN 2 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 3 THEN strftime(o_orderdate, '%Y%m%d')
  WHEN 4 THEN strftime(o_orderdate, '%Y') WHEN 5 THEN 'n/a' WHEN 6 THEN '1998-02-31 x' ELSE '  12345 ' END AS raw, o_orderdate::DATE AS d FROM orders),
p AS (SELECT o_orderkey, raw, CASE WHEN o_orderkey % 8 < 4 THEN date_diff('day', DATE '1970-01-01', d) WHEN o_orderkey % 8 = 4 THEN date_diff('day', DATE '1970-01-01', make_date(year(d), 1, 1)) WHEN o_orderkey % 8 = 7 THEN 12345 END::INT AS days FROM r)"""
QUERIES["date_parse"] = lambda s, d: _raw_dates(s, d).withColumn("days", dates.days(F.col("raw"))).withColumn("year", dates.display(F.col("days"))).withColumn("full_date", dates.display(F.col("days"), True))
SQL["date_parse"] = _RAW + " SELECT o_orderkey, raw, days, strftime(DATE '1970-01-01' + days, '%Y') AS year, strftime(DATE '1970-01-01' + days, '%Y-%m-%d') AS full_date FROM p"


def _coverage(s, d):
    from textloom.operators.topics import date_coverage

    return date_coverage(_raw_dates(s, d).select("raw", dates.days(F.col("raw")).alias("date")))


QUERIES["date_coverage"] = _coverage
SQL["date_coverage"] = _RAW + """ SELECT count(days) AS with_date, count(*) FILTER (trim(raw) = '') AS without_date, count(*) FILTER (days IS NULL) AS parse_errors, min(days) AS first, max(days) AS last, count(DISTINCT days) AS distinct_dates, count(days) >= 2 AND count(DISTINCT days) >= 2 AS usable FROM p"""


def _segments(s, d):
    """Turns of a conversation as segments of one token stream."""
    c = s.read.parquet(f"{d}/conversations.parquet").withColumn("source", F.col("role")).withColumn("lang", F.lit("")).withColumn("doc_id", F.struct("conv_id", "turn"))
    return corpus_tokens(c)


QUERIES["segment_frequency"] = lambda s, d: freq.word_frequency(_segments(s, d), least=2)
SQL["segment_frequency"] = r"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS word FROM conversations), c AS (SELECT word, count(*) AS frequency FROM w GROUP BY 1 HAVING count(*) >= 2)
SELECT word, frequency, round(frequency * 100.0 / sum(frequency) OVER (), 4)::DOUBLE AS percentage, row_number() OVER (ORDER BY frequency DESC, encode(word)) AS rank FROM c"""


def _texts(s, d):
    return docs(s, d).select(F.col("doc_id").alias("text_id"), F.col("source").alias("corpus_id"), F.col("lang").alias("media_type"), "n_chars")


QUERIES["catalog_list"] = lambda s, d: catalog.list_texts(_texts(s, d), "src3", "en")
SQL["catalog_list"] = "SELECT doc_id AS text_id, source AS corpus_id, lang AS media_type, n_chars FROM documents WHERE source = 'src3' AND lang = 'en'"
QUERIES["catalog_select"] = lambda s, d: catalog.select_texts(_texts(s, d), s.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("text_id")))
SQL["catalog_select"] = "SELECT doc_id AS text_id, source AS corpus_id, lang AS media_type, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
QUERIES["catalog_tags"] = lambda s, d: catalog.having_tags(catalog.with_tags(_texts(s, d).withColumn("name", F.concat(F.lit("Text "), "text_id")), s.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id text_id", "concat('q', quality) tag").unionByName(s.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id text_id", "concat('t', toxic) tag"))), ["q1", "t0"], "text").select("text_id", F.array_join("tags", ",").alias("tags"))
SQL["catalog_tags"] = "SELECT doc_id AS text_id, 'q1,t0' AS tags FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0"
QUERIES["archive_upsert"] = lambda s, d: catalog.upsert(docs(s, d).select("doc_id", "source", "lang"), s.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") + F.col("toxic") * 1000000).alias("doc_id"), F.when(F.col("quality") == 0, "low").alias("source"), F.lit(None).cast("string").alias("lang")), "doc_id")
SQL["archive_upsert"] = """WITH n AS (SELECT doc_id + toxic * 1000000 AS doc_id, CASE WHEN quality = 0 THEN 'low' END AS source FROM labels) SELECT coalesce(n.doc_id, d.doc_id) AS doc_id, coalesce(n.source, d.source) AS source, d.lang FROM documents d FULL JOIN n ON n.doc_id = d.doc_id"""


def _entries(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_brand").alias("dict"), F.lower(F.concat_ws(" ", "p_name", "p_partkey")).alias("key"), F.concat_ws(" ", "p_name", "p_partkey").alias("word"), F.concat(F.lit('x @@@LINK=w y <a href="entry://'), "p_type", F.lit('">see</a>')).alias("content"))


_ENTRIES = """WITH e AS (SELECT p_brand AS dict, lower(p_name || ' ' || p_partkey) AS key, p_name || ' ' || p_partkey AS word,
  'x <a class="dict-link" data-word="w" href="javascript:void(0)">w</a> y <a class="dict-link" data-word="' || p_type || '" href="javascript:void(0)">see</a>' AS content FROM part)"""
QUERIES["dictionary_lookup"] = lambda s, d: dictionary.lookup(_entries(s, d), " Ring 1")
SQL["dictionary_lookup"] = _ENTRIES + """, o AS (SELECT *, CASE WHEN key = 'ring 1' THEN 0 WHEN starts_with(key, 'ring 1') THEN 1 WHEN contains(key, 'ring 1') THEN 2 END AS o FROM e)
SELECT dict, word, key AS matched_key, o > 0 AS fuzzy, content FROM (SELECT *, row_number() OVER (PARTITION BY dict ORDER BY o, encode(key)) AS nth FROM o WHERE o IS NOT NULL) WHERE nth = 1"""
QUERIES["dictionary_suggestions"] = lambda s, d: dictionary.suggestions(_entries(s, d), "Red w", 15)
SQL["dictionary_suggestions"] = _ENTRIES + " SELECT DISTINCT word FROM e WHERE starts_with(key, 'red w') ORDER BY length(word), encode(lower(word)), encode(word) LIMIT 15"


def _resource_rows(s, d):
    return writers.build_frequencies(annotate(docs(s, d)).where("not is_punct"))


QUERIES["resource_frequency"] = _resource_rows
SQL["resource_frequency"] = f"WITH {TOKENS} SELECT word, lower(lemma) AS lemma, pos, count(*) AS freq FROM tokens WHERE NOT is_punct GROUP BY 1, 2, 3"
QUERIES["resource_words"] = lambda s, d: keyness.resource_counts(_resource_rows(s, d).withColumn("freq", F.when(F.col("pos") == "NUM", "x").otherwise(F.col("freq").cast("string"))))
SQL["resource_words"] = f"WITH {TOKENS} SELECT word, sum(CASE WHEN pos = 'NUM' THEN 0 ELSE 1 END)::BIGINT AS freq FROM tokens WHERE NOT is_punct GROUP BY 1"


def _resource_search(s, d):
    names = s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("/x/bnc_"), F.lower("n_name"), F.lit(".csv")).alias("path"), (F.col("n_nationkey") * 123456).alias("n"))
    prefix, category = text.resource_name(F.col("path"))
    return names.select(prefix.alias("prefix"), category.alias("category"), text.human_count(F.col("n")).alias("count")).where(F.col("category").contains("a"))


QUERIES["resource_search"] = _resource_search
SQL["resource_search"] = """SELECT 'bnc' AS prefix, lower(n_name) AS category, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0) ELSE n::VARCHAR END AS count FROM (SELECT n_name, n_nationkey * 123456 AS n FROM nation) WHERE contains(lower(n_name), 'a')"""


def _detections(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("label"), F.col("event_id").alias("frame"), F.col("value").alias("time"))


QUERIES["track_segments"] = lambda s, d: media.track_segments(_detections(s, d))
SQL["track_segments"] = """WITH n AS (SELECT user_id AS track_id, event_type AS label, count(*) AS n, min(event_id) AS f0, max(event_id) AS f1, min(value) AS t0, max(value) AS t1 FROM events GROUP BY 1, 2)
SELECT track_id, arg_min(label, (-n, label)) AS label, sum(n)::BIGINT AS detections, min(f0) AS start_frame, max(f1) AS end_frame, min(t0) AS start_time, max(t1) AS end_time FROM n GROUP BY 1"""
QUERIES["frame_labels"] = lambda s, d: media.top_label(_detections(s, d).groupBy(F.col("track_id").alias("frame"), "label").agg(F.round(F.sum("time"), 2).alias("v")).groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("scores")))
SQL["frame_labels"] = """WITH n AS (SELECT user_id AS frame, event_type AS label, round(sum(value), 2) AS v FROM events GROUP BY 1, 2) SELECT frame, arg_min(label, (-v, label)) AS label, max(v) AS score FROM n GROUP BY 1"""
QUERIES["waveform_peaks"] = lambda s, d: media.waveform_peaks(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("i"), (F.col("value") - 50).alias("value")), 500)
SQL["waveform_peaks"] = """WITH b AS (SELECT floor(event_id * 500 / (SELECT max(event_id) + 1 FROM events))::BIGINT AS bucket, max(abs(value - 50)) AS v FROM events GROUP BY 1) SELECT bucket, round(v / max(v) OVER (), 4) AS peak FROM b"""


def _chunks(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), (F.col("turn") * 10.0).alias("start"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 10.0 + 7.5).alias("end"), "text")


_TIMES = r"""WITH c AS (SELECT conv_id * 1000 + turn AS chunk_id, turn * 10.0::DOUBLE AS s, CASE WHEN turn % 2 = 0 THEN turn * 10.0::DOUBLE + 7.5 ELSE turn * 10.0::DOUBLE + 1 END AS e, regexp_extract_all(text, '\S+') AS w FROM conversations),
t AS (SELECT chunk_id, nth, word, s + nth * dur AS a, s + nth * dur + dur AS b FROM (SELECT chunk_id, s, (e - s) / len(w) AS dur, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS nth FROM c WHERE len(w) > 0)), wt AS (SELECT chunk_id, nth::INT AS nth, word, round(a, 4) AS start, round(b, 4) AS "end" FROM t)"""
QUERIES["word_timestamps"] = lambda s, d: media.word_times(_chunks(s, d))
SQL["word_timestamps"] = _TIMES + " SELECT * FROM wt"
QUERIES["sentence_sessions"] = lambda s, d: media.sentence_sessions(media.word_times(_chunks(s, d)))
SQL["sentence_sessions"] = _TIMES + r""", x AS (SELECT *, coalesce(sum(regexp_matches(word, '[.!?;:]+$')::INT) OVER (PARTITION BY chunk_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM wt)
SELECT chunk_id, sentence, count(*) AS words, min(start) AS start, max("end") AS "end", string_agg(word, ' ' ORDER BY nth) AS text FROM x GROUP BY 1, 2"""
QUERIES["subtitles"] = lambda s, d: _chunks(s, d).select("chunk_id", text.srt_time(F.col("start") + 0.25).alias("start"))
SQL["subtitles"] = "SELECT conv_id * 1000 + turn AS chunk_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS start FROM (SELECT conv_id, turn, turn * 10000 + 250 AS ms FROM conversations)"


def _framework(s, d):
    r, n = s.read.parquet(f"{d}/region.parquet"), s.read.parquet(f"{d}/nation.parquet")
    kids = n.groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("label").alias("type"))))).alias("kids"))
    one = r.join(kids, F.col("r_regionkey") == F.col("n_regionkey")).select(F.format_string('{"name": "%s", "root": {"id": "r", "name": "root", "type": "tier", "children": [{"id": "a", "name": "All", "type": "tier", "children": %s}]}}', F.col("r_name"), F.col("kids")).alias("value"))
    return frameworks.flatten(one)


QUERIES["framework_paths"] = lambda s, d: frameworks.rename(_framework(s, d), "ASIA", "/root/All", "Countries").select("framework", "node_id", "parent_id", "name", "depth", "path")
SQL["framework_paths"] = """SELECT r_name AS framework, 'r' AS node_id, NULL AS parent_id, 'root' AS name, 0 AS depth, '/root' AS path FROM region UNION ALL SELECT r_name, 'a', 'r', CASE WHEN r_name = 'ASIA' THEN 'Countries' ELSE 'All' END, 1, CASE WHEN r_name = 'ASIA' THEN '/root/Countries' ELSE '/root/All' END FROM region
UNION ALL SELECT r_name, 'n' || n_nationkey, 'a', n_name, 2, CASE WHEN r_name = 'ASIA' THEN '/root/Countries/' ELSE '/root/All/' END || n_name FROM nation JOIN region ON n_regionkey = r_regionkey"""


def _merged(s, d):
    from textloom.plans.agreement import spans

    t = spans(s, d).select("doc_id", "start", "end", "label", "coder")
    return frameworks.merge_annotations(t.where("coder = '1'").drop("coder"), t.where("coder = '2'").drop("coder"))


def _merged_sql():
    from textloom.plans.agreement import _SPANS

    return _SPANS + """, m AS (SELECT doc_id, start, "end", label FROM spans WHERE coder = '1'), a AS (SELECT doc_id, start, "end", label FROM spans WHERE coder = '2')
    SELECT * FROM m UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = a.doc_id AND a.start < m."end" AND m.start < a."end")"""


QUERIES["auto_annotation_merge"] = _merged
SQL["auto_annotation_merge"] = _merged_sql()


def _coders(s, d):
    """Two coders' spans; the second's first label reaches two places on, so that some cross."""
    from textloom.plans.agreement import spans

    t = spans(s, d).select("doc_id", "start", "end", "label", "coder")
    wide = F.when(F.col("label") == "A", F.col("end") + F.col("start") % 3).otherwise(F.col("end")).cast("int")
    return t.where("coder = '1'").drop("coder"), t.where("coder = '2'").drop("coder").withColumn("end", wide)


_TWO = """, m AS (SELECT doc_id, start, "end", label FROM spans WHERE coder = '1'), a AS (SELECT doc_id, start, (CASE WHEN label = 'A' THEN "end" + start % 3 ELSE "end" END)::INT AS "end", label FROM spans WHERE coder = '2')"""
QUERIES["annotation_merge"] = lambda s, d: frameworks.merge_distinct(*_coders(s, d))
SQL["annotation_merge"] = _merged_sql().split(", m AS (")[0] + _TWO + """ SELECT * FROM m UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = a.doc_id AND m.start = a.start AND m."end" = a."end" AND m.label = a.label)"""
QUERIES["annotation_conflicts"] = lambda s, d: frameworks.conflicts(*_coders(s, d))
SQL["annotation_conflicts"] = _merged_sql().split(", m AS (")[0] + _TWO + """ SELECT * FROM a WHERE EXISTS (SELECT 1 FROM m WHERE m.doc_id = a.doc_id AND (m.start < a.start AND a.start < m."end" AND m."end" < a."end" OR a.start < m.start AND m.start < a."end" AND a."end" < m."end"))"""


def _pieces(s, d, separator, number):
    """Stretches of the documents between separators, with their places in characters."""
    # only lengths leave the texts, as one array each, so that the window needs no shuffle of pieces
    t = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.transform(F.split("text", separator, -1), F.length).alias("n")).repartition("doc_id").select("doc_id", F.posexplode("n").alias("i", "n"))
    at = Window.partitionBy("doc_id").orderBy("i")
    end = F.sum(F.col("n") + 1).over(at) - 1
    return t.select("doc_id", (F.col("i") + 1).alias(number), (end - F.col("n")).alias("start"), end.alias("end"))


_PIECES = """WITH {0} AS (SELECT doc_id, nth, stop - length(piece) AS start, stop FROM (SELECT doc_id, nth, piece, (sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY nth) - 1)::BIGINT AS stop
  FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS nth FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))),
{1} AS (SELECT doc_id, nth AS word, stop - length(piece) AS start, stop FROM (SELECT doc_id, nth, piece, (sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY nth) - 1)::BIGINT AS stop
  FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS nth FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents))))"""
QUERIES["token_sentences"] = lambda s, d: intervals.first_holder(_pieces(s, d, " ", "word"), _pieces(s, d, "\n", "nth")).select("doc_id", "word", F.col("start").cast("bigint").alias("start"), F.col("nth").alias("sentence"))
SQL["token_sentences"] = _PIECES.format("l", "w") + """ SELECT w.doc_id, w.word::INT AS word, w.start, coalesce(min(l.nth), 0)::INT AS sentence
FROM w LEFT JOIN l ON w.doc_id = l.doc_id AND l.start <= w.start AND w.start < l.stop GROUP BY 1, 2, 3"""
QUERIES["sentence_tokens"] = lambda s, d: intervals.holders(_pieces(s, d, " ", "word"), _pieces(s, d, "\n", "nth")).groupBy("doc_id", F.col("nth").alias("sentence")).agg(F.count("*").alias("words"), F.min("word").alias("first"), F.max("word").alias("last"))
SQL["sentence_tokens"] = _PIECES.format("l", "w") + " SELECT w.doc_id, l.nth::INT AS sentence, count(*) AS words, min(word)::INT AS first, max(word)::INT AS last FROM w JOIN l ON w.doc_id = l.doc_id AND w.start >= l.start AND w.stop <= l.stop GROUP BY 1, 2"
QUERIES["json_properties"] = lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
SQL["json_properties"] = "SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1"


def _stream(s, d):
    """Daily counts of events by type, made by a stream that reads the table as it finds it; it closes all windows but the last."""
    path = f"{shared_dir(s)}/textloom/stream-{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if not d.endswith("/") else "*").parquet(d).withColumnRenamed("event_type", "term").withColumn("ts", F.col("ts").cast("timestamp"))
    counts.write_counts(counts.windowed_counts(stream), f"{path}/out", f"{path}/state").awaitTermination()
    out = s.read.schema("window_start timestamp, term string, n bigint, value double").parquet(f"{path}/out")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "term", "n", F.round("value", 2).alias("value"))


QUERIES["streaming_counts"] = _stream
SQL["streaming_counts"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS term, count(*) AS n, round(sum(value), 2) AS value FROM events
WHERE ts::DATE + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"""


def _unspaced(s, d):
    """Names of parts without their spaces, cut again by a lattice over the words that names are made of."""
    p = s.read.parquet(f"{d}/part.parquet")
    words = p.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    cut = segmentation.segment(p.select("p_partkey", F.translate("p_name", " ", "").alias("text")), words, pattern="[a-z]+", longest=12)
    return cut.select("p_partkey", F.array_join("words", " ").alias("words"))


QUERIES["segmented_words"] = _unspaced
SQL["segmented_words"] = "SELECT p_partkey, p_name AS words FROM part"
