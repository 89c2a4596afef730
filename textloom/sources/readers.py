"""Readers: annotated tokens, frequency lists, bibliographic exports, tagged corpora, archives, dictionaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import address_parts, brown_to_penn, claws_to_penn, resource_name

TOKEN = "struct<text: string, start: int, `end`: int, pos: string, tag: string, lemma: string, dep: string, head: int, morph: string, is_stop: boolean, is_punct: boolean, is_space: boolean, usas_tag: string, usas_tags: array<string>, is_metaphor: boolean, metaphor_source: string>"
SIDECAR = f"tokens array<{TOKEN}>, sentences array<struct<text: string, start: int, `end`: int, tokens: array<{TOKEN}>>>, entities array<struct<text: string, start: int, `end`: int, label: string, description: string>>, segments map<string, struct<segment_start: double, segment_end: double, tokens: array<{TOKEN}>>>"
# Document types by the export's names.
DOC_TYPES = {"J": "Journal Article", "Article": "Journal Article", "Journal Article": "Journal Article", "C": "Conference Paper", "Proceedings Paper": "Conference Paper", "Review": "Review", "B": "Book", "Book": "Book", "Book Chapter": "Book Chapter", "D": "Dissertation", "Dissertation": "Dissertation"}


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, segment_id, tok_idx, token fields) of annotation files, whether they hold tokens, sentences or segments.

    Heads inside a segment are numbered from the segment's first token on; missing flags are false.
    """
    raw = spark.read.schema(SIDECAR).json(path, multiLine=True).withColumn("text_id", _stem())
    nested = F.flatten(F.transform("sentences", lambda s: F.coalesce(s["tokens"], F.array().cast(f"array<{TOKEN}>"))))
    plain = raw.where("segments is null").select("text_id", F.lit(None).cast("string").alias("segment_id"), F.posexplode(F.coalesce("tokens", nested)).alias("tok_idx", "t"))
    seg = raw.where("segments is not null").select("text_id", F.posexplode(_in_order("segments")).alias("tok_idx", "x")).select("text_id", "x.segment_id", "tok_idx", "x.i", "x.t")
    seg = seg.withColumn("t", F.col("t").withField("head", F.col("t.head") + F.col("tok_idx") - F.col("i"))).select("text_id", "segment_id", "tok_idx", "t")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("is_punct", "is_space", "is_stop")}
    return plain.unionByName(seg).select("text_id", "segment_id", "tok_idx", "t.*").withColumns(flags)


def _in_order(segments: str) -> Column:
    """All tokens of a row's segments (segment_id, i, t), by their segments' start and name; i is the place in the segment."""
    sorted_ = F.array_sort(F.transform(F.map_entries(segments), lambda e: F.struct(e["value"]["segment_start"].alias("start"), e["key"].alias("id"), e["value"]["tokens"].alias("tokens"))))
    tokens = lambda s: F.coalesce(s["tokens"], F.array().cast(f"array<{TOKEN}>"))
    return F.flatten(F.transform(sorted_, lambda s: F.transform(tokens(s), lambda t, i: F.struct(s["id"].alias("segment_id"), i.alias("i"), t.alias("t")))))


def read_usas(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, segment_id, tok_idx, token fields) of semantic annotation files and of transcripts that hold one.

    Tokens come first, else the segments' in the file's form; a segment's tokens are numbered on from the one before.
    """
    form = f"tokens array<{TOKEN}>, segments map<string, struct<segment_start: double, tokens: array<{TOKEN}>>>"
    raw = spark.read.schema(f"{form}, usas_annotations struct<{form}>").json(path, multiLine=True).withColumn("text_id", _stem())
    raw = raw.select("text_id", *(F.when(F.col("usas_annotations").isNotNull(), F.col(f"usas_annotations.{c}")).otherwise(F.col(c)).alias(c) for c in ("tokens", "segments")))
    plain = raw.where("tokens is not null").select("text_id", F.lit(None).cast("string").alias("segment_id"), F.posexplode("tokens").alias("tok_idx", "t"))
    seg = raw.where("tokens is null").select("text_id", F.posexplode(_in_order("segments")).alias("tok_idx", "x")).select("text_id", "x.segment_id", "tok_idx", "x.t")
    return plain.unionByName(seg.select("text_id", "segment_id", "tok_idx", "t")).select("text_id", "segment_id", "tok_idx", "t.*")


def read_mipvu(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, sent_idx, tok_idx, word, lemma, pos, tag, dep, start, end, is_metaphor, metaphor_source) of metaphor annotations.

    A file is an annotation, or a transcript that holds one, whole or per segment; the sentences of successful
    segments are put together in order. Files that do not report success are left out.
    """
    token = "struct<word: string, lemma: string, pos: string, tag: string, dep: string, start: int, `end`: int, is_metaphor: boolean, metaphor_source: string>"
    form = f"success boolean, sentences array<struct<tokens: array<{token}>>>"
    raw = spark.read.schema(f"{form}, mipvu_annotations struct<{form}, segments: array<struct<mipvu_data: struct<{form}>>>>").json(path, multiLine=True).withColumn("text_id", _stem())
    held = F.col("mipvu_annotations")
    good = F.filter(held["segments"], lambda s: F.coalesce(s["mipvu_data"]["success"], F.lit(False)))
    merged = F.flatten(F.transform(good, lambda s: F.coalesce(s["mipvu_data"]["sentences"], F.array().cast(f"array<struct<tokens: array<{token}>>>"))))
    cut = held["segments"].isNotNull() & held["sentences"].isNull()
    own = F.when(held.isNull(), F.when(F.col("success"), F.col("sentences"))).when(cut, merged).when(held["success"], held["sentences"])
    # numbered in the text's own row, so that no token is shuffled
    each = F.flatten(F.transform(own, lambda s, i: F.transform(F.coalesce(s["tokens"], F.array().cast(f"array<{token}>")), lambda t: F.struct(i.alias("sent_idx"), t.alias("t")))))
    t = raw.select("text_id", F.posexplode(each).alias("tok_idx", "x")).select("text_id", "x.sent_idx", "tok_idx", "x.t")
    return t.select("text_id", "sent_idx", "tok_idx", "t.*").withColumn("is_metaphor", F.coalesce("is_metaphor", F.lit(False)))


def _stem() -> Column:
    """The file's name without .json and the kind before it."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)?\.json$", 1)


def read_preprocessed(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, text, tokens, word_count, config) as write_preprocessed() has them."""
    texts = spark.read.schema("text_id string, text string").json(f"{path}/texts")
    tokens = spark.read.schema("text_id string, tokens array<string>, word_count bigint, config map<string, string>").json(f"{path}/tokens")
    return texts.join(tokens, "text_id")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, category, word, lemma, pos, freq): CSV lists with their names' parts; numbers that are none count zero."""
    t = spark.read.schema("word string, lemma string, pos string, freq string").csv(path, header=True)
    prefix, category = resource_name(F.input_file_name())
    return t.select(prefix.alias("prefix"), category.alias("category"), "word", "lemma", "pos", F.coalesce(F.col("freq").try_cast("bigint"), F.lit(0)).alias("freq"))


def resources(frequencies: DataFrame) -> DataFrame:
    """(prefix, category, words, tokens) of the lists at hand."""
    return frequencies.groupBy("prefix", "category").agg(F.count_distinct("word").alias("words"), F.sum("freq").alias("tokens"))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8, else GBK, else Latin-1, which always works."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for encoding in ("utf-8-sig", "gbk"):
            try:
                return b.decode(encoding)
            except UnicodeDecodeError:
                pass
        return b.decode("latin-1")

    return content.map(one)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files as text, whatever their encoding."""
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("value"))


def source_type(value: Column) -> Column:
    """WOS or CNKI by an export's marks, null if none shows; the whole content counts, and WOS's first marks before CNKI's."""
    ends = value.contains("\nER\n") | F.rtrim(F.regexp_replace(value, r"\s+$", "")).endswith("ER")
    wos = F.left(value, F.lit(500)).contains("Clarivate Analytics Web of Science") | ends
    cnki = value.contains("\nDS CNKI") | value.contains("\nCN ")
    return F.when(wos, "WOS").when(cnki, "CNKI").when(value.contains("\nUT WOS:") | value.contains("\nUT KJD:"), "WOS")


def _fields(files: DataFrame, records: Column, continuation: str, glue: str) -> DataFrame:
    """(path, record, raw): tagged lines folded with the lines that continue them, as a map per record."""
    r = files.select("path", F.posexplode(records).alias("record", "body")).where(F.trim("body") != "")
    line = r.select("path", "record", F.posexplode(F.split("body", r"\r?\n")).alias("i", "line"))
    tagged = F.col("line").rlike(r"^[A-Z][A-Z0-9](\s|$)")
    w = Window.partitionBy("path", "record").orderBy("i")
    line = line.withColumn("field", F.sum(F.when(tagged, 1).otherwise(0)).over(w)).where((F.col("field") > 0) & (tagged | F.col("line").rlike(continuation)))
    text = F.when(tagged, F.trim(F.substring("line", 3, (1 << 31) - 1))).otherwise(F.trim("line"))
    f = line.select("path", "record", "field", "i", F.when(tagged, F.left("line", F.lit(2))).alias("tag"), text.alias("text"))
    f = f.groupBy("path", "record", "field").agg(F.max("tag").alias("tag"), F.sort_array(F.collect_list(F.struct("i", "text"))).alias("x"))
    f = f.select("path", "record", "field", "tag", F.trim(F.array_join(F.transform("x", lambda x: x["text"]), glue)).alias("value"))
    # a tag that comes again overwrites, but for authors, of which each may have its own line
    f = f.groupBy("path", "record", "tag").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("x"))
    values = F.transform("x", lambda x: x["value"])
    f = f.select("path", "record", "tag", F.when(F.col("tag").isin("A1", "AU", "K1"), F.array_join(values, "\n")).otherwise(F.element_at(values, -1)).alias("value"))
    return f.groupBy("path", "record").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("raw"))


def _list(raw: Column, separator: str) -> Column:
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), separator), lambda x: F.trim(F.regexp_replace(F.trim(x), ",+$", "")))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def read_wos(files: DataFrame) -> DataFrame:
    """Entries of Web of Science exports (path, value); header lines do not cost the first record."""
    body = F.regexp_replace("value", r"(?m)^(FN|VR|EF)( .*)?$", "")
    raw = lambda *k: F.coalesce(*(F.nullif(F.trim(F.col("raw")[x]), F.lit("")) for x in k))
    t = _fields(files, F.split(body, r"\r?\nER[ \t]*(?:\r?\n|$)"), r"^   ", "\n").where(F.trim(F.col("raw")["TI"]) != "")
    lines = F.filter(F.split(F.coalesce(raw("C1"), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    keys = F.array_union(_list(F.col("raw")["DE"], ";"), _list(F.col("raw")["ID"], ";"))
    stop = "the a an of in on for to and or by from with as at is are was were be been its this that these those using based".split()
    title = F.slice(F.filter(F.regexp_extract_all(F.lower(raw("TI")), F.lit(r"[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*stop)), 1, 5)
    pages = F.when(raw("EP").isNotNull() & raw("BP").isNotNull(), F.concat_ws("-", raw("BP"), raw("EP"))).otherwise(raw("BP"))
    reprint = F.filter(F.array(F.trim(F.try_element_at(F.split(F.coalesce(raw("RP"), F.lit("")), ","), F.lit(2)))), lambda x: F.length(x) > 3)
    places = F.array_distinct(F.filter(F.transform(lines, lambda x: address_parts(x)[0]), lambda x: x != ""))
    return _entries(
        t, raw("TI"), _list(raw("AU", "AF"), "\n"), F.when(F.size(places) > 0, places).otherwise(reprint),
        F.array_distinct(F.array_compact(F.transform(lines, lambda x: address_parts(x)[1]))), raw("SO"), raw("PY"), F.when(F.size(keys) > 0, keys).otherwise(title),
        raw("DT", "PT"), F.coalesce(*(raw(k).try_cast("bigint") for k in ("TC", "Z9", "U1")), F.lit(0)), raw("UT"), pages,
    )


def read_cnki(files: DataFrame) -> DataFrame:
    """Entries of CNKI exports: records between blank lines, continued lines joined by a blank; ids are hashes of title and authors."""
    raw = lambda *k: F.coalesce(*(F.nullif(F.trim(F.col("raw")[x]), F.lit("")) for x in k))
    t = _fields(files, F.split("value", r"\r?\n[ \t]*\r?\n"), r"^[ \t]", " ").where(F.trim(F.col("raw")["T1"]) != "")
    unique = F.sha2(F.concat_ws("|", raw("T1"), raw("A1"), raw("YR")), 256)
    return _entries(
        t, raw("T1"), _list(raw("A1"), "[;\n]"), _list(raw("AD"), ";"), F.array().cast("array<string>"), raw("JF"), raw("YR"),
        _list(raw("K1"), "[;\n]"), raw("RT"), F.lit(0).cast("bigint"), unique, raw("OP"),
    )


def _entries(t, title, authors, institutions, countries, journal, year, keywords, kind, citations, unique, pages) -> DataFrame:
    types = F.create_map(*(F.lit(x) for kv in DOC_TYPES.items() for x in kv))
    year = F.regexp_extract(year, r"(\d{4})", 1).try_cast("int")
    cols = {"title": title, "authors": authors, "institutions": institutions, "countries": countries, "journal": journal, "year": year, "keywords": keywords, "doc_type": F.coalesce(types[kind], F.lit("Other")), "citation_count": citations, "unique_id": unique, "pages": pages}
    return t.select(F.sha2(F.concat_ws("|", "path", "record"), 256).alias("id"), *(c.alias(n) for n, c in cols.items()), F.col("raw").alias("raw_data"))


def read_bnc(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, word, lemma, tag) of <w c5 hw> elements, tags mapped to Penn's."""
    t = spark.read.format("xml").option("rowTag", "w").schema("_c5 string, _hw string, _VALUE string").load(path)
    return t.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1).alias("text_id"), F.trim("_VALUE").alias("word"), F.col("_hw").alias("lemma"), claws_to_penn(F.col("_c5")).alias("tag"))


def read_brown(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, word, lemma, tag) of plain texts of word/tag pairs, tags mapped to Penn's; quotes and dashes are left out."""
    t = spark.read.text(path).select(_text_id(), F.explode(F.split("value", r"\s+")).alias("p")).where(F.col("p").rlike(r"^\S+/\S+$"))
    t = t.select("text_id", F.regexp_extract("p", r"^(\S+)/(\S+)$", 1).alias("word"), brown_to_penn(F.regexp_extract("p", r"^(\S+)/(\S+)$", 2)).alias("tag"))
    return t.where(~F.col("word").isin("``", "''", "--")).select("text_id", "word", F.lower("word").alias("lemma"), "tag")


def read_oanc(spark: SparkSession, path: str, elements: tuple[str, ...] = ("tok", "token", "word", "w")) -> DataFrame:
    """(text_id, word, lemma, tag) of the XML elements in use for words; the tag is pos, else type, else NN. Each element is one scan."""
    out = None
    for name in elements:
        t = spark.read.format("xml").option("rowTag", name).schema("_pos string, _type string, _lemma string, _VALUE string").load(path)
        tag = F.coalesce(F.nullif(F.coalesce("_pos", "_type"), F.lit("")), F.lit("NN"))
        t = t.select(_text_id(), F.trim("_VALUE").alias("word"), F.coalesce("_lemma", F.lower(F.trim("_VALUE"))).alias("lemma"), tag.alias("tag")).where("word != ''")
        out = t if out is None else out.unionByName(t)
    return out


def read_plain_words(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(text_id, word) of plain texts: words of letters only, of `least` or more. They bring no tags."""
    t = spark.read.text(path).select(_text_id(), F.explode(F.regexp_extract_all("value", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    return t.where(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") >= least))


def _text_id() -> Column:
    """The file's name without its ending."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("text_id")


def read_tagged(spark: SparkSession, path: str, mark: str = "_") -> DataFrame:
    """(text_id, word, tag) of plain texts of word_TAG pairs."""
    t = spark.read.text(path).select(_text_id(), F.explode(F.split(F.trim("value"), r"\s+")).alias("p")).where("p != ''")
    at = F.length("p") - F.locate(mark, F.reverse("p"))
    return t.select("text_id", F.when(F.locate(mark, F.col("p")) > 0, F.substring(F.col("p"), F.lit(1), at)).otherwise(F.col("p")).alias("word"), F.when(F.locate(mark, F.col("p")) > 0, F.substring(F.col("p"), at + 2, F.length("p"))).alias("tag"))


def read_archives(spark: SparkSession, path: str, kind: str | None = None, text_id: str | None = None, lines: bool = False) -> DataFrame:
    """(doc_id, coder, start, end, label, framework) of annotation archives, one JSON document a file, or a line, under any of the field names in use."""
    item = "struct<text: string, position: int, startPosition: int, start_position: int, endPosition: int, end_position: int, label: string, path: string, labelPath: string>"
    t = spark.read.schema(f"id string, type string, framework string, text string, textId string, coderName string, annotations array<{item}>").json(path, multiLine=not lines)
    t = t.where(F.col("type") == kind) if kind else t
    t = t.where(F.col("textId") == text_id) if text_id else t
    a = t.select(F.coalesce("textId", "id").alias("doc_id"), F.coalesce("coderName", "id").alias("coder"), "framework", F.explode("annotations").alias("a"))
    start = F.coalesce("a.startPosition", "a.position", "a.start_position", F.lit(0))
    return a.select("doc_id", "coder", start.alias("start"), F.coalesce("a.endPosition", "a.end_position", start + F.length("a.text")).alias("end"), "a.label", "framework")


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """(dict, key, word, content) of JSON dictionaries, one a file."""
    t = spark.read.schema("entries map<string, struct<word: string, content: string>>").json(path, multiLine=True)
    return t.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("dict"), F.explode("entries").alias("key", "e")).select("dict", "key", "e.word", "e.content")


def read_accuracy_list(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(word, tag, freq) of frequency files with a header, for accuracy comparison."""
    t = spark.read.schema("word string, tag string, freq string").csv(path, sep=separator, header=True)
    return t.select(F.lower("word").alias("word"), "tag", F.coalesce(F.col("freq").try_cast("bigint"), F.lit(0)).alias("freq"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, rank, term, frequency, score) of topic results as write_topics() has them."""
    t = spark.read.schema("topic string, terms array<struct<rank: bigint, term: string, frequency: bigint, score: double>>").json(path)
    return t.select("topic", F.inline("terms"))
