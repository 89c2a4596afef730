"""The queries opN_<name> and pipeline, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), report=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.chat import chat_digests

    hard = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat_digests(turns.unionByName(extra))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.embeddings import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), F.col("component_id").cast("bigint").alias("component_id"), "kept")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.quality import apply_policy, ledger

    found = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.pii import find

    return find(table(spark, sf_dir, "documents"), longest=None)


#: The ledger of op7 with its rules and policy written out.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n >= 2
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM repeated, range(3) AS o(k) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{C0}-\x{10FFFF}]')))::BIGINT AS n_letter_words,
         len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_marks, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper,
         len(regexp_extract_all(t, '[A-Za-z]'))::BIGINT AS n_letters
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
), b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
            + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT
            + 64 * (10 * n_marks > 5 * n_words)::BIGINT + 128 * (n_letters >= 50 AND 10 * n_upper > 6 * n_letters)::BIGINT
            + 256 * (10 * n_letter_words < 6 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 != 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


def _sql() -> dict[str, str]:
    from textloom.llm import codes, mixing, pii

    return {"op7_quality": OP7_SQL, "op8_mixing": mixing.SQL, "op12_codes": codes.SQL, "op13_pii": pii.sql()}


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_chat, op4_substring, op5_embeddings, op6_html, op7_quality, op8_mixing, op9_langid, op10_line_dedup, op11_alignment, op12_codes, op13_pii, pipeline)}
SQL: dict[str, str] = _sql()
