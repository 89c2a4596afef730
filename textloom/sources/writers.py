"""Writers: token tables, frequency lists, subtitles, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import srt_time


def write_tokens(tokens: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, a folder per corpus, so that a corpus's scan reads its folder alone."""
    tokens.repartition("corpus", F.pmod(F.xxhash64("text_id"), F.lit(16))).write.partitionBy("corpus").mode(mode).parquet(path)


def write_frequencies(counts: DataFrame, path: str) -> None:
    """word,lemma,pos,freq in descending order, with a header."""
    counts.select("word", "lemma", "pos", "freq").orderBy(F.desc("freq"), "word", "lemma", "pos").write.mode("overwrite").csv(path, header=True)


def build_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(F.lower("text").alias("word"), F.lower("lemma").alias("lemma"), "pos").agg(F.count("*").alias("freq"))


def write_srt(segments: DataFrame, path: str) -> None:
    """Subtitles of (id, start, end, text), numbered from one."""
    body = F.concat_ws("\n", (F.col("id") + 1).cast("string"), F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end"))), F.trim("text"), F.lit(""))
    segments.orderBy("id").select(body.alias("value")).write.mode("overwrite").text(path)


def write_table(result: DataFrame, path: str, kind: str = "csv") -> None:
    """A result as csv with header, tsv, json or parquet; arrays and maps become JSON in text forms."""
    if kind in ("csv", "tsv"):
        flat = result.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in result.dtypes))
        flat.write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        getattr(result.write.mode("overwrite"), kind)(path)


def write_page(page: DataFrame, path: str) -> None:
    """The parts (nth, html) of one page as one text file, in order; a page is small, a part per measure."""
    page.coalesce(1).sortWithinPartitions("nth").select(F.col("html").alias("value")).write.mode("overwrite").text(path)


def write_topics(topics: DataFrame, path: str) -> None:
    """Topic results (topic, term, ...) as JSON, one topic a line with its terms in order of rank."""
    kept = [c for c in topics.columns if c not in ("topic", "rank")]
    topics.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", *kept))).alias("terms")).write.mode("overwrite").json(path)


def write_preprocessed(texts: DataFrame, path: str, config: dict[str, str] | None = None) -> None:
    """Processed texts (text_id, tokens) under path: `texts` with the words joined, `tokens` with the words, their number and the settings."""
    named = [F.lit(x) for kv in (config or {}).items() for x in kv]
    t = texts.withColumn("text_id", F.col("text_id").cast("string"))
    t.select("text_id", F.array_join("tokens", " ").alias("text")).write.mode("overwrite").json(f"{path}/texts")
    t.select("text_id", "tokens", F.size("tokens").alias("word_count"), F.create_map(*named).cast("map<string, string>").alias("config")).write.mode("overwrite").json(f"{path}/tokens")
