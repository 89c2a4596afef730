"""Chunks of texts for embedding: greedy packing of sentences, merging of short paragraphs, fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_chunks(tokens: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(text_id, chunk, n, text): windows of `size` tokens, each starting size - overlap behind the one before."""
    step = max(1, size - overlap)
    last = F.floor(F.col("tok_idx") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("tok_idx") - size + 1) / step))
    t = tokens.select("text_id", "tok_idx", "text", F.explode(F.sequence(first, last)).alias("chunk"))
    g = t.groupBy("text_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("tok_idx", "text"))).alias("x"))
    return g.select("text_id", "chunk", F.size("x").alias("n"), F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))


def _pack(sizes: Column, most: int) -> Column:
    """Per sentence its chunk: a chunk takes sentences while their sizes stay within `most`."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["sum"] == 0) | (acc["sum"] + n <= most)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        return F.struct(chunk.alias("chunk"), F.when(fits, acc["sum"] + n).otherwise(n).cast("int").alias("sum"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def sentence_chunks(sentences: DataFrame, most: int = 256) -> DataFrame:
    """(text_id, chunk, first, last, n): sentences (text_id, sent_idx, n) packed in order; one over `most` is a chunk of its own."""
    g = sentences.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", F.col("n").cast("int").alias("n")))).alias("s"))
    g = g.withColumn("c", _pack(F.transform("s", lambda s: s["n"]), most))
    x = g.select("text_id", F.explode(F.arrays_zip("s", "c")).alias("x")).select("text_id", F.col("x.c").alias("chunk"), "x.s.sent_idx", "x.s.n")
    return x.groupBy("text_id", "chunk").agg(F.min("sent_idx").alias("first"), F.max("sent_idx").alias("last"), F.sum("n").alias("n"))


def merge_paragraphs(paragraphs: DataFrame, least: int) -> DataFrame:
    """(text_id, block, first, last, n): a paragraph of fewer than `least` tokens takes in the next; a short last one stays alone."""
    g = paragraphs.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("par_idx", F.col("n").cast("int").alias("n")))).alias("p"))
    start = F.struct(F.lit(0).alias("block"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        on = (F.size(acc["out"]) > 0) & (acc["sum"] < least)
        new = (F.size(acc["out"]) > 0) & ~on
        block = acc["block"] + F.when(new, 1).otherwise(0)
        return F.struct(block.alias("block"), F.when(new, p["n"]).otherwise(acc["sum"] + p["n"]).cast("int").alias("sum"), F.concat(acc["out"], F.array(block)).alias("out"))

    g = g.withColumn("b", F.aggregate("p", start, step, lambda acc: acc["out"]))
    x = g.select("text_id", F.explode(F.arrays_zip("p", "b")).alias("x")).select("text_id", F.col("x.b").alias("block"), "x.p.par_idx", "x.p.n")
    return x.groupBy("text_id", "block").agg(F.min("par_idx").alias("first"), F.max("par_idx").alias("last"), F.sum("n").alias("n"))
