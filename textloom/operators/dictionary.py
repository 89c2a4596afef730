"""Dictionary lookup and suggestions over (dict, key, word, content), key in lower case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import rewrite_links


def lookup(entries: DataFrame, word: str, dicts: list[str] | None = None) -> DataFrame:
    """(dict, word, matched_key, fuzzy, content): per dictionary the exact entry, else the first that starts with the word, else that holds it."""
    w = word.strip().lower()
    e = entries.where(F.col("dict").isin(*dicts)) if dicts else entries
    order = F.when(F.col("key") == w, 0).when(F.col("key").startswith(w), 1).when(F.col("key").contains(w), 2)
    best = Window.partitionBy("dict").orderBy("order", "key")
    hit = e.withColumn("order", order).where("order is not null").withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return hit.select("dict", "word", F.col("key").alias("matched_key"), (F.col("order") > 0).alias("fuzzy"), rewrite_links(F.col("content")).alias("content"))


def suggestions(entries: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """(word): distinct words whose key starts with the prefix, shortest first."""
    p = prefix.strip().lower()
    found = entries.where(F.lit(bool(p)) & F.col("key").startswith(p)).select("word").distinct()
    return found.orderBy(F.length("word"), F.lower("word"), "word").limit(limit)
