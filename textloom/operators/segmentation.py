"""Words of scripts without spaces: a lattice of dictionary words over each run of characters, and its most probable path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize, small_batches

#: Runs of ideographs.
HAN = r"\p{IsHan}+"


def lattice(runs: DataFrame, dictionary: DataFrame, longest: int, stretch: int = 256) -> DataFrame:
    """(rid, edges) of runs (rid, run): the dictionary's words (word, count) in each as (start, length, weight), by a join of its substrings.

    weight is the logarithm of a word's share of all counts. Words of over `longest` characters and
    counts below one take no part; a word that comes twice counts once, with its highest count. A run is
    cut into stretches first, with what a word may reach beyond, so that no row carries a long run.
    """
    words = dictionary.where((F.col("count") >= 1) & F.char_length("word").between(1, longest)).groupBy("word").agg(F.max("count").alias("count"))
    total = words.agg(F.sum("count").alias("total"))
    words = words.crossJoin(F.broadcast(total)).select("word", (F.log(F.col("count").cast("double")) - F.log(F.col("total").cast("double"))).alias("weight"))  # total is one row
    parts = F.transform(F.sequence(F.lit(0), F.char_length("run") - 1, F.lit(stretch)), lambda i: F.struct(i.alias("at"), F.substring(F.col("run"), i + 1, F.lit(stretch + longest - 1)).alias("part")))
    p = runs.select("rid", F.explode(parts).alias("p")).select("rid", "p.at", "p.part")
    n = F.char_length("part")
    at = p.select("rid", "at", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(stretch), n))).alias("i"))
    pieces = at.select("rid", "at", "part", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("i") + 1))).alias("length"))
    pieces = pieces.select("rid", (F.col("at") + F.col("i")).alias("start"), "length", F.substring(F.col("part"), F.col("i"), F.col("length")).alias("word"))
    return pieces.join(words, "word").groupBy("rid").agg(F.collect_list(F.struct("start", "length", "weight")).alias("edges"))


def best_path(n: int, start: np.ndarray, length: np.ndarray, weight: np.ndarray, unknown: float) -> list[tuple[int, int]]:
    """(start, length) of the words of the most probable path over n characters, from 0; a character that begins no word counts as one of weight `unknown`.

    Worked out from the end; of equal paths the one whose word here is longer is taken.
    """
    order = np.argsort(start, kind="stable")
    start, length, weight = start[order], length[order], weight[order]
    first = np.searchsorted(start, np.arange(n + 1))
    value, step = np.zeros(n + 1), np.ones(n + 1, int)
    for i in range(n - 1, -1, -1):
        a, b = first[i], first[i + 1]
        k = length[a:b]
        total = value[i + k] + weight[a:b]
        best, size = value[i + 1] + unknown, 1
        if b > a and (k == 1).any():
            best = -np.inf
        for x, m in zip(total.tolist(), k.tolist(), strict=True):
            if (round(x, 9), m) > (round(best, 9), size) or best == -np.inf:
                best, size = x, m
        value[i], step[i] = best, size
    out, i = [], 0
    while i < n:
        out.append((i, int(step[i])))
        i += step[i]
    return out


def segment(texts: DataFrame, dictionary: DataFrame, text_col: str = "text", *, pattern: str = HAN, longest: int = 8) -> DataFrame:
    """texts with `words`: the words, in order, of each run of characters that the pattern finds in the text.

    Each distinct run is worked once, wherever it stands. The dictionary, (word, count), is joined and
    never sent whole. A character that no word of the dictionary explains is a word of its own, of count one.
    Null and empty texts have no words; repeated rows stay; an empty dictionary leaves single characters.
    A run's words in the dictionary meet in one row.
    """
    small_batches(texts)
    found = materialize(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    placed = found.select("_row", F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0))).alias("_at", "run")).where("run != ''")
    runs = materialize(placed.select("run").distinct().withColumn("rid", F.monotonically_increasing_id()), "runs")
    total = dictionary.where((F.col("count") >= 1) & F.char_length("word").between(1, longest)).groupBy("word").agg(F.max("count").alias("c")).agg(F.sum("c")).first()[0]
    unknown = -float(np.log(total or 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for run, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                e = edges or []
                s, k, w = (np.array([x[c] for x in e], t) for c, t in (("start", int), ("length", int), ("weight", float)))
                words.append([run[i : i + m] for i, m in best_path(len(run), s - 1, k, w, unknown)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "cut"])

    edges = lattice(runs, dictionary, longest)
    words = runs.join(edges, "rid", "left").select("run", "edges").mapInArrow(cut, "run string, cut array<string>")
    by = placed.join(words, "run").groupBy("_row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", "cut"))), lambda x: x["cut"])).alias("words"))
    return found.join(by, "_row", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))).drop("_row")
