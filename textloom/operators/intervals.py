"""Joins of spans of characters or places, by bins of fixed width: each span meets only spans of its own stretch of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bin. A span stands in every bin that it touches, so that work grows with the text's length and with the pairs found.
WIDTH = 256


def _bin(at: Column, width: int) -> Column:
    return F.floor(at / width).cast("bigint")


def _bins(start: Column, end: Column, width: int) -> Column:
    """The bins of a span; an empty one stands in the bin of its start."""
    return F.explode(F.sequence(_bin(start, width), _bin(F.greatest(start, end - 1), width)))


def overlapping(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs of a's (doc_id, start, end, ...) and b's (doc_id, other_start, other_end, ...) spans of a text with start < other_end and other_start < end.

    Spans are joined by text and bin; a pair that shares several bins counts in the first of them. Spans
    with null ends meet nothing; an empty table gives no rows.
    """
    x = a.where("start IS NOT NULL AND `end` IS NOT NULL").withColumn("bin", _bins(F.col("start"), F.col("end"), width))
    y = b.where("other_start IS NOT NULL AND other_end IS NOT NULL").withColumn("bin", _bins(F.col("other_start"), F.col("other_end"), width))
    first = F.greatest(_bin(F.col("start"), width), _bin(F.col("other_start"), width))
    return x.join(y, ["doc_id", "bin"]).where((F.col("bin") == first) & (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end"))).drop("bin")


def _met(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """points with `spans`, an array of the numbered spans (nth, start, end) of their bin.

    Both stand in one table, and a window over each bin hands its spans to its points. Where both sides are dealt out
    by text already, as pieces of texts are, no row is shuffled again, which a join on text and bin would do.
    """
    s = spans.where("doc_id IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL")
    s = s.select("doc_id", _bins(F.col("start"), F.col("end"), width).alias("__bin"), F.struct("nth", "start", "end").alias("__span"))
    both = points.withColumn("__bin", _bin(F.col("start"), width)).unionByName(s, allowMissingColumns=True)
    here = F.collect_list("__span").over(Window.partitionBy("doc_id", "__bin"))
    return both.withColumn("spans", here).where("__span IS NULL").drop("__bin", "__span")


def first_holder(points: DataFrame, spans: DataFrame, name: str = "nth", width: int = WIDTH) -> DataFrame:
    """points (doc_id, start, ...) with `name`: the lowest number of a span with start <= place < end, 0 where none holds it.

    Points with a null text or place are held by none; an empty table of spans gives zeros.
    """
    holds = F.filter("spans", lambda s: (s["start"] <= F.col("start")) & (F.col("start") < s["end"]))
    first = F.array_min(F.transform(holds, lambda s: s["nth"]))
    return _met(points, spans, width).withColumn(name, F.coalesce(first, F.lit(0))).drop("spans")


def holders(inner: DataFrame, spans: DataFrame, name: str = "nth", width: int = WIDTH) -> DataFrame:
    """inner (doc_id, start, end, ...) once for each span that holds it whole, with the span's number as `name`."""
    holds = F.filter("spans", lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"]))
    return _met(inner, spans, width).withColumn(name, F.explode(F.transform(holds, lambda s: s["nth"]))).drop("spans")
