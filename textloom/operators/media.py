"""Post-aggregations of media: tracks, frame labels, waveforms, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def track_segments(detections: DataFrame) -> DataFrame:
    """(track_id, label, detections, start_frame, end_frame, start_time, end_time) of (track_id, label, frame, time); the label is the most frequent."""
    n = detections.groupBy("track_id", "label").agg(F.count("*").alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min("time").alias("t0"), F.max("time").alias("t1"))
    return n.groupBy("track_id").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"), F.sum("n").alias("detections"), F.min("f0").alias("start_frame"), F.max("f1").alias("end_frame"), F.min("t0").alias("start_time"), F.max("t1").alias("end_time"))


def top_label(frames: DataFrame) -> DataFrame:
    """(frame, label, score): the best entry of each frame's map of scores, ties by label."""
    best = F.array_max(F.transform(F.map_entries("scores"), lambda e: F.struct(e["value"].alias("s"), e["key"].alias("k"))))
    top = F.filter(F.map_entries("scores"), lambda e: e["value"] == best["s"])
    return frames.select("frame", F.array_min(F.transform(top, lambda e: e["key"])).alias("label"), best["s"].alias("score"))


def waveform_peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """(bucket, peak): the largest magnitude per bucket of equal counts of (i, value), over the largest of all."""
    n = samples.agg((F.max("i") + 1).alias("n"))
    b = samples.crossJoin(F.broadcast(n)).select(F.floor(F.col("i") * F.lit(buckets) / F.col("n")).alias("bucket"), F.abs("value").alias("v"))  # n is one row
    p = b.groupBy("bucket").agg(F.max("v").alias("v"))
    top = p.agg(F.max("v").alias("top"))
    return p.crossJoin(F.broadcast(top)).select("bucket", F.round(F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(0.0), 4).alias("peak"))


def word_times(chunks: DataFrame) -> DataFrame:
    """(chunk_id, nth, word, start, end): a chunk's time shared out evenly over its words; a missing end is one second on."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    start = F.coalesce("start", F.lit(0.0))
    t = chunks.select("chunk_id", start.alias("s"), F.coalesce("end", start + 1).alias("e"), words.alias("w")).where(F.size("w") > 0)
    each = t.select("chunk_id", "s", ((F.col("e") - F.col("s")) / F.size("w")).alias("d"), F.posexplode("w").alias("nth", "word"))
    at = F.col("s") + F.col("nth") * F.col("d")
    return each.select("chunk_id", "nth", "word", F.round(at, 4).alias("start"), F.round(at + F.col("d"), 4).alias("end"))


def sentence_sessions(words: DataFrame) -> DataFrame:
    """(chunk_id, sentence, words, start, end, text): words (chunk_id, nth, word, start, end) closed at . ! ? ; or :"""
    w = Window.partitionBy("chunk_id").orderBy("nth")
    ends = F.when(F.col("word").rlike(r"[.!?;:]+$"), 1).otherwise(0)
    t = words.withColumn("sentence", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = t.groupBy("chunk_id", "sentence").agg(F.count("*").alias("words"), F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("nth", "word"))).alias("x"))
    return g.select("chunk_id", "sentence", "words", "start", "end", F.array_join(F.transform("x", lambda x: x["word"]), " ").alias("text"))
