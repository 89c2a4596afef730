"""Beyond the batch analyses: term counts that follow a growing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, term: str = "term", ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, term, n, value) per window of event time; rows later than the watermark are left out."""
    n = stream.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(term).alias("term")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return n.select(F.col("window.start").alias("window_start"), "term", "n", "value")


def write_counts(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Counts of closed windows to Parquet; restarts go on from the checkpoint, exactly once."""
    return counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
