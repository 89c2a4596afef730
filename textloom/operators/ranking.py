"""Global ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize


def ranked(df: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """df with a row number 1..n by a total order.

    Rows are dealt out by ranges of the order and sorted in place; a row's number is its place in its
    partition plus the sizes of the partitions before, of which there is one row each.
    """
    placed = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).collect()
    before, offset = 0, {}
    for r in sorted(sizes, key=lambda r: r["__part"]):
        offset[r["__part"]], before = before, before + r["__n"]
    starts = F.create_map(*(F.lit(x) for kv in offset.items() for x in kv)) if offset else F.create_map(F.lit(0).cast("bigint"), F.lit(0))
    return placed.withColumn(rank, (starts[part] + place + 1).cast("bigint")).drop("__at")


def offsets(df: DataFrame, weight: str, *order: Column, name: str = "offset") -> DataFrame:
    """df with the sum of `weight` over all rows before, by a total order: ranked() for rows that count for several.

    It is the sum before in a row's range of the order plus the sums of the ranges before, of which there is one row each.
    """
    placed = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "offsets").withColumn("__part", F.shiftright("__at", 33))
    before, start = 0, {}
    for r in sorted(placed.groupBy("__part").agg(F.sum(weight).alias("__n")).collect(), key=lambda r: r["__part"]):
        start[r["__part"]], before = before, before + (r["__n"] or 0)
    starts = F.create_map(*(F.lit(x) for kv in start.items() for x in kv)) if start else F.create_map(F.lit(0).cast("bigint"), F.lit(0))
    inside = F.sum(weight).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn(name, (starts[F.col("__part")] + F.coalesce(inside, F.lit(0))).cast("bigint")).drop("__at", "__part")
