"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize, small_batches

#: A word is a run of bytes other than 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1), none above its cap; ties go to the earlier entry.

    A divisor found by bisection gives all but the last few seats at once, so that the work does not
    grow with the number of seats.
    """
    votes, caps = votes.astype(float), caps.astype(np.int64)
    seats = min(int(seats), int(caps[votes > 0].sum()))
    given = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return given
    at = lambda d: np.minimum(caps, np.floor(votes / d + 0.5).astype(np.int64))
    low, high = votes[votes > 0].min() / (2.0 * seats + 2), 4 * votes.max() + 1
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() >= seats else (low, mid)
    given = at(high)
    while (left := seats - int(given.sum())) > 0:
        quotient = np.where(given < caps, votes / (2 * given + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:left]
        given[best[quotient[best] == quotient[best[0]]]] += 1
    return given


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(source, source_size, target, rank) per source: weights by rank, capped at most * size, the excess reshared.

    All in whole numbers up to the one division: with caps sorted by cap / weight, the first sources
    whose even share exceeds their cap take the cap, the rest share what is left by weight.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("rank", F.row_number().over(by))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("bigint"))
    cap = F.lit(most) * F.col("source_size")
    up = Window.orderBy(cap / F.col("weight"), "rank")
    every = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    # what is left for this source and those behind it, times the share's divisor
    t = t.withColumn("left", F.lit(share[0]) * F.sum("source_size").over(every) - F.lit(share[1]) * F.coalesce(F.sum(cap).over(before), F.lit(0)))
    t = t.withColumn("behind", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    capped = F.col("weight") * F.col("left") >= F.lit(share[1]) * cap * F.col("behind")
    t = t.withColumn("capped", capped).withColumn("step", F.row_number().over(up))
    first_open = F.min(F.when(~F.col("capped"), F.col("step"))).over(every)
    t = t.withColumn("open", F.coalesce(F.col("step") >= first_open, F.lit(False)))
    rate = lambda c: F.max(F.when(F.col("step") == first_open, F.col(c))).over(every)
    t = t.withColumn("rest", rate("left")).withColumn("over", rate("behind"))
    even = (F.col("weight") * F.col("rest")).cast("double") / (F.lit(share[1]) * F.col("over")).cast("double")
    return t.select("source", "source_size", F.when(F.col("open"), even).otherwise(cap.cast("double")).alias("target"), "rank")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    shard_words: int = 1 << 20,
    seed: str = "mix",
    carry: bool = False,
) -> DataFrame:
    """(id_col, size, source_size, target, taken) of every row of docs; with carry also `row`, and `words` per pass.

    Sources in order of code points, null last, weigh `weights` in turn and share share[0]/share[1] of
    all words; none gets more than `most` times its size. Blocks of equal size (the smallest source's
    64th part, 1024 words at most) go to sources by highest quotients and then, the same way, to
    each source's shards, so that every shard has a whole number of blocks to give. A shard lays its
    documents out in seeded order, and its first blocks are taken, again from the start beyond its
    end: one document of a shard at most is cut.

    A large source has many shards, hashed by id, and no task sees more than a shard's documents.
    Null or empty texts have size 0 and are never taken; a null source is a source of its own; a null
    id is hashed by its text, and rows with one id are ordered by size; an empty table gives no rows; other
    columns are not read unless carried. Reruns agree whatever the partitioning.
    """
    small_batches(docs)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.coalesce(F.col(text_col), F.lit(""))))
    hashed = F.md5(F.concat(F.lit(seed + " "), name).cast("binary"))
    # words are counted once; with carry the texts are written with their counts and travel once
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), hashed.alias("h"), *([F.struct("*").alias("row")] if carry else []))
    rows = materialize(rows, "sizes")
    sized = rows.select("source", "size", "h")
    sources = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    block = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(Window.partitionBy()) / 64))).cast("bigint")
    sources = materialize(sources.withColumn("block", F.coalesce(block, F.lit(1))).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int")), "sources")

    def by_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        block = int(pdf.block.iloc[0])
        seats = int(pdf.target.sum() / block + 0.5)
        return pdf[["rank"]].assign(blocks=sainte_lague(pdf.target.to_numpy(), (most * pdf.source_size // block).to_numpy(), seats))

    def by_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        return pdf[["rank", "shard", "shard_size"]].assign(quota=sainte_lague(pdf.shard_size.to_numpy(), (most * pdf.shard_size // pdf.block).to_numpy(), int(pdf.blocks.iloc[0])) * pdf.block)

    # one row per source: a mix's recipe
    blocks = sources.groupBy(F.lit(1).alias("one")).applyInPandas(by_source, "rank int, blocks bigint")
    recipe = materialize(sources.join(blocks, "rank"), "recipe")
    shard = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.col("shards")).cast("int")
    placed = rows.join(recipe.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).withColumn("shard", shard)
    shards = placed.groupBy("rank", "shard", "block", "blocks").agg(F.sum("size").alias("shard_size"))
    quotas = materialize(shards.groupBy("rank").applyInPandas(by_shard, "rank int, shard int, shard_size bigint, quota bigint"), "quotas")

    order = Window.partitionBy("rank", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quotas, ["rank", "shard"])

    def words(nth: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - nth * F.col("shard_size") - F.col("before")))

    passes = [words(n) for n in range(most)]
    out = [F.col("id").alias(id_col), "size", "source_size", "target", sum(passes[1:], passes[0]).alias("taken")]
    return laid.select(*out, *(["row", F.array(*passes).alias("words")] if carry else []))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, in docs' columns: a row per pass that takes words of a document, cut to those words.

    A whole document keeps its text as it is; a cut one has its first words, joined by one space.
    """
    taken = mix(docs, id_col, text_col, source_col, carry=True, **how)
    each = taken.select("row", "size", F.explode("words").alias("n")).where("n > 0")
    text = F.col(f"row.`{text_col}`")
    text = F.when(F.col("n") == F.col("size"), text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("n").cast("int")), " "))
    return each.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")


#: What mix() returns for `documents` while no source has more than shard_words words, so one shard.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix ' || coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, ''))) AS h
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rnk FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((rnk - 1) % 3 + 1)::INT]::BIGINT AS weight FROM src
), steps AS (
  SELECT *, row_number() OVER up AS step,
         3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
  FROM weighed WINDOW up AS (ORDER BY 2 * source_size / weight, rnk)
), opened AS (
  SELECT *, min(step) FILTER (weight * rest < 4 * source_size * behind) OVER () AS first_open FROM steps
), targets AS (
  SELECT source, source_size, rnk,
         CASE WHEN step >= first_open THEN (weight * max(rest) FILTER (step = first_open) OVER ())::DOUBLE / (2 * max(behind) FILTER (step = first_open) OVER ())::DOUBLE
              ELSE (2 * source_size)::DOUBLE END AS target,
         greatest(1, least(1024, (min(source_size) FILTER (source_size > 0) OVER ()) // 64))::BIGINT AS block
  FROM opened
), quotients AS (
  SELECT rnk, target / (2 * k + 1) AS q, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rnk) AS nth
  FROM (SELECT rnk, target, unnest(range(2 * source_size // block)) AS k FROM targets WHERE target > 0)
), seats AS (
  SELECT rnk, count(*) AS blocks FROM quotients WHERE nth <= (SELECT floor(sum(target) / max(block) + 0.5) FROM targets) GROUP BY rnk
), quotas AS (
  SELECT t.*, coalesce(s.blocks, 0) * t.block AS quota FROM targets t LEFT JOIN seats s USING (rnk)
), laid AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
         coalesce(sum(d.size) OVER (PARTITION BY q.rnk ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - b)) + greatest(0, least(size, quota - source_size - b)))::BIGINT AS taken
FROM laid
"""
