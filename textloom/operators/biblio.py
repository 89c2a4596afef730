"""Bibliographic records: filters, statistics, co-occurrence networks, clusters, bursts and views.

An entry has id, title, authors[], institutions[], countries[], journal, year, keywords[], doc_type, citation_count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranking import ranked
from textloom.runtime import materialize


def filter_entries(entries: DataFrame, *, year_from: int | None = None, year_to: int | None = None, author: str = "", institution: str = "", keyword: str = "", journal: str = "", doc_type: str = "", country: str = "") -> DataFrame:
    """All conditions hold; texts match anywhere, without regard to case. The country is applied too."""
    has = lambda c, v: F.exists(c, lambda x: F.lower(x).contains(v.lower()))
    keep = F.lit(True)
    keep &= F.col("year") >= year_from if year_from is not None else F.lit(True)
    keep &= F.col("year") <= year_to if year_to is not None else F.lit(True)
    for column, value in (("authors", author), ("institutions", institution), ("keywords", keyword), ("countries", country)):
        keep &= has(column, value) if value else F.lit(True)
    keep &= F.lower("journal").contains(journal.lower()) if journal else F.lit(True)
    return entries.where(keep & (F.col("doc_type") == doc_type if doc_type else F.lit(True)))


def page(entries: DataFrame, number: int, size: int) -> DataFrame:
    """(…, total, total_pages): one page by year, newest first, then title and id."""
    total = entries.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("bigint"))
    cut = entries.orderBy(F.desc("year"), F.asc("title"), F.asc("id")).offset((number - 1) * size).limit(size)
    return cut.crossJoin(F.broadcast(total))  # total is one row


def statistics(entries: DataFrame) -> DataFrame:
    """(measure, key, value): total, first and last year, counts by year and by document type."""
    one = lambda m, k, v: F.struct(F.lit(m).alias("measure"), k.cast("string").alias("key"), v.cast("bigint").alias("value"))
    g = entries.groupingSets([["year"], ["doc_type"], []], "year", "doc_type").agg(F.count("*").alias("n"), F.min("year").alias("y0"), F.max("year").alias("y1"), F.grouping_id().alias("g"))
    # grouping id 1: by year; 2: by type; 3: all
    rows = F.when(F.col("g") == 1, F.array(one("by_year", F.col("year"), F.col("n")))).when(F.col("g") == 2, F.array(one("by_type", F.col("doc_type"), F.col("n"))))
    rows = rows.otherwise(F.array(one("total", F.lit(""), F.col("n")), one("year_min", F.lit(""), F.col("y0")), one("year_max", F.lit(""), F.col("y1"))))
    return g.select(F.explode(rows).alias("x")).select("x.*")


def options(entries: DataFrame) -> DataFrame:
    """(field, value): the distinct filter values."""
    fields = ["authors", "institutions", "countries", "keywords"]
    each = F.flatten(F.array(*map(_named, fields), F.array(_one("journal"), _one("doc_type"))))
    return entries.select(F.explode(each).alias("x")).select("x.*").where("value is not null and value != ''").distinct()


def _one(column: str) -> Column:
    return F.struct(F.lit(column).alias("field"), F.col(column).alias("value"))


def _named(column: str) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(column).alias("field"), x.alias("value")))


def cooccurrence(entries: DataFrame, field: str, lower: bool = False) -> DataFrame:
    """(source, target, weight): unordered pairs of different items inside an entry, each once."""
    items = F.array_sort(F.array_distinct(F.transform(field, lambda x: F.lower(F.trim(x)) if lower else F.trim(x))))
    e = entries.select(F.filter(items, lambda x: x != "").alias("x")).where(F.size("x") > 1)
    # an item at a time with those behind it, so that no row holds all pairs of an entry
    one = e.select("x", F.posexplode("x").alias("i", "source")).select("source", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("target"))
    return one.groupBy("source", "target").agg(F.count("*").alias("weight"))


def items(entries: DataFrame, field: str, lower: bool = False) -> DataFrame:
    """(id, frequency, year, first_year, last_year) of a field's items."""
    each = F.array_distinct(F.transform(field, lambda x: F.lower(F.trim(x)) if lower else F.trim(x)))
    t = entries.select("year", F.explode(each).alias("id")).where("id != ''")
    return t.groupBy("id").agg(F.count("*").alias("frequency"), F.floor(F.avg("year")).cast("int").alias("year"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def network(entries: DataFrame, field: str, *, min_weight: int = 1, max_nodes: int = 100, lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the most frequent items, ties by name, and the pairs among them of at least min_weight; nodes with degree centrality."""
    top = materialize(items(entries, field, lower).orderBy(F.desc("frequency"), F.asc("id")).limit(max_nodes), "nodes")
    e = cooccurrence(entries, field, lower).where(F.col("weight") >= min_weight)
    ids = top.select("id")
    e = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "weight")
    degree = e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    n = top.agg(F.count("*").alias("n"))
    nodes = top.join(degree, "id", "left").crossJoin(F.broadcast(n))  # n is one row
    central = F.when(F.col("n") > 1, F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0)
    return nodes.select("id", "frequency", F.round(central, 4).alias("centrality"), "year", "first_year", "last_year"), e


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, density)."""
    x = nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    return x.select("nodes", "edges", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2)).otherwise(0.0), 6).alias("density"))


def similar_entries(entries: DataFrame, field: str = "keywords", measure: str = "jaccard", least: float = 0.1, shared: int = 1) -> DataFrame:
    """(id1, id2, shared, similarity) of entries with at least `shared` items in common; null items count for nothing.

    jaccard must exceed `least`, overlap (by the smaller set) zero. A pair needs a number of common items that
    follows from an entry's size and the bound, so only its rarest items, all but that number less one, are
    looked up in inverted lists (prefix filtering, which loses no pair): the most frequent items make no
    candidates where the bound allows. A pair is checked where its first common item lies, so that pairs are
    never shuffled. Rows with one id count as one entry.
    """
    each = F.array_distinct(F.transform(field, lambda x: F.lower(F.trim(x))))
    t = entries.select("id", F.explode(each).alias("item")).where("item is not null")
    order = F.transform(F.array_sort(F.collect_set(F.struct("df", "item"))), lambda x: x["item"])
    sets = t.join(t.groupBy("item").agg(F.count("*").alias("df")), "item").groupBy("id").agg(order.alias("items"))
    bound = F.floor(F.size("items") * (least if measure == "jaccard" else 0.0) * (1 - 1e-9)) + 1
    prefix = F.slice("items", 1, F.greatest(F.lit(0), F.size("items") - F.greatest(F.lit(shared), bound) + 1).cast("int"))
    x = sets.withColumn("prefix", prefix).withColumn("item", F.explode("prefix"))
    a, b = x.toDF("id1", "items1", "prefix1", "item"), x.toDF("id2", "items2", "prefix2", "item")
    first = F.get(F.array_intersect("prefix1", "prefix2"), 0) == F.col("item")
    p = a.join(b, "item").where("id1 < id2").where(first)
    p = p.select("id1", "id2", F.size("items1").alias("n1"), F.size("items2").alias("n2"), F.size(F.array_intersect("items1", "items2")).cast("bigint").alias("shared"))
    s = F.col("shared") / ((F.col("n1") + F.col("n2") - F.col("shared")) if measure == "jaccard" else F.least("n1", "n2"))
    keep = (s > (least if measure == "jaccard" else 0)) & (F.col("shared") >= shared)
    return p.where(keep).select("id1", "id2", "shared", F.round(s, 4).alias("similarity"))


def cocitation(entries: DataFrame, min_weight: int = 2) -> DataFrame:
    """(source, target, weight): entries with at least min_weight keywords in common."""
    p = similar_entries(entries, measure="overlap", shared=min_weight)
    return p.select(F.col("id1").alias("source"), F.col("id2").alias("target"), F.col("shared").alias("weight"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, cluster): each node takes the label of most weight among its neighbours and itself, ties to the least label.

    All nodes change at once, so that reruns agree; a node's own label counts with its heaviest link, which
    keeps pairs from swapping for ever. It ends when nothing changes, or after `rounds`.
    """
    e = edges.select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.col("similarity").alias("w"))
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "links")
    own = e.groupBy("a").agg(F.max("w").alias("w")).select("a", F.col("a").alias("b"), "w")
    e = materialize(e.unionByName(own), "links")
    labels = e.select("a").distinct().select("a", F.col("a").alias("label"))
    for _ in range(rounds):
        votes = e.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        best = votes.groupBy("a").agg(F.max_by("label", F.struct("w", (-F.col("label")).alias("l"))).alias("label"))
        new = materialize(best, "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "a").where("label != old").limit(1).count()
        labels = new
        if not moved:
            break
    return labels.select(F.col("a").alias("id"), F.col("label").alias("cluster"))


def cluster_entries(entries: DataFrame, field: str = "keywords", rounds: int = 50) -> DataFrame:
    """(id, cluster): entries by label propagation over what they share, until nothing changes.

    Keywords link entries by a Jaccard similarity over 0.1, authors and institutions by any overlap, of the smaller set.
    """
    links = similar_entries(entries, field) if field == "keywords" else similar_entries(entries, field, "overlap")
    return label_propagation(links, rounds)


def merge_clusters(clusters: DataFrame, target: int) -> DataFrame:
    """(id, cluster) with `target` clusters at most: the smallest join the largest, one by one.

    So all but the largest `target` end in the largest; of equal sizes the least cluster is merged first, and is the largest.
    """
    sizes = materialize(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    largest = sizes.orderBy(F.desc("n"), "cluster").limit(1).select(F.col("cluster").alias("largest"))
    stay = sizes.join(F.broadcast(largest), F.col("cluster") == F.col("largest"), "left_anti").orderBy(F.desc("n"), F.desc("cluster")).limit(max(1, target) - 1)
    stay = stay.select("cluster").unionByName(largest.toDF("cluster")).withColumn("stays", F.lit(True))
    x = clusters.join(F.broadcast(stay), "cluster", "left").crossJoin(F.broadcast(largest))  # target rows, and one row
    return x.select("id", F.when(F.col("stays"), F.col("cluster")).otherwise(F.col("largest")).alias("cluster"))


def cluster_summary(entries: DataFrame, clusters: DataFrame, edges: DataFrame, field: str = "keywords", k: int = 10) -> DataFrame:
    """(cluster, size, cohesion, top_terms): cohesion is the mean similarity of linked entries inside it."""
    t = entries.join(clusters, "id").select("id", "cluster", F.explode(F.array_distinct(F.transform(field, lambda x: F.lower(F.trim(x))))).alias("term"))
    first = Window.partitionBy("cluster").orderBy(F.desc("n"), "term")
    terms = t.groupBy("cluster", "term").agg(F.count("*").alias("n")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    terms = terms.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("nth", "term"))).alias("x")).select("cluster", F.array_join(F.transform("x", lambda x: x["term"]), "; ").alias("top_terms"))
    c = lambda n: clusters.select(F.col("id").alias(f"id{n}"), F.col("cluster").alias(f"c{n}"))
    inside = edges.join(c(1), "id1").join(c(2), "id2").where("c1 = c2").groupBy(F.col("c1").alias("cluster")).agg(F.sum(F.round(F.col("similarity") * 10000).cast("bigint")).alias("s"), F.count("*").alias("n")).select("cluster", (F.expr("(2 * s + n) div (2 * n)") / 10000).alias("cohesion"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(inside, "cluster", "left").join(terms, "cluster", "left").select("cluster", "size", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), "top_terms")


def modularity(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, inner, degree, coverage, modularity) of clusters (id, cluster) over links (id1, id2): inner links and ends of links by cluster.

    coverage is the share of all links that stay inside clusters, modularity what that exceeds links dealt
    out by degree: the sum of inner / links - (degree / (2 * links))^2. Both are of all clusters, on every row.
    """
    c = lambda n: clusters.select(F.col("id").alias(f"id{n}"), F.col("cluster").alias(f"c{n}"))
    e = edges.select("id1", "id2").join(c(1), "id1").join(c(2), "id2")
    ends = e.select(F.explode(F.array(F.struct(F.col("c1").alias("cluster"), (F.col("c1") == F.col("c2")).cast("int").alias("x")), F.struct(F.col("c2").alias("cluster"), F.lit(0).alias("x")))).alias("y")).select("y.*")
    by = ends.groupBy("cluster").agg(F.sum("x").alias("inner"), F.count("*").alias("degree"))
    by = materialize(by, "degrees")
    total = by.agg(F.sum("inner").alias("i"), F.sum("degree").alias("d"), F.sum((F.col("degree") * F.col("degree")).cast("decimal(38,0)")).cast("double").alias("s"))
    x = by.crossJoin(F.broadcast(total))  # total is one row
    coverage = 2 * F.col("i") / F.col("d")
    return x.select("cluster", "inner", "degree", F.round(coverage, 4).alias("coverage"), F.round(coverage - F.col("s") / (F.col("d") * F.col("d").cast("double")), 4).alias("modularity"))


def term_years(entries: DataFrame, field: str, lower: bool = True) -> DataFrame:
    """(term, year, n): terms of more than one character, each once an entry."""
    each = F.array_distinct(F.transform(field, lambda x: F.lower(F.trim(x)) if lower else F.trim(x)))
    t = entries.where("year is not null").select("year", F.explode(each).alias("term")).where(F.length("term") > 1)
    return t.groupBy("term", "year").agg(F.count("*").alias("n"))


def bursts(series: DataFrame, *, least: int = 5, gamma: float = 1.0) -> DataFrame:
    """(rank, term, frequency, burst_start, burst_end, burst_strength, burst_weight): runs of years above (1 + gamma) times the mean.

    The mean is over all years from the first to the last of the whole series, years without the term
    count zero; a term's mean must be .5 at least. Runs are islands of consecutive years above the bound.
    """
    span = series.agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    term = Window.partitionBy("term")
    t = series.crossJoin(F.broadcast(span)).withColumn("frequency", F.sum("n").over(term)).where(F.col("frequency") >= least)  # span is one row
    t = t.withColumn("expected", F.col("frequency") / (F.col("y1") - F.col("y0") + 1)).where("expected >= 0.5")
    hot = t.where(F.col("n") > F.col("expected") * (1 + gamma)).withColumn("island", F.col("year") - F.row_number().over(term.orderBy("year")))
    out = hot.groupBy("term", "island").agg(F.first("frequency").alias("frequency"), F.min("year").alias("burst_start"), F.max("year").alias("burst_end"), F.round(F.max(F.col("n") / F.col("expected")), 4).alias("burst_strength"), F.sum("n").alias("burst_weight")).drop("island")
    return ranked(out, F.desc("burst_strength"), F.asc("term"), F.asc("burst_start"))


def fill_years(series: DataFrame) -> DataFrame:
    """(term, year, n) with every year between the first and last of the series."""
    span = series.agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    grid = series.select("term").distinct().crossJoin(F.broadcast(span)).select("term", F.explode(F.sequence("y0", "y1")).alias("year"))
    return grid.join(series, ["term", "year"], "left").select("term", "year", F.coalesce("n", F.lit(0)).alias("n"))


def timeline(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, size, year_start, year_end, bursts): clusters over years from 1900 to 2100; a burst has over 10 citations."""
    t = entries.where("year between 1900 and 2100").join(clusters, "id")
    return t.groupBy("cluster").agg(F.count("*").alias("size"), F.min("year").alias("year_start"), F.max("year").alias("year_end"), F.count_if(F.col("citation_count") > 10).alias("bursts"))


def year_slices(entries: DataFrame) -> DataFrame:
    return entries.where("year is not null").groupBy("year").agg(F.count("*").alias("entries"), F.sum("citation_count").cast("bigint").alias("citations"))


def keyword_chains(entries: DataFrame, most: int = 500) -> DataFrame:
    """(keyword, source, target): each entry to the next one in time with the keyword; the first `most` in order."""
    t = entries.where("year is not null").select("id", "year", F.explode(F.array_distinct(F.transform("keywords", lambda x: F.lower(F.trim(x))))).alias("keyword"))
    w = Window.partitionBy("keyword").orderBy("year", "id")
    chains = t.select("keyword", F.col("id").alias("source"), F.lead("id").over(w).alias("target")).where("target is not null")
    return chains.orderBy("keyword", "source", "target").limit(most)


def dual_map(entries: DataFrame, top: int = 50) -> DataFrame:
    """(journal, total, early, recent, link): entries up to and after the mean of the distinct years, for the top journals."""
    mid = entries.where("year is not null").select("year").distinct().agg(F.avg("year").alias("mid"))
    t = entries.where("journal is not null and year is not null").crossJoin(F.broadcast(mid))  # mid is one row
    n = t.groupBy("journal").agg(F.count("*").alias("total"), F.count_if(F.col("year") <= F.col("mid")).alias("early"), F.count_if(F.col("year") > F.col("mid")).alias("recent"))
    return n.orderBy(F.desc("total"), "journal").limit(top).withColumn("link", F.least("early", "recent"))


def landscape(entries: DataFrame, clusters: DataFrame, centrality: DataFrame, seed: int = 0) -> DataFrame:
    """(id, cluster, x, y, z): clusters on a circle, entries jittered by a hash; z = 5 * centrality + .1 * citations."""
    n = clusters.agg(F.count_distinct("cluster").alias("n"))
    order = ranked(clusters.select("cluster").distinct(), F.asc("cluster")).select("cluster", (F.col("rank") - 1).alias("nth"))
    t = entries.join(clusters, "id").join(order, "cluster").crossJoin(F.broadcast(n)).join(centrality, "id", "left")
    angle = 2 * math.pi * F.col("nth") / F.col("n")
    jitter = lambda s: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), F.lit(1000)) / 1000.0 - 0.5
    return t.select("id", "cluster", (5 * F.cos(angle) + jitter(1)).alias("x"), (5 * F.sin(angle) + jitter(2)).alias("y"), (5 * F.coalesce("centrality", F.lit(0.0)) + 0.1 * F.coalesce("citation_count", F.lit(0))).alias("z"))
