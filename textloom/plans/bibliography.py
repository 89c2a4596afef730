"""Registered queries: bibliographic analyses. An order stands for an entry, its lines' suppliers and parts for authors and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import biblio
from textloom.operators.graph import connected_components
from textloom.runtime import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def entries(s, d):
    read = lambda t: s.read.parquet(f"{d}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(read("part").select("p_partkey", "p_brand", "p_type", F.concat_ws(" ", "p_name", "p_partkey").alias("keyword")), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sets = lambda c, a: F.array_sort(F.collect_set(c)).alias(a)
    g = lines.groupBy("l_orderkey").agg(sets("s_name", "authors"), sets("p_type", "institutions"), sets("n_name", "countries"), sets("p_brand", "brands"), sets("keyword", "keywords"), F.count("*").alias("citation_count"))
    o = read("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Entry "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("journal"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("doc_type"))
    return o.join(g, o.id == g.l_orderkey).drop("l_orderkey")


_E = """lines AS (SELECT l_orderkey AS id, s_name, p_type, n_name, p_brand, p_name || ' ' || p_partkey AS keyword FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT o_orderkey AS id, 'Entry ' || o_orderkey AS title, o_orderpriority AS journal, year(o_orderdate)::INT AS year, o_orderstatus AS doc_type, count(*) AS citation_count FROM orders JOIN lines ON id = o_orderkey GROUP BY ALL)"""
_WITH = f"WITH {_E}"
_FIELD = {"authors": "s_name", "institutions": "p_type", "countries": "n_name", "brands": "p_brand", "keywords": "keyword"}


def _items(field, lower=False):
    c = f"lower({_FIELD[field]})" if lower else _FIELD[field]
    return f"SELECT DISTINCT lines.id, e.year, {c} AS x FROM lines JOIN e USING (id)"


QUERIES["biblio_filter_page"] = lambda s, d: biblio.page(biblio.filter_entries(entries(s, d), year_from=1996, year_to=1999, keyword="a", country="A", doc_type="O"), 2, 20).select("id", "title", "journal", "year", "doc_type", "total", "total_pages")
SQL["biblio_filter_page"] = _WITH + """, f AS (SELECT * FROM e WHERE year BETWEEN 1996 AND 1999 AND doc_type = 'O' AND id IN (SELECT id FROM lines WHERE contains(lower(keyword), 'a')) AND id IN (SELECT id FROM lines WHERE contains(lower(n_name), 'a')))
SELECT id, title, journal, year, doc_type, (SELECT count(*) FROM f) AS total, (SELECT ceil(count(*) / 20)::BIGINT FROM f) AS total_pages FROM f ORDER BY year DESC, title, id LIMIT 20 OFFSET 20"""
QUERIES["biblio_statistics"] = lambda s, d: biblio.statistics(entries(s, d))
SQL["biblio_statistics"] = _WITH + """ SELECT 'total' AS measure, '' AS key, count(*) AS value FROM e UNION ALL SELECT 'year_min', '', min(year)::BIGINT FROM e UNION ALL SELECT 'year_max', '', max(year)::BIGINT FROM e
UNION ALL SELECT 'by_year', year::VARCHAR, count(*) FROM e GROUP BY year UNION ALL SELECT 'by_type', doc_type, count(*) FROM e GROUP BY doc_type"""
QUERIES["biblio_filter_options"] = lambda s, d: biblio.options(entries(s, d))
SQL["biblio_filter_options"] = _WITH + """ SELECT 'authors' AS field, s_name AS value FROM lines UNION SELECT 'institutions', p_type FROM lines UNION SELECT 'countries', n_name FROM lines UNION SELECT 'keywords', keyword FROM lines
UNION SELECT 'journal', journal FROM e UNION SELECT 'doc_type', doc_type FROM e"""


def _network(name, field, lower=False, nodes=40, weight=2):
    QUERIES[f"{name}_nodes"] = lambda s, d: biblio.network(entries(s, d), field, min_weight=weight, max_nodes=nodes, lower=lower)[0]
    QUERIES[f"{name}_edges"] = lambda s, d: biblio.network(entries(s, d), field, min_weight=weight, max_nodes=nodes, lower=lower)[1]
    base = _WITH + f""", i AS ({_items(field, lower)}), n AS (SELECT x AS id, count(*) AS frequency, floor(avg(year))::INT AS year, min(year) AS first_year, max(year) AS last_year FROM i GROUP BY 1 ORDER BY frequency DESC, encode(x) LIMIT {nodes}),
    ed AS (SELECT a.x AS source, b.x AS target, count(*) AS weight FROM i a JOIN i b ON a.id = b.id AND encode(a.x) < encode(b.x) WHERE a.x IN (SELECT id FROM n) AND b.x IN (SELECT id FROM n) GROUP BY 1, 2 HAVING count(*) >= {weight})"""
    SQL[f"{name}_edges"] = base + " SELECT * FROM ed"
    SQL[f"{name}_nodes"] = base + ", dg AS (SELECT x AS id, count(*) AS degree FROM (SELECT source AS x FROM ed UNION ALL SELECT target FROM ed) GROUP BY 1) SELECT id, frequency, round(coalesce(degree, 0) / ((SELECT count(*) FROM n) - 1), 4)::DOUBLE AS centrality, year, first_year, last_year FROM n LEFT JOIN dg USING (id)"
    return base


_base = _network("co_author", "authors")
_network("co_institution", "institutions")
_network("co_country", "countries")
_network("keyword_cooccurrence", "brands", lower=True)
QUERIES["network_density"] = lambda s, d: biblio.density(*biblio.network(entries(s, d), "authors", min_weight=2, max_nodes=40))
SQL["network_density"] = _base + ", c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM ed) AS edges) SELECT nodes, edges, round(edges / (nodes * (nodes - 1) / 2), 6)::DOUBLE AS density FROM c"

_SIMILAR = _WITH + f""", i AS ({_items("keywords", True)}), k AS (SELECT id, count(*) AS n FROM i GROUP BY 1),
p AS (SELECT a.id AS id1, b.id AS id2, count(*) AS shared FROM i a JOIN i b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2), q AS (SELECT id1, id2, shared, k1.n AS n1, k2.n AS n2 FROM p JOIN k k1 ON k1.id = id1 JOIN k k2 ON k2.id = id2)"""
QUERIES["entry_similarity"] = lambda s, d: biblio.similar_entries(entries(s, d), "keywords", "jaccard", 0.1)
SQL["entry_similarity"] = _SIMILAR + " SELECT id1, id2, shared, round(shared / (n1 + n2 - shared), 4)::DOUBLE AS similarity FROM q WHERE shared / (n1 + n2 - shared) > 0.1"
QUERIES["co_citation"] = lambda s, d: biblio.cocitation(entries(s, d), 2)
SQL["co_citation"] = _SIMILAR + " SELECT id1 AS source, id2 AS target, shared AS weight FROM q WHERE shared >= 2"


def _clusters(s, d):
    e = entries(s, d)
    links = materialize(biblio.similar_entries(e, "keywords", "jaccard", 0.3), "links")
    return e, links, connected_components(links, "id1", "id2").toDF("id", "cluster")


def _timeline(s, d):
    e, _, c = _clusters(s, d)
    return biblio.timeline(e, c)


QUERIES["timeline"] = _timeline
QUERIES["timeline_keywords"] = lambda s, d: biblio.timeline(entries(s, d), biblio.cluster_entries(entries(s, d)))
_COMPONENTS = f"""WITH RECURSIVE {_E}, i AS MATERIALIZED ({_items("keywords", True)}), k AS (SELECT id, count(*) AS n FROM i GROUP BY 1),
p AS (SELECT a.id AS id1, b.id AS id2, count(*) AS shared FROM i a JOIN i b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT id1, id2, round(shared / (k1.n + k2.n - shared), 4) AS similarity FROM p JOIN k k1 ON k1.id = id1 JOIN k k2 ON k2.id = id2 WHERE shared / (k1.n + k2.n - shared) > 0.3),
b AS MATERIALIZED (SELECT id1 AS a, id2 AS b FROM l UNION SELECT id2, id1 FROM l), reach(a, r) AS (SELECT a, a FROM b UNION SELECT b.b, reach.r FROM reach JOIN b ON b.a = reach.a WHERE reach.r < b.b),
cl AS (SELECT a AS id, min(r) AS cluster FROM reach GROUP BY 1)"""
SQL["timeline"] = _COMPONENTS + " SELECT cluster, count(*) AS size, min(year) AS year_start, max(year) AS year_end, count(*) FILTER (citation_count > 10) AS bursts FROM e JOIN cl USING (id) WHERE year BETWEEN 1900 AND 2100 GROUP BY cluster"


def _summary(s, d):
    e, links, c = _clusters(s, d)
    return biblio.cluster_summary(e, c, links)


QUERIES["cluster_summary"] = _summary
SQL["cluster_summary"] = _COMPONENTS + """, t AS (SELECT cluster, x, count(*) AS n FROM i JOIN cl USING (id) GROUP BY 1, 2), tt AS (SELECT cluster, array_to_string(list(x ORDER BY nth), '; ') AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, encode(x)) AS nth FROM t) WHERE nth <= 10 GROUP BY 1),
co AS (SELECT c1.cluster, ((2 * sum(round(similarity * 10000)::BIGINT)::BIGINT + count(*)) // (2 * count(*))) / 10000 AS cohesion FROM l JOIN cl c1 ON c1.id = id1 GROUP BY 1) SELECT cluster, count(*) AS size, any_value(cohesion)::DOUBLE AS cohesion, any_value(top_terms) AS top_terms FROM cl JOIN co USING (cluster) JOIN tt USING (cluster) GROUP BY cluster"""


def _years_modularity(s, d):
    e, links, _ = _clusters(s, d)
    return biblio.modularity(e.select("id", F.col("year").alias("cluster")), links)


QUERIES["cluster_modularity"] = _years_modularity
SQL["cluster_modularity"] = _COMPONENTS + """, le AS (SELECT a.year AS c1, b.year AS c2 FROM l JOIN e a ON a.id = id1 JOIN e b ON b.id = id2),
en AS (SELECT c1 AS cluster, (c1 = c2)::INT AS x FROM le UNION ALL SELECT c2, 0 FROM le), dg AS (SELECT cluster, sum(x)::BIGINT AS "inner", count(*) AS degree FROM en GROUP BY 1)
SELECT cluster, "inner", degree, round(2 * sum("inner") OVER () / sum(degree) OVER (), 4)::DOUBLE AS coverage,
round(2 * sum("inner") OVER () / sum(degree) OVER () - sum(degree * degree) OVER () / (sum(degree) OVER ())::DOUBLE ^ 2, 4)::DOUBLE AS modularity FROM dg"""
# A part stands for an author, a part and its quantity of a line for an institution.
def _stand_ins(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_set(F.concat_ws(" ", "l_partkey", (F.col("l_quantity") % 5).cast("int"))).alias("institutions"))
    return entries(s, d).drop("institutions").withColumn("authors", F.col("keywords")).join(lines, F.col("id") == F.col("l_orderkey"))


QUERIES["cluster_keywords"] = lambda s, d: biblio.cluster_entries(entries(s, d))
QUERIES["cluster_authors"] = lambda s, d: biblio.cluster_entries(_stand_ins(s, d), "authors")
QUERIES["cluster_institutions"] = lambda s, d: biblio.cluster_entries(_stand_ins(s, d), "institutions")
QUERIES["clusters_merged"] = lambda s, d: biblio.merge_clusters(_clusters(s, d)[2], 10)
SQL["clusters_merged"] = _COMPONENTS + """, sz AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1), la AS (SELECT cluster AS l FROM sz ORDER BY n DESC, cluster LIMIT 1),
st AS (SELECT cluster FROM (SELECT * FROM sz WHERE cluster NOT IN (SELECT l FROM la) ORDER BY n DESC, cluster DESC LIMIT 9) UNION ALL SELECT l FROM la) SELECT id, CASE WHEN cluster IN (SELECT cluster FROM st) THEN cluster ELSE l END AS cluster FROM cl, la"""


def _burst(name, field, lower, gamma, least):
    QUERIES[name] = lambda s, d: biblio.bursts(biblio.term_years(entries(s, d), field, lower), gamma=gamma, least=least)
    SQL[name] = _WITH + f""", s AS (SELECT x AS term, year, count(*) AS n FROM ({_items(field, lower)}) WHERE length(x) > 1 GROUP BY 1, 2), f AS (SELECT *, sum(n) OVER (PARTITION BY term) AS frequency, (SELECT max(year) - min(year) + 1 FROM s) AS years FROM s),
    h AS (SELECT *, frequency / years AS expected, year - row_number() OVER (PARTITION BY term ORDER BY year) AS island FROM f WHERE frequency >= {least} AND frequency / years >= 0.5 AND n > frequency / years * (1 + {gamma}::DOUBLE)),
    o AS (SELECT term, any_value(frequency)::BIGINT AS frequency, min(year) AS burst_start, max(year) AS burst_end, round(max(n / expected), 4)::DOUBLE AS burst_strength, sum(n)::BIGINT AS burst_weight FROM h GROUP BY term, island)
    SELECT *, row_number() OVER (ORDER BY burst_strength DESC, encode(term), burst_start) AS rank FROM o"""


_burst("burst_keywords", "keywords", True, 0.5, 5)
_burst("burst_authors", "authors", False, 0.1, 5)
QUERIES["term_years_filled"] = lambda s, d: biblio.fill_years(biblio.term_years(entries(s, d), "countries"))
SQL["term_years_filled"] = _WITH + f""", s AS (SELECT x AS term, year, count(*) AS n FROM ({_items("countries", True)}) WHERE length(x) > 1 GROUP BY 1, 2), g AS (SELECT DISTINCT term, unnest(range((SELECT min(year) FROM s), (SELECT max(year) FROM s) + 1))::INT AS year FROM s)
SELECT term, year, coalesce(n, 0) AS n FROM g LEFT JOIN s USING (term, year)"""
QUERIES["year_slices"] = lambda s, d: biblio.year_slices(entries(s, d))
SQL["year_slices"] = _WITH + " SELECT year, count(*) AS entries, sum(citation_count)::BIGINT AS citations FROM e GROUP BY year"
QUERIES["timezone"] = lambda s, d: biblio.keyword_chains(entries(s, d))
SQL["timezone"] = _WITH + f""", c AS (SELECT x AS keyword, id AS source, lead(id) OVER (PARTITION BY x ORDER BY year, id) AS target FROM ({_items("keywords", True)})) SELECT * FROM c WHERE target IS NOT NULL ORDER BY encode(keyword), source, target LIMIT 500"""
QUERIES["dual_map"] = lambda s, d: biblio.dual_map(entries(s, d))
SQL["dual_map"] = _WITH + """, m AS (SELECT avg(year) AS mid FROM (SELECT DISTINCT year FROM e)) SELECT journal, count(*) AS total, count(*) FILTER (year <= mid) AS early, count(*) FILTER (year > mid) AS recent, least(count(*) FILTER (year <= mid), count(*) FILTER (year > mid)) AS link FROM e, m GROUP BY journal ORDER BY total DESC, journal LIMIT 50"""


def _landscape(s, d):
    e, links, c = _clusters(s, d)
    n = links.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg((F.count("*") / 1000.0).alias("centrality"))
    return biblio.landscape(e, c, n)


QUERIES["landscape"] = _landscape
