"""Queries over pages with infoboxes, samples, bundles, dated territory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import graph as P
from ..operators import pages as I
from ..sources import testgraph as G
from ..sources.tables import table
from .build_queries import order_pages
from .catalog import query


@query("SELECT 'Order' AS type", graph=False)
def infobox_types(spark, d):
    return I.infobox_types(order_pages(spark, d))


@query("SELECT label, count(*) AS n FROM orders CROSS JOIN (VALUES ('Placed'), ('Span'), ('Status'), ('Customer'), ('PriceTag(s)'), ('Home port')) f(label) GROUP BY 1", graph=False)
def infobox_labels(spark, d):
    return I.label_usage(order_pages(spark, d), "Order")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30", graph=False)
def sample_label_values(spark, d):
    return I.sample_values(order_pages(spark, d), "Order", "PriceTag(s)")


@query("SELECT label, count(*) AS n FROM orders CROSS JOIN (VALUES ('Customer'), ('Home port')) f(label) GROUP BY 1", graph=False)
def link_label_samples(spark, d):
    return I.link_labels(order_pages(spark, d), "Order")


@query("SELECT o_orderkey + 6000000000 AS id FROM orders WHERE contains(lower(o_orderpriority), 'urg')", graph=False)
def pages_by_value(spark, d):
    return I.by_value(order_pages(spark, d), "PriceTag(s)", "URG").select(F.col("pageId").alias("id"))


@query("SELECT o_orderkey + 6000000000 AS id FROM orders WHERE o_custkey = 7", graph=False)
def pages_by_link(spark, d):
    return I.by_link(order_pages(spark, d), "https://example.org/wiki/customer%23000000007").select(F.col("pageId").alias("id"))


@query("SELECT count(*) AS n FROM orders", graph=False)
def pages_without_field(spark, d):
    return I.without_field(order_pages(spark, d), "Grid square").agg(F.count("*").alias("n"))


@query("""SELECT id, big FROM (SELECT *, row_number() OVER (PARTITION BY big ORDER BY md5('7:' || id)) AS turn FROM (SELECT c_custkey AS id, c_acctbal > 5000 AS big FROM customer)) WHERE turn <= 11 ORDER BY turn, big DESC LIMIT 11""", graph=False)
def stratified_sample(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 5000).alias("big"))
    return I.half_and_half(rows, "big", "id", 11, 7)


@query()
def page_bundles(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", F.length("text").alias("chars"))
    return I.bundles(sized, "source", ["doc_id"], F.col("chars"))


@query("""SELECT c.id, c.name, c.col, c.row, c.region, coalesce(string_agg(b.name, ',' ORDER BY b.name), '') AS bodies, count(b.name) AS n FROM cells c
LEFT JOIN (SELECT s_suppkey % 10 + 1 + 4000000000 AS system, s_name AS name FROM supplier) b ON b.system = c.id WHERE c.col BETWEEN 0 AND 20 AND c.row BETWEEN 0 AND 15 GROUP BY ALL""")
def systems_in_viewport(spark, d):
    bodies = table(spark, d, "supplier").select((F.col("s_suppkey") % 10 + 1 + 4 * G.BASE).alias("system"), F.col("s_name").alias("name"))
    return I.viewport(G.cells(spark, d), bodies, (0, 20, 0, 15))


_HELD = """(SELECT y.year::INT AS year, r_name AS region, o_orderpriority AS faction, count(*) AS n FROM (SELECT year(o_orderdate) AS f, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) + 2 END AS t, o_orderpriority, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) a JOIN range(1994, 2003) y(year) ON y.year >= a.f AND (a.t IS NULL OR y.year <= a.t) GROUP BY 1, 2, 3)"""


def _affiliations(spark, d):
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    at = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    year = F.year("o_orderdate")
    return at.select(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("faction"), year.alias("from_year"), F.when(F.col("o_orderkey") % 7 != 0, year + 2).alias("to_year"))


@query(f"SELECT * FROM {_HELD}", graph=False)
def dated_territory_counts(spark, d):
    return I.controlled(_affiliations(spark, d), 1994, 2002)


@query(f"""SELECT year, region, faction, round(greatest(n / total, CASE WHEN rank = 1 THEN 0.3 ELSE 0.1 END), 6) AS share, factions > 1 AND most / total < 0.7 AS contested FROM (
  SELECT *, row_number() OVER (PARTITION BY year, region ORDER BY n DESC, faction) AS rank, sum(n) OVER w AS total, count(*) OVER w AS factions, max(n) OVER w AS most FROM {_HELD} WINDOW w AS (PARTITION BY year, region)) WHERE rank = 1 OR (factions > 1 AND most / total < 0.7)""", graph=False)
def dated_territory(spark, d):
    return A.territory_control(dated_territory_counts(spark, d))


@query("SELECT from_id, to_id, label, weight, direction FROM (SELECT *, CASE WHEN direction = 'forward' THEN label ELSE reverse_label END AS own FROM bidir) WHERE from_id = 2000000003 AND own IN ('in_region', 'in_nation') ORDER BY weight DESC, to_id, label, direction LIMIT 40")
def relationships_by_category(spark, d):
    names = [k for k, v in G.LABELS.items() if v[2] == "geography"]
    rows = P.bidirectional(G.edges(spark, d)).where((F.col("from_id") == 2 * G.BASE + 3) & F.when(F.col("direction") == "forward", F.col("label")).otherwise(F.col("reverse_label")).isin(names))
    return rows.select("from_id", "to_id", "label", "weight", "direction").orderBy(F.desc("weight"), "to_id", "label", "direction").limit(40)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v[2]}', '{k}', '{v[0]}', {v[3]}::DOUBLE)" for k, v in G.LABELS.items()) + ") t(category, label, reverse, weight)", graph=False)
def labels_by_category(spark, d):
    return spark.createDataFrame([(v[2], k, v[0], v[3]) for k, v in G.LABELS.items()], "category string, label string, reverse string, weight double")


@query("SELECT type, count(*) AS nodes, count(start_year) AS dated, min(start_year) AS first, max(end_year) AS last FROM nodes GROUP BY 1")
def describe_entity_schema(spark, d):
    return G.nodes(spark, d).groupBy("type").agg(F.count("*").alias("nodes"), F.count("start_year").alias("dated"), F.min("start_year").alias("first"), F.max("end_year").alias("last"))
