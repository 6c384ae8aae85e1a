"""Queries over the map's years, cells and grid, and over events of characters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import characters as C
from ..operators import galaxy as Y
from ..operators import graph as P
from ..operators import vectors
from ..sources import testgraph as G
from ..sources.tables import table
from ._texts import probe
from .build_queries import order_pages
from .catalog import query

#: Orders take place where the first of their suppliers outside Africa is; half of them are conflicts.
_EVENTS = """, places AS (SELECT id, arg_min(region, cell) AS region, arg_min(col, cell) AS col, arg_min(row, cell) AS row FROM (SELECT from_id AS id, c.id AS cell, region, col, row FROM bare JOIN cells c ON to_id = c.id WHERE label = 'supplied_by' AND region <> 'AFRICA') GROUP BY 1),
dated AS (SELECT n.*, p.region, p.col, p.row, CASE WHEN n.id % 2 = 0 AND end_year > start_year AND end_year - start_year <= 100 THEN end_year ELSE start_year END AS last FROM nodes n LEFT JOIN places p USING (id) WHERE start_year IS NOT NULL),
happened AS (SELECT *, unnest(range(start_year, last + 1)) AS year FROM dated)
"""


def _nodes(spark, d):
    return G.nodes(spark, d).withColumn("semantic", F.when(F.col("id") % 2 == 0, "conflict.start").otherwise("lifespan.start"))


def _places(spark, d):
    at = G.cells(spark, d).where("region <> 'AFRICA'").select(F.col("id").alias("to_id"), "name", "region", "col", "row")
    of = G.bare_edges(spark, d).where("label = 'supplied_by'").join(at, "to_id")
    return of.groupBy(F.col("from_id").alias("id")).agg(F.min(F.struct("to_id", F.col("name").alias("place"), "region", "col", "row")).alias("p")).select("id", "p.place", "p.region", "p.col", "p.row")


def _eras(spark):
    return spark.createDataFrame([("Early", 1990, 1994, "Canon"), ("Late", 1994, 1996, "Legends"), ("Shared", 1990, 1990, "Both")], "name string, start_year int, end_year int, continuity string")


def _documents(spark, d):
    governments = spark.createDataFrame([(1985, 1993), (1994, None)], "start_year int, end_year int")
    return Y.year_documents(_nodes(spark, d), _places(spark, d), _eras(spark), governments)


@query(_EVENTS + "SELECT type AS lens, count(*) AS total, count(p.id) AS with_location, arg_min(realm = 'Real', n.id) AS is_real FROM nodes n LEFT JOIN places p ON n.id = p.id WHERE start_year IS NOT NULL GROUP BY 1")
def lens_totals(spark, d):
    return Y.lens_totals(G.nodes(spark, d), _places(spark, d))


@query(_EVENTS + """SELECT year::INT AS year, col, row, count(*) AS count, arg_min(region, id) AS region, array_to_string((list(name ORDER BY id))[1:15], ';') AS titles FROM happened WHERE col IS NOT NULL GROUP BY 1, 2, 3""")
def year_event_cells(spark, d):
    cells = _documents(spark, d).select("year", F.inline("cells"))
    return cells.select("year", "col", "row", "count", "region", F.array_join(F.transform("events", lambda e: e.title), ";").alias("titles"))


@query(_EVENTS + """, years AS (SELECT year FROM happened UNION SELECT * FROM (VALUES (1985), (1993), (1994)))
SELECT y.year::INT AS year, CASE WHEN y.year <= 0 THEN abs(y.year) || ' BBY' ELSE y.year || ' ABY' END AS display, CASE WHEN y.year BETWEEN 1990 AND 1994 THEN 'Early' WHEN y.year BETWEEN 1995 AND 1996 THEN 'Late' END AS era,
  count(h.id) AS count, count(h.id) FILTER (continuity = 'Canon') AS canon, count(h.id) FILTER (continuity = 'Legends') AS legends, count(h.id) FILTER (col IS NULL) AS unresolved, array_to_string((list(name ORDER BY h.id) FILTER (h.id IS NOT NULL AND col IS NULL))[1:30], ';') AS open
FROM years y LEFT JOIN happened h ON y.year = h.year GROUP BY 1, 2, 3, y.year""")
def galaxy_years(spark, d):
    titles = F.array_join(F.transform("unresolved_events", lambda e: e.title), ";")
    return _documents(spark, d).select("year", "display", "era", "count", "canon", "legends", "unresolved", F.when(titles != "", titles).alias("open"))


@query(_EVENTS + "SELECT year::INT AS year, type AS lens, count(*) AS n FROM happened WHERE year BETWEEN 1993 AND 1995 GROUP BY 1, 2")
def galaxy_year_range(spark, d):
    return Y.years_between(_documents(spark, d), 1993, 1995).select("year", F.explode("lens_counts").alias("lens", "n"))


@query(_EVENTS + """, of AS (SELECT col, count(*) AS n FROM happened WHERE year = 1995 GROUP BY col, row)
SELECT 1995 AS year, 'Late' AS era, sum(CASE WHEN col IS NULL THEN least(n, 30) ELSE n END)::BIGINT AS total, least(30, coalesce(sum(least(n, 15)) FILTER (col IS NOT NULL), 0))::BIGINT AS shown FROM of""")
def galaxy_year(spark, d):
    return Y.galaxy_year(_documents(spark, d), 1995).select("year", "era", "total", F.size("events").cast("long").alias("shown"))


@query(_EVENTS + "SELECT 'No data for year 1900.' AS error, array_to_string(list(year ORDER BY year), ',') AS nearest FROM (SELECT DISTINCT year FROM (SELECT year FROM happened UNION SELECT * FROM (VALUES (1985), (1993), (1994))) ORDER BY year LIMIT 5)")
def galaxy_year_missing(spark, d):
    return Y.galaxy_year(_documents(spark, d), 1900).select("error", F.array_join(F.transform("nearest", lambda y: y.cast("string")), ",").alias("nearest"))


@query("SELECT * FROM (VALUES ('Early', 1990, 1994), ('Shared', 1990, 1990)) t(name, start_year, end_year)", graph=False)
def galaxy_overview_eras(spark, d):
    documents, names = _documents(spark, d), G.cells(spark, d).select(F.col("region").alias("name")).distinct()
    whole = Y.overview(documents, Y.lens_totals(G.nodes(spark, d), _places(spark, d)), _eras(spark), names.withColumn("colour", Y.colour(F.col("name"))))
    return Y.eras_shown(whole, "Canon").select(F.inline("eras")).select("name", "start_year", "end_year")


@query("""SELECT col, row, sum(n)::BIGINT AS systems, arg_max(region, (n, -ascii(region))) AS region, array_to_string(any_value(sectors), ';') AS sectors FROM (SELECT col, row, region, count(*) AS n FROM cells GROUP BY 1, 2, 3) JOIN (SELECT col, row, list(nation || ':' || m ORDER BY m DESC, nation) AS sectors FROM (SELECT col, row, nation, count(*) AS m FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (col, row) GROUP BY 1, 2""")
def cell_sectors(spark, d):
    out = Y.cell_summaries(G.cells(spark, d).withColumn("sector", F.col("nation")))
    return out.select("col", "row", "systems", "region", F.array_join(F.transform("sectors", lambda s: F.concat_ws(":", s["name"], s["count"])), ";").alias("sectors"))


@query("SELECT region, array_to_string(list(col || '-' || row ORDER BY col, row), ';') AS cells FROM (SELECT DISTINCT region, col, row FROM cells) GROUP BY 1")
def region_geography(spark, d):
    return Y.region_cells(G.cells(spark, d)).select("region", F.array_join(F.transform("cells", lambda c: F.concat_ws("-", c.col, c.row)), ";").alias("cells"))


@query("SELECT o_orderkey + 6000000000 AS id, 'y' AS has FROM orders UNION ALL SELECT r_regionkey + 1000000000, NULL FROM region", graph=False)
def event_payloads(spark, d):
    rows = C.with_payload(G.nodes(spark, d).where("type IN ('Order', 'Region')"), order_pages(spark, d))
    return rows.select("id", F.when(F.col("payload").isNotNull(), "y").alias("has"))


@query("""SELECT event_id, event_type, year, location FROM (SELECT event_id, event_type, year(ts)::DOUBLE AS year, user_id % 5 AS location, row_number() OVER (PARTITION BY event_type, year(ts), user_id % 5 ORDER BY value > 50 DESC, event_id) AS turn FROM events) WHERE turn = 1""", graph=False)
def consolidated_events(spark, d):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    e = table(spark, d, "events", "event_id", "event_type", "ts", "user_id", "value")
    place = F.concat(F.when(F.col("event_id") % 2 == 0, "the Planet ").otherwise(" "), F.col("user_id") % 5)
    rows = e.select("event_id", F.col("event_type").alias("type"), F.year("ts").cast("double").alias("year"), F.lit("aby").alias("demarcation"), none.alias("date_text"), place.alias("location"), none.alias("description"), none.alias("narrative"),
                    F.when(F.col("value") > 50, "much").alias("significance"), none.alias("source_title"), empty.alias("related"), empty.alias("consequences"), (F.col("user_id") % 5).alias("place"))
    return C.consolidate(rows).select("event_id", F.col("type").alias("event_type"), "year", F.col("place").alias("location"))


@query("""SELECT event_id, min(from_year) AS year, 'Aby' AS demarcation FROM (SELECT e.event_id, b.from_year FROM events e JOIN bare b ON b.to_id = 3000000000 + e.user_id AND b.label = 'placed_by' AND b.from_id = 6000000000 + e.event_id) GROUP BY 1""")
def inferred_years(spark, d):
    """Events of customers that name an order: the year of the customer's edge with it."""
    e = table(spark, d, "events", "event_id", "user_id").select("event_id", (F.col("user_id") + 3 * G.BASE).alias("character_id"), F.lit(None).cast("double").alias("year"), F.lit(" ").alias("location"), F.array(F.lit("nobody"), F.concat(F.lit(" ORDER "), "event_id")).alias("related"))
    return C.infer_years(e, G.edges(spark, d), G.nodes(spark, d)).select("event_id", "year", "demarcation")


@query("SELECT label FROM (SELECT label, count(*) AS n FROM edges WHERE from_type = 'Order' GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, label LIMIT 3)")
def stronger_labels(spark, d):
    found = C.stronger_labels(G.nodes(spark, d), G.edges(spark, d), "Order", "Colour")
    return spark.createDataFrame([(x,) for x in found], "label string")


def _map_pages(spark, d):
    """Suppliers as pages with a square, customers as pages that name a supplier as their home."""
    box = lambda label, value: F.struct(F.lit("x/Template:Party").alias("Template"), F.lit(None).cast("string").alias("ImageUrl"), F.array(F.struct(F.lit(label).alias("Label"), F.array(value).alias("Values"), F.array(F.struct(value.alias("Content"), value.alias("Href"))).alias("Links"))).alias("Data")).alias("infobox")
    page = lambda id_, name, box: [id_.alias("pageId"), name.alias("title"), F.lit("").alias("text"), F.lit("Canon").alias("continuity"), box]
    home = F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") * 7 % 10 + 1).cast("string"), 9, "0"))
    places = G.cells(spark, d).select(page(F.col("id"), F.col("name"), box("Grid square", F.col("grid"))))
    return places.unionByName(table(spark, d, "customer").select(page(F.col("c_custkey") + 3 * G.BASE, F.col("c_name"), box("Homeworld", home))))


@query("""SELECT grid AS grid_key, id AS page_id, name, 'direct' AS match, NULL AS linked_via, NULL::BIGINT AS source_id FROM cells WHERE name = 'Supplier#000000003'
UNION ALL SELECT grid, id, name, 'linked', 'Homeworld of ' || c_name, c_custkey + 3000000000 FROM customer JOIN cells ON id = c_custkey * 7 % 10 + 4000000001 WHERE c_name = 'Customer#000000003'""")
def grid_search(spark, d):
    return Y.grid_search(_map_pages(spark, d), "000000003").select("grid_key", "page_id", "name", "match", "linked_via", "source_id")


@query("""SELECT * FROM (SELECT grid AS grid_key, id AS page_id, 'semantic' AS match, NULL::BIGINT AS source_id, 0.7::DOUBLE AS score FROM cells WHERE id <= 4000000003
UNION ALL SELECT grid, id, 'semantic-linked', min(c_custkey) + 3000000000, max(0.9)::DOUBLE FROM customer JOIN cells ON id = c_custkey * 7 % 10 + 4000000001 WHERE c_custkey <= 6 AND id > 4000000003 GROUP BY 1, 2)""")
def semantic_grid_search(spark, d):
    hit = lambda df, score: df.select(F.col("pageId").alias("id"), F.lit(score).alias("score"), F.col("title").alias("text"))
    pages = _map_pages(spark, d)
    near = pages.where(F.col("pageId").between(4 * G.BASE, 4 * G.BASE + 3))
    every = hit(near, 0.95).unionByName(hit(pages.where(F.col("pageId").between(3 * G.BASE, 3 * G.BASE + 6)), 0.9))
    return Y.semantic_grid_search(pages, hit(near, 0.7), every).select("grid_key", "page_id", "match", "source_id", "score")


@query("""SELECT grid_key, page_id, match, source_id, score FROM (WITH v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS exact, vec_id % 3 = 0 AS place, CASE WHEN vec_id % 3 = 0 THEN 4000000001 + vec_id % 10 ELSE 3000000001 + vec_id % 100 END AS page FROM embeddings),
f AS (SELECT page, exact, vec_id, 0 AS turn FROM (SELECT * FROM v WHERE place AND exact >= 0.05 ORDER BY exact DESC, vec_id LIMIT 8) UNION ALL SELECT page, exact, vec_id, 1 FROM (SELECT * FROM v WHERE exact >= 0.05 ORDER BY exact DESC, vec_id LIMIT 12)),
h AS (SELECT page, round(exact, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY turn, round(exact, 6) DESC, 'chunk ' || vec_id) = 1),
l AS (SELECT grid, id, min(page) AS source FROM h JOIN cells ON page < 4000000000 AND id = (page - 3000000000) * 7 % 10 + 4000000001 WHERE id NOT IN (SELECT page FROM h) GROUP BY 1, 2)
SELECT grid AS grid_key, page AS page_id, 'semantic' AS match, NULL::BIGINT AS source_id, score FROM h JOIN cells ON id = page
UNION ALL SELECT grid, id, 'semantic-linked', source, score FROM l JOIN h ON page = source) ORDER BY match, score DESC, page_id LIMIT 4""")
def grid_search_by_vector(spark, d):
    """The squares of what a vector finds among places and customers, which name places as their homes."""
    place = F.col("vec_id") % 3 == 0
    chunks = table(spark, d, "embeddings", F.col("vec_id").alias("id"), F.when(place, F.col("vec_id") % 10 + 4 * G.BASE + 1).otherwise(F.col("vec_id") % 100 + 3 * G.BASE + 1).alias("page"), F.when(place, "Place").otherwise("Person").alias("type"), F.concat(F.lit("chunk "), "vec_id").alias("text"), "embedding")
    index = f"{P.shared(spark)}/chunk-vectors-{uuid.uuid4().hex}"
    vectors.build(chunks, index, "embedding", ["page", "type", "text"])
    return Y.grid_search_by_vector(_map_pages(spark, d), index, probe(spark, d), ["Place"], 4, 0.05).select("grid_key", "page_id", "match", "source_id", "score")


def _mart(spark, d):
    """Orders as dated nodes, a third of which name a supplier as their location; suppliers outside Africa as systems, held by
    their nations for some years."""
    home = F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 10 + 1).cast("string"), 9, "0"))
    nodes = _nodes(spark, d).withColumn("properties", F.when(F.col("id") % 3 == 0, F.create_map(F.lit("Location"), F.array(F.lit("nowhere"), home))).otherwise(F.col("properties")))
    systems = G.cells(spark, d).where("region <> 'AFRICA'").select("id", "name", "region", "col", "row", "nation")
    first = (F.col("id") % 4 + 1991).cast("int")
    held = systems.select("id", F.col("nation").alias("faction"), F.when(F.col("id") % 5 != 0, first).alias("from_year"), F.when(F.col("id") % 2 == 0, first + 3).alias("to_year"))
    edges = G.bare_edges(spark, d).where("label IN ('supplied_by', 'in_nation') AND from_id % 9 <> 0")
    return Y.year_mart(nodes, edges, systems, held, _eras(spark), hops=2)


_MART = """, systems AS (SELECT * FROM cells WHERE region <> 'AFRICA'),
near AS (SELECT from_id AS id, min(c.id) AS at FROM bare JOIN systems c ON to_id = c.id WHERE label = 'supplied_by' AND from_id % 9 <> 0 GROUP BY 1),
named AS (SELECT n.id, s.id AS at FROM nodes n JOIN systems s ON s.name = 'Supplier#' || lpad((n.id % 10 + 1)::VARCHAR, 9, '0') WHERE n.id % 3 = 0 AND n.id NOT IN (SELECT id FROM near)),
places AS (SELECT p.id, region, col, row FROM (SELECT * FROM near UNION ALL SELECT * FROM named) p JOIN systems s ON s.id = p.at),
dated AS (SELECT n.*, p.region, p.col, p.row, CASE WHEN n.id % 2 = 0 AND end_year > start_year AND end_year - start_year <= 100 THEN end_year ELSE start_year END AS last FROM nodes n LEFT JOIN places p USING (id) WHERE start_year IS NOT NULL),
happened AS (SELECT *, unnest(range(start_year, last + 1)) AS year FROM dated),
held AS (SELECT region, nation AS faction, CASE WHEN id % 5 <> 0 THEN id % 4 + 1991 END AS first, CASE WHEN id % 2 = 0 THEN id % 4 + 1994 END AS last FROM systems),
counts AS (SELECT year, h.region, faction, count(*) AS n FROM (SELECT DISTINCT year FROM happened) y JOIN held h ON (first IS NULL OR first <= year) AND (h.last IS NULL OR year <= h.last) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY year, region ORDER BY n DESC, faction) AS rank, sum(n) OVER (PARTITION BY year, region) AS total, count(*) OVER (PARTITION BY year, region) AS factions, max(n) OVER (PARTITION BY year, region) AS most FROM counts)
"""


@query(_MART + "SELECT year::INT AS year, count(*) AS count, count(*) FILTER (col IS NULL) AS unresolved, count(DISTINCT (col, row)) FILTER (col IS NOT NULL) AS cells FROM happened GROUP BY 1")
def composed_years(spark, d):
    """Each year's events, placed by traversal or else by a property."""
    return _mart(spark, d).select("year", "count", "unresolved", F.size("cells").cast("long").alias("cells"))


@query(_MART + "SELECT year::INT AS year, region, faction, round(greatest(n / total, CASE WHEN rank = 1 THEN 0.3 ELSE 0.1 END), 6) AS share, factions > 1 AND most / total < 0.7 AS contested FROM ranked WHERE rank = 1 OR factions > 1 AND most / total < 0.7")
def composed_territory(spark, d):
    """Who held each region in each year that has a document."""
    return _mart(spark, d).select("year", F.inline("regions"))
