"""Queries over filters, counts and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import filters as where
from ..operators import analytics as A
from ..sources import testgraph as G
from ..sources.tables import table
from .catalog import query


@query("SELECT to_name AS name, to_id AS id, count(*) AS count FROM edges WHERE from_type = 'Order' AND label = 'contains' AND to_type = 'Part' GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 25")
def group_entities_by_connection(spark, d):
    return A.group_entities_by_connection(G.edges(spark, d), "Order", "contains", "Part", None, 25)


@query("SELECT to_name AS name, to_id AS id, count(*) AS count FROM edges WHERE from_type = 'Order' AND to_type = 'Customer' AND label = 'placed_by' AND continuity = 'Canon' GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 20")
def count_related_entities(spark, d):
    return A.count_related_entities(G.edges(spark, d), "Order", "Customer", "placed_by", False, "Canon", 20)


@query("SELECT * FROM (SELECT from_name AS name, from_id AS id, count(*) AS count FROM edges WHERE from_type = 'Order' AND to_type = 'Part' AND label = 'contains' GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 50) ORDER BY 3, 2")
def count_related_entities_asc(spark, d):
    return A.count_related_entities(G.edges(spark, d), "Order", "Part", "contains", True, None, 500, ascending=True)


@query("""SELECT brand, kind, count(*) AS count, array_to_string((list(id || ':' || name ORDER BY id))[1:3], '|') AS sources
FROM (SELECT p_partkey + 5000000000 AS id, p_name AS name, coalesce(p_brand, 'Unknown') AS brand, coalesce(array_to_string(string_split(p_type, ' '), ', '), 'Unknown') AS kind FROM part)
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30""")
def count_nodes_by_properties(spark, d):
    return A.count_nodes_by_properties(G.nodes(spark, d), "Part", ["Brand", "Kind"], None, 3, 30)


@query("""SELECT value, count(*) AS count, array_to_string((list(id || ':' || name ORDER BY id))[1:5], '|') AS sources
FROM (SELECT p_partkey + 5000000000 AS id, p_name AS name, unnest(string_split(p_type, ' ')) AS value FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def count_nodes_by_property(spark, d):
    return A.count_nodes_by_property(G.nodes(spark, d), "Part", "Kind", None, 20, 5)


@query("SELECT (floor(start_year / 2) * 2)::INT AS year, count(*) AS count FROM nodes WHERE type = 'Order' AND start_year <= 1999 AND (end_year IS NULL OR end_year >= 1995) AND start_year BETWEEN 1995 AND 1999 GROUP BY 1")
def count_by_year_range(spark, d):
    return A.count_by_year_range(G.nodes(spark, d), "Order", 1995, 1999, 2, None)


@query("SELECT (floor((year - 1998) / 10.0) * 10)::INT AS year, count(*) AS count FROM facets WHERE semantic = 'lifespan.start' AND continuity = 'Legends' AND year - 1998 BETWEEN -23 AND 23 GROUP BY 1")
def count_by_year_range_before_epoch(spark, d):
    shifted = G.facets(spark, d).withColumn("facets", F.transform("facets", lambda f: f.withField("year", f.year - 1998)))
    return A.count_facets_by_year(shifted, "lifespan.start", -23, 23, 10, "Order", "Legends")


@query("SELECT (floor(year / 5) * 5)::INT AS year, count(*) AS count FROM facets WHERE semantic LIKE 'lifespan%' AND year BETWEEN 1990 AND 2005 GROUP BY 1")
def count_facets_by_year_prefix(spark, d):
    return A.count_facets_by_year(G.facets(spark, d), "LIFESPAN", 1990, 2005, 5, exact=False)


@query("SELECT year, count(*) AS count FROM facets WHERE semantic = 'lifespan.end' AND year BETWEEN 1996 AND 2000 GROUP BY 1")
def count_lifecycle_transitions(spark, d):
    return A.count_facets_by_year(G.facets(spark, d), "lifespan.end", 1996, 2000, 1, "Order")


@query("SELECT id, name, type, semantic, year, year || ' CE' AS text, calendar FROM facets WHERE semantic = 'lifespan.end' AND year BETWEEN 1997 AND 1998 AND continuity = 'Canon' ORDER BY year, id LIMIT 100")
def find_by_lifecycle_transition(spark, d):
    return A.find_by_lifecycle_transition(G.facets(spark, d), "lifespan.end", 1997, 1998, "Order", "Canon", 500)


@query("SELECT label, count(*) AS count FROM edges WHERE from_type = 'Order' AND to_type = 'Supplier' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def count_edges_between_types(spark, d):
    return A.count_edges_between_types(G.edges(spark, d), "Order", "Supplier", None, 10)


@query("SELECT from_name AS name, from_id AS id, count(*) AS degree FROM edges WHERE from_type = 'Order' GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 15")
def top_connected_entities(spark, d):
    return A.top_connected_entities(G.edges(spark, d), "Order", None, None, 15)


@query("""SELECT place, dimension, count(from_id) AS count FROM (VALUES (0, 'contains'), (1, 'nothing'), (2, 'supplied_by'), (3, 'placed_by')) AS asked(place, dimension)
LEFT JOIN edges ON label = dimension AND from_id = 6000000001 GROUP BY 1, 2""")
def entity_profile(spark, d):
    return A.entity_profile(G.edges(spark, d), 6 * G.BASE + 1, ["contains", "nothing", "supplied_by", "placed_by"], None)


@query("SELECT type, count(*) AS count FROM nodes WHERE continuity = 'Canon' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def count_nodes_by_type(spark, d):
    return A.count_nodes_by_type(G.nodes(spark, d), "Canon", 10)


@query("""SELECT value, count(*) AS count, array_to_string((list(id || ':' || name ORDER BY id))[1:3], '|') AS sources FROM (
  SELECT c_custkey + 3000000000 AS id, c_name AS name, c_mktsegment AS value FROM customer WHERE c_custkey + 3000000000 IN (SELECT from_id FROM edges WHERE to_id = 2000000003 AND label = 'in_nation'))
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def count_property_for_related_entities(spark, d):
    return A.count_property_for_related(G.nodes(spark, d), G.edges(spark, d), 2 * G.BASE + 3, "in_nation", "Segment", True, None, 10, 3)


@query("SELECT label, count(*) AS count FROM edges WHERE from_type = 'Order' GROUP BY 1 ORDER BY 2 DESC, 1")
def edge_labels_for_source_type(spark, d):
    return A.edge_labels_for_type(G.edges(spark, d), "Order", None)


@query("""SELECT place, a.id, coalesce(any_value(n.name), '') AS name, a.label, count(e.from_id) AS count
FROM (SELECT i.place, i.id, l.label FROM (VALUES (0, 6000000007), (1, 6000000001), (2, 99)) AS i(place, id) CROSS JOIN (VALUES ('contains'), ('supplied_by'), ('placed_by')) AS l(label)) a
LEFT JOIN edges e ON e.from_id = a.id AND e.label = a.label LEFT JOIN nodes n ON n.id = a.id GROUP BY 1, 2, 4""")
def compare_entities(spark, d):
    return A.compare_entities(G.nodes(spark, d), G.edges(spark, d), [6 * G.BASE + 7, 6 * G.BASE + 1, 99], ["contains", "supplied_by", "placed_by"], None)


@query("SELECT label, count(*) AS count, round(avg(weight), 6) AS avg_weight FROM edges WHERE from_id = 6000000003 GROUP BY 1")
def relationship_types(spark, d):
    return A.relationship_types(G.edges(spark, d), 6 * G.BASE + 3, None)


@query("""SELECT label, sum(n)::BIGINT AS count, sum(canon)::BIGINT AS canon, sum(legends)::BIGINT AS legends, round(avg(mean), 6) AS avg_weight, round(sum(w) / sum(n), 6) AS weighted_avg,
  min(s).from_name AS sample_from, min(s).to_name AS sample_to,
  (SELECT string_agg(t, ', ' ORDER BY k DESC, t) FROM (SELECT from_type AS t, count(*) AS k FROM edges e WHERE e.label = p.label GROUP BY 1)) AS top_from_types,
  (SELECT string_agg(t, ', ' ORDER BY k DESC, t) FROM (SELECT to_type AS t, count(*) AS k FROM edges e WHERE e.label = p.label GROUP BY 1)) AS top_to_types
FROM (SELECT label, from_type, to_type, count(*) AS n, count(*) FILTER (continuity = 'Canon') AS canon, count(*) FILTER (continuity = 'Legends') AS legends, avg(weight) AS mean, sum(weight) AS w,
  min({'from_id': from_id, 'to_id': to_id, 'from_name': from_name, 'to_name': to_name}) AS s FROM edges GROUP BY 1, 2, 3) p GROUP BY label""")
def edge_label_statistics(spark, d):
    return A.edge_label_statistics(G.edges(spark, d))


_DECLARED = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in G.LABELS.items())


@query(f"""SELECT coalesce(u.label, l.label) AS label, coalesce(nullif(old, ''), nullif(reverse, ''), '') AS reverse, coalesce(description, '') AS description, coalesce(count, 0) AS count, coalesce(ft, '') AS from_types, coalesce(tt, '') AS to_types
FROM (SELECT label, count(*) AS count, string_agg(DISTINCT from_type, ',' ORDER BY from_type) AS ft, string_agg(DISTINCT to_type, ',' ORDER BY to_type) AS tt, max(reverse_label) AS old FROM edges GROUP BY 1) u
FULL JOIN (VALUES {_DECLARED}) AS l(label, reverse, description) ON u.label = l.label""")
def label_registry(spark, d):
    return A.label_registry(G.edges(spark, d), G.LABELS)


@query("SELECT type, count(*) AS count FROM facets WHERE pos = 0 GROUP BY 1")
def list_entity_types(spark, d):
    return G.facets(spark, d).where(where.sized("facets")).groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


@query("SELECT label, count(*) AS count FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def list_relationship_labels(spark, d):
    return G.bare_edges(spark, d).groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(3)


@query("SELECT label, from_id, to_id, count(*) AS count FROM (SELECT * FROM bare UNION ALL SELECT * FROM bare WHERE from_id % 10 = 0) GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_edges(spark, d):
    times = F.when(F.col("from_id") % 10 == 0, 2).otherwise(1)
    e = G.bare_edges(spark, d).select("label", "from_id", "to_id", F.explode(F.array_repeat(F.lit(1), times)).alias("one"))
    return e.repartition(2 * G.parts(spark, d), "from_id", "to_id").groupBy("label", "from_id", "to_id").agg(F.count("*").alias("count")).where("count > 1")


@query("SELECT type, realm, count(*) AS count FROM nodes GROUP BY 1, 2")
def realm_distribution(spark, d):
    return G.nodes(spark, d).groupBy("type", "realm").agg(F.count("*").alias("count"))


@query("""SELECT n_nationkey % 3 + 1995 AS year, r_name AS region, c_mktsegment AS faction, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def faction_region_counts(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy((F.col("n_nationkey") % 3 + 1995).alias("year"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("faction")).agg(F.count("*").alias("n"))


@query("""SELECT year, region, faction, round(greatest(n / total, CASE WHEN rank = 1 THEN 0.3 ELSE 0.1 END), 6) AS share, factions > 1 AND most / total < 0.7 AS contested FROM (
  SELECT *, row_number() OVER (PARTITION BY year, region ORDER BY n DESC, faction) AS rank, sum(n) OVER w AS total, count(*) OVER w AS factions, max(n) OVER w AS most FROM (
    SELECT n_nationkey % 3 + 1995 AS year, r_name AS region, c_mktsegment AS faction, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY year, region)) WHERE rank = 1 OR (factions > 1 AND most / total < 0.7)""")
def territory_control(spark, d):
    return A.territory_control(faction_region_counts(spark, d))


@query("""SELECT real_year AS year, sum(n)::BIGINT AS count, sum(canon)::BIGINT AS canon, sum(legends)::BIGINT AS legends, string_agg(template || '=' || n, ',' ORDER BY template) AS lenses FROM (
  SELECT real_year, template, count(*) AS n, count(*) FILTER (continuity = 'Canon') AS canon, count(*) FILTER (continuity = 'Legends') AS legends FROM timeline WHERE real_year IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def year_density(spark, d):
    return A.year_density(G.timeline(spark, d).where("real_year IS NOT NULL").withColumn("year", F.col("real_year")), "template")


@query("""SELECT o_orderpriority AS type, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS total FROM orders GROUP BY 1""", graph=False)
def builder_progress(spark, d):
    return A.progress(table(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status")), ["F", "O", "P"])


@query("SELECT name, id, type, (SELECT count(*) FROM nodes WHERE type = 'Customer' AND regexp_matches(name, '9', 'i')) AS total FROM nodes WHERE type = 'Customer' AND regexp_matches(name, '9', 'i') ORDER BY name, id LIMIT 20 OFFSET 20")
def browse_entities(spark, d):
    rows = G.nodes(spark, d).where((F.col("type") == "Customer") & where.matches("name", "9")).select("name", "id", "type")
    return A.paged(rows, ["name", "id"], 2, 20)


@query("SELECT id, name FROM nodes WHERE regexp_matches(name, 'order 1.*7$', 'i') AND continuity = 'Legends' ORDER BY name, id LIMIT 30")
def search_entities_regex(spark, d):
    return G.nodes(spark, d).where(where.matches("name", "ORDER 1.*7$") & where.graph_continuity("continuity", "Legends")).select("id", "name").orderBy("name", "id").limit(30)


@query("SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'er. ')", graph=False)
def search_literal(spark, d):
    return table(spark, d, "documents", "text").where(where.contains("text", "ER. ")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT type AS value, 'type' AS kind FROM nodes UNION ALL SELECT DISTINCT label, 'label' FROM edges WHERE label <> ''")
def distinct_types_and_labels(spark, d):
    types, labels = G.nodes(spark, d).select(F.col("type").alias("value")).distinct(), G.bare_edges(spark, d).select(F.col("label").alias("value")).where("value <> ''").distinct()
    return types.withColumn("kind", F.lit("type")).unionByName(labels.withColumn("kind", F.lit("label")))


@query("""SELECT id, name, start_year, end_year FROM nodes WHERE type = 'Order' AND continuity IN ('Canon') AND start_year <= 1997 AND (end_year IS NULL OR end_year >= 1996) ORDER BY start_year, id LIMIT 100""")
def find_entities_by_year(spark, d):
    first, last = sorted((1997, 1996))
    rows = G.nodes(spark, d).where((F.col("type") == "Order") & where.graph_continuity("continuity", "Canon") & where.envelope_overlap(first, last))
    return rows.select("id", "name", "start_year", "end_year").orderBy("start_year", "id").limit(100)


@query("""SELECT id, name FROM nodes WHERE type = 'Order' AND start_year BETWEEN 1998 AND 1998 ORDER BY id LIMIT 50""")
def find_entities_by_facet_year(spark, d):
    rows = G.facets(spark, d).where(where.has_facet("facets", "lifespan.start", first=1998, last=1998))
    return rows.select("id", "name").orderBy("id").limit(50)


@query("""SELECT n.id, n.name, n.start_year, (SELECT count(*) FROM nodes m WHERE m.type = 'Order' AND m.continuity = 'Canon' AND m.id IN (SELECT from_id FROM edges WHERE label = 'contains') AND m.start_year >= 1996) AS total
FROM nodes n WHERE n.type = 'Order' AND n.continuity = 'Canon' AND n.id IN (SELECT from_id FROM edges WHERE label = 'contains') AND n.start_year >= 1996 ORDER BY n.start_year DESC, n.id LIMIT 25""")
def browse_temporal_nodes(spark, d):
    have = G.bare_edges(spark, d).where("label = 'contains'").select(F.col("from_id").alias("id"))
    rows = G.facets(spark, d).where(where.sized("facets") & where.graph_continuity("continuity", "Canon") & where.has_facet("facets", "lifespan.start", first=1996)).join(have, "id", "left_semi")
    return A.paged(rows.select("id", "name", "start_year"), [F.desc("start_year"), "id"], 1, 25)


_VARIANTS = (("graph", where.graph_continuity, "continuity = 'Canon'"), ("timeline", where.timeline_continuity, "continuity IN ('Canon', 'Both', 'Unknown')"), ("category", where.category_continuity, "continuity = 'Canon'"), ("names", where.name_continuity, "continuity IN ('Canon', 'Both')"), ("pages", where.page_continuity, "continuity IN ('Canon', 'Both', 'Unknown')"))


@query("SELECT type, " + ", ".join(f"count(*) FILTER ({sql}) AS {n}" for n, _, sql in _VARIANTS) + ", count(*) FILTER (continuity IN ('Canon', 'Legends', 'Both')) AS category_default FROM nodes GROUP BY 1")
def continuity_variants(spark, d):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    made = [count(f("continuity", "Canon")).alias(n) for n, f, _ in _VARIANTS]
    return G.nodes(spark, d).groupBy("type").agg(*made, count(where.category_continuity("continuity", None)).alias("category_default"))


@query("""SELECT label, count(*) FILTER (to_realm IS NULL OR to_realm IN ('Fiction', 'Unknown')) AS "out", count(*) FILTER (from_realm IS NULL OR from_realm IN ('Fiction', 'Unknown')) AS back, count(*) FILTER (to_realm <> 'Real') AS names_made_up, count(*) FILTER (to_realm IN ('Real', 'Unknown')) AS names_real, count(*) FILTER (to_realm = 'Real') AS exact FROM edges GROUP BY 1""")
def realm_variants(spark, d):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return G.edges(spark, d).groupBy("label").agg(count(where.edge_realm("out", "Fiction")).alias("out"), count(where.edge_realm("in", "Fiction")).alias("back"), count(where.name_realm("to_realm", "Fiction")).alias("names_made_up"), count(where.name_realm("to_realm", "Real")).alias("names_real"), count(where.exact_realm("to_realm", "Real")).alias("exact"))


@query("""SELECT label, count(*) FILTER ((from_year IS NULL OR from_year <= 1997) AND (to_year IS NULL OR to_year >= 1996)) AS in_window, count(*) FILTER (from_year IS NULL OR (1997 >= from_year AND (to_year IS NULL OR 1997 <= to_year))) AS active FROM edges GROUP BY 1""")
def edges_in_time(spark, d):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return G.bare_edges(spark, d).groupBy("label").agg(count(where.edge_window(1996, 1997)).alias("in_window"), count(where.active_at(1997)).alias("active"))


@query("SELECT event_id, title FROM timeline WHERE year IS NOT NULL AND (CASE WHEN demarcation = 'Bby' THEN -year ELSE year END) BETWEEN -3 AND 2 AND coalesce(calendar, 'Galactic') = 'Galactic'")
def linear_year_filter(spark, d):
    return G.timeline(spark, d).where(where.linear_between(-3, 2) & where.in_calendar("Galactic")).select("event_id", "title")


@query("SELECT event_id, real_year FROM timeline WHERE real_year BETWEEN 1992 AND 2004")
def real_year_filter(spark, d):
    return G.timeline(spark, d).where(where.real_between(2004.5, 1991.5)).select("event_id", "real_year")


@query("SELECT * FROM cells WHERE col BETWEEN 5 AND 15 AND row BETWEEN 2 AND 9")
def viewport(spark, d):
    return G.cells(spark, d).where(where.in_box(5, 15, 2, 9))


@query("SELECT id, name, type FROM nodes WHERE id IN (1000000001, 2000000002, 6000000003, 7)")
def nodes_by_id(spark, d):
    return G.nodes(spark, d).where(F.col("id").isin(G.BASE + 1, 2 * G.BASE + 2, 6 * G.BASE + 3, 7)).select("id", "name", "type")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, (o_orderkey % 4 = 0) AS canon FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') ORDER BY 1 LIMIT 20", graph=False)
def browse_processed(spark, d):
    built = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").join(built, "o_custkey", "left_semi")
    return done.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4 == 0).alias("canon")).orderBy("id").limit(20)


@query("SELECT min(col) AS min_col, max(col) AS max_col, min(row) AS min_row, max(row) AS max_row, count(*) AS n FROM cells")
def grid_bounds(spark, d):
    return G.cells(spark, d).agg(F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.count("*").alias("n"))


@query("""SELECT col, row, sum(n)::BIGINT AS systems, arg_max(region, (n, region)) AS region FROM (SELECT col, row, region, count(*) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def cell_summary(spark, d):
    each = G.cells(spark, d).groupBy("col", "row", "region").agg(F.count("*").alias("n"))
    return each.groupBy("col", "row").agg(F.sum("n").alias("systems"), F.max_by("region", F.struct("n", "region")).alias("region"))


@query("""SELECT p_type AS template, word AS field, count(*) AS n, count(DISTINCT p_brand) AS brands FROM (SELECT p_type, p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1, 2 HAVING count(*) >= 3""", graph=False)
def template_field_inventory(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("template"), "p_brand", F.explode(F.split("p_name", " ")).alias("field"))
    return rows.groupBy("template", "field").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands")).where("n >= 3")


@query("""SELECT lang AS type, sum(n)::BIGINT AS chunks, count(*) AS pages, round(avg(n), 1) AS avg_chunks FROM (SELECT lang, doc_id, count(*) AS n FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY 1, 2) GROUP BY 1""", graph=False)
def chunking_progress(spark, d):
    each = table(spark, d, "documents", "lang", "doc_id", "text").select("lang", "doc_id", F.size(F.split("text", "\n")).alias("n")).groupBy("lang", "doc_id").agg(F.sum("n").alias("n"))
    return each.groupBy(F.col("lang").alias("type")).agg(F.sum("n").alias("chunks"), F.count("*").alias("pages"), F.round(F.avg("n"), 1).alias("avg_chunks"))


@query("SELECT lower(text) AS prompt, min(turn) AS first_turn FROM conversations WHERE role = 'user' GROUP BY 1", graph=False)
def suggestion_dedup(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy(F.lower("text").alias("prompt")).agg(F.min("turn").alias("first_turn"))


def half_by_half(sides: list, key: str, most: int):
    """Rows of several sides in turn: the first of each, then the second of each."""
    ranked = [s.withColumn("side", F.lit(i)) for i, s in enumerate(sides)]
    return reduce(lambda a, b: a.unionByName(b), ranked).orderBy(key, "side").limit(most)
