"""Queries over joins, windows, sets and traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecal
from ..operators import analytics as A
from ..operators import graph as P
from ..sources import testgraph as G
from ..sources.tables import table
from .catalog import query

N, B = 2 * G.BASE, G.BASE


@query("SELECT direction, label, count(*) AS n, count(DISTINCT from_id) AS sources, round(sum(weight), 4) AS weight FROM bidir GROUP BY 1, 2")
def bidirectional_edges(spark, d):
    return P.bidirectional(G.edges(spark, d)).groupBy("direction", "label").agg(F.count("*").alias("n"), F.count_distinct("from_id").alias("sources"), F.round(F.sum("weight"), 4).alias("weight"))


@query("""SELECT from_id, to_id, label, weight, direction FROM (
  (SELECT *, 'forward' AS direction FROM edges WHERE from_id = 3000000005 ORDER BY weight DESC, to_id, label LIMIT 10) UNION ALL
  (SELECT * FROM bidir WHERE direction = 'reverse' AND from_id = 3000000005 ORDER BY weight DESC, to_id, label LIMIT 10)) ORDER BY weight DESC, to_id, label, direction LIMIT 20""")
def entity_relationships(spark, d):
    return P.all_edges(G.edges(spark, d), 3 * B + 5, None, None, 20).select("from_id", "to_id", "label", "weight", "direction")


@query("SELECT from_id, to_id, label, weight FROM edges WHERE from_id = 6000000002 AND label = 'contains' ORDER BY weight DESC, to_id LIMIT 10")
def outgoing_edges(spark, d):
    return P.outgoing(G.edges(spark, d), 6 * B + 2, "contains", None, 10).select("from_id", "to_id", "label", "weight")


@query("SELECT DISTINCT label FROM bidir WHERE from_id = 2000000003")
def labels_for_entity(spark, d):
    return P.labels_for_entity(G.bare_edges(spark, d), N + 3)


@query("""SELECT CASE WHEN from_id = 2000000003 THEN 0 ELSE 1 END AS depth, count(*) AS n FROM (SELECT DISTINCT from_id FROM bidir WHERE from_id = 2000000003
  UNION SELECT to_id FROM (SELECT to_id, weight FROM bidir WHERE from_id = 2000000003 AND label IN ('in_region', 'has_member') ORDER BY to_id LIMIT 500)) GROUP BY 1""")
def neighbourhood_depth_one(spark, d):
    nodes, _ = P.neighbourhood(G.edges(spark, d), N + 3, ["in_region", "in_nation"], 1, max_nodes=1000)
    return nodes.groupBy("depth").agg(F.count("*").alias("n"))


@query("""SELECT e.from_id, e.to_id, string_agg(DISTINCT label, ' / ' ORDER BY label) AS label, max(weight) AS weight FROM edges e
  JOIN (SELECT 6000000001 AS id UNION SELECT to_id FROM edges WHERE from_id = 6000000001) a ON e.from_id = a.id
  JOIN (SELECT 6000000001 AS id UNION SELECT to_id FROM edges WHERE from_id = 6000000001) b ON e.to_id = b.id GROUP BY 1, 2""")
def traverse_graph(spark, d):
    _, merged = P.neighbourhood(G.edges(spark, d), 6 * B + 1, None, 1, max_nodes=1000)
    return merged.select("from_id", "to_id", "label", "weight")


@query("""SELECT hop, from_id, to_id FROM (SELECT 1 AS hop, from_id, to_id FROM bare WHERE label = 'in_nation' AND to_id = 2000000004)""")
def lineage_reverse(spark, d):
    return P.lineage(G.bare_edges(spark, d), N + 4, "in_nation", "reverse", 5)


_PARTS = """parts AS (SELECT p_partkey AS from_id, (p_partkey / 2)::BIGINT AS to_id FROM part WHERE p_partkey > 1 AND p_partkey % 2 = 0 UNION ALL SELECT p_partkey, ((p_partkey - 1) / 2)::BIGINT FROM part WHERE p_partkey > 1 AND p_partkey % 2 = 1)"""


def part_tree(spark, d):
    """Parts as a binary tree: each but the first belongs to the one of half its number."""
    p = table(spark, d, "part", "p_partkey").where("p_partkey > 1")
    return p.select(F.col("p_partkey").alias("from_id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("to_id"), F.lit("part_of").alias("label"), F.lit("").alias("reverse_label"), F.lit(1.0).alias("weight"), F.lit("Canon").alias("continuity"), F.lit(None).cast("int").alias("from_year"), F.lit(None).cast("int").alias("to_year"))


_CLOSED = f"WITH RECURSIVE {_PARTS}, reach AS (SELECT from_id AS id, to_id AS ancestor, 1 AS depth FROM parts UNION ALL SELECT r.id, p.to_id, r.depth + 1 FROM reach r JOIN parts p ON r.ancestor = p.from_id) "


@query(_CLOSED + "SELECT id, ancestor, min(depth)::INT AS depth FROM reach GROUP BY 1, 2", graph=False)
def transitive_closure(spark, d):
    return P.closure(part_tree(spark, d), ["part_of"])


@query(_CLOSED + "SELECT id, string_agg(ancestor, ',' ORDER BY depth, ancestor) AS ancestors FROM reach GROUP BY 1", graph=False)
def closure_lists(spark, d):
    return P.closure_lists(P.closure(part_tree(spark, d), ["part_of"])).select("id", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), ",").alias("ancestors"))


@query(_CLOSED + "SELECT id FROM reach WHERE ancestor = 5", graph=False)
def lineage_membership(spark, d):
    lists = P.closure_lists(P.closure(part_tree(spark, d), ["part_of"])).select("id", F.create_map(F.lit("part_of"), "ancestors").alias("lineages"))
    return lists.where(P.is_in_lineage("lineages", "part_of", 5)).select("id")


@query("""SELECT from_id AS id, to_id AS ancestor, 1 AS depth FROM bare WHERE label IN ('in_nation', 'in_region') UNION ALL
SELECT a.from_id, b.to_id, 2 FROM bare a JOIN bare b ON a.to_id = b.from_id WHERE a.label = 'in_nation' AND b.label = 'in_region'""")
def closure_in_region(spark, d):
    return P.closure(G.bare_edges(spark, d), ["in_nation", "in_region"])


@query(_CLOSED.replace("UNION ALL SELECT r.id", "UNION ALL SELECT r.id") + "SELECT depth::INT AS hop, 100::BIGINT * 0 + from_id AS from_id, to_id FROM (SELECT r.depth, p.from_id, p.to_id FROM (SELECT 100::BIGINT AS id, 100::BIGINT AS ancestor, 1 AS depth UNION ALL SELECT id, ancestor, depth + 1 FROM reach WHERE id = 100) r JOIN parts p ON p.from_id = r.ancestor WHERE r.depth <= 10)", graph=False)
def lineage(spark, d):
    return P.lineage(part_tree(spark, d), 100, "part_of", "forward", 10)


@query(f"WITH {_PARTS} SELECT 1 AS step, from_id, to_id, 'part_of' AS label, 'forward' AS direction FROM parts WHERE from_id = 10 UNION ALL SELECT 2, to_id, from_id, 'part_of', 'reverse' FROM parts WHERE from_id = 11 AND to_id = 5", graph=False)
def find_connections(spark, d):
    return P.connect(part_tree(spark, d), 10, 11, 3)


@query(f"""WITH RECURSIVE {_PARTS}, near AS (SELECT from_id AS a, to_id AS b FROM parts UNION ALL SELECT to_id, from_id FROM parts),
walk AS (SELECT from_id AS id, from_id AS pos, 0 AS depth FROM parts WHERE from_id % 5 = 0 UNION SELECT w.id, n.b, w.depth + 1 FROM walk w JOIN near n ON w.pos = n.a WHERE w.depth < 3)
SELECT id, min(pos) AS place, depth::INT AS depth FROM walk w WHERE pos % 7 = 0 AND depth > 0 AND pos <> id AND depth = (SELECT min(depth) FROM walk v WHERE v.id = w.id AND v.pos % 7 = 0 AND v.depth > 0 AND v.pos <> v.id) GROUP BY id, depth""", graph=False)
def nearest_location(spark, d):
    tree = part_tree(spark, d)
    return P.nearest_location(tree, tree.where("from_id % 7 = 0").select(F.col("from_id").alias("id")), tree.where("from_id % 5 = 0").select(F.col("from_id").alias("id")))


@query(f"""WITH RECURSIVE {_PARTS}, near AS (SELECT from_id AS a, to_id AS b FROM parts UNION ALL SELECT to_id, from_id FROM parts),
walk AS (SELECT 6::BIGINT AS id, 0 AS depth UNION SELECT n.b, w.depth + 1 FROM walk w JOIN near n ON w.id = n.a WHERE w.depth < 4) SELECT id, min(depth)::INT AS depth FROM walk GROUP BY 1""", graph=False)
def depth_labels(spark, d):
    return P.label_depths(part_tree(spark, d), 6)


@query("SELECT e.label, n.type AS to_type, n.realm, count(*) AS n FROM bare e LEFT JOIN nodes n ON e.to_id = n.id GROUP BY 1, 2, 3")
def edges_with_targets(spark, d):
    ends = G.nodes(spark, d).select(F.col("id").alias("to_id"), F.col("type").alias("to_type"), "realm")
    return G.bare_edges(spark, d).join(ends, "to_id", "left").groupBy("label", "to_type", "realm").agg(F.count("*").alias("n"))


_REVERSES = ", ".join(f"('{k.upper()}', '{v[0]}')" for k, v in G.LABELS.items())


@query(f"SELECT e.label, coalesce(r.reverse, '') AS reverse, count(*) AS n FROM bare e LEFT JOIN (VALUES {_REVERSES}) r(label, reverse) ON lower(e.label) = lower(r.label) GROUP BY 1, 2")
def label_reverses(spark, d):
    r = spark.createDataFrame([(k.upper(), v[0]) for k, v in G.LABELS.items()], "l string, reverse string")
    e = G.bare_edges(spark, d)
    return e.join(F.broadcast(r), F.lower("label") == F.lower("l"), "left").groupBy("label", F.coalesce("reverse", F.lit("")).alias("reverse")).agg(F.count("*").alias("n"))  # as many rows as declared labels


@query("SELECT label, count(*) AS n FROM bare WHERE from_id IN (SELECT id FROM nodes WHERE realm = 'Real') GROUP BY 1")
def labels_of_realm(spark, d):
    real = G.nodes(spark, d).where("realm = 'Real'").select(F.col("id").alias("from_id"))
    edges = G.bare_edges(spark, d).select("from_id", "label").repartition(2 * G.parts(spark, d), "from_id")  # as many rows a task at any size
    return edges.join(real, "from_id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT e.label, coalesce(f.realm, 'Unknown') AS from_realm, coalesce(t.realm, 'Unknown') AS to_realm, count(*) AS n FROM bare e LEFT JOIN nodes f ON e.from_id = f.id LEFT JOIN nodes t ON e.to_id = t.id GROUP BY 1, 2, 3")
def realm_backfill(spark, d):
    e = G.edges(spark, d)
    return e.groupBy("label", F.coalesce("from_realm", F.lit("Unknown")).alias("from_realm"), F.coalesce("to_realm", F.lit("Unknown")).alias("to_realm")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", graph=False)
def not_yet_processed(spark, d):
    return table(spark, d, "customer", "c_custkey").join(table(spark, d, "orders", F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"))


@query("""SELECT p_partkey + 5000000000 AS id, 'Brand=' || CASE WHEN length(p_brand) > 6 THEN substr(p_brand, 1, 6) || '…' ELSE p_brand END || ';Kind=' || CASE WHEN length(k) > 6 THEN substr(k, 1, 6) || '…' ELSE k END || ';Words=' || CASE WHEN length(w) > 6 THEN substr(w, 1, 6) || '…' ELSE w END AS info
FROM (SELECT *, string_split(p_type, ' ')[1] AS k, string_split(p_name, ' ')[1] AS w FROM part)""", graph=False)
def node_properties_batch(spark, d):
    """First values of up to 8 properties, by name, cut to a length."""
    short = lambda x: F.when(F.length(x) > 6, F.concat(F.substring(x, 1, 6), F.lit("…"))).otherwise(x)
    n = G.nodes(spark, d).where("type = 'Part'")
    entries = F.slice(F.array_sort(F.map_entries("properties")), 1, 8)
    return n.select("id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e.key, short(F.element_at(e.value, 1)))), ";").alias("info"))


@query("""SELECT y.year::INT AS year, count(o_orderkey) AS active FROM range(1995, 2002) y(year) LEFT JOIN (SELECT o_orderkey, year(o_orderdate) AS s, last AS e FROM orders LEFT JOIN shipped ON o_orderkey = l_orderkey) o ON o.s <= y.year AND (o.e IS NULL OR y.year <= o.e) GROUP BY 1""")
def active_by_year(spark, d):
    """An interval join made an equi-join: an order is alive in every year of its life, those without an end to the last asked."""
    years = spark.range(1995, 2002).select(F.col("id").cast("int").alias("year"))
    life = G.nodes(spark, d).where("type = 'Order'").select(F.explode(F.sequence(F.greatest("start_year", F.lit(1995)), F.greatest(F.least(F.coalesce("end_year", F.lit(2001)), F.lit(2001)), F.greatest("start_year", F.lit(1995))))).alias("year"), "start_year", "end_year")
    counts = life.where((F.col("start_year") <= F.col("year")) & (F.col("end_year").isNull() | (F.col("year") <= F.col("end_year")))).groupBy("year").agg(F.count("*").alias("active"))
    return years.join(counts, "year", "left").select("year", F.coalesce("active", F.lit(0)).alias("active"))


@query("SELECT year, era FROM (SELECT y.year::INT AS year, e.era, row_number() OVER (PARTITION BY y.year ORDER BY e.first, e.era) AS rn FROM range(1990, 2003) y(year) JOIN (VALUES ('Dawn', 1990, 1996), ('Trade', 1995, 1999), ('Late', 1998, 2010)) e(era, first, last) ON y.year BETWEEN e.first AND e.last) WHERE rn = 1", graph=False)
def year_eras(spark, d):
    """The first era by start that a year is in."""
    eras = spark.createDataFrame([("Dawn", 1990, 1996), ("Trade", 1995, 1999), ("Late", 1998, 2010)], "era string, first int, last int")
    years = spark.range(1990, 2003).select(F.col("id").cast("int").alias("year"))
    inside = years.join(F.broadcast(eras), F.col("year").between(F.col("first"), F.col("last")))  # a fixed list of eras
    return inside.groupBy("year").agg(F.min_by("era", F.struct("first", "era")).alias("era"))


@query("""SELECT o_orderkey AS route, string_agg(grid, '>' ORDER BY l_linenumber, l_suppkey) AS cells FROM (
  SELECT *, lag(grid) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey) AS before FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, l_suppkey, grid FROM lineitem JOIN cells ON cells.id = l_suppkey + 4000000000))
WHERE before IS NULL OR before <> grid GROUP BY 1 HAVING count(*) >= 2""")
def trade_routes(spark, d):
    """Waypoints in order, without repeated cells in a row; routes of two points or more."""
    from pyspark.sql.window import Window

    way = table(spark, d, "lineitem", F.col("l_orderkey").alias("route"), "l_linenumber", (F.col("l_suppkey") + 4 * B).alias("id")).join(G.cells(spark, d).select("id", "grid"), "id")
    w = Window.partitionBy("route").orderBy("l_linenumber", "id")
    steps = way.withColumn("before", F.lag("grid").over(w)).where("before IS NULL OR before <> grid")
    routes = steps.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "id", "grid"))).alias("p")).where(F.size("p") >= 2)
    return routes.select("route", F.array_join(F.transform("p", lambda x: x.grid), ">").alias("cells"))


@query("""SELECT from_id, to_id, label, weight, from_year, to_year FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, label ORDER BY from_year IS NULL, meta IS NULL, weight DESC, from_year, to_year) AS rn FROM (
  SELECT from_id, to_id, label, weight, from_year, to_year, NULL AS meta FROM bare UNION ALL SELECT from_id, to_id, label, weight / 2, NULL, to_year, 'm' FROM bare WHERE from_id % 3 = 0)) WHERE rn = 1""")
def dedup_edges(spark, d):
    e = G.bare_edges(spark, d).select("from_id", "to_id", "label", "weight", "from_year", "to_year")
    twice = e.where("from_id % 3 = 0").withColumns({"weight": F.col("weight") / 2, "from_year": F.lit(None).cast("int"), "meta": F.lit("m")})
    return P.dedup_edges(e.withColumn("meta", F.lit(None).cast("string")).unionByName(twice)).drop("meta")


@query("""SELECT * FROM (WITH life AS (SELECT id, start_year, end_year FROM nodes WHERE start_year IS NOT NULL), ends AS (
  SELECT b.label, b.to_year AS own, f.start_year AS fs, f.end_year AS fe, t.start_year AS ts, t.end_year AS te
  FROM bare b LEFT JOIN life f ON b.from_id = f.id LEFT JOIN life t ON b.to_id = t.id), cases AS (
  SELECT label, own, CASE
      WHEN fs IS NOT NULL AND ts IS NOT NULL THEN CASE WHEN least(fe, te) IS NULL OR greatest(fs, ts) <= least(fe, te) THEN 'both' ELSE 'none' END
      WHEN fs IS NOT NULL THEN 'source' WHEN ts IS NOT NULL THEN 'target' ELSE 'none' END AS how, fs, fe, ts, te FROM ends)
SELECT label, CASE how WHEN 'both' THEN greatest(fs, ts) WHEN 'source' THEN fs WHEN 'target' THEN ts END AS from_year,
  CASE how WHEN 'both' THEN least(fe, te) WHEN 'source' THEN fe WHEN 'target' THEN te ELSE own END AS to_year, count(*) AS n FROM cases GROUP BY 1, 2, 3)""")
def derived_bounds(spark, d):
    bare = G.bare_edges(spark, d).withColumn("from_year", F.lit(None).cast("int"))
    return P.derive_bounds(bare, G.nodes(spark, d)).groupBy("label", "from_year", "to_year").agg(F.count("*").alias("n"))


@query("SELECT label, from_type, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, from_type) AS rn FROM (SELECT label, from_type, count(*) AS n FROM edges GROUP BY 1, 2)) WHERE rn <= 5")
def first_types_by_label(spark, d):
    each = G.edges(spark, d).groupBy("label", "from_type").agg(F.count("*").alias("n"))
    return A.first_by_group(each, ["label"], [F.desc("n"), "from_type"], 5).drop("rn")


@query("SELECT DISTINCT o_orderpriority, coalesce(array_position(['2-HIGH', '1-URGENT'], o_orderpriority), 99) AS place FROM orders ORDER BY 2, 1", graph=False)
def priority_order(spark, d):
    place = F.array_position(F.array(F.lit("2-HIGH"), F.lit("1-URGENT")), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderpriority", F.when(place == 0, 99).otherwise(place).cast("int").alias("place")).distinct().orderBy("place", "o_orderpriority")


@query("SELECT year FROM (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders) ORDER BY abs(year - 1997), year LIMIT 5", graph=False)
def nearest_years(spark, d):
    years = table(spark, d, "orders", F.year("o_orderdate").alias("year")).distinct()
    return years.orderBy(F.abs(F.col("year") - 1997), "year").limit(5)


@query("SELECT o_orderkey AS id, sum(l_quantity)::DOUBLE AS links FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", graph=False)
def link_count_priority(spark, d):
    """Orders by a sum over a nested array, as pages by their links."""
    nested = table(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("data"))
    links = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return nested.select(F.col("l_orderkey").alias("id"), links.alias("links")).orderBy(F.desc("links"), "id").limit(10)


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40", graph=False)
def sorted_page(spark, d):
    allowed = {"price": F.col("o_totalprice"), "date": F.col("o_orderdate")}
    return table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderdate").orderBy(allowed["price"].desc(), "o_orderkey").offset(40).limit(20)


@query("SELECT c_name AS name, s_nationkey AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT n_nationkey, n_name AS c_name FROM nation) n JOIN (SELECT coalesce(a.k, b.k) AS s_nationkey, c, s FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON a.k = b.k) m ON n.n_nationkey = m.s_nationkey", graph=False)
def totals_full_outer(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    both = a.join(b, "nation", "full_outer").join(table(spark, d, "nation"), F.col("nation") == F.col("n_nationkey"))
    return both.select(F.col("n_name").alias("name"), "nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_timeline FROM customer", graph=False)
def characters_with_timelines(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("there")).distinct()
    return table(spark, d, "customer", "c_custkey").join(big, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("there").isNotNull().alias("has_timeline"))


@query("""SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY 1, 2""", graph=False)
def distinct_keep_first(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))


@query("""SELECT a.label AS label, b.label AS other, round(len(list_intersect(list_distinct(string_split(a.label, '')), list_distinct(string_split(b.label, '')))) / len(list_distinct(string_split(a.label || b.label, ''))), 6) AS jaccard
FROM (SELECT DISTINCT label FROM bare) a JOIN (SELECT DISTINCT label FROM bare) b ON a.label < b.label""")
def character_jaccard(spark, d):
    """Similarity of label texts by their characters; labels are a registry of bounded size."""
    a = G.bare_edges(spark, d).select("label").distinct()
    b = a.select(F.col("label").alias("other"))
    chars = lambda c: F.array_distinct(F.split(c, ""))
    j = F.size(F.array_intersect(chars("label"), chars("other"))) / F.size(F.array_union(chars("label"), chars("other")))
    return a.join(b, F.col("label") < F.col("other")).select("label", "other", F.round(j, 6).alias("jaccard"))


@query("SELECT (floor((year(o_orderdate) - 1998) / 3.0) * 3)::INT AS bucket, count(*) AS n, min(CASE WHEN year(o_orderdate) - 1998 <= 0 THEN abs(year(o_orderdate) - 1998) || ' BBY' ELSE (year(o_orderdate) - 1998) || ' ABY' END) AS mart, min(CASE WHEN year(o_orderdate) = 1998 THEN '0 BBY/ABY' WHEN year(o_orderdate) < 1998 THEN abs(year(o_orderdate) - 1998) || ' BBY' ELSE (year(o_orderdate) - 1998) || ' ABY' END) AS shown FROM orders GROUP BY 1", graph=False)
def year_buckets(spark, d):
    rows = table(spark, d, "orders", (F.year("o_orderdate") - 1998).alias("y"))
    y = F.col("y")
    return rows.groupBy(timecal.bucket(y, 3).alias("bucket")).agg(F.count("*").alias("n"), F.min(timecal.mart_display(y)).alias("mart"), F.min(timecal.analytics_display(y)).alias("shown"))
