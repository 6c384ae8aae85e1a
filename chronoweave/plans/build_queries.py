"""Queries over graph construction, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecal
from ..operators import build as E
from ..operators import graph as P
from ..sources import testgraph as G
from ..sources.tables import table
from .catalog import query

RULES = E.Rules(
    temporal={"Placed": ("lifespan.start", "auto", False), "Span": ("usage", "galactic", True)},
    properties={"Status"},
    relations={"Customer": ("placed_by", "placed_order", 1.0, ("Customer",))},
    whitelist={"Order": {"Placed", "Span", "Status", "Customer"}},
)


def order_pages(spark, d):
    """Orders and customers as pages with infoboxes."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    field = lambda label, values, links=None: F.struct(F.lit(label).alias("Label"), values.alias("Values"), (links if links is not None else F.array().cast("array<struct<Content:string,Href:string>>")).alias("Links"))
    link = lambda text, href: F.array(F.struct(text.alias("Content"), href.alias("Href")))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    y = F.year("o_orderdate") - 1998
    span = F.concat(F.abs(y - 3), F.when(y - 3 < 0, " BBY").otherwise(" ABY"), F.lit(" – "), F.abs(y), F.when(y < 0, " BBY").otherwise(" ABY"))
    data = F.array(
        field("Placed", F.array(F.concat(F.lit("May "), F.year("o_orderdate")))),
        field("Span", F.array(span)),
        field("Status", F.array("o_orderstatus")),
        field("Customer", F.array(F.concat(name, F.lit(" (19 BBY–4 ABY, once)"))), link(name, F.concat(F.lit("https://example.org/wiki/"), F.replace(name, F.lit("#"), F.lit("%23"))))),
        field("PriceTag(s)", F.array(F.col("o_orderpriority"))),
        field("Home port", F.array(F.lit("none of these")), link(F.lit("other"), F.lit("https://example.org/wiki/Nowhere"))),
    )
    box = lambda template, fields: F.struct(F.lit(template).alias("Template"), F.lit(None).cast("string").alias("ImageUrl"), fields.alias("Data")).cast(E.INFOBOX)
    orders = o.select((F.col("o_orderkey") + 6 * G.BASE).alias("pageId"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.concat(F.lit("https://example.org/wiki/Order_"), "o_orderkey").alias("wikiUrl"), F.lit("Canon").alias("continuity"), box("https://example.org/wiki/Template:Order", data).alias("infobox"))
    people = c.select((F.col("c_custkey") + 3 * G.BASE).alias("pageId"), F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("title"), F.lit(None).cast("string").alias("wikiUrl"), F.lit("Canon").alias("continuity"), F.lit(None).cast(E.INFOBOX).alias("infobox"))
    return orders.unionByName(people)


@query("SELECT kind, field, count(*) AS n FROM orders CROSS JOIN (VALUES ('temporal', 'Placed'), ('temporal', 'Span'), ('property', 'Status'), ('relation', 'Customer'), ('property', 'PriceTag(s)'), ('fallback', 'Home port')) AS f(kind, field) GROUP BY 1, 2", graph=False)
def field_classes(spark, d):
    return E.fields(order_pages(spark, d), RULES).groupBy("kind", "field").agg(F.count("*").alias("n"))


@query("""WITH y AS (SELECT o_orderkey + 6000000000 AS id, year(o_orderdate) - 1998 AS y FROM orders)
SELECT semantic, calendar, year::INT AS year, "order"::INT AS "order", count(*) AS n FROM (
  SELECT 'lifespan.start' AS semantic, 'real' AS calendar, y + 1998 AS year, 0 AS "order" FROM y UNION ALL SELECT 'usage.start', 'galactic', y - 3, 0 FROM y UNION ALL SELECT 'usage.end', 'galactic', y, 1 FROM y) GROUP BY 1, 2, 3, 4""", graph=False)
def temporal_facets(spark, d):
    f = E.facets(E.fields(order_pages(spark, d), RULES), RULES)
    return f.groupBy("semantic", "calendar", "year", "order").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey + 6000000000 AS id, least(year(o_orderdate), year(o_orderdate) - 2001)::INT AS start_year, (year(o_orderdate) - 1998)::INT AS end_year FROM orders", graph=False)
def facet_envelopes(spark, d):
    f = E.facets(E.fields(order_pages(spark, d), RULES), RULES)
    return timecal.envelope(f).select("id", "start_year", "end_year")


@query("""SELECT o_orderkey + 6000000000 AS from_id, o_custkey + 3000000000 AS to_id, 'placed_by' AS label, 1.0::DOUBLE AS weight, '19 BBY–4 ABY, once' AS qualifier, -19 AS from_year, 4 AS to_year FROM orders JOIN customer ON o_custkey = c_custkey""", graph=False)
def infobox_edges(spark, d):
    pages = order_pages(spark, d)
    made = E.edges(E.fields(pages, RULES), pages, RULES)
    return made.select("from_id", "to_id", "label", "weight", "qualifier", "from_year", "to_year")


@query("SELECT label, count(*) AS n FROM edges WHERE NOT (label = 'in_nation' AND to_type = 'Nation') AND to_type NOT IN ('Region') GROUP BY 1")
def noise_filter(spark, d):
    kinds = {"Nation": "TitleOrPosition", "Region": "Era"}
    types = G.nodes(spark, d).select("id", F.coalesce(*[F.when(F.col("type") == k, v) for k, v in kinds.items()], "type").alias("type"))
    return E.drop_noise(G.bare_edges(spark, d), types, {"in_nation"}).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT p_type AS raw, lower(replace(regexp_replace(p_type, '([^A-Z ])([A-Z])', '\\1_\\2', 'g'), ' ', '_')) AS label FROM (SELECT DISTINCT lower(p_type) AS p_type FROM part)", graph=False)
def snake_case_labels(spark, d):
    rows = table(spark, d, "part").select(F.lower("p_type").alias("raw")).distinct()
    return rows.select("raw", E.snake_case(F.col("raw")).alias("label"))


@query("SELECT l_orderkey + 6000000000 AS id, 'supplied_byIds' AS key, string_agg(l_suppkey + 4000000000, ',' ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem GROUP BY 1", graph=False)
def ordered_routes(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") + 6 * G.BASE).alias("from_id"), (F.col("l_suppkey") + 4 * G.BASE).alias("to_id"), F.lit("supplied_by").alias("label"), F.col("l_linenumber").alias("order"))
    return E.ordered_ids(rows, ["supplied_by"]).select("id", "key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'added' WHEN doc_id % 9 = 2 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 9 IN (0, 1, 2)", graph=False)
def content_changes(spark, d):
    """Changes between two states of the documents, by content hashes."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    old = docs.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 9 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return E.changed(docs.where("doc_id % 9 <> 2"), old, "doc_id", "text", "lang")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT -c_custkey, 0 FROM customer WHERE c_custkey % 10 = 0", graph=False)
def upsert_rows(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = old.where("id % 2 = 0").withColumn("balance", F.col("balance") + 1).unionByName(old.where("id % 10 = 0").select((-F.col("id")).alias("id"), F.lit(0.0).alias("balance")))
    return E.upsert(old, new, "id")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'kept' ELSE n_name END AS name, n_regionkey AS region FROM nation", graph=False)
def merge_keeping_texts(spark, d):
    new = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    old = new.select("id", F.when(F.col("id") % 3 == 0, "kept").otherwise("").alias("name"))
    return E.merge_keeping(old, new, "id", ["name"])


@query("SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE THEN 'Pending' WHEN event_type = 'click' THEN 'Processing' ELSE 'Completed' END AS status FROM events", graph=False)
def release_stale(spark, d):
    rows = table(spark, d, "events", "event_id", F.when(F.col("event_type") == "click", "Processing").otherwise("Completed").alias("status"), F.col("ts").alias("processed_at"))
    return E.release_stale(rows, F.lit("2024-01-20 00:00:00").cast("timestamp").cast(rows.schema["processed_at"].dataType)).select("event_id", "status")


@query()
def batch_export(spark, d):
    """Documents as JSON lines in batches by size and number."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    lines = docs.select("doc_id", F.to_json(F.struct("doc_id", "text", "lang")).alias("line"))
    return E.export_batches(lines, "doc_id", "line", 100_000, 20).groupBy("batch").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, false AS broken FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT NULL, NULL, true FROM events WHERE event_id % 10 = 0", graph=False)
def result_import(spark, d):
    """JSON lines back as rows; broken lines go their own way."""
    e = table(spark, d, "events")
    lines = e.select(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "props": '), "props", F.lit("}"))).alias("value"))
    rows, bad = E.import_lines(lines, "event_id long, props struct<k:long>")
    return rows.select("event_id", "props.k", F.lit(False).alias("broken")).unionByName(bad.select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("k"), F.lit(True).alias("broken")))


@query("""SELECT from_id, to_id, label FROM (SELECT from_id, to_id, label FROM bare WHERE label = 'in_nation' AND from_id % 2 = 0 UNION SELECT to_id, from_id, reverse_label FROM bare WHERE label = 'in_nation' AND from_id % 2 = 0)""")
def store_offered_edges(spark, d):
    e = G.bare_edges(spark, d).where("label = 'in_nation'").select("from_id", "to_id", "label", "reverse_label", "weight")
    loops = e.select("from_id", F.col("from_id").alias("to_id"), "label", "reverse_label", "weight")
    offered = e.unionByName(e.withColumn("label", F.lit(" In Nation "))).unionByName(loops)
    return E.store_edges(e.where("from_id % 2 = 1"), offered).select("from_id", "to_id", "label")


@query("""SELECT * FROM (WITH own AS (SELECT DISTINCT label, 'in_nation' AS want FROM bare WHERE label LIKE 'in%'),
stems AS (SELECT label, want, replace(replace(rtrim(label, 's'), '_of', ''), '_by', '') AS a, replace(replace(rtrim(want, 's'), '_of', ''), '_by', '') AS b,
  list_distinct(string_split(label, '')) AS x, list_distinct(string_split(want, '')) AS y FROM own),
scored AS (SELECT label, CASE WHEN label = want THEN 1.0 WHEN contains(label, want) OR contains(want, label) THEN 0.8 WHEN a = b THEN 0.7 WHEN contains(a, b) OR contains(b, a) THEN 0.5
  ELSE 0.4 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END::DOUBLE AS score FROM stems)
SELECT label, round(score, 6) AS score FROM scored WHERE round(score, 6) > 0.3 ORDER BY score DESC, label LIMIT 5)""")
def similar_labels(spark, d):
    labels = G.bare_edges(spark, d).select("label").distinct().where("label LIKE 'in%'")
    return E.label_similarity(labels, "IN_NATION")


@query("SELECT template, count(*) AS n FROM timeline GROUP BY 1")
def template_views(spark, d):
    """One view for each category; here all are counted."""
    t = G.timeline(spark, d)
    names = [r.template for r in t.select("template").distinct().collect()]  # categories are a small registry
    for name in names:
        t.where(F.col("template") == name).createOrReplaceTempView(f"timeline_{name}")
    counts = [spark.table(f"timeline_{n}").agg(F.lit(n).alias("template"), F.count("*").alias("n")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT id, type, name FROM nodes WHERE type = 'Nation'")
def projected_scan(spark, d):
    return G.nodes(spark, d).where("type = 'Nation'").select("id", "type", "name")


@query("SELECT from_id AS id, count(*) AS n FROM edges WHERE label = 'contains' GROUP BY 1 HAVING count(*) >= 5")
def staged_swap(spark, d):
    """Written to a staging table, verified, then read as the result."""
    made = G.bare_edges(spark, d).where("label = 'contains'").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 5")
    staged = P.kept(made, "staged")
    if staged.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a key is there twice")
    return staged
