"""Queries over workflows, publication, paged sources, indexes, interval joins, crawl states, discovery and rates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import characters as C
from ..operators import discovery as D
from ..operators import graph as P
from ..operators import intervals, pages, textindex, vectors
from ..sources import pages as wiki
from ..sources import paging, publish, sinks
from ..sources import testgraph as G
from ..sources.tables import table
from ..streaming import crawl
from ..streaming.workflow import Workflow
from ._texts import WORD_COUNTS, documents, probe
from .catalog import query


def _own(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{P.shared(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) > 1000) AS long FROM documents GROUP BY 1", graph=False)
def resumable_extraction(spark, d):
    """Documents measured in eight batches by a workflow that is stopped at the fourth and started again, then summed by source."""
    folder, asked = _own(spark, "workflows"), []

    def measure(rows):
        asked.append(rows)
        if len(asked) == 4:
            raise InterruptedError("stopped at the fourth batch")
        return rows.select("doc_id", "source", F.length("text").alias("chars"))

    docs = lambda: table(spark, d, "documents", "doc_id", "source", "text")
    try:
        Workflow(spark, folder, "measure").run("documents", docs, "doc_id", 8, measure, pass_over=False)
    except InterruptedError:
        pass
    flow = Workflow(spark, folder, "measure")
    measured = flow.run("documents", docs, "doc_id", 8, measure, pass_over=False)
    sums = flow.run("sources", lambda: measured, "source", 2, lambda rows: rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.count_if(F.col("chars") > 1000).alias("long")))
    return sums


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS price, (SELECT count(*) FROM orders) AS orders FROM orders GROUP BY 1", graph=False)
def published_mart(spark, d):
    """Orders by year with their overview, published twice; the first version has half of the orders."""
    path, orders = _own(spark, "mart"), table(spark, d, "orders", "o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    for part in (orders.where("o_orderkey % 2 = 0"), orders):
        rows = part.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
        sinks.replace_mart(rows, part.agg(F.count("*").alias("orders")), path)
    mart = publish.current(spark, path)
    return mart.table("rows").join(F.broadcast(mart.table("overview")))  # one row


@query("SELECT from_id, to_id, label, round(max(weight), 6) AS weight FROM edges GROUP BY 1, 2, 3")
def swapped_edges(spark, d):
    """Edges made anew without repeats, verified, then put in the place of the old ones, from which they are made."""
    path, edges = _own(spark, "edges"), G.bare_edges(spark, d).select("from_id", "to_id", "label", "weight")
    publish.publish({"rows": edges.unionByName(edges.where("label = 'contains'"))}, path)
    old = publish.current(spark, path).table("rows").repartition(2 * G.parts(spark, d), "from_id", "to_id")  # as many rows a task at any size
    return sinks.swap(old.groupBy("from_id", "to_id", "label").agg(F.round(F.max("weight"), 6).alias("weight")), path, ["from_id", "to_id", "label"]).table("rows")


@query("SELECT page_id, url FROM pages", graph=False)
def paged_listing(spark, d):
    """Pages read by a stream over a listing of 100 to a page, five listing pages a batch, stopped once on the way."""
    rows = table(spark, d, "pages", "page_id", "url").withColumn("page", F.floor(F.col("page_id") / 100))
    folder, out = _own(spark, "listing"), _own(spark, "paged")
    rows.repartition("page").write.partitionBy("page").parquet(folder)
    last = spark.read.parquet(folder).agg(F.max("page")).first()[0]
    if last is None:
        return rows.drop("page")
    listing = paging.TableListing(folder, int(last), ["page_id", "url"])
    for whole in (False, True):
        made = paging.paged(spark, listing, "page_id long, url string", 5)
        stream = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(processingTime="0 seconds").start()
        while not whole and stream.isActive and not stream.lastProgress:
            stream.awaitTermination(0.1)
        if whole:
            stream.processAllAvailable()
        stream.stop()
    return spark.read.parquet(out)


def _index(spark, d):
    """The inverted index of documents, made once for a folder and its file as it now is."""
    state = publish.Files(spark).state(f"{d}/documents.parquet")
    path = f"{P.shared(spark)}/text-index-{uuid.uuid5(uuid.NAMESPACE_URL, repr((d, state))).hex}"
    if not publish.current(spark, path):
        own = f"{path}/{uuid.uuid4().hex}"
        textindex.build(documents(spark, d), own)
        publish.Files(spark).put(f"{path}/{publish.POINTER}", {"version": own.rpartition("/")[2], "tables": []}, over=True)
    return f"{path}/{publish.current(spark, path).version}"


@query(f"SELECT id, round(raw / max(raw) OVER (), 6) AS score, substr(text, 1, 300) AS snippet FROM (SELECT * FROM {WORD_COUNTS} WHERE raw > 0 ORDER BY raw DESC, id LIMIT 15)", graph=False)
def indexed_keyword_search(spark, d):
    return textindex.keyword_search(documents(spark, d), _index(spark, d), "with FROM", 15)


@query("SELECT doc_id AS id, 0.0::DOUBLE AS score, substr(text, 1, 300) AS snippet FROM documents WHERE contains(lower('Page ' || doc_id), 'pag') ORDER BY 'Page ' || doc_id, doc_id LIMIT 10", graph=False)
def indexed_search_fallback(spark, d):
    return textindex.text_search(documents(spark, d), _index(spark, d), "pag", 10)


@query()
def filtered_vector_search(spark, d):
    """About the 10 nearest of label 1 to 3; tests hold its recall against the scan."""
    path = _own(spark, "vectors")
    vectors.build(table(spark, d, "embeddings", F.col("vec_id").alias("id"), "label", "embedding"), path, "embedding", ["label"])
    return vectors.search(spark, path, probe(spark, d), 10, F.col("label").isin(1, 2, 3)).select("id", "label", "score")


@query("""SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS open, round(sum(o_totalprice), 2) AS price FROM (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem)
JOIN (SELECT o_orderkey, any_value(o_orderdate)::DATE AS first, CASE WHEN o_orderkey % 50 <> 0 THEN max(l_shipdate)::DATE END AS last, any_value(o_totalprice) AS o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) o
ON day >= first AND (last IS NULL OR day <= last) GROUP BY 1""", graph=False)
def orders_open_by_day(spark, d):
    """Days and the orders open on them, from their date to their last item's; every fiftieth stays open for good."""
    number = lambda c: F.unix_date(F.col(c).cast("date"))
    days = table(spark, d, "lineitem", number("l_shipdate").alias("day")).distinct()
    shipped = table(spark, d, "lineitem", "l_orderkey", number("l_shipdate").alias("last")).groupBy("l_orderkey").agg(F.max("last").alias("last"))
    orders = table(spark, d, "orders", F.col("o_orderkey").alias("l_orderkey"), number("o_orderdate").alias("first"), "o_totalprice").join(shipped, "l_orderkey")
    spans = orders.withColumn("last", F.when(F.col("l_orderkey") % 50 != 0, F.col("last")))
    hits = intervals.sums_at_points(days, spans.select("first", "last", F.lit(1).alias("open"), "o_totalprice"), "day", "first", "last", ["open", "o_totalprice"])
    return hits.select(F.date_from_unix_date("day").cast("string").alias("day"), "open", F.round("o_totalprice", 2).alias("price"))


_YEARS = "(SELECT DISTINCT start_year AS year FROM nodes WHERE start_year IS NOT NULL UNION SELECT DISTINCT end_year FROM nodes WHERE end_year IS NOT NULL)"


def _years(spark, d):
    nodes = G.nodes(spark, d)
    return nodes.select(F.col("start_year").alias("year")).unionByName(nodes.select(F.col("end_year").alias("year"))).where("year IS NOT NULL").distinct()


@query(f"SELECT year, count(*) AS nodes, min(id) AS first_id, max(id) AS last_id FROM {_YEARS} JOIN nodes ON start_year <= year AND (end_year IS NULL OR year <= end_year) GROUP BY 1")
def governments_by_year(spark, d):
    """In each year, which nodes' lives hold it."""
    hits = intervals.governments_in(_years(spark, d), G.nodes(spark, d))
    return hits.groupBy("year").agg(F.count("*").alias("nodes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"SELECT year, label, count(*) AS edges FROM {_YEARS} JOIN edges ON (from_year IS NULL OR from_year <= year) AND (to_year IS NULL OR year <= to_year) WHERE label IN ('placed_by', 'in_region') GROUP BY 1, 2")
def affiliations_by_year(spark, d):
    """In each year, the relations that hold; some have no bounds, some an open end."""
    edges = G.bare_edges(spark, d).where(F.col("label").isin("placed_by", "in_region"))
    hits = intervals.affiliations_in(_years(spark, d), edges)
    return hits.join(edges.select("from_id", "to_id", "label"), ["from_id", "to_id"]).groupBy("year", "label").agg(F.count("*").alias("edges"))


_LEASE = 3000
_KIND = "CASE event_id % 6 WHEN 0 THEN 'claim' WHEN 1 THEN 'claim' WHEN 2 THEN 'done' WHEN 3 THEN 'release' WHEN 4 THEN 'failed' ELSE 'skipped' END"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id * 40 + event_id % 40 AS page, epoch_us(ts) AS stamp, {_KIND} AS kind, event_id // 40 % 2 AS batch, row_number() OVER (PARTITION BY user_id * 40 + event_id % 40 ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT DISTINCT page, 0::BIGINT AS rn, 'Pending' AS status, NULL::BIGINT AS batch, 0::BIGINT AS since, 0::BIGINT AS changes, 0::BIGINT AS stale FROM e
UNION ALL SELECT page, rn, coalesce(new, was), CASE WHEN new IS NOT NULL THEN own ELSE batch END, CASE WHEN new = 'Processing' THEN stamp ELSE since END, changes + gone + CASE WHEN new IS NOT NULL THEN 1 ELSE 0 END, stale + gone FROM (
  SELECT *, CASE WHEN kind = 'claim' AND was = 'Pending' THEN 'Processing' WHEN was = 'Processing' AND batch = own THEN CASE kind WHEN 'done' THEN 'Completed' WHEN 'failed' THEN 'Failed' WHEN 'skipped' THEN 'Skipped' WHEN 'release' THEN 'Pending' END END AS new FROM (
    SELECT w.page, e.rn, w.batch, w.since, w.changes, w.stale, e.stamp, e.kind, e.batch AS own, CASE WHEN status = 'Processing' AND e.stamp > since + {_LEASE} * 60000000::BIGINT THEN 1 ELSE 0 END AS gone, CASE WHEN status = 'Processing' AND e.stamp > since + {_LEASE} * 60000000::BIGINT THEN 'Pending' ELSE status END AS was
    FROM w JOIN e ON w.page = e.page AND e.rn = w.rn + 1)))
SELECT page, CASE WHEN status = 'Processing' AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') > since + {_LEASE} * 60000000::BIGINT THEN 'Pending' ELSE status END AS status, batch, changes, stale
FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rn DESC) AS r FROM w) WHERE r = 1 AND changes > 0""",
    graph=False,
)
def crawl_states(spark, d):
    """Events as a log of claims and results; each page's last state and its changes, leases of 50 hours."""
    kinds = F.array(*[F.lit(k) for k in ("claim", "claim", "done", "release", "failed", "skipped")])
    events = table(spark, d, "events", (F.col("user_id") * 40 + F.col("event_id") % 40).alias("page"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("event"), F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("kind"), (F.floor(F.col("event_id") / 40) % 2).alias("batch"))
    changes = P.kept(crawl.replay(events, _LEASE), "changes")
    last = crawl.final(changes, F.lit("2024-01-31 00:00:00").cast("timestamp"), _LEASE)
    return last.join(changes.groupBy("page").agg(F.count("*").alias("changes"), F.count_if(F.col("why") == "stale").alias("stale")), "page").select("page", "status", "batch", "changes", "stale")


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query(
    f"""WITH c AS (SELECT user_id AS page, count(*) AS n, max(ts) AS last FROM events GROUP BY 1), r AS (SELECT CASE WHEN c_nationkey % 4 = 0 THEN 'Unknown' ELSE c_mktsegment END AS type, n, last FROM customer LEFT JOIN c ON page = c_custkey),
s AS (SELECT type, count(*) AS pages, count(n) AS chunked, coalesce(sum(n), 0)::BIGINT AS chunks, count(*) FILTER (last BETWEEN {_NOW} - INTERVAL 1 HOUR AND {_NOW}) AS per_hour FROM r GROUP BY ROLLUP (type))
SELECT type, pages, chunked, pages - chunked AS pending, chunks, CASE WHEN chunked > 0 THEN round(chunks / chunked, 1) ELSE 0 END AS avg_chunks, per_hour, CASE WHEN per_hour > 0 THEN round((pages - chunked) / per_hour, 1) END AS hours_left FROM s""",
    graph=False,
)
def chunk_rates(spark, d):
    """Customers as pages and events as their chunks, at a given time."""
    made = table(spark, d, "customer", F.col("c_custkey").alias("page"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")).alias("type"))
    chunks = table(spark, d, "events", F.col("user_id").alias("page"), F.col("ts").cast("timestamp").alias("created_at")).where("created_at IS NOT NULL")
    return A.chunk_rates(made, chunks, F.lit("2024-01-15 00:00:00").cast("timestamp"))


@query(
    f"""WITH s AS (SELECT p_brand AS type, count(*) AS total, count(*) FILTER (p_size % 5 = 0) AS processed, count(*) FILTER (p_size % 5 = 1) AS skipped, count(*) FILTER (p_size % 5 = 2) AS failed FROM part GROUP BY ROLLUP (p_brand)),
b AS (SELECT sum(event_id % 7 + 1) AS n, date_diff('microsecond', min(ts - INTERVAL 90 MINUTE), {_NOW}) / 3.6e9 AS hours FROM events WHERE event_type <> 'error' AND ts BETWEEN {_NOW} - INTERVAL 24 HOUR AND {_NOW}),
r AS (SELECT coalesce(CASE WHEN hours > 0 THEN round(n / hours, 0) END, 0)::DOUBLE AS per_hour FROM b)
SELECT type, total, processed, skipped, failed, total - processed - skipped - failed AS pending, per_hour, CASE WHEN per_hour > 0 THEN round((total - processed - skipped - failed) / per_hour, 1) END AS hours_left FROM s, r""",
    graph=False,
)
def builder_rates(spark, d):
    """Parts as pages with states, events as batches, at a given time."""
    made = table(spark, d, "part", F.col("p_partkey").alias("page"), F.col("p_brand").alias("type"))
    names = F.array(*[F.lit(x) for x in ("Completed", "Skipped", "Failed", "Processing", "Processing")])
    states = table(spark, d, "part", F.col("p_partkey").alias("page"), F.get(names, (F.col("p_size") % 5).cast("int")).alias("status"))
    batches = table(spark, d, "events", F.col("ts").cast("timestamp").alias("processed_at"), F.when(F.col("event_type") != "error", "Processed").otherwise("Failed").alias("status"), (F.col("event_id") % 7).alias("completed"), F.lit(1).alias("skipped"))
    return A.builder_rates(made, states, batches.withColumn("created_at", F.expr("processed_at - INTERVAL 90 MINUTES")), F.lit("2024-01-15 00:00:00").cast("timestamp"))


def _hops(root: int, depth: int, per_hop: int, cap: int) -> str:
    """The statement of query_graph as SQL, hop after hop."""
    parts = [f"v0 AS (SELECT {root}::BIGINT AS id, 0 AS depth)"]
    for h in range(1, depth + 1):
        front = f"(SELECT id FROM v{h - 1} WHERE depth = {h - 1} AND (SELECT count(*) FROM v{h - 1}) < {cap})"
        parts.append(f"o{h} AS (SELECT from_id, to_id, label, weight, from_year, to_year FROM edges WHERE from_id IN {front} ORDER BY weight DESC, from_id, to_id, label LIMIT {per_hop})")
        parts.append(f"c{h} AS (SELECT * FROM edges WHERE to_id IN {front} ORDER BY weight DESC, from_id, to_id, label LIMIT {per_hop})")
        parts.append(f"s{h} AS (SELECT * FROM o{h} UNION ALL SELECT to_id, from_id, CASE WHEN reverse_label = '' THEN label ELSE reverse_label END, weight, from_year, to_year FROM c{h} WHERE from_id NOT IN {front})")
        parts.append(f"v{h} AS (SELECT * FROM (SELECT * FROM v{h - 1} UNION ALL SELECT DISTINCT to_id, {h} FROM s{h} WHERE to_id NOT IN (SELECT id FROM v{h - 1})) ORDER BY depth, id LIMIT {cap})")
    return ", ".join(parts)


@query(f", {_hops(1_000_000_000, 3, 200, 1000)} SELECT v.id, coalesce(n.name, '') AS name, n.type, v.depth FROM v3 v LEFT JOIN nodes n USING (id)")
def graph_three_hops(spark, d):
    """Nodes within three hops of a region, under the cap of a hop's edges."""
    return P.query_graph(G.nodes(spark, d), G.edges(spark, d), G.BASE, depth=3, max_nodes=1000).nodes


@query(f", {_hops(1_000_000_000, 4, 200, 50)}, s AS (SELECT DISTINCT from_id, to_id, label, weight FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)) SELECT from_id, to_id, string_agg(DISTINCT label, ' / ' ORDER BY label) AS label, round(max(weight), 6) AS weight, (SELECT count(*) FROM v4) AS nodes, true AS truncated FROM s WHERE from_id IN (SELECT id FROM v4) AND to_id IN (SELECT id FROM v4) GROUP BY 1, 2")
def graph_truncated(spark, d):
    """The edges of a graph whose cap of 50 nodes leaves some out."""
    found = P.query_graph(G.nodes(spark, d), G.edges(spark, d), G.BASE, depth=4, max_nodes=50)
    return found.edges.select("from_id", "to_id", "label", F.round("weight", 6).alias("weight"), F.lit(found.nodes.count()).cast("long").alias("nodes"), F.lit(found.truncated).alias("truncated"))


@query("SELECT id, name, wanted FROM nodes CROSS JOIN (VALUES ('Fiction'), ('Real'), ('Unknown')) w(wanted) WHERE id BETWEEN 2000000000 AND 2000000004 AND realm IN (wanted, 'Unknown')")
def graph_roots_by_realm(spark, d):
    """Five roots alone, each asked for in three realms: those of another realm find nothing."""
    nodes, edges, out = G.nodes(spark, d), G.edges(spark, d), None
    for root in range(2 * G.BASE, 2 * G.BASE + 5):
        for realm in ("Fiction", "Real", "Unknown"):
            got = P.query_graph(nodes, edges, root, realm=realm, only_root=True).nodes.select("id", "name", F.lit(realm).alias("wanted"))
            out = got if out is None else out.unionByName(got)
    return out


def _books(spark, d):
    """Suppliers and customers as pages that link to nations, and nations that link to some of them."""
    nodes = G.nodes(spark, d).where(F.col("type").isin("Nation", "Supplier", "Customer"))
    made = nodes.select("id", F.col("name").alias("title"), F.concat(F.lit("/wiki/"), "id").alias("url"), "continuity", F.lit("").alias("text"))
    edges = G.bare_edges(spark, d).where("label = 'in_nation'")
    href = lambda c: F.concat(F.lit("/wiki/"), c).alias("href")
    links = edges.select(F.col("from_id").alias("id"), href("to_id")).unionByName(edges.where("from_id % 3 = 0").select(F.col("to_id").alias("id"), href("from_id")))
    known = edges.where("from_id % 2 = 0").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.round(F.col("from_id") % 7 / 7, 6).alias("weight"), "continuity")
    return nodes, made, links, known


@query("""SELECT root, page, min(how) AS how FROM (
  SELECT id AS root, id AS page, '0' AS how FROM nodes WHERE type = 'Nation'
  UNION ALL SELECT root, page, '1' FROM (SELECT r.id AS root, p.id AS page, row_number() OVER (PARTITION BY r.id ORDER BY p.id) AS nth FROM nodes r JOIN edges e ON e.to_id = r.id AND e.label = 'in_nation' JOIN nodes p ON p.id = e.from_id WHERE r.type = 'Nation' AND (p.continuity IN ('Both', 'Unknown') OR r.continuity NOT IN ('Canon', 'Legends') OR p.continuity = r.continuity)) WHERE nth <= 20
  UNION ALL SELECT root, page, '2' FROM (SELECT r.id AS root, p.id AS page, row_number() OVER (PARTITION BY r.id ORDER BY p.id) AS nth FROM nodes r JOIN edges e ON e.to_id = r.id AND e.label = 'in_nation' AND e.from_id % 3 = 0 JOIN nodes p ON p.id = e.from_id WHERE r.type = 'Nation' AND (p.continuity IN ('Both', 'Unknown') OR r.continuity NOT IN ('Canon', 'Legends') OR p.continuity = r.continuity)) WHERE nth <= 20
  UNION ALL SELECT root, page, '3' FROM (SELECT r.id AS root, e.from_id AS page, row_number() OVER (PARTITION BY r.id ORDER BY round(e.from_id % 7 / 7, 6) DESC, e.from_id) AS nth FROM nodes r JOIN edges e ON e.to_id = r.id AND e.label = 'in_nation' AND e.from_id % 2 = 0 WHERE r.type = 'Nation' AND (e.continuity IN ('Both', 'Unknown') OR r.continuity NOT IN ('Canon', 'Legends') OR e.continuity = r.continuity)) WHERE nth <= 40)
GROUP BY 1, 2""")
def discovered_pages(spark, d):
    """The pages to read about each nation, by what found them first."""
    nodes, made, links, known = _books(spark, d)
    found = D.discover(nodes.where("type = 'Nation'").select("id"), made, links, known)
    order = F.create_map(*[F.lit(x) for k, v in enumerate(("self", "incoming", "outgoing", "graph")) for x in (v, str(k))])
    return found.select("root", "page", order[F.col("how")].alias("how"))


@query("""SELECT doc_id AS id, CASE WHEN length(text) > 8000 THEN md5(left(text, 8000) || chr(10) || '... [truncated]') ELSE md5(text) END AS digest FROM documents""", graph=False)
def prompt_contents(spark, d):
    """Every document as it is told to a model."""
    docs = table(spark, d, "documents", F.col("doc_id").alias("id"), F.concat(F.lit("/wiki/"), "doc_id").alias("url"), F.col("source").alias("title"), "text", F.lit("Both").alias("continuity"))
    none = docs.where(F.lit(False))
    told = D.page_content(docs, none.select("id", F.col("url").alias("href")), none.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.col("url").alias("label"), F.lit(1.0).alias("weight")))
    return told.select("id", F.md5("content").alias("digest"))


@query("SELECT source, doc_id AS page, length(text) AS year FROM documents WHERE source <> (SELECT max(source) FROM documents) AND length(text) % 2 = 0", graph=False)
def extracted_events(spark, d):
    """A given extractor over bundles of each source's documents; the last source's fail, the others are delivered."""
    docs = table(spark, d, "documents", "source", F.col("doc_id").alias("page"), "text")
    bad = docs.agg(F.max("source")).first()[0]

    def extractor(prompts):
        if prompts[0]["source"] == bad:
            raise RuntimeError("no answer")
        return [{"page": p["page"], "year": len(p["text"])} for p in prompts if len(p["text"]) % 2 == 0]

    bundled = pages.bundles(docs.where("text IS NOT NULL"), "source", ["page"], F.length("text"))
    events, _ = D.extract(bundled, ["source", "bundle"], ["page"], extractor, "page long, year long")
    return events.select("source", "page", "year")


@query("""SELECT c_custkey AS id, 'Template:Customer' AS template, label, value FROM (
  SELECT c_custkey, 'Titles' AS label, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'Segment', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, 'Home', 'nation ' || c_nationkey FROM customer UNION ALL SELECT c_custkey, 'Home', 'customer ' || c_custkey FROM customer)""", graph=False)
def infobox_variants(spark, d):
    """Customers as infobox JSON of nested groups, walked as variants; one row for each value."""
    text = '[{"type":"navigation","data":{"value":"<a href=/wiki/Template:Customer?action=edit>e</a>"}},{"type":"title","data":{"value":"%s"}},{"type":"group","data":{"value":[{"type":"data","data":{"label":"Segment","value":"<b>%s</b>"}},{"type":"section","data":{"value":[{"type":"panel","data":[{"type":"data","data":{"label":"Home:","value":"nation %d<br/>customer %d"}}]}]}}]}}]'
    made = table(spark, d, "customer", F.col("c_custkey").alias("id"), F.format_string(text, F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("long")).alias("json"))
    boxes = wiki.infobox_rows(made, "id", "json")
    rows = boxes.select(F.col("pageId").alias("id"), F.col("infobox.Template").alias("template"), F.explode("infobox.Data").alias("f"))
    return rows.select("id", "template", F.col("f.Label").alias("label"), F.explode("f.Values").alias("value"))


@query("""SELECT id, arg_min(place, (depth, place)) AS place, min(depth)::INT AS depth FROM (
  SELECT e.from_id AS id, e.to_id AS place, 1 AS depth FROM edges e WHERE e.label = 'in_nation' AND e.from_id % 7 <> 0
  UNION ALL SELECT from_id, from_id, 0 FROM edges WHERE label = 'in_nation' AND from_id % 7 = 0
  UNION ALL SELECT to_id, to_id, 0 FROM edges WHERE label = 'in_nation'
  UNION ALL SELECT to_id, from_id, 1 FROM edges WHERE label = 'in_region'
  UNION ALL SELECT p.from_id, p.to_id, 1 FROM edges p WHERE label = 'placed_by' AND p.to_id % 7 = 0
  UNION ALL SELECT p.from_id, n.to_id, 2 FROM edges p JOIN edges n ON n.from_id = p.to_id AND n.label = 'in_nation' WHERE p.label = 'placed_by' AND p.to_id % 7 <> 0) GROUP BY 1""")
def waypoints(spark, d):
    """For every region, nation, customer, supplier and order the nearest nation or seventh party, itself included, within two
    hops over where parties are at home and who placed orders."""
    edges = G.bare_edges(spark, d).where(F.col("label").isin("in_nation", "in_region", "placed_by")).select("from_id", "to_id", "label")
    homes = edges.where("label = 'in_nation'")
    located = homes.select(F.col("to_id").alias("id")).unionByName(homes.where("from_id % 7 = 0").select(F.col("from_id").alias("id"))).distinct()
    starts = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id"))).distinct()
    return P.nearest_location(edges, located, starts, 2, start_counts=True)


@query("""WITH n AS (SELECT 'Colour' AS property, 0::BIGINT AS total UNION ALL SELECT 'Gender', 0 UNION ALL SELECT 'Priority', count(*) FROM orders),
l AS (SELECT label, count(*) AS n FROM (SELECT 'placed_by' AS label FROM orders UNION ALL SELECT 'contains' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'supplied_by' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) GROUP BY 1)
SELECT property, total, CASE WHEN property = 'Colour' THEN (SELECT string_agg(label || ' (' || n || ')', ', ' ORDER BY n DESC, label) FROM l WHERE n >= 10) ELSE '' END AS stronger, property <> 'Priority' AS noted FROM n""", graph=False)
def property_counts_with_hints(spark, d):
    """A property that is not there, a category that is not there, and one that is, of orders."""
    nodes, edges, rows = G.nodes(spark, d), G.edges(spark, d), []
    for name in ("Colour", "Gender", "Priority"):
        got = C.property_counts(nodes, edges, "Order", name)
        rows.append((name, got.total, ", ".join(f"{label} ({n})" for label, n in got.stronger), got.note is not None))
    return spark.createDataFrame(rows, "property string, total long, stronger string, noted boolean")
