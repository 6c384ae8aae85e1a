"""Queries over timelines and grids, and over the state of the engine itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timelines as L
from ..sources import testgraph as G
from ..sources.tables import table
from ..streaming import limits
from .catalog import query

_LINEAR = "(CASE WHEN demarcation = 'Bby' THEN -year ELSE year END)::DOUBLE"


@query(f"""SELECT event_id, template, title, {_LINEAR} AS linear_year, (SELECT count(*) FROM timeline WHERE template IN ('view', 'click') AND continuity IN ('Canon', 'Both', 'Unknown') AND coalesce(calendar, 'Galactic') = 'Galactic' AND {_LINEAR} BETWEEN -10 AND 10) AS total
FROM timeline WHERE template IN ('view', 'click') AND continuity IN ('Canon', 'Both', 'Unknown') AND coalesce(calendar, 'Galactic') = 'Galactic' AND {_LINEAR} BETWEEN -10 AND 10 ORDER BY 4, 1 LIMIT 50 OFFSET 50""")
def timeline_page(spark, d):
    return L.page(G.timeline(spark, d), ["view", "click"], "Canon", "Galactic", -10, 10, 2, 50).select("event_id", "template", "title", "linear_year", "total")


@query("""SELECT event_id, real_year::DOUBLE AS linear_year, (SELECT count(*) FROM timeline WHERE calendar = 'Real' AND real_year BETWEEN 1990 AND 2005) AS total FROM timeline WHERE calendar = 'Real' AND real_year BETWEEN 1990 AND 2005 ORDER BY 2, 1 LIMIT 40""")
def timeline_page_real(spark, d):
    return L.page(G.timeline(spark, d), None, None, "Real", 2005, 1990, 1, 40).select("event_id", "linear_year", "total")


@query(f"""SELECT linear_year, n, titles FROM (SELECT {_LINEAR} AS linear_year, count(*) AS n, array_to_string((list(title ORDER BY event_id))[1:30], '; ') AS titles FROM timeline GROUP BY 1)""")
def timeline_by_year(spark, d):
    return L.by_year(G.timeline(spark, d).withColumn("linear_year", L.where.linear_year()), 30)


@query(f"""SELECT event_id, linear_year FROM (SELECT event_id, {_LINEAR} AS linear_year FROM timeline WHERE template = 'purchase' AND continuity IN ('Canon', 'Legends', 'Both') ORDER BY demarcation, year, event_id LIMIT 30 OFFSET 30)""")
def category_timeline(spark, d):
    return L.category_page(G.timeline(spark, d), "purchase", None, 2, 30).select("event_id", "linear_year")


@query(f"SELECT template AS era, min({_LINEAR}) AS first, max({_LINEAR}) AS last, count(*) AS n FROM timeline GROUP BY 1")
def timeline_eras(spark, d):
    title = F.when(F.col("event_id") % 2 == 0, F.concat("template", F.lit("/Legends"))).otherwise(F.col("template"))
    return L.eras(G.timeline(spark, d), title)


@query("SELECT DISTINCT template FROM timeline ORDER BY 1")
def timeline_categories(spark, d):
    return G.timeline(spark, d).select("template").distinct().orderBy("template")


@query("SELECT year, count(*) AS n FROM (SELECT unnest(range(start_year, CASE WHEN end_year IS NULL OR end_year < start_year OR end_year - start_year > 100 THEN start_year ELSE end_year END + 1))::INT AS year FROM nodes WHERE start_year IS NOT NULL) GROUP BY 1")
def multi_year_expansion(spark, d):
    return L.expand_years(G.nodes(spark, d), "start_year", "end_year").groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN field = 'Date' THEN '' ELSE field END AS field, abs(year - 1998)::FLOAT AS year, CASE WHEN year < 1998 THEN 'Bby' ELSE 'Aby' END AS demarcation FROM facets WHERE year IS NOT NULL")
def timeline_build(spark, d):
    f = G.facets(spark, d).select("id", F.explode("facets").alias("f")).select("id", "f.field", (F.col("f.year") - 1998).alias("year"))
    return L.build_rows(f)


@query("SELECT id, coalesce(start_year, end_year) AS first, coalesce(end_year, start_year) AS last, 'Existed' AS label FROM nodes")
def node_anchors(spark, d):
    return G.nodes(spark, d).select("id", L.anchor(F.col("start_year"), F.col("end_year"), F.col("type")).alias("a")).select("id", "a.*")


@query("SELECT id, grid, col, row FROM cells")
def grid_squares(spark, d):
    return G.cells(spark, d).select("id", "grid", L.grid_square(F.concat(F.lit(" "), F.lower("grid"), F.lit(" "))).alias("s")).select("id", "grid", "s.col", "s.row")


@query(f"""SELECT col, row, count(*) AS count, array_to_string((list(title ORDER BY linear_year, event_id))[1:15], ';') AS titles FROM (SELECT (event_id * 7 % 26)::INT AS col, (event_id % 20)::INT AS row, {_LINEAR} AS linear_year, event_id, title FROM timeline) GROUP BY 1, 2""")
def event_heat_map(spark, d):
    at = G.timeline(spark, d).select("event_id", "title", (F.col("event_id") * 7 % 26).cast("int").alias("col"), (F.col("event_id") % 20).cast("int").alias("row"), L.where.linear_year().alias("linear_year"))
    return L.heat_map(at)


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS big FROM orders GROUP BY ALL""", graph=False)
def progress_by_day(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum((F.col("o_totalprice") > 100000).cast("int")).alias("big"))


@query()
def rate_limiter(spark, d):
    """Calls by users within a sliding window; rejected ones don't count."""
    return limits.sliding(table(spark, d, "events", "event_id", "user_id", "ts"), calls=3, seconds=86_400)


@query("SELECT user_id, count(*) AS calls, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1", graph=False)
def client_usage(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT conv_id AS id, array_to_string(string_split(any_value(text) FILTER (turn = 0), ' ')[1:4], ' ') || '…' AS title FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (turn = 0) > 0", graph=False)
def chat_titles(spark, d):
    """A session's title: its first four words."""
    first = table(spark, d, "conversations").where("turn = 0").groupBy(F.col("conv_id").alias("id")).agg(F.min("text").alias("text"))
    return first.select("id", F.concat(F.array_join(F.slice(F.split("text", " "), 1, 4), " "), F.lit("…")).alias("title"))
