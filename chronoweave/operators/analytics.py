"""Counts and statistics over nodes and edges. Every result has a total order before its limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import filters as where
from ..functions import timecal


def _top(df: DataFrame, limit: int, *ties: str, count: str = "count") -> DataFrame:
    return df.orderBy(F.desc(count), *ties).limit(limit)


def _some_sources(id_: str, name: str, most: int) -> Column:
    """The ``most`` first sources by id, as text. Partial sums keep no more than ``most`` rows of a group."""
    refs = F.array_sort(F.collect_list(F.struct(F.col(id_).alias("id"), F.col(name).alias("name"))))
    return F.array_join(F.transform(F.slice(refs, 1, most), lambda r: F.concat_ws(":", r["id"], r["name"])), "|")


def first_by_group(df: DataFrame, group: list[str], order: list, most: int, name: str = "rn") -> DataFrame:
    """The first ``most`` rows of each group; Spark limits groups before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= most)


def count_related_entities(edges: DataFrame, entity_type: str, related_type: str, label: str, group_by_source: bool, continuity: str | None, limit: int, ascending: bool = False) -> DataFrame:
    """name, id, count of edges by one end. Ascending turns the top rows round, it doesn't look for the least."""
    side = "from" if group_by_source else "to"
    rows = edges.where((F.col("from_type") == entity_type) & (F.col("to_type") == related_type) & (F.col("label") == label) & where.graph_continuity("continuity", continuity))
    top = _top(rows.groupBy(F.col(f"{side}_name").alias("name"), F.col(f"{side}_id").alias("id")).agg(F.count("*").alias("count")), where.clamp(limit, 1, 50), "id")
    return top.orderBy("count", F.desc("id")) if ascending else top


def _property(nodes: DataFrame, entity_type: str, continuity: str | None) -> DataFrame:
    return nodes.where((F.col("type") == entity_type) & where.graph_continuity("continuity", continuity))


def count_nodes_by_properties(nodes: DataFrame, entity_type: str, properties: list[str], continuity: str | None, max_sources: int, limit: int) -> DataFrame:
    """Counts by whole property values, missing ones Unknown, with some sources."""
    value = lambda p: F.coalesce(F.array_join(F.try_element_at("properties", F.lit(p)), ", "), F.lit("Unknown"))
    rows = _property(nodes, entity_type, continuity).select("id", "name", *[value(p).alias(p.lower()) for p in properties])
    keys = [p.lower() for p in properties]
    top = _top(rows.groupBy(*keys).agg(F.count("*").alias("count")), limit, *keys)
    some = first_by_group(rows.join(F.broadcast(top.select(*keys)), keys, "left_semi"), keys, ["id"], max_sources)  # limit rows
    refs = some.groupBy(*keys).agg(_some_sources("id", "name", max_sources).alias("sources"))
    return _top(top.join(refs, keys).select(*keys, "count", "sources"), limit, *keys)


def count_nodes_by_property(nodes: DataFrame, entity_type: str, property_: str, continuity: str | None, limit: int, max_sources: int) -> DataFrame:
    """value, count, sources over the single values of a property."""
    rows = _property(nodes, entity_type, continuity).select("id", "name", F.explode(F.try_element_at("properties", F.lit(property_))).alias("value"))
    return _values(rows, limit, max_sources)


def _values(rows: DataFrame, limit: int, max_sources: int) -> DataFrame:
    top = _top(rows.groupBy("value").agg(F.count("*").alias("count")), limit, "value")
    some = first_by_group(rows.join(top.select("value"), "value", "left_semi"), ["value"], ["id"], max_sources)
    refs = some.groupBy("value").agg(_some_sources("id", "name", max_sources).alias("sources"))
    return top.join(refs, "value").orderBy(F.desc("count"), "value")


def count_by_year_range(nodes: DataFrame, entity_type: str, first: int, last: int, size: int, continuity: str | None) -> DataFrame:
    """year (of the bucket) and count of nodes by their start, those whose envelope meets the span."""
    rows = _property(nodes, entity_type, continuity).where(where.envelope_overlap(first, last) & F.col("start_year").between(first, last))
    return rows.groupBy(timecal.bucket(F.col("start_year"), size).alias("year")).agg(F.count("*").alias("count")).orderBy("year")


def count_facets_by_year(nodes: DataFrame, semantic: str, first: int, last: int, size: int, entity_type: str | None = None, continuity: str | None = None, exact: bool = True) -> DataFrame:
    """year and count of facets of one meaning. Nodes are filtered before their facets are taken apart."""
    rows = nodes.where(where.has_facet("facets", semantic, first=first, last=last, exact=exact) & where.graph_continuity("continuity", continuity))
    rows = rows.where(F.col("type") == entity_type) if entity_type else rows
    f = rows.select(F.explode("facets").alias("f")).select("f.*")
    s = F.lower("semantic")
    f = f.where((s == semantic.lower() if exact else s.startswith(semantic.lower())) & F.col("year").between(first, last))
    return f.groupBy(timecal.bucket(F.col("year"), size).alias("year")).agg(F.count("*").alias("count")).orderBy("year")


def find_by_lifecycle_transition(nodes: DataFrame, semantic: str, first: int, last: int, entity_type: str | None, continuity: str | None, limit: int) -> DataFrame:
    """The facets of one meaning within years, by year, with their nodes."""
    rows = nodes.where(where.has_facet("facets", semantic, first=first, last=last, exact=True) & where.graph_continuity("continuity", continuity))
    rows = rows.where(F.col("type") == entity_type) if entity_type else rows
    f = rows.select("id", "name", "type", F.explode("facets").alias("f")).select("id", "name", "type", "f.semantic", "f.year", "f.text", "f.calendar")
    return f.where((F.lower("semantic") == semantic.lower()) & F.col("year").between(first, last)).orderBy("year", "id").limit(where.clamp(limit, 1, 100))


def count_edges_between_types(edges: DataFrame, from_type: str, to_type: str, continuity: str | None, limit: int) -> DataFrame:
    rows = edges.where((F.col("from_type") == from_type) & (F.col("to_type") == to_type) & where.graph_continuity("continuity", continuity))
    return _top(rows.groupBy("label").agg(F.count("*").alias("count")), limit, "label")


def top_connected_entities(edges: DataFrame, entity_type: str | None, label: str | None, continuity: str | None, limit: int) -> DataFrame:
    """name, id, degree: by outgoing edges alone."""
    rows = edges.where(where.graph_continuity("continuity", continuity))
    rows = rows.where(F.col("from_type") == entity_type) if entity_type else rows
    rows = rows.where(F.col("label") == label) if label else rows
    return _top(rows.groupBy(F.col("from_name").alias("name"), F.col("from_id").alias("id")).agg(F.count("*").alias("degree")), limit, "id", count="degree")


def entity_profile(edges: DataFrame, entity_id: int, labels: list[str], continuity: str | None) -> DataFrame:
    """place, dimension, count for the labels in their order, 0 where there is none."""
    asked = edges.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "place int, dimension string")
    rows = edges.where((F.col("from_id") == entity_id) & F.col("label").isin(labels) & where.graph_continuity("continuity", continuity))
    counts = rows.groupBy(F.col("label").alias("dimension")).agg(F.count("*").alias("count"))
    return asked.join(counts, "dimension", "left").select("place", "dimension", F.coalesce("count", F.lit(0)).alias("count")).orderBy("place")


def count_nodes_by_type(nodes: DataFrame, continuity: str | None, limit: int) -> DataFrame:
    return _top(nodes.where(where.graph_continuity("continuity", continuity)).groupBy("type").agg(F.count("*").alias("count")), limit, "type")


def count_property_for_related(nodes: DataFrame, edges: DataFrame, root: int, label: str, property_: str, root_is_target: bool, continuity: str | None, limit: int, max_sources: int) -> DataFrame:
    """Property values of the distinct neighbours of a root."""
    own, far = ("to_id", "from_id") if root_is_target else ("from_id", "to_id")
    near = edges.where((F.col(own) == root) & (F.col("label") == label) & where.graph_continuity("continuity", continuity)).select(F.col(far).alias("id"))
    rows = nodes.join(near, "id", "left_semi").select("id", "name", F.explode(F.try_element_at("properties", F.lit(property_))).alias("value"))
    return _values(rows, limit, max_sources)


def edge_labels_for_type(edges: DataFrame, source_type: str, continuity: str | None) -> DataFrame:
    rows = edges.where((F.col("from_type") == source_type) & where.graph_continuity("continuity", continuity))
    return rows.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")


def group_entities_by_connection(edges: DataFrame, source_type: str, label: str, target_type: str | None, continuity: str | None, limit: int) -> DataFrame:
    """name, id, count of what entities of a type are connected with."""
    rows = edges.where((F.col("from_type") == source_type) & (F.col("label") == label) & where.graph_continuity("continuity", continuity))
    rows = rows.where(F.col("to_type") == target_type) if target_type else rows
    return _top(rows.groupBy(F.col("to_name").alias("name"), F.col("to_id").alias("id")).agg(F.count("*").alias("count")), limit, "id")


def compare_entities(nodes: DataFrame, edges: DataFrame, ids: list[int], labels: list[str], continuity: str | None) -> DataFrame:
    """place, id, name, label, count: every asked entity (10 at most) by every label, zeros for what isn't there."""
    ids = ids[:10]
    spark = edges.sparkSession
    asked = spark.createDataFrame([(i, e, x) for i, e in enumerate(ids) for x in labels], "place int, id long, label string")
    rows = edges.where(F.col("from_id").isin(ids) & F.col("label").isin(labels) & where.graph_continuity("continuity", continuity))
    counts = rows.groupBy(F.col("from_id").alias("id"), "label").agg(F.count("*").alias("count"))
    names = nodes.where(F.col("id").isin(ids)).select("id", "name")
    return asked.join(counts, ["id", "label"], "left").join(names, "id", "left").select("place", "id", F.coalesce("name", F.lit("")).alias("name"), "label", F.coalesce("count", F.lit(0)).alias("count")).orderBy("place", "label")


def relationship_types(edges: DataFrame, entity_id: int, continuity: str | None) -> DataFrame:
    rows = edges.where((F.col("from_id") == entity_id) & where.graph_continuity("continuity", continuity))
    return rows.groupBy("label").agg(F.count("*").alias("count"), F.round(F.avg("weight"), 6).alias("avg_weight")).orderBy(F.desc("count"), "label")


def edge_label_statistics(edges: DataFrame, pattern: str | None = None, continuity: str | None = None, from_type: str | None = None, to_type: str | None = None, min_count: int = 1, top: int = 5) -> DataFrame:
    """Statistics of labels in two stages: by label and type pair, then by label. avg_weight is the mean of the pairs'
    means; weighted_avg is the plain one."""
    rows = edges.where(where.matches("label", pattern) & where.graph_continuity("continuity", continuity))
    rows = rows.where(F.col("from_type") == from_type) if from_type else rows
    rows = rows.where(F.col("to_type") == to_type) if to_type else rows
    is_ = lambda c: F.sum(F.when(F.col("continuity") == c, 1).otherwise(0))
    pairs = rows.groupBy("label", "from_type", "to_type").agg(F.count("*").alias("n"), is_("Canon").alias("canon"), is_("Legends").alias("legends"), F.avg("weight").alias("mean"), F.sum("weight").alias("weight"), F.min("from_id").alias("least"))
    # the least edge of a label is one of its least source: minima of structs would sort all edges
    least = pairs.groupBy("label").agg(F.min("least").alias("least")).select(F.col("label").alias("_label"), "least")
    of_least = rows.join(F.broadcast(least), F.col("label").eqNullSafe(F.col("_label")) & F.col("from_id").eqNullSafe(F.col("least")), "left_semi")  # a row for each label
    sample = of_least.groupBy(F.col("label").alias("_label")).agg(F.min(F.struct("from_id", "to_id", "from_name", "to_name")).alias("sample"))

    def types(side: str) -> Column:
        """The commonest types of a side, from a label's pairs; there are no more than types by types."""
        n = lambda t: F.aggregate(F.filter("pairs", lambda p: p[side].eqNullSafe(t)), F.lit(0).cast("long"), lambda total, p: total - p.n)
        each = F.transform(F.array_distinct(F.transform("pairs", lambda p: p[side])), lambda t: F.struct(n(t).alias("n"), t.alias("type")))
        return F.array_join(F.transform(F.slice(F.array_sort(each), 1, top), lambda x: x.type), ", ")

    sums = [F.sum("n").alias("count"), F.sum("canon").alias("canon"), F.sum("legends").alias("legends"), F.round(F.avg("mean"), 6).alias("avg_weight"), F.round(F.sum("weight") / F.sum("n"), 6).alias("weighted_avg")]
    by_label = pairs.groupBy("label").agg(*sums, F.collect_list(F.struct("from_type", "to_type", "n")).alias("pairs"))
    by_label = by_label.join(F.broadcast(sample), F.col("label").eqNullSafe(F.col("_label")))  # a row for each label
    by_label = by_label.withColumns({"top_from_types": types("from_type"), "top_to_types": types("to_type")})
    return by_label.where(F.col("count") >= min_count).select("label", "count", "canon", "legends", "avg_weight", "weighted_avg", F.col("sample.from_name").alias("sample_from"), F.col("sample.to_name").alias("sample_to"), "top_from_types", "top_to_types").orderBy(F.desc("count"), "label")


def label_registry(edges: DataFrame, definitions: dict[str, tuple]) -> DataFrame:
    """Every used or declared label with its reverse, description, count and types. Old texts stay where not empty."""
    used = edges.groupBy("label").agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_set(F.nullif("from_type", F.lit("")))), ",").alias("from_types"), F.array_join(F.array_sort(F.collect_set(F.nullif("to_type", F.lit("")))), ",").alias("to_types"), F.max("reverse_label").alias("old_reverse"))
    declared = edges.sparkSession.createDataFrame([(k, v[0], v[1]) for k, v in definitions.items()], "label string, reverse string, description string")
    filled = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    out = used.join(F.broadcast(declared), "label", "full_outer")
    return out.select("label", filled("old_reverse", "reverse").alias("reverse"), filled("description").alias("description"), F.coalesce("count", F.lit(0)).alias("count"), filled("from_types").alias("from_types"), filled("to_types").alias("to_types"))


def territory_control(counts: DataFrame, contested_below: float = 0.7, floor: float = 0.3, other_floor: float = 0.1) -> DataFrame:
    """year, region, faction, share, contested from counts (year, region, faction, n). The leader's share is at least
    0.3; others are listed, at least at 0.1, only where a region is contested: more than one faction, leader below 0.7."""
    region = Window.partitionBy("year", "region")
    order = region.orderBy(F.desc("n"), "faction")
    rows = counts.select("*", F.row_number().over(order).alias("rank"), F.sum("n").over(region).alias("total"), F.count("*").over(region).alias("factions"), F.max("n").over(region).alias("most"))
    contested = (F.col("factions") > 1) & (F.col("most") / F.col("total") < contested_below)
    share = F.greatest(F.col("n") / F.col("total"), F.when(F.col("rank") == 1, floor).otherwise(other_floor))
    return rows.where((F.col("rank") == 1) | contested).select("year", "region", "faction", F.round(share, 6).alias("share"), contested.alias("contested"))


def year_density(rows: DataFrame, lens: str) -> DataFrame:
    """year, count, canon, legends and the counts of each lens, as sorted text."""
    each = rows.groupBy("year", lens).agg(F.count("*").alias("n"), F.sum((F.col("continuity") == "Canon").cast("int")).alias("canon"), F.sum((F.col("continuity") == "Legends").cast("int")).alias("legends"))
    lenses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(lens, "n"))), lambda x: F.concat_ws("=", x[lens], x.n)), ",")
    return each.groupBy("year").agg(F.sum("n").alias("count"), F.sum("canon").alias("canon"), F.sum("legends").alias("legends"), lenses.alias("lenses")).orderBy("year")


def progress(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """type by status, pivoted over known statuses, with totals."""
    out = rows.groupBy("type").pivot("status", kinds).count()
    filled = [F.coalesce(k, F.lit(0)).alias(k) for k in kinds]
    return out.select("type", *filled).withColumn("total", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))


def paged(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page and, in each row, the total: one aggregate, as a scalar subquery."""
    size = where.clamp(size, 1, 100)
    rows = df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
    return rows.withColumn("total", df.agg(F.count("*").alias("total")).scalar())


def _remaining(pending: Column, per_hour: Column) -> Column:
    return F.when(per_hour > 0, F.round(pending / per_hour, 1))


def chunk_rates(pages: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """type, pages, chunked, pending, chunks, avg_chunks, per_hour, hours_left, for each type and, as type null, for all.

    pages: page, type of those that are to be chunked; chunks: page, created_at. A page's chunks are put together once;
    pages that have one of the last hour are the rate of an hour. hours_left is null where that is 0."""
    each = chunks.groupBy("page").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    rows = pages.select("page", F.coalesce("type", F.lit("Unknown")).alias("type")).join(each, "page", "left")
    recent = (F.col("last") >= now - F.expr("INTERVAL 1 HOUR")) & (F.col("last") <= now)
    sums = rows.rollup("type").agg(F.count("*").alias("pages"), F.count("n").alias("chunked"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count_if(recent).alias("per_hour"))
    out = sums.withColumn("pending", F.col("pages") - F.col("chunked"))
    mean = F.when(F.col("chunked") > 0, F.round(F.col("chunks") / F.col("chunked"), 1)).otherwise(0.0)
    return out.select("type", "pages", "chunked", "pending", "chunks", mean.alias("avg_chunks"), "per_hour", _remaining(F.col("pending"), F.col("per_hour")).alias("hours_left"))


def builder_rates(pages: DataFrame, states: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """type, total, processed, skipped, failed, pending, per_hour, hours_left, for each type and, as type null, for all.

    pages: page, type; states: page, status; batches: created_at, processed_at, status, completed, skipped. The rate
    is what the batches processed in the last day did in the hours since the oldest of them was made; it is one for all types,
    and each type's hours are by its own pending pages."""
    done = batches.where((F.col("status") == "Processed") & (F.col("processed_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("processed_at") <= now))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))) / 3.6e9
    rate = done.agg(F.sum(F.col("completed") + F.col("skipped")).alias("n"), hours.alias("hours"))
    rate = rate.select(F.coalesce(F.when(F.col("hours") > 0, F.round(F.col("n") / F.col("hours"), 0)), F.lit(0.0)).alias("per_hour"))  # one row
    rows = pages.select("page", F.coalesce("type", F.lit("Unknown")).alias("type")).join(states.select("page", "status"), "page", "left")
    count = lambda status: F.count_if(F.col("status") == status)
    sums = rows.rollup("type").agg(F.count("*").alias("total"), count("Completed").alias("processed"), count("Skipped").alias("skipped"), count("Failed").alias("failed"))
    out = sums.withColumn("pending", F.col("total") - F.col("processed") - F.col("skipped") - F.col("failed")).join(F.broadcast(rate))
    return out.select("type", "total", "processed", "skipped", "failed", "pending", "per_hour", _remaining(F.col("pending"), F.col("per_hour")).alias("hours_left"))
