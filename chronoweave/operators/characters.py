"""Events of characters: one of each kept, years inferred from the graph; payloads, hints and reasons for no result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as where
from .analytics import count_nodes_by_property, edge_labels_for_type, first_by_group
from .graph import kept
from .pages import infobox_types, label_usage
from .timelines import sparse_hint

#: Properties that have few values by nature.
CATEGORICAL = ("era", "period", "epoch", "alignment", "gender", "outcome")


def consolidate(events: DataFrame, *group: str) -> DataFrame:
    """The most complete event of each type, year and place (undated ones: of the first 60 characters of their text too),
    the smallest event_id of equal ones. ``group`` keeps characters apart.

    Columns: event_id, type, year, demarcation, date_text, location, description, narrative, significance, source_title,
    related and consequences (arrays). Nulls and blanks are missing; a missing type is Other. Others are kept as they are.
    """
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    place = F.regexp_replace(F.regexp_replace(text("location"), "^the ", ""), "^planet ", "")
    dated = F.col("year").isNotNull()
    key = F.struct(
        F.lower(F.trim(F.coalesce("type", F.lit("Other")))), F.bround("year").cast("long"), F.when(dated, F.upper(text("demarcation"))),
        place, F.when(~dated, F.substring(text("description"), 1, 60)),
    )
    filled = lambda c: (text(c) != "").cast("int")
    longer = lambda c, n: F.coalesce(F.length(c) > n, F.lit(False)).cast("int")
    score = 2 * dated.cast("int") + sum((filled(c) for c in ("demarcation", "date_text", "location", "source_title", "significance")), F.lit(0))
    score += sum((where.sized(c).cast("int") for c in ("related", "consequences")), longer("description", 50) + 3 * longer("narrative", 100) * filled("narrative"))
    rows = events.select(F.struct(*events.columns).alias("event"), *group, F.col("event_id").alias("id"), key.alias("dedup"), score.alias("score"))
    return first_by_group(rows, [*group, "dedup"], [F.desc("score"), "id"], 1).select("event.*")


def infer_years(events: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """event_id, year (never negative), demarcation, source: years for events without one, where the graph tells one.

    ``events`` has event_id, character_id, year, location, related. The place, then the related names in order, are
    looked for among the names that the character has edges with: first an edge with a year (its first one, else its
    last one), then the far node's life. Names compare without outer blanks and case.
    """
    name = lambda c: F.lower(F.trim(c))
    both = edges.select("from_id", "to_id", "label", "from_name", "to_name", "from_year", "to_year")
    turned = both.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "label", F.col("to_name").alias("from_name"), F.col("from_name").alias("to_name"), "from_year", "to_year")
    asked = events.where("year IS NULL")
    # ids of a type lie together, so most edges are none of a character's; that is told without an exchange
    least, most = asked.agg(F.min("character_id"), F.max("character_id")).first()
    near = F.col("from_id").between(F.lit(least), F.lit(most))
    far = both.where(near).unionByName(turned.where(near)).withColumnRenamed("from_id", "character_id")
    far = far.join(asked.select("character_id").distinct(), "character_id", "left_semi")
    dated = far.where("from_year IS NOT NULL OR to_year IS NOT NULL")
    first = F.struct(F.col("from_year").isNull().alias("late"), "label", "to_id", F.coalesce("from_year", "to_year").alias("year"), F.concat(F.lit("kg-edge:"), "label", F.lit("→"), "to_name").alias("source"))
    by_edge = dated.groupBy("character_id", name("to_name").alias("key")).agg(F.min(first).alias("edge"))
    lives = nodes.where("start_year IS NOT NULL OR end_year IS NOT NULL").select(F.col("id").alias("to_id"), "name", F.coalesce("start_year", "end_year").alias("year"))
    life = F.struct("to_id", "year", F.concat(F.lit("kg-node:"), "name").alias("source"))
    by_node = far.select("character_id", "to_id").distinct().join(lives, "to_id").groupBy("character_id", name("name").alias("key")).agg(F.max(life).alias("node"))
    texts = F.concat(F.when(F.trim("location") != "", F.array("location")).otherwise(F.array().cast("array<string>")), F.coalesce("related", F.array().cast("array<string>")))
    tries = asked.select("event_id", "character_id", F.posexplode(texts).alias("turn", "text")).select("event_id", "character_id", "turn", name("text").alias("key"))
    keys = ["character_id", "key"]
    found = tries.join(by_edge, keys, "left").join(by_node, keys, "left").where("edge IS NOT NULL OR node IS NOT NULL")
    hit = F.when(F.col("edge").isNotNull(), F.struct("edge.year", "edge.source")).otherwise(F.struct("node.year", "node.source"))
    best = found.groupBy("event_id").agg(F.min_by(hit, "turn").alias("hit"))
    return best.select("event_id", F.abs("hit.year").alias("year"), F.when(F.col("hit.year") < 0, "Bby").otherwise("Aby").alias("demarcation"), "hit.source")


def with_payload(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes with the fields of their page's infobox as ``payload``; null where there is no page or it has no fields."""
    payload = pages.where(where.sized("infobox.Data")).select(F.col("pageId").alias("id"), F.col("infobox.Data").alias("payload"))
    return nodes.join(payload, "id", "left")


def stronger_labels(nodes: DataFrame, edges: DataFrame, kind: str, property_: str, continuity: str | None = None) -> list[str]:
    """Up to three edge labels that tell more of a type than a property with few values does."""
    wanted = where.graph_continuity("continuity", continuity)
    total = nodes.where((F.col("type") == kind) & wanted).agg(F.sum(F.coalesce(F.size(F.col("properties")[property_]), F.lit(0))).alias("n")).first().n or 0
    if total >= 20 or property_.lower() in CATEGORICAL:
        return []
    counts = edges.where((F.col("from_type") == kind) & wanted).groupBy("label").agg(F.count("*").alias("n"))
    best = counts.where(F.col("n") >= max(5 * total, 10)).orderBy(F.desc("n"), "label").limit(3).collect()
    return sparse_hint(total, False, [(r.label, r.n) for r in best])


def why_empty(pages: DataFrame, kind: str, label: str) -> tuple[str, list[str]]:
    """Why a read by type, field and value found nothing, and what there is: ``type``, ``case`` (of the type) with all
    types, ``label`` with the 30 most frequent fields, or ``value`` with the same."""
    labels = [r.label for r in label_usage(pages, kind).limit(30).collect()]
    if labels:
        return "value" if label.lower() in {x.lower() for x in labels} else "label", labels
    types = [r.type for r in infobox_types(pages).orderBy("type").collect()]  # names of types alone
    return "case" if kind.lower() in {t.lower() for t in types if t} else "type", types


@dataclass
class PropertyCounts:
    """rows: value, count, sources; total: the sum of these counts; stronger: labels and counts of edges that tell more; note: what
    to read instead, or None."""

    rows: DataFrame
    total: int
    stronger: list[tuple[str, int]]
    note: str | None


def property_counts(nodes: DataFrame, edges: DataFrame, kind: str, property_: str, limit: int = 20, max_sources: int = 5, continuity: str | None = None) -> PropertyCounts:
    """Counts of a property's values, and what to do if they say little: with fewer than 20 in all, up to three labels of edges from the
    type with at least five times as many, and ten; none for categories, which have few values by nature, but if there is nothing
    at all, a count by years. ``rows`` is kept, limit rows, as its sum is needed too."""
    limit, max_sources = where.clamp(limit, 1, 50), where.clamp(max_sources, 1, 25)
    rows = kept(count_nodes_by_property(nodes, kind, property_, continuity, limit, max_sources), "counts")
    total, category = rows.agg(F.sum("count")).first()[0] or 0, property_.lower() in CATEGORICAL
    if category:
        note = f"{property_!r} has no values on {kind!r}: count it by years instead." if not total else None
        return PropertyCounts(rows, total, [], note)
    if total >= 20:
        return PropertyCounts(rows, total, [], None)
    counts = edge_labels_for_type(edges, kind, continuity).where(F.col("count") >= max(5 * total, 10)).limit(3).collect()
    stronger = [(r.label, r["count"]) for r in counts]
    note = f"{property_!r} has {total} values on {kind!r}: group by the edges {', '.join(f'{label} ({n})' for label, n in stronger)} instead." if stronger else None
    return PropertyCounts(rows, total, stronger, note)
