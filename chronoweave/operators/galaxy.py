"""A map of the made-up world: a document for each year, its overview, cells and regions, and searches over the grid."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as where
from ..functions import timecal
from . import vectors
from .analytics import first_by_group, territory_control
from .build import type_of
from .graph import kept, nearest_location
from .intervals import point_in_span
from .search import text_search
from .timelines import grid_square, nearest_available

#: Regions from the core out, and parts of texts that mean one of them, tried in this order.
REGIONS = ("Deep Core", "Core Worlds", "Colonies", "Inner Rim", "Expansion Region", "Mid Rim", "Outer Rim Territories", "Hutt Space", "Unknown Regions", "Wild Space")
REGION_PARTS = {
    "outer rim": "Outer Rim Territories", "mid rim": "Mid Rim", "inner rim": "Inner Rim", "core world": "Core Worlds", "deep core": "Deep Core",
    "colonies": "Colonies", "expansion": "Expansion Region", "hutt space": "Hutt Space", "unknown region": "Unknown Regions", "wild space": "Wild Space",
}
#: Short names of regions.
SHORT_REGIONS = {"outer rim": "Outer Rim Territories", "mid rim": "Mid Rim", "inner rim": "Inner Rim", "the slice": "The Slice", "the interior": "The Interior"}
#: Categories of events by type; all others are events.
CATEGORIES = {"Battle": "Battle", "Duel": "Battle", "War": "War", "Campaign": "War", "Treaty": "Treaty", "Government": "Government", "Organization": "Government", "Mission": "Campaign"}
#: Fixed value: the colours of factions that have none of their own.
PALETTE = ("#3b82f6", "#ef4444", "#6b7280", "#f97316", "#22c55e", "#991b1b", "#f59e0b", "#a8722a", "#1e3a5f", "#8b5cf6", "#ec4899", "#14b8a6", "#84cc16", "#d946ef", "#06b6d4")
#: Parts of labels of fields that say where something is.
LOCATION_LABELS = ("Homeworld", "Location", "Planet", "Birthplace", "Capital", "Headquarters", "Base of operations", "Place", "Theater", "Born", "Died", "Destroyed", "System", "Sector", "Region", "Base", "World", "Moon", "Located")
GRID, SHOWN_EVENTS, UNRESOLVED, LONGEST = "Grid square", 15, 30, 100


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def region_name(raw: Column) -> Column:
    """One of the known regions by its whole name, else by a part of it, else null."""
    lower = F.lower(F.trim(raw))
    parts = [F.when(F.contains(lower, F.lit(part)), name) for part, name in REGION_PARTS.items()]
    return F.coalesce(_lookup(lower, {r.lower(): r for r in REGIONS}), *parts)


def short_region(raw: Column) -> Column:
    """What stands before the first ; or , (the whole, if one is first) without "Territories", short names written out."""
    first = F.when(raw.rlike("^[;,]"), raw).otherwise(F.regexp_extract(raw, "(?s)^([^;,]*)", 1))
    name = F.regexp_replace(F.trim(first), "(?i) Territories$", "")
    return F.coalesce(_lookup(F.lower(name), SHORT_REGIONS), name)


def category(kind: Column) -> Column:
    return F.coalesce(_lookup(kind, CATEGORIES), F.lit("Event"))


def colour(name: Column, curated: dict[str, str] | None = None, palette: tuple[str, ...] = PALETTE) -> Column:
    """A faction's own colour, whatever the case of its name, else one that its name's hash picks."""
    picked = F.element_at(F.array(*[F.lit(x) for x in palette]), (F.crc32(F.lower(name).cast("binary")) % len(palette) + 1).cast("int"))
    return F.coalesce(_lookup(F.lower(name), {k.lower(): v for k, v in curated.items()}), picked) if curated else picked


def lens_totals(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """lens, total, with_location, is_real (of the first node by id) of nodes with a start; ``located`` has unique ids."""
    dated = nodes.where(F.col("start_year").isNotNull()).join(located.select("id", F.lit(1).alias("at")), "id", "left")
    return dated.groupBy(F.col("type").alias("lens")).agg(F.count("*").alias("total"), F.count("at").alias("with_location"), F.min_by(F.col("realm") == "Real", "id").alias("is_real"))


def events_by_year(nodes: DataFrame) -> DataFrame:
    """Nodes with a start, in the year of it; conflicts and institutions (by ``semantic``, that of the first facet) of up
    to 100 years in each of their years."""
    length = F.col("end_year") - F.col("start_year")
    spans = F.split("semantic", r"\.")[0].isin("conflict", "institutional") & length.between(1, LONGEST)
    last = F.when(spans, F.col("end_year")).otherwise(F.col("start_year"))
    return nodes.where(F.col("start_year").isNotNull()).withColumn("year", F.explode(F.sequence("start_year", last)))


def _listed(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """The first ``most`` events by id of each group as an array; groups are limited before the shuffle."""
    event = F.struct("rank", F.col("id").alias("id"), F.col("name").alias("title"), F.col("type").alias("lens"), category(F.col("type")).alias("category"), "place", "continuity", "realm")
    first = first_by_group(rows, keys, ["id"], most, "rank")
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias(name))  # most of each group


def event_cells(events: DataFrame) -> DataFrame:
    """year, col, row, region (of the first event), count of all events and the first 15."""
    rows = events.where(F.col("col").isNotNull() & F.col("row").isNotNull())
    keys = ["year", "col", "row"]
    total = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.min_by("region", "id").alias("region"))
    return total.join(_listed(rows, keys, SHOWN_EVENTS, "events"), keys)


def unresolved(events: DataFrame) -> DataFrame:
    """year, count of events without a place on the grid, and the first 30 of them."""
    rows = events.where(F.col("col").isNull() | F.col("row").isNull())
    return rows.groupBy("year").agg(F.count("*").alias("unresolved")).join(_listed(rows, ["year"], UNRESOLVED, "unresolved_events"), "year")


def year_documents(nodes: DataFrame, places: DataFrame, eras: DataFrame, governments: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """One row for each year in which an event is or a government starts or ends.

    ``nodes`` has a ``semantic`` too; ``places`` is id, place, region, col, row (unique ids); ``eras`` is name, start_year,
    end_year; ``governments`` is start_year, end_year; ``regions`` is year, region, faction, share, contested. A row has
    year, display, era (that of the earliest start), cells by falling count (no more than the grid has), unresolved events,
    counts by lens and continuity, and regions. Years without events have empty arrays and zeros.
    """
    events = events_by_year(nodes).join(places, "id", "left")
    by_lens = events.groupBy("year", F.col("type").alias("lens")).agg(F.count("*").alias("n"), F.count_if(F.col("continuity") == "Canon").alias("canon"), F.count_if(F.col("continuity") == "Legends").alias("legends"))
    counted = by_lens.groupBy("year").agg(F.sum("n").alias("count"), F.sum("canon").alias("canon"), F.sum("legends").alias("legends"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lens", "n")))).alias("lens_counts"))
    cell = F.struct((-F.col("count")).alias("order"), "col", "row", "count", "region", "events")
    cells = event_cells(events).groupBy("year").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    out = counted
    if governments is not None:
        years = governments.select(F.explode(F.array("start_year", "end_year")).alias("year")).where("year IS NOT NULL").distinct()
        out = out.join(years, "year", "full_outer")
    spans = eras.where(F.col("start_year").isNotNull()).withColumn("end_year", F.coalesce("end_year", "start_year")).where("end_year >= start_year")
    spans = spans.select(F.struct("start_year", "name").alias("era"), F.explode(F.sequence("start_year", "end_year")).alias("year")).groupBy("year").agg(F.min("era").alias("era"))
    out = out.join(spans, "year", "left").join(cells, "year", "left").join(unresolved(events), "year", "left")
    if regions is not None:
        held = regions.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("region", "faction", "share", "contested"))).alias("regions"))
        out = out.join(held, "year", "left")
    else:
        out = out.withColumn("regions", F.lit(None).cast("array<struct<region:string,faction:string,share:double,contested:boolean>>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("year", timecal.mart_display(F.col("year")).alias("display"), F.col("era.name").alias("era"), empty("cells"), zero("unresolved"), empty("unresolved_events"), F.coalesce("lens_counts", F.create_map().cast("map<string,bigint>")).alias("lens_counts"), zero("count"), zero("canon"), zero("legends"), empty("regions"))


def overview(documents: DataFrame, lenses: DataFrame, eras: DataFrame, factions: DataFrame) -> DataFrame:
    """The one row beside the years: lenses by falling total, eras by start, factions by name, and each year's counts.
    Its size is that of the lists of types, declared eras, factions and years, not of the events."""
    listed = lambda df, *columns: df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("x")).scalar()
    return documents.sparkSession.range(1).select(
        listed(lenses, (-F.col("total")).alias("order"), "lens", "total", "with_location", "is_real").alias("lenses"),
        listed(eras, "start_year", "end_year", "name", "continuity").alias("eras"),
        listed(factions, "name", "colour").alias("factions"),
        listed(documents, "year", "count", "canon", "legends").alias("years"),
    )


def eras_shown(overview: DataFrame, continuity: str | None) -> DataFrame:
    """The overview with the eras of a continuity and those that both share; all of them, if none or both is asked for."""
    if continuity in (None, "Both"):
        return overview
    return overview.withColumn("eras", F.filter("eras", lambda e: e.continuity.isin(continuity, "Both", "Unknown")))


def years_between(documents: DataFrame, first: int, last: int) -> DataFrame:
    return documents.where(F.col("year").between(first, last)).orderBy("year")


def factions(overview: DataFrame) -> DataFrame:
    return overview.select(F.inline("factions"))


def galaxy_year(documents: DataFrame, year: int, most: int = 30) -> DataFrame:
    """One row: a year with shares in percent, its first ``most`` events on the map and the count of all; of a year
    without a document an error and the five nearest years (null otherwise)."""
    none = lambda kind: F.lit(None).cast(kind)
    percent = lambda r: F.struct(r.region.alias("region"), r.faction.alias("faction"), F.concat(F.round(r.share * 100).cast("int"), F.lit("%")).alias("control"), r.contested.alias("contested"))
    titles = F.transform(F.slice(F.flatten(F.transform("cells", lambda c: c.events)), 1, most), lambda e: e.title)
    found = documents.where(F.col("year") == year).select(
        F.col("year").cast("int"), "display", "era", F.transform("regions", percent).alias("territory"), titles.alias("events"),
        (F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["count"]) + F.size("unresolved_events")).alias("total"), none("string").alias("error"), none("array<int>").alias("nearest"),
    )
    if not found.isEmpty():
        return found
    near = nearest_available(documents.select("year"), year).agg(F.array_sort(F.collect_list(F.struct(F.abs(F.col("year") - year).alias("far"), F.col("year").cast("int").alias("year")))).alias("near"))
    return near.select(*[none(found.schema[c].dataType).alias(c) for c in found.columns[:6]], F.lit(f"No data for year {year}.").alias("error"), F.transform("near", lambda n: n.year).alias("nearest"))


def cell_summaries(systems: DataFrame) -> DataFrame:
    """col, row, systems, region (the one of most systems, the first by name of equal ones) and sectors by falling count.
    ``systems`` has id, col, row, region, sector; null regions and sectors count as systems alone."""
    keys = ["col", "row"]
    region = systems.where("region IS NOT NULL").groupBy(*keys, "region").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "region")).alias("top"))
    sector = systems.where("sector IS NOT NULL").groupBy(*keys, "sector").agg(F.count("*").alias("n"))
    sectors = sector.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col("sector").alias("name"), F.col("n").alias("count")))).alias("sectors"))
    out = systems.groupBy(*keys).agg(F.count("*").alias("systems")).join(region, keys, "left").join(sectors, keys, "left")
    return out.select(*keys, "systems", F.col("top.region").alias("region"), "sectors")


def region_cells(systems: DataFrame) -> DataFrame:
    """region and its distinct cells in order; no more than the grid has."""
    each = systems.where("region IS NOT NULL").select(short_region(F.col("region")).alias("region"), "col", "row").distinct()
    return each.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("col", "row"))).alias("cells"))


def _with_grid(pages: DataFrame) -> DataFrame:
    return pages.withColumn("square", F.get(F.get(where.fields("infobox.Data", GRID), F.lit(0))["Values"], F.lit(0)))


def _references(pages: DataFrame, exact: bool) -> DataFrame:
    """source_id, source_name, label, name: places that fields about locations name. ``exact`` takes whole labels and
    only links, else labels with a part and texts and links."""
    f = pages.select(F.col("pageId").alias("source_id"), F.col("title").alias("source_name"), F.explode("infobox.Data").alias("f"))
    label, links = F.col("f.Label"), F.transform("f.Links", lambda x: x.Content)
    fits = label.isin(*LOCATION_LABELS) if exact else reduce(or_, [F.contains(F.lower(label), F.lit(x.lower())) for x in LOCATION_LABELS])
    names = links if exact else F.array_distinct(F.concat(F.coalesce("f.Values", F.array().cast("array<string>")), F.coalesce(links, F.array().cast("array<string>"))))
    return f.where(fits).select("source_id", "source_name", label.alias("label"), F.explode(names).alias("name")).where(F.trim("name") != "")


def grid_search(pages: DataFrame, term: str, continuity: str | None = None, most: int = 50) -> DataFrame:
    """grid_key, page_id, name, template, match, linked_via, source_id: the best ``most`` pages with a square that the
    term finds, and the squares of places that the best ``most`` other pages found say they are at.

    ``pages`` has pageId, title, text, continuity and infobox. A square's text after the first dash must be a number.
    """
    rows = _with_grid(pages)
    marked = where.has_field("infobox.Data", GRID)
    wanted = rows.where(F.col("continuity") == continuity) if continuity else rows
    find = lambda df: df.join(text_search(df, term, most, "title", id_col="pageId").select("pageId"), "pageId", "left_semi")
    key = F.concat(F.trim(F.split("square", "-", 2)[0]), F.lit("-"), F.trim(F.split("square", "-", 2)[1]))
    on_grid = rows.where(marked & F.col("square").rlike(r"^[^-]*-\s*[-+]?\d+\s*$")).withColumn("grid_key", key)
    shown = lambda match, via, source: ["grid_key", F.col("pageId").alias("page_id"), F.col("title").alias("name"), type_of(F.col("infobox.Template")).alias("template"), F.lit(match).alias("match"), via.alias("linked_via"), source.cast("long").alias("source_id")]
    direct = on_grid.join(find(wanted.where(marked)).select("pageId"), "pageId", "left_semi").select(shown("direct", F.lit(None).cast("string"), F.lit(None)))
    refs = _references(find(wanted.where(~marked & F.col("infobox").isNotNull())), exact=False)  # of ``most`` pages
    linked = on_grid.join(refs, on_grid.title == refs.name).select(shown("linked", F.concat("label", F.lit(" of "), "source_name"), F.col("source_id")))
    return direct.unionByName(linked)


def semantic_grid_search(pages: DataFrame, spatial: DataFrame, every: DataFrame, limit: int = 10) -> DataFrame:
    """grid_key, page_id, match, source_id, score, snippet, those found themselves first, then by score.

    ``spatial`` and ``every`` are hits (id, score, text) of searches over places and over all pages; of a page's hits the
    first of the places' counts, then the best. Pages without a square count for the squares of pages they link to.
    """
    hits = spatial.withColumn("turn", F.lit(0)).unionByName(every.withColumn("turn", F.lit(1)))
    hits = first_by_group(hits, ["id"], ["turn", F.desc("score"), "text"], 1).select(F.col("id").alias("pageId"), "score", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("snippet"))
    rows = _with_grid(pages).withColumn("s", grid_square(F.col("square")))
    on_grid = rows.where("s IS NOT NULL").select("pageId", "title", F.concat(F.chr(F.col("s.col") + 65), F.lit("-"), F.col("s.row") + 1).alias("grid_key"))
    own = on_grid.join(hits, "pageId").select("grid_key", F.col("pageId").alias("page_id"), F.lit("semantic").alias("match"), F.lit(None).cast("long").alias("source_id"), "score", "snippet")
    far = rows.where("s IS NULL").join(hits, "pageId", "left_semi")
    refs = _references(far, exact=True).select("source_id", "name").distinct()
    first = on_grid.join(refs, on_grid.title == refs.name).join(hits.select("pageId"), "pageId", "left_anti").groupBy("pageId", "grid_key").agg(F.min("source_id").alias("source_id"))
    linked = first.join(hits.withColumnRenamed("pageId", "source_id"), "source_id").select("grid_key", F.col("pageId").alias("page_id"), F.lit("semantic-linked").alias("match"), "source_id", "score", "snippet")
    return own.unionByName(linked).orderBy("match", F.desc("score"), "page_id").limit(limit)  # "semantic" sorts first


def grid_search_by_vector(pages: DataFrame, index: str, query: list[float], places: list[str], limit: int = 10, least: float = 0.6) -> DataFrame:
    """semantic_grid_search() over what the vector search finds: twice ``limit`` chunks of pages of the types that are places, then
    three times as many of any type, each at least ``least`` near. ``index`` is one of vectors.build() over chunks, which keeps
    page, type and text; of a page's chunks the best counts."""
    spark = pages.sparkSession
    # kept, as each is read several times
    hit = lambda most, passes: kept(vectors.search(spark, index, query, most, passes, least).select(F.col("page").alias("id"), "score", "text"), "hits")
    return semantic_grid_search(pages, hit(2 * limit, F.col("type").isin(places)), hit(3 * limit, None), limit)


def places_of(nodes: DataFrame, edges: DataFrame, systems: DataFrame, hops: int = 3, properties: tuple[str, ...] = LOCATION_LABELS) -> DataFrame:
    """id, place, region, col, row: of each node the nearest system over edges either way, itself not asked; of nodes that reach
    none within the hops, the first of their properties about places that names a system. systems: id, name, region, col, row."""
    place = systems.select(F.col("id").alias("at"), F.col("name").alias("place"), "region", "col", "row")
    near = nearest_location(edges, systems.select("id"), nodes.select("id"), hops).select("id", F.col("place").alias("at"))
    lost = nodes.join(near.select("id"), "id", "left_anti")
    said = F.flatten(F.transform(F.array(*[F.lit(p) for p in properties]), lambda p: F.coalesce(F.try_element_at("properties", p), F.array().cast("array<string>"))))
    named = lost.select("id", F.posexplode(said).alias("nth", "place")).join(place, "place").groupBy("id").agg(F.min(F.struct("nth", "at")).alias("x")).select("id", "x.at")
    return near.unionByName(named).join(place, "at").select("id", "place", "region", "col", "row")


def territory_by_year(years: DataFrame, affiliations: DataFrame, systems: DataFrame, **shares) -> DataFrame:
    """year, region, faction, share, contested: who held how much of each region in each of ``years``, by the systems'
    affiliations (id, faction, from_year, to_year; open bounds hold) that were in force."""
    held = affiliations.join(systems.where("region IS NOT NULL").select("id", "region"), "id").select("region", "faction", "from_year", "to_year")
    hits = point_in_span(years.select("year").distinct(), held, "year", "from_year", "to_year")
    return territory_control(hits.groupBy("year", "region", "faction").agg(F.count("*").alias("n")), **shares)


def year_mart(nodes: DataFrame, edges: DataFrame, systems: DataFrame, affiliations: DataFrame, eras: DataFrame, governments: DataFrame | None = None, hops: int = 3) -> DataFrame:
    """year_documents() from the graph alone: places by places_of(), and in each year that has a document the regions by
    territory_by_year()."""
    dated = nodes.where(F.col("start_year").isNotNull())
    places = kept(places_of(dated, edges, systems, hops), "places")
    years = events_by_year(dated).select("year")
    if governments is not None:
        years = years.unionByName(governments.select(F.explode(F.array("start_year", "end_year")).cast(years.schema["year"].dataType).alias("year")))
    regions = kept(territory_by_year(years.where("year IS NOT NULL"), affiliations, systems), "regions")
    return year_documents(dated, places, eras, governments, regions)
