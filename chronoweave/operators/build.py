"""Building the graph from pages with infoboxes: types, facets, properties, edges, links, incremental changes.

Pages have infobox.Template and infobox.Data, an array of (Label, Values, Links of (Content, Href)).
"""

from __future__ import annotations

from collections.abc import Iterator

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timecal

INFOBOX = "struct<Template:string,ImageUrl:string,Data:array<struct<Label:string,Values:array<string>,Links:array<struct<Content:string,Href:string>>>>>"
DEFAULT_WEIGHT, FALLBACK = 0.8, 0.8
#: Full batches of exported lines that are walked in one task.
PER_STRETCH = 16


@dataclass
class Rules:
    """What fields mean. temporal: field -> (semantic, calendar, is_range); relations: field -> (label, reverse,
    weight, target types); whitelist: template -> fields, others unknown to it; a null template knows all."""

    temporal: dict[str, tuple[str, str, bool]] = field(default_factory=dict)
    properties: set[str] = field(default_factory=set)
    relations: dict[str, tuple[str, str, float, tuple[str, ...]]] = field(default_factory=dict)
    whitelist: dict[str, set[str]] | None = None


def type_of(template: Column) -> Column:
    """What follows the last colon of a template; none is Unknown."""
    return F.when(template.isNull() | ~F.contains(template, F.lit(":")), "Unknown").otherwise(F.substring_index(template, ":", -1))


def snake_case(label: Column) -> Column:
    """A field's label as an edge label."""
    clean = F.trim(F.replace(F.replace(F.replace(label, F.lit("(s)"), F.lit("")), F.lit("("), F.lit("")), F.lit(")"), F.lit("")))
    parted = F.regexp_replace(clean, r"(?<=[^\p{Lu} \-/])(?=\p{Lu})", "_")
    # a capital after a separator gets a mark of its own too
    parted = F.regexp_replace(parted, r"(?<=[ \-/])(?=\p{Lu})", "_")
    return F.regexp_replace(F.lower(F.regexp_replace(parted, r"[ \-/]", "_")), r"^_+|_+$", "")


def fields(pages: DataFrame, rules: Rules) -> DataFrame:
    """One row for each field of a page, with its class: temporal, property or relation.

    Temporal rules come first, then properties; a field without a rule is a property if it has no links, else a
    relation by its own name."""
    rows = pages.where(F.col("infobox").isNotNull()).select(
        F.col("pageId").alias("id"), "title", "continuity", type_of(F.col("infobox.Template")).alias("type"), F.posexplode(F.coalesce("infobox.Data", F.expr("array()").cast("array<struct<Label:string,Values:array<string>,Links:array<struct<Content:string,Href:string>>>>"))).alias("pos", "f")
    ).select("id", "title", "continuity", "type", "pos", F.col("f.Label").alias("field"), F.coalesce("f.Values", F.array().cast("array<string>")).alias("values"), F.coalesce("f.Links", F.array().cast("array<struct<Content:string,Href:string>>")).alias("links")).where(F.col("field").isNotNull())
    known = F.lit(True)
    if rules.whitelist is not None:
        known = F.col("type") == "Unknown"
        for template, names in rules.whitelist.items():
            known = known | ((F.col("type") == template) & F.col("field").isin(*names))
    temporal, relation = known & F.col("field").isin(*rules.temporal), known & F.col("field").isin(*rules.relations)
    property_ = known & F.col("field").isin(*rules.properties)
    kind = F.when(temporal, "temporal").when(property_, "property").when(relation & (F.size("links") > 0), "relation").when(F.size("links") == 0, "property").otherwise("fallback")
    return rows.withColumn("kind", kind)


def _picked(names: dict, column: str, default=None) -> Column:
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def facets(rows: DataFrame, rules: Rules) -> DataFrame:
    """id, field, semantic, calendar, year, text, pos of temporal fields; blank values have none."""
    t = rows.where("kind = 'temporal'").select("id", "pos", "field", F.posexplode("values").alias("at", "text")).where(F.trim("text") != "")
    t = t.select("*", _picked({k: v[0] for k, v in rules.temporal.items()}, "field", "").alias("base"), _picked({k: v[1] for k, v in rules.temporal.items()}, "field", "auto").alias("hint"), _picked({k: v[2] for k, v in rules.temporal.items()}, "field", False).alias("ranged"))
    found = timecal.years(F.col("text"), F.col("hint"))
    one = F.array(F.struct(F.col("base").alias("semantic"), found.calendar.alias("calendar"), F.try_element_at(found.years, F.lit(1)).alias("year")))
    many = F.transform(timecal.range_facets(timecal.epoch_years(F.col("text"))), lambda x: F.struct(F.concat_ws(".", "base", x.role).alias("semantic"), F.lit("galactic").alias("calendar"), x.year.alias("year")))
    made = t.select("id", "field", "text", (F.col("pos") * 1_000_000 + F.col("at") * 1_000).alias("pos"), F.posexplode(F.when(F.col("ranged"), many).otherwise(one)).alias("k", "f"))
    return timecal.facet_order(made.select("id", "field", "f.semantic", "f.calendar", "f.year", "text", (F.col("pos") + F.col("k")).alias("pos")))


def link_targets(pages: DataFrame) -> DataFrame:
    """key -> target id: urls and titles of pages in one lower-cased keyspace; of equal keys the first page's counts."""
    keys = pages.select(F.col("pageId").alias("target"), F.explode(F.array(F.lower("wikiUrl"), F.lower("title"))).alias("key")).where(F.col("key").isNotNull())
    return keys.groupBy("key").agg(F.min("target").alias("target"))


def slug(href: Column) -> Column:
    """The title that a page's address stands for: what follows /wiki/, decoded, blanks for underscores."""
    raw = F.replace(F.regexp_extract(href, r"/wiki/([^?#]*)", 1), F.lit("+"), F.lit("%2B"))
    return F.lower(F.replace(F.coalesce(F.try_url_decode(raw), raw), F.lit("_"), F.lit(" ")))


def resolve(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds target to rows of Content and Href: by address, else by text, else by the decoded address."""
    keyed = links.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode(F.array(F.lower("Href"), F.lower("Content"), slug(F.col("Href")))).alias("_step", "key"))
    hit = keyed.join(targets, "key", "left")
    return hit.groupBy(*[c for c in links.columns], "_row").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("_step"))).alias("target")).drop("_row")


def primary_links(values: Column, links: Column) -> Column:
    """For each value its links: the one named before a bracket, or by the whole value, or all named inside; with the
    bracket's text and up to two years of it."""

    def of(value: Column, order: Column) -> Column:
        bracket = F.instr(value, "(")
        name = F.regexp_replace(F.trim(F.when(bracket > 1, F.substring(value, F.lit(1), bracket - 1)).otherwise(value)), ",+$", "")
        inner = F.when(bracket > 1, F.nullif(F.regexp_extract(value, r"(?s)\((.*)\)", 1), F.lit("")))
        qualifier = F.when((bracket > 1) & value.rlike(r"(?s)\(.*\)"), F.trim(F.coalesce(inner, F.lit(""))))
        years = timecal.epoch_years(F.coalesce(qualifier, F.lit("")))
        made = lambda link, q, y: F.struct(link.Content.alias("Content"), link.Href.alias("Href"), q.alias("qualifier"), F.try_element_at(y, F.lit(1)).alias("from_year"), F.try_element_at(y, F.lit(2)).alias("to_year"), F.trim(value).alias("raw"), order.alias("order"))
        exact = F.filter(links, lambda x: F.lower(x.Content) == F.lower(name))
        whole = F.filter(links, lambda x: F.lower(x.Content) == F.lower(F.trim(value)))
        inside = F.filter(links, lambda x: (x.Content != "") & F.contains(F.lower(name), F.lower(x.Content)))
        none, no_years = F.lit(None).cast("string"), F.array().cast("array<int>")
        return (
            F.when(F.trim(value) == "", F.slice(F.transform(links, lambda x: made(x, none, no_years)), 1, 0))
            .when(F.size(exact) > 0, F.transform(F.slice(exact, 1, 1), lambda x: made(x, qualifier, years)))
            .when(F.size(whole) > 0, F.transform(F.slice(whole, 1, 1), lambda x: made(x, none, no_years)))
            .otherwise(F.transform(inside, lambda x: made(x, qualifier, years)))
        )

    return F.flatten(F.transform(values, of))


def edges(rows: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """from_id, to_id, label, weight, evidence, qualifier, raw, order, years, from resolved relations."""
    r = rows.where("kind in ('relation', 'fallback')").select("id", "title", "continuity", "type", "field", "kind", F.explode(primary_links(F.col("values"), F.col("links"))).alias("link"))
    r = r.select("id", "title", "continuity", "type", "field", "kind", "link.*")
    found = resolve(r, link_targets(pages)).where(F.col("target").isNotNull() & (F.col("target") != F.col("id")))
    label = F.coalesce(_picked({k: v[0] for k, v in rules.relations.items()}, "field"), snake_case(F.col("field")))
    weight = F.coalesce(_picked({k: v[2] for k, v in rules.relations.items()}, "field"), F.lit(DEFAULT_WEIGHT)) * F.when(F.col("kind") == "fallback", FALLBACK).otherwise(1.0)
    return found.select(
        F.col("id").alias("from_id"), F.col("title").alias("from_name"), F.col("type").alias("from_type"), F.col("target").alias("to_id"), F.col("Content").alias("to_name"), label.alias("label"), F.round(weight, 6).alias("weight"),
        F.concat_ws(": ", "field", "raw").alias("evidence"), "continuity", "qualifier", F.when(F.col("qualifier").isNotNull() | (F.col("raw") != F.col("Content")), F.col("raw")).alias("raw"), "order", "from_year", "to_year",
    )


def drop_noise(edges_: DataFrame, types: DataFrame, person_labels: set[str]) -> DataFrame:
    """Edges without those to years, eras, and, for labels of persons, to titles and abilities."""
    kind = F.coalesce("to_type", F.lit("Unknown"))
    person = F.col("label").isin(*person_labels) if person_labels else F.lit(False)
    typed = edges_.join(types.select(F.col("id").alias("to_id"), F.col("type").alias("to_type")), "to_id", "left")
    return typed.where(~kind.isin("Year", "Era") & ~(person & kind.isin("TitleOrPosition", "ForcePower", "LightsaberForm")))


def ordered_ids(edges_: DataFrame, labels: list[str]) -> DataFrame:
    """id, key (label and Ids) and the targets in the order of their values."""
    rows = edges_.where(F.col("label").isin(labels)).groupBy(F.col("from_id").alias("id"), F.concat("label", F.lit("Ids")).alias("key")).agg(F.array_sort(F.collect_list(F.struct("order", "to_id"))).alias("x"))
    return rows.select("id", "key", F.transform("x", lambda v: v.to_id).alias("ids"))


def content_hash(*columns: str) -> Column:
    """SHA-256 over columns; a null is told from an empty text."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def changed(new: DataFrame, old: DataFrame, key: str, *columns: str) -> DataFrame:
    """key and what happened: added, changed or removed."""
    h = lambda df, n: df.select(key, content_hash(*columns).alias(n))
    both = h(new, "new").join(h(old, "old"), key, "full_outer").where(~F.col("new").eqNullSafe(F.col("old")))
    return both.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All new rows, and the old ones whose key isn't among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_keeping(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """A full merge where old non-empty texts of some columns stay."""
    o = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    joined = new.join(o, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.nullif(f"_old_{c}", F.lit("")), c, F.lit("")).alias(c) if c in keep else F.col(c) for c in new.columns if c != key])


def release_stale(states: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Crawl states: those in work for longer go back to pending."""
    stale = (F.col("status") == "Processing") & (F.col("processed_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return states.withColumn("status", F.when(stale, "Pending").otherwise(F.col("status")))


def export_batches(rows: DataFrame, key: str, line: str, most_bytes: int = 150 << 20, most_rows: int = 500, stretches: int | None = None) -> DataFrame:
    """key, line and batch: JSON lines in files by size and number. Lines of a stretch are walked by key; a batch ends
    with ``most_rows`` lines or with the line that brings it to ``most_bytes``, so none is over by more than a line.
    Stretches of keys (by hash) are walked apart; each ends with a file that may not be full, so without a given number there is one
    for PER_STRETCH full batches, which the rows and bytes tell. Python sees stretches and sizes, never the lines."""
    if stretches is None:
        all_ = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(line)), F.lit(0)).alias("bytes")).first()
        stretches = max(1, round(max(all_["n"] / most_rows, all_["bytes"] / most_bytes) / PER_STRETCH))

    @F.pandas_udf("string")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own, part, lines, size = None, 0, 0, 0
        for stretches_, sizes in batches:
            out = []
            for stretch, n in zip(stretches_, sizes, strict=True):
                if stretch != own:
                    own, part, lines, size = stretch, 0, 0, 0
                elif lines >= most_rows or size >= most_bytes:
                    part, lines, size = part + 1, 0, 0
                lines, size = lines + 1, size + n
                out.append(f"{stretch}-{part}")
            yield pd.Series(out, dtype=object)

    sized = rows.select(key, line, F.pmod(F.xxhash64(key), F.lit(stretches)).cast("long").alias("stretch"), F.coalesce(F.octet_length(line), F.lit(0)).cast("long").alias("size"))
    dealt = sized.repartition("stretch").sortWithinPartitions("stretch", key, line)
    # the order of rows counts, which only a function that is not deterministic tells Spark
    return dealt.select(key, line, walk.asNondeterministic()("stretch", "size").alias("batch"))


def import_lines(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines) of JSON lines."""
    parsed = lines.select(column, F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("row"))
    bad = F.col("row").isNull() | F.col("row._broken").isNotNull()
    return parsed.where(~bad).select("row.*").drop("_broken"), parsed.where(bad).select(column)


def store_edges(old: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered edges with clean labels that are new, no loops, and their reverses. Of several of one key the heaviest
    is taken, then the highest in the other columns."""
    clean = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    new = offered.where("from_id <> to_id").withColumns({"label": clean("label"), "reverse_label": clean("reverse_label")})
    key = ["from_id", "to_id", "label"]
    rest = [c for c in offered.columns if c not in key]
    total = F.struct(*[F.col(c) for c in (["weight"] if "weight" in rest else []) + [c for c in rest if c != "weight"]])
    new = new.groupBy(*key).agg(F.max(total).alias("best")).select(*key, "best.*") if rest else new.distinct()
    new = new.join(old.select("from_id", "to_id", "label"), ["from_id", "to_id", "label"], "left_anti").select(*offered.columns)
    turned = {"from_id": "to_id", "to_id": "from_id", "label": "reverse_label", "reverse_label": "label"}
    back = new.where("reverse_label <> ''").select(*[F.col(turned.get(c, c)).alias(c) for c in offered.columns])
    return new.unionByName(back).dropDuplicates(["from_id", "to_id", "label"])


def label_similarity(labels: DataFrame, wanted: str) -> DataFrame:
    """label and score against a wanted one: equal 1, contained 0.8, same stem 0.7, a stem in the other 0.5, else 0.4
    times the Jaccard of characters; above 0.3, the five best. A stem is without final s, then without _of and _by."""
    want, own = F.lit(wanted.lower()), F.lower("label")
    stem = lambda c: F.replace(F.replace(F.regexp_replace(c, "s+$", ""), F.lit("_of")), F.lit("_by"))
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    jaccard = F.size(F.array_intersect(chars(want), chars(own))) / F.size(F.array_union(chars(want), chars(own)))
    inside = lambda a, b: F.contains(a, b) | F.contains(b, a)
    score = F.when(own == want, 1.0).when(inside(own, want), 0.8).when(stem(own) == stem(want), 0.7).when(inside(stem(own), stem(want)), 0.5).otherwise(0.4 * jaccard)
    return labels.select("label", F.round(score, 6).alias("score")).where("score > 0.3").orderBy(F.desc("score"), "label").limit(5)
