"""Reads over pages with infoboxes: by field, value, link; samples; bundles of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import filters as where
from .build import type_of

DATA = "infobox.Data"


def of_type(pages: DataFrame, kind: str) -> DataFrame:
    return pages.where(type_of(F.col("infobox.Template")) == kind)


def infobox_types(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("infobox").isNotNull()).select(type_of(F.col("infobox.Template")).alias("type")).distinct()


def label_usage(pages: DataFrame, kind: str) -> DataFrame:
    """label and n: how many pages of a type have each field."""
    rows = of_type(pages, kind).select("pageId", F.explode(F.array_distinct(F.transform(DATA, lambda f: f.Label))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def sample_values(pages: DataFrame, kind: str, label: str, most: int = 30) -> DataFrame:
    """The most frequent values of a field."""
    rows = of_type(pages, kind).select(F.explode(where.fields(DATA, label)).alias("f")).select(F.explode("f.Values").alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def link_labels(pages: DataFrame, kind: str, most: int = 50) -> DataFrame:
    """label and n: rows with links of each field."""
    rows = of_type(pages, kind).select(F.explode(DATA).alias("f")).where(F.size("f.Links") > 0)
    return rows.groupBy(F.col("f.Label").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)


def by_value(pages: DataFrame, label: str, text: str) -> DataFrame:
    """Pages where a field has a value with a text in it, whatever the case."""
    hit = F.exists(DATA, lambda f: (f.Label == label) & F.exists(f.Values, lambda v: F.contains(F.lower(v), F.lit(text.lower()))))
    return pages.where(hit)


def by_link(pages: DataFrame, href: str) -> DataFrame:
    return pages.where(where.has_link(DATA, href))


def without_field(pages: DataFrame, label: str) -> DataFrame:
    """Pages with an infobox that hasn't a field."""
    return pages.where(F.col("infobox").isNotNull() & ~F.coalesce(where.has_field(DATA, label), F.lit(False)))


def half_and_half(rows: DataFrame, side: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """A repeatable random sample: half of each side, the rest filled from the other, in turn. Order is by a hash of
    the key, so that a side's first n come from a sort that keeps n rows a task."""
    spot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    taken = [rows.where(F.col(side) == s).withColumn("_spot", spot).orderBy("_spot").limit(n) for s in (True, False)]
    ranked = [t.withColumn("_turn", F.row_number().over(Window.orderBy("_spot"))).withColumn("_side", F.lit(i)) for i, t in enumerate(taken)]  # n rows each
    return ranked[0].unionByName(ranked[1]).orderBy("_turn", "_side").limit(n).drop("_spot", "_turn", "_side")


def bundles(rows: DataFrame, group: str, order: list[str], size: Column, most: int = 40_000) -> DataFrame:
    """Adds bundle: rows of a group in order, a new bundle where the next one would go beyond ``most``. The sum starts
    anew with each bundle, so rows are walked in order; a task holds one batch."""
    sized = rows.withColumn("_size", size.cast("long")).withColumn("bundle", F.lit(0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, bundle, total = None, 0, 0
        for f in frames:
            out = []
            for g, s in zip(f[group], f["_size"], strict=True):
                if g != own:
                    own, bundle, total = g, 0, 0
                elif total + s > most and total:
                    bundle, total = bundle + 1, 0
                total += s
                out.append(bundle)
            yield f.assign(bundle=out)

    return sized.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, sized.schema).drop("_size")


def viewport(systems: DataFrame, bodies: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Systems in a box of cells with the names of the bodies that orbit them."""
    inside = systems.where(where.in_box(*box))
    near = bodies.join(inside.select(F.col("id").alias("system")), "system", "left_semi").groupBy(F.col("system").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("bodies"), F.count("*").alias("n"))
    return inside.join(near, "id", "left").select("id", "name", "col", "row", "region", F.coalesce("bodies", F.lit("")).alias("bodies"), F.coalesce("n", F.lit(0)).alias("n"))


def controlled(affiliations: DataFrame, first: int, last: int) -> DataFrame:
    """year, region, faction, n from dated affiliations: one row for each year of a span an affiliation holds in."""
    start = F.greatest(F.coalesce("from_year", F.lit(first)), F.lit(first))
    end = F.least(F.coalesce("to_year", F.lit(last)), F.lit(last))
    years = affiliations.where(start <= end).withColumn("year", F.explode(F.sequence(start, end)))
    return years.groupBy("year", "region", "faction").agg(F.count("*").alias("n"))
