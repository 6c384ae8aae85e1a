"""Timelines, maps and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import filters as where
from ..functions import timecal


def page(events: DataFrame, templates: list[str] | None, continuity: str | None, calendar: str, first: float, last: float, number: int, size: int) -> DataFrame:
    """One page of the union of categories in order of the linear year, with the total and a display year."""
    rows = events.where(where.timeline_continuity("continuity", continuity))
    rows = rows.where(F.col("template").isin(templates)) if templates else rows
    if calendar == "Real":
        rows, year = rows.where(where.in_calendar("Real") & where.real_between(first, last)), F.col("real_year").cast("double")
    else:
        rows, year = rows.where(where.in_calendar("Galactic") & where.linear_between(first, last)), where.linear_year()
    rows = rows.withColumn("linear_year", year)
    out = rows.orderBy("linear_year", "event_id").offset((max(1, number) - 1) * size).limit(size)
    return out.withColumn("total", rows.agg(F.count("*").alias("total")).scalar())


def by_year(rows: DataFrame, most: int) -> DataFrame:
    """year, n, and the titles of the first ``most`` events."""
    w = Window.partitionBy("linear_year").orderBy("event_id")
    first = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    titles = first.groupBy("linear_year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x.title), "; ").alias("titles"))
    return rows.groupBy("linear_year").agg(F.count("*").alias("n")).join(titles, "linear_year")


def category_page(events: DataFrame, template: str, continuity: str | None, number: int, size: int, legacy: bool = True) -> DataFrame:
    """One category. The legacy order pages by the demarcation's text, then the year, and sorts the page by time."""
    rows = events.where((F.col("template") == template) & where.category_continuity("continuity", continuity)).withColumn("linear_year", where.linear_year())
    order = ["demarcation", "year", "event_id"] if legacy else ["linear_year", "event_id"]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).orderBy("linear_year", "event_id")


def eras(events: DataFrame, title: Column) -> DataFrame:
    """Titles without their suffix, with their first and last linear years."""
    year = where.linear_year()
    return events.groupBy(F.regexp_replace(title, "/Legends$", "").alias("era")).agg(F.min(year).alias("first"), F.max(year).alias("last"), F.count("*").alias("n"))


def expand_years(rows: DataFrame, start: str, end: str, longest: int = 100) -> DataFrame:
    """A row for every year of spans up to ``longest`` years; longer ones count at their start."""
    last = F.when(F.col(end).isNull() | (F.col(end) < F.col(start)) | (F.col(end) - F.col(start) > longest), F.col(start)).otherwise(F.col(end))
    return rows.where(F.col(start).isNotNull()).withColumn("year", F.explode(F.sequence(F.col(start), last)))


def build_rows(facets: DataFrame) -> DataFrame:
    """Timeline rows of facets with a year: magnitude and side; year 0 is after the epoch; the field Date has no name."""
    return facets.where(F.col("year").isNotNull()).select("id", F.when(F.col("field") == "Date", "").otherwise(F.col("field")).alias("field"), F.abs("year").cast("float").alias("year"), F.when(F.col("year") < 0, "Bby").otherwise("Aby").alias("demarcation"))


def anchor(start: Column, end: Column, kind: Column) -> Column:
    """first, last and label of a node's life; a missing bound is the other one."""
    label = F.when(kind.isin("Battle", "War"), "Fought").when(kind == "Character", "Lived").otherwise("Existed")
    return F.struct(F.coalesce(start, end).alias("first"), F.coalesce(end, start).alias("last"), label.alias("label"))


def grid_square(text: Column) -> Column:
    """col and row (from 0) of squares A-1 to Z-20, blanks allowed; null for anything else."""
    letter, number = F.regexp_extract(F.upper(text), r"^\s*([A-Z])\s*-\s*(\d{1,2})\s*$", 1), F.regexp_extract(text, r"^\s*[A-Za-z]\s*-\s*(\d{1,2})\s*$", 1)
    n = F.when(number != "", number).cast("int")
    return F.when((letter != "") & n.between(1, 20), F.struct((F.ascii(letter) - 65).alias("col"), (n - 1).alias("row")))


def heat_map(events: DataFrame, most: int = 15) -> DataFrame:
    """col, row, count of all events of a cell, and its first ``most`` titles by time."""
    w = Window.partitionBy("col", "row").orderBy("linear_year", "event_id")
    first = events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    kept = first.groupBy("col", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x.title), ";").alias("titles"))
    return events.groupBy("col", "row").agg(F.count("*").alias("count")).join(kept, ["col", "row"])


def sparse_hint(total: int, categorical: bool, labels: list[tuple[str, int]]) -> list[str]:
    """For a property with few values: up to three labels that say more."""
    if categorical or total >= 20:
        return []
    return [x for x, n in sorted(labels, key=lambda p: (-p[1], p[0])) if n >= max(5 * total, 10)][:3]


def nearest_available(years: DataFrame, wanted: int, most: int = 5) -> DataFrame:
    return years.orderBy(F.abs(F.col("year") - wanted), "year").limit(most)


def display(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shown", timecal.mart_display(F.col("year")))
