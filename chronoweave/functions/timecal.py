"""The time model: year texts, facets, envelopes, buckets, display. All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How years before and after the epoch, and common-era years, are written.
EPOCH_YEAR = r"(?i)(\d[\d,]*)\s*(BBY|ABY)"
COMMON_YEAR = r"\b(1[89]\d{2}|20[0-3]\d)\b"


def epoch_years(text: Column) -> Column:
    """All years of a text in sort order of writing: before the epoch negative, after it positive."""
    numbers, sides = F.regexp_extract_all(text, F.lit(EPOCH_YEAR), 1), F.regexp_extract_all(text, F.lit(EPOCH_YEAR), 2)
    signed = lambda n, s: F.when(F.upper(s) == "BBY", -F.replace(n, F.lit(",")).cast("int")).otherwise(F.replace(n, F.lit(",")).cast("int"))
    return F.zip_with(numbers, sides, signed)


def common_years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(COMMON_YEAR), 1), lambda x: x.cast("int"))


def years(text: Column, hint: Column) -> Column:
    """calendar and years of a text: galactic and real hints are forced, auto tries galactic, then real."""
    epoch, common = epoch_years(text), common_years(text)
    found = lambda name, ys: F.struct(F.lit(name).alias("calendar"), ys.alias("years"))
    auto = F.when(F.size(epoch) > 0, found("galactic", epoch)).when(F.size(common) > 0, found("real", common)).otherwise(found("unknown", F.array().cast("array<int>")))
    return F.when(hint == "galactic", found("galactic", epoch)).when(hint == "real", found("real", common)).otherwise(auto)


def range_facets(years_: Column) -> Column:
    """Roles for the years of a range field: none or one is a point, else start, mids and end, in order."""
    own = F.array_sort(F.array_distinct(years_))
    role = lambda y, i: F.when(F.size(own) == 1, "point").when(i == 0, "start").when(i == F.size(own) - 1, "end").otherwise("mid")
    made = F.transform(own, lambda y, i: F.struct(role(y, i).alias("role"), y.alias("year")))
    return F.when(F.size(own) > 0, made).otherwise(F.array(F.struct(F.lit("point").alias("role"), F.lit(None).cast("int").alias("year"))))


def facet_order(facets: DataFrame, key: str = "id", position: str = "pos") -> DataFrame:
    """Adds order: within a page and dimension, facets with years first, by year, else as they came."""
    w = Window.partitionBy(key, F.substring_index("semantic", ".", 1)).orderBy(F.col("year").asc_nulls_last(), position)
    return facets.withColumn("order", F.row_number().over(w) - 1)


def envelope(facets: DataFrame, key: str = "id") -> DataFrame:
    """start_year and end_year of each page, and the texts of the first such facets."""
    role = F.substring_index("semantic", ".", -1)
    starts, ends = role.isin("start", "point", "release"), role.isin("end", "point")
    pick = lambda fits: F.min_by(F.when(fits, F.col("text")), F.when(fits, F.col("pos")))
    return facets.groupBy(key).agg(F.min(F.when(starts, F.col("year"))).alias("start_year"), F.max(F.when(ends, F.col("year"))).alias("end_year"), pick(starts).alias("start_text"), pick(ends).alias("end_text"))


def bucket(year: Column, size: int) -> Column:
    """The bucket a year is in; years before the epoch go down, not towards zero."""
    return (F.floor(year / size) * size).cast("int")


def mart_display(year: Column) -> Column:
    """In marts year 0 is before the epoch."""
    return F.when(year <= 0, F.concat(F.abs(year), F.lit(" BBY"))).otherwise(F.concat(year, F.lit(" ABY")))


def analytics_display(year: Column) -> Column:
    return F.when(year < 0, F.concat(F.abs(year), F.lit(" BBY"))).when(year == 0, "0 BBY/ABY").otherwise(F.concat(year, F.lit(" ABY")))
