"""Joins of points with spans, of any length and also open, by bins of powers of two.

A span is cut into the largest whole bins that fit: bin b of level k holds the points from b * 2^k to (b + 1) * 2^k - 1,
and a span of n points is at most 2 * log2(n) bins. A point is in one bin of each level. Joined by level and bin, a point meets
each of its spans exactly once, so the join is an equi-join whose rows are the hits, and no row is made for each year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points and bounds lie between -2^(LEVELS-1) and 2^(LEVELS-1) - 1; an open end is the last of these.
LEVELS = 32
_LOW, _HIGH = -(1 << (LEVELS - 1)), (1 << (LEVELS - 1)) - 1


def bins_of_span(start: Column, end: Column) -> Column:
    """array<struct<level, bin>>: the bins that are a span, both bounds included; null is open. None if end < start."""
    low = F.coalesce(start.cast("long"), F.lit(_LOW)) - F.lit(_LOW)
    high = F.coalesce(end.cast("long"), F.lit(_HIGH)) - F.lit(_LOW) + F.lit(1)

    def at(level: int) -> tuple[Column, Column]:
        """From the first bin that begins in the span to before the first that ends beyond it."""
        return F.shiftright(low + F.lit((1 << level) - 1), level), F.shiftright(high, level)

    made = []
    for level in range(LEVELS + 1):
        first, beyond = at(level)
        some = first < beyond
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        made.append(F.when(some & odd(first), F.struct(F.lit(level).alias("level"), first.alias("bin"))))
        made.append(F.when(some & odd(beyond), F.struct(F.lit(level).alias("level"), (beyond - 1).alias("bin"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def bins_of_point(at: Column) -> Column:
    """array<struct<level, bin>>: the bins that a point is in; none if it is null."""
    place = at.cast("long") - F.lit(_LOW)
    return F.when(at.isNotNull(), F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(place, k).alias("bin")) for k in range(LEVELS + 1)]))


def point_in_span(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, on: tuple[str, ...] = ()) -> DataFrame:
    """All columns of both, for each point and span that holds it, both bounds included, null bounds open. Columns in
    ``on`` must be equal too; other names must differ. Levels that no span has are not probed."""
    both = set(points.columns) & set(spans.columns) - set(on)
    if both:
        raise ValueError(f"columns of both sides: {sorted(both)}")
    cut = spans.withColumn("_bin", F.explode(bins_of_span(F.col(start), F.col(end))))
    probes = points.withColumn("_bin", F.explode(bins_of_point(F.col(at))))
    used = cut.select("_bin.level").distinct()  # LEVELS + 1 rows at most
    probes = probes.join(F.broadcast(used.withColumnRenamed("level", "_level")), F.col("_bin.level") == F.col("_level"), "left_semi")
    keys = ["_level", "_place", *on]
    flat = lambda df: df.withColumns({"_level": F.col("_bin.level"), "_place": F.col("_bin.bin")}).drop("_bin")
    return flat(probes).join(flat(cut), keys).drop("_level", "_place")


def sums_at_points(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, sums: list[str]) -> DataFrame:
    """``at`` and, under their own names, the sums of the spans' columns over all spans that hold each distinct point; points in no span are left
    out. Unlike point_in_span() no row is made for a hit: equal spans are added up first, then the spans of each bin, so that a point
    meets at most one row of each level."""
    add = lambda df, *by: df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    cut = add(spans.select(start, end, *sums), start, end).withColumn("_bin", F.explode(bins_of_span(F.col(start), F.col(end))))
    bins = add(cut.select(F.col("_bin.level").alias("_level"), F.col("_bin.bin").alias("_place"), *sums), "_level", "_place")
    probes = points.select(at).distinct().withColumn("_bin", F.explode(bins_of_point(F.col(at))))
    met = probes.select(at, F.col("_bin.level").alias("_level"), F.col("_bin.bin").alias("_place")).join(bins, ["_level", "_place"])
    return add(met, at)


def governments_in(years: DataFrame, governments: DataFrame) -> DataFrame:
    """year, id: the governments there were in each year (those without a start are in none)."""
    return point_in_span(years.select("year"), governments.where("start_year IS NOT NULL").select("id", "start_year", "end_year"), "year", "start_year", "end_year").select("year", "id")


def affiliations_in(years: DataFrame, edges: DataFrame) -> DataFrame:
    """year, from_id, to_id: the relations that held in each year, by their own bounds; those without any bound hold
    always."""
    return point_in_span(years.select("year"), edges.select("from_id", "to_id", "from_year", "to_year"), "year", "from_year", "to_year").select("year", "from_id", "to_id").distinct()
