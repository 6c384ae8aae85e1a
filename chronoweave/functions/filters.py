"""Predicates, one function each. Each returns a Column, so that Catalyst can push it down."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters that inputs lose, but tab, line feed and carriage return.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff]")


def sanitize(text: str | None) -> str | None:
    """User input without control characters and lone surrogates."""
    return None if text is None else _CONTROL.sub("", text)


def clamp(value: int | None, low: int, high: int, default: int | None = None) -> int:
    """A limit within bounds; with a default, one outside of them becomes the default."""
    if value is None:
        return default if default is not None else low
    if default is not None and not low <= value <= high:
        return default
    return max(low, min(high, value))


def always() -> Column:
    return F.lit(True)


def graph_continuity(column: str, wanted: str | None) -> Column:
    """Only Canon and Legends filter, and exactly."""
    return F.col(column) == wanted if wanted in ("Canon", "Legends") else always()


def timeline_continuity(column: str, wanted: str | None) -> Column:
    """The wanted one, or Both, or Unknown."""
    return F.col(column).isin(wanted, "Both", "Unknown") if wanted else always()


def category_continuity(column: str, wanted: str | None) -> Column:
    """Exactly the wanted one; without one all but Unknown."""
    return F.col(column) == wanted if wanted else F.col(column).isin("Canon", "Legends", "Both")


page_continuity = discovery_continuity = timeline_continuity


def name_continuity(column: str, wanted: str | None) -> Column:
    """The wanted one, or Both."""
    return F.col(column).isin(wanted, "Both") if wanted else always()


def node_realm(column: str, wanted: str | None) -> Column:
    """The wanted realm, or Unknown."""
    return F.col(column).isin(wanted, "Unknown") if wanted else always()


def edge_realm(direction: str, wanted: str | None) -> Column:
    """The far end's realm, by direction; a missing one passes."""
    column = F.col("to_realm" if direction == "out" else "from_realm")
    return column.isNull() | column.isin(wanted, "Unknown") if wanted else always()


def name_realm(column: str, wanted: str | None) -> Column:
    """The made-up realm means all but Real; Real means Real or Unknown."""
    if wanted is None:
        return always()
    return F.col(column).isin("Real", "Unknown") if wanted == "Real" else F.col(column) != "Real"


def exact_realm(column: str, wanted: str | None) -> Column:
    return F.col(column) == wanted if wanted else always()


def matches(column: str, pattern: str | None) -> Column:
    """Case-insensitive regular expression anywhere."""
    return F.col(column).rlike("(?i)" + sanitize(pattern)) if pattern else always()


def contains(column: str, literal: str | None) -> Column:
    """Case-insensitive literal anywhere."""
    return F.contains(F.lower(F.col(column)), F.lit(sanitize(literal).lower())) if literal else always()


def has_facet(column: str, semantic: str | None = None, calendar: str | None = None, first: int | None = None, last: int | None = None, exact: bool = False) -> Column:
    """One facet that fits all clauses: semantic prefix (or whole), calendar, years."""

    def fits(f: Column) -> Column:
        out = always()
        if semantic:
            s = F.lower(f.semantic)
            out &= s == semantic.lower() if exact else s.startswith(semantic.lower())
        if calendar:
            out &= f.calendar == calendar
        if first is not None:
            out &= f.year >= first
        if last is not None:
            out &= f.year <= last
        return out

    return F.exists(column, fits)


def sized(column: str) -> Column:
    """Whether an array has elements; null has none."""
    return F.coalesce(F.size(column), F.lit(0)) > 0


def has_link(data: str, href: str) -> Column:
    """Whether any field of an infobox links to a page."""
    return F.exists(data, lambda f: F.exists(f.Links, lambda x: F.lower(x.Href) == href.lower()))


def has_field(data: str, label: str) -> Column:
    return F.exists(data, lambda f: f.Label == label)


def fields(data: str, *labels: str) -> Column:
    """Only the fields of some labels."""
    return F.filter(data, lambda f: f.Label.isin(*labels))


def envelope_overlap(first: int, last: int, start: str = "start_year", end: str = "end_year") -> Column:
    """Nodes alive in a span: a null start fails, a null end is open."""
    return (F.col(start) <= last) & (F.col(end).isNull() | (F.col(end) >= first))


def edge_window(first: int | None, last: int | None, start: str = "from_year", end: str = "to_year") -> Column:
    """Edges that may hold in a span: nulls pass on either side."""
    out = always()
    if last is not None:
        out &= F.col(start).isNull() | (F.col(start) <= last)
    if first is not None:
        out &= F.col(end).isNull() | (F.col(end) >= first)
    return out


def active_at(year: Column | int, start: str = "from_year", end: str = "to_year") -> Column:
    """Edges that hold in one year; without a start always."""
    y = F.lit(year) if isinstance(year, int) else year
    return F.col(start).isNull() | ((y >= F.col(start)) & (F.col(end).isNull() | (y <= F.col(end))))


def linear_year(demarcation: str = "demarcation", year: str = "year") -> Column:
    """Years before the epoch are negative."""
    return F.when(F.col(demarcation) == "Bby", -F.col(year)).otherwise(F.col(year)).cast("double")


def linear_between(first: float, last: float) -> Column:
    return F.col("year").isNotNull() & linear_year().between(first, last)


def real_between(first: float, last: float, column: str = "real_year") -> Column:
    """Bounds are rounded half to even and put in order."""
    low, high = sorted((round(first), round(last)))
    return F.col(column).between(low, high)


def in_calendar(wanted: str, column: str = "calendar") -> Column:
    """A missing calendar is galactic."""
    return F.coalesce(F.col(column), F.lit("Galactic")) == wanted


def in_box(low_col: int, high_col: int, low_row: int, high_row: int) -> Column:
    return F.col("col").between(low_col, high_col) & F.col("row").between(low_row, high_row)
