"""Sinks that replace what was there. Those by folder must not read the folder that they replace."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import publish

#: Rows that a task verifies.
VERIFIED = 500_000


def replace(rows: DataFrame, path: str) -> None:
    """All old rows go, all new ones stand."""
    rows.write.mode("overwrite").parquet(path)


def replace_mart(rows: DataFrame, overview: DataFrame, path: str) -> publish.Publication:
    """A mart's rows and its one row of overview, which change together: readers take publish.current(spark, path)."""
    return publish.publish({"rows": rows, "overview": overview.coalesce(1)}, path)


def swap(rows: DataFrame, path: str, key: list[str], name: str = "rows") -> publish.Publication:
    """A table made anew beside the old one, which it follows only if no key is null or there twice. A task verifies about
    VERIFIED rows, whatever the table's size."""

    def verify(tables: dict[str, DataFrame]) -> str | None:
        parts = -(-tables[name].count() // VERIFIED) or 1  # the files' own counts
        bad = tables[name].repartition(parts, *key).groupBy(*key).count().where(" OR ".join([f"`{k}` IS NULL" for k in key] + ["count > 1"])).limit(1).count()
        return f"{key} is null or repeated" if bad else None

    return publish.publish({name: rows}, path, verify)


def replace_by(rows: DataFrame, column: str, path: str) -> None:
    """Rows in a folder for each value of a column; values that are no longer there lose theirs."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(column).parquet(path)
