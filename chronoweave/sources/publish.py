"""Tables that are published together: each version in a folder of its own, and one pointer that is replaced last.

A reader takes the pointer once and reads that version's tables, so it sees the old or the new ones whole, whatever a
writer does meanwhile. What was written but not pointed to is never read; it goes with ``clean``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .files import Files

POINTER = "_current.json"


class Publication:
    """One version of the tables in a folder."""

    def __init__(self, spark: SparkSession, path: str, pointer: dict):
        self.spark, self.path, self.version, self.names = spark, path, pointer["version"], pointer["tables"]

    def table(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(f"{name} is not among {self.names}")
        return self.spark.read.parquet(f"{self.path}/{self.version}/{name}")


def current(spark: SparkSession, path: str) -> Publication | None:
    """The version that the pointer names now; None if nothing has been published."""
    pointer = Files(spark).read(f"{path}/{POINTER}")
    return Publication(spark, path, pointer) if pointer else None


def publish(tables: dict[str, DataFrame], path: str, verify: Callable[[dict[str, DataFrame]], str | None] | None = None) -> Publication:
    """Write all tables, then point to them. They may be made from the version that they follow. ``verify`` gets them as
    written and tells what is wrong with them, if anything: then the old version stands, and ValueError is raised."""
    spark = next(iter(tables.values())).sparkSession
    files, version = Files(spark), f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{version}/{name}")
    if verify:
        wrong = verify({name: spark.read.parquet(f"{path}/{version}/{name}") for name in tables})
        if wrong:
            files.delete(f"{path}/{version}")
            raise ValueError(wrong)
    pointer = {"version": version, "tables": sorted(tables)}
    files.put(f"{path}/{POINTER}", pointer, over=True)
    return Publication(spark, path, pointer)


def clean(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
    """Delete versions but the current one, the ``keep`` newest, and those younger than ``older_than`` seconds, which a
    writer may be at. Readers of what is deleted fail, so keep as many as readers may be behind."""
    files, now = Files(spark), time.time_ns()
    found = [n for n in files.names(path) if n.startswith("v")]
    pointer = files.read(f"{path}/{POINTER}")
    gone = [n for n in found[: max(0, len(found) - keep)] if n != (pointer or {}).get("version") and int(n[1:21]) < now - older_than * 1e9]
    for name in gone:
        files.delete(f"{path}/{name}")
    return gone
