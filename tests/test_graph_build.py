"""The test graph is made with narrow exchanges, and what reads it does not sort or copy it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import analytics
from chronoweave.operators import graph as P
from chronoweave.plans import catalog
from chronoweave.sources import sinks
from chronoweave.sources import testgraph as G


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_made_without_all_nodes(spark, small, monkeypatch):
    """Ends are found in the tables that they are in, and no ranges are sampled, for which all edges would be made twice."""
    monkeypatch.setattr(G, "nodes", None)
    assert "rangepartitioning" not in _plan(G.made_edges(spark, small))


def test_edges_against_plain_joins(spark, small, tmp_path):
    """Also where ends are missing: orders and parts are read without some rows."""
    for name in G.MADE_FROM:
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        rows = rows.where("o_orderkey % 11 <> 0") if name == "orders" else rows.where("p_partkey % 7 <> 0") if name == "part" else rows
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    ends = G.made_nodes(spark, str(tmp_path)).select("id", "name", "type", "realm")
    want = G.bare_edges(spark, str(tmp_path))
    for side in ("from", "to"):
        want = want.join(ends.select(*[F.col(c).alias(f"{side}_{c}") for c in ends.columns]), f"{side}_id", "left")
    got = G.made_edges(spark, str(tmp_path)).select(want.columns)
    assert got.where("from_type IS NULL").count() and got.where("to_name IS NULL").count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_label_statistics_do_not_sort_the_edges(spark):
    columns = "from_id long, to_id long, label string, weight double, continuity string, from_name string, to_name string, from_type string, to_type string"
    rows = [(2, 1, "a", 1.0, "Canon", "two", "one", "T", "U"), (1, 9, "a", 0.5, "Canon", "one", "nine", "S", "U"), (1, 3, "a", 0.5, None, "one", "three", "T", "T"), (7, 7, None, 1.0, "Canon", "seven", None, None, "U")]
    found = analytics.edge_label_statistics(spark.createDataFrame(rows, columns))
    assert {r.label: (r["count"], r.sample_from, r.sample_to) for r in found.collect()} == {"a": (3, "one", "three"), None: (1, "seven", None)}
    whole = _plan(found)
    grouped = [line for line in whole.splitlines() if "SortAggregate" in line and "from_type" in line]
    assert not grouped


def test_stronger_labels_copy_nothing(spark, small, monkeypatch):
    G.edges(spark, small), G.nodes(spark, small)
    monkeypatch.setattr(P, "kept", None)
    assert catalog.QUERIES["stronger_labels"](spark, small).count() == 3


def test_a_hop_is_capped_over_both_directions(spark):
    """As in the view of both directions: 600 sources and one target are 500 steps in all."""
    columns = "from_id long, to_id long, label string, reverse_label string, weight double, continuity string, from_year int, to_year int, from_realm string, to_realm string"
    rows = [(i, 5, "in", "has", 1.0, "Canon", None, None, "Real", "Real") for i in range(100, 700)] + [(5, 1, "of", "holds", 1.0, "Canon", None, None, "Real", "Real")]
    nodes, _ = P.neighbourhood(spark.createDataFrame(rows, columns), 5, None, 1, max_nodes=1000)
    got = [r.id for r in nodes.where("depth = 1").orderBy("id").collect()]
    assert got == [1, *range(100, 599)]


def test_parts_grow_with_the_items(spark, small, monkeypatch):
    """A task's rows stay as many at any size: ten times the parts are dealt where there are ten times the bytes for each."""
    monkeypatch.setattr(G, "PART_BYTES", 1000)
    most = 2 * G.parts(spark, small)
    assert most > 8 * spark.sparkContext.defaultParallelism
    assert "hashpartitioning(from_id#" in (plan := _plan(catalog.QUERIES["duplicate_edges"](spark, small))) and f", {most})" in plan
    assert f", {most // 2})" in _plan(G.made_nodes(spark, small))


def test_a_swap_is_verified_in_parts(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(sinks, "VERIFIED", 10)
    own = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: asked.append(a[0]) or own(self, *a))
    assert sinks.swap(spark.range(95), f"{tmp_path}/t", ["id"]).table("rows").count() == 95 and 10 in asked
    with pytest.raises(ValueError):
        sinks.swap(spark.range(9).union(spark.range(1)), f"{tmp_path}/t", ["id"])
