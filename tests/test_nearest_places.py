"""Nearest places against a walk in Python; the walk from places makes no row for each pair of start and node."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import characters, graph


@pytest.mark.parametrize("start_counts", [False, True])
def test_nearest_against_a_walk(spark, start_counts):
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(55)] + [(70, 70), (71, 72), (72, 71)] + [(100, k) for k in range(101, 140)]
    located, starts = {*rng.sample(range(60), 8), 71, 101}, [*range(0, 60, 2), *rng.sample(range(60), 9), 70, 71, 72, 101, 139, 999]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in set(starts):
        seen = level = {s}
        for depth in range(4):
            hit = {x for x in level if x in located and (start_counts or depth)}
            if hit:
                want[s] = (min(hit), depth)
                break
            level = {y for x in level for y in near.get(x, ())} - seen
            seen = seen | level
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = graph.nearest_location(spark.createDataFrame(pairs, "from_id long, to_id long"), one(located), one(starts), 3, start_counts).collect()
    assert {r.id: (r.place, r.depth) for r in got} == want and len(got) == len(want)


def test_a_hub_is_not_walked_by_each_start(spark, tmp_path, monkeypatch):
    """A thousand starts around a hub without a place: a walk of each start would keep a million pairs."""
    written = []
    real = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: written.append(real(df, name)) or written[-1])
    edges = spark.range(1, 1001).select(F.col("id").alias("from_id"), F.lit(0).cast("long").alias("to_id")).unionByName(spark.range(1, 2).select(F.lit(5000).cast("long").alias("from_id"), F.lit(5001).cast("long").alias("to_id")))
    got = graph.nearest_location(edges, spark.range(5001, 5002), spark.range(1, 1001), 2)
    assert got.count() == 0 and max(w.count() for w in written) <= 2002


def test_edges_of_no_character_are_left_before_any_exchange(spark):
    events = spark.createDataFrame([(1, 500, None, " ", ["b"]), (2, 502, None, "c", None)], "event_id long, character_id long, year double, location string, related array<string>")
    edges = spark.createDataFrame([(1, 500, "l", "b", "x", 7, None), (502, 2, "l", "y", "c", None, 9), (1, 2, "l", "b", "c", 3, 3)], "from_id long, to_id long, label string, from_name string, to_name string, from_year int, to_year int")
    nodes = spark.createDataFrame([(1, "b", 1, None)], "id long, name string, start_year int, end_year int")
    made = characters.infer_years(events, edges, nodes)
    assert {(r.event_id, r.year) for r in made.collect()} == {(1, 7), (2, 9)}
    assert "500" in made._jdf.queryExecution().optimizedPlan().toString() and "502" in made._jdf.queryExecution().optimizedPlan().toString()
    assert characters.infer_years(events.where("year > 0"), edges, nodes).count() == 0
