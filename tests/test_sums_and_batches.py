"""Sums over spans without a row for each hit; batches of lines that Python never sees."""

import random

from pyspark.sql import functions as F

from chronoweave.operators import build, intervals


def test_sums_at_points(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.choice([0, 1, 9, 200]), i) for i, a in enumerate(rng.randrange(-300, 300) for _ in range(200))] * 3
    spans += [(None, 5, 1000), (5, None, 2000), (None, None, 3000), (9, 8, 4000)]
    points = [*range(-400, 600, 7), 5, 5, None]
    s = spark.createDataFrame(spans, "a int, b int, v long").withColumn("n", F.lit(1))
    made = intervals.sums_at_points(spark.createDataFrame([(p,) for p in points], "p int"), s, "p", "a", "b", ["n", "v"])
    hit = {p: [v for a, b, v in spans if (a is None or a <= p) and (b is None or p <= b)] for p in points if p is not None}
    assert {r.p: (r.n, r.v) for r in made.collect()} == {p: (len(v), sum(v)) for p, v in hit.items() if v}
    far = intervals.sums_at_points(spark.createDataFrame([(0,), (10**6,)], "p int"), s.where("b < 1000"), "p", "a", "b", ["n"])
    assert [r.p for r in far.collect()] == [0]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("sum(") and plan.count("Aggregate") >= 4  # added up below the join


def test_lines_stay_out_of_python(spark):
    rows = spark.range(0, 300).select("id", F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("line"))
    made = build.export_batches(rows, "id", "line", 200, 15, stretches=3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "ArrowEvalPython [walk(stretch" in plan
    got = {}
    for r in made.orderBy("id").collect():
        got.setdefault(r.batch, []).append(len(r.line))
    assert sum(map(len, got.values())) == 300
    for name, sizes in got.items():
        stretch, part = name.split("-")
        assert len(sizes) <= 15 and sum(sizes[:-1]) < 200 and (len(sizes) == 15 or sum(sizes) >= 200 or f"{stretch}-{int(part) + 1}" not in got)
    # also where the order of rows seems not to matter
    counts = {r.batch: r.n for r in made.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
