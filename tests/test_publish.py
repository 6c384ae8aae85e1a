"""Publication by pointer and workflows that go on where they ended."""

import pytest
from pyspark.sql import functions as F

from chronoweave.sources import publish, sinks
from chronoweave.sources.files import Files
from chronoweave.streaming.workflow import Workflow


def numbers(spark, n, value):
    return spark.range(n).select("id", F.lit(value).alias("value"))


def test_a_reader_sees_old_or_new_whole(spark, tmp_path, monkeypatch):
    """Readers look after every step of a swap: both tables are always of one version."""
    path, seen = str(tmp_path / "mart"), []

    def look():
        now = publish.current(spark, path)
        seen.append((now.table("rows").first().value, now.table("rows").count(), now.table("overview").first().n) if now else None)

    sinks.replace_mart(numbers(spark, 5, "old"), numbers(spark, 1, 5).select(F.col("value").alias("n")), path)
    held = publish.current(spark, path)
    put = Files.put
    monkeypatch.setattr(Files, "put", lambda self, *a, **k: (look(), put(self, *a, **k), look())[1])
    sinks.replace_mart(publish.current(spark, path).table("rows").withColumn("value", F.lit("new")).where("id < 3"), numbers(spark, 1, 3).select(F.col("value").alias("n")), path)
    assert seen == [("old", 5, 5), ("new", 3, 3)]
    assert held.table("rows").count() == 5 and held.table("overview").first().n == 5  # who began with the old version ends with it


def test_a_bad_version_is_never_pointed_to(spark, tmp_path):
    path = str(tmp_path / "t")
    assert publish.current(spark, path) is None
    sinks.swap(numbers(spark, 4, "a"), path, ["id"])
    for bad in (numbers(spark, 4, "b").unionByName(numbers(spark, 1, "b")), numbers(spark, 4, "b").withColumn("id", F.when(F.col("id") > 0, F.col("id")))):
        with pytest.raises(ValueError, match="null or repeated"):
            sinks.swap(bad, path, ["id"])
    with pytest.raises(Exception, match="(?i)divi"):
        sinks.swap(spark.range(3).select((F.col("id") / F.lit(0)).alias("id")), path, ["id"])
    now = publish.current(spark, path)
    assert {r.value for r in now.table("rows").collect()} == {"a"}
    with pytest.raises(KeyError):
        now.table("other")
    for _ in range(3):
        sinks.swap(numbers(spark, 1, "c"), path, ["id"])
    assert len(publish.clean(spark, path, 2, 0)) == 3 and publish.current(spark, path).table("rows").count() == 1
    assert publish.clean(spark, path, 0, 3600) == []


class Killed(BaseException):
    """Ends the driver's run as a kill does: no handler of errors sees it."""


@pytest.mark.parametrize("when", ["before writing", "before the commit"])
def test_a_killed_workflow_goes_on(spark, tmp_path, monkeypatch, when):
    calls, folder = [], str(tmp_path)

    def work(rows):
        calls.append(sorted(r.id for r in rows.collect()))
        if when == "before writing" and len(calls) == 4:
            raise Killed
        return rows.select("id", (F.col("id") * 2).alias("twice"))

    put, puts = Files.put, []

    def counted(self, path, content, over):
        if path.endswith(tuple(f"/{k}.json" for k in range(8))):
            puts.append(path)
            if when == "before the commit" and len(puts) == 4:
                raise Killed
        return put(self, path, content, over)

    monkeypatch.setattr(Files, "put", counted)
    rows = lambda: spark.range(100)
    with pytest.raises(Killed):
        Workflow(spark, folder, "s").run("double", rows, "id", 8, work)
    first = list(calls)
    assert len(first) == 4 and len(Workflow(spark, folder, "s").commits("double")) == 3 and Workflow(spark, folder, "s").done() == []
    again = Workflow(spark, folder, "s")
    got = again.run("double", lambda: pytest.fail("the rows were dealt before"), "id", 8, work)
    assert sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(100)]
    assert len(calls) == 4 + 5 and calls[4] == first[3] and sum(calls[:3] + calls[4:], []) != [] and sorted(sum(calls[:3] + calls[4:], [])) == list(range(100))
    more = again.run("count", lambda: got, "id", 2, lambda x: x.agg(F.count("*").alias("n"), F.sum("twice").alias("twice")))
    assert [sum(c) for c in zip(*map(tuple, more.collect()), strict=True)] == [100, 9900] and again.done() == ["double", "count"]
    n = len(calls)
    assert Workflow(spark, folder, "s").run("double", rows, "id", 8, work).count() == 100 and len(calls) == n
    again.clear()
    assert Workflow(spark, folder, "s").done() == [] and Workflow(spark, folder, "s").result("double") is None


def test_failing_batches(spark, tmp_path):
    flow, tries = Workflow(spark, str(tmp_path), "s"), []

    def work(rows):
        if rows.where("id = 7").count():
            tries.append(1)
            raise OSError("no answer")
        return rows

    with pytest.raises(OSError):
        flow.run("strict", lambda: spark.range(20), "id", 5, work, pass_over=False)
    with pytest.raises(OSError):
        flow.run("strict", lambda: spark.range(20), "id", 5, work, pass_over=False)
    got = sorted(r.id for r in flow.run("kind", lambda: spark.range(20), "id", 5, work).collect())
    lost = set(range(20)) - set(got)
    assert 7 in lost and len(flow.errors("kind")) == 1 and "no answer" in next(iter(flow.errors("kind").values())) and len(tries) == 3
    alone = {r.id for r in spark.range(20).where("pmod(xxhash64(id), 5) = (SELECT pmod(xxhash64(7L), 5))").collect()}
    assert lost == alone
    with pytest.raises(RuntimeError, match="all batches"):
        flow.run("none", lambda: spark.range(3), "id", 1, lambda rows: spark.sql("SELECT no_such_column"))
    assert flow.run("empty", lambda: spark.range(0), "id", 3, lambda rows: rows).count() == 0
    for name in ("../x", "", ".."):
        with pytest.raises(ValueError):
            Workflow(spark, str(tmp_path), name)
