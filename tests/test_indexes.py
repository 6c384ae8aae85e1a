"""Interval joins, the inverted index and filtered vector search against scans; the paged stream against its listing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import intervals, search, textindex, vectors
from chronoweave.sources import paging


def test_spans_and_points(spark):
    """Long, open, single and impossible spans, points before and beyond all, repeated points."""
    rng = random.Random(1)
    spans = [(i, a, a + rng.choice([0, 1, 7, 100, 25_000])) for i, a in enumerate(rng.randrange(-25_000, 5_000) for _ in range(300))]
    spans += [(900, None, 5), (901, 5, None), (902, None, None), (903, 9, 8), (904, -(2**31), 2**31 - 1), (905, 0, 0)]
    points = [rng.randrange(-30_000, 30_000) for _ in range(400)] + [0, 0, 5, 8, 9, -(2**31), 2**31 - 1, None]
    p = spark.createDataFrame(list(enumerate(points)), "nth int, year int")
    s = spark.createDataFrame(spans, "id int, start_year int, end_year int")
    joined = intervals.point_in_span(p, s, "year", "start_year", "end_year")
    got = sorted((r.nth, r.id) for r in joined.collect())
    want = sorted((k, i) for k, y in enumerate(points) if y is not None for i, a, b in spans if (a is None or a <= y) and (b is None or y <= b))
    assert got == want
    cut = s.select(F.size(intervals.bins_of_span(F.col("start_year"), F.col("end_year"))).alias("n"), "id")
    assert {r.n for r in cut.where("id IN (902, 904)").collect()} == {1} and cut.where("id = 903").first().n == 0 and cut.agg(F.max("n")).first()[0] <= 2 * 32
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    keyed = intervals.point_in_span(p.withColumn("k", F.col("nth") % 3), s.withColumn("k", F.col("id") % 3), "year", "start_year", "end_year", ("k",))
    assert sorted((r.nth, r.id) for r in keyed.collect()) == [(k, i) for k, i in want if k % 3 == i % 3]
    with pytest.raises(ValueError):
        intervals.point_in_span(p.withColumn("id", F.lit(1)), s, "year", "start_year", "end_year")


def test_index_finds_what_the_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 7)
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "été", "x_1", "the"]
    rows = [(i, f"{rng.choice(words)} {i}", " ".join(rng.choices(words, [1, 2, 1, 1, 1, 1, 30], k=rng.randrange(1, 40)))) for i in range(200)]
    rows += [(900, None, None), (901, "", ""), (902, "Alpha ALPHA", None), (903, None, "alpha, Beta; é" + "zeta " * 300)]
    pages = spark.createDataFrame(rows, "id long, title string, text string")
    path = str(tmp_path / "index")
    textindex.build(pages, path)
    assert spark.read.parquet(path).agg(F.max("n")).first()[0] < 40  # blocks are near their size, also of the word in every page
    for query, limits in (("alpha alpha", [10]), ("beta gamma The", [1, 10, 1000]), ("zeta", [5]), ("Été x_1 nothing", [10]), ("nothing", [1]), ("", [1])):
        for limit in limits:
            want = sorted(map(tuple, search.keyword_search(pages, query, limit).collect()))
            assert sorted(map(tuple, textindex.keyword_search(pages, path, query, limit).collect())) == want, (query, limit)
    plan = textindex._of(spark, path, ["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:120]
    near = textindex.text_search(pages, path, "lph", 5).collect()
    assert [r.id for r in near] == [r.id for r in search.text_search(pages, "lph", 5).collect()] and len(near) == 5
    assert sorted(r.id for r in textindex.text_search(pages, path, "zeta", 5).collect()) == [903]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """20,000 clustered vectors with a column by which 1, 10 and 100 in a hundred pass."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    v = centres[rng.integers(0, 60, 20_000)] + 0.7 * rng.normal(size=(20_000, 32))
    rows = spark.createDataFrame([(i, int(i * 7919 % 100), x.tolist()) for i, x in enumerate(v)] + [(-1, 0, None), (-2, 0, [0.0] * 32)], "id long, part int, embedding array<float>")
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    vectors.build(rows, path, "embedding", ["part"])
    return path, v.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("share", [1, 10, 100])
def test_recall_under_a_filter(spark, many, share):
    path, v = many
    fits = np.arange(len(v)) * 7919 % 100 < share
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 20_000, 4000):
        score = np.where(fits, unit @ unit[q], -9)
        want = set(np.lexsort((np.arange(len(v)), -score))[:10].tolist())
        got = vectors.search(spark, path, v[q].tolist(), 10, F.col("part") < share).collect()
        assert len(got) == 10 and all(r.part < share for r in got) and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
        assert all(abs(r.score - score[r.id]) < 1e-5 for r in got)
        hits, total = hits + len(want & {r.id for r in got}), total + 10
    assert hits >= 0.9 * total


def test_vector_search_edges(spark, many):
    path, v = many
    got = vectors.search(spark, path, v[5].tolist(), 10, F.col("id").between(100, 103)).collect()
    assert {r.id for r in got} == {100, 101, 102, 103}
    assert vectors.search(spark, path, v[5].tolist(), 10, F.col("part") == 200).count() == 0
    assert all(r.score >= 0.8 for r in vectors.search(spark, path, v[5].tolist(), 10, None, 0.8).collect())
    with pytest.raises(ValueError):
        vectors.search(spark, path, [1.0], 3)


class Noted(paging.FolderListing):
    """Notes each fetch in a file of its own."""

    def fetch(self, ids):
        import uuid

        with open(f"{self.uri.removeprefix('file://')}/read-{ids[0][0]}-{uuid.uuid4().hex}", "w"):
            pass
        yield from super().fetch(ids)


def test_paged_stream_goes_on_in_the_middle(spark, tmp_path):
    import json

    folder, n = tmp_path / "listing", 11
    folder.mkdir()
    for k in range(n):  # tokens in no order
        token = "0" if k == 0 else f"t{k * 37 % 101}"
        following = f"t{(k + 1) * 37 % 101}" if k + 1 < n else None
        (folder / f"{token}.json").write_text(json.dumps({"rows": [] if k == 4 else [[100 * k + i, f"page {i}"] for i in range(k + 1)], "next": following}))
    want = [(100 * k + i, f"page {i}") for k in range(n) if k != 4 for i in range(k + 1)]
    seen, check, broken = [], str(tmp_path / "check"), {"at": 2}

    def put(rows, batch):
        if broken["at"] == batch:
            broken["at"] = None
            raise RuntimeError("stopped in the middle")
        seen.append((batch, sorted(map(tuple, rows.collect()))))

    def start(**how):
        stream = paging.paged(spark, Noted(f"file://{folder}"), "id long, title string", pages_per_batch=2)
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", check).trigger(**how).start()

    query = start(processingTime="0 seconds")
    with pytest.raises(Exception, match="stopped in the middle"):
        query.awaitTermination(120)
    assert [b for b, _ in seen] == [0, 1]
    query = start(processingTime="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert [b for b, _ in seen] == list(range(6)) and [r for _, rows in seen for r in rows] == want
    query = start(processingTime="0 seconds")  # at the end there is nothing more
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 6
    reads = [p.name.split("-")[1] for p in folder.glob("read-*")]
    assert all(reads.count(t) == 1 for t in reads if t not in {f"t{4 * 37 % 101}", f"t{5 * 37 % 101}"})  # the broken batch's pages were not read, or twice
