"""Approximate nearest neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import ann, queries


def brute(ids, v, query_id, q, k):
    d = np.sqrt(((v - q) ** 2).sum(1))
    return sorted((x, i) for x, i in zip(d.tolist(), ids, strict=True) if i != query_id)[:k]


@pytest.mark.parametrize("n, dim", [(1, 4), (7, 3), (3000, 24)])
def test_shards(n, dim):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))
    graph = ann._from_row(ann._to_row(dim, 0, ann.build_shard(np.arange(n), v)).to_pylist()[0])
    hits = total = 0
    for i in range(0, n, 37):
        got, want = graph.search(i, v[i], 10), brute(range(n), v, i, v[i], 10)
        hits += len({x for x, _ in got} & {x for _, x in want})
        total += len(want)
    assert hits >= 0.97 * total


def test_equal_vectors_and_ties():
    v = np.repeat(np.eye(3), 400, axis=0)
    ids = np.random.default_rng(0).permutation(len(v))
    graph = ann.Graph(ann.build_shard(ids, v))
    own = sorted(ids[:400].tolist())
    assert [x for x, _ in graph.search(own[2], v[0], 10)] == [i for i in own if i != own[2]][:10]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.5]), (9, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")
    got = ann.search(ann.build_index(df), df.where("vec_id = 0 or vec_id = 8 or vec_id = 9 or vec_id = 4"))
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert found[0] == [(1, 1, 0.5), (2, 9, 0.5), (3, 9, 0.5)] and 8 not in found and 4 not in found
    assert {x[1] for x in found[9]} == {0, 1}
    assert ann.search(ann.build_index(df.limit(0)), df).count() == 0


def test_query_recall_and_scores(spark, small):
    for folder, shard in ((small, ann.SHARD), (small.replace("sf0.001", "sf0.01"), 128)):
        rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
        asked = rows.where(F.col("vec_id") % 100 == 0)
        got = (queries.op7_nearest_neighbours(spark, folder) if shard == ann.SHARD else ann.search(ann.build_index(rows, shard=shard), asked)).collect()
        all_rows = rows.collect()
        ids, v = [r.vec_id for r in all_rows], np.array([r.embedding for r in all_rows], np.float64)
        hits = total = 0
        for r in asked.collect():
            want = brute(ids, v, r.vec_id, np.array(r.embedding, np.float64), 10)
            own = sorted((x for x in got if x.query_id == r.vec_id), key=lambda x: x["rank"])
            assert [x["rank"] for x in own] == list(range(1, len(want) + 1))
            hits += len({x.vec_id for x in own} & {i for _, i in want})
            total += len(want)
            for x in own:
                assert x.score == pytest.approx(float(np.sqrt(((v[ids.index(x.vec_id)] - np.array(r.embedding, np.float64)) ** 2).sum())), rel=1e-12)
        assert hits >= 0.9 * total
