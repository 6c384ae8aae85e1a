"""The index is made of packed lists, not of single postings, however its pages lie in files."""

import random
from collections import Counter

import pytest

from chronoweave.operators import textindex


@pytest.mark.parametrize("records", [3, 10_000])
def test_blocks_of_lists(spark, tmp_path, monkeypatch, records):
    """Each posting once, in blocks of less than twice BLOCK that don't end with a batch; fewer lists than postings are exchanged."""
    monkeypatch.setattr(textindex, "BLOCK", 20)
    rng = random.Random(5)
    rows = [(i, f"T{i % 3}", " ".join(rng.choices(["a", "b", "c", "été"], k=rng.randrange(0, 30)))) for i in range(1, 301)] + [(-7, None, None)]
    pages = spark.createDataFrame(rows, "id long, title string, text string").coalesce(1)
    want = Counter()
    for i, title, text in rows:
        for word in (text or "").split():
            want[word, i] += 1
        if title:
            want[title.lower(), i] += 10
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        made = textindex.lists(pages)
        assert (records == 3 or made.count() < len(want) / 2) and "hashpartitioning(id" in made._jdf.queryExecution().executedPlan().toString()
        textindex.build(pages, str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got, blocks = Counter(), Counter()
    for r in spark.read.parquet(str(tmp_path / "index")).collect():
        assert r.n == len(r.ids) == len(r.weights) < 40 and r.most == max(r.weights) == r.weights[0]
        assert list(zip(r.weights, r.ids)) == sorted(zip(r.weights, r.ids), key=lambda x: (-x[0], x[1]))
        assert {w.bit_length() - 1 for w in r.weights} == {r["class"]}
        blocks[r.token, r["class"]] += r.n
        got.update({(r.token, i): w for i, w in zip(r.ids, r.weights)})
        assert r.block * 20 < blocks[r.token, r["class"]] + 600
    assert got == want and sum(blocks.values()) == len(want)
    rows = spark.read.parquet(str(tmp_path / "index")).select("token", "class", "block").collect()
    assert len(rows) == len(set(rows)) and all(sum(t == x[:2] for x in rows) <= 1 + blocks[t] // 20 + 1 for t in blocks)
