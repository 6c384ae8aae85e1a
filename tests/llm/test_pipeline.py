"""The corpus pipeline, stage by stage."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import langid, toxicity
from chronoweave.llm._base import keep

from .test_jaccard import brute, edited
from .test_packing import check
from .test_texts import all_spans


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], small), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, small, steps):
    docs, spoken, clean, single, safe, packed = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "secrets", "packing"]
    assert all(s.columns == docs.columns and s.dtypes == docs.dtypes for s in steps[:-1])
    model = langid.fit(docs, F.lit(True))
    judged = langid.identify(docs, model).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SHARE}")
    assert rows(spoken).keys() == rows(judged).keys() and len(rows(spoken)) > 0.95 * docs.count()
    own = rows(spoken)
    assert rows(clean).keys() <= own.keys() and len(rows(clean)) > 0.7 * len(own)
    own = rows(clean)
    groups = brute([(i, r.text) for i, r in own.items()])
    assert rows(single).keys() == {i for i, c in groups.items() if i == c}
    own = rows(single)
    for i, r in rows(safe).items():
        text, out, at = own[i].text, "", 0
        for s, _, e in all_spans(text)[1]:
            out += "" if s < at else text[at:s] + "[secret]"
            at = max(at, e)
        assert r.text == out + text[at:] and r.n_chars == (own[i].n_chars if r.text == text else len(r.text))
    check(packed.collect(), [(r.doc_id, r.text) for r in rows(safe).values()])
    assert corpus_pipeline.run(spark, small).count() == packed.count()


def odd(spark, small, more):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("score", F.lit(1).cast("int")).withColumn("_found", F.lit("x"))
    return docs.unionByName(spark.createDataFrame([(i, t, None, None, None, 2, "y") for i, t in more], docs.schema))


def test_odd_rows(spark, small):
    text = spark.read.parquet(f"{small}/documents.parquet").where("length(text) between 1000 and 2000").first().text
    more = [(None, None), (None, text), (9001, None), (9002, ""), (9003, "…"), (9004, "secret = hunter22"), (9005, text), (9005, text), (9006, text + " token=abcdefgh"), (9007, (text + " ") * 200)]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd(spark, small, more), small)
        assert got.count() > 0, name
        assert stage(spark, odd(spark, small, more).limit(0), small).count() == 0, name
    spoken = corpus_pipeline.language(spark, odd(spark, small, more), small)
    assert not {9001, 9002} & {r.doc_id for r in spoken.collect()} and spoken.where("doc_id is null").count() == 1
    single = corpus_pipeline.near_duplicates(spark, odd(spark, small, [*more, (-5, text), (-5, text), (-5, text + " x")]), small)
    left = [r.doc_id for r in single.collect()]
    assert left.count(-5) == 1 and not {9005, 9006} & set(left) and not left.count(9007) and left.count(None) == 2
    safe = corpus_pipeline.redacted(spark, odd(spark, small, more), small)
    assert {r.doc_id: r.text for r in safe.where("doc_id = 9004").collect()} == {9004: "[secret]"} and safe.where("doc_id = 9001").first().text is None


def test_planted_copies_go(spark, small):
    import random

    rng = random.Random(2)
    base = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text.split()) > 150][:20]
    planted = [(100_000 + k, edited(rng, r.text, 0.01) if k % 2 else r.text) for k, r in enumerate(base)]
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd(spark, small, planted), small).collect()}
    assert not got & {i for i, _ in planted}


def test_toxic_ones_go():
    from .test_learned import made_up

    texts, y = made_up(np.random.default_rng(8), 300)
    model = toxicity.fit(texts, y)
    score, _ = toxicity.score_texts(model, *toxicity.utf8(pa.array(texts)))
    assert ((score < 0.5) == (y == 0)).mean() > 0.95
