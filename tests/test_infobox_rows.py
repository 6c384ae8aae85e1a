"""Infobox JSON walked as variants against the walk in Python."""

import json
import random

from chronoweave.sources import pages


def item(rng, depth):
    kind = rng.choice(["data", "data", "title", "image", "navigation", "other", "group", "section", "panel", None])
    value = rng.choice(["plain", "a<br/>b", '<a href="/wiki/X">x</a>, y<sup>1</sup>', "", None, '/wiki/Template:Ship?x "t"'])
    if kind in ("group", "section", "panel", None):
        inner = [item(rng, depth - 1) for _ in range(rng.randrange(0, 4))] if depth else []
        inner = inner[0] if inner and rng.random() < 0.2 else inner
        data = {"value": inner, "n": 1} if rng.random() < 0.6 else inner
    elif kind == "image":
        data = rng.choice([[{"url": "http://i/1.png"}, {"url": "x"}], [{"url": ""}], ["x"], [], {"url": "no"}, None, [{"caption": "c"}]])
    else:
        data = rng.choice([{"label": rng.choice(["Name", "<b>Born</b>", "", None]), "value": value}, {"value": value}, [1], "text", None])
    return {"type": kind, "data": data} if kind or rng.random() < 0.5 else {"data": data}


def nested(levels):
    at = {"type": "data", "data": {"label": "Deep", "value": str(levels)}}
    for k in range(levels):
        at = {"type": ("group", "section", "panel")[k % 3], "data": {"value": [{"type": "data", "data": {"label": f"L{k}", "value": "v"}}, at]}}
    return [at]


def test_variants_against_the_walk(spark):
    rng = random.Random(8)
    texts = [json.dumps([item(rng, 5) for _ in range(rng.randrange(0, 5))]) for _ in range(120)]
    texts += [json.dumps(nested(n)) for n in (0, 1, 8, 10, 11, 40)]
    texts += [None, "", "null", "{", "[]", "{}", "5", '"x"', "[[[1]]]", '[{"type": 5, "data": {"label": "a", "value": "b"}}]', '[{"type": "data", "type": "title", "data": {"label": "Twice", "value": "b"}}]']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, json string").repartition(3)
    got = {r.pageId: r.infobox.asDict(recursive=True) if r.infobox else None for r in pages.infobox_rows(df, "id", "json", "https://e.org").collect()}
    want = {r.pageId: r.infobox.asDict(recursive=True) if r.infobox else None for r in pages.infoboxes(df, "id", "json", "https://e.org").collect()}
    assert len(want) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == want[i], (i, text)
    assert len(want[122]["Data"]) == 9 and any(w and w["Template"] for w in want.values()) and any(w and w["ImageUrl"] for w in want.values())


def test_pages_are_dealt_and_walked_once(spark):
    """Pages that lie in one stretch are dealt by id, which is the only exchange; no level is walked for a second branch."""
    text = json.dumps(nested(2))
    df = spark.range(0, 500, 1, 1).selectExpr("id", f"'{text}' AS json")
    made = pages.infobox_rows(df, "id", "json")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 2 * pages.DEPTH + 1
    assert made.select("infobox").distinct().count() == 1 and made.count() == 500
    physical = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pageId" in physical and "SinglePartition" not in physical and physical.count("Exchange rangepartitioning") == 0
