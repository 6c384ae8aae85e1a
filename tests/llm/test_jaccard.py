"""N-gram Jaccard join."""

import random
import re

import numpy as np
import pytest

from chronoweave.llm import jaccard, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> component, with rows of one id taken together."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {}
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                key = (members[b], members[a])
                pairs[key] = pairs.get(key, 0) + 1
    for (a, b), both in pairs.items():
        if 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = find(sets[a][0]), find(sets[b][0])
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, a string, n long")
    got = jaccard.link(df).collect()
    want = brute(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == sorted((i is None, i or 0, len(shingle_set(t)), want[i] if i is not None else 0) for i, t in rows)
    return want


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    shared = [text(60) for _ in range(3)]
    rows = [text(rng.randrange(1, 300)) for _ in range(150)]
    rows += [f"{text(rng.randrange(5, 40))} {rng.choice(shared)} {text(rng.randrange(5, 40))}" for _ in range(80)]
    rows += [f"{text(rng.randrange(0, 6))} {rng.choice(shared)} {text(rng.randrange(0, 6))}" for _ in range(60)]
    for _ in range(8):
        base = text(rng.randrange(20, 300))
        rows += [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])) for _ in range(rng.randrange(2, 30))]
    base = text(120)
    rows += [base] * 30 + [edited(rng, base, 0.02) for _ in range(120)]
    rows += [text(n) for n in (1, 2, 3, 4, 4, 5, 6)] + ["one two", "One TWO", "a b c d e", "A b\tC d\n e"]
    rng.shuffle(rows)
    ids = rng.sample(range(-500, 5000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    want = check(spark, corpus(seed))
    assert len(set(want.values())) < len(want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (5, "same text here"), (4, "same text here"), (None, "same text here"), (None, None), (6, "É a b c d e f"), (7, "é a b c d e f"), (8, "x " * 120_000), (9, "x x x x x x"), (11, "k l m n o p q"), (10, "k l m n o p q"), (10, "same text here")]
    want = check(spark, rows)
    assert want[5] == 4 and want[8] == want[9] == 8 and want[11] == 4 and want[6] == 6
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link(empty).count() == 0


def test_tree_bounds_are_safe():
    rng = np.random.default_rng(0)
    points = rng.poisson(2.0, (300, 16)).astype(np.int32)
    points[150:] = np.maximum(0, points[:150] + rng.integers(-1, 2, (150, 16)) * (rng.random((150, 16)) < 0.2))
    q, p, bound = jaccard.RTree(points).search(points)
    minima = np.minimum(points[:, None], points[None]).sum(2)
    n = points.sum(1)
    need = 175 * minima >= 75 * (n[:, None] + n[None])
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(need)), strict=True))
    assert (bound == minima[q, p]).all()


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1 << 32), (5, 1 << 32), (5000, 1 << 32), (200_000, 1 << 32), (200_000, 250_000), (3, 4)):
        keys = np.sort(rng.integers(0, top, n)).astype(np.uint32)
        packed = jaccard._thinned(keys)
        assert jaccard._thickened(packed, n).tolist() == keys.tolist() and len(packed) <= 4 * n


def test_first_shared_bucket():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    lists = [rng.choice(5000, rng.integers(1, 900), replace=False).tolist() for _ in range(40)]
    x, y = np.triu_indices(40, 1)
    for bucket in (0, 10, 2500, 5000):
        want = [any(b < bucket for b in set(lists[i]) & set(lists[j])) for i, j in zip(x, y, strict=True)]
        assert jaccard._met_before(bucket, pa.array(lists, pa.list_(pa.int64())), x, y).tolist() == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.v: r.label for r in jaccard.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_query_on_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(rows)
    for r in queries.op1_ngram_jaccard_join(spark, small).collect():
        assert r.component_id == want[r.doc_id]
