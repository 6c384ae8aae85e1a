"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import queries, spelling


def near(a, b):
    """Exactly one edit apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain(counts):
    """The result by all pairs; words meet by their halves only to save time: one edit leaves a half whole."""
    meet, forms, many = {}, {}, Counter()
    for w in counts:
        for key in {(0, w[:3]), (1, w[-3:])}:
            meet.setdefault(key, []).append(w)
    best = {}
    for w in counts:
        others = {o for key in ((0, w[:3]), (1, w[-3:])) for o in meet[key] if o != w and near(w, o)}
        many[w] = len(others)
        if others:
            best[w] = min(others, key=lambda o: (-counts[o], o))
            if counts[best[w]] >= 10 * counts[w]:
                forms[w] = best[w]
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, many[w], counts[forms[w]] if w in forms else None))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_query_against_all_pairs(spark, small):
    got = rows_of(queries.op12_spelling_variants(spark, small))
    want = plain(plain_counts((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()))
    assert len(got) == len(set(got)) and set(got) == want and any(r[1] for r in want)


def test_chains_and_repeated_letters(spark):
    """A chain of forms six steps long, runs of one letter, words of 9,000 letters, ties."""
    counts = {"kabcdefg": 2, "abcdefg": 20, "abcdefx": 200, "abcdexx": 2000, "abcdxxx": 20_000, "abcxxxx": 200_000, "abxxxxx": 2_000_000}
    counts |= {"aaaaaaa": 5, "aaaaaaaa": 50, "aaabaaa": 7, "aaaaaab": 500, "aaacaaa": 500}
    counts |= {"z" * 9000: 3, "z" * 8999: 30, "z" * 4000 + "y" + "z" * 4999: 300, "éàüöñçß": 4, "éàüöñçx": 40}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.group(df))
    assert set(got) == plain(counts) and len(got) == len(counts)
    roots = {r[0]: r[2] for r in got}
    assert roots["kabcdefg"] == "abxxxxx"


def test_hashes_that_merely_agree(spark, monkeypatch):
    """Keys of eight bits: nearly all of them agree by chance, and the strings part them again."""
    counts = plain_counts([(i, " ".join("".join(np.random.default_rng(i).choice(list("abé"), 8)) for _ in range(300))) for i in range(6)])
    whole = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda letters: tuple(x if x.dtype == bool else x << np.uint64(56) for x in whole(letters)))
    near_rows = []
    words = sorted(counts)
    held = list(spelling._blocks(1)([spelling.batch(spelling.pa.schema([("word", spelling.pa.string()), ("name", spelling.pa.int64())]), words, list(range(len(words))))]))
    for b in spelling._survivors(held):
        by_key = {}
        for key, name, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by_key.setdefault(key, []).append((place, words[name], counts[words[name]]))
        near_rows = [x for g in by_key.values() for x in spelling.near_of(g)]
    many = Counter()
    for word, n, _, _ in near_rows:
        many[word] += n
    assert {w: many[w] for w in counts} == {r[0]: r[4] for r in plain(counts)}


@pytest.mark.parametrize("tasks", [1, 5])
def test_odd_rows(spark, tasks):
    rows = [(1, None), (2, ""), (3, "Leopard leopard"), (3, "Leopard leopard"), (None, "leopard Leoparden"), (4, "ÉCLAIRS éclairs ÉCLAIRS x" + "abcdefgh," * 20_000), (5, "12 345 __"), (6, "leoparden" + " × " * 3)]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(tasks)
    got = rows_of(spelling.group(spelling.counts(df)))
    assert set(got) == plain(plain_counts(rows)) and len(got) == len(set(got))
    assert spelling.group(spelling.counts(df.where(F.lit(False)))).count() == 0
