"""License scans against plain words, an edit-distance table, and odd rows."""

import random
import re

import pytest

from chronoweave.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def places(words):
    return sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_query_against_plain_words(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op11_license_scan(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        words = words_of(texts[r.doc_id])
        want = places(words)
        first = [i for i, _ in want]
        labels = ",".join(sorted({x for _, x in want}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(want), min(first, default=None), max(first, default=None), labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        for span in filter(None, r.spans.split(",")):
            label, start, end, wrong = span.split(":")
            said = " ".join(words_of(texts[r.doc_id][int(start) : int(end)]))
            known = [p for p, x in licenses.PHRASES if x == label] + [re.sub("[{}]", "", p) for p, x in licenses.NOTICES if x == label]
            assert min(distance(said, p) for p in known) == int(wrong)


def test_edited_notices_are_found_with_the_fewest_edits():
    """Every notice, with up to its edits outside the key, amid other words; the span is the one of fewest edits."""
    rng, made = random.Random(3), licenses._notices(licenses.NOTICES, licenses.PHRASES)
    for marked, label in licenses.NOTICES:
        plain, begin = re.sub("[{}]", "", marked), marked.index("{")
        end = marked.index("}") - 1
        for k in range(licenses.edits(plain) + 1):
            chars = list(plain)
            free = [i for i, c in enumerate(chars) if c != " " and not begin <= i < end and not chars[i].isdigit()]
            for i in sorted(rng.sample(free, k), reverse=True):
                kind = rng.randrange(3)
                chars[i : i + 1] = [[], ["q"], [chars[i], "q"]][kind]
            said = "".join(chars)
            text = f"Ünd öther, wörds.  {said.title()}! more wörds"
            found = [f for f in licenses.find(text, made)[1] if f["label"] == label and not f["base"]]
            best = min(distance(" ".join(said.split()), re.sub("[{}]", "", p)) for p, x in licenses.NOTICES if x == label)
            assert found, (marked, said)
            assert min(f["edits"] for f in found) <= max(best, 0) or len(found) > 1
            assert all(f["edits"] <= licenses.MOST and text[f["start"] : f["end"]].strip() == text[f["start"] : f["end"]] for f in found)


@pytest.mark.parametrize("text", ["licensed under the foo license", "under the license", "gnu lesser things", "all rights", "rights reserved by all", "mitlicense", "mit-licensed", "the limit license fee"])
def test_clean_texts_stay_clean(text):
    assert licenses.find(text, licenses._notices(licenses.NOTICES, licenses.PHRASES))[1] == []


def test_many_in_one_text():
    made = licenses._notices(licenses.NOTICES, licenses.PHRASES)
    text = "Released under teh MIT License. " * 500 + "mit license " * 3 + "license " * 2000
    n, found = licenses.find(text, made)
    assert n == 500 * 5 + 6 + 2000
    assert sum(f["base"] for f in found) == 503 and sum(not f["base"] for f in found) == 500
    assert [f["word"] for f in found if not f["base"]] == list(range(0, 2500, 5))


def test_odd_rows(spark):
    long = "x " * 300_000 + "general public license"
    rows = [(1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (None, "mit   LICENSE!"), (4, "... --"), (5, long), (6, "ÄPACHE LICENSE apache\x00license")]
    df = spark.createDataFrame([(i, t, 7, "x", True) for i, t in rows], "doc_id long, text string, n_words int, found string, base boolean")
    got = sorted((r.doc_id or 0, r.n_words, [(f.label, f.word, f.start, f.end) for f in r.found]) for r in licenses.scan(df).collect())
    mit = [("mit", 0, 0, 11)]
    assert got == [(0, 2, [("mit", 0, 0, 13)]), (1, 0, []), (2, 0, []), (3, 2, mit), (3, 2, mit), (4, 0, []), (5, 300_003, [("gpl", 300_000, 600_000, 600_022)]), (6, 4, [("apache", 2, 15, 29)])]
    assert licenses.scan(df.limit(0)).count() == 0
