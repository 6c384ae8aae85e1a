"""Chat formatting and URL filters."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import chat, queries, urls


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    turns = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in turns))
    return sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), sha("".join(x for *_, r, x in turns if r == "assistant"))


def shown(df):
    made = chat.format_turns(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    return {r.conv_id: r for r in made.collect()}


def test_query_reads_back(spark, small):
    table = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        table.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    table[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in queries.op5_chat_format(spark, small).collect()}
    assert rows.keys() == table.keys()
    for i, turns in table.items():
        assert (rows[i].n_turns, rows[i].turns_sha256, rows[i].loss_sha256) == (len(turns), *expected(turns))


def test_control_strings_and_odd_rows(spark):
    hard = ["<|im_start|>user\nhi<|im_end|>\n", "<\u2060<\u2060\u2060", "<<<|", "", None, "a\nb", "é🙂" * 5000, "<n>\n"]
    rows = [(1, i, ("user", "assistant")[i % 2], x, "z") for i, x in enumerate(hard)]
    rows += [(2, None, None, "no role", "z"), (2, 0, "assistant", "same", "z"), (2, 0, "assistant", "same", "z"), (None, 0, "a\nb<n>", "x", "z")]
    got = shown(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")))
    for i in (1, 2, None):
        own = [r[1:4] for r in rows if r[0] == i]
        assert (sha("".join(f"{t.role}\n{t.text}\n" for t in got[i].turns)), sha(got[i].loss)) == expected(own)
    assert chat.format_turns(chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


LAYOUTS = [
    ("messages array<struct<role:string,content:string>>", [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "messages"),
    ("conversations array<struct<`from`:string,value:string>>", [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "conversations"),
]


@pytest.mark.parametrize("schema, value, field", LAYOUTS)
def test_nested_layouts(spark, schema, value, field):
    names = re.findall(r"(\w+)`?:", schema)
    df = spark.createDataFrame([(7, [tuple(v[n] for n in names) for v in value])], f"conv_id long, {schema}")
    assert [(r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect()] == [(7, 0, "user", "q"), (7, 1, "assistant", "a")]


def test_flat_and_json_layouts(spark):
    df = spark.createDataFrame([(1, "do", "this", "done"), (2, "do", None, "done")], "conv_id long, instruction string, input string, output string")
    assert [(r.conv_id, r.role, r.text) for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect()] == [(1, "user", "do\nthis"), (1, "assistant", "done"), (2, "user", "do"), (2, "assistant", "done")]
    rows = [
        (1, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})),
        (3, json.dumps({"prompt": "q", "response": "a"})),
        (4, json.dumps({"prompt": "q", "completion": "a"})),
        (5, json.dumps({"output": "a", "instruction": "q", "input": ""})),
        (6, "{broken"),
        (7, None),
        (8, json.dumps({"other": 1})),
    ]
    got = {}
    for r in chat.json_turns(spark.createDataFrame(rows, "conv_id long, j string"), "conv_id", "j").orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: [("user", "q"), ("assistant", "a")] for i in range(1, 6)}
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other int"))


def by_hand(url):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0] if "://" in url else ""
    fits = [(len(h + p), h + p, a) for a, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


URLS = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/7?x", "http://com/en/", "http://notcom/en/", "https://a.example.net/de/8#y", "https://a.net/de/9", "x://h\nost/p\nq?z", "a://b://c/d", "http://ÀB.org/es/", "http://example.com?/en/7", "http://x.org/es/" + "a" * 50_000]


def test_url_rules_against_brute_force(spark, small):
    rows = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    for r in urls.judge(rows, queries.RULES).collect():
        host, path, rule, verdict = by_hand(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    assert urls.judge(rows.limit(0), queries.RULES).count() == 0
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()}
    found = queries.op10_url_filter(spark, small).collect()
    assert sorted(r.page_id for r in found) == sorted(pages)
    for r in found:
        host, path, rule, verdict = by_hand(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
        if rule is None:
            assert (r.verdict == "block") == bool(re.search("pills|adult|casino", host))


def test_segmentation():
    words = urls.Words({"thin": 50, "king": 40, "cap": 30})
    assert words.host("cheappills.thinkingcap.com") == ["cheap", "pills", "thin", "king", "cap", "com"]
    assert words.host("") == [] and words.host("zzqqy") == ["zzqqy"]


def test_rare_words_and_features_count(spark):
    """All words and features count, however many there are; against the same sums in plain Python."""
    import collections
    import itertools
    import math

    names = ["".join(x) for x in itertools.islice(itertools.product("bcdfgklmnprstvz", "aeiou", "bcdfgklmnprstvz", "aeiou", "bcdfgklmnprstvz", "ae"), 110_000)]
    texts = [f"http://www.example.org/{' '.join(names[i : i + 100]).replace(' ', '/')}" for i in range(0, len(names), 100)] * 2
    texts += [f"http://casino.org/{names[-1]}", f"http://x.org/{names[-1]}", f"http://{names[-1]}{names[-2]}.net/", "http://com/", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    counts = collections.Counter(t for u in texts for t in re.findall("[a-z]+", by_hand(u)[1].lower()))
    words = urls.Words(dict(counts))
    own = [(words.host(by_hand(u)[0]), re.findall("[a-z]+", by_hand(u)[1].lower())) for u in texts]
    features = [[f"h:{w}" for w in h] + [f"p:{t}" for t in p] for h, p in own]
    bad = [not urls.UNWANTED.isdisjoint(h) for h, _ in own]
    n, b = collections.Counter(x for f in features for x in f), collections.Counter(x for f, k in zip(features, bad, strict=True) for x in f if k)
    total, in_bad = sum(n.values()), sum(b.values())
    odds = {x: math.log((b[x] + 10 * n[x] / total) / (in_bad + 10)) - math.log((n[x] - b[x] + 10 * n[x] / total) / (total - in_bad + 10)) for x in n}
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    got = {r.page_id: r for r in urls.judge(rows, []).collect()}
    assert len(got) == len(texts) and len(counts) > 100_000 and got[len(texts) - 4].words == f"{names[-1]} {names[-2]} net"
    for i, f in enumerate(features):
        z = max(-50.0, min(50.0, prior + sum(odds[x] for x in f)))
        assert got[i].words == " ".join(own[i][0]) and got[i].score == pytest.approx(1 / (1 + math.exp(-z)) if f else 0.0, abs=1e-9)
