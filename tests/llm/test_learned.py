"""Language identification, toxicity."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import _words, langid, queries, toxicity


def test_words_and_hashes():
    rows = ["aa Bb aa", "", "\tccc é  bb", "x" * 10_000 + " " + "x" * 10_000, " ", "aa"]
    raw = "".join(rows).encode()
    at = np.cumsum([0] + [len(r.encode()) for r in rows])
    starts, ends, row = _words.find(np.frombuffer(raw, np.uint8), at, _words.BLANKS)
    words = [raw[s:e].decode() for s, e in zip(starts, ends, strict=True)]
    assert words == [w for r in rows for w in r.split()]
    assert row.tolist() == [i for i, r in enumerate(rows) for _ in r.split()]
    h = _words.hashes(np.frombuffer(raw, np.uint8), starts, ends).tolist()
    assert len(set(zip(words, h, strict=True))) == len(set(words)) == len(set(h))


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 4, 3, 6])
    scores = rng.normal(0, 5, (sizes.sum(), 3)).astype(np.float32)
    begin = np.cumsum(sizes) - sizes
    label = langid.viterbi(scores, begin, sizes, 4.0)
    value = lambda own, path: sum(own[i, k] for i, k in enumerate(path)) - 4.0 * sum(a != b for a, b in itertools.pairwise(path))
    for b, n in zip(begin, sizes, strict=True):
        own = scores[b : b + n].astype(float)
        best = max(value(own, p) for p in itertools.product(range(3), repeat=n))
        assert value(own, label[b : b + n].tolist()) == pytest.approx(best, abs=1e-3)


@pytest.fixture(scope="module")
def taught(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return langid.fit(docs, F.lit(True))


def test_language_query_on_held_out_rows(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.9


def test_language_odd_rows_and_spans(spark, small, taught):
    one = {r.lang: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text) > 500}
    en, fr = " ".join(one["en"].split()[:40]), " ".join(one["fr"].split()[:40])
    rows = [(1, None), (2, ""), (3, " 12 🙂… —"), (None, en), (5, en), (5, en), (6, f"{en} {fr}"), (7, (en + " ") * 3000), (8, "привет мир"), (9, "\x00 …é")]
    got = langid.identify(spark.createDataFrame([(i, t, "xx", 1) for i, t in rows], "doc_id long, text string, lang string, score int"), taught).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == "und" and not by[i].spans for i in (1, 2, 3))
    assert by[5].lang_pred == by[7].lang_pred == by[None].lang_pred == "en" and by[8].lang_pred in taught["langs"] and by[9].lang_pred in taught["langs"]
    assert [s.lang for s in by[6].spans] == ["en", "fr"] and abs(by[6].spans[0].end - len(en)) <= 25
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), taught).count() == 0
    empty = langid.fit(spark.createDataFrame([(1, None, "x")], "doc_id long, lang string, text string"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), empty).collect()} == {"und"}


def test_scripts():
    raw = "abc ελ при שלו 한국 日本 ไทย".encode()
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = _words.find(data, np.array([0, len(raw)]), _words.NO_LETTERS)
    assert [langid._NAMES[i] for i in langid.scripts(data, starts)] == ["latin", "greek", "cyrillic", "hebrew", "hangul", "han", "thai"]
    assert pa.types.is_list(langid.SPANS)


def made_up(rng, n):
    """Texts of which every other one has an unwanted word somewhere."""
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    texts, y = [], []
    for i in range(n):
        own = list(rng.choice(words, rng.integers(1, 200)))
        if i % 2:
            own.insert(int(rng.integers(0, len(own) + 1)), ["zorrnak", "zorrnaku", "vlixxor"][i // 2 % 3])
        texts.append(" ".join(own))
        y.append(i % 2)
    return texts, np.array(y)


def test_toxicity_gradients():
    rng = np.random.default_rng(1)
    texts = toxicity.Texts(*toxicity.utf8(pa.array(["one two three two one", "four five", "six " * 40])))
    row, first, size = texts.windows()
    y = np.arange(len(row)) % 2
    w = {k: x.astype(np.float64) for k, x in toxicity.start_weights(rng).items()}
    w["b"] += 0.1
    x = toxicity.inputs(w, texts, np.zeros(0, np.uint64))
    index = toxicity._index(texts, first, size)

    def loss():
        gates = np.stack([x @ w["wx"][k] + w["b"][k] for k in range(2)])
        z = toxicity.forward(w, gates, index, size).astype(float)
        return float((np.logaddexp(0, z) - y * z).sum()), gates

    kept = {}
    z = toxicity.forward(w, loss()[1], index, size, kept)
    grads, d_gates = toxicity.backward(w, kept, size, 1 / (1 + np.exp(-z)) - y)
    d_gates = np.stack([d_gates[0], d_gates[1][::-1]])
    grads["wx"] = np.stack([x[index].reshape(-1, x.shape[1]).T @ d_gates[k].reshape(-1, d_gates.shape[-1]) for k in range(2)])
    for name in ("w", "v", "wa", "wh", "wx"):
        for place in list(np.ndindex(w[name].shape))[:: max(1, w[name].size // 6)]:
            old, step = w[name][place], 1e-2
            w[name][place] = old + step
            up = loss()[0]
            w[name][place] = old - step
            down = loss()[0]
            w[name][place] = old
            assert (up - down) / (2 * step) == pytest.approx(grads[name][place], abs=2e-3, rel=2e-2), (name, place)


def test_toxicity_on_held_out_texts():
    rng = np.random.default_rng(4)
    texts, y = made_up(rng, 500)
    model = toxicity.fit(texts[:400], y[:400])
    score, _ = toxicity.score_texts(model, *toxicity.utf8(pa.array(texts[400:])))
    assert ((score >= 0.5) == (y[400:] == 1)).mean() > 0.95
    # one unwanted word anywhere in a long text is found, as all windows are scored
    clean = " ".join(t for t, k in zip(texts[:200], y[:200], strict=True) if not k)
    parts = clean.split()
    planted = [" ".join([*parts[:at], "zorrnak", *parts[at:]]) for at in (0, len(parts) // 2, len(parts))]
    score, many = toxicity.score_texts(model, *toxicity.utf8(pa.array([clean, *planted])))
    assert (score[1:] > score[0]).all() and many[0] == 1 + -(-(len(parts) - toxicity.WINDOW) // toxicity.STRIDE)


def test_toxicity_rows(spark):
    texts, y = made_up(np.random.default_rng(6), 120)
    df = spark.createDataFrame([(i, t, "en", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(k), 1) for i, k in enumerate(y)] + [(None, 1, 1), (3, None, 1), (4, 0, 1)], "doc_id long, toxic int, text int")
    model = toxicity.learn(df, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "--  12"), (None, texts[0]), (5, texts[0]), (5, texts[0]), (6, texts[0] * 3000)], "doc_id long, text string")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1 and np.ptp([r.score for r in rows if r.doc_id in (None, 5)]) < 1e-4
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.learn(df, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


def test_toxicity_query(spark, small):
    rows = queries.op2_toxicity(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_finds_held_out_documents(spark, small):
    """Nine of ten toxic documents that taught nothing, and nine of ten flags right, on 10,000 documents."""
    folder = small.replace("sf0.001", "sf0.1")
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    known = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").collect()}
    flagged = {r.doc_id: r.predicted for r in queries.op2_toxicity(spark, folder).where("held_out").collect() if r.doc_id in known}
    hits = sum(k for i, k in flagged.items() if i in toxic)
    assert hits >= 0.9 * len(toxic & set(flagged)) and hits >= 0.9 * sum(flagged.values())


def test_long_labelled_texts_teach(spark):
    """Every toxic text has more windows than MOST and more bytes than 64 KiB."""
    texts, y = made_up(np.random.default_rng(5), 120)
    plain = " ".join(t for t, k in zip(texts, y, strict=True) if not k)
    long = [t if not k else f"{plain} {t} {plain} " + " " * (1 << 16) for t, k in zip(texts, y, strict=True)]
    raw, at = toxicity.utf8(pa.array(long))
    parts = toxicity.excerpts(raw, at, toxicity._odds(toxicity._seen(toxicity.Texts(raw, at), y, np.ones(len(y), bool))))
    assert all(n > toxicity.MOST == len(p) if k else len(p) == 1 for (n, p), k in zip(parts, y, strict=True))
    # clean texts as long: else the words and windows of clean texts that are kept out are in toxic texts alone
    rows = [*zip(long, y.tolist(), strict=True), *[(f"{t} {plain} {t} {plain}", 0) for t, k in zip(texts, y, strict=True) if not k]]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([(i, k) for i, (_, k) in enumerate(rows)], "doc_id long, toxic int"))
    assert "line" in model
    peak, _ = toxicity.peaks(model, *toxicity.utf8(pa.array([plain, *[f"{plain} {w} {plain}" for w in ("zorrnak", "zorrnaku", "vlixxor")]])))
    assert (peak[1:] > peak[0]).all()


def test_few_labelled_texts():
    texts, y = made_up(np.random.default_rng(7), 6)
    score, _ = toxicity.score_texts(toxicity.fit(texts, y), *toxicity.utf8(pa.array(texts)))
    assert ((score >= 0) & (score <= 1)).all()
    assert toxicity.fit(["", "1", ""], np.array([0, 1, 0])) == {"constant": pytest.approx(1 / 3)}


def test_calibration_undoes_the_sampling_rates(spark, monkeypatch):
    """10,000 clean and 1,000 toxic rows with overlapping logits, of which the sample has as many of each class."""
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1], [10_000, 1000])
    peak, many = rng.normal(2.0 * y - 1, 2.0), rng.integers(1, 90, len(y))
    some = np.flatnonzero(y | (np.arange(len(y)) % 10 == 0))
    labels = spark.range(440).selectExpr("id AS doc_id", "int(id < 40) AS toxic")
    monkeypatch.setattr(toxicity, "_learned", lambda rows, share: share)
    share = toxicity.learn(labels.selectExpr("doc_id", "'x' AS text"), labels, per_class=40)
    assert share == {1: 1.0, 0: 0.1}
    line = toxicity.calibrated({}, peak[some], many[some], y[some], float(np.log(share[1] / share[0])))["line"]
    p = 1 / (1 + np.exp(-np.stack([peak, np.log(many), np.ones(len(y))], 1) @ line))
    assert p.mean() == pytest.approx(y.mean(), abs=0.01)
