"""Language identification by spans: script ranges, per-word scores, and Viterbi with a penalty for switching.

A model has, for each learned language, counts of hashed byte n-grams inside words and of word scripts. The script
of a word narrows the candidates to the languages that were seen in it. Each word's score is the mean over the
n-gram orders of its log likelihood; Viterbi finds the labels of all words of a text whose scores less SWITCH for
each change are highest. A text's language is the one with most letters' bytes among its words.

Learning: from every language about PER_LANG rows, chosen by a hash of the id below a threshold that follows from
exact counts over all rows. Their whole texts count.

Defined cases: null text, or one without a letter, is ``und`` with score 0 and no spans; so is every text if nothing
was learned; ties go to the language first by name; repeated rows are kept as rows; rows with a null id or language
teach nothing; an empty table gives an empty result; other columns are not read. A text's words are held in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words
from ._base import batch, passing, pieces, utf8

#: Rows learned from for each language, n-gram sizes and buckets, the switching penalty in nats, the text at once.
PER_LANG, SIZES, BUCKETS, SWITCH, STEP, UND = 3000, (2, 3, 4), 1 << 16, 8.0, 4 << 20, "und"
#: The first code points of script ranges, by Unicode's blocks; what stands before counts as Latin.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"))
_FROM, _NAMES = np.array([s for s, _ in SCRIPTS]), sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
#: A language is a candidate for a script if this share of its words was in it.
SEEN = 0.001


def scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word, by its first code point."""
    b = [np.take(data, np.minimum(starts + k, len(data) - 1)).astype(np.int64) & (0x3F if k else 0xFF) for k in range(4)]
    point = np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | b[1], (b[0] & 0xF) << 12 | b[1] << 6 | b[2]],
        (b[0] & 0x7) << 18 | b[1] << 12 | b[2] << 6 | b[3],
    )
    return _SCRIPT[np.searchsorted(_FROM, point, side="right") - 1]


def _counted(batches):
    """Sparse counts for each language: n-gram buckets, then (from BUCKETS on) scripts of words."""
    sums: dict[str, np.ndarray] = {}
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    for b in pieces(batches, 1, STEP):
        raw, at = utf8(b.column(1))
        data = _words.latin_lower(raw)
        starts, ends, rows = _words.find(data, at, _words.NO_LETTERS)
        langs = np.array(b.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            if (own := np.flatnonzero(langs[rows] == lang)).size:
                own_sum = sums.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                found, _ = _words.grams(data, starts[own], ends[own], SIZES, BUCKETS)
                own_sum += np.bincount(found.reshape(-1), minlength=len(own_sum))
                own_sum += np.bincount(BUCKETS + scripts(data, starts[own]), minlength=len(own_sum))
    for lang, n in sums.items():
        there = np.flatnonzero(n)
        yield batch(schema, [lang] * len(there), pa.array(there.astype(np.int32)), pa.array(n[there]))


def shares(rows: DataFrame, key: str, most: int) -> dict:
    """The share of each key's rows that leaves about ``most`` of them."""
    return {r[0]: min(1.0, most / r[1]) for r in rows.groupBy(key).count().collect()}


def sampled(rows: DataFrame, key: str, id_col: str, most: int, share: dict | None = None) -> DataFrame:
    """About ``most`` rows of each key, by a hash of the id below a share that follows from the keys' counts."""
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30))
    below = F.lit(0)
    for value, part in (shares(rows, key, most) if share is None else share).items():
        below = F.when(F.col(key) == F.lit(value), F.lit(int((1 << 30) * part))).otherwise(below)
    return rows.where(place < below)


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> dict:
    """A model from the rows where ``learn`` is true; of each language about ``per_lang``."""
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    some = sampled(rows, "lang", "doc_id", per_lang).select("lang", "text").repartition(16)
    counts = some.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    n = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    n[counts["bucket"].to_numpy(np.int64), [langs.index(x) for x in counts["lang"]]] = counts["n"].to_numpy(np.float64)
    seen = n[:BUCKETS] + 0.1
    words = n[BUCKETS:]
    return {"langs": langs, "score": (np.log(seen / seen.sum(0)) / len(SIZES)).astype(np.float32), "scripts": words >= SEEN * np.maximum(1, words.sum(0))}


def word_scores(model: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores [word, language], for distinct words computed once; a word's best candidate has 0."""
    _, first, number = _words.distinct(_words.hashes(data, starts, ends))
    found, at = _words.grams(data, starts[first], ends[first], SIZES, BUCKETS)
    each = model["score"][found].sum(1)
    sums = np.add.reduceat(each, at, axis=0)
    fits = model["scripts"][scripts(data, starts[first])]
    fits |= ~fits.any(1, keepdims=True)
    sums = np.where(fits, sums, -1e4)
    return (sums - sums.max(1, keepdims=True))[number].astype(np.float32)


def viterbi(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The label of each word. Rows of words (begin, size) are walked side by side, the longest ones first."""
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest + 1), side="left")  # how many rows have more than t words
    stay, before = np.ones(scores.shape, bool), np.zeros(len(scores), np.int16)
    label, last = np.zeros(len(scores), np.int16), np.zeros(len(size), np.int16)
    d = np.zeros((len(size), scores.shape[1]), np.float32)
    for t in range(longest):
        k = live[t]
        at, d = begin[:k] + t, d[:k]
        if t:
            stay[at], before[at] = d >= -penalty, d.argmax(1)
            d = np.maximum(d, -penalty)
        d = d + scores[at]
        d -= d.max(1, keepdims=True)
        if live[t + 1] < k:
            last[live[t + 1] : k] = d[live[t + 1] :].argmax(1)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at, now = begin[:k] + t, last[:k]
        label[at] = now
        last[:k] = np.where(stay[at, now], now, before[at])
    return label


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", SPANS)])


def predict(model: dict, b: pa.RecordBatch) -> pa.RecordBatch:
    """Languages of the texts in the second column."""
    raw, at = utf8(b.column(1))
    n, langs = b.num_rows, model["langs"]
    data = _words.latin_lower(raw)
    starts, ends, rows = _words.find(data, at, _words.NO_LETTERS)
    foreign = np.flatnonzero(np.maximum.reduceat(np.append(raw, 0), at[:-1]) >= 0x80) if len(raw) else []
    for i in foreign:  # bytes beyond ASCII may be no letters
        if at[i] < at[i + 1] and not any(map(str.isalpha, raw[at[i] : at[i + 1]].tobytes().decode())):
            rows = np.where(rows == i, -1, rows)
    if not langs or not len(starts) or not (rows >= 0).any():
        return batch(SCHEMA, b.column(0), [UND] * n, [0.0] * n, pa.array([[]] * n, SPANS))
    starts, ends, rows = starts[rows >= 0], ends[rows >= 0], rows[rows >= 0]
    size = np.bincount(rows, minlength=n)
    begin = np.cumsum(size) - size
    there = np.flatnonzero(size)
    label = viterbi(word_scores(model, data, starts, ends), begin[there], size[there]).astype(np.int64)
    weight = np.bincount(rows * len(langs) + label, weights=ends - starts, minlength=n * len(langs)).reshape(n, -1)
    best = weight.argmax(1)
    score = np.divide(weight.max(1), weight.sum(1), out=np.zeros(n), where=size > 0)
    cut = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(label) != 0)))
    until = np.append(cut[1:], len(rows)) - 1
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    base = points[at[rows[cut]]]
    spans: list[list] = [[] for _ in range(n)]
    for row, begin_at, end_at, lang in zip(rows[cut].tolist(), (points[starts[cut]] - base).tolist(), (points[ends[until]] - base).tolist(), label[cut].tolist(), strict=True):
        spans[row].append({"start": begin_at, "end": end_at, "lang": langs[lang]})
    pred = [langs[i] if k else UND for i, k in zip(best.tolist(), size.tolist(), strict=True)]
    return batch(SCHEMA, b.column(0), pred, score, pa.array(spans, SPANS))


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of that language) and spans (start, end in code points, lang)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in pieces(batches, 1, STEP):
            yield predict(sent.value, b)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def in_language(df: DataFrame, model: dict, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which the text is in a learned language by at least this share."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(b):
        made = predict(sent.value, b)
        return [lang != UND and score >= least for lang, score in zip(made.column(1).to_pylist(), made.column(2).to_pylist(), strict=True)]

    return passing(df, text_col, judge)
