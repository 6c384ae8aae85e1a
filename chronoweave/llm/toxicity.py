"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (runs of letters and of all characters beyond ASCII, lower-cased) enter as a word vector and the mean of the vectors of their hashed
character n-grams. Two gated recurrent layers read windows of WINDOW words from either side, attention pools their
states, and a linear unit gives the window's logit. All overlapping windows of a text are scored, STRIDE words
apart, the last one at its end; a text's logit is the highest, and a logistic fit on rows kept out of training, over
it and the log of the number of windows, gives the score.

Learning: about PER_CLASS labelled rows of each class and of any length, chosen by a hash of the id. A toxic text
teaches by its most telling window (first by n-gram odds, then by the network itself), a clean one by its most
suspicious windows and some others. N-gram odds, the choice of windows and the fit over the highest logit come from
all windows of the rows, where the rows are; of a text with more than MOST windows, the half of MOST most telling ones
and as many spread over the whole text go to the one task that trains. The fit's constant undoes the classes'
different sampling rates, so that 0.5 lies where it does for the labels as they are.

Defined cases: null text, empty text, or one without a word has the score that a text of the lowest logit has;
without labels of both classes, or without a word in any labelled text, every score is the share of toxic ones, or 0;
with fewer than five rows of a class none are kept out, and the score is the network's own; rows with a null id or label teach
nothing; of several labels of one row the highest counts; repeated rows are kept as rows; an empty table gives an
empty result; other columns are not read. Memory is bounded by STEP bytes of text or one text.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._base import batch, forget, keep, passing, pieces, utf8
from .langid import sampled, shares

WINDOW, STRIDE, HIDDEN, WIDTH, POOL = 32, 16, 8, 8, 8
SIZES, BUCKETS, VOCABULARY = (3, 4, 5), 1 << 14, 4096
PER_CLASS, MOST, EPOCHS, LEAST, LOT, SEED, STEP = 1200, 64, (8, 6), (300, 200), 128, 11, 4 << 20
CLIP = 30.0
#: Words and n-grams in fewer rows of the sample have no vectors of their own; the weights' decay.
RARE, DECAY = 4, 0.02


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -CLIP, CLIP)))


class Texts:
    """Words of a column: for each row its words as numbers of distinct words, and their features."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        data = _words.latin_lower(raw)
        starts, ends, rows = _words.find(data, at, _words.NO_LETTERS)
        self.data, self.starts, self.ends = data, starts, ends
        hashed, first, self.number = _words.distinct(_words.hashes(data, starts, ends))
        self.hashed = hashed
        self.size = np.bincount(rows, minlength=len(at) - 1)
        self.begin = np.cumsum(self.size) - self.size
        self.gram, self.first = _words.grams(data, starts[first], ends[first], SIZES, BUCKETS) if len(first) else (np.zeros((0, len(SIZES)), np.int64), np.zeros(0, np.int64))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and number of words of every window."""
        many = np.where(self.size > WINDOW, -(-(self.size - WINDOW) // STRIDE), 0) + (self.size > 0)
        row = np.repeat(np.arange(len(self.size)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = np.minimum(k * STRIDE, np.maximum(0, self.size[row] - WINDOW))
        return row, self.begin[row] + start, np.minimum(WINDOW, self.size[row])


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, d = HIDDEN, 2 * WIDTH
    draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    return {
        "word": draw(VOCABULARY + 1, WIDTH, scale=0.1), "gram": draw(BUCKETS, WIDTH, scale=0.1),
        "wx": draw(2, d, 3 * h, scale=d**-0.5), "b": np.zeros((2, 3 * h), np.float32), "wh": draw(2, h, 3 * h, scale=h**-0.5),
        "wa": draw(2 * h, POOL, scale=0.35), "v": draw(POOL, scale=0.5), "w": draw(2 * h, scale=0.5), "b0": np.zeros(1, np.float32),
    }


def inputs(w: dict, texts: Texts, vocabulary: np.ndarray) -> np.ndarray:
    """Input vectors of the distinct words: word vector, then the mean of their n-grams' vectors times 2."""
    place = np.searchsorted(vocabulary, texts.hashed) if len(vocabulary) else np.zeros(len(texts.hashed), np.int64)
    known = np.zeros(len(texts.hashed), bool)
    if len(vocabulary):
        known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == texts.hashed
    word = w["word"][np.where(known, place, VOCABULARY)]
    sums = np.add.reduceat(w["gram"][texts.gram].sum(1), texts.first, axis=0)
    n = np.diff(np.append(texts.first, len(texts.gram))) * len(SIZES)
    return np.concatenate([word, sums * (2.0 / n[:, None]).astype(np.float32)], 1)


def forward(w: dict, gates: np.ndarray, index: np.ndarray, size: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Logits of windows. gates: [2, distinct words, 3h]; index: [time, windows], the words; size: words of each."""
    h, steps, many = HIDDEN, *index.shape
    state = np.zeros((2, many, h), np.float32)
    states = np.empty((2, steps, many, h), np.float32)
    whole = bool((size == steps).all())
    for t in range(steps):
        back = steps - 1 - t
        p = np.stack([gates[0][index[t]], gates[1][index[back]]])
        q = state @ w["wh"]
        zr = _sigmoid(p[..., : 2 * h] + q[..., : 2 * h])
        z, r = zr[..., :h], zr[..., h:]
        new = np.tanh(p[..., 2 * h :] + r * q[..., 2 * h :])
        after = new + z * (state - new)
        if not whole:
            there = np.stack([t < size, back < size])[..., None]
            after = np.where(there, after, state)
        if kept is not None:
            kept.setdefault("steps", []).append((state, z, r, new, q[..., 2 * h :]))
        state = states[:, t] = after
    both = np.concatenate([states[0], states[1][::-1]], 2)
    inner = np.tanh(both @ w["wa"])
    score = inner @ w["v"]
    if not whole:
        score = np.where(np.arange(steps)[:, None] < size, score, -1e9)
    share = np.exp(score - score.max(0))
    share /= share.sum(0)
    pooled = (share[..., None] * both).sum(0)
    if kept is not None:
        kept |= {"both": both, "inner": inner, "share": share, "pooled": pooled}
    return pooled @ w["w"] + w["b0"]


def backward(w: dict, kept: dict, size: np.ndarray, grad: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights but the tables, and of the gates' inputs [2, time, windows, 3h]."""
    h, both, inner, share = HIDDEN, kept["both"], kept["inner"], kept["share"]
    steps, many = share.shape
    out = {"w": grad @ kept["pooled"], "b0": grad.sum(keepdims=True)}
    d_pooled = grad[:, None] * w["w"]
    d_share = (both * d_pooled).sum(2)
    d_score = share * (d_share - (share * d_share).sum(0))
    out["v"] = np.einsum("tb,tbp->p", d_score, inner)
    d_inner = d_score[..., None] * w["v"] * (1 - inner**2)
    out["wa"] = np.einsum("tbi,tbp->ip", both, d_inner)
    d_both = share[..., None] * d_pooled + d_inner @ w["wa"].T
    d_states = np.stack([d_both[..., :h], d_both[::-1, :, h:]])
    d_gates = np.zeros((2, steps, many, 3 * h), np.float32)
    d_state, out["wh"] = np.zeros((2, many, h), np.float32), np.zeros_like(w["wh"])
    for t in range(steps - 1, -1, -1):
        state, z, r, new, q = kept["steps"][t]
        d = d_state + d_states[:, t]
        there = np.stack([t < size, steps - 1 - t < size])[..., None]
        own = np.where(there, d, 0)
        d_z = own * (state - new) * z * (1 - z)
        d_new = own * (1 - z) * (1 - new**2)
        d_r = d_new * q * r * (1 - r)
        d_gates[:, t] = np.concatenate([d_z, d_r, d_new], 2)
        d_q = np.concatenate([d_z, d_r, d_new * r], 2)
        out["wh"] += state.transpose(0, 2, 1) @ d_q
        d_state = np.where(there, own * z + d_q @ w["wh"].transpose(0, 2, 1), d)
    return out, d_gates


def _index(texts: Texts, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct words of windows, [time, windows]; places beyond a short window repeat its last word."""
    t = np.minimum(np.arange(WINDOW)[:, None], size - 1)
    return texts.number[first + t]


def logits(w: dict, texts: Texts, vocabulary: np.ndarray, first: np.ndarray, size: np.ndarray, lot: int = 4096) -> np.ndarray:
    """Logits of windows, full ones and short ones apart."""
    out = np.zeros(len(first), np.float32)
    if not len(first):
        return out
    x = inputs(w, texts, vocabulary)
    gates = np.stack([x @ w["wx"][k] + w["b"][k] for k in range(2)])
    for own in (np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)):
        for i in range(0, len(own), lot):
            some = own[i : i + lot]
            out[some] = forward(w, gates, _index(texts, first[some], size[some]), size[some])
    return out


class Adam:
    """Adam with decay; rows where ``free`` is false stay as they are."""

    def __init__(self, w: dict, rate: float, free: dict):
        self.rate, self.t, self.free = rate, 0, free
        self.m, self.s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, w: dict, grads: dict) -> None:
        self.t += 1
        size = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            w[k] -= (size * self.m[k] / (np.sqrt(self.s[k]) + 1e-7) + self.rate * DECAY * w[k]) * self.free.get(k, 1)


def train_on(w: dict, adam: Adam, texts: Texts, vocabulary: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Logistic loss over windows, with either class weighing the same."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32) * len(y)
    place = np.searchsorted(vocabulary, texts.hashed) if len(vocabulary) else np.zeros(len(texts.hashed), np.int64)
    known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == texts.hashed if len(vocabulary) else np.zeros(len(texts.hashed), bool)
    row = np.where(known, place, VOCABULARY)
    until = np.append(texts.first, len(texts.gram))
    for _ in range(epochs):
        order = rng.permutation(len(first))
        for i in range(0, len(order), LOT):
            some = order[i : i + LOT]
            index = _index(texts, first[some], size[some])
            there, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            n = until[there + 1] - until[there]
            flat = np.repeat(until[there] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            grams = texts.gram[flat]
            begin = np.cumsum(n) - n
            scale = (2.0 / (n * len(SIZES)))[:, None].astype(np.float32)
            x = np.concatenate([w["word"][row[there]], np.add.reduceat(w["gram"][grams].sum(1), begin, axis=0) * scale], 1)
            gates = np.stack([x @ w["wx"][k] + w["b"][k] for k in range(2)])
            kept: dict = {}
            z = forward(w, gates, local, size[some], kept)
            grad = ((_sigmoid(z) - y[some]) * weight[some] / len(some)).astype(np.float32)
            grads, d_gates = backward(w, kept, size[some], grad)
            d_gates[1] = d_gates[1][::-1]
            d_rows = np.zeros((2, len(there), 3 * HIDDEN), np.float32)
            for k in range(2):
                np.add.at(d_rows[k], local.reshape(-1), d_gates[k].reshape(-1, 3 * HIDDEN))
            grads["wx"] = np.stack([x.T @ d_rows[k] for k in range(2)])
            grads["b"] = d_rows.sum(1)
            d_x = d_rows[0] @ w["wx"][0].T + d_rows[1] @ w["wx"][1].T
            grads["word"] = np.zeros_like(w["word"])
            np.add.at(grads["word"], row[there], d_x[:, :WIDTH])
            grads["gram"] = np.zeros_like(w["gram"])
            each = np.repeat(d_x[:, WIDTH:] * scale, n, axis=0)
            for k in range(len(SIZES)):
                np.add.at(grads["gram"], grams[:, k], each)
            adam.step(w, grads)


def _seen(texts: Texts, y: np.ndarray, taught: np.ndarray) -> np.ndarray:
    """[class, n-gram]: in how many stretches of WINDOW words of a class's taught rows each n-gram is; last in each class,
    how many stretches it has. Then, for each n-gram, in how many rows it is."""
    n = np.diff(np.append(texts.first, len(texts.gram)))
    out = np.zeros((3, BUCKETS + 1), np.int64)
    for i in np.flatnonzero(taught).tolist():
        begin, size = int(texts.begin[i]), int(texts.size[i])
        words = len(texts.first)
        pair = np.unique(np.arange(size) // WINDOW * words + texts.number[begin : begin + size])
        stretch, word = pair // max(1, words), pair % max(1, words)
        many = n[word]
        flat = np.repeat(texts.first[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        grams = texts.gram[flat]
        each = np.unique(np.repeat(stretch, many)[:, None] * BUCKETS + grams) % BUCKETS
        out[int(y[i]), :BUCKETS] += np.bincount(each, minlength=BUCKETS)
        out[int(y[i]), BUCKETS] += -(-size // WINDOW)
        out[2, np.unique(each)] += 1
        out[2, BUCKETS] += 1
    return out


def _odds(seen: np.ndarray) -> np.ndarray:
    """The log odds of each n-gram, by stretches, to be in a toxic one, over their standard error. One stretch of either
    class is added in proportion to the classes' sizes, so that an unseen n-gram tells nothing, however unlike they are."""
    (b, a), (clean, toxic) = seen[:2, :BUCKETS], np.maximum(1, seen[:2, BUCKETS])
    a, b = a + toxic / (clean + toxic), b + clean / (clean + toxic)
    return np.log(a / toxic * clean / b) / np.sqrt(1 / a + 1 / b)


def _telling(texts: Texts, odds: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The highest of the means over its n-grams of a window's words."""
    n = np.diff(np.append(texts.first, len(texts.gram)))
    by_word = np.add.reduceat(odds[texts.gram].sum(1), texts.first) / (n * len(SIZES))
    return np.where(np.arange(WINDOW)[:, None] < size, by_word[_index(texts, first, size)], -99).max(0)


def excerpts(raw: np.ndarray, at: np.ndarray, odds: np.ndarray) -> list[tuple[int, list[bytes]]]:
    """For each text its number of windows and its words as parts: one of all words, or beyond MOST windows one for
    each of the most telling and of some spread over the whole text."""
    own = Texts(raw, at)
    row, first, size = own.windows()
    value = _telling(own, odds, first, size) if len(first) else np.zeros(0)
    many = np.bincount(row, minlength=len(at) - 1)
    words = lambda begin, n: b" ".join(own.data[s:e].tobytes() for s, e in zip(own.starts[begin : begin + n], own.ends[begin : begin + n], strict=True))
    out, done = [], 0
    for i, n in enumerate(many.tolist()):
        if n <= MOST:
            parts = [words(own.begin[i], own.size[i])]
        else:
            best = np.argsort(-value[done : done + n], kind="stable")[: MOST // 2]
            rest = np.setdiff1d(np.arange(n), best)
            spread = rest[np.linspace(0, len(rest) - 1, MOST - len(best)).round().astype(np.int64)]
            parts = [words(first[done + k], size[done + k]) for k in np.sort(np.append(best, spread)).tolist()]
        out.append((n, parts))
        done += n
    return out


def _top(row: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values of each row."""
    order = np.lexsort((-value, row))
    own = row[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return order[rank < k]


def _kept_out(ids: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A fifth of the ids of either class, for the fit over the highest logit."""
    own = [np.unique(ids[y == k]) for k in (0, 1)]
    return np.concatenate([rng.permutation(x)[: len(x) // 5] for x in own])


def fit(texts: list[str], y: np.ndarray, seed: int = SEED) -> dict:
    """A model from texts and their labels (1 toxic, 0 clean)."""
    y = np.asarray(y, np.int64)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    rng = np.random.default_rng(seed)
    kept_out = np.isin(np.arange(len(y)), _kept_out(np.arange(len(y)), y, rng))
    raw, at = utf8(pa.array(texts))
    seen = _seen(Texts(raw, at), y, ~kept_out)
    model = train([parts for _, parts in excerpts(raw, at, _odds(seen))], y, kept_out, seen, rng)
    if "constant" in model:
        return model
    peak, many = peaks(model, raw, at)
    return calibrated(model, peak[kept_out], many[kept_out], y[kept_out])


def train(texts: list[list[bytes]], y: np.ndarray, kept_out: np.ndarray, seen: np.ndarray, rng: np.random.Generator) -> dict:
    """The network from the parts of each text."""
    own = Texts(*utf8(pa.array([p for parts in texts for p in parts], pa.binary())))
    row, first, size = own.windows()
    owner = np.repeat(np.arange(len(y)), [len(parts) for parts in texts])
    row = owner[row]
    use = ~kept_out[row]
    if not use.any():
        return {"constant": float(y.mean())}
    words = np.bincount(owner, own.size, len(y)).astype(np.int64)
    pairs = np.unique(np.repeat(np.arange(len(y)), words) * len(own.hashed) + own.number) % max(1, len(own.hashed))
    often = np.bincount(pairs, minlength=len(own.hashed))
    chosen = np.lexsort((own.hashed, -often))[:VOCABULARY]
    vocabulary = np.sort(own.hashed[chosen[often[chosen] >= RARE]])
    odds, rows_of = _odds(seen), seen[2, :BUCKETS]
    value = _telling(own, odds, first, size)
    w = start_weights(rng)
    w["gram"][:, 0] = odds / 2  # where training starts from; the other dimensions start at random
    w["gram"][rows_of < RARE] = 0
    adam = Adam(w, 0.01, {"gram": (rows_of >= RARE)[:, None]})
    for round_, epochs in enumerate(EPOCHS):
        if round_:
            value = np.full(len(row), -99.0)
            value[use] = logits(w, own, vocabulary, first[use], size[use])
            adam.rate = 0.003
        bad, good = use & (y[row] == 1), use & (y[row] == 0)
        teach = [np.flatnonzero(bad)[_top(row[bad], value[bad], 1)], np.flatnonzero(good)[_top(row[good], value[good], 2)], np.flatnonzero(good)[_top(row[good], rng.random(int(good.sum())), 2)]]
        teach = np.concatenate(teach)
        epochs = max(epochs, -(-LEAST[round_] * LOT // len(teach)))  # small samples need more rounds
        train_on(w, adam, own, vocabulary, first[teach], size[teach], y[row[teach]].astype(np.float32), epochs, rng)
    return {"w": w, "vocabulary": vocabulary, "low": -8.0, "line": np.array([1.0, 0.0, 0.0])}


def calibrated(model: dict, peak: np.ndarray, many: np.ndarray, y: np.ndarray, tilt: float = 0.0) -> dict:
    """The model with the fit over the highest logits and numbers of windows of texts it has not learned from. tilt:
    the log of the sampling rate of toxic rows over that of clean ones."""
    some = many > 0
    if len(np.unique(y[some])) < 2:
        return model
    low = float(np.clip(np.quantile(peak[some], 0.02), -20, -4))
    return model | {"low": low, "line": _line(peak[some], np.log(many[some]), y[some]) - np.array([0.0, 0.0, tilt])}


def _line(peak: np.ndarray, many: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the highest logit, the log number of windows and 1; pulled to 1, 0 and 0."""
    x, start, pull = np.stack([np.clip(peak, -CLIP, CLIP), many, np.ones(len(y))], 1), np.array([1.0, 0.0, 0.0]), np.array([5.0, 5.0, 1.0])
    loss = lambda v: np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ v)).sum() + (pull * (v - start) ** 2).sum() / 2
    line = start.copy()
    for _ in range(50):
        p = _sigmoid(x @ line)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (line - start))
        while np.abs(step).max() > 1e-9 and loss(line - step) > loss(line):
            step = step / 2
        line = line - step
    return line if line[0] > 0.05 else start


def peaks(model: dict, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest logit and the number of windows of each text."""
    own = Texts(raw, at)
    row, first, size = own.windows()
    peak = np.full(len(at) - 1, -np.inf)
    np.maximum.at(peak, row, logits(model["w"], own, model["vocabulary"], first, size))
    return peak, np.bincount(row, minlength=len(at) - 1)


def score_texts(model: dict, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of windows of each text."""
    n = len(at) - 1
    if "constant" in model:
        return np.full(n, model["constant"]), np.zeros(n, np.int64)
    peak, many = peaks(model, raw, at)
    peak = np.where(many > 0, peak, model["low"])
    return _sigmoid(np.stack([peak, np.log(np.maximum(1, many)), np.ones(n)], 1) @ model["line"]), many


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> dict:
    """A model from about ``per_class`` rows of each class of ``labels`` (id and 0/1) that are in ``df``."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    share = shares(rows, "toxic", per_class)
    some = sampled(rows, "toxic", "doc_id", per_class, share)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # about 2 * per_class ids at most, whatever the tables' sizes
    rows = keep(texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    model = _learned(rows, share)
    forget(rows)
    return model


SEEN = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])
PARTS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("parts", pa.list_(pa.binary()))])
PEAKS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("peak", pa.float64()), ("many", pa.int64())])
PACKED = pa.schema([("packed", pa.binary())])


def _counts(sums: pa.Table) -> np.ndarray:
    """As _seen() gives it, of rows kind, bucket and n."""
    seen = np.zeros((3, BUCKETS + 1), np.int64)
    seen[sums["kind"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return seen


def _learned(rows: DataFrame, share: dict, seed: int = SEED) -> dict:
    """fit() over a table (doc_id, text, toxic): whole texts are read where they are, and the network is trained in one
    task on the excerpts of the sample; the driver gets packed counts, the weights and the highest logits.
    share: the sampling rate of each class."""
    ids = sorted(map(tuple, rows.select("doc_id", "toxic").collect()))  # the sample: about per_class rows of each class
    y = np.array([k for _, k in ids], np.int64)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    rng = np.random.default_rng(seed)
    out = _kept_out(np.array([i for i, _ in ids], np.int64), y, rng)

    def counted(batches):
        seen = np.zeros((3, BUCKETS + 1), np.int64)
        for b in pieces(batches, 1, STEP):
            seen += _seen(Texts(*utf8(b.column(1))), b.column(2).to_numpy(), ~np.isin(b.column(0).to_numpy(), out))
        kind, bucket = np.nonzero(seen)
        yield batch(SEEN, pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(seen[kind, bucket]))

    def packed(batches):
        held = [pa.Table.from_batches([b]) for b in batches]
        yield batch(PACKED, [(_counts(pa.concat_tables(held)) if held else np.zeros((3, BUCKETS + 1), np.int64)).tobytes()])

    sums = rows.mapInArrow(counted, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    seen = np.frombuffer(sums.coalesce(1).mapInArrow(packed, "packed binary").first().packed, np.int64).reshape(3, -1)
    odds = _odds(seen)

    def cut(batches):
        for b in pieces(batches, 1, STEP):
            yield batch(PARTS, b.column(0), b.column(2), [parts for _, parts in excerpts(*utf8(b.column(1)), odds)])

    def trained(batches):
        found = sorted((i, [bytes(p) for p in parts], k) for b in batches for i, k, parts in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = train([parts for _, parts, _ in found], np.array([k for *_, k in found]), np.isin([i for i, *_ in found], out), seen, rng)
        yield batch(PACKED, [pickle.dumps(model)])

    # one task holds the excerpts of the sample: 2 * per_class rows of MOST windows of WINDOW words at most
    made = keep(rows.mapInArrow(cut, "doc_id long, toxic int, parts array<binary>"), "excerpts")
    model = pickle.loads(made.coalesce(1).mapInArrow(trained, "packed binary").first().packed)
    forget(made)
    if "constant" in model:
        toxic, clean = y.sum() / share[1], (1 - y).sum() / share[0]
        return {"constant": float(toxic / (toxic + clean))}
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def highest(batches):
        for b in pieces(batches, 1, STEP):
            yield batch(PEAKS, b.column(0), b.column(2), *peaks(sent.value, *utf8(b.column(1))))

    check = rows.where(F.col("doc_id").isin(out.tolist())).mapInArrow(highest, "doc_id long, toxic int, peak double, many long").collect()
    sent.destroy()
    peak, many, toxic = (np.array(x) for x in zip(*sorted((r.peak, r.many, r.toxic) for r in check), strict=True)) if check else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return calibrated(model, peak, many, toxic, float(np.log(share[1] / share[0])))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_windows", pa.int64())])


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and n_windows for every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in pieces(batches, 1, STEP):
            yield batch(SCHEMA, b.column(0), *score_texts(sent.value, *utf8(b.column(1))))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_windows long")


def clean(df: DataFrame, model: dict, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which the text scores below a threshold."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return passing(df, text_col, lambda b: score_texts(sent.value, *utf8(b.column(1)))[0] < below)
