"""Spelling variants: words one edit apart, found by hashes of all their one-letter deletions.

Words are counted in each task before they are exchanged. Two words are one edit apart if they are equal after
deleting the same place of both (a letter replaced), or if one without a letter is the other (a letter inserted or
deleted). A word's keys are the hashes of its deletions and of itself: prefix and suffix sums of a polynomial give
all of them at once, for all words of a length, as numpy integers. Keys are dealt by their upper bits into blocks of
bytes (BLOCK keys for a task to hold), sorted there, and only keys with company go on: those of at least two words at
one place, or of a word and of deletions that may be that word. They meet their words again by a join, and the
strings themselves, put in the order of keys, tell true company from hashes that merely agree.

No pairs are made. Where g words share a place's deletion, each has g - 1 near words, and the best of them is the
group's first or second; a word and the words that hold it plus a letter are counted alike. Such a group has no more
words than a place can have letters, times the places. Forms are followed by doubling: a form has at least TIMES as
many occurrences, so the number of rounds follows from the largest count.

Defined cases: null texts have no words; a null id counts as the empty text where a run's checksum is taken; repeated
rows count each; ties are broken by the word; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import batch, forget, keep, pieces
from ._words import mix

#: Code points that a word has at least, occurrences that it has at least, how many times more its form has.
LEAST, OFTEN, TIMES = 7, 2, 10
#: One run of SLIP loses a letter.
SLIP = 31
#: Distinct words counted in a task before they are sent, keys held by a task, keys made at once.
HELD, BLOCK, STEP = 400_000, 3_000_000, 500_000
_RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST},}}")
_U = np.uint64
_B = _U(0x5851F42D4C957F2D)
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_BLOCKS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("names", pa.binary()), ("places", pa.binary())])
_LEFT = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("place", pa.int32())])
_NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.int64()), ("other_n", pa.int64()), ("other", pa.string())])


def slipped(doc_id: object, runs: Counter) -> Counter:
    """The words of one document's lower-cased runs: a run loses a letter if its checksum with the id says so."""
    begin, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), begin)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST:
                continue
        out[run] += n
    return out


def _counted(batches):
    held: Counter = Counter()
    for b in pieces(batches, 1):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                held.update(slipped(doc_id, Counter(_RUN.findall(text.encode().lower().decode()))))
                if len(held) > HELD:
                    yield batch(_COUNTS, list(held), list(held.values()))
                    held = Counter()
    yield batch(_COUNTS, list(held), list(held.values()))


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: all words with at least OFTEN occurrences."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def deletion_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length [word, letter] as Latin-1 bytes: the keys of all deletions [word, place], of the words, and
    where deleting a place gives the same string as deleting the one before."""
    size = letters.shape[1]
    value = letters.astype(np.uint64) + _U(1)
    power = np.cumprod(np.full(size, _B, np.uint64))
    head = np.zeros((len(letters), size + 1), np.uint64)
    np.cumsum(value * power, axis=1, out=head[:, 1:])
    shifted = value[:, 1:] * power[:-1]  # each letter one place to the left
    tail = np.zeros((len(letters), size), np.uint64)
    tail[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1)[:, ::-1]
    same = np.zeros(letters.shape, bool)
    same[:, 1:] = letters[:, 1:] == letters[:, :-1]
    return mix(head[:, :-1] + tail + _U(size - 1)), mix(head[:, -1] + _U(size)), same


def _blocks(buckets: int):
    """Keys of words, as one row of bytes for each bucket: keys, names and places (-1: the word itself; else twice the
    place, plus one if deleting the place before gives the same)."""
    shift = _U(64 - max(1, buckets.bit_length() - 1))

    def dealt(keys, names, places):
        keys, names, places = np.concatenate(keys), np.concatenate(names), np.concatenate(places)
        bucket = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, names, places, bucket = keys[order], names[order], places[order], bucket[order]
        first = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
        ends = np.append(first[1:], len(bucket))
        return batch(_BLOCKS, bucket[first].astype(np.int32), *([x[a:e].tobytes() for a, e in zip(first, ends, strict=True)] for x in (keys, names, places)))

    def run(batches):
        held, many = ([], [], []), 0
        for b in batches:
            words = np.array([w.encode("latin-1") for w in b.column(0).to_pylist()], object)
            names = b.column(1).to_numpy()
            sizes = np.array([len(w) for w in words])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                step = max(1, STEP // (size + 1))
                for own in (rows[i : i + step] for i in range(0, len(rows), step)):
                    letters = np.frombuffer(b"".join(words[own]), np.uint8).reshape(-1, size)
                    out, full, same = deletion_keys(letters)
                    place = 2 * np.arange(size, dtype=np.int32) + same.astype(np.int32)
                    for x, parts in zip(held, ((out.reshape(-1), full), (np.repeat(names[own], size), names[own]), (place.reshape(-1), np.full(len(own), -1, np.int32))), strict=True):
                        x.extend(parts)
                    many += len(own) * (size + 1)
                    if many >= STEP:
                        yield dealt(*held)
                        held, many = ([], [], []), 0
        if many:
            yield dealt(*held)

    return run


def with_company(keys: np.ndarray, names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that at least two words share at one place, or a word with deletions."""
    order = np.argsort(keys)
    keys = keys[order]
    twice = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = keys[1:] == keys[:-1]
        twice[1:] = equal
        twice[:-1] |= equal
    order, keys = order[twice], keys[twice]
    names, places = names[order], places[order]
    order = np.lexsort((places >> 1, keys))
    keys, names, places = keys[order], names[order], places[order]
    if not len(keys):
        return keys, names, places
    new_key = np.append(True, keys[1:] != keys[:-1])
    new_place = new_key | np.append(True, (places[1:] >> 1) != (places[:-1] >> 1))
    key_at, place_at = np.cumsum(new_key) - 1, np.cumsum(new_place) - 1
    full = places == -1
    n, fulls, at_place = np.bincount(key_at), np.bincount(key_at, full), np.bincount(place_at)
    met = (fulls > 0)[key_at] & (n > fulls)[key_at] & (full | (places & 1 == 0))
    good = met | (~full & (at_place > 1)[place_at])
    return keys[good], names[good], places[good]


def _survivors(batches):
    held: tuple = ([], [], [])
    for b in batches:
        for into, column, kind in zip(held, b.columns[1:], (np.uint64, np.int64, np.int32), strict=True):
            into.extend(np.frombuffer(x, kind) for x in column.to_pylist())
    if held[0]:
        keys, names, places = with_company(*(np.concatenate(x) for x in held))
        for i in range(0, len(keys), 1 << 16):
            own = slice(i, i + (1 << 16))
            yield batch(_LEFT, keys[own].view(np.int64), names[own], places[own])


def near_of(group: list[tuple[int, str, int]]):
    """word, number of near words, the best one's n, the best one: of (place, word, n) that share a key. Strings decide
    which of them belong together."""
    true: dict[str, list] = {}
    for place, word, n in group:
        true.setdefault(word if place < 0 else word[: place >> 1] + word[(place >> 1) + 1 :], []).append((place, word, n))
    for rows in true.values():
        if len(rows) < 2:
            continue
        by_place: dict[int, dict] = {}
        for place, word, n in rows:
            by_place.setdefault(place >> 1, {})[word] = n
        whole = by_place.pop(-1, {})
        more: dict[str, int] = {}
        for place, word, n in rows:
            if place >= 0 and not place & 1:
                more[word] = n
        for word, n in whole.items():  # at most one: the shared string itself
            if more:
                best = min(more, key=lambda w: (-more[w], w))
                yield word, len(more), more[best], best
                for other in more:
                    yield other, 1, n, word
        for own in by_place.values():
            if len(own) > 1:
                first, second = sorted(own, key=lambda w: (-own[w], w))[:2]
                for word in own:
                    best = second if word == first else first
                    yield word, len(own) - 1, own[best], best


def _verified(batches):
    """Rows in the order of their keys: key, place, word, n."""
    last, group, out = None, [], []

    def done():
        words, near, other_n, other = ([x[i] for x in out] for i in range(4))
        return batch(_NEAR, words, [None] * len(out), near, other_n, other)

    for b in batches:
        for key, place, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != last:
                if len(group) > 1:
                    out.extend(near_of(group))
                last, group = key, []
            group.append((place, word, n))
        if len(out) > 50_000:
            yield done()
            out = []
    if len(group) > 1:
        out.extend(near_of(group))
    yield done()


def group(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n from word, n (distinct words of Latin-1 letters)."""
    words = keep(words.select("word", F.xxhash64("word").alias("name"), "n"), "spelling-words")
    size = words.agg(F.sum(F.length("word") + 1).alias("keys"), F.max("n").alias("n")).first()
    tasks = (size["keys"] or 0) // BLOCK + 1
    buckets = 1 << (8 * tasks - 1).bit_length()
    made = words.select("word", "name").mapInArrow(_blocks(buckets), "bucket int, keys binary, names binary, places binary")
    left = made.repartition(tasks, "bucket").mapInArrow(_survivors, "key long, name long, place int")
    met = left.join(words, "name").select("key", "place", "word", "n")
    near = met.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "word string, n long, near long, other_n long, other string")
    each = near.unionByName(words.select("word", "n"), allowMissingColumns=True).groupBy("word").agg(
        F.max("n").alias("n"), F.coalesce(F.sum("near"), F.lit(0)).alias("n_near"), F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other"))).alias("best")
    )
    enough = -F.col("best.less") >= TIMES * F.col("n")
    told = keep(each.select("word", F.when(enough, F.col("best.other")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-forms")
    forget(words)
    steps = int(math.log(max(TIMES, (size["n"] or 0) / OFTEN), TIMES) + 1e-9)
    roots = told.where("form IS NOT NULL").withColumn("root", F.col("form"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = keep(roots.join(next_, "root", "left").withColumn("root", F.coalesce("beyond", "root")).drop("beyond"), "spelling-roots")
    plain = told.where("form IS NULL").withColumn("root", F.col("word"))
    return roots.unionByName(plain).select("word", "form", "root", "n", "n_near", "form_n")
