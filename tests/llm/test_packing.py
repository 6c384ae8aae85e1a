"""Best-fit packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoweave.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def lower_bound(lengths, capacity):
    """Martello and Toth's second lower bound."""
    best = -(-sum(lengths) // capacity)
    for k in {0} | {x for x in lengths if 2 * x <= capacity}:
        big = [x for x in lengths if x > capacity - k]
        middle = [x for x in lengths if capacity - k >= x > capacity // 2]
        small = [x for x in lengths if k <= x <= capacity // 2]
        best = max(best, len(big) + len(middle) + max(0, -(-(sum(small) - (len(middle) * capacity - sum(middle))) // capacity)))
    return best


def packed(lengths, capacity):
    plan = packing.Plan(Counter(lengths), capacity)
    filled = defaultdict(list)
    for s, runs in plan.arrays().items():
        ends = [*runs[1:, 0].tolist(), plan.used[s]]
        for (first, seq, off, each), end in zip(runs.tolist(), ends, strict=True):
            for r in range(first, end):
                filled[seq + (r - first) // each].append((off + (r - first) % each * s, s))
    assert Counter(s for x in filled.values() for _, s in x) == Counter(lengths)
    for x in filled.values():
        at = 0
        for off, s in sorted(x):
            assert off == at
            at += s
        assert at <= capacity
    assert sorted(filled) == list(range(plan.sequences))
    return plan


def fewest(lengths, capacity):
    """The fewest sequences, by trying all assignments."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= lengths[i]}:
            k = bins.index(room)
            go(i + 1, [*bins[:k], room - lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))]
    plan = packed(lengths, capacity)
    assert plan.sequences <= 1.1 * lower_bound(lengths, capacity) + 1
    few = lengths[:9]
    # what is fixed is provably no worse: the reduced instance needs as many as the whole
    plan = packed(few, capacity)
    rest = list((Counter(few) - Counter({s: n for s, n in reduced_use(few, capacity).items()})).elements())
    assert plan.fixed + fewest(rest, capacity) == fewest(few, capacity)


def reduced_use(lengths, capacity):
    class Only(packing.Plan):
        def _best_fit(self):
            pass

    return Counter({s: n for s, n in enumerate(Only(Counter(lengths), capacity).used) if n})


def test_tokens_equal_the_library():
    own = packing.Tokens(open(PATH, "rb").read())
    known = Tokenizer.from_file(PATH)
    known.encode_special_tokens = True
    rng = random.Random(5)
    for k in range(2000):
        text = "".join(rng.choice("aabcde the in éèüßÀ 012 ,.'sll\n\t\r\x0b\x85\xa0<|endoftext|>" + ("中🙂 " if k % 4 == 0 else "")) for _ in range(rng.randint(0, 60)))
        assert own.ids(text).tolist() == known.encode(text, add_special_tokens=False).ids
    assert own.fast is not None and own.ids("<|endoftext|>").tolist() == known.encode("<|endoftext|>", add_special_tokens=False).ids


def check(rows, texts):
    known = Tokenizer.from_file(PATH)
    known.encode_special_tokens = True
    want = Counter()
    for doc, text in texts:
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for x in filled.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 2048
    return len(filled)


def test_packing_query(spark, small):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = queries.op4_best_fit_packing(spark, small).collect()
    assert check(rows, texts) <= 1.02 * lower_bound([r.length for r in rows], 2048) + 1


def test_packing_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "x"), (5, "ab " * 9000), (6, "é中🙂"), (7, "word " * 2047), (8, "word " * 2046)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, length int, offset string")
    rows = packing.pack(df, PATH, keep_ids=True).collect()
    check(rows, texts)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(df.limit(0), PATH).count() == 0
