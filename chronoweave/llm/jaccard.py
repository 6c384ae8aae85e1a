"""N-gram Jaccard join: documents linked by similar sets of word shingles, and the groups that the links make.

Texts are cut at ASCII blanks, A to Z lower-cased; a set holds the distinct shingles of SIZE words, as 64-bit hashes.
Two sets link if ``100 * both >= PERCENT * either``. The join is exact up to collisions of 64-bit hashes:

1. Equal sets are one, told by a 64-bit sum of their hashes. All that follows works on distinct sets.
2. Shingles are counted over all distinct sets: each stretch of text sends its shingles, packed as arrays, to the part
   of the hash range they belong to; the part knows in how many sets each is, and sends those of two or more sets on
   to the lot of their set. Shingles that are frequent already within a stretch (at most FREQUENT of them) are known
   beforehand and stay out of that exchange.
3. A set's prefix are its first ``n - ceil(n * PERCENT / 100) + 1`` shingles in an order that all sets share, so two
   sets that link share a shingle of their prefixes. The order: three quarters of the hash space (told by
   two bits), the last quarter, then the frequent ones; rarest first within each. The prefix is about a quarter of a
   set, so the first part mostly holds it and the second part isn't exchanged for that set. Shingles of one set alone come first and make no
   bucket, so what many documents share makes one only where there is little else. Buckets of the same sets are one.
4. A set is a point: its shingles hashed to groups, counted. The number of groups grows with the set (one for each
   one or two shingles); halves add up, so sets of different sizes compare at the coarser number. The sum over groups
   of the smaller counts bounds the intersection from above.
5. Points are searched in R-trees (packed by size and leading groups): a query goes down to the nodes whose upper
   corners leave the bound high enough. First each set is searched among those with which it shares its pivot, the
   least set of the buckets that it shares most shingles with; of the pairs that the tree can't rule out, those of a
   spanning forest of the highest bounds are verified on the shingles themselves. That joins most of a group of near
   copies at one pair for each set.
6. Then every bucket whose sets are not all joined is searched; pairs of joined sets are left out. The bucket's other
   sets go as queries to its main group, which lies in blocks of BLOCK sets that all buckets share, so a query goes to
   a block once; among each other they are searched in pairs of blocks, unless they are all in one larger bucket. Of
   these a pair counts only in the first bucket that both sets are in, which each set's list of buckets tells. A forest
   of the highest bounds comes first again; where more candidates are left, the STEPS best between each two groups,
   then STEPS times as many, and so on until the groups are joined or no candidate is left. So no link between groups
   is lost.

Defined cases: a null or empty text, or one of blanks alone, has no shingles and no links; fewer than SIZE words are
one shingle; rows with a null id get their n_shingles and no component; rows that repeat an id are one document and
link by any of their texts; an empty table gives an empty result; other columns are not read. A task holds STEP
bytes of text or one text, FLUSH shingles, one part or lot of about PART shingles, two blocks of points, or one pair
of sets. FREQUENT and MAP_BITS bound what is broadcast; they change the work, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _words
from ._base import batch, binary, forget, free_name, give_back, keep, pieces, utf8

SIZE, PERCENT, BLOCK, FAN, FREQUENT, STEP, FLUSH, PART, LEAST_GROUPS = 5, 75, 1024, 8, 1 << 20, 2 << 20, 1 << 21, 1 << 21, 64
#: Sets of a stretch that make a shingle frequent, and sets of a stretch at most (their numbers have 16 bits).
OFTEN, MOST_SETS = 4, 60_000
#: Rounds of searches by pivot; the buckets are searched after them whatever they have left.
ROUNDS, STEPS = 2, 32
#: Jumps to the label's label in each written step of components(); chains of that many ends need no second one.
JUMPS = 3
#: Pairs that are broadcast at most (16 bytes each); beyond, they are joined by shuffles.
SENT_PAIRS = 1 << 20
#: The most bits of the map that spares texts a second look; beyond, texts are joined instead.
MAP_BITS = 1 << 27
_FACTOR = _words.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_U = np.uint64


def shingles(raw: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows, and where each row's begin (one more than rows)."""
    data = _words.ascii_lower(raw)
    starts, ends, rows = _words.find(data, at, _words.BLANKS)
    words = _words.hashes(data, starts, ends)
    n = len(at) - 1
    many = np.bincount(rows, minlength=n)
    first = np.cumsum(many) - many
    out = []
    if len(words) >= size:
        run = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            run += words[k : k + len(run)] * _FACTOR[k]
        run = _words.mix(run)
    for i in range(n):
        m, f = int(many[i]), int(first[i])
        if m >= size:
            out.append(np.unique(run[f : f + m - size + 1]))
        elif m:
            out.append(_words.mix((words[f : f + m] * _FACTOR[size : size + m]).sum(keepdims=True, dtype=np.uint64) + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    until = np.append(0, np.cumsum([len(x) for x in out]))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), until


def set_names(found: np.ndarray, until: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row that tells its set, of two sums of its shingles."""
    sums = []
    for salt in (0xA5A5A5A55A5A5A5A, 0x0F1E2D3C4B5A6978):
        total = np.append(_U(0), np.cumsum(_words.mix(found ^ _U(salt)), dtype=np.uint64))
        sums.append(total[until[1:]] - total[until[:-1]])
    return _words.mix(sums[0] ^ _words.mix(sums[1])).view(np.int64)


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many first shingles of a set of n two sets that link have one of in common."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def groups_of(n) -> np.ndarray:
    """The number of groups of a set of n shingles: a power of two, LEAST_GROUPS at least."""
    return np.maximum(LEAST_GROUPS, 1 << np.ceil(np.log2(np.maximum(1, n) / 2)).astype(np.int64).clip(0))


def vector(found: np.ndarray) -> np.ndarray:
    """A set's counts by group, in the smallest type that holds them."""
    groups = int(groups_of(len(found)))
    n = np.bincount(((_words.mix(found ^ _U(0x5DEECE66D)) >> _U(32)) % _U(groups)).astype(np.int64), minlength=groups)
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def unpacked(rows: list[bytes], groups: int) -> np.ndarray:
    """Count vectors [row, group]; the type of each is told by its length."""
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
    return np.stack([np.frombuffer(x, kinds[len(x) // groups]).astype(np.int32) for x in rows])


def folded(points: np.ndarray) -> np.ndarray:
    """Points of half as many groups."""
    half = points.shape[1] // 2
    return points[:, :half] + points[:, half:]


def needed(a, b, percent: int = PERCENT):
    """The least intersection of linked sets of sizes a and b, times (100 + percent)."""
    return percent * (a + b)


class RTree:
    """Points packed into nodes of FAN children by size and leading coordinates, with lower and upper corners."""

    def __init__(self, points: np.ndarray, fan: int = FAN):
        n = points.sum(1)
        self.order = np.lexsort((*[points[:, k] for k in range(min(4, points.shape[1]))][::-1], n))
        self.points, self.fan, self.levels = points, fan, []
        high, least, most = points[self.order], n[self.order], n[self.order]
        while True:
            self.levels.append((high, least, most))
            if len(high) <= 1:
                break
            cuts = np.arange(0, len(high), fan)
            high, least, most = np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)

    def search(self, queries: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point and bound of all pairs whose summed minima are high enough for a link."""
        size = queries.sum(1)
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        bound, lot = np.zeros(0), max(64, (1 << 21) // queries.shape[1])
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            if depth < len(self.levels) - 1:
                child = (node[:, None] * self.fan + np.arange(self.fan)).reshape(-1)
                q = np.repeat(q, self.fan)
                q, node = q[child < len(high)], child[child < len(high)]
            fits = (percent * least[node] <= 100 * size[q]) & (percent * size[q] <= 100 * most[node])
            q, node = q[fits], node[fits]
            passes, bounds = [], []
            for i in range(0, len(q), lot):
                s = slice(i, i + lot)
                both = np.minimum(queries[q[s]], high[node[s]]).sum(1)
                fine = (100 + percent) * both >= needed(size[q[s]], least[node[s]], percent)
                passes.append(np.flatnonzero(fine) + i)
                bounds.append(both[fine])
            kept = np.concatenate(passes) if passes else np.zeros(0, np.int64)
            q, node, bound = q[kept], node[kept], np.concatenate(bounds) if bounds else np.zeros(0)
        return q, self.order[node], bound


def tree_pairs(n: np.ndarray, counts: list[bytes], own: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places x (of own) and y (of other, or of own and each pair once) and bounds of the pairs that R-trees can't rule
    out. There is a tree for each number of groups; linked sets differ by one doubling at most."""
    level = groups_of(n)
    found: list[tuple] = []

    def points(some: np.ndarray) -> np.ndarray:
        return unpacked([counts[i] for i in some.tolist()], int(level[some[0]]))

    def search(queries: np.ndarray, places: np.ndarray, tree: RTree, of: np.ndarray, once: bool, turned: bool = False) -> None:
        q, p, bound = tree.search(queries)
        if once:
            q, p, bound = q[q < p], p[q < p], bound[q < p]
        x, y = places[q], of[p]
        found.append((y, x, bound) if turned else (x, y, bound))

    theirs = own if other is None else other
    for g in np.unique(level[theirs]).tolist():
        of = theirs[level[theirs] == g]
        at = points(of)
        tree = RTree(at)
        if (same := own[level[own] == g]).size:
            search(at if other is None else points(same), same, tree, of, other is None)
        if (larger := own[level[own] == 2 * g]).size:
            search(folded(points(larger)), larger, tree, of, False)
    if other is not None:
        for g in np.unique(level[own]).tolist():
            if (larger := other[level[other] == 2 * g]).size:
                of = own[level[own] == g]
                search(folded(points(larger)), larger, RTree(points(of)), of, False, True)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))


PROFILE = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s", pa.int64())])
SPREAD = pa.schema([("part", pa.int64()), ("frequent", pa.bool_()), ("sets", pa.binary()), ("sizes", pa.binary()), ("owners", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
MET = pa.schema([("token", pa.int64()), ("bucket", pa.int64()), ("s", pa.int64()), ("low", pa.int64()), ("times", pa.int64())])
POINT = pa.schema([("s", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])
SET = pa.schema([("s", pa.int64()), ("n", pa.int64()), ("found", pa.binary())])


def _profile(batches):
    """kind 0: each row's size and set. kind 1: shingles (s) of OFTEN or more sets of a stretch, with their number."""
    seen: set = set()
    waiting, size = [], 0

    def flush():
        tokens, n = np.unique(np.concatenate(waiting), return_counts=True)
        tokens, n = tokens[n >= OFTEN], n[n >= OFTEN]
        return batch(PROFILE, pa.array(np.ones(len(n), np.int32)), pa.nulls(len(n), pa.int64()), n.astype(np.int64), tokens.view(np.int64))

    for b in pieces(batches, 1, STEP):
        found, until = shingles(*utf8(b.column(1)))
        n, names = np.diff(until), set_names(found, until)
        yield batch(PROFILE, pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), n, pa.array(names, mask=n == 0))
        for i, key in enumerate(names.tolist()):
            if n[i] and key not in seen:
                seen.add(key)
                waiting.append(found[until[i] : until[i + 1]])
                size += len(waiting[-1])
        if size >= FLUSH:
            yield flush()
            waiting, size = [], 0
    if waiting:
        yield flush()


def _stepped(steps: np.ndarray, full: int) -> np.ndarray:
    """Steps of less than ``full``; a larger one is told by full ones before its rest."""
    many = steps // full + 1
    out = np.full(int(many.sum()), full, np.uint32)
    out[np.cumsum(many) - 1] = steps % full
    return out


def _thinned(keys: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as steps of 16 or 24 bits, or as they are, whichever is least. Steps of 24 bits have an odd
    length, by a byte at the end where needed; the others an even one."""
    steps = np.diff(keys.astype(np.int64), prepend=0)
    two, three = (int((steps // full + 1).sum()) * width for full, width in ((0xFFFF, 2), (0xFFFFFF, 3)))
    three += three % 2 == 0
    if min(two, three) >= 4 * len(keys):
        return keys.astype(np.uint32).tobytes()
    if two <= three:
        return _stepped(steps, 0xFFFF).astype(np.uint16).tobytes()
    made = _stepped(steps, 0xFFFFFF).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return made + b"\0" * (three - len(made))


def _thickened(steps: bytes, n: int) -> np.ndarray:
    """The n numbers that _thinned() has packed."""
    if len(steps) == 4 * n:
        return np.frombuffer(steps, np.uint32).astype(np.int64)
    if len(steps) % 2:
        own, full = np.zeros((len(steps) // 3, 4), np.uint8), 0xFFFFFF
        own[:, :3] = np.frombuffer(steps, np.uint8)[: 3 * len(own)].reshape(-1, 3)
        own = own.reshape(-1).view(np.uint32)
    else:
        own, full = np.frombuffer(steps, np.uint16), 0xFFFF
    return np.cumsum(own, dtype=np.int64)[own < full]


def _second(keys: np.ndarray) -> np.ndarray:
    """Whether shingles are of the second part of the order, by the last two of their 32 bits."""
    return keys.astype(np.uint32) & np.uint32(3) == 3


def _reach(prefix: int, first: int, rare: int) -> int:
    """How far a prefix reaches into a set's rare shingles, as one number: how many of the first part of the order
    are behind it; or, where it needs the second too, one less than minus how many of the second are behind it."""
    return first - prefix if first >= prefix else -1 - max(0, rare - prefix)


def _spread(bits: int, frequent: np.ndarray, many: np.ndarray) -> Callable:
    """Shingles of distinct sets by part of the hash range: a row holds the sets of a stretch, the reach of each one's
    prefix (see _reach), and for each shingle its set's number and 32 bits. A set whose prefix fits in the first part
    of the order sends that alone. Rows marked frequent hold instead the frequent shingles of prefixes and the set of each."""

    def flush(sets: list, sizes: list, tokens: list, held: list):
        for part, t, s in held:
            yield batch(SPREAD, [part], [True], binary([s.tobytes()]), binary([b""]), binary([b""]), binary([t.tobytes()]), binary([b""]))
        flat, names, size = np.concatenate(tokens), np.array(sets, np.int64), np.array(sizes, np.int32)
        order = np.argsort(flat)
        flat, owner = flat[order], np.repeat(np.arange(len(sets)), [len(t) for t in tokens])[order]
        part = (flat >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
        key = ((flat >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(flat)) if len(flat) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            there = np.zeros(len(sets), bool)
            there[owner[i:j]] = True
            number = (np.cumsum(there) - 1).astype(np.uint16)
            yield batch(SPREAD, [int(part[i])], [False], binary([names[there].tobytes()]), binary([size[there].tobytes()]), binary([number[owner[i:j]].tobytes()]), binary([_thinned(key[i:j])]), binary([b""]))

    def run(batches):
        seen: set = set()
        sets, sizes, tokens, held, total = [], [], [], [], 0
        for b in pieces(batches, 1, STEP):
            found, until = shingles(*utf8(b.column(1)))
            n, names = np.diff(until), set_names(found, until)
            often = np.zeros(len(found), np.int64)
            if len(frequent):
                place = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                often = np.where(frequent[place] == found, many[place], 0)
            for i, (size, key) in enumerate(zip(n.tolist(), names.tolist(), strict=True)):
                if not size or key in seen:
                    continue
                seen.add(key)
                own, w = found[until[i] : until[i + 1]], often[until[i] : until[i + 1]]
                rare = own[w == 0]
                prefix = int(prefix_size(np.int64(size)))
                if (more := prefix - len(rare)) > 0:
                    hot, w = own[w > 0], w[w > 0]
                    hot = hot[np.lexsort((hot, w))][:more]
                    held.append((key & ((1 << bits) - 1), (hot | _U(1 << 63)).view(np.int64), np.full(len(hot), key)))
                first = rare[~_second(rare >> _U(32 - bits))]
                sets.append(key)
                sizes.append(_reach(prefix, len(first), len(rare)))
                tokens.append(first if len(first) >= prefix else rare)
                total += len(rare)
            if total >= FLUSH or len(sets) >= MOST_SETS - 10_000:
                yield from flush(sets, sizes, tokens, held)
                sets, sizes, tokens, held, total = [], [], [], [], 0
        if sets:
            yield from flush(sets, sizes, tokens, held)
        sets, sizes, tokens, held = [], [], [], []
        give_back()

    return run


def _by_part(batches) -> Iterator[tuple[int, list]]:
    """Rows of sorted batches, those of one part together."""
    part, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != part and held:
                yield part, held
                held = []
            part = row[0]
            held.append(row[1:])
    if held:
        yield part, held
    held = []
    give_back()


def _joined(rows: list, column: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _sizes(rows: list) -> np.ndarray:
    """The reach of each of the rows' sets."""
    return _joined(rows, 2, np.int32)


def _counted(bits: int) -> Callable:
    """What the parts send on: for each lot of sets the shingles that are in two or more sets, with their number."""

    def run(batches):
        for part, rows in _by_part(batches):
            for r in rows:
                if r[0]:
                    yield batch(SPREAD, [part], [True], *(binary([x]) for x in r[1:]))
            rows = [r for r in rows if not r[0]]
            if not rows:
                continue
            names, first, number = np.unique(_joined(rows, 1, np.int64), return_index=True, return_inverse=True)
            sizes = _sizes(rows)[first]
            begin = np.cumsum([0, *(len(r[1]) // 8 for r in rows)])
            number = number.astype(np.uint32)
            owner = np.concatenate([number[begin[k] + np.frombuffer(r[3], np.uint16).astype(np.int32)] for k, r in enumerate(rows)])
            pairs = np.concatenate([_thickened(r[4], len(r[3]) // 2).astype(np.uint32) for r in rows]).astype(np.uint64)
            pairs <<= _U(32)
            pairs |= owner
            pairs.sort()
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
            key, owner = (pairs >> _U(32)).astype(np.uint32), pairs.astype(np.uint32)
            del pairs
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(cuts, len(key)))
            many = np.repeat(np.minimum(size, 65535).astype(np.uint16), size)
            key, owner, many = key[many > 1], owner[many > 1], many[many > 1]
            lot = names[owner] & ((1 << bits) - 1)
            order = np.lexsort((owner, lot))
            lot, owner, key, many = lot[order], owner[order], key[order], many[order]
            cuts = np.append(np.flatnonzero(np.append(True, lot[1:] != lot[:-1])), len(lot)) if len(lot) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own, each = np.unique(owner[i:j], return_counts=True)
                # the sets' numbers are told by how many shingles each has; the part by the first of the counts' row
                yield batch(SPREAD, [int(lot[i])], [False], binary([names[own].tobytes()]), binary([sizes[own].tobytes()]), binary([np.append(part, each).astype(np.int64).tobytes()]), binary([key[i:j].tobytes()]), binary([many[i:j].tobytes()]))

    return run


def _prefixes(batches):
    """The shingles of each set's prefix that other sets have too, by part: a row holds sets, each one's number of
    shingles, and the 32 bits of each shingle."""
    for lot, rows in _by_part(batches):
        for r in rows:
            if r[0]:
                yield batch(SPREAD, [lot], [True], *(binary([x]) for x in r[1:]))
        rows = [r for r in rows if not r[0]]
        if not rows:
            continue
        names, first, number = np.unique(_joined(rows, 1, np.int64), return_index=True, return_inverse=True)
        reach = _sizes(rows)[first].astype(np.int64)
        heads = [np.frombuffer(r[3], np.int64) for r in rows]
        owner = np.repeat(number, np.concatenate([h[1:] for h in heads]))
        part = np.repeat([h[0] for h in heads], [len(r[4]) // 4 for r in rows])
        key = _joined(rows, 4, np.uint32)
        half = 2 * owner + _second(key)
        order = np.lexsort((key, part, _joined(rows, 5, np.uint16), half))
        owner, key, part, half = owner[order], key[order], part[order], half[order]
        shared = np.bincount(half, minlength=2 * len(names))
        rank = np.arange(len(half)) - (np.cumsum(shared) - shared)[half]
        # those of one set alone come first in a part, so what is behind the prefix are the last ones of its last part
        behind = np.where(half % 2 == (reach < 0)[owner], np.where(reach < 0, -1 - reach, reach)[owner], 0)
        kept = rank < shared[half] - behind
        owner, key, part = owner[kept], key[kept], part[kept]
        order = np.lexsort((owner, part))
        owner, key, part = owner[order], key[order], part[order]
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own, each = np.unique(owner[i:j], return_counts=True)
            yield batch(SPREAD, [int(part[i])], [False], binary([names[own].tobytes()]), binary([b""]), binary([each.astype(np.int32).tobytes()]), binary([key[i:j].tobytes()]), binary([b""]))


def _met(batches):
    """Buckets of the parts' shingles, told by the sets in them: bucket, s, low and times, each bucket and set of a
    part once. Of frequent shingles token and s alone."""
    for _, rows in _by_part(batches):
        if hot := [r for r in rows if r[0]]:
            tokens, names = _joined(hot, 4, np.int64), _joined(hot, 1, np.int64)
            none = pa.nulls(len(tokens), pa.int64())
            yield batch(MET, tokens, none, names, none, none)
        rows = [r for r in rows if not r[0]]
        if not rows:
            continue
        names = np.repeat(_joined(rows, 1, np.int64), _joined(rows, 3, np.int32))
        key = _joined(rows, 4, np.uint32)
        order = np.lexsort((names, key))
        names, key = names[order], key[order]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cuts, len(key)))
        mark = np.bitwise_xor.reduceat(_words.mix(names.view(np.uint64) ^ _U(0x3C6EF372FE94F82B)), cuts)
        low, mark, shared = np.repeat(names[cuts], size), np.repeat(mark, size), np.repeat(size > 1, size)
        names, low, mark = names[shared], low[shared], mark[shared]
        order = np.lexsort((names, mark))
        names, low, mark = names[order], low[order], mark[order]
        cuts = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
        times = np.diff(np.append(cuts, len(names)))
        yield batch(MET, pa.nulls(len(cuts), pa.int64()), mark[cuts].view(np.int64), names[cuts], low[cuts], times)


def _spots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_words.mix(ids.view(np.uint64)) % _U(bits)).astype(np.int64)


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """The map of ids, hashed to a number of bits: bits / 8 bytes on the driver, whatever the number of ids."""

    def spots(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_spots(b.column(0).to_numpy(), bits)))], names=["spot"])

    marked = ids.mapInArrow(spots, "spot long").select((F.col("spot") / 32768).cast("long").alias("part"), F.pmod("spot", F.lit(32768)).alias("bit"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in marked.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r.part * 4096 : r.part * 4096 + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _set(bitmap: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    """Whether the ids' bits are set."""
    spot = _spots(ids, bits)
    return (bitmap[spot >> 3] >> (spot & 7)) & 1 == 1


def _map_size(n: int) -> int:
    """Bits of a map of n ids with few false hits, or 0 where that would be over MAP_BITS."""
    bits = 1 << max(16, int(16 * n - 1).bit_length())
    return bits if bits <= MAP_BITS else 0


def _of_marked(texts: DataFrame, names: DataFrame, most: int, owners: DataFrame, schema: pa.Schema, make: Callable) -> DataFrame:
    """s, n and ``make(shingles)`` (binary) of the named sets, and of a few more, from the text of each one's owner;
    ``most``: how many names there are at most. The owners are told by a map of their ids, so that no text is shuffled; where the map would be too large, texts
    are joined."""
    ids = names.join(owners, "s").select(F.col("own").alias("doc_id"))
    bits = _map_size(most)
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(ids, bits)) if bits else None  # MAP_BITS / 8 bytes at most

    def run(batches):
        seen: set = set()  # a copy may share its owner's bit
        for b in batches:
            for p in pieces([b.filter(pa.array(_set(sent.value, b.column(0).to_numpy(), bits))) if bits else b], 1, STEP):
                found, until = shingles(*utf8(p.column(1)))
                names, new = set_names(found, until), []
                for i, key in enumerate(names.tolist()):
                    if key not in seen:
                        seen.add(key)
                        new.append(i)
                yield batch(schema, names[new], np.diff(until)[new], binary([make(found[until[i] : until[i + 1]]).tobytes() for i in new]))

    some = texts if bits else texts.join(ids.distinct(), "doc_id", "left_semi").select("doc_id", "text")
    return some.mapInArrow(run, f"s long, n long, {schema.names[2]} binary")


def verify(pairs: DataFrame, n: int, left: DataFrame, right: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of n pairs (x, y) those that link, by the sets themselves: left has those of x, right those of y."""

    def run(batches):
        for b in batches:
            fine = []
            for fx, fy in zip(b.column(2), b.column(3), strict=True):
                fx, fy = sorted((np.frombuffer(v.as_buffer(), np.uint64) for v in (fx, fy)), key=len)
                place = np.minimum(np.searchsorted(fy, fx), len(fy) - 1)
                fine.append((100 + percent) * int((fy[place] == fx).sum()) >= needed(len(fx), len(fy), percent))
            yield b.select(["x", "y"]).filter(pa.array(fine, pa.bool_()))

    # each set of y goes once, to the pair's x, of which there are fewer
    sent = F.broadcast(pairs) if n <= SENT_PAIRS else pairs
    with_y = right.select(F.col("s").alias("y"), F.col("found").alias("fy")).join(sent, "y")
    both = with_y.join(left.select(F.col("s").alias("x"), F.col("found").alias("fx")), "x").select("x", "y", "fx", "fy")
    return both.mapInArrow(run, "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v and label: the smallest vertex of each vertex's component. Contracts the graph until no edge is left.

    Each round hooks every vertex to its smallest neighbour, shortens the chains by jumping, and keeps the edges
    between different roots. Tables are written to the shared folder each round; what a later one replaces is deleted.
    """
    current = keep(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    labels = None
    while True:
        both = current.unionByName(current.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = keep(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("y")).select("v", F.least("v", "y").alias("label")), "up")
        while True:
            jumped = up.select("v", "label", F.col("label").alias("before"))
            for _ in range(JUMPS):
                above = up.select(F.col("v").alias("label"), F.col("label").alias("next"))
                jumped = jumped.join(above, "label", "left").select("v", F.coalesce("next", "label").alias("label"), F.col("label").alias("before"))
            jumped = keep(jumped.select("v", "label", (F.col("label") < F.col("before")).alias("moved")), "up")
            forget(up)
            up = jumped
            if not up.where("moved").limit(1).count():
                break
        before, old = labels, current
        if labels is None:
            labels = keep(up.select("v", "label"), "labels")
        else:
            step = up.select(F.col("v").alias("label"), F.col("label").alias("next"))
            labels = keep(labels.join(step, "label", "left").select("v", F.coalesce("next", "label").alias("label")), "labels")
        x, y = (up.select(F.col("v").alias(k), F.col("label").alias(f"l{k}")) for k in "xy")
        current = keep(old.join(x, "x").join(y, "y").where("lx <> ly").select(F.least("lx", "ly").alias("x"), F.greatest("lx", "ly").alias("y")).distinct(), "edges")
        forget(up, old, before)
        if not current.limit(1).count():
            forget(current)
            return labels


def _labelled(rows: DataFrame, labels: DataFrame | None, vertex: str, name: str) -> DataFrame:
    """Adds the label of a vertex column; vertices of no edge are their own."""
    if labels is None:
        return rows.withColumn(name, F.col(vertex))
    return rows.join(labels.select(F.col("v").alias(vertex), F.col("label").alias(name)), vertex, "left").withColumn(name, F.coalesce(name, vertex))


def extended(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The labels (v, label; kept) with more edges: only what the edges join is contracted."""
    if labels is None:
        return components(edges)
    between = _labelled(_labelled(edges, labels, "x", "lx"), labels, "y", "ly").select(F.col("lx").alias("x"), F.col("ly").alias("y"))
    joined = components(between)
    step = joined.select(F.col("v").alias("label"), F.col("label").alias("next"))
    moved = labels.join(step, "label", "left").select("v", F.coalesce("next", "label").alias("label"))
    new = keep(moved.unionByName(joined.join(labels.select("v"), "v", "left_anti").select("v", "label")), "labels")
    forget(labels, joined)
    return new


OFFER = pa.schema([("bucket", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("more", pa.bool_())])


def _forest(low: np.ndarray, high: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of pairs in an order, those that join two trees."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = i = up.get(j, j)
        return i

    kept, left = [], len(np.unique(np.append(low, high))) - 1
    for k, a, b in zip(order.tolist(), low[order].tolist(), high[order].tolist(), strict=True):
        if not left:
            break
        a, b = find(a), find(b)
        if a != b:
            up[b] = a
            kept.append(k)
            left -= 1
    return np.array(kept, np.int64)


def _met_before(bucket: int, lists: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of places those whose lists share a bucket that comes before the given one."""
    held = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    owner, held = owner[held < bucket], held[held < bucket]
    _, number, many = np.unique(held, return_inverse=True, return_counts=True)
    shared = many[number] > 1
    owner, number = owner[shared], (np.cumsum(many > 1) - 1)[number[shared]]
    met = np.zeros(len(x), bool)
    for begin in range(0, int(number.max(initial=-1)) + 1, 512):
        bits = np.zeros((len(lists), 512), bool)
        some = (number >= begin) & (number < begin + 512)
        bits[owner[some], number[some] - begin] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        left = np.flatnonzero(~met)
        for i in range(0, len(left), 1 << 17):
            part = left[i : i + (1 << 17)]
            met[part] = (words[x[part]] & words[y[part]]).any(1)
    return met


def _tree_offers(batches, many: int):
    """Candidates of sorted groups (key, bucket, side, s, label, n, counts); a group may go on in the next batch.
    With a list of buckets as well, a pair counts only in the first bucket that both lists have.

    many 0: a forest of the pairs with the highest bounds. Else of each pair of labels the ``many`` with the highest
    bounds. With both, whether there are more candidates between different labels."""

    def pairs(rows: pa.Table):
        ids, label, side, n = (rows[k].to_numpy() for k in ("s", "label", "side", "n"))
        two = bool((side == 1).any())
        own = np.flatnonzero(side == 0) if two else np.arange(len(ids))
        x, y, bound = tree_pairs(n, rows["counts"].to_pylist(), own, np.flatnonzero(side == 1) if two else None)
        fine = label[x] != label[y]
        x, y, bound = x[fine], y[fine], bound[fine]
        if "buckets" in rows.column_names and len(x):
            fine = ~_met_before(rows["bucket"][0].as_py(), rows["buckets"].combine_chunks(), x, y)
            x, y, bound = x[fine], y[fine], bound[fine]
        one, other = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if not many:
            kept = _forest(low, high, np.lexsort((other, one, -bound)))
            more = np.full(len(kept), len(x) > len(kept))
        else:
            order = np.lexsort((other, one, -bound, high, low))
            one, other, low, high = one[order], other[order], low[order], high[order]
            cuts = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(order) else np.zeros(0, np.int64)
            size = np.diff(np.append(cuts, len(order)))
            kept = np.flatnonzero(np.arange(len(order)) - np.repeat(cuts, size) < many)
            more = np.repeat(size > many, size)[kept]
        return np.repeat(rows["bucket"].to_numpy()[:1], len(kept)), one[kept], other[kept], more

    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        key = table["key"].to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        held = table.slice(int(cuts[-2])).combine_chunks()
        for i, j in zip(cuts[:-2], cuts[1:-1], strict=True):
            if j - i > 1:
                yield batch(OFFER, *pairs(table.slice(int(i), int(j - i))))
    if held is not None and held.num_rows > 1:
        yield batch(OFFER, *pairs(held))
    held = None
    give_back()


def searched(dealt: DataFrame, points: DataFrame, many: int) -> DataFrame:
    """bucket, x, y, more: what the R-trees of the groups (key, bucket, side, s, label, maybe buckets) offer."""

    def run(batches):
        return _tree_offers(batches, many)

    placed = dealt.join(points, "s").select(*dealt.columns, "n", "counts")
    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "bucket long, x long, y long, more boolean")


def choose(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """label, s, low, other (the pivot's label): each label's choice of a pivot of another label, the one that one of
    its sets shares most shingles with; kept. shared: s, low, times."""
    rows = _labelled(_labelled(shared, labels, "s", "label"), labels, "low", "other").where("label <> other")
    best = rows.groupBy("label").agg(F.max_by(F.struct("s", "low", "other"), F.struct("times", -F.col("low"), "s")).alias("best"))
    return keep(best.select("label", "best.s", "best.low", "best.other"), "pivots")


def by_pivot(chosen: DataFrame) -> DataFrame:
    """Groups of the sets that chose one pivot, in blocks; the pivot is in every block."""
    size = chosen.groupBy("low", "other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = chosen.join(size.select("low", "blocks"), "low").select("low", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int").alias("block"), "s", "label")
    pivots = size.select("low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("low").alias("s"), F.col("other").alias("label"))
    return own.unionByName(pivots).select(F.xxhash64("low", "block").alias("key"), F.col("low").alias("bucket"), F.lit(0).alias("side"), "s", "label")


def opened(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, s, label, main and blocks of the sets of the buckets that hold several labels; kept. main is the
    bucket's most frequent label, which has so many blocks, where sending the bucket's other sets to those blocks
    takes no more rows than the bucket in pairs of blocks; else null."""
    rows = _labelled(buckets.select("bucket", "s"), labels, "s", "label")
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    held = rows.join(mixed.select(F.col("main").alias("label")).distinct(), "label", "left_semi").select("s", "label").distinct()
    blocks = held.groupBy(F.col("label").alias("main")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    others, touched = F.col("all") - F.col("n"), F.least("n", "blocks")
    worth = others * touched <= F.col("all") * F.ceil(F.col("all") / BLOCK) - others
    mixed = mixed.join(blocks, "main").select("bucket", F.when(worth, F.col("main")).alias("main"), F.when(worth, F.col("blocks")).alias("blocks"))
    return keep(rows.join(mixed, "bucket").select("bucket", "s", "label", "main", "blocks"), "opened")


def by_label(rows: DataFrame) -> DataFrame:
    """Groups of the sets of a bucket's main label, in blocks that do not depend on the bucket, with the buckets' other
    sets as queries: each goes to a block once, however many buckets it shares with sets there."""
    home = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    mains = rows.where("label = main").withColumn("block", home)
    queries = rows.where("label <> main").select("bucket", "s", "label").join(mains.select("bucket", "main", "block").distinct(), "bucket").select("main", "block", "s", "label").distinct()
    lots = queries.groupBy("main", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lots"))
    homes = mains.select("main", "block", "s", "label").distinct().join(lots, ["main", "block"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    queries = queries.join(lots, ["main", "block"]).withColumn("lot", F.pmod(F.xxhash64("s"), F.col("lots")).cast("int"))
    key = F.xxhash64("main", "block", "lot", F.lit("label")).alias("key")
    none = F.array().cast("array<bigint>").alias("buckets")
    return homes.select(key, F.col("main").alias("bucket"), F.lit(0).alias("side"), "s", "label", none).unionByName(queries.select(key, F.col("main").alias("bucket"), F.lit(1).alias("side"), "s", "label", none))


def by_bucket(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Groups of the sets of a bucket that are not of its main label, in pairs of blocks, with each set's buckets
    before this one, and the tables that they are read from. A bucket that is part of another is left to that one, which is looked for among the largest
    buckets of its sets."""
    own = rows.where("main is null or label <> main").select("bucket", "s", "label")
    sizes = own.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket", "n")
    own = keep(own.join(sizes, "bucket"), "others")
    largest = own.groupBy("s").agg(F.max(F.struct("n", "bucket")).alias("largest"))
    whole = own.join(largest, "s").groupBy("bucket").agg(F.min("largest.bucket").alias("first"), F.max("largest.bucket").alias("last"), F.min("largest").alias("largest"))
    whole = keep(whole.select("bucket", F.col("largest.bucket").alias("in"), (F.col("first") == F.col("last")).alias("sure")).where("bucket <> in"), "within")
    asked = own.join(whole.where("not sure").select("bucket", "in"), "bucket").select("bucket", "n", "s", "in")
    found = asked.join(own.select(F.col("bucket").alias("in"), "s"), ["in", "s"]).groupBy("bucket").agg(F.count("*").alias("found"), F.max("n").alias("n")).where("found = n")
    kept = own.join(whole.where("sure").select("bucket").unionByName(found.select("bucket")), "bucket", "left_anti")
    kept = keep(kept.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")), "kept")
    lists = kept.groupBy("s").agg(F.collect_list("bucket").alias("buckets"))  # no more than its prefix has shingles
    with_ = kept.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).join(lists, "s")
    low, high = F.least("block", "with"), F.greatest("block", "with")
    before = F.filter("buckets", lambda b: b < F.col("bucket")).alias("buckets")
    return with_.select(F.xxhash64("bucket", low, high).alias("key"), "bucket", ((F.col("block") == high) & (low < high)).cast("int").alias("side"), "s", "label", before), [own, whole, kept]


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT of the most frequent shingles, sorted, and their counts: all from a certain count on."""
    sums = keep(counted.groupBy("s").agg(F.sum("n").alias("n")).withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "frequent")
    most, least = 0, None
    for step, n in sorted(map(tuple, sums.groupBy("step").count().collect()), reverse=True):
        most += n
        if most > FREQUENT:
            break
        least = step
    if least is None:
        forget(sums)
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([binary([b.column(0).to_numpy().tobytes()]), binary([b.column(1).to_numpy().tobytes()])], names=["s", "n"])

    rows = sums.where(F.col("step") >= least).select("s", "n").mapInArrow(packed, "s binary, n binary").collect()  # FREQUENT * 16 bytes at most
    forget(sums)
    tokens = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.s, np.uint64) for r in rows)])
    order = np.argsort(tokens)
    return tokens[order], np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.n, np.int64) for r in rows)])[order].astype(np.int32)


def _same(found: np.ndarray) -> np.ndarray:
    return found


def buckets_of(named: DataFrame, total: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """bucket, s, low (the least set of the bucket), times (how many shingles made it), of the sets' prefixes; kept.
    total: shingles of all sets, about."""
    bits = min(31, max(3, (max(1, total * 3 // 4) // PART).bit_length()))  # three quarters of the shingles are exchanged
    sent = named.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT * 12 bytes at most
    kind = "part long, frequent boolean, sets binary, sizes binary, owners binary, keys binary, counts binary"

    def spread(batches):
        return _spread(bits, *sent.value)(batches)

    def exchanged(df: DataFrame, run: Callable, kind: str = kind) -> DataFrame:
        return df.repartition("part").sortWithinPartitions("part").mapInArrow(run, kind)

    parts = exchanged(exchanged(named.mapInArrow(spread, kind), _counted(bits)), _prefixes)
    met = keep(exchanged(parts, _met, "token long, bucket long, s long, low long, times long"), "met")
    often = met.where("token is not null").select("token", "s")
    size = often.groupBy("token").agg(F.count("*").alias("size"), F.min("s").alias("low"), F.bit_xor(F.xxhash64("s")).alias("bucket")).where("size > 1").select("token", "low", "bucket")
    hot = often.join(F.broadcast(size), "token").select("bucket", "s", "low", F.lit(1).cast("long").alias("times"))  # FREQUENT rows at most
    rows = met.where("token is null").select("bucket", "s", "low", "times").unionByName(hot)
    out = keep(rows.groupBy("bucket", "s").agg(F.min("low").alias("low"), F.sum("times").alias("times")), "buckets")
    forget(met)
    return out


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links lead to, its own included) for every row."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = keep(texts.mapInArrow(_profile, "kind int, doc_id long, n long, s long"), "profile")
    docs = profile.where("kind = 0").select("doc_id", "n", "s")
    named = texts.where(F.col("doc_id").isNotNull())
    owners = docs.where("n > 0 and doc_id is not null").groupBy("s").agg(F.min("doc_id").alias("own"))
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = buckets_of(named, total, _frequent(profile.where("kind = 1").select("s", "n")))
    own = buckets.select("s").distinct()
    points = keep(_of_marked(named, own, own.count(), owners, POINT, vector), "points")

    def links(pairs: DataFrame, n: int) -> DataFrame:
        sets = [_of_marked(named, pairs.select(F.col(k).alias("s")).distinct(), n, owners, SET, _same) for k in "xy"]
        return keep(verify(pairs, n, *sets), "links")

    shared = keep(buckets.where("s <> low").groupBy("s", "low").agg(F.sum("times").alias("times")), "shared")
    labels, tried, used = None, None, []
    for _ in range(ROUNDS):
        chosen = choose(shared, labels)
        pairs = searched(by_pivot(chosen), points, 0).select("x", "y").distinct()
        pairs = keep(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        used.append(pairs)
        if not (n := pairs.count()):
            forget(chosen)
            break
        new = links(pairs, n)
        left = keep(shared.join(chosen.select("s", "low"), ["s", "low"], "left_anti"), "shared")
        forget(shared, chosen)
        shared = left
        if not new.limit(1).count():
            break
        labels = extended(labels, new)
        forget(new)
    forget(shared)
    mixed = _labelled(buckets.select("bucket", "s"), labels, "s", "label").groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    left = keep(buckets.select("bucket", "s").join(mixed.select("bucket"), "bucket", "left_semi"), "buckets")
    forget(buckets)
    buckets, all_points = left, points
    points = keep(all_points.join(buckets.select("s").distinct(), "s", "left_semi"), "points")
    forget(all_points)
    many, open_ = 0, buckets
    while True:
        rows = opened(open_, labels)
        dealt, read = by_bucket(rows)
        offered = keep(searched(dealt.unionByName(by_label(rows)), points, many), "offers")
        forget(*read)
        fresh = keep(offered.select("x", "y").distinct().join(tried, ["x", "y"], "left_anti"), "pairs")
        used.append(fresh)
        if n := fresh.count():
            tried, new = tried.unionByName(fresh), links(fresh, n)
            if new.limit(1).count():
                labels = extended(labels, new)
            forget(new)
        # a label's groups stand for all buckets of that main label
        left = offered.where("more").select("bucket").distinct()
        more = keep(rows.join(left, "bucket", "left_semi").unionByName(rows.join(left.withColumnRenamed("bucket", "main"), "main", "left_semi").select(*rows.columns)).select("bucket").distinct(), "open")
        forget(offered, rows)
        used.append(more)
        if not more.limit(1).count():
            break
        open_, many = buckets.join(more, "bucket", "left_semi"), max(1, many) * STEPS
    forget(points, buckets, *used)
    again = docs.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y")
    if again.limit(1).count():
        repeated = docs.where("n > 0").join(again.select("doc_id", "x"), "doc_id").select("x", F.col("s").alias("y")).where("x <> y").distinct()
        labels = extended(labels, repeated)
    least = _labelled(owners, labels, "s", "label")
    least = least.join(least.groupBy("label").agg(F.min("own").alias("component_id")), "label").select("s", "component_id")
    rows = docs.where("n > 0 and doc_id is not null").join(least, "s").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = docs.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if not again.limit(1).count():
        return rows.unionByName(rest)
    # an empty text of a repeated id belongs to the component of the id's other texts
    by_id = rows.groupBy("doc_id").agg(F.min("component_id").alias("own"))
    rest = rest.join(by_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))
    return rows.unionByName(rest)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns whatever their names, of one document of each group: that of the smallest id,
    of rows that repeat it the first by text. Rows with a null id stay. Only rows that may go are shuffled: the others
    are told by a map of the ids that go or repeat, or where it would be too large by a join."""
    linked = keep(link(df, id_col, text_col).where(F.col("doc_id").isNotNull()), "linked")
    each = linked.groupBy("doc_id").agg(F.min(F.col("component_id") == F.col("doc_id")).alias("first"), F.count("*").alias("rows"))
    own, fine, rank = (free_name(df.columns, k) for k in ("doubtful_id", "doubtful_first", "doubtful_rank"))
    doubtful = keep(each.where("not first or rows > 1").select(F.col("doc_id").alias(own), F.col("first").alias(fine)), "doubtful")
    bits = _map_size(doubtful.count())
    sent = df.sparkSession.sparkContext.broadcast(_bitmap(doubtful.select(own), bits)) if bits else None  # MAP_BITS / 8 bytes at most
    place, kind, columns = df.columns.index(id_col), df.schema, [F.col(f"`{c}`") for c in df.columns]

    def part(hit: bool):
        def run(batches):
            for b in batches:
                ids = b.column(place).cast(pa.int64())
                doubt = ids.is_valid().to_numpy(zero_copy_only=False)
                if bits:
                    doubt &= _set(sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
                yield b.filter(pa.array(doubt if hit else ~doubt))

        return df.mapInArrow(run, kind)

    some = part(True).join(doubtful, F.col(f"`{id_col}`").cast("long") == F.col(own), "left").where(F.coalesce(F.col(fine), F.lit(True)))
    order = Window.partitionBy(F.col(f"`{id_col}`")).orderBy(F.col(f"`{text_col}`"))
    some = some.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*columns)
    return part(False).unionByName(some)
