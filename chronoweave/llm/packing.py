"""Best-fit packing of documents into token sequences, with dominance reduction first.

Documents are tokenized, ended by a separator id, and those longer than a sequence are cut into full pieces, the
rest first. Only how many pieces there are of each length matters for packing, and that is a table of at most
``capacity`` rows, whatever the corpus. The driver packs this table:

1. Reduction (Martello and Toth): from the longest on, a small set with the piece that provably dominates every
   other set with it is fixed for good: the piece alone if nothing fits beside it; the piece and its exact
   complement; the piece and the longest that fits, if no two others fit, or if no two that fit are longer together
   than that one and no three fit.
2. The remainder by best-fit decreasing: the fullest open sequence that a piece fits in, else a new one.

The plan is a list of runs (length, how many, sequence, offset). The n-th piece of its length takes the n-th place
of the runs of that length; ranks come from counts for each input partition and length and a running sum over them.

Defined cases: null and empty texts are one piece, the separator alone; repeated rows are packed each; null ids
stay null; of equal lengths the order is that of the input's partitions; an empty table gives an empty result;
other columns are not read. Memory is bounded by STEP_BYTES of text or one text and its ids.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import batch, binary, keep, pieces

CAPACITY, SEPARATOR, MAX_FILE_MB = 2048, 0, 64
#: Texts of these characters alone are split alike by either tokenizer library.
PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]").search


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids as the tokenizers library gives them for a byte-level BPE file, specials as ordinary text.

    Where the file is plain byte-level BPE, texts of plain characters go through tiktoken with the same merges as
    ranks, which is several times faster and gives the same ids; all others go through tokenizers.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(data.decode())
        self.slow.encode_special_tokens = True
        self.fast = self.id_of = None
        spec = json.loads(data)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if plain and not spec.get("normalizer") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"):
            import public_tokenizers
            import tiktoken

            byte = _byte_of()
            merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
            order = [*sorted(byte), *merges]
            ranks = {bytes(byte[c] for c in t): i for i, t in enumerate(order)}
            if len(ranks) == len(order) and all(t in model["vocab"] for t in order):
                self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
                self.id_of = np.array([model["vocab"][t] for t in order], np.uint32)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and not PLAIN(text):
            return self.id_of[self.fast.encode_to_numpy(text, disallowed_special=())]
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def tokens(data: bytes) -> Tokens:
    """One tokenizer for each worker process and file."""
    return Tokens(data)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, place long"
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("place", pa.int64())])


def cut(df: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces, with their partition and place among the partition's pieces of that length."""
    with open(path, "rb") as f:
        data = f.read((MAX_FILE_MB << 20) + 1)
    if len(data) > MAX_FILE_MB << 20:
        raise ValueError(f"{path} is over {MAX_FILE_MB} MB")
    sent = df.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        own, part = tokens(sent.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in pieces(batches, 1):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(own.ids(text), np.uint32(SEPARATOR)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (begin, end) in enumerate(zip(edges, edges[1:], strict=False)):
                    raw = ids[begin:end].tobytes()
                    rows.append((doc, k, begin, end - begin, zlib.crc32(raw), raw if keep_ids else None, part, seen[end - begin]))
                    seen[end - begin] += 1
            columns = list(zip(*rows, strict=True))
            yield batch(PIECES, *columns[:5], binary(list(columns[5])), *columns[6:])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE)


class Plan:
    """Places for so many pieces of each length. runs[length]: (first rank, sequence, offset, pieces a sequence)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] += n
        self.used = [0] * (capacity + 1)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (sequence, how many)
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _put(self, length: int, sequence: int, many: int, offset: int, each: int = 1) -> None:
        """``each`` pieces of a length into each of ``many`` sequences, from an offset on."""
        self.runs.setdefault(length, []).append((self.used[length], sequence, offset, each))
        self.used[length] += many * each
        self.left[length] -= many * each

    def _fix(self, many: int, *lengths: int) -> None:
        offset = 0
        for length in lengths:
            self._put(length, self.sequences, many, offset)
            offset += length
        self.sequences += many

    def _reduce(self) -> None:
        """Fix sets that dominate, from the longest length on."""
        for s in range(self.capacity, 0, -1):
            while self.left[s]:
                room, n = self.capacity - s, self.left[s]
                low = self._lowest(s)
                if not low or low[0] > room:
                    self._fix(n, s)
                    continue
                if self.left[room] and room != s:
                    self._fix(min(n, self.left[room]), s, room)
                    continue
                if room == s and n > 1:
                    self._fix(n // 2, s, s)
                    continue
                best = max(x for x in range(1, room + 1) if self.left[x] - (x == s) > 0)
                single = len(low) < 2 or low[0] + low[1] > room
                if not single and (len(low) < 3 or sum(low) > room):
                    single = self._best_pair(s, room) <= best
                if not single:
                    break
                self._fix(min(n, self.left[best]) if best != s else n // 2, s, best)

    def _lowest(self, s: int) -> list[int]:
        """The three shortest lengths there are beside one piece of length s."""
        out: list[int] = []
        for x in range(1, self.capacity + 1):
            out += [x] * min(3 - len(out), self.left[x] - (x == s))
            if len(out) == 3:
                break
        return out

    def _best_pair(self, s: int, room: int) -> int:
        """The longest that two pieces beside one of length s are together, within the room."""
        there = [x for x in range(1, room) if self.left[x] - (x == s) > 0]
        best, j = 0, len(there) - 1
        for i, a in enumerate(there):
            while j >= 0 and a + there[j] > room:
                j -= 1
            k = j
            if k == i and self.left[a] - (a == s) < 2:
                k -= 1
            if k >= 0:
                best = max(best, a + there[k])
        return best

    def _best_fit(self) -> None:
        """Best-fit decreasing: equal pieces go into the fullest sequences with room, as many in each as fit."""
        rooms: list[int] = []  # sorted, those with open sequences
        for s in range(self.capacity, 0, -1):
            while n := self.left[s]:
                i = bisect.bisect_left(rooms, s)
                if i < len(rooms):
                    room = rooms[i]
                    sequence, many = self.open[room].pop()
                    if not self.open[room]:
                        rooms.pop(i)
                else:
                    room, sequence, many = self.capacity, self.sequences, -(-n // (self.capacity // s))
                    self.sequences += many
                each = room // s
                full = min(many, n // each)
                self._put(s, sequence, full, self.capacity - room, each) if full else None
                taken = [(sequence, full, room - each * s)] if full else []
                if full < many and self.left[s]:
                    rest = self.left[s] if self.left[s] < each else 0
                    if rest:
                        self._put(s, sequence + full, 1, self.capacity - room, rest)
                        taken.append((sequence + full, 1, room - rest * s))
                        full += 1
                if full < many:
                    taken.append((sequence + full, many - full, room))
                for q, m, left in taken:
                    if left:
                        if not self.open[left]:
                            bisect.insort(rooms, left)
                        self.open[left].append((q, m))

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(runs, np.int64) for length, runs in self.runs.items()}


PLACED = pa.schema([(f.name, f.type) for f in PIECES][:6] + [("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless kept), sequence_id and offset for every piece."""
    made = keep(cut(df, path, capacity, keep_ids, id_col, text_col), "pieces")
    each = made.groupBy("part", "length").count()
    plan = Plan({r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    sent = df.sparkSession.sparkContext.broadcast(plan.arrays())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = made.join(base, ["part", "length"]).select(*PIECES.names[:6], (F.col("base") + F.col("place")).alias("rank"))

    def run(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(6).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                own = np.flatnonzero(length == s)
                runs = sent.value[s]
                first, seq, off, many = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1].T
                sequence[own] = seq + (rank[own] - first) // many
                offset[own] = off + (rank[own] - first) % many * s
            yield batch(PLACED, *b.columns[:6], sequence, offset)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
