"""Byte-level BPE encoding and decoding with an automaton over all tokens.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds every token of a piece in one pass. Encoding
walks the piece from its longest matches: a token is taken if it may stand right of the one before it, else its
next shorter prefix token is tried, else the walk goes back a token and marks the place as closed. Whether two
tokens may be neighbours depends on the two alone (merging their joined bytes must give the two back), so that is
memoised. Each place is closed at most once, so time is linear, and the result is that of the merges.

Defined cases: null and empty texts have no ids and decode to no bytes; ties and repeated rows are kept as rows;
null ids stay null; an empty table gives an empty result; other columns of the input are not read. Special tokens
are ordinary text. Memory is bounded by STEP bytes of text or one text, MEMO_BYTES of remembered pieces and PAIRS
remembered neighbours; beyond, a worker forgets all and goes on.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import batch, binary, pieces

#: Bytes of pieces and their ids, and pairs of neighbours, that a worker remembers; longer pieces than LONG are not
#: remembered. Text at once. A rank file may have MAX_RANKS_MB.
MEMO_BYTES, PAIRS, LONG, STEP, MAX_RANKS_MB = 8 << 20, 400_000, 64, 2 << 20, 64
#: Above all ranks; characters of a text that is split into a list of all its pieces.
NONE, LISTED = 1 << 40, 1 << 20


class Codec(dict):
    """Encodes and decodes by a rank table. As a dict: piece -> its ids, packed as little-endian 32 bits."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.bytes_of, self.split = ranks, {i: b for b, i in ranks.items()}, regex.compile(pattern)
        self.held = 0
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no rank for the bytes {missing[:5]}")
        self.beside: dict[int, bool] = {}
        made = {b: i for b, i in ranks.items() if self.merged(b) == [i]}  # what the merges can't make is only a whole piece
        self.shorter = {i: next((made[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in made), -1) for b, i in made.items()}
        self.size = {i: len(b) for b, i in made.items()}
        self.found = ahocorasick.Automaton()
        for b, i in made.items():
            self.found.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.found.make_automaton()

    def merged(self, raw: bytes) -> list[int]:
        """The merges as defined: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        parts, rank_of = [raw[i : i + 1] for i in range(len(raw))], self.ranks.get
        joined = [rank_of(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]
        while joined and (rank := min(joined)) < NONE:
            at = joined.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]  # a merge changes the ranks beside it alone
            if at < len(joined):
                joined[at] = rank_of(parts[at] + parts[at + 1], NONE)
            if at:
                joined[at - 1] = rank_of(parts[at - 1] + parts[at], NONE)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, token: int) -> bool:
        """Whether the merges leave these two as neighbours. Remembered by both ids in one number."""
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        known = self.beside[left << 32 | token] = self.merged(self.bytes_of[left] + self.bytes_of[token]) == [left, token]
        return known

    def ids(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        n, beside, size, shorter = len(raw), self.beside.get, self.size, self.shorter
        longest = [0] * n
        for end, (token, more) in self.found.iter(raw.decode("latin-1")):
            longest[end - more] = token  # later ends are longer
        out: list[int] = []
        closed, at, token, last = bytearray(n + 1), 0, longest[0], -1
        while True:
            while token >= 0:
                end = at + size[token]
                if not closed[end] and (last < 0 or (self.fits(last, token) if (known := beside(last << 32 | token)) is None else known)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            else:
                closed[at] = 1
                token = out.pop()
                at -= size[token]
                last, token = out[-1] if out else -1, shorter[token]

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG:
            self.held += len(piece) + len(packed)
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = len(piece) + len(packed)
            self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) <= LISTED and not self.split.groups:
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        out = bytearray()  # grows in place: a very long text needs no list of all its pieces
        for match in self.split.finditer(text):
            out += self[match[0]]
        return bytes(out)

    def decode(self, packed: bytes | None) -> bytes:
        """The bytes of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())) if packed else b""


class Decoder:
    """The bytes of ids by a rank table, as one buffer and where each id's bytes are."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for b, i in ranks.items():
            self.size[i] = len(b)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(b for _, b in sorted((i, b) for b, i in ranks.items())), np.uint8)

    def decode(self, packed: bytes | None) -> bytes:
        """The bytes of packed ids; an id without a rank raises an error."""
        if not packed:
            return b""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        size = self.size[ids]
        if not size.all():
            raise ValueError(f"no rank has the id {int(ids[size == 0][0])}")
        begin = np.cumsum(size) - size
        return self.data[np.arange(int(size.sum())) + np.repeat(self.begin[ids] - begin, size)].tobytes()


def read_ranks(path: str) -> bytes:
    """A rank file's content, read on the driver, to be sent to the executors. Its size is checked."""
    with open(path, "rb") as f:
        data = f.read((MAX_RANKS_MB << 20) + 1)
    if len(data) > MAX_RANKS_MB << 20:
        raise ValueError(f"{path} is over {MAX_RANKS_MB} MB")
    return data


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, of a rank file with a base64 token and a number on each line."""
    return {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in data.splitlines() if line.strip()}


@lru_cache(1)
def codec(data: bytes, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(ranks_of(data), pattern)


@lru_cache(1)
def decoder(data: bytes) -> Decoder:
    """One decoder for each worker process."""
    return Decoder(ranks_of(data))


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) for every row."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # MAX_RANKS_MB at most

    def run(batches):
        own = codec(sent.value, pattern)
        for b in pieces(batches, 1, STEP):
            yield batch(ENCODED, b.column(0), binary([own.encode(x.as_py()) for x in b.column(1)]))

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Adds decoded (binary) to what encode() returns; the pattern is not needed."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # MAX_RANKS_MB at most

    def run(batches):
        own = decoder(sent.value)
        for b in pieces(batches, 1, STEP):
            yield batch(DECODED, b.column(0), b.column(1), binary([own.decode(x.as_py()) for x in b.column(1)]))

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode() of encode() in one pass: doc_id, ids and decoded for every row, with one Python worker a task."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # MAX_RANKS_MB at most

    def run(batches):
        own, back = codec(sent.value, pattern), decoder(sent.value)
        for b in pieces(batches, 1, STEP):
            ids = [own.encode(x.as_py()) for x in b.column(1)]
            yield batch(DECODED, b.column(0), binary(ids), binary([back.decode(x) for x in ids]))

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")
