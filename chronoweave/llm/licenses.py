"""License scans: short notices found with a bounded number of edits, and exact phrases.

A text's words (ASCII letters in lower case, digits, and all characters beyond ASCII) are joined by single blanks. A
notice of n characters may differ by up to k = n // EVERY, at most MOST, inserted, deleted or replaced characters. It
is cut into k + 1 pieces: k edits leave one of them whole, so one automaton of all pieces finds every candidate. Each
candidate's window (the notice's length and 5 k more) is verified by the regex library's bounded-error matching, which
begins and ends at word borders and takes the fewest edits. The word between braces tells a license from its
neighbours: it must be there, with one edit at most, or none if it is shorter than SURE. Phrases are notices of no
edits, whose one piece is the whole phrase between blanks; all their places count, also overlapping ones.

Of matches of one label that overlap, the one of fewest edits stays, then the first.

Defined cases: null or empty text, or one without words, has no words and nothing found; rows with a null id and
repeated rows are scanned each; an empty table gives an empty result; other columns are not read. A task holds one
text at a time, in up to five copies, and its matches.
"""

from __future__ import annotations

import functools
import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import batch, pieces

#: One edit for each EVERY characters of a notice, MOST at most; keys shorter than SURE stand without edits.
EVERY, MOST, SURE = 10, 4, 6
#: Exact phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Usual short notices as words, with the word that tells the license in braces, and labels.
NOTICES = (
    ("released under the {mit} license", "mit"),
    ("licensed under the {mit} license", "mit"),
    ("distributed under the {mit} license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this {software}", "mit"),
    ("licensed under the {apache} license version 2 0", "apache"),
    ("released under the {apache} license", "apache"),
    ("licensed under the gnu {general} public license version 3", "gpl"),
    ("licensed under the gnu {general} public license", "gpl"),
    ("under the terms of the gnu {general} public license", "gpl"),
    ("gnu {lesser} general public license", "lgpl"),
    ("gnu {affero} general public license", "agpl"),
    ("gnu free {documentation} license", "gfdl"),
    ("redistribution and use in source and {binary} forms with or without modification are permitted", "bsd"),
    ("licensed under the {bsd} license", "bsd"),
    ("released under the {bsd} license", "bsd"),
    ("licensed under the {isc} license", "isc"),
    ("permission to use copy modify and or {distribute} this software for any purpose", "isc"),
    ("{mozilla} public license version 2 0", "mpl"),
    ("subject to the terms of the {mozilla} public license", "mpl"),
    ("{eclipse} public license version 2 0", "epl"),
    ("this is free and {unencumbered} software released into the public domain", "unlicense"),
    ("{boost} software license version 1 0", "boost"),
    ("licensed under {cc by} 4 0", "cc-by"),
    ("creative commons {attribution} 4 0 international", "cc-by"),
    ("licensed under {cc by nc} 4 0", "cc-by-nc"),
    ("licensed under {cc by sa} 4 0", "cc-by-sa"),
    ("licensed under {cc by nd} 4 0", "cc-by-nd"),
    ("creative commons attribution {noncommercial} 4 0 international", "cc-by-nc"),
    ("creative commons attribution {sharealike} 4 0 international", "cc-by-sa"),
    ("{cc0} 1 0 universal public domain dedication", "cc0"),
    ("{copyright} all rights reserved", "reserved"),
)
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_INSIDE = np.array([_WORDS[c] != 32 for c in range(128)])
FOUND = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("found", FOUND)])
FOUND_SQL = "doc_id long, n_words long, found array<struct<label:string,base:boolean,word:long,words:long,start:long,end:long,edits:int,similarity:double>>"


def edits(notice: str) -> int:
    """How many edits a notice may have."""
    return min(MOST, len(notice) // EVERY)


def cut(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places."""
    borders = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(borders, borders[1:], strict=False)]


class Notices:
    """The automaton of all pieces and the patterns that verify."""

    def __init__(self, notices: tuple, phrases: tuple):
        self.phrases, self.notices, seeds = phrases, [], {}
        for i, (phrase, _) in enumerate(phrases):
            seeds.setdefault(f" {phrase} ", []).append((True, i, 1))
        for i, (marked, label) in enumerate(notices):
            head, key, tail = re.split(r"[{}]", marked)
            plain, k = head + key + tail, edits(head + key + tail)
            pattern = regex.compile(f"(?b)(?<= )(?:{regex.escape(head)}(?P<key>{regex.escape(key)}){regex.escape(tail)}){{e<={k}}}(?= )")
            self.notices.append((label, len(plain), k, pattern, regex.compile(f"(?:{regex.escape(key)}){{e<={int(len(key) >= SURE)}}}")))
            for at, piece in cut(plain, k):
                seeds.setdefault(piece, []).append((False, i, at))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def matches(self, words: str) -> list[tuple[str, bool, int, int, int, int]]:
        """label, whether a phrase, start, end, edits and the notice's length, of words set off by blanks."""
        out, starts = [], {}
        for last, (size, uses) in self.seeds.iter(words):
            for exact, i, at in uses:
                if exact:
                    phrase, label = self.phrases[i]
                    out.append((label, True, last - size + 2, last, 0, len(phrase)))
                else:
                    starts.setdefault(i, []).append(last - size + 1 - at)
        fuzzy = []
        for i, places in starts.items():
            label, size, k, pattern, key = self.notices[i]
            beyond = -math.inf
            for start in sorted(places):
                if start <= beyond:
                    continue
                beyond = start + 2 * k  # a notice that one of these places belongs to lies wholly in the window
                low = max(0, start - k - 1)
                m = pattern.search(words[low : start + size + 4 * k + 1])
                if m and key.fullmatch(m["key"].strip()):
                    fuzzy.append((label, False, low + m.start(), low + m.end(), sum(m.fuzzy_counts), size))
        kept: dict[str, list] = {}
        for hit in sorted(fuzzy, key=lambda h: (h[4], h[2], -h[3])):
            own = kept.setdefault(hit[0], [])
            if all(hit[3] <= x[2] or hit[2] >= x[3] for x in own):
                own.append(hit)
        return sorted(out + [h for own in kept.values() for h in own], key=lambda h: (h[2], h[3], h[0], h[1]))


@functools.cache
def _notices(notices: tuple, phrases: tuple) -> Notices:
    return Notices(notices, phrases)


def find(text: str, notices: Notices) -> tuple[int, list[dict]]:
    """A text's number of words, and all that is found; starts and ends in code points, end exclusive."""
    own = text.encode().translate(_WORDS).split()
    words = b" ".join((b"", *own, b"")).decode() if own else ""
    hits = notices.matches(words)
    if not hits:
        return len(own), []
    blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = np.where(points < 128, _INSIDE[np.minimum(points, 127)], True).astype(np.int8)
    turns = np.diff(inside, prepend=0, append=0)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    out = []
    for label, base, start, end, wrong, size in hits:
        first, last = (int(x) for x in np.searchsorted(blanks, (start - 1, end)))
        out.append({"label": label, "base": base, "word": first, "words": last - first, "start": int(starts[first]), "end": int(ends[last - 1]), "edits": wrong, "similarity": 1 - wrong / size})
    return len(own), out


def scan(df: DataFrame, notices: tuple = NOTICES, phrases: tuple = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and found: label, base (a phrase), word (the first one's number), words (their count), start and
    end in code points, edits, similarity (1 less the edits for each character of the notice), in order of place."""

    def run(batches):
        made = _notices(notices, phrases)
        for b in pieces(batches, 1):
            got = [find(t or "", made) for t in b.column(1).to_pylist()]
            yield batch(SCHEMA, b.column(0), [n for n, _ in got], pa.array([f for _, f in got], FOUND))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND_SQL)
