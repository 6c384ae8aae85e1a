"""Secret scans, native: fixed patterns plus sliding-window entropy over candidate strings.

Every expression is a DataFrame function. Matches get their places by putting a control character round each match
and adding up the lengths of the parts. Base kinds are assign, access and hex. The kind entropy adds candidate
strings (20 or more characters of a token alphabet, a digit among them) whose highest window entropy reaches the
threshold of their character class. The counts of characters and the sum of c*log2(c) over them are kept up as the
window moves: only the counts of the character that goes and of the one that comes change. Candidates that an allow-list pattern
matches, or that lie within a base span, are left out; base spans always stay.

Defined cases: null text counts as empty and has no spans; repeated rows and ties are kept as rows; null ids stay
null; an empty table gives an empty result; other columns are not read by scan() and kept by redact(). Offsets
count code points, ends are exclusive. Long texts need memory in proportion to the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import free_name

#: Base patterns as the contract of the scan has them; assign's second group is the value.
ASSIGN = r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)()"
HEX = r"([0-9a-f]{24,})()"
KINDS = ("assign", "access", "hex", "entropy")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Candidates, the window, and the entropy in bits that each character class must reach.
TOKEN = r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})()"
WINDOW = 20
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[0-9a-z_-]+$|^[0-9A-Z_-]+$", 3.55), (r"", 3.75))
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|lorem",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(.)\1{7}",
    r"0123456789|(?i)abcdefgh",
    r"^[0-9=_/+-]+$",
    r"^(?:[A-Za-z]+[-_/=+])+[A-Za-z0-9]{0,11}$",
)
OPEN, MID = "\x01", "\x02"
#: Parts of a text that are walked at once.
CHUNK = 256
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _marked(text: Column, pattern: str, there: str) -> Column:
    """Parts of the text: what stands between matches, then a match with MID before its last group, and so on."""
    return F.when(text.rlike(there), F.split(F.regexp_replace(text, pattern, f"{OPEN}$1{MID}$2{OPEN}"), OPEN)).otherwise(F.array(text))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use).getItem(0)


def _located(parts: Column, kind: int, good) -> Column:
    """Spans of the matches among the parts that ``good(whole, last group)`` keeps. Parts are walked CHUNK at a time,
    so that the spans found before are not copied for each match."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("inside"), _none().alias("found"))

    def step(acc: Column, part: Column) -> Column:
        size = F.when(acc.inside, F.length(part) - 1).otherwise(F.length(part)).cast("bigint")
        head, tail = F.substring_index(part, MID, 1), F.substring_index(part, MID, -1)
        span = F.struct(acc.at.alias("start"), F.lit(kind).alias("kind"), (acc.at + size).alias("end"))
        found = F.when(acc.inside & good(F.concat(head, tail), tail), F.concat(acc.found, F.array(span))).otherwise(acc.found)
        return F.struct((acc.at + size).alias("at"), (~acc.inside).alias("inside"), found.alias("found"))

    def chunk(acc: Column, own: Column) -> Column:
        begin = F.struct(acc.at.alias("at"), acc.inside.alias("inside"), _none().alias("found"))
        add = lambda x: F.struct(x.at.alias("at"), x.inside.alias("inside"), F.concat(acc.found, F.array(x.found)).alias("found"))
        return _bound(F.aggregate(own, begin, step), add)

    def walk(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)))
        outer = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{SPAN}>").alias("found"))
        return F.when(F.size(all_) > CHUNK, F.flatten(F.aggregate(chunks, outer, chunk).found)).when(F.size(all_) > 1, F.aggregate(all_, start, step).found).otherwise(_none())

    return _bound(parts, walk)


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of the string; null if it is shorter.

    Counts of all characters of the string are kept as the window moves: one falls by one and one rises by one, and
    the sum of c*log2(c) changes by those two alone."""

    def over(x: Column) -> Column:
        """x: code (each character's place among the distinct ones) and kinds (how many there are)."""
        n = F.size(x.code)
        first = F.transform(F.sequence(F.lit(1), x.kinds), lambda k: F.size(F.filter(F.slice(x.code, 1, window), lambda c: c == k)))
        total = F.aggregate(first, F.lit(0.0), lambda acc, c: acc + _weight(c.cast("double")))
        moves = F.when(n > window, F.arrays_zip(F.slice(x.code, F.lit(1), n - window).alias("goes"), F.slice(x.code, F.lit(window + 1), n - window).alias("comes"))).otherwise(F.array().cast("array<struct<goes:int,comes:int>>"))

        def step(acc: Column, move: Column) -> Column:
            lost, won = (F.element_at(acc.counts, k).cast("double") for k in (move.goes, move.comes))
            moved = acc.sum + _weight(lost - 1) - _weight(lost) + _weight(won + 1) - _weight(won)
            counts = F.transform(acc.counts, lambda c, k: F.when(k + 1 == move.goes, c - 1).when(k + 1 == move.comes, c + 1).otherwise(c))
            changed = F.struct(counts.alias("counts"), moved.alias("sum"), F.least(acc.least, moved).alias("least"))
            return F.when(move.goes == move.comes, acc).otherwise(changed)

        begin = _bound(total, lambda t: F.struct(first.alias("counts"), t.alias("sum"), t.alias("least")))
        return F.when(n >= window, F.lit(math.log2(window)) - F.aggregate(moves, begin, step).least / window)

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    distinct = _bound(chars, lambda x: F.struct(x.alias("chars"), F.array_distinct(x).alias("kinds")))
    coded = _bound(distinct, lambda x: F.struct(F.transform(x.chars, lambda c: F.array_position(x.kinds, c).cast("int")).alias("code"), F.size(x.kinds).alias("kinds")))
    return _bound(coded, over)


def _random(token: Column) -> Column:
    """Whether a candidate looks random and no allow-list pattern matches it."""
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        least = F.when(token.rlike(pattern), F.lit(bits)).otherwise(least)
    fine = token.rlike("[0-9]")
    for pattern in ALLOWED:
        fine &= ~token.rlike(pattern)
    return F.when(fine, peak_entropy(token) >= least - 1e-9).otherwise(F.lit(False))


def _with_spans(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds ``name``: a struct with base (spans of the base kinds) and spans (all), each by start, then kind."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), OPEN + MID, "\x03\x03")
    assign = _located(_marked(text, ASSIGN, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), 0, lambda whole, last: F.length(last) >= LEAST["assign"])
    access = _located(_marked(text, ACCESS, "AKIA[A-Z0-9]{16}"), 1, lambda whole, last: F.length(whole) >= LEAST["access"])
    hexes = _located(_marked(text, HEX, r"(?<![0-9a-f])[0-9a-f]{24}"), 2, lambda whole, last: F.length(whole) >= LEAST["hex"])
    added = _located(_marked(text, TOKEN, r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"), 3, lambda whole, last: _random(whole))
    out = df.withColumn(name, F.struct(F.array_sort(F.concat(assign, access, hexes)).alias("base"), added.alias("added")))
    free = F.filter(F.col(name)["added"], lambda a: ~F.exists(F.col(name)["base"], lambda b: (b.start <= a.start) & (a.end <= b.end)))
    return out.withColumn(name, F.struct(F.col(name)["base"].alias("base"), F.array_sort(F.concat(F.col(name)["base"], free)).alias("spans")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind as the place in KINDS, end), by start, then kind."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _with_spans(rows, "text", "found").select("doc_id", "found.base", "found.spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Every span of the text, overlapping ones as one, replaced by ``mark``; all columns are kept, null text too."""
    own = free_name(df.columns, "found_spans")
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc.at + 1, F.greatest(s.start - acc.at, F.lit(0)))
        out = F.when(s.start < acc.at, acc.out).otherwise(F.concat(acc.out, gap, F.lit(mark)))
        return F.struct(F.greatest(acc.at, s.end).cast("int").alias("at"), out.alias("out"))

    marked = _with_spans(df, text_col, own)
    done = F.aggregate(F.col(own)["spans"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    text_out = F.when(F.size(F.col(own)["spans"]) == 0, text).otherwise(F.concat(done.out, F.substring(text, done.at + 1, F.length(text))))
    return marked.withColumn(text_col, text_out).drop(own)
