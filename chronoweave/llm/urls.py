"""URL filters: rules by host suffix and path prefix, else naive Bayes over segmented hosts and path tokens.

Hosts are cut at dots and hyphens, and each label is split into words by a unigram Viterbi: the split with the
highest product of word probabilities; unknown words get a probability that falls with their length. Word counts
come from all urls (path tokens and the parts of hyphenated labels) and a small seed list. The classifier is a
multinomial naive Bayes over host words and path tokens of all urls. Its labels are distant: a url counts as
blocked if a word of its segmented host is in the seed list of unwanted words.

Defined cases: a null url, or one without ``://``, has an empty host and path and the verdict allow, unless a rule
fits; repeated rows and ties are kept as rows, of rules of one length the first wins; null ids stay null; an empty
table gives an empty result; other columns are not read. Counts of words and features are tables without a bound;
the driver sees sums, the counts of the seed words and the names of the HOT most frequent keys of a join.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import batch, keep

#: The most letters of a word that segmentation knows, and how many keys of a join are broadcast.
LONGEST, HOT = 24, 1000
#: Each class counts as having seen this many features more, in the proportions of all urls.
PRIOR = 10
UNWANTED = frozenset("adult porn xxx sex nude escort casino poker betting gamble jackpot slots pills pharma viagra cialis replica warez crack keygen torrent malware phishing loan payday".split())
ORDINARY = frozenset(
    "the and for news blog shop store home page web site online best free world time life day city book books music video photo art game games sport sports food travel health school science tech data cloud code dev app mail forum wiki help support docs learn cheap buy my your our new old big small green blue red www example com org net".split()
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest fitting rule's text (what 1) or action (what 0), else null. rules: (action, host, path)."""
    out = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit((action, h + p)[what])).otherwise(out)
    return out


def path_tokens(path: Column) -> Column:
    """Lower-case letter runs of the path."""
    return F.filter(F.split(F.lower(path), "[^a-z]+"), lambda x: x != "")


def labels_of(host: str) -> list[str]:
    """The letter runs of a host; digits are marks of where labels end, like dots and hyphens."""
    return "".join(c if c.isalpha() else " " for c in host).split()


class Words:
    """Splits labels by unigram probabilities. counts: of all words, or of some that have the seed words among them
    with ``total`` the sum over all words."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        everything = sum(counts.values()) if total is None else total
        least = (everything + 1) // 1000 + 1
        raised = {w: least for w in UNWANTED | ORDINARY if counts.get(w, 0) < least}
        self.total = math.log(everything + sum(n - counts.get(w, 0) for w, n in raised.items()))
        self.cost = self.costs(counts | raised)

    def costs(self, counts: dict[str, int]) -> dict[str, float]:
        return {w: self.total - math.log(n) for w, n in counts.items() if n > 0}

    def split(self, label: str, more: dict[str, int] | None = None) -> list[str]:
        """The words of one label: least total cost, of equal ones the longest last word. more: counts of further
        words."""
        cost = self.costs(more or {}) | self.cost
        best, back = [0.0], [0]
        for end in range(1, len(label) + 1):
            least = None
            for size in range(min(end, LONGEST), 0, -1):
                c = cost.get(label[end - size : end])
                c = best[end - size] + (c if c is not None else self.total + 1 + 2.5 * size)
                if least is None or c < least[0] - 1e-12:
                    least = (c, end - size)
            best.append(least[0])
            back.append(least[1])
        out, at = [], len(label)
        while at:
            out.append(label[back[at] : at])
            at = back[at]
        return out[::-1]

    def host(self, host: str) -> list[str]:
        """The words of a host."""
        return [w for label in labels_of(host) for w in self.split(label)]


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined with ``table``, which has each key once. The rows' HOT most frequent keys are joined by
    broadcast, so that none of the others has more than one row in HOT of those that are shuffled."""
    hot = [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(HOT).collect()]
    own = F.col(key).isin(hot)
    return rows.where(own).join(F.broadcast(table.where(own)), key, "left").unionByName(rows.where(~own).join(table, key, "left"))  # HOT rows at most


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n: words in all urls, which are path tokens and the parts of labels with a hyphen."""
    parts = F.flatten(F.transform(F.filter(F.split("host", r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "[^a-z]+")))
    words = rows.select(F.explode(F.concat(path_tokens(F.col("path")), parts)).alias("word")).where((F.col("word") != "") & (F.length("word") <= LONGEST))
    return words.groupBy("word").agg(F.count("*").alias("n"))


SUBSTRINGS = pa.schema([("label", pa.string()), ("word", pa.string())])
PLACED = pa.schema([("host", pa.string()), ("place", pa.int32()), ("label", pa.string())])
SPLIT = pa.schema([("label", pa.string()), ("words", pa.list_(pa.string()))])


def _placed(batches):
    """The labels of each host."""
    for b in batches:
        made = [(h, i, x) for h in b.column(0).to_pylist() for i, x in enumerate(labels_of(h))]
        yield batch(PLACED, [x[0] for x in made], [x[1] for x in made], [x[2] for x in made])


def _substrings(batches):
    """The substrings of each label that may be a word; all words are of the letters a to z."""
    for b in batches:
        for label in b.column(0).to_pylist():
            own = {run[i:j] for run in re.findall("[a-z]+", label) for i in range(len(run)) for j in range(i + 1, min(len(run), i + LONGEST) + 1)}
            yield batch(SUBSTRINGS, [label] * len(own), sorted(own))


def segment(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words: of distinct hosts, by the counts of all words. Each distinct label is split once, by the counts of
    the words among its substrings."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seeds = {r.word: r.n for r in counts.where(F.col("word").isin(sorted(UNWANTED | ORDINARY))).collect()}
    sent = hosts.sparkSession.sparkContext.broadcast((seeds, total))

    def run(batches):
        own = Words(*sent.value)
        for b in batches:
            names, found = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield batch(SPLIT, names, [own.split(x, {w["word"]: w["n"] for w in f or []}) for x, f in zip(names, found, strict=True)])

    placed = keep(hosts.mapInArrow(_placed, "host string, place int, label string"), "labels")
    labels = keep(placed.select("label").distinct(), "distinct-labels")
    inside = looked_up(labels.mapInArrow(_substrings, "label string, word string"), counts, "word").where("n is not null")
    inside = inside.groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    split = keep(labels.join(inside, "label", "left").select("label", "found").mapInArrow(run, "label string, words array<string>"), "split")
    found = looked_up(placed, split, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("own"))
    return found.select("host", F.flatten(F.transform("own", lambda x: x["words"])).alias("words"))


def fit(segmented: DataFrame) -> tuple[DataFrame, float]:
    """Log odds of each feature, from counts over all rows, and of the classes. segmented: features, unwanted."""
    bad = F.col("unwanted").cast("long")
    seen = keep(segmented.select(F.explode("features").alias("feature"), bad.alias("bad")).groupBy("feature").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")), "features")
    rows = segmented.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    sums = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    total = max(1, sums.n)
    share = lambda n, size: F.log((n + PRIOR * F.col("n") / total) / (size + PRIOR))
    odds = share(F.col("bad"), sums.bad) - share(F.col("n") - F.col("bad"), total - sums.bad)
    return seen.select("feature", odds.alias("odds")), math.log((rows.bad + 1) / (rows.n - rows.bad + 1))


def judge(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, words, rule, score (how likely unwanted, 0 to 1) and verdict for every url."""
    url = F.col(url_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "urls")  # written, the numbers stay
    words = keep(segment(rows.select("host").distinct(), keep(word_counts(rows), "words")), "hosts")
    named = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    segmented = looked_up(rows, words, "host").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    features = F.concat(named("h:", F.col("words")), named("p:", path_tokens(F.col("path"))))
    unwanted = F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(UNWANTED)]))
    segmented = keep(segmented.withColumn("features", features).withColumn("unwanted", unwanted), "segmented")
    odds, prior = fit(segmented)
    each = looked_up(segmented.select("row", F.explode("features").alias("feature")), odds, "feature")
    sums = each.groupBy("row").agg(F.sum(F.col("odds").cast("decimal(20,12)")).cast("double").alias("z"))  # in any order the same
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("z") + prior))
    made = segmented.join(sums, "row", "left").withColumn("score", F.when(F.col("z").isNull(), 0.0).otherwise(1 / (1 + F.exp(-z))))
    made = made.select("page_id", "host", "path", F.array_join("words", " ").alias("words"), "score")
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return made.withColumn("rule", rule_column(host, path, rules, 1)).withColumn("verdict", F.coalesce(rule_column(host, path, rules, 0), own))
