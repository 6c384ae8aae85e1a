"""An inverted index for keyword search: blocks of postings by token, each with its highest weight.

Postings (token, page, weight) are cut into blocks of about BLOCK (less than 2 * BLOCK), of one power of two of weights each. Pages are packed where they are read, up to BLOCK of them at once, into one list for each token and power; only lists
are exchanged, and of a token of a third of all pages no task holds more than a batch of lists. A token's bucket is a folder: a query reads the folders of its
tokens, and of these the row groups with them.

The best k are found by their maxima. The k-th highest single weight is a total that k pages reach at least. Of m
tokens, a page that reaches it has one weight of an m-th of it; so only pages in blocks with such a maximum are candidates,
and only candidates are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders of tokens, postings in a block, and what a word in the title counts.
BUCKETS, BLOCK, TITLE = 64, 4096, 10
_SPLIT = r"[^\p{L}\p{N}_]+"


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


#: Words of pages that are packed at once; a page with more is packed alone.
WORDS = 1 << 20
_LISTS = pa.schema([("token", pa.string()), ("class", pa.int32()), ("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])
_BLOCKS = pa.schema([("token", pa.string()), ("class", pa.int32()), ("block", pa.int32()), ("most", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])
_LISTED = "token string, class int, ids array<long>, weights array<long>"


def _pack(ids: np.ndarray, words: pa.ListArray) -> pa.RecordBatch:
    """For each token and power of two the pages' ids and weights, the heaviest first. A page's words are as many as they count."""
    coded = words.flatten().dictionary_encode()
    page, code = np.repeat(np.arange(len(ids)), np.diff(words.offsets.to_numpy())), coded.indices.to_numpy()
    names = coded.dictionary
    said = np.array([x != "" for x in names.to_pylist()], bool)[code]
    pairs, weight = np.unique(page[said] * len(names) + code[said], return_counts=True)
    page, code = np.divmod(pairs, max(len(names), 1))
    power = np.frexp(weight)[1] - 1  # floor of the logarithm, exactly
    order = np.lexsort((ids[page], -weight, power, code))
    page, code, weight, power = page[order], code[order], weight[order], power[order]
    begin = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(power) != 0)]) if len(code) else np.zeros(0, int)
    offsets = pa.array(np.r_[begin, len(code)], pa.int32())
    listed = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (ids[page], weight)]
    return pa.RecordBatch.from_arrays([names.take(pa.array(code[begin])), pa.array(power[begin], pa.int32()), *listed], schema=_LISTS)


def lists(pages: DataFrame, title_col: str = "title", text_col: str = "text", id_col: str = "id") -> DataFrame:
    """token, class, ids, weights: 10 for each time in the title, 1 in the text; a list for each token and power of two of up to BLOCK
    pages. Pages are dealt first, as a file may hold all of them in one stretch that only one task can read."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words = b.column(0).to_numpy(), b.column(1)
            ends, at = words.offsets.to_numpy(), 0
            while at < len(ids):
                to = max(at + 1, min(at + most, int(np.searchsorted(ends, ends[at] + WORDS, "right")) - 1))
                part = pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - ends[at], pa.int32()), words.values.slice(ends[at], ends[to] - ends[at]))
                yield _pack(ids[at:to], part)
                at = to

    words = lambda c: F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), _SPLIT)
    titled = F.flatten(F.transform(words(title_col), lambda w: F.array_repeat(w, TITLE)))
    dealt = pages.select(F.col(id_col).cast("long").alias("id"), F.col(title_col).cast("string").alias(title_col), F.col(text_col).cast("string").alias(text_col)).repartition("id")
    return dealt.select("id", F.concat(titled, words(text_col)).alias("words")).mapInArrow(run, _LISTED)


def _join(lists: pa.RecordBatch, before: int, most: int, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch, int]:
    """Blocks of sorted lists; then, unless these are the ``last``, the lists of the last block, which may go on, and how many of
    their token's postings come before them. ``before`` says that of the first list. A block has the lists that begin in the same
    stretch of ``most`` of their token's postings."""
    if not lists.num_rows:
        return pa.RecordBatch.from_pylist([], _BLOCKS), lists, 0
    n = pa.compute.list_value_length(lists.column(2)).to_numpy().astype(np.int64)
    code, power = lists.column(0).dictionary_encode().indices.to_numpy(), lists.column(1).to_numpy()
    first = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(power) != 0)])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(n)]))
    begin = np.cumsum(n) - n
    begin = begin - begin[first][group] + np.where(group == 0, before, 0)
    number = begin // most
    cut = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(number) != 0)])
    held = lists.slice(len(n) if last else cut[-1])
    cut = cut if last else cut[:-1]
    whole = len(n) - held.num_rows
    ids, weights = (np.asarray(lists.column(k).slice(0, whole).flatten()) for k in (2, 3))
    sizes = np.add.reduceat(n[:whole], cut) if len(cut) else np.zeros(0, np.int64)
    order = np.lexsort((ids, -weights, np.repeat(np.arange(len(cut)), sizes)))
    offsets = np.r_[0, np.cumsum(sizes)]
    ids, weights = ids[order], weights[order]
    listed = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (ids, weights)]
    told = [pa.array(power[cut], pa.int32()), pa.array(number[cut], pa.int32()), pa.array(weights[offsets[:-1]], pa.int64()), pa.array(sizes, pa.int64())]
    made = pa.RecordBatch.from_arrays([lists.column(0).take(pa.array(cut, pa.int64())), *told, *listed], schema=_BLOCKS)
    return made, held, 0 if last else int(begin[whole])


def build(pages: DataFrame, path: str, **columns) -> None:
    """Write the index of pages with distinct ids that are not null."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists in the order of tokens and powers, joined to blocks; a batch's last block may go on in the next one."""
        held, before = pa.RecordBatch.from_pylist([], _LISTS), 0
        for b in batches:
            ends, at = np.cumsum(pa.compute.list_value_length(b.column(2)).to_numpy()), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
                made, held, before = _join(pa.concat_batches([held, b.slice(at, to - at).cast(_LISTS)]), before, most, False)
                yield made
                at = to
        yield _join(held, before, most, True)[0]

    order = ["bucket", "token", "class"]
    dealt = lists(pages, **columns).withColumn("bucket", _bucket(F.col("token"))).repartition(BUCKETS, "bucket").sortWithinPartitions(*order)
    blocks = dealt.select("token", "class", "ids", "weights").mapInArrow(run, "token string, class int, block int, most long, n long, ids array<long>, weights array<long>")
    blocks.withColumn("bucket", _bucket(F.col("token"))).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)


def _of(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    buckets = [r.b for r in spark.createDataFrame([(w,) for w in words], "token string").select(_bucket(F.col("token")).alias("b")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("token").isin(words))


def top(spark: SparkSession, path: str, query: str, limit: int) -> DataFrame:
    """id, raw: the pages of highest weights in all, ties to the smaller id."""
    words = sorted(set(re.findall(r"\w+", query.lower())))
    if not words or limit < 1:
        return spark.createDataFrame([], "id long, raw long")
    blocks = _of(spark, path, words)
    # a page may be in blocks of several tokens, so the k-th is asked of one token at a time
    tokens = blocks.select("token", F.slice("weights", 1, limit).alias("w")).select("token", F.explode("w").alias("w"))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("w")))
    least = tokens.withColumn("r", rank).where(F.col("r") == limit).agg(F.max("w").alias("w")).first().w or 0
    candidates = blocks.where(F.col("most") * len(words) >= least).select(F.explode(F.arrays_zip("ids", "weights")).alias("p")).where(F.col("p.weights") * len(words) >= least).select(F.col("p.ids").alias("id")).distinct()
    every = blocks.select(F.explode(F.arrays_zip("ids", "weights")).alias("p")).select(F.col("p.ids").alias("id"), F.col("p.weights").alias("weight"))
    totals = every.join(candidates, "id", "left_semi").groupBy("id").agg(F.sum("weight").alias("raw"))
    return totals.orderBy(F.desc("raw"), "id").limit(limit)


def keyword_search(pages: DataFrame, path: str, query: str, limit: int, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """id, score, snippet, as search.keyword_search has it, from the index and the found pages alone."""
    spark = pages.sparkSession
    found = [(r.id, r.raw) for r in top(spark, path, query, limit).collect()]  # limit rows
    if not found:
        return pages.where(F.lit(False)).select(id_col, F.lit(0.0).alias("score"), F.substring(text_col, 1, 300).alias("snippet"))
    best = max(raw for _, raw in found)
    score = F.element_at(F.create_map(*[F.lit(x) for i, raw in found for x in (i, raw / best)]), F.col(id_col).cast("long"))
    return pages.where(F.col(id_col).isin([i for i, _ in found])).select(id_col, F.round(score, 6).alias("score"), F.substring(text_col, 1, 300).alias("snippet"))


def text_search(pages: DataFrame, path: str, query: str, limit: int, title_col: str = "title", text_col: str = "text", id_col: str = "id") -> DataFrame:
    """The index's hits; if there are none, pages whose title has the query anywhere, by title."""
    if top(pages.sparkSession, path, query, 1).limit(1).count():
        return keyword_search(pages, path, query, limit, text_col, id_col)
    near = pages.where(F.contains(F.lower(F.col(title_col)), F.lit(query.lower()))).orderBy(title_col, id_col).limit(limit)
    return near.select(id_col, F.lit(0.0).alias("score"), F.substring(text_col, 1, 300).alias("snippet"))
