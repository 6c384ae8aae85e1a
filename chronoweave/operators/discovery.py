"""From an entity to events about it: pages to read, prompts, extraction by a given function, errors apart.

Many roots are handled at once. What a language model does is a function that the caller gives; it gets lists of prompts in
the executors, a batch at a time, so that a batch that fails loses nothing of the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import kept

#: Pages that link to a root, that it links to, that it has edges to; characters of chunks and of plain content.
INCOMING, OUTGOING, EDGES, CHUNK_CHARS, PLAIN_CHARS = 20, 20, 40, 8000, 4000
#: Characters of a page read alone, what then follows, and how many linked pages it tells.
PAGE_CHARS, CUT, LINKED = 8000, "\n... [truncated]", 30


def allowed(own, other):
    """Whether a page's continuity goes with a root's: the same, Both and Unknown; all if the root's is neither Canon nor Legends."""
    known = F.col(own).isin("Canon", "Legends")
    return F.coalesce(F.col(other), F.lit("Unknown")).isin("Both", "Unknown") | F.when(known, F.col(other) == F.col(own)).otherwise(F.col(other).isin("Canon", "Legends"))


def discover(roots: DataFrame, pages: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """root, page, how (self, incoming, outgoing, graph), nth: the pages to read for each root, each once, as the first of these
    that finds it.

    roots: id; pages: id, url, continuity; links: id, href (of infoboxes); edges: from_id, to_id, weight, continuity. Of
    each kind the first pages by id, of edges the heaviest, then by target, each kind under its own limit before the pages found
    otherwise are taken out. Of a hot page's links each task keeps a limit's worth before the shuffle."""
    own = pages.select(F.col("id").alias("root"), F.col("url").alias("root_url"), F.col("continuity").alias("root_continuity")).join(roots.select(F.col("id").alias("root")).distinct(), "root")
    at = pages.select(F.col("id").alias("page"), "url", "continuity")
    first = lambda df, order, most: df.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where(F.col("nth") <= most)
    told = links.where(F.coalesce("href", F.lit("")) != "").select("id", "href").distinct()
    to_root = own.join(told.withColumnRenamed("id", "page"), F.col("href") == F.col("root_url")).join(at.drop("url"), "page").where(allowed("root_continuity", "continuity") & (F.col("page") != F.col("root")))
    from_root = own.join(told.withColumnRenamed("id", "root"), "root").join(at, F.col("href") == F.col("url")).where(allowed("root_continuity", "continuity") & (F.col("page") != F.col("root")))
    known = own.join(edges.select(F.col("from_id").alias("root"), F.col("to_id").alias("page"), "weight", F.col("continuity").alias("edge_continuity")), "root").where(allowed("root_continuity", "edge_continuity"))
    best = first(known, [F.desc("weight"), "page"], EDGES).where("page <> root").join(at.select("page"), "page", "left_semi")
    kinds = [
        own.select("root", F.col("root").alias("page"), F.lit(0).alias("kind"), F.lit(0).alias("nth")),
        first(to_root.select("root", "page").distinct(), ["page"], INCOMING).select("root", "page", F.lit(1).alias("kind"), "nth"),
        first(from_root.select("root", "page").distinct(), ["page"], OUTGOING).select("root", "page", F.lit(2).alias("kind"), "nth"),
        best.groupBy("root", "page").agg(F.min("nth").alias("nth")).select("root", "page", F.lit(3).alias("kind"), "nth"),
    ]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    once = every.groupBy("root", "page").agg(F.min(F.struct("kind", "nth")).alias("x"))
    how = F.element_at(F.array(*[F.lit(x) for x in ("self", "incoming", "outgoing", "graph")]), F.col("x.kind") + 1)
    return once.select("root", "page", how.alias("how"), F.col("x.nth").alias("nth"))


def contents(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, content: a page's chunks under their headings in order, cut to CHUNK_CHARS; without chunks its text, cut to
    PLAIN_CHARS. chunks: id, chunk_index, heading, text. Of a page no more chunks are put together than the cut can show."""
    said = F.concat(F.when(F.trim(F.coalesce("heading", F.lit(""))) != "", F.concat(F.lit("## "), "heading", F.lit("\n"))).otherwise(""), "text", F.lit("\n\n"))
    before = F.sum(F.length("said")).over(Window.partitionBy("id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    needed = chunks.select("id", "chunk_index", said.alias("said")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < CHUNK_CHARS)
    whole = needed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "said"))), lambda x: x.said), "").alias("chunked"))
    return pages.select("id", "text").join(whole, "id", "left").select("id", F.coalesce(F.substring("chunked", 1, CHUNK_CHARS), F.substring(F.coalesce("text", F.lit("")), 1, PLAIN_CHARS)).alias("content"))


def page_content(pages: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """id, content (PAGE_CHARS, and a mark where it was cut), linked (up to LINKED pages by id: id, title, continuity), edges
    (those stored from the page: label, to_id, weight). A prompt's parts for each page."""
    text = F.coalesce("text", F.lit(""))
    content = F.when(F.length(text) > PAGE_CHARS, F.concat(F.substring(text, 1, PAGE_CHARS), F.lit(CUT))).otherwise(text)
    told = links.where(F.trim(F.coalesce("href", F.lit(""))) != "").select("id", "href").distinct()
    to = told.join(pages.select(F.col("url").alias("href"), F.struct("id", "title", F.coalesce("continuity", F.lit("Unknown")).alias("continuity")).alias("to")), "href")
    some = to.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("to.id"))).where(F.col("nth") <= LINKED)
    linked = some.groupBy("id").agg(F.array_sort(F.collect_list("to")).alias("linked"))
    stored = edges.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("label", "to_id", "weight"))).alias("edges"))
    return pages.select("id", "title", content.alias("content")).join(linked, "id", "left").join(stored, "id", "left")


def extract(rows: DataFrame, batch: list[str], order: list[str], extractor: Callable[[list[dict]], list[dict]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of batches. The extractor gets a batch's rows in order and gives rows of ``schema``; events are these with
    the batch's columns. A batch whose call raises, or gives what the schema can't hold, has no events but one error row: the
    batch's columns, rows (how many it had) and error. Each batch is asked once: the answers are written before they are parted.
    A task holds one batch at a time; batches are bounded by how they are made (pages.bundles)."""
    kind = rows.select(*batch).schema
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held = None, []

        def ask() -> pd.DataFrame:
            try:
                given = [{n: e[n] for n in names} for e in extractor(held)]
                out = [(*own, given, None, len(held))]
            except Exception as e:
                out = [(*own, None, f"{type(e).__name__}: {e}"[:1000], len(held))]
            return pd.DataFrame(out, columns=[*batch, "events", "error", "rows"])

        for f in frames:
            for row in f.to_dict("records"):
                key = tuple(row[b] for b in batch)
                if key != own and held:
                    yield ask()
                    held = []
                own = key
                held.append(row)
        if held:
            yield ask()

    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields) + f", events array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in rows.sparkSession.createDataFrame([], schema).schema.fields)}>>, error string, rows long"
    answers = kept(rows.repartition(*batch).sortWithinPartitions(*batch, *order).mapInPandas(run, made), "answers")
    events = answers.where("error IS NULL").select(*batch, F.explode("events").alias("e")).select(*batch, "e.*")
    return events, answers.where("error IS NOT NULL").select(*batch, "rows", "error")
