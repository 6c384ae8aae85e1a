"""The corpus pipeline: language, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it back as the next stage's documents. All stages but the last return the columns of documents, whatever
further columns those have.

Defined cases: rows with a null id are kept by every stage that can judge their text; null and empty texts are
rejected by the language stage, as they have no language; repeated rows are judged each, and of equal texts the near
duplicate stage keeps the row of the smallest id (of rows that repeat that id, one); empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import jaccard, langid, packing, secrets, toxicity
from chronoweave.llm._base import free_name, keep

#: Below this share of its words in one language a text is rejected, as mixed.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of which most words are in one learned language. Learns from all rows with a language."""
    return langid.in_language(docs, langid.fit(docs, F.lit(True)), LEAST_SHARE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a toxicity score below 0.5. Learns from the labels of the rows there are."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest id. Texts without words have no group and stay."""
    return jaccard.one_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows where the text has changed."""
    before = free_name(docs.columns, "text_before")
    clean = secrets.redact(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.coalesce(F.col("text") != F.col(before), F.lit(False))
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    made = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", redacted), ("packing", packed)]

#: Learned stages can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
