"""What queries over texts and vectors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table

#: How often each document says two words, as DuckDB text.
WORD_COUNTS = """(SELECT doc_id AS id, text, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x = 'with')) + len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x = 'from')) AS raw FROM documents)"""


def documents(spark, d):
    return table(spark, d, "documents", F.col("doc_id").alias("id"), F.concat(F.lit("Page "), "doc_id").alias("title"), "text", "lang")


def probe(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first().embedding]
