"""Queries over texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.tables import table
from ._texts import WORD_COUNTS, documents, probe
from .catalog import query


@query()
def article_chunks(spark, d):
    made = S.chunks(documents(spark, d), "id", "title", "text")
    return made.select("id", "chunk_index", "heading", F.length("text").alias("chars"), F.md5("text").alias("digest"))


_BARE = "regexp_replace(regexp_replace(text, '\\[!\\[[^\\]]*\\]\\(data:image[^\\)]*\\)\\]\\([^\\)]*\\)', '', 'g'), 'data:image/[^)\\s]+', '', 'g')"


@query(f"SELECT doc_id AS id, length(trim(regexp_replace({_BARE}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)))::INT AS chars FROM documents", graph=False)
def boilerplate(spark, d):
    return documents(spark, d).select("id", F.length(S.strip_boilerplate(F.col("text"))).alias("chars"))


@query()
def page_markdown(spark, d):
    made = S.html_to_markdown(table(spark, d, "pages", "page_id", "html"), "page_id", "html", "https://example.org")
    return made.select("id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query("""SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY score DESC, id LIMIT 20""", graph=False)
def vector_search(spark, d):
    rows = table(spark, d, "embeddings", F.col("vec_id").alias("id"), "label", "embedding").where(F.col("label").isin(1, 2, 3))
    return S.vector_search(rows, "embedding", probe(spark, d), 20).select("id", "label", "score")


@query("""SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score FROM embeddings WHERE round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) >= 0.6 ORDER BY score DESC, id LIMIT 50""", graph=False)
def vector_search_least_score(spark, d):
    rows = table(spark, d, "embeddings", F.col("vec_id").alias("id"), "embedding")
    return S.vector_search(rows, "embedding", probe(spark, d), 50, 0.6).select("id", "score")


@query(f"SELECT id, round(raw / max(raw) OVER (), 6) AS score, substr(text, 1, 300) AS snippet FROM (SELECT * FROM {WORD_COUNTS} WHERE raw > 0 ORDER BY raw DESC, id LIMIT 15)", graph=False)
def keyword_search(spark, d):
    return S.keyword_search(documents(spark, d), "with FROM", 15)


@query("SELECT doc_id AS id, 0.0::DOUBLE AS score, substr(text, 1, 300) AS snippet FROM documents WHERE contains(lower('Page ' || doc_id), 'pag') ORDER BY 'Page ' || doc_id, doc_id LIMIT 10", graph=False)
def text_search_fallback(spark, d):
    return S.text_search(documents(spark, d), "pag", 10)


@query(f"""WITH k AS (SELECT id, round(raw / max(raw) OVER (), 6) AS score FROM (SELECT * FROM {WORD_COUNTS} WHERE raw > 0 ORDER BY raw DESC, id LIMIT 60)),
s AS (SELECT id, min(score) AS score FROM (SELECT vec_id % 40 AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score, vec_id FROM embeddings ORDER BY score DESC, vec_id LIMIT 60) GROUP BY 1)
SELECT coalesce(k.id, s.id) AS id, round(coalesce(least(1.0, (s.score + k.score) / 2 * 1.2), s.score, k.score), 6) AS score, CASE WHEN s.id IS NULL THEN 'keyword' WHEN k.id IS NULL THEN 'semantic' ELSE 'both' END AS source FROM k FULL JOIN s ON k.id = s.id""".replace("least(1.0, (s.score + k.score) / 2 * 1.2)", "CASE WHEN s.score IS NOT NULL AND k.score IS NOT NULL THEN least(1.0, (s.score + k.score) / 2 * 1.2) END"), graph=False)
def hybrid_search(spark, d):
    k = S.keyword_search(documents(spark, d), "with from", 60)
    rows = table(spark, d, "embeddings", "vec_id", (F.col("vec_id") % 40).alias("id"), "embedding")
    s = S.vector_search(rows, "embedding", probe(spark, d), 60, id_col="vec_id")
    return S.hybrid(k, s)


@query("SELECT source AS id, min(doc_id) AS first_doc, min_by(left(text, 100), doc_id) AS intro FROM documents GROUP BY 1", graph=False)
def article_intro(spark, d):
    """The text of the first chunk of each page, here of each source."""
    return table(spark, d, "documents", "doc_id", "text", "source").groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("first_doc"), F.min_by(F.substring("text", 1, 100), "doc_id").alias("intro"))


@query("SELECT page_id AS id, url || CASE WHEN page_id % 2 = 0 THEN '' ELSE '#Part_' || page_id END AS link FROM pages", graph=False)
def section_links(spark, d):
    section = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("Part_"), "page_id"))
    return table(spark, d, "pages", F.col("page_id").alias("id"), S.deep_link(F.col("url"), section).alias("link"))
