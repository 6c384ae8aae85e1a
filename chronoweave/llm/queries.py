"""The registered queries of the corpus operators, and their DuckDB forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, jaccard, langid, licenses, media, packing, secrets, spelling, toxicity, urls, whitening
from ._base import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    """Register under the function's name."""
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the group its links make."""
    return jaccard.link(documents(spark, sf_dir, "doc_id", "text"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes they decode to, as digests."""
    made = bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image, read back, with digests and a cosine-transform hash."""
    made = media.read_media(media.write_media(documents(spark, sf_dir, "doc_id", "text")))
    return made.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the output."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], table.schema)
    made = chat.format_turns(chat.canonical_turns(table.unionByName(own)))
    back = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op5_chat_format"] = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(text) + length('<|im_end|>') + 1
      + length(role) - length(replace(role, '<', '')) + 2 * (length(role) - length(replace(role, chr(10), '')))
      + length(text) - length(replace(text, '<', '')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and a digest of the base kinds, and all spans."""
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by the classifier."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score", "words")


def fold(modulus: int, held: int):
    """held_out by the checksum of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(docs, ~fold(4, 2))
    return langid.identify(docs, model).select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    packed = packing.pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels of the rows that are not held out."""
    docs, labels = documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels.where(~fold(5, 0)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for every row whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(ann.build_index(rows), rows.where(F.col("vec_id") % 100 == 0))


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices."""
    found = licenses.scan(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("found", lambda f: f.base)
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda f: f.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f.word)).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f.word)).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f.similarity)), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("found", lambda f: F.concat_ws(":", f.label, f.start.cast("string"), f.end.cast("string"), f.edits.cast("string"))), ",").alias("spans"),
    )


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words, form and root."""
    return spelling.group(spelling.counts(documents(spark, sf_dir, "doc_id", "text")))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(rows)
    return whitening.whiten(rows, model, whitening.identity_errors(rows, model))
