"""Approximate vector search under a filter: random-projection buckets, probed in the order of their distance.

Each of TABLES tables signs a vector by planes drawn from a seed; the signs are its code. The index is (table, code, id and
what is filtered by), sorted by table and code, so that a probe reads few row groups. A query first takes the filter, then
counts what passes in each bucket (at most TABLES * 2^bits rows), and probes each table's buckets by what it costs to get
there: the sum of the query's distances to the planes on whose other side a bucket lies. It goes on until limit * WIDE rows
that pass are met in each table, so a strict filter probes more buckets and a filter that few pass ends in an exact scan of
these. Candidates are scored exactly, by cosine.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import vector_search

#: Tables, rows that a bucket should have, the most bits, candidates for each hit asked for, the planes' seed.
TABLES, FULL, MOST_BITS, WIDE, SEED = 8, 64, 14, 20, 11


def planes(dim: int, bits: int) -> np.ndarray:
    """[table, plane, entry], the same for the same numbers."""
    return np.random.default_rng([SEED, dim, bits]).normal(size=(TABLES, bits, dim))


def build(rows: DataFrame, path: str, vector_col: str, keep: list[str], id_col: str = "id") -> None:
    """Write ``path``/codes (table, code, id, kept columns), ``path``/vectors and ``path``/about. Rows whose vector is null,
    empty or zero are left out, as no cosine is theirs. Vectors must be of one length."""
    fine = rows.where(F.col(vector_col).isNotNull() & F.exists(vector_col, lambda x: x != 0))
    about = fine.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("dim")).first()
    dim, bits = about["dim"] or 1, min(MOST_BITS, max(1, round(math.log2(max(2, about["n"] / FULL)))))
    p = planes(dim, bits).reshape(-1, dim).T

    @F.pandas_udf("array<int>")
    def codes(v):
        signs = (np.stack(v.to_numpy()).astype(np.float64) @ p >= 0).reshape(len(v), TABLES, bits) if len(v) else np.zeros((0, TABLES, bits))
        return type(v)(list((signs << np.arange(bits)).sum(2).astype(np.int32)))

    kept = [F.col(c) for c in keep]
    coded = fine.select(F.col(id_col).alias("id"), *kept, F.posexplode(codes(vector_col)).alias("table", "code"))
    coded.repartitionByRange("table", "code").sortWithinPartitions("table", "code").write.parquet(f"{path}/codes")
    fine.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/vectors")
    rows.sparkSession.createDataFrame([(dim, bits)], "dim int, bits int").coalesce(1).write.parquet(f"{path}/about")


def search(spark: SparkSession, path: str, query: list[float], limit: int, passes: Column | None = None, min_score: float | None = None) -> DataFrame:
    """id, kept columns, score: about the nearest rows that pass, nearest first."""
    about = spark.read.parquet(f"{path}/about").first()
    if len(query) != about["dim"]:
        raise ValueError(f"a query of {len(query)} entries, vectors of {about['dim']}")
    far = planes(about["dim"], about["bits"]) @ np.asarray(query, np.float64)
    own = [int((f >= 0) @ (1 << np.arange(about["bits"]))) for f in far]
    codes = spark.read.parquet(f"{path}/codes")
    codes = codes.where(passes) if passes is not None else codes
    cost = F.lit(None).cast("double")
    for t in range(TABLES):
        other = lambda k: F.pmod(F.shiftright(F.col("code").bitwiseXOR(F.lit(own[t])), k), F.lit(2))  # noqa: B023, E731
        cost = F.when(F.col("table") == t, sum((other(k) * F.lit(float(abs(far[t][k]))) for k in range(about["bits"])), F.lit(0.0))).otherwise(cost)
    # one row for each bucket, TABLES * 2^bits at most
    buckets = codes.groupBy("table", "code").agg(F.count("*").alias("n")).withColumn("cost", cost)
    before = F.sum("n").over(Window.partitionBy("table").orderBy("cost", "code").rowsBetween(Window.unboundedPreceding, -1))
    probed = buckets.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit * WIDE).select("table", "code")
    near = codes.join(F.broadcast(probed), ["table", "code"], "left_semi").drop("table", "code").dropDuplicates(["id"])
    scored = spark.read.parquet(f"{path}/vectors").join(near, "id")
    return vector_search(scored, "vector", query, limit, min_score).drop("vector")
