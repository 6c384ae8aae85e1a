"""Incremental copies of a growing folder of pages: a file stream in micro-batches, upserted by key.

The target is dealt to parts by a hash of the key. A batch writes the parts that its keys are in, under a name of its own,
and then a pointer to all parts as they now stand; so it costs what it touches, a reader sees a batch whole or not at all,
and a batch that runs again after its pointer was written does nothing. What the stream's checkpoint says has been read. The
watermark of a run is its start, not its end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import upsert
from ..sources.files import Files

POINTER, PARTS = "_current.json", 64


def _rows(spark: SparkSession, places: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def latest(spark: SparkSession, target: str, schema) -> DataFrame:
    """The target as the last batch left it, or no rows."""
    pointer = Files(spark).read(f"{target}/{POINTER}")
    return _rows(spark, sorted(pointer["parts"].values()) if pointer else [], schema)


def put_batch(rows: DataFrame, batch: int, schema, key: str, newest: str, target: str, parts: int = PARTS) -> list[str]:
    """Upsert a batch and tell which parts it wrote. Of several rows of a key the one with the highest ``newest`` counts. A
    target keeps the number of parts that it began with."""
    spark = rows.sparkSession
    files = Files(spark)
    pointer = files.read(f"{target}/{POINTER}") or {"batch": -1, "count": parts, "parts": {}}
    if batch <= pointer["batch"]:
        return []
    part = F.pmod(F.xxhash64(key), F.lit(pointer["count"])).cast("int")
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(newest)).alias("r")).select("r.*")
    touched = sorted(r.p for r in best.select(part.alias("p")).distinct().collect())  # no more than there are parts
    old = _rows(spark, [place for p in touched if (place := pointer["parts"].get(str(p)))], schema)
    own = f"{target}/b{batch}-{uuid.uuid4().hex}"
    upsert(old, best.select(*old.columns), key).withColumn("_part", part).repartition(max(1, len(touched)), "_part").write.partitionBy("_part").parquet(own)
    made = {str(p): f"{own}/_part={p}" for p in touched}
    files.put(f"{target}/{POINTER}", {"batch": batch, "count": pointer["count"], "parts": pointer["parts"] | made}, over=True)
    return sorted(made)


def clean(spark: SparkSession, target: str) -> list[str]:
    """Delete the folders of batches that no part is in any more. Not while a reader of an older state or a batch is at work."""
    files = Files(spark)
    used = {place.split("/")[-2] for place in (files.read(f"{target}/{POINTER}") or {"parts": {}})["parts"].values()}
    gone = [n for n in files.names(target) if n.startswith("b") and n not in used]
    for name in gone:
        files.delete(f"{target}/{name}")
    return gone


def sync(spark: SparkSession, source: str, schema, key: str, newest: str, target: str, checkpoint: str, files: int = 100) -> None:
    """Reads what is new in ``source`` and ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    each = stream.writeStream.foreachBatch(lambda rows, batch: put_batch(rows, batch, rows.schema, key, newest, target) and None)
    each.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def due(states: DataFrame, now, hours: int = 24) -> DataFrame:
    """job and since: from when each job reads on; without a state from ``hours`` before now."""
    return states.select("job", F.coalesce("last_start", now - F.expr(f"INTERVAL {hours} HOURS")).alias("since"))
