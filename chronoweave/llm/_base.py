"""Helpers that the corpus operators share: the shared scratch folder, Arrow text buffers, table reads."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step of a Python operator handles at once; a single longer text is handled alone.
STEP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session uses a
    folder of its own; on a cluster there is none that all executors see, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/chronoweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that keep() wrote and that nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_kept_at", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(columns: list[str], name: str) -> str:
    """A column name that is not among the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table with only the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def give_back() -> None:
    """Return what a Python worker no longer holds to the system: workers are reused, and one task's peak would stay
    with all later ones. Where the C library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: int, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text in ``column`` of each is at most ``step`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + step, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
        give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def binary(values: list[bytes]) -> pa.Array:
    """A binary column."""
    return pa.array(values, pa.binary())


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """One record batch of the given schema from arrays or lists."""
    made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)


def passing(df: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows whose text passes, with all their columns and no shuffle. judge: two columns (a row's number in the
    batch, text) -> one truth value for each."""
    place = df.columns.index(text_col)

    def run(batches):
        for b in pieces(batches, place, 4 << 20):
            text = b.column(place)
            fine = judge(pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), text], names=["doc_id", "text"]))
            yield b.filter(pa.array(np.asarray(fine, bool)))

    return df.mapInArrow(run, df.schema)
