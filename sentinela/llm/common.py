"""Stored intermediate tables, and Arrow batches as rows of text bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one numpy pass works on; a longer text is a pass of its own.
PASS_BYTES = 2_000_000
_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`. Where it is unset, one of our own, but only in local mode: on a
    cluster every machine would write to its own disk, so there the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        # Spark does not let this setting be changed later, so the folder is kept here
        folder = _OWN_FOLDER.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="checkpoints-")
        _OWN_FOLDER[spark.sparkContext.applicationId] = folder
    return folder


def stored(df: DataFrame, parts: int | None = None) -> DataFrame:
    """`df` written once to the shared folder and read back: a lost executor costs no recomputation of what led to it.

    `parts` is the most files to write, for tables that are small next to the shuffles they come from.
    """
    spark = df.sparkSession
    df = df.coalesce(parts) if parts else df
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, the split into learning and held-out rows; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column, one after the other, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def passes(batch: pa.RecordBatch, text: str = "text", most: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about `most` bytes of text, with their bytes and offsets; every row is in one slice."""
    data, at = text_bytes(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin), data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end
