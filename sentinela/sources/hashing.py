"""SHA-256 and UTF-8 check of files that are too large for one value.

Such a file is read in splits, as lines, and its bytes are stored once as pieces. SHA-256 chains through a file in order, so
it is taken in steps of STEP bytes: the task of a step goes on from the state that the step before has left. No task reads
more than a split of a file, or its share of one step. Files are independent and go side by side.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.session import work_folder

# Workers get the functions of this module with the task, wherever the library is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Files up to WHOLE bytes are one value; a piece has PIECE bytes at most.
WHOLE, STEP, PIECE = 64 << 20, 256 << 20, 1 << 16
# Small row groups, so that a task that stores pieces holds a few of them only.
STORED = {"compression": "none", "parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}
# Names that Spark's text reader would unpack.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz)\z"
BOM = b"\xef\xbb\xbf"
PIECES = "file string, start long, place long, data binary, valid boolean, step long"
STATES = "file string, state binary, sha256 string"
# Bytes of OpenSSL's SHA256_CTX, a plain struct without pointers.
STATE_BYTES = 112


def _openssl() -> ctypes.CDLL | None:
    """The library under Python's hashlib, whose SHA-256 keeps its state where it can be copied; None if there is none."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        found.SHA256_Init.argtypes = [ctypes.c_void_p]
        found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
        found.SHA256_Final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
    except (ImportError, OSError, AttributeError):
        return None
    return found


def resumable() -> bool:
    return _openssl() is not None


class Sha256:
    """A SHA-256 that can be put down as bytes and taken up again."""

    def __init__(self, state: bytes | None = None):
        self._library, self._held = _openssl(), ctypes.create_string_buffer(state or b"", STATE_BYTES)
        if state is None:
            self._library.SHA256_Init(self._held)

    def update(self, data: pa.Buffer) -> None:
        self._library.SHA256_Update(self._held, data.address, data.size)

    def state(self) -> bytes:
        return self._held.raw

    def hexdigest(self) -> str:
        digest = ctypes.create_string_buffer(32)
        self._library.SHA256_Final(digest, ctypes.create_string_buffer(self._held.raw, STATE_BYTES))
        return digest.raw.hex()


def _packer(step_bytes: int):
    """Lines of splits, in order, to pieces; every line but a file's first has the line break before it."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("data", pa.binary()), ("valid", pa.bool_()), ("step", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place = None, 0
        for batch in batches:
            found, begin = [], 0
            for end in sorted({e for c in ("file", "start") for e in pc.run_end_encode(batch[c]).run_ends.to_pylist()}):
                file, start = batch["file"][begin].as_py(), batch["start"][begin].as_py()
                data = b"\n".join(batch["value"].slice(begin, end - begin).to_pylist())
                valid = pc.all(batch["valid"].slice(begin, end - begin)).as_py()
                if (file, start) != split:
                    split, place = (file, start), 0
                if start or place:
                    data = b"\n" + data
                for at in range(0, max(len(data), 1), PIECE):
                    found.append((file, start, place, data[at:at + PIECE], valid, start // step_bytes))
                    place += 1
                begin = end
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), schema)], schema=schema)

    return pack


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of each file after its pieces. Rows come by file, that of its state so far first, then the pieces in order."""
    schema = pa.schema([("file", pa.string()), ("state", pa.binary()), ("sha256", pa.string())])

    def row(file: str, sha: Sha256) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": file, "state": sha.state(), "sha256": sha.hexdigest()}], schema=schema)

    current, sha = None, None
    for batch in batches:
        for i, file in enumerate(batch["file"].to_pylist()):
            if file != current:
                if sha:
                    yield row(current, sha)
                current, sha = file, Sha256(batch["state"][i].as_py())
            elif batch["data"][i].is_valid:
                sha.update(batch["data"][i].as_buffer())
    if sha:
        yield row(current, sha)


def in_steps(whole: int) -> Column:
    """Whether a file is hashed in steps; said of its metadata only, so that other files are not opened."""
    return (F.col("_metadata.file_size") > whole) & ~F.col("_metadata.file_name").rlike(PACKED)


def hashed_in_steps(spark: SparkSession, path: str, whole: int, step_bytes: int) -> DataFrame:
    """(file, sha256, valid_utf8) of the files that `in_steps` names, of which there must be one; `file` is `_metadata.file_path`.

    Runs when called: pieces and states are stored in the shared folder. The text reader leaves out a byte-order mark at the
    beginning and does not tell whether the last line has a line break: both follow from the size of the file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).filter(in_steps(whole)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"), F.is_valid_utf8("value").alias("valid"),
    )
    folder = work_folder(spark)
    lines.mapInArrow(_packer(step_bytes), PIECES).write.options(**STORED).partitionBy("step").parquet(f"{folder}/pieces")
    pieces = spark.read.schema(PIECES).parquet(f"{folder}/pieces")
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    sums = pieces.groupBy("file").agg(F.sum(F.octet_length("data")).alias("known"), F.bool_and("valid").alias("valid_utf8"))
    missing = (F.col("length") - F.col("known")).cast("int")
    checked = F.when(missing.isin(0, 1, 3, 4), missing).otherwise(
        F.raise_error(F.concat(F.lit("file changed while it was read: "), F.col("file"))).cast("int"))
    sums.join(sizes, "file").select("file", "length", "valid_utf8", checked.alias("missing")).write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    steps = -(-files.agg(F.max("length")).first()[0] // step_bytes)
    states = files.select("file", F.lit(None).cast("binary").alias("state"))
    mark = files.filter("missing >= 3").select("file", F.lit(-1).alias("start"), F.lit(0).alias("place"), F.lit(BOM).alias("data"))
    last_break = files.filter("missing IN (1, 4)").select("file", F.col("length").alias("start"), F.lit(0).alias("place"), F.lit(b"\n").alias("data"))
    for step in range(steps):
        rows = pieces.filter(F.col("step") == step).select("file", "start", "place", "data")
        rows = rows.unionByName(mark) if step == 0 else rows
        rows = rows.unionByName(last_break) if step == steps - 1 else rows
        before = states.select("file", "state", F.lit(-2).alias("start"), F.lit(0).alias("place"))
        ordered = before.unionByName(rows, allowMissingColumns=True).repartition("file").sortWithinPartitions("file", "start", "place")
        ordered.select("file", "state", "data").mapInArrow(_advance, STATES).write.parquet(f"{folder}/states-{step}")
        states = spark.read.schema(STATES).parquet(f"{folder}/states-{step}")
    return states.join(files, "file").select("file", "sha256", "valid_utf8")
