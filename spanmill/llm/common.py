"""Shared helpers: durable intermediate tables and zero-copy text batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 19
#: Bytes of an Arrow batch that goes to a Python worker, where the session's builder doesn't say otherwise.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent on a single machine (a local master, as in
    tests) a folder is made and remembered in the session, so later calls agree;
    on a cluster that is an error, as executors don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, and the table outlives any executor; the shuffle
    files that led to it are dropped.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanmill/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete durable tables that nothing will read again, not even a lazy result."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are of bounded size.

    A batch lives several times over, in the executor and in its Python worker,
    and texts may be long; Spark's own bound of 64 MB is too much for that. The
    setting is read when the result is computed, so it stays in the session.
    """
    if not df.sparkSession.sparkContext.getConf().contains(_BATCH):
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def bit_filter(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, a power of two, with the low bits of every key set.

    It is made in Spark and is of one size whatever there is to hold, so it may
    be broadcast; it says "no" or "maybe".
    """
    slot = f"pmod({column}, {bits}L)"
    words = keys.selectExpr(f"CAST({slot} DIV 64 AS INT) AS word", f"shiftleft(1L, CAST({slot} % 64 AS INT)) AS bit")
    mask = np.zeros(bits // 64, np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask[np.asarray(found["word"])] = np.asarray(found["bits"])
    return mask


def maybe(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys may be in a bitmap of ``bit_filter``."""
    slot = keys & (64 * len(mask) - 1)
    return (mask[slot >> 6] >> (slot & 63)) & 1 == 1


#: Distinct keys and their counts that a task holds before it sends them on.
HELD_COUNTS = 1 << 20


def merge_counts(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct int64 keys of several pieces and the sums of their counts."""
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in pieces]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, inverse, np.concatenate([n for _, n in pieces]))
    return keys, counts


def combined(pieces):
    """Counts of a task's batches added up before they are shuffled, ``HELD_COUNTS`` keys at a time at most."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size > HELD_COUNTS:
            held = [merge_counts(held)]
            size = len(held[0][0])
            if 2 * size > HELD_COUNTS:
                yield held[0]
                held, size = [], 0
    if held:
        yield merge_counts(held)


def utf8_batch(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; nulls become empty rows."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = str(column.type).startswith("large")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Split a batch into row ranges of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j
