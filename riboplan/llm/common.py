"""What the operators of this subpackage share: reading, durable cuts of lineage, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word contract: space and the controls 0x09 to 0x0D (what ``bytes.split()`` splits at).
WHITE = r"[\x20\x09-\x0D]+"

#: Rows of 8-byte keys up to which a side may be broadcast (about 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, removed when the application ends.

    Where that is unset, a temporary folder serves a local master only: no other machine would see it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the cluster {master} shares")
        root = tempfile.gettempdir()
    folder = f"{root.rstrip('/')}/riboplan-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared checkpoint folder, which outlives any executor.

    Parquet is written, for its rows are smaller than a checkpoint's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side of ``rows`` rows (counted by the caller) for broadcast only if it is within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def written_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join as a durable table, broadcast if its counted rows are within ``limit``.

    Beyond it both sides of the join come straight from a shuffle, so that Spark can split a hot key.
    """
    df = durable(df)
    return small_side(df, df.count(), limit)


def under(most: int, rows: int) -> int:
    """Bound of a 64-bit hash under which about 2 * ``most`` + 100 of ``rows`` rows lie; all, if there are no more."""
    share = (2 * most + 100) / max(rows, 1)
    return 2**63 - 1 if share >= 1 else int(-(2**63) + share * 2**64)


#: Bytes of a batch between Spark and Python: texts are long, and two batches a task must fit.
BATCH_BYTES = 4_000_000


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of about BATCH_BYTES at most, after which a worker gives its memory back.

    The bound is the session's, read when a plan runs, so it stays set; it changes no result. One in other units
    than bytes, or a smaller one, is the user's and is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(tidied, schema)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters outside WHITE; empty for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, *range(9, 14)]] = True
_BYTES[_IS_WHITE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_names(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all words of all texts in a row, and the number of words of each text.

    A name is a hash of the word's bytes (random 64-bit values of the bytes, weighted by their places), made
    for all words at once. ``lower`` first lowers A-Z.
    """
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = _LOWER[raw] if lower else raw
    ink = ~_IS_WHITE[raw]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    gaps = np.diff(np.concatenate([first, [len(raw)]]))
    place = np.arange(first[0], len(raw)) - np.repeat(first, gaps)
    power = np.full(int(gaps.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    names = mix(np.add.reduceat(_BYTES[raw[first[0] :]] * power[place], first - first[0]))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    upto = np.searchsorted(first, ends)
    return names, np.diff(np.concatenate([[0], upto]))
