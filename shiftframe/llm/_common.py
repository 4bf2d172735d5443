"""Shared plumbing of the text operators: session settings, the shared folder, Arrow batches and hash tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one Arrow batch may hold on its way to a Python worker.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_shiftframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="shiftframe-src-"), "shiftframe_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._shiftframe_shipped = True


#: Rows of one Arrow batch on its way to a Python worker, beside BATCH_BYTES.
BATCH_ROWS = 4096


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches, as rows may be very long, and ship the package. Lower bounds of the session stay."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shiftframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that results may still read lazily; they go when the program ends, if its session is still there.
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        remove(spark, *_WRITTEN)


def saved(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back; lost executors then cost nothing that came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later result reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df as its files split it; only a table of fewer files than cores is dealt out anew, over all of them.

    No size is looked at: a table of many files is never shuffled, whether large or small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(4 * cores)


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each holds about `most` bytes."""
    for batch in batches:
        at, n = 0, batch.num_rows
        lengths = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        while at < n:
            base = lengths[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(lengths, base + most, "right")))
            yield batch.slice(at, end - at)
            at = end


class PairTable:
    """Open-addressing hash table from non-negative int64 keys to int32 values, probed by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        slot = self._home(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several that want one slot, the last gets it
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        slot = self._home(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot_o = (slot[open_] + 1) & self.mask
            slot[open_] = slot_o
            seen = self.keys[slot_o]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot_o[hit]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated integer ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
