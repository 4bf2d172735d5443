"""Files: digests on the driver and in tasks, by pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import store


def sha256_file(path: str | Path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def digests(spark: SparkSession, folder: str, ends: str | tuple[str, ...] = "") -> DataFrame:
    """(name, length, sha256) of the files below a folder whose names end so. Their names are listed once; tasks read them in pieces of a megabyte, whatever their size."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                size, sha = store.digest(f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([sha])], ["name", "length", "sha256"])

    found = [(x,) for x in store.names(folder) if x.endswith(ends)]
    listed = spark.createDataFrame(found, "name string").repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)))
    return listed.mapInArrow(run, "name string, length long, sha256 string")
