"""Session settings that every plan relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def pin(spark: SparkSession) -> SparkSession:
    """UTC as session zone, as time stamps without a zone are read in it; adaptive execution on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("shiftframe").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return pin(b.getOrCreate())


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for cutting lineage: spark.checkpoint.dir; a temporary one in local mode alone."""
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


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_shiftframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="shiftframe-src-"), "shiftframe_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._shiftframe_shipped = True
