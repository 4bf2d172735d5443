"""A Spark data source for arrays in .npy files: `df.write.format("npy")`, `spark.read.format("npy")`.

An array is a folder. Its rows are (pos, value) or (pos, values array): pos from 0 without gaps, every array of the same length. Each task writes
the stretches of positions that it holds as parts of their own, plain .npy files of at most `rows` rows, under names that no other attempt uses,
and reports them; the driver's commit checks that the parts of all tasks cover the positions once, removes what lost attempts left behind, and writes the list of parts
last. A folder without that list is not an array, so a job that dies leaves none, and a reader never sees a part of a lost attempt.

Reading has a task for each part, streams it in pieces, and refuses a part whose digest is not the listed one. Any store that pyarrow opens will do.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import IntegrityError
from ..session import ship
from . import store

LIST = "_array.json"
#: Element types: Spark's, numpy's.
KINDS = {"bigint": "<i8", "int": "<i4", "float": "<f4", "double": "<f8", "tinyint": "|i1"}
ROWS = 1 << 16


def header(dtype: str, shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": dtype, "fortran_order": False, "shape": shape})
    return out.getvalue()


@dataclass
class Part(InputPartition):
    path: str
    first: int
    rows: int
    sha256: str


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.rows = options["path"].rstrip("/"), overwrite, int(options.get("rows", ROWS))
        if len(schema) != 2 or schema[0].dataType != T.LongType():
            raise IntegrityError(f"an array has columns pos long and its values, not {schema.simpleString()}")
        kind = schema[1].dataType
        self.wide = isinstance(kind, T.ArrayType)
        self.kind = KINDS.get((kind.elementType if self.wide else kind).simpleString())
        if self.kind is None or self.rows < 1:
            raise IntegrityError(f"no array of {kind.simpleString()} in parts of {self.rows} rows")
        if not overwrite and LIST in store.names(self.path):
            raise IntegrityError(f"{self.path} is an array already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Parts of the positions of this task, each a run without gaps."""
        done: list[dict] = []
        held: list[np.ndarray] = []
        first = after = 0

        def put() -> None:
            if held:
                done.append(self.part(np.concatenate(held), first))
                held.clear()

        try:
            for batch in iterator:
                pos, values = batch.column(0).to_numpy(), self.matrix(batch.column(1))
                order = np.argsort(pos, kind="stable")
                pos, values = pos[order], values[order]
                for own in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) != 1) + 1):
                    while len(own):
                        if held and (pos[own[0]] != after or after - first == self.rows or held[0].shape[1:] != values.shape[1:]):
                            put()
                        if not held:
                            first = after = int(pos[own[0]])
                        now, own = own[: self.rows - (after - first)], own[self.rows - (after - first) :]
                        held.append(values[now])
                        after += len(now)
            put()
        except BaseException:
            self.discard(done)
            raise
        return Written(done)

    def matrix(self, column: pa.Array) -> np.ndarray:
        if column.null_count:
            raise IntegrityError("an array has no missing values")
        if not self.wide:
            return column.to_numpy(zero_copy_only=False).astype(self.kind)
        widths = np.unique(np.diff(column.offsets.to_numpy()))
        if len(widths) > 1:
            raise IntegrityError(f"rows of an array have different lengths: {widths.tolist()[:5]}")
        flat = column.flatten()
        if flat.null_count:
            raise IntegrityError("an array has no missing values")
        return flat.to_numpy(zero_copy_only=False).astype(self.kind).reshape(len(column), int(widths[0]) if len(widths) else 0)

    def part(self, values: np.ndarray, first: int) -> dict:
        name = f"part-{first:012d}-{uuid.uuid4().hex}.npy"
        fs, at = store.opened(f"{self.path}/{name}")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        sha, size = hashlib.sha256(), 0
        with fs.open_output_stream(at, compression=None) as out:
            for piece in (header(self.kind, values.shape), np.ascontiguousarray(values).tobytes()):
                out.write(piece)
                sha.update(piece)
                size += len(piece)
        return {"name": name, "first": first, "rows": len(values), "shape": list(values.shape[1:]), "bytes": size, "sha256": sha.hexdigest()}

    def discard(self, parts: list[dict]) -> None:
        for part in parts:
            store.remove(f"{self.path}/{part['name']}")

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["first"])
        end = 0
        for p in parts:
            if p["first"] != end or p["shape"] != parts[0]["shape"]:
                self.discard(parts)
                raise IntegrityError(f"{self.path}: positions from {end} on are missing, repeated, or of another length")
            end += p["rows"]
        shape = [end, *(parts[0]["shape"] if parts else [0] * self.wide)]
        store.write_text(f"{self.path}/{LIST}", json.dumps({"descr": self.kind, "shape": shape, "parts": parts}, indent=2, sort_keys=True) + "\n")
        listed = {p["name"] for p in parts}
        self.discard([{"name": x} for x in store.names(self.path) if x.endswith(".npy") and x not in listed])

    def abort(self, messages: list[Written | None]) -> None:
        self.discard([p for m in messages if m for p in m.parts])


class NpyReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.names, self.listed = options["path"].rstrip("/"), [f.name for f in schema], listing(options["path"])

    def partitions(self) -> list[Part]:
        own = [Part(f"{self.path}/{p['name']}", p["first"], p["rows"], p["sha256"]) for p in self.listed["parts"]]
        return own or [Part("", 0, 0, "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        fs, at = store.opened(partition.path)
        kind, width = np.dtype(self.listed["descr"]), self.listed["shape"][1:]
        start = header(self.listed["descr"], (partition.rows, *width))
        size = kind.itemsize * (width[0] if width else 1)
        sha, pos = hashlib.sha256(), partition.first
        with fs.open_input_stream(at, compression=None) as f:
            sha.update(f.read(len(start)))
            while raw := f.read(max(1, store.PIECE // max(1, size)) * size or 1):
                sha.update(raw)
                values = pa.array(np.frombuffer(raw[: len(raw) // kind.itemsize * kind.itemsize], kind))
                n = len(raw) // size
                if width:
                    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width[0], pa.int32()), values[: n * width[0]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + n)), values[:n]], self.names)
                pos += n
        if sha.hexdigest() != partition.sha256:
            raise IntegrityError(f"{partition.path} was changed")


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        found = listing(self.options["path"])
        kind = next(k for k, v in KINDS.items() if v == found["descr"])
        return f"pos bigint, values array<{kind}>" if len(found["shape"]) > 1 else f"pos bigint, value {kind}"

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), schema, overwrite)


def listing(path: str) -> dict:
    """The list of an array's parts."""
    try:
        return json.loads(store.read_text(f"{path.rstrip('/')}/{LIST}"))
    except (OSError, ValueError) as e:
        raise IntegrityError(f"{path} is not an array: {e}") from e


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(NpySource)


def write(df: DataFrame, path: str, *, rows: int = ROWS, overwrite: bool = False) -> dict:
    """Write (pos, value or values) as an array, in stretches by position; returns the list of its parts."""
    register(df.sparkSession)
    path = store.require_shared(df.sparkSession, path)
    dealt = df.repartitionByRange("pos").sortWithinPartitions("pos")
    dealt.write.format("npy").mode("overwrite" if overwrite else "append").option("rows", rows).save(path)
    return listing(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("npy").load(store.require_shared(spark, path))


def by_step(cube: DataFrame, channel: str) -> DataFrame:
    """(pos, values) of one channel: a row for each step, with its buses in order."""
    each = cube.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("bus", F.col(channel).alias("v")))).alias("s"))
    return each.select(F.col("step").cast("long").alias("pos"), F.transform("s", lambda x: x["v"].cast("float")).alias("values"))
