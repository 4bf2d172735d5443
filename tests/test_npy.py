"""The .npy data source: round trips, lost attempts, changed bytes, and files that numpy reads."""

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftframe.errors import IntegrityError
from shiftframe.sources import npy, store


def whole(folder):
    return np.concatenate([np.load(folder / p["name"], allow_pickle=False) for p in npy.listing(str(folder))["parts"]])


@pytest.mark.parametrize(("kind", "sql"), [("<f4", "CAST(pos / 7 AS FLOAT)"), ("<f8", "pos / 7D"), ("<i8", "pos * 3"), ("|i1", "CAST(pos % 2 AS TINYINT)")])
def test_columns(spark, tmp_path, kind, sql):
    df = spark.range(1000).selectExpr("id AS pos").selectExpr("pos", f"{sql} AS value").repartition(7)
    listed = npy.write(df, str(tmp_path / "a"), rows=64)
    assert listed["shape"] == [1000] and max(p["rows"] for p in listed["parts"]) == 64
    own = whole(tmp_path / "a")
    assert own.dtype == np.dtype(kind) and own.tolist() == [r["value"] for r in df.orderBy("pos").collect()]
    again = npy.read(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect())) and again.dtypes == df.dtypes


def test_matrices_and_empty_arrays(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("pos"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("id") * 10 + k).cast("float")).alias("values"))
    npy.write(df, str(tmp_path / "m"), rows=50)
    assert whole(tmp_path / "m").tolist() == [[10.0 * i + k for k in range(5)] for i in range(300)]
    assert sorted((r["pos"], list(r["values"])) for r in npy.read(spark, str(tmp_path / "m")).collect()) == [(i, [10.0 * i + k for k in range(5)]) for i in range(300)]
    npy.write(df.where("pos < 0"), str(tmp_path / "none"))
    assert npy.read(spark, str(tmp_path / "none")).count() == 0


def test_large_rows_are_read_in_pieces(spark, tmp_path, monkeypatch):
    df = spark.range(40).select(F.col("id").alias("pos"), F.array_repeat(F.col("id").cast("double"), 9000).alias("values"))
    npy.write(df, str(tmp_path / "w"))
    reader = npy.NpyReader({"path": str(tmp_path / "w")}, T.StructType.fromDDL("pos long, values array<double>"))
    monkeypatch.setattr(store, "PIECE", 100_000)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) == 40 and [b.column(0)[0].as_py() for b in batches] == list(range(40))


@pytest.mark.parametrize("where", ["pos <> 5", "pos <> 0"])
def test_gaps_are_refused_and_leave_nothing(spark, tmp_path, where):
    with pytest.raises(Exception, match="missing, repeated"):
        npy.write(spark.range(20).selectExpr("id AS pos", "id AS value").where(where), str(tmp_path / "g"))
    assert store.names(str(tmp_path / "g")) == []
    with pytest.raises(IntegrityError, match="not an array"):
        npy.listing(str(tmp_path / "g"))


def test_repeats_nulls_and_ragged_rows_are_refused(spark, tmp_path):
    one = spark.range(20).selectExpr("id AS pos", "id AS value")
    for k, bad in enumerate((one.union(one.where("pos = 3")), one.selectExpr("pos", "IF(pos = 3, NULL, value) AS value"), one.selectExpr("pos", "array_repeat(value, CAST(1 + pos % 2 AS INT)) AS values"), one.selectExpr("pos", "CAST(value AS STRING) AS value"))):
        with pytest.raises(Exception, match="repeated|missing values|lengths|no array"):
            npy.write(bad, str(tmp_path / f"b{k}"))
        assert npy.LIST not in store.names(str(tmp_path / f"b{k}"))


def test_existing_arrays_stay_unless_overwritten(spark, tmp_path):
    at = str(tmp_path / "o")
    npy.write(spark.range(30).selectExpr("id AS pos", "id AS value"), at)
    with pytest.raises(Exception, match="already"):
        npy.write(spark.range(5).selectExpr("id AS pos", "id AS value"), at)
    npy.write(spark.range(5).selectExpr("id AS pos", "-id AS value"), at, overwrite=True)
    assert whole(tmp_path / "o").tolist() == [0, -1, -2, -3, -4]
    assert len(store.names(at)) == 1 + len(npy.listing(at)["parts"])


def writer(path, overwrite=False, rows=100):
    return npy.NpyWriter({"path": str(path), "rows": rows}, T.StructType.fromDDL("pos long, value long"), overwrite)


def batch(a, b):
    return pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(range(a, b), pa.int64())], ["pos", "value"])


def test_lost_and_repeated_attempts(tmp_path):
    """Two attempts of one task write; only the one that reported counts, and the other's files go."""
    own = writer(tmp_path)
    own.write(iter([batch(0, 10)]))  # lost before it reported
    a, b = own.write(iter([batch(0, 4), batch(4, 10)])), own.write(iter([batch(10, 12)]))
    assert len(store.names(str(tmp_path))) == 3
    own.commit([b, None, a])
    assert len(store.names(str(tmp_path))) == 3 and whole(tmp_path).tolist() == list(range(12))
    assert [(p["first"], p["rows"]) for p in json.loads((tmp_path / npy.LIST).read_text())["parts"]] == [(0, 10), (10, 2)]


def test_a_failed_task_and_an_aborted_job_leave_no_parts(tmp_path):
    own = writer(tmp_path, rows=3)

    def broken():
        yield batch(0, 10)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        own.write(broken())
    assert store.names(str(tmp_path)) == []
    own.abort([own.write(iter([batch(0, 5)])), None])
    assert store.names(str(tmp_path)) == []


def test_changed_bytes_are_found_while_reading(spark, tmp_path):
    npy.write(spark.range(100).selectExpr("id AS pos", "id AS value"), str(tmp_path / "t"))
    victim = sorted(Path(tmp_path, "t").glob("*.npy"))[0]
    raw = bytearray(victim.read_bytes())
    raw[-1] ^= 1
    victim.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="was changed"):
        npy.read(spark, str(tmp_path / "t")).count()


def test_folders_of_one_machine_are_refused_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return {"spark.checkpoint.dir": "file:///shared/x"}.get(name, default)

    class Session:
        conf = Conf()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    assert store.require_shared(Session(), "/shared/x/a") == "file:///shared/x/a" and store.require_shared(Session(), "s3://b/c/") == "s3://b/c"
    for path in ("/tmp/a", "file:///tmp/a", "/shared/xy"):
        with pytest.raises(IntegrityError, match="one machine"):
            store.require_shared(Session(), path)
