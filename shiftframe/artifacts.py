"""Artifacts: fingerprints, the benchmark dataset as .npy arrays with a manifest, and its verification."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .contract import Contract, Split, validate_contract
from .errors import IntegrityError
from .operators import checks, scaling, timeaxis, windows
from .schemas import CALENDAR, CHANNELS, SPLITS
from .sources import files, npy, store

MANIFEST = "manifest.json"
ALGORITHM = "sha256 of sorted per-channel, per-bus sha256 digests"


def series_fingerprint(cube: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(fingerprint, n): a digest of each channel and bus in order of steps, then a digest of these in order.

    A bus's series is one group, as it is for lags; only digests, one per channel and bus, meet in one place.
    """
    long = cube.unpivot(["step", "bus"], list(channels), "channel", "value")
    series = long.groupBy("channel", "bus").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("s"))
    text = F.concat_ws(",", F.transform("s", lambda x: x["value"].cast("string")))
    each = series.select("channel", "bus", F.sha2(text, 256).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("channel", "bus", "x")))
    line = F.transform(ordered, lambda r: F.concat_ws(":", r["channel"], r["bus"].cast("string"), r["x"]))
    return each.agg(F.sha2(F.concat_ws("\n", line), 256).alias("fingerprint"), F.count("*").alias("n"))


def table_fingerprint(df: DataFrame, key: str) -> str:
    """Schema and rows, whatever their order: digests of rows are summed by parts of 32 bits, with their count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(8)]
    got = df.agg(F.count("*").alias("n"), *parts).first()
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema, key=lambda f: f.name))
    return _sha(f"{key}|{schema}|" + "|".join(str(x) for x in got))


def network_fingerprint(tables: dict[str, DataFrame], constants: dict[str, Any] | None = None) -> str:
    return _sha("\n".join([canonical_json(constants or {}), *[table_fingerprint(tables[k], k) for k in sorted(tables)]]))


def _sha(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_json(value: Any, path: str | Path) -> Path:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(canonical_json(value), encoding="utf-8")
    return out


def require_target(spark: SparkSession, folder: str | Path, overwrite: bool) -> str:
    """A folder that may be written: shared, and new, empty or to be overwritten. Of an artifact that is there its manifest
    goes first, then its arrays, so that none of its files is taken for the new one's; other files stay."""
    out = store.require_shared(spark, str(folder))
    found = store.names(out)
    if found and not overwrite:
        raise IntegrityError(f"{out} is not empty")
    if MANIFEST in found:
        store.remove(f"{out}/{MANIFEST}")
    for name in found:
        if name.endswith((".npy", npy.LIST)):
            store.remove(f"{out}/{name}")
    return out


def arrays(cube: DataFrame, axis: DataFrame, split: Split, contract: Contract) -> dict[str, DataFrame]:
    """Every array of an artifact by its path, as (pos, value) or (pos, values)."""
    spark = cube.sparkSession
    buses = cube.select("bus").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("bus")) - 1).cast("long"))  # one row for each bus
    calendar = timeaxis.calendar_table(axis, zone=contract.zone)
    out = {
        "time_utc_ns": axis.select(F.col("step").cast("long").alias("pos"), (F.unix_micros(F.col("t_utc").cast("timestamp")) * 1000).alias("value")),
        "bus_index": buses.select("pos", F.col("bus").cast("long").alias("value")),
        "calendar_features": calendar.select(F.col("step").cast("long").alias("pos"), F.array(*[F.col(x).cast("float") for x in CALENDAR]).alias("values")),
    }
    out |= {f"channels/{x}": npy.by_step(cube, x) for x in CHANNELS}
    for task in contract.tasks:
        plan = windows.plan(spark, split.n_steps, split, task.spec())
        windows.require_audit(plan, split)
        out[f"windows/{task.task_id}"] = _ranked(windows.encode(plan), "origin").select("pos", F.array("split", *windows.COLUMNS[1:]).alias("values"))
    channels = tuple(dict.fromkeys(c for t in contract.tasks for c in t.channels()))
    fitted = scaling.fit(cube, split, channels).join(buses, "bus")
    for x in channels:
        own = fitted.where(F.col("channel") == x)
        out |= {f"scaling/{x}_{n}": own.select("pos", v.alias("value")) for n, v in (("mean", F.col("mean")), ("scale", F.col("scale")), ("constant_mask", F.col("is_constant").cast("tinyint")))}
    return out


def _ranked(rows: DataFrame, by: str, stretch: int = 1 << 16) -> DataFrame:
    """Rows with pos, their place by a whole number: places within a stretch, and the counts of the stretches before, which are few."""
    own = rows.withColumn("_s", F.floor(F.col(by) / stretch))
    counts = own.groupBy("_s").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_s").orderBy(by)) - 1
    return own.withColumn("_p", place).join(before, "_s").withColumn("pos", (F.col("_before") + F.col("_p")).cast("long")).drop("_s", "_p", "_before")


def write_artifact(cube: DataFrame, axis: DataFrame, folder: str | Path, *, contract: Contract | None = None, overwrite: bool = False, split: Split | None = None, rows: int = npy.ROWS) -> str:
    """Time, buses, channels, calendar, window plans and scalers as .npy arrays, with a manifest of every file's size and digest; verified.

    Arrays are written by tasks, in parts (sources.npy). The manifest is written last: a folder without one is not an artifact.
    """
    contract = contract or Contract()
    validate_contract(contract, expected_id=contract.contract_id)
    spark = cube.sparkSession
    out = require_target(spark, folder, overwrite)
    timeaxis.utc_axis(axis)
    split = split or windows.contract_split(axis, contract)
    checks.ordered_columns(cube, CHANNELS, "cube")
    checks.finite(cube, list(CHANNELS), "cube")
    windows.check_dense(cube, split.n_steps)
    listed = {}
    for name, array in arrays(cube, axis, split, contract).items():
        for part in npy.write(array, f"{out}/{name}", rows=rows)["parts"]:
            listed[f"{name}/{part['name']}"] = {"bytes": part["bytes"], "sha256": part["sha256"]}
        listed[f"{name}/{npy.LIST}"] = dict(zip(("bytes", "sha256"), store.digest(f"{out}/{name}/{npy.LIST}"), strict=True))
    fingerprint = series_fingerprint(cube).first()["fingerprint"]
    span = axis.agg(F.min("t_utc").cast("string").alias("start"), F.max("t_utc").cast("string").alias("end_inclusive")).first().asDict()
    manifest = {
        "schema_version": contract.schema_version, "contract": contract.to_dict(), "split": {k: list(v) for k, v in split.ranges().items()}, "fingerprint": fingerprint, "fingerprint_algorithm": ALGORITHM,
        "n_steps": split.n_steps, "time": span | {"timezone": "UTC"}, "channels": list(CHANNELS), "channel_dtype": "float32", "calendar": list(CALENDAR), "window_columns": ["split", *windows.COLUMNS[1:]],
        "split_code": {x: k for k, x in enumerate(SPLITS)}, "files": listed, "spark_version": spark.version,
    }
    store.write_text(f"{out}/{MANIFEST}", canonical_json(manifest))
    verify_artifact(spark, out)
    return out


def verify_artifact(spark: SparkSession, folder: str | Path, expected_version: int = 1) -> dict[str, Any]:
    """The manifest, after every file in it was found with its size and digest. Tasks read the files, in pieces of a megabyte."""
    out = store.require_shared(spark, str(folder))
    try:
        manifest = json.loads(store.read_text(f"{out}/{MANIFEST}"))
    except (OSError, ValueError) as e:
        raise IntegrityError(f"{out}: the manifest cannot be read: {e}") from e
    if manifest.get("schema_version") != expected_version:
        raise IntegrityError(f"{out}: schema version {manifest.get('schema_version')} is not {expected_version}")
    rows = [(k, v["bytes"], v["sha256"]) for k, v in manifest["files"].items()]
    if not rows:
        raise IntegrityError(f"{out}: the manifest lists no files")
    listed = spark.createDataFrame(rows, "name string, bytes long, expected string")
    there = files.digests(spark, out, (".npy", npy.LIST)).select("name", "length", "sha256")
    both = listed.join(there, "name", "full_outer")
    checks.none_of(both.where("sha256 IS NULL").select("name"), f"{out}: files are missing")
    checks.none_of(both.where("expected IS NULL").select("name"), f"{out}: files are not in the manifest")
    checks.none_of(both.where("expected <> sha256 OR bytes <> length").select("name"), f"{out}: files were changed")
    return manifest


def read_cube(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(step, bus, channels) of a written artifact."""
    out = store.require_shared(spark, str(folder))
    buses = npy.read(spark, f"{out}/bus_index").select(F.col("pos").alias("bus_pos"), F.col("value").alias("bus"))
    each = [npy.read(spark, f"{out}/channels/{x}").select(F.col("pos").alias("step"), F.col("values").alias(x)) for x in CHANNELS]
    whole = reduce(lambda a, b: a.join(b, "step"), each)
    flat = whole.select("step", F.posexplode(F.arrays_zip(*CHANNELS)).alias("bus_pos", "v")).select("step", F.col("bus_pos").cast("long").alias("bus_pos"), "v.*")
    return flat.join(F.broadcast(buses), "bus_pos").select("step", "bus", *CHANNELS)  # a row for each bus
