"""Element tables and profile tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IntegrityError
from ..operators import checks, physics, timeaxis
from ..schemas import ELEMENTS, FAMILIES, OPTIONAL, PROFILED, REQUIRED_FAMILIES, SUFFIX

#: Grids that may be loaded.
GRIDS = ("1-MV-urban--1-no_sw",)


def element_table(spark: SparkSession, source: str | Mapping[str, DataFrame], element: str, fmt: str = "parquet") -> DataFrame:
    """One element table, from a mapping of tables, a folder (<folder>/<element>) or a catalog schema (`schema.`)."""
    if isinstance(source, Mapping):
        df = source.get(element)
        if not isinstance(df, DataFrame):
            raise IntegrityError(f"there is no table of {element}")
    elif source.endswith("."):
        if not spark.catalog.tableExists(source + element):
            raise IntegrityError(f"there is no table {source}{element}")
        df = spark.table(source + element)
    else:
        path = f"{source.rstrip('/')}/{element}"
        df = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(path)
    return conform(df, element)


def conform(df: DataFrame, element: str) -> DataFrame:
    """The columns that the engine reads, with their types; columns that may be missing become NULL."""
    fields = ELEMENTS[element]
    checks.columns_present(df, [x for x in fields if (element, x) not in OPTIONAL], element)
    out = df.select(*[(F.col(x) if x in df.columns else F.lit(None)).cast(kind).alias(x) for x, kind in fields.items()])
    checks.none_of(out.where("element_id IS NULL").limit(1), f"{element}: an element has no id")
    checks.unique(out, ["element_id"], f"{element}: an id occurs twice")
    return out


def absolute_key(key: str | tuple[str, str]) -> tuple[str, str]:
    """(element, column) of a key that is a pair or `element.column`; only the first dot parts."""
    parts = tuple(key.split(".", 1)) if isinstance(key, str) else tuple(key)
    if len(parts) != 2 or not all(isinstance(x, str) and x for x in parts):
        raise IntegrityError(f"{key!r} is not an element and a column")
    return parts


def absolute_key_columns(key: Column) -> list[Column]:
    parts = F.split(key, r"\.", 2)
    return [parts[0].alias("element"), F.try_element_at(parts, F.lit(2)).alias("column")]


def require_keys(present) -> None:
    """Every required element column has a profile."""
    gone = sorted(set(PROFILED) - {absolute_key(k) for k in present})
    if gone:
        raise IntegrityError(f"absolute profiles are missing: {gone}")


def families_of(spark: SparkSession) -> DataFrame:
    """(element, family): which profile families may drive an element."""
    return spark.createDataFrame([(e, f) for e, own in FAMILIES.items() for f in own], "element string, family string")


def require_families(present) -> None:
    gone = sorted(set(REQUIRED_FAMILIES) - set(present))
    if gone:
        raise IntegrityError(f"profile families are missing: {gone}")


def signal_columns(frame: DataFrame) -> list[str]:
    return [x for x in frame.columns if x not in ("pos", "time")]


def numeric_profile(frame: DataFrame, family: str) -> DataFrame:
    """(pos, time, signals DOUBLE): strings that read as numbers are taken, anything else fails with examples."""
    signals = signal_columns(frame)
    made = [(F.col(x) if isinstance(frame.schema[x].dataType, T.NumericType) else F.col(x).cast("string").try_cast("double")).cast("double").alias(x) for x in signals]
    out = frame.select("pos", "time", *made)
    if signals:
        bad = F.array_compact(F.array(*[F.when(checks.not_finite(F.col(x)), F.lit(x)) for x in signals]))
        checks.none_of(out.select("pos", bad.alias("signals")).where(F.size("signals") > 0), f"{family}: values are not finite numbers")
    return out


def long_profile(frame: DataFrame, family: str) -> DataFrame:
    """(family, pos, signal, factor)"""
    signals = signal_columns(frame)
    if not signals:
        return frame.sparkSession.createDataFrame([], "family string, pos long, signal string, factor double")
    return frame.unpivot(["pos"], signals, "signal", "factor").select(F.lit(family).alias("family"), F.col("pos").cast("long").alias("pos"), "signal", "factor")


def group_summary(elements: DataFrame, frame: DataFrame, element: str) -> DataFrame:
    """(element, n_elements, applied, n_signals, available): the profiles in use against those on offer."""
    signals = signal_columns(frame)
    applied = elements.agg(F.count("*").alias("n_elements"), F.array_sort(F.collect_set("profile")).alias("applied"))
    return applied.select(F.lit(element).alias("element"), "n_elements", "applied", F.lit(len(signals)).alias("n_signals"), F.array(*[F.lit(x) for x in sorted(signals)]).alias("available"))


def require_group(elements: DataFrame, frame: DataFrame, element: str) -> None:
    """Profiles in use need signals; a table of times alone is fine if nothing uses it."""
    if not signal_columns(frame) and elements.where("profile IS NOT NULL").take(1):
        raise IntegrityError(f"{element}: profiles are in use, but the family has no signals")


def unmapped(elements: DataFrame, profiles: DataFrame, element: str) -> DataFrame:
    """Elements whose profile has no signal in any of their families."""
    parts = []
    for e, column in PROFILED:
        if e == element:
            own = elements.where("profile IS NOT NULL").select("element_id", F.concat("profile", F.lit(SUFFIX.get((e, column), ""))).alias("signal"))
            parts.append(own.join(profiles.where(F.col("family").isin(*FAMILIES[e])).select("signal").distinct(), "signal", "left_anti"))
    return reduce(DataFrame.unionByName, parts)


def validate_profiles(frames: Mapping[str, DataFrame], tables: Mapping[str, DataFrame], zone: str = timeaxis.ZONE) -> tuple[DataFrame, DataFrame]:
    """(profiles long, axis (pos, t_utc)) after all rules: families, rows, one time axis, numbers, mapping."""
    require_families(frames)
    numeric = {k: numeric_profile(v, k) for k, v in frames.items()}
    axis, axis_time = None, None
    for family, frame in sorted(numeric.items()):
        n = checks.require(frame, {"pos is null": F.col("pos").isNull(), "time is null": F.col("time").isNull()}, family)
        if not n:
            raise IntegrityError(f"{family}: there are no rows")
        checks.unique(frame, ["pos"], f"{family}: a position occurs twice")
        times = frame.select("pos", F.col("time").alias("other"))
        if axis is None:
            axis, axis_time = timeaxis.localise(frame, zone=zone), frame.select("pos", "time")
        else:
            checks.none_of(axis_time.join(times, "pos", "full_outer").where("NOT time <=> other"), f"{family}: the time axis differs")
    profiles = reduce(DataFrame.unionByName, [long_profile(v, k) for k, v in numeric.items()])
    for element in FAMILIES:
        if element in tables:
            for family in FAMILIES[element]:
                if family in numeric and len(FAMILIES[element]) == 1:
                    require_group(tables[element], numeric[family], element)
            checks.none_of(unmapped(tables[element], profiles, element), f"{element}: profiles without a signal")
    return profiles, axis


def load_grid(spark: SparkSession, source: str | Mapping[str, DataFrame], grid_code: str, profiles: Mapping[str, DataFrame], *, grids: tuple[str, ...] = GRIDS) -> dict[str, object]:
    """Tables, repaired transformers with their audit, long profiles and the UTC axis of a grid on the list."""
    if grid_code not in grids:
        raise IntegrityError(f"unknown grid {grid_code!r}; known: {list(grids)}")
    tables = {x: element_table(spark, source, x) for x in ELEMENTS}
    checks.none_of(physics.tap_bounds(tables["trafo"]).select("element_id"), "taps out of bounds")
    long, axis = validate_profiles(profiles, tables)
    tables["trafo"], audit = physics.repair_taps(tables["trafo"])
    sizes = {k: v.count() for k, v in tables.items()}
    return {"tables": tables, "profiles": long, "axis": axis, "repairs": audit, "sizes": sizes}
