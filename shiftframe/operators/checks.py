"""Fail-closed checks. Rules are aggregates and anti-joins; each reports its first few offenders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError

EXAMPLES = 5


def not_finite(x: Column) -> Column:
    """NULL, NaN or an infinity."""
    d = x.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))


def none_of(violations: DataFrame, message: str, examples: int = EXAMPLES) -> None:
    """Raise if there is a row; the limit stops the scan early."""
    found = violations.limit(examples).collect()
    if found:
        raise IntegrityError(f"{message}: {[r.asDict() for r in found]}")


def count_rules(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    """How many rows break each rule (a condition that must not hold), in one pass."""
    row = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in rules.items()]).first()
    return row.asDict()


def require(df: DataFrame, rules: dict[str, Column], what: str) -> int:
    """Raise, naming every broken rule; else the number of rows. One aggregate for all rules."""
    counts = count_rules(df, rules)
    broken = {k: v for k, v in counts.items() if k != "_rows" and v}
    if broken:
        first = next(iter(broken))
        examples = [r.asDict() for r in df.where(rules[first]).limit(EXAMPLES).collect()]
        raise IntegrityError(f"{what}: {broken}; such as {examples}")
    return counts["_rows"]


def finite(df: DataFrame, columns: Sequence[str], what: str) -> int:
    return require(df, {f"{x} is not finite": not_finite(F.col(x)) for x in columns}, what)


def missing_keys(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left whose key is absent from right."""
    return left.join(right, on, "left_anti")


def known_keys(left: DataFrame, right: DataFrame, on: str, what: str) -> None:
    none_of(missing_keys(left.select(on).distinct(), right, on), what)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """No key occurs twice."""
    none_of(duplicates(df, keys), what)


def differing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has: left or right."""
    a = left.select(key).distinct().withColumn("_left", F.lit(True))
    b = right.select(key).distinct().withColumn("_right", F.lit(True))
    one = a.join(b, key, "full_outer").where("_left IS NULL OR _right IS NULL")
    return one.select(key, F.when(F.col("_left"), "left").otherwise("right").alias("side"))


def same_keys(left: DataFrame, right: DataFrame, key: str, what: str) -> None:
    """The same set of keys on either side; their order means nothing."""
    none_of(differing_keys(left, right, key), what)


def columns_present(df: DataFrame, required: Iterable[str], what: str) -> None:
    gone = sorted(set(required) - set(df.columns))
    if gone:
        raise IntegrityError(f"{what}: missing columns {gone}")


def ordered_columns(df: DataFrame, expected: Sequence[str], what: str) -> None:
    found = [x for x in df.columns if x in set(expected)]
    if found != list(expected):
        raise IntegrityError(f"{what}: columns are {found}, not {list(expected)}")


def missing_from(required: DataFrame, present: DataFrame) -> DataFrame:
    """EXCEPT on the single column of each."""
    return required.distinct().subtract(present.distinct())


def conserved(elements: DataFrame, buses: DataFrame, value: str, tolerance: float = 1e-10) -> DataFrame:
    """Steps at which the sum over elements differs from that over buses; none should."""
    a = elements.groupBy("step").agg(F.sum(value).alias("by_element"))
    b = buses.groupBy("step").agg(F.sum(value).alias("by_bus"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return a.join(b, "step", "full_outer").where(F.abs(zero("by_element") - zero("by_bus")) > tolerance)


def worst(df: DataFrame, key: str, delta: Column, tolerance: float, what: str) -> float:
    """Largest absolute delta; raise with its key if that is over the tolerance or not a number."""
    bad = F.count_if(not_finite(delta))
    row = df.agg(F.max(F.abs(delta)).alias("most"), F.max_by(F.col(key), F.abs(delta)).alias("where"), bad.alias("bad")).first()
    if row["bad"] or (row["most"] or 0.0) > tolerance:
        raise IntegrityError(f"{what}: {key} {row['where']} is off by {row['most']}; {row['bad']} not finite")
    return row["most"] or 0.0
