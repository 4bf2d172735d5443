"""Scans and order statistics over whole series, without one task for a series.

A window without partition, or by one long series, is the work of one task. Here a running sum has two levels: sums of stretches of positions, a running sum of
those, and the carry joined back to the stretches. An order statistic is found by counting: each pass counts the cells of the numbers
that may still be it, which are partial sums in every task, whatever the sizes of groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IntegrityError

#: Positions of a stretch.
STRETCH = 8192
#: Cells of a pass, and the passes of an order statistic: by the exponent, three by cells and one by values.
CELLS, PASSES = 8192, 5
#: Groups up to which what is known of an order statistic (a row for each) goes to all tasks; with more of them rows are joined by a shuffle.
GROUPS = 100_000


def running_sums(rows: DataFrame, by: str, values: Sequence[str], keys: Sequence[str] = (), *, stretch: int = STRETCH, suffix: str = "_sum") -> DataFrame:
    """The rows with the sums of `values` up to and with each row in order of the integer `by` (distinct within keys), as columns value + suffix.

    Missing values count as 0. Sums of integers are exact; those of doubles are rounded once for each stretch and row.
    """
    if stretch < 1 or not values:
        raise IntegrityError("a running sum needs values, and stretches of at least one position")
    own = rows.withColumn("_stretch", F.floor(F.col(by) / stretch))
    total = own.groupBy(*keys, "_stretch").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"_t{k}") for k, x in enumerate(values)])
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    carry = total.select(*[F.col(x).alias(f"_k{j}") for j, x in enumerate(keys)], F.col("_stretch").alias("_s"), *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_c{k}") for k in range(len(values))])
    upto = Window.partitionBy(*keys, "_stretch").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"_w{k}": F.coalesce(F.sum(x).over(upto), F.lit(0)) for k, x in enumerate(values)})
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_k{j}")) for j, x in enumerate(keys)], F.col("_stretch") == F.col("_s"))
    out = own.join(carry, same)
    return out.select(*rows.columns, *[(F.col(f"_c{k}") + F.col(f"_w{k}")).alias(x + suffix) for k, x in enumerate(values)])


def prefix_sums(rows: DataFrame, by: str, value: str, keys: Sequence[str] = (), *, stretch: int = STRETCH) -> DataFrame:
    """(keys, by, prefix): what stands before each position, 0 at the first, and one position more at the end with the whole sum.

    The sum over positions a to b - 1 is the prefix at b less that at a. Positions are 0, 1, ... without gaps.
    """
    summed = running_sums(rows.select(*keys, by, value), by, [value], keys, stretch=stretch)
    first = rows.select(*keys).distinct() if keys else rows.limit(1).select()
    zero = first.select(*keys, F.lit(0).cast(rows.schema[by].dataType).alias(by), F.lit(0).cast(summed.schema[f"{value}_sum"].dataType).alias("prefix"))
    return zero.unionByName(summed.select(*keys, (F.col(by) + 1).alias(by), F.col(f"{value}_sum").alias("prefix")))


def shared_steps(intervals: DataFrame, owner: str, start: str, end: str, *, stretch: int = STRETCH) -> DataFrame:
    """(start, end): the maximal stretches of steps (end inclusive) that lie in intervals of two or more owners, by a sweep over their ends.

    Each interval is one event where it begins and one behind its end; per owner a running sum tells whether a step is covered, and a second one over all
    owners how many cover it. Nothing is expanded to steps, and no pairs of intervals are made. Null ends are ignored, and an interval that ends before it begins is empty.
    """
    own = intervals.where(F.col(owner).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(owner).alias("o"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("z")).where("a <= z")
    events = own.select("o", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct((F.col("z") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).select("o", "e.at", "e.d")
    depth = running_sums(events.groupBy("o", "at").agg(F.sum("d").alias("d")).where("d <> 0"), "at", ["d"], ["o"], stretch=stretch)
    turn = F.when((F.col("d_sum") > 0) & (F.col("d_sum") - F.col("d") == 0), 1).when((F.col("d_sum") == 0) & (F.col("d") < 0), -1)
    covers = depth.select("at", turn.alias("c")).where("c IS NOT NULL").groupBy("at").agg(F.sum("c").alias("c"))
    count = running_sums(covers, "at", ["c"], stretch=stretch).select("at", F.col("c_sum").alias("n"), (F.col("c_sum") - F.col("c")).alias("m"))
    turns = count.where("(n > 1) <> (m > 1)").select("at", (F.col("n") > 1).cast("int").alias("up"))
    numbered = running_sums(turns, "at", ["up"], stretch=stretch)  # a stretch begins where the number rises, and ends at the next turn
    return numbered.groupBy(F.col("up_sum").alias("k")).agg(F.min("at").alias("start"), (F.max("at") - 1).alias("end")).select("start", "end")


def contained_in(rows: DataFrame, first: str, last: str, intervals: DataFrame, *, bucket: int, by: Sequence[str] = ()) -> DataFrame:
    """The rows joined with each interval (start, end exclusive, its other columns) that holds first..last, for any number of intervals.

    An interval is a row for each bucket of positions that it meets, so the join is an equality on the bucket of a row's first position (and on `by`),
    not a comparison of all rows with all intervals. Rows in no interval are absent.
    """
    if bucket < 1:
        raise IntegrityError("a bucket has at least one position")
    cut = intervals.where(F.col("start") < F.col("end")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    own = rows.withColumn("_b", F.floor(F.col(first) / bucket))
    return own.join(cut, [*by, "_b"]).where((F.col(first) >= F.col("start")) & (F.col(last) < F.col("end"))).drop("_b")


def _scaled(rows: DataFrame) -> DataFrame:
    """Finite doubles _x with _r from 1 to 2 (exclusive) and _g, so that |_x| is _r * 2 ** _g; both NULL for 0. Nothing is rounded."""
    size = F.abs("_x")
    own = rows.withColumn("_g", F.when(size > 0, F.floor(F.log2(F.when(size > 0, size)))).cast("int"))
    two = F.lit(2.0)
    scaled = F.when(F.col("_g") < -1000, size * F.pow(two, F.lit(600.0)) / F.pow(two, F.col("_g") + 600)).otherwise(size / F.pow(two, F.col("_g")))
    own = own.withColumn("_r", scaled)  # the logarithm may be off by one
    over, under = F.col("_r") >= 2, F.col("_r") < 1
    return own.withColumns({"_r": F.when(over, F.col("_r") / 2).when(under, F.col("_r") * 2).otherwise(F.col("_r")), "_g": F.when(over, F.col("_g") + 1).when(under, F.col("_g") - 1).otherwise(F.col("_g"))})


def stable_sums(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, n): sums of doubles that are the same bits for any order and partitioning of the rows.

    A double is an integer times a power of two; integers are added exactly for each 32 binary places, in partial sums like any others, and at most
    67 such sums a group meet in a fixed order at the end. A group with a number that is not finite has NaN; nulls don't count.
    """
    x = F.col(value).cast("double")
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.where(x.isNotNull()).select(*keys, F.when(finite, x).otherwise(0.0).alias("_x"), (~finite).alias("_bad"))
    own = _scaled(own).withColumn("_e", F.coalesce(F.col("_g") - 52, F.lit(0)))
    place = F.floor(F.col("_e") / 32).cast("int")
    whole = F.coalesce(F.signum("_x") * F.col("_r") * F.lit(float(1 << 52)), F.lit(0.0)).cast("decimal(17,0)")
    parts = own.select(*keys, "_bad", place.alias("_b"), (whole * F.pow(F.lit(2.0), F.col("_e") - 32 * place).cast("decimal(10,0)")).alias("_m"))
    sums = parts.groupBy(*keys, "_b").agg(F.sum("_m").alias("_s"), F.count("*").alias("_n"), F.bool_or("_bad").alias("_bad"))
    each = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_s")), asc=False).alias("_p"), F.sum("_n").alias("n"), F.bool_or("_bad").alias("_bad"))
    half = lambda b: F.pow(F.lit(2.0), 16 * b)  # noqa: E731  in two steps, as the power itself may be too small for a double
    total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["_s"].cast("double") * half(p["_b"]) * half(p["_b"]))
    return each.select(*keys, F.when(F.col("_bad"), float("nan")).otherwise(total).alias(value), "n")


def _cell(level: int) -> Column:
    """Of the numbers _x from _lo to _hi, a number that never falls as _x rises: for the first pass nearly the exponent, for the last one _x itself."""
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    if level == 0:
        size = F.floor(F.log2(F.abs(x))) + 1100
        return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))
    return x if level == PASSES - 1 else F.floor(F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0) * CELLS)


def kth(rows: DataFrame, value: str, ranks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, k, value): in each group of `keys` the k-th smallest finite value (k from 1), for ranks (keys, k) with one row for each group.

    The first pass counts numbers of about the same exponent. The next three cut what lies between the least and the largest number of the cell that holds the rank into
    `CELLS` equal cells, which leaves some 8,192 different doubles of 2 ** 52 for the last one, which counts each of them: nothing is rounded, as a cell only has to
    keep the order. A pass is partial sums of at most 8,193 counts a group in every task. What is known, a row for each group, goes to the rows and not they to it, so no row is
    shuffled and no task gets a group; beyond `GROUPS` groups Spark chooses the join. Ranks beyond a group's rows are absent.
    """
    x = F.col(value).cast("double")
    own = rows.select(*keys, x.alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x) AND abs(_x) < double('infinity')")
    few = not keys or ranks.limit(GROUPS + 1).count() <= GROUPS
    state = ranks.select(*keys, F.col("k").cast("long").alias("k"), F.col("k").cast("long").alias("_k"))
    for level in range(PASSES):
        known = F.broadcast(state) if few else state
        cells, carried = own, []
        if level:
            carried = ["k", "_k"]  # the same in all rows of a group, so that a pass names the one before it once
            cells = (own.join(known, list(keys)) if keys else own.crossJoin(known)).where("_x >= _lo AND _x <= _hi")
        counts = cells.groupBy(*keys, *carried, _cell(level).alias("_d")).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        counted = counts.withColumn("_u", F.sum("_n").over(upto))
        if not level:
            counted = counted.join(known, list(keys)) if keys else counted.crossJoin(known)  # without keys the state is one row
        found = counted.where((F.col("_u") >= F.col("_k")) & (F.col("_u") - F.col("_n") < F.col("_k")) & (F.col("_k") > 0))
        state = found.select(*keys, "k", (F.col("_k") - F.col("_u") + F.col("_n")).alias("_k"), "_lo", "_hi")
    return state.select(*keys, "k", F.col("_lo").alias(value))
