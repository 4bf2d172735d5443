"""Every query against its SQL on the driver's smallest tables."""

import pytest
from oracle import same

from shiftframe.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_matches_sql(spark, name):
    same(q.QUERIES[name], q.SQL[name], spark, SF)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_query_without_sql_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_golden_error_sums(spark):
    rows = q.naive.error_rows(q.events.cube(spark, "/root/testdata/sf0.01"), q.events.SPLIT, "validation", q.SPEC, q.naive.BASELINES, q.NET_P)
    got = {r["baseline"]: (r["e"], r["n"]) for r in rows.groupBy("baseline").agg(q.F.sum(q.F.abs(q.F.col("y") - q.F.col("yhat")) * q.F.col("w")).alias("e"), q.F.sum("w").alias("n")).collect()}
    assert got == {"last_value_v1": (171_821_546, 59_520), "seasonal_24h_v1": (173_027_085, 59_520), "seasonal_7d_v1": (169_862_901, 59_520)}


def test_dropout_keeps_the_golden_number_of_cells(spark):
    assert q.QUERIES["sensor_dropout"](spark, "/root/testdata/sf0.01").agg(q.F.sum("n_observed")).first()[0] == 17_276


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lags_and_rolling_means_share_one_exchange_by_bus(spark):
    cube = spark.range(100).select(q.F.col("id").alias("step"), (q.F.col("id") % 2).alias("bus"), *[q.F.lit(1.0).alias(x) for x in q.CHANNELS])
    text = plan(q.features.origin_frame(cube))
    assert text.count("Exchange hashpartitioning(bus") == 1


def test_scans_read_only_what_a_query_needs(spark):
    text = plan(q.QUERIES["duplicate_keys"](spark, SF))
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(x.split(":")[0] for x in read.split(",")) == ["l_linenumber", "l_orderkey"]


def test_naive_metrics_have_no_cartesian_product_of_windows(spark):
    rows = q.naive.error_rows(q.events.cube(spark, SF), q.events.SPLIT, "validation", q.SPEC, (q.naive.WEEKLY,), q.NET_P)
    assert rows.count() <= 480 * 8
