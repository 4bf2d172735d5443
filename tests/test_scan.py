"""Scans, sweeps, interval joins and order statistics against plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from shiftframe.errors import IntegrityError
from shiftframe.operators import conformal, scan


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(-9, 9) if rng.random() < 0.9 else None) for k in ("a", "b", None) for i in range(rng.randint(1, 60))]
    return rows, spark.createDataFrame(rows, "k string, step long, v long").repartition(5).cache()


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_running_and_prefix_sums(series, stretch):
    rows, df = series
    got = {(r["k"], r["step"]): r["v_sum"] for r in scan.running_sums(df, "step", ["v"], ["k"], stretch=stretch).collect()}
    prefix = {(r["k"], r["step"]): r["prefix"] for r in scan.prefix_sums(df, "step", "v", ["k"], stretch=stretch).collect()}
    for k, own in itertools.groupby(rows, key=lambda r: r[0]):
        total = 0
        assert prefix[k, 0] == 0
        for _, i, v in own:
            total += v or 0
            assert got[k, i] == total and prefix[k, i + 1] == total
    assert len(got) == len(rows) and len(prefix) == len(rows) + 3
    one = df.where("k = 'a'").select("step", "v")
    assert scan.prefix_sums(one, "step", "v", stretch=stretch).count() == one.count() + 1
    assert scan.running_sums(df.where("step < 0"), "step", ["v"]).count() == 0 and scan.prefix_sums(one.where("step < 0"), "step", "v").count() == 0
    with pytest.raises(IntegrityError):
        scan.running_sums(df, "step", [])


@pytest.mark.parametrize("seed", range(4))
def test_shared_steps(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("xyz"), a := rng.randint(0, 200), a + rng.randint(0, 12)) for _ in range(rng.randint(0, 40))] + [(None, 1, 2), ("x", None, 3)]
    covered = {}
    for o, a, z in rows:
        if o and a is not None:
            for t in range(a, z + 1):
                covered.setdefault(t, set()).add(o)
    want = sorted(t for t, o in covered.items() if len(o) > 1)
    df = spark.createDataFrame(rows, "o string, a long, z long").repartition(3)
    got = [(r["start"], r["end"]) for r in scan.shared_steps(df, "o", "a", "z", stretch=9).orderBy("start").collect()]
    assert [t for a, z in got for t in range(a, z + 1)] == want
    assert all(z + 1 < a for (_, z), (a, _) in itertools.pairwise(got))
    assert scan.shared_steps(spark.createDataFrame([("x", 3, 2), ("y", 2, 3)], "o string, a long, z long"), "o", "a", "z").count() == 0


def test_intervals_join_by_bucket(spark):
    rng = random.Random(7)
    folds = [(k, a := rng.randint(0, 500), a + rng.randint(0, 90)) for k in range(300)]
    rows = [(i, a := rng.randint(0, 560), a + rng.randint(0, 10)) for i in range(400)]
    f, r = spark.createDataFrame(folds, "fold long, start long, end long"), spark.createDataFrame(rows, "id long, first long, last long")
    want = sorted((i, k) for i, a, z in rows for k, s, e in folds if a >= s and z < e)
    for bucket in (1, 16, 1000):
        out = scan.contained_in(r, "first", "last", f, bucket=bucket)
        assert sorted((x["id"], x["fold"]) for x in out.collect()) == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def numbers():
    rng = random.Random(4)
    odd = [0.0, -0.0, 1.0, -1.0, 2.0, 2.0**-1074, -(2.0**-1074), 2.0**-1022, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, 0.1, 3.0, math.nextafter(2, 0), math.nextafter(2, 3), math.nextafter(1, 0), 1e-300, -1e300]
    return odd + [rng.gauss(0, 1) * 10 ** rng.randint(-8, 8) for _ in range(80)] + [float(rng.randint(-3, 3)) for _ in range(40)]


def test_order_statistics_are_exact(spark):
    own = numbers()
    rows = [("all", x) for x in own] + [("few", x) for x in own[:5]] + [("none", float("nan")), ("none", None)] + [("hot", 7.0)] * 300
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    for share in (0.5, 0.93):
        ranks = {g: max(1, math.ceil(share * n)) for g, n in (("all", len(own)), ("few", 5), ("hot", 300), ("none", 1))}
        got = {r["g"]: r["x"] for r in scan.kth(df, "x", spark.createDataFrame(list(ranks.items()), "g string, k long"), ["g"]).collect()}
        assert got == {"all": sorted(own)[ranks["all"] - 1], "few": sorted(own[:5])[ranks["few"] - 1], "hot": 7.0}
    for k in (1, len(own)):
        one = scan.kth(df.where("g = 'all'"), "x", spark.createDataFrame([(k,)], "k long")).collect()
        assert [r["x"] for r in one] == [sorted(own)[k - 1]]
    assert scan.kth(df.where("g = 'few'"), "x", spark.createDataFrame([(6,)], "k long")).count() == 0


def test_sums_are_the_same_bits_for_any_partitioning(spark):
    rng = random.Random(8)
    own = [rng.gauss(0, 1) * 10 ** rng.randint(-12, 12) for _ in range(600)] + [0.0, -0.0, 2.0**-1074, -(2.0**-1070), 1e300, -1e300]
    rows = [("a", x) for x in own] + [("b", 0.1)] * 1000 + [("tiny", 2.0**-1074)] * 3 + [("none", None), ("bad", 1.0), ("bad", float("nan")), ("inf", float("inf")), (None, 2.5)]
    seen = set()
    for parts in (1, 7, 211):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
        got = {r["g"]: (r["x"], r["n"]) for r in scan.stable_sums(df, "x", ["g"]).collect()}
        assert math.isnan(got["bad"][0]) and math.isnan(got["inf"][0]) and "none" not in got
        seen.add((got["a"], got["b"], got["tiny"], got[None]))
    assert len(seen) == 1
    a, b, tiny, null = seen.pop()
    assert a == (pytest.approx(math.fsum(own), rel=1e-12), len(own)) and b[0] == pytest.approx(100, rel=1e-15) and tiny[0] == 3 * 2.0**-1074 and null == (2.5, 1)
    assert scan.stable_sums(df.where("g = 'nobody'"), "x", ["g"]).count() == 0


def test_the_radius_has_no_task_with_a_whole_group(spark):
    df = spark.range(5000).select((F.col("id") % 997 / 7).alias("y"), F.lit(0.0).alias("yhat"), F.lit(1).alias("bus"))
    found = conformal.radius(df, 0.1, ["bus"]).first()
    own = sorted(k % 997 / 7 for k in range(5000))
    assert found["radius"] == own[math.ceil(5001 * 0.9)] and found["n"] == 5000 and conformal.radius(df, 0.1).first()["radius"] == found["radius"]
    assert "collect_list" not in conformal.radius(df, 0.1)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [[], ["bus"]])
def test_an_order_statistic_shuffles_counts_and_no_rows(spark, keys):
    rows = spark.range(5000).select((F.col("id") % 3).alias("bus"), (F.col("id") * 7919 % 4999 / 3).alias("x"))
    ranks = spark.createDataFrame([(k, 700) for k in range(3)], "bus long, k long").select(*keys, "k").limit(3 if keys else 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        found = scan.kth(rows, "x", ranks, keys)
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Range (0, 5000") == scan.PASSES  # each pass reads the rows once
    assert "SortMergeJoin" not in text and len(max(text.split("\n"), key=len)) < 2000  # and no filter repeats whole expressions
    own = {k: sorted(i * 7919 % 4999 / 3 for i in range(5000) if not keys or i % 3 == k) for k in range(3)}
    assert sorted(r["x"] for r in found.collect()) == sorted(own[k][699] for k in range(3 if keys else 1))


def test_order_statistics_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(scan, "GROUPS", 2)
    rows = spark.range(900).select((F.col("id") % 9).alias("g"), (F.col("id") * 37 % 101 / 8).alias("x"))
    got = {r["g"]: r["x"] for r in scan.kth(rows, "x", spark.createDataFrame([(g, 10 * g + 1) for g in range(9)], "g long, k long"), ["g"]).collect()}
    assert got == {g: sorted(i * 37 % 101 / 8 for i in range(900) if i % 9 == g)[10 * g] for g in range(9)}


def test_order_statistics_among_neighbours_and_far_apart(spark):
    near = [1.0 + i * 2.0**-52 for i in range(1500)] + [2.0 - i * 2.0**-53 for i in range(1, 700)] + [2.0 + i * 2.0**-51 for i in range(700)]
    tiny = [i * 2.0**-1074 for i in range(-400, 900)]
    far = [s * 2.0**e for e in range(-1074, 1024) for s in (-1.0, 1.0)] + [0.0]
    groups = {"near": near, "tiny": tiny, "far": far}
    rows = spark.createDataFrame([(g, x) for g, own in groups.items() for x in own], "g string, x double").repartition(4).cache()
    for share in (0.001, 0.3, 0.52, 1.0):
        ranks = [(g, math.ceil(share * len(own))) for g, own in groups.items()]
        got = {r["g"]: r["x"] for r in scan.kth(rows, "x", spark.createDataFrame(ranks, "g string, k long"), ["g"]).collect()}
        assert got == {g: sorted(groups[g])[k - 1] for g, k in ranks}
    rows.unpersist()
