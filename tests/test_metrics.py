"""Metrics, conformal radius, shifts: hand-computed values and every refusal."""

import math

import pytest

from shiftframe.errors import IntegrityError
from shiftframe.operators import conformal, metrics, shifts
from shiftframe.operators import cube as cubes
from shiftframe.schemas import CHANNELS


def pairs(spark, y, p, **more):
    return spark.createDataFrame(list(zip(y, p, *more.values(), strict=True)), ["y", "yhat", *more])


def one(df):
    return df.first()[0]


def test_scalar_metrics(spark):
    df = pairs(spark, [0.0, 2.0], [1.0, 2.0])
    assert one(metrics.mae(df)) == 0.5 and one(metrics.rmse(df)) == math.sqrt(0.5)
    iv = spark.createDataFrame([(0.0, -1.0, 1.0), (2.0, 1.0, 3.0)], "y double, lo double, hi double")
    assert one(metrics.interval_coverage(iv)) == 1 and one(metrics.mean_interval_width(iv)) == 2 and one(metrics.interval_score(iv, 0.1)) == 2
    assert one(metrics.interval_score(spark.createDataFrame([(5.0, 0.0, 1.0)], "y double, lo double, hi double"), 0.5)) == 1 + 4 * 4
    assert one(metrics.pinball_loss(df, 0.9)) == pytest.approx(0.05)
    assert one(metrics.violation_rate(spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "value double"), 1, 3)) == pytest.approx(2 / 3)
    assert metrics.decision_regret(spark.createDataFrame([(3.0, 1.0), (1.0, 1.0)], "cost double, oracle double")).agg({"regret": "sum"}).first()[0] == 2


def test_scalar_metrics_refuse(spark):
    good = pairs(spark, [0.0, 2.0], [1.0, 2.0])
    crossed = spark.createDataFrame([(0.0, 2.0, 1.0)], "y double, lo double, hi double")
    for bad in (
        lambda: metrics.mae(pairs(spark, [0.0, float("nan")], [1.0, 2.0])), lambda: metrics.mae(good.where("y > 9")), lambda: metrics.rmse(pairs(spark, [0.0], [float("inf")])), lambda: metrics.pinball_loss(good, 1.0),
        lambda: metrics.interval_coverage(crossed), lambda: metrics.mean_interval_width(crossed), lambda: metrics.interval_score(crossed, 0.1), lambda: metrics.interval_score(crossed, 0.0),
        lambda: metrics.decision_regret(spark.createDataFrame([(1.0, 2.0)], "cost double, oracle double")), lambda: metrics.violation_rate(spark.createDataFrame([(1.0,)], "value double"), 3, 1),
    ):
        with pytest.raises(ValueError):
            bad()


def forecast(spark, rows):
    return spark.createDataFrame(rows, "baseline string, step long, horizon int, bus long, y double, yhat double").selectExpr("*", "1 AS w")


def test_levels(spark):
    perfect = forecast(spark, [("b", s, s % 2, b, float(s + b), float(s + b)) for s in range(3) for b in range(2)])
    active = spark.createDataFrame([(0, True), (1, True)], "bus long, active boolean")
    assert all(r["mae"] == 0 and r["rmse"] == 0 for r in metrics.levels(perfect, metrics.horizon_step(perfect, ["baseline"]), active, ["baseline"]).collect())
    one_off = forecast(spark, [("b", 0, 0, 0, 1.0, 2.0), ("b", 0, 0, 1, 0.0, 100.0)])
    got = {r["level"]: r for r in metrics.levels(one_off, metrics.horizon_step(one_off, ["baseline"]), spark.createDataFrame([(0, True), (1, False)], "bus long, active boolean"), ["baseline"]).collect()}
    assert got["bus_macro_active"]["mae"] == 1 and got["bus_macro_active"]["active_buses"] == 1
    assert got["system_aggregate"]["mae"] == 101 and got["bus_micro"]["mae"] == 50.5
    with pytest.raises(IntegrityError):
        metrics.levels(one_off, metrics.horizon_step(one_off, ["baseline"]), active.selectExpr("bus", "false AS active"), ["baseline"])


def test_wape_is_null_without_a_target(spark):
    assert metrics.bus_micro(forecast(spark, [("b", 0, 0, 0, 0.0, 1.0)]), ["baseline"]).first()["wape"] is None


def test_probabilistic(spark):
    good = spark.createDataFrame([("m", 1.0, 0.0, 1.0, 2.0), ("m", 2.0, 1.0, 2.0, 3.0)], "g string, y double, q05 double, q50 double, q95 double")
    r = metrics.probabilistic(good, (0.05, 0.5, 0.95), (0.05, 0.95), ["g"]).first()
    assert (r["coverage"], r["width"], r["crossing_rate"]) == (1, 2, 0) and r["abs_coverage_error"] == pytest.approx(0.1)
    turned = good.selectExpr("g", "y", "q95 AS q05", "q50", "q05 AS q95")
    assert metrics.probabilistic(turned, (0.05, 0.5, 0.95), (0.05, 0.95), ["g"]).first()["crossing_rate"] == 1
    for q, i in (((0.5, 0.05), (0.05, 0.5)), ((0.05, 0.5), (0.05, 0.95)), ((), (0.05, 0.95))):
        with pytest.raises(ValueError):
            metrics.probabilistic(good, q, i, ["g"])


def test_conformal(spark):
    df = pairs(spark, [float(i) for i in range(10)], [i - i / 10 for i in range(10)])
    assert conformal.radius(df, 0.2).first()["radius"] == pytest.approx(0.9)
    iv = conformal.interval(pairs(spark, [0.25, 1.5], [0.0, 1.0]), 0.5)
    assert one(conformal.coverage(iv)) == 1
    for bad in (lambda: conformal.radius(df, 0.0), lambda: conformal.interval(df, -1.0), lambda: conformal.radius(df.where("y > 99"), 0.1)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("n", [1, 2, 9, 19, 50])
@pytest.mark.parametrize("alpha", [0.05, 0.1, 0.5])
def test_conformal_radius_is_the_next_order_statistic(spark, n, alpha):
    k = math.ceil((n + 1) * (1 - alpha))
    df = pairs(spark, [float(i // 2) for i in range(n)], [0.0] * n)
    assert conformal.radius(df, alpha).first()["radius"] == sorted(float(i // 2) for i in range(n))[min(k, n - 1)]


def test_sensor_dropout(spark):
    df = spark.range(100).selectExpr("id AS step", "id % 10 AS bus", "CAST(id AS DOUBLE) AS v")
    got = lambda d: sorted((r["step"], r["observed"]) for r in shifts.sensor_dropout(d, "v", 0.25, 7).collect())
    assert got(df) == got(df.repartition(7))
    assert 0 < sum(not o for _, o in got(df)) < 100
    assert shifts.sensor_dropout(df, "v", 1.0).where("observed").count() == 0 and shifts.sensor_dropout(df, "v", 0.0).where("v IS NULL").count() == 0
    for rate, seed in ((1.5, 0), (-0.1, 0), (0.5, -1)):
        with pytest.raises(ValueError):
            shifts.sensor_dropout(df, "v", rate, seed)


def test_scale_der(spark):
    cube = cubes.with_net_demand(spark.createDataFrame([(0, 0, 5.0, 1.0, 2.0, 1.0, 0.5)], "step long, bus long, load_p_mw double, load_q_mvar double, sgen_p_mw double, gen_p_mw double, storage_p_mw double"))
    assert cube.columns[2:] == list(CHANNELS) and cube.first()["net_demand_p_mw"] == 2.5
    r = shifts.scale_der(cube, 2.0).first()
    assert (r["sgen_p_mw"], r["net_demand_p_mw"]) == (4.0, 0.5)
    with pytest.raises(ValueError):
        shifts.scale_der(cube, -1.0)
