"""Splits, windows, contracts, the time axis; shapes as in FIXTURES.md."""

from dataclasses import replace
from datetime import datetime

import pytest

from shiftframe.contract import Contract, Split, Task, WindowSpec, fraction_split, partition_split, split_at, validate_contract
from shiftframe.errors import IntegrityError
from shiftframe.operators import naive, scaling, timeaxis, windows
from shiftframe.operators import features as ft
from shiftframe.plans.benchmark import require_open
from shiftframe.schemas import CALENDAR, FEATURES, NET_P, NET_Q

YEAR = split_at(0, 24572, 29856, 35136)


def ramp(spark, n, buses=(10, 20)):
    f = spark.sql(f"SELECT id AS step, b AS bus, CAST(id * {len(buses)} + i AS FLOAT) AS net_demand_p_mw, CAST(0.1 * (id * {len(buses)} + i) AS FLOAT) AS net_demand_q_mvar FROM range({n}) CROSS JOIN (SELECT posexplode(array{buses}) AS (i, b))")
    return f


def test_fraction_split_bounds_and_errors():
    assert fraction_split(100).ranges() == {"train": (0, 70), "validation": (70, 85), "test": (85, 100)}
    assert fraction_split(35136).validation == (24595, 29865)
    for bad in ({"n": 2}, {"n": 100, "train": 0.9, "validation": 0.1}, {"n": 100, "train": 0.0}):
        with pytest.raises(IntegrityError):
            fraction_split(**bad)
    with pytest.raises(IntegrityError):
        Split((0, 5), (6, 7), (7, 8))


def test_partition_split():
    assert partition_split(100).ranges() == {"train": (0, 60), "validation": (60, 80), "test": (80, 100)}
    with pytest.raises(ValueError):
        partition_split(100, least=30)


@pytest.mark.parametrize(
    ("split", "spec", "want"),
    [
        (YEAR, WindowSpec(96, 16), (24461, 5269, 5265, 30)),
        (YEAR, WindowSpec(672, 96), (23805, 5189, 5185, 190)),
        (fraction_split(35136), WindowSpec(96, 16), (24484, 5255, 5256, 30)),
        (fraction_split(35136), WindowSpec(672, 96), (23828, 5175, 5176, 190)),
    ],
)
def test_golden_window_counts(spark, split, spec, want):
    assert tuple(windows.count_windows(split, spec).values()) == want
    got = {r["split"]: r["n"] for r in windows.counts(windows.plan(spark, split.n_steps, split, spec)).collect()}
    assert tuple(got[k] for k in ("train", "validation", "test", "dropped")) == want


@pytest.mark.parametrize("spec", [WindowSpec(8, 4), WindowSpec(8, 4, 2, 3), WindowSpec(3, 1, 1, 7), WindowSpec(90, 20)])
def test_closed_form_counts_equal_planned_ones(spark, spec):
    split = fraction_split(100)
    got = {r["split"]: r["n"] for r in windows.counts(windows.plan(spark, 100, split, spec)).collect()}
    assert {k: v for k, v in windows.count_windows(split, spec).items() if v} == got


def test_audit_passes_plans_and_catches_leaks(spark):
    split = fraction_split(100)
    own = windows.plan(spark, 100, split, WindowSpec(8, 4))
    assert windows.require_audit(own, split)["passed"]
    leaky = own.selectExpr("split", "history_start", "history_end", "origin", "target_start", "CASE WHEN split = 'train' THEN target_end + 3 ELSE target_end END AS target_end")
    with pytest.raises(IntegrityError, match="leaks"):
        windows.require_audit(leaky, split)
    with pytest.raises(IntegrityError):
        windows.plan(spark, 101, split, WindowSpec(8, 4))
    with pytest.raises(IntegrityError):
        windows.for_split(own, "holdout")


def test_materialised_shapes(spark):
    cube = ramp(spark, 100)
    task = Task("t", "primary", 8, 4, history_channels=(NET_P,), target_channels=(NET_P,))
    own = windows.plan(spark, 100, fraction_split(100), task.spec()).where("origin = 20")
    cal = timeaxis.calendar_table(timeaxis.generated_axis(spark, "2026-01-01 00:00:00", 100))
    rows = windows.materialise(cube, own, task, cal)
    assert rows.where("part = 'history'").count() == 8 * 2 and rows.where("part = 'target'").count() == 4 * 2
    assert set(CALENDAR) <= set(rows.columns)
    one = windows.nested(cube, task, own).where("bus = 10").first()
    assert [x[NET_P] for x in one["history"]] == [2.0 * s for s in range(13, 21)] and [x[NET_P] for x in one["target"]] == [2.0 * s for s in range(21, 25)]
    with pytest.raises(IntegrityError):
        windows.materialise(cube, own, replace(task, target_channels=()))


def test_scaler_does_not_see_the_future(spark):
    split, cube = fraction_split(100), ramp(spark, 100)
    later = cube.selectExpr("step", "bus", "IF(step >= 70, net_demand_p_mw + 1e6, net_demand_p_mw) AS net_demand_p_mw")
    fit = lambda c: sorted(map(tuple, scaling.fit(c, split, [NET_P]).collect()))
    assert fit(cube) == fit(later)
    z = scaling.transform(cube, scaling.fit(cube, split, [NET_P, NET_Q]), [NET_P, NET_Q]).where("step < 70").selectExpr(f"avg({NET_P})", f"stddev_pop({NET_Q})").first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-6
    flat = cube.selectExpr("step", "bus", "1.0F AS net_demand_p_mw")
    assert all(r["is_constant"] and r["scale"] == 1 for r in scaling.fit(flat, split, [NET_P]).collect())
    for bad in (lambda: scaling.fit(cube, split, ["nothing"]), lambda: scaling.transform(cube, scaling.fit(cube.where("bus = 10"), split, [NET_P]), [NET_P])):
        with pytest.raises(IntegrityError):
            bad()


def test_activity_is_strict(spark):
    cube = ramp(spark, 100).selectExpr("step", "bus", "IF(bus = 20, 0F, net_demand_p_mw) AS net_demand_p_mw")
    assert {r["bus"]: r["active"] for r in scaling.activity(cube, fraction_split(100), NET_P).collect()} == {10: True, 20: False}


def test_contract_split_and_rules(spark):
    axis = timeaxis.generated_axis(spark, "2015-12-31 23:00:00", 35136)
    c = Contract()
    assert windows.contract_split(axis, c, c.grid_code) == YEAR
    validate_contract(c)
    with pytest.raises(IntegrityError):
        windows.contract_split(axis, c, "other")
    with pytest.raises(IntegrityError):
        windows.contract_split(axis.where("step < 35000"), c)
    bad = [
        replace(c, contract_id="x"), replace(c, schema_version=2), replace(c, tasks=(c.tasks[0], c.tasks[0])), replace(c, tasks=(c.tasks[1],)),
        replace(c, evaluation=replace(c.evaluation, quantiles=(0.5, 0.05, 0.95))), replace(c, evaluation=replace(c.evaluation, central_quantile=0.4)), replace(c, evaluation=replace(c.evaluation, quantiles=(0.0, 0.05, 0.5, 0.95))),
    ]
    for x in bad:
        with pytest.raises(IntegrityError):
            validate_contract(x)
    plans = windows.contract_plans(spark, YEAR, c, check=False)
    assert plans.where("split IS NOT NULL").count() == 24461 + 5269 + 5265 + 23805 + 5189 + 5185


def profile(spark, times):
    return spark.createDataFrame(list(enumerate(times)), "pos int, time string")


def test_localise_across_daylight_saving(spark):
    autumn = [f"30.10.2016 {t}" for t in ("01:45", "02:00", "02:15", "02:30", "02:45", "02:00", "02:15", "02:30", "02:45", "03:00")]
    got = [r["t_utc"] for r in timeaxis.localise(profile(spark, autumn)).orderBy("pos").collect()]
    assert (got[-1] - got[0]).total_seconds() == 9 * 900
    spring = [f"27.03.2016 {t}" for t in ("01:30", "01:45", "03:00", "03:15")]
    assert timeaxis.localise(profile(spark, spring)).count() == 4
    for bad in (["27.03.2016 01:45", "27.03.2016 02:00"], ["01.01.2016 00:00", "01.01.2016 00:30"], ["2016-01-01 00:00"], ["30.10.2016 02:15", "30.10.2016 02:30"], ["27.03.2016 02:30"], []):
        with pytest.raises(IntegrityError):
            timeaxis.localise(profile(spark, bad) if bad else spark.createDataFrame([], "pos int, time string"))


def test_calendar_on_the_change_of_daylight_saving(spark):
    df = spark.sql("SELECT 0L AS step, TIMESTAMP '2016-10-30 00:00:00' AS t_utc UNION ALL SELECT 1L, TIMESTAMP '2016-10-30 01:00:00'")
    got = timeaxis.calendar_table(df).orderBy("step").collect()
    assert [(r["is_dst"], r["utc_offset_hours"]) for r in got] == [(1.0, 2.0), (0.0, 1.0)]


def test_axis_and_boundaries(spark):
    axis = timeaxis.generated_axis(spark, "2016-01-01 00:00:00", 10)
    timeaxis.utc_axis(axis, 10)
    with pytest.raises(IntegrityError):
        timeaxis.utc_axis(axis.where("step <> 4"))
    end = datetime(2016, 1, 1, 2, 30)
    assert timeaxis.exact_position(axis, end, allow_end=True) == 10
    with pytest.raises(IntegrityError):
        timeaxis.exact_position(axis, end)
    for bad in ("2016-03-27 02:30:00", "2016-10-30 02:30:00", "yesterday"):
        with pytest.raises(IntegrityError):
            timeaxis.boundary_to_utc(spark, bad)


def window(spark, origin, horizon):
    return spark.createDataFrame([(origin, origin + 1, origin + horizon)], "origin long, target_start long, target_end long")


def test_naive_sources(spark):
    cube = ramp(spark, 1000)
    get = lambda b: [r["yhat"] for r in naive.forecasts(cube, window(spark, 700, 4), b, NET_P).where("bus = 10").orderBy("horizon").collect()]
    assert get(naive.LAST_VALUE) == [1400.0] * 4
    assert get(naive.DAILY) == [2.0 * s for s in range(605, 609)]
    assert get(naive.WEEKLY) == [2.0 * s for s in range(29, 33)]
    later = cube.selectExpr("step", "bus", "IF(step > 700, 1e9, net_demand_p_mw) AS net_demand_p_mw")
    assert [r["yhat"] for r in naive.forecasts(later, window(spark, 700, 4), naive.DAILY, NET_P).where("bus = 10").orderBy("horizon").collect()] == get(naive.DAILY)


def test_naive_causality():
    naive.require_causal(naive.DAILY, WindowSpec(672, 96), 672)
    for baseline, spec, first in ((naive.DAILY, WindowSpec(96, 100), 701), (naive.WEEKLY, WindowSpec(96, 16), 96)):
        with pytest.raises(IntegrityError):
            naive.require_causal(baseline, spec, first)


def test_closed_form_equals_exploded_windows(spark):
    split, spec = fraction_split(200), WindowSpec(8, 4)
    cube = ramp(spark, 200).selectExpr("step", "bus", "CAST(pmod(step * 37 + bus, 101) AS DOUBLE) AS net_demand_p_mw")
    daily = naive.Baseline("d", "", "target_lag", 7)
    rows = naive.error_rows(cube, split, "validation", spec, (naive.LAST_VALUE, daily), NET_P)
    own = windows.for_split(windows.plan(spark, 200, split, spec), "validation")
    slow = None
    for b in (naive.LAST_VALUE, daily):
        x = naive.forecasts(cube, own, b, NET_P).selectExpr(f"'{b.baseline_id}' AS baseline", "horizon AS h", "abs(y - yhat) AS e", "1 AS w")
        slow = x if slow is None else slow.union(x)
    want = {(r["baseline"], r["h"]): (r["e"], r["n"]) for r in slow.groupBy("baseline", "h").agg({"e": "sum", "w": "sum"}).toDF("baseline", "h", "a", "b").selectExpr("baseline", "h", "greatest(a, b) AS e", "least(a, b) AS n").collect()}
    fast = naive.by_horizon(rows, split, "validation", spec).selectExpr("baseline", "horizon AS h", "abs(y - yhat) AS e", "w")
    got = {(r["baseline"], r["h"]): (r["e"], r["n"]) for r in fast.groupBy("baseline", "h").agg({"e": "sum", "w": "sum"}).toDF("baseline", "h", "a", "b").selectExpr("baseline", "h", "greatest(a, b) AS e", "least(a, b) AS n").collect()}
    assert got == want


def test_stretches_change_nothing(spark, monkeypatch):
    """Lags and means across the borders of short stretches, of two buses."""
    cube = spark.range(2 * 1800).selectExpr("id div 2 AS step", "id % 2 AS bus", "CAST(pmod(id * 7919, 1009) AS DOUBLE) AS net_demand_p_mw", "CAST(pmod(id * 104729, 997) AS DOUBLE) AS net_demand_q_mvar")
    whole = [sorted(map(tuple, f(cube).collect()), key=repr) for f in (lambda x: ft.origin_frame(x, kind="double"), ft.target_frame)]
    split = fraction_split(1800)
    rows = lambda: sorted(map(tuple, naive.error_rows(cube, split, "validation", WindowSpec(96, 16), naive.BASELINES, (NET_P, "net_demand_q_mvar")).collect()), key=repr)
    errors = rows()
    monkeypatch.setattr(ft, "STRETCH", 700)
    assert [sorted(map(tuple, f(cube).collect()), key=repr) for f in (lambda x: ft.origin_frame(x, kind="double"), ft.target_frame)] == whole
    assert rows() == errors and len(whole[0]) == 3600


def test_seal():
    require_open(("train", "validation"))
    require_open(("test",), unseal=True)
    for bad in (("test",), ("holdout",)):
        with pytest.raises(IntegrityError):
            require_open(bad)


def static(spark, buses=(10, 20)):
    from shiftframe.schemas import STATIC

    return spark.createDataFrame([(b, i, *[0.0] * len(STATIC)) for i, b in enumerate(buses)], "bus long, bus_pos long, " + ", ".join(f"{x} double" for x in STATIC))


def test_feature_matrix_gathers_exactly(spark):
    cube = ramp(spark, 1000)
    cal = spark.range(1000).selectExpr("id AS step", *[f"0D AS {x}" for x in CALENDAR])
    sample = ft.with_windows(ft.exhaustive_rows(spark, 1, 2, 4), 700, WindowSpec(96, 4))
    rows = ft.matrix(cube, sample, static(spark), cal)
    assert ft.check_matrix(rows, 8) == 8
    r = rows.where("bus = 20 AND horizon_step = 3").first()
    v = lambda s: 2.0 * s + 1
    assert (r["origin_p"], r["lag_1h_p"], r["lag_4h_p"], r["lag_24h_p"], r["lag_7d_p"]) == (v(700), v(696), v(684), v(604), v(28))
    assert (r["target_lag_24h_p"], r["target_lag_7d_p"]) == (v(703 - 96), v(703 - 672))
    assert r["mean_4h_p"] == sum(v(s) for s in range(685, 701)) / 16 and r["mean_7d_p"] == sum(v(s) for s in range(29, 701)) / 672
    assert r["trend_4h_p"] == r["origin_p"] - r["mean_4h_p"] and r["bus_pos"] == 1
    early = ft.matrix(cube, ft.with_windows(ft.exhaustive_rows(spark, 1, 2, 4), 100, WindowSpec(96, 4)), static(spark), cal).first()
    assert early["lag_7d_p"] is None and early["mean_7d_p"] is None and early["mean_24h_p"] is not None
    y = ft.target_vector(rows, cube, NET_P).where("bus = 10").orderBy("target_step").collect()
    assert [x["y"] for x in y] == [2.0 * s for s in range(701, 705)]
    assert len(FEATURES) == 41 and len(set(FEATURES)) == 41


def test_features_do_not_see_the_future(spark):
    cal = spark.range(1000).selectExpr("id AS step", *[f"0D AS {x}" for x in CALENDAR])
    sample = ft.with_windows(ft.exhaustive_rows(spark, 1, 2, 4), 700, WindowSpec(96, 4))
    cube = ramp(spark, 1000)
    later = cube.selectExpr("step", "bus", *[f"IF(step > 700, CAST(1e6 AS FLOAT), {x}) AS {x}" for x in (NET_P, NET_Q)])
    get = lambda c: sorted(map(tuple, ft.matrix(c, sample, static(spark), cal).collect()), key=repr)
    assert get(cube) == get(later)


def test_sampler(spark):
    draw = lambda: [tuple(r) for r in ft.sample_rows(spark, 100, 4, 16, max_rows=500, seed=42).orderBy("row_id").collect()]
    a = draw()
    assert a == draw() and len(a) == 500
    assert all(0 <= w < 100 and 0 <= b < 4 and 0 <= h < 16 for _, w, b, h in a)
    assert ft.sample_rows(spark, 2, 2, 2, max_rows=8, seed=0).count() == 8
    with pytest.raises(IntegrityError):
        ft.sample_rows(spark, 2, 2, 2, max_rows=0, seed=0)
    with pytest.raises(IntegrityError):
        ft.audit_causality(Task("t", "primary", 96, 97))
