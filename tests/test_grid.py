"""Element tables, profiles, cube, physics, artifacts, configuration, provenance, streaming, models."""

import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from shiftframe import artifacts, cli, config, models, provenance
from shiftframe.contract import Contract, Task, split_at
from shiftframe.errors import ConfigError, IntegrityError
from shiftframe.operators import checks, features, physics, snapshots, timeaxis, windows
from shiftframe.operators import cube as cubes
from shiftframe.plans import benchmark
from shiftframe.schemas import CHANNELS, FEATURES, NET_P, STATIC
from shiftframe.sources import files, tables
from shiftframe.streaming import metrics as streaming

ELEMENT = "element_id long, bus long, p_mw double, q_mvar double, profile string"


def axis(spark, n):
    return spark.range(n).selectExpr("id AS pos")


def test_profile_formula(spark):
    load = spark.createDataFrame([(7, 1, 2.0, 0.5, "H0"), (8, 1, 3.0, 0.1, None)], ELEMENT)
    profiles = spark.createDataFrame([("load", 0, "H0_pload", 0.4), ("load", 0, "H0_qload", 0.6)], "family string, pos long, signal string, factor double")
    get = lambda c: {r["element_id"]: round(r["value"], 9) for r in cubes.absolute_profile(load, profiles, axis(spark, 1), "load", c).collect()}
    assert get("p_mw") == {7: 0.8, 8: 3.0} and get("q_mvar") == {7: 0.3, 8: 0.1}
    storage = spark.createDataFrame([(3, 1, -2.0, 0.0, "S")], ELEMENT)
    sp = spark.createDataFrame([("storage", 0, "S", 0.25)], "family string, pos long, signal string, factor double")
    assert cubes.manual_row(storage, sp, "storage", "p_mw", -1).first()["value"] == -0.5


def test_profiles_join_by_position_and_must_be_unambiguous(spark):
    sgen = spark.createDataFrame([(1, 1, 2.0, 0.0, "PV-A")], ELEMENT)
    p = spark.createDataFrame([("renewables", 0, "PV-A", 0.25), ("renewables", 1, "PV-A", 0.75)], "family string, pos long, signal string, factor double")
    got = sorted((r["pos"], r["value"]) for r in cubes.absolute_profile(sgen, p, axis(spark, 2), "sgen", "p_mw").collect())
    assert got == [(0, 0.5), (1, 1.5)]
    both = p.union(spark.createDataFrame([("powerplants", 0, "PV-A", 1.0)], p.schema))
    for bad in (both, p.where("pos < 0")):
        with pytest.raises(IntegrityError):
            cubes.absolute_profile(sgen, bad, axis(spark, 2), "sgen", "p_mw")


def grid(spark):
    t = {
        "bus": spark.createDataFrame([(0, 20.0, True), (1, 20.0, None), (2, 110.0, False)], "element_id long, vn_kv double, in_service boolean"),
        "line": spark.createDataFrame([(0, 0, 1), (1, 1, 1)], "element_id long, from_bus long, to_bus long"),
        "trafo": spark.createDataFrame([(0, 2, 0, -1.0, None, -9.0, 9.0, 1.5, None, "hv", None)], "element_id long, hv_bus long, lv_bus long, tap_pos double, tap_neutral double, tap_min double, tap_max double, tap_step_percent double, tap_step_degree double, tap_side string, tap_changer_type string"),
        "load": spark.createDataFrame([(0, 0, 2.0, 0.5, "H0"), (1, 1, 4.0, 1.0, "H0")], ELEMENT),
        "sgen": spark.createDataFrame([(0, 1, 1.0, 0.0, "PV")], ELEMENT),
        "gen": spark.createDataFrame([(0, 2, 0.5, 0.0, None)], ELEMENT),
        "storage": spark.createDataFrame([(0, 0, -1.0, 0.0, "S")], ELEMENT),
        "ext_grid": spark.createDataFrame([(0, 2)], "element_id long, bus long"),
        "switch": spark.createDataFrame([(0, 2)], "element_id long, bus long"),
    }
    times = [f"01.06.2016 {h:02d}:{m:02d}" for h in range(2) for m in (0, 15, 30, 45)]
    frame = lambda **c: spark.createDataFrame([(i, x, *[str(v[i]) if s else v[i] for s, v in c.values()]) for i, x in enumerate(times)], "pos int, time string" + "".join(f", {k} {'string' if s else 'double'}" for k, (s, _) in c.items()))
    up = [0.1 * i for i in range(8)]
    profiles = {"load": frame(H0_pload=(True, up), H0_qload=(False, [0.5] * 8)), "powerplants": frame(), "renewables": frame(PV=(False, up)), "storage": frame(S=(False, [1.0] * 8))}
    return t, profiles


def loaded(spark):
    t, p = grid(spark)
    return tables.load_grid(spark, t, tables.GRIDS[0], p)


def test_grid_to_cube(spark):
    g = loaded(spark)
    assert g["sizes"]["load"] == 2 and g["repairs"].first()["tap_changer_type"] == "Ratio"
    ax = g["axis"].selectExpr("CAST(pos AS LONG) AS pos")
    bundle = cubes.absolute_bundle(g["tables"], g["profiles"], ax)
    assert max(cubes.verify_formula(bundle, g["tables"], g["profiles"], 3).values()) <= 1e-12
    cube = cubes.build_cube(g["tables"], bundle, ax)
    assert cube.count() == 8 * 3 and cube.schema[NET_P].dataType.simpleString() == "float"
    r = cube.where("step = 4 AND bus = 1").first()
    assert r["load_p_mw"] == pytest.approx(1.6) and r["net_demand_p_mw"] == pytest.approx(1.6 - 0.4) and r["net_demand_q_mvar"] == pytest.approx(0.5)
    element = bundle["load", "p_mw"].selectExpr("pos AS step", "value")
    assert checks.conserved(element, cubes.element_to_bus(bundle["load", "p_mw"], g["tables"]["load"], g["tables"]["bus"].selectExpr("element_id AS bus"), "value"), "value").count() == 0
    with pytest.raises(IntegrityError):
        cubes.element_to_bus(bundle["load", "p_mw"], g["tables"]["load"], g["tables"]["bus"].where("element_id = 0").selectExpr("element_id AS bus"), "x")
    st = {r["bus"]: r for r in features.static_features(g["tables"]).collect()}
    assert (st[0]["line_degree"], st[1]["line_degree"], st[2]["line_degree"], st[2]["trafo_degree"], st[0]["installed_storage_abs_p_mw"]) == (1, 3, 0, 1, 1)


def test_snapshot_assignment_is_exact_and_leaves_the_table(spark):
    load = spark.createDataFrame([(4, 1, 1.0, 0.0, None), (9, 1, 1.0, 0.0, None)], ELEMENT)
    v = spark.createDataFrame([(0, 4, 3.0), (0, 9, 5.0)], "pos long, element_id long, value double")
    assert {r["element_id"]: r["p_mw"] for r in cubes.assign_row(load, v, "p_mw", 0).collect()} == {4: 3.0, 9: 5.0}
    assert load.first()["p_mw"] == 1.0
    with pytest.raises(IntegrityError):
        cubes.assign_row(load, v.where("element_id = 4"), "p_mw", 0)


def flow(losses=0.25, vm=1.0, drop=()):
    """A plain solver: all power meets at one external grid, and one line loses a little."""

    def run(pdf):
        at, rows = int(pdf["position"].iloc[0]), []
        add = lambda result, element, **values: rows.extend((at, result, element, k, float(v)) for k, v in values.items() if result not in drop)
        total = {"p_mw": 0.0, "q_mvar": 0.0}
        for r in pdf.itertuples():
            total[r.name] += r.value * (1 if r.element in ("load", "storage") else -1)
            add(f"res_{r.element}", r.element_id, **{r.name: r.value})
        add("res_ext_grid", 0, p_mw=total["p_mw"] + 0.25, q_mvar=total["q_mvar"] + 0.5)
        add("res_line", 0, pl_mw=losses, ql_mvar=0.5, loading_percent=40 + at)
        add("res_trafo", 0, p_from_mw=3.0, p_to_mw=-3.0, loading_percent=10)
        add("res_bus", 0, vm_pu=vm, p_mw=-0.25, q_mvar=-0.5)
        add("res_bus", 1, vm_pu=1.01, p_mw=0, q_mvar=0)
        return pd.DataFrame(rows, columns=["position", "result", "element_id", "name", "value"])

    return run


def test_snapshots(spark):
    t, p = grid(spark)
    g = loaded(spark)
    g = g | {"profiles": g["profiles"].checkpoint(), "axis": g["axis"].checkpoint(), "tables": t}  # short plans
    bundle = {k: v.checkpoint() for k, v in cubes.absolute_bundle(g["tables"], g["profiles"], g["axis"]).items()}
    at = spark.createDataFrame([(2,), (-1,), (2,)], "position long")
    results, rows = snapshots.reconstruct("g", g, p["load"], at, flow(), bundle=bundle)
    got = {r["position"]: r.asDict() for r in rows.collect()}
    assert set(got) == {2, 7}
    assert (got[7]["local_time"], got[7]["utc_time"], got[7]["converged"], got[7]["grid_code"]) == ("01.06.2016 01:45", "2016-05-31T23:45:00+00:00", True, "g")
    r = got[2]
    assert r["total_load_p_mw"] == pytest.approx(6 * 0.2) and r["total_load_q_mvar"] == pytest.approx(0.75) and r["total_storage_p_mw"] == -1.0 and r["total_gen_p_mw"] == 0.5
    assert (r["min_vm_pu"], r["max_vm_pu"], r["max_line_loading_percent"], r["max_trafo_loading_percent"]) == (1.0, 1.01, 42.0, 10.0)
    assert (r["active_branch_loss_mw"], r["reactive_branch_loss_mvar"], r["active_balance_residual_mw"], r["reactive_balance_residual_mvar"]) == (0.25, 0.5, 0.0, 0.0)
    assert len(rows.columns) == 20 and results.where("result = 'res_load' AND name = 'p_mw' AND position = 2").count() == 2
    wrong = bundle | {("load", "p_mw"): bundle["load", "p_mw"].withColumn("value", bundle["load", "p_mw"]["value"] + 1e-9)}
    with pytest.raises(IntegrityError):
        snapshots.reconstruct("g", g, p["load"], at, flow(), bundle=wrong)
    for bad in ([(8,)], [(-9,)], []):
        with pytest.raises(IntegrityError):
            snapshots.reconstruct("g", g, p["load"], spark.createDataFrame(bad, "position long"), flow(), bundle=bundle)


def test_snapshots_must_be_sound(spark):
    at = spark.createDataFrame([(2,)], "position long")
    power = pd.DataFrame([(2, "load", 0, 0, "p_mw", 1.0)], columns=["position", "element", "element_id", "bus", "name", "value"])
    for solver, good in ((flow(), True), (flow(losses=0.3), False), (flow(vm=0.4), False), (flow(vm=float("nan")), False), (flow(drop=("res_bus",)), False)):
        results = spark.createDataFrame(solver(power), snapshots.RESULTS)
        if good:
            snapshots.require_sound(results, snapshots.summary(results), at)
            continue
        with pytest.raises(IntegrityError):
            snapshots.require_sound(results, snapshots.summary(results), at)


def test_profile_validation_refuses(spark):
    t, p = grid(spark)
    cases = [
        ({k: v for k, v in p.items() if k != "storage"}, t),
        (p | {"load": p["load"].withColumn("H0_pload", p["load"]["time"])}, t),
        (p | {"load": p["load"].where("pos < 5")}, t),
        (p | {"renewables": p["renewables"].drop("PV")}, t),
        (p | {"storage": p["storage"].drop("S")}, t),
        (p | {"load": p["load"].union(p["load"].where("pos = 1"))}, t),
    ]
    for frames, own in cases:
        with pytest.raises(IntegrityError):
            tables.validate_profiles(frames, own)
    with pytest.raises(IntegrityError):
        tables.load_grid(spark, t, "another grid", p)
    with pytest.raises(IntegrityError):
        tables.element_table(spark, t, "trafo3w") if "trafo3w" in t else tables.element_table(spark, {}, "bus")
    row = tables.group_summary(t["load"], p["load"], "load").first()
    assert (row["n_elements"], row["applied"], row["n_signals"]) == (2, ["H0"], 2)


def test_keys():
    assert tables.absolute_key("load.p_mw.x") == ("load", "p_mw.x") and tables.absolute_key(("load", "p_mw")) == ("load", "p_mw")
    for bad in ("load", ("load",), ""):
        with pytest.raises(IntegrityError):
            tables.absolute_key(bad)
    with pytest.raises(IntegrityError):
        tables.require_keys(["load.p_mw"])


def trafo(spark, *rows):
    cols = "element_id long, tap_pos double, tap_neutral double, tap_min double, tap_max double, tap_step_percent double, tap_step_degree double, tap_side string, tap_changer_type string"
    return spark.createDataFrame(list(rows), cols)


def test_taps(spark):
    t = trafo(spark, (1, -1.0, 0.0, -9.0, 9.0, 1.5, 0.0, "hv", None), (2, 1.0, None, None, 9.0, 1.5, 90.0, "hv", None), (3, 1.0, 0.0, -9.0, 9.0, 1.5, 0.0, "hv", "Tabular"), (4, None, 0.0, None, None, None, None, "hv", None))
    fixed, audit = physics.repair_taps(t)
    assert {r["element_id"]: r["tap_changer_type"] for r in fixed.collect()} == {1: "Ratio", 2: "Symmetrical", 3: "Tabular", 4: None}
    assert audit.count() == 2 and physics.tap_bounds(t).count() == 0
    assert physics.tap_bounds(trafo(spark, (1, 10.0, 0.0, -9.0, 9.0, 1.5, 0.0, "hv", None))).count() == 1
    with pytest.raises(IntegrityError):
        physics.repair_taps(trafo(spark, (1, 1.0, 0.0, -9.0, 9.0, 0.0, 30.0, "hv", None)))
    res = lambda *v: spark.createDataFrame(list(enumerate(v)), "element_id long, vm_pu double")
    delta = physics.voltage_delta(res(1.0, 0.97), res(1.0, 0.99))
    assert delta.first()["max_abs_delta"] == pytest.approx(0.02)
    physics.require_tap_response(audit, delta)
    with pytest.raises(IntegrityError):
        physics.require_tap_response(audit, physics.voltage_delta(res(1.0), res(1.0)))
    bus = spark.createDataFrame([(0, True), (1, None), (2, False)], "element_id long, in_service boolean")
    assert tuple(physics.voltage_summary(res(1.0, 0.9, 0.1), bus).first()) == (0.9, 1.0)
    physics.require_voltages(res(1.0, 0.9))
    for bad in (lambda: physics.require_voltages(res(0.4)), lambda: physics.require_balance(1.0, 0.5, 0.4)):
        with pytest.raises(IntegrityError):
            bad()
    assert physics.require_balance(1.0, 0.5, 0.5) == 0


def test_results_and_peaks(spark):
    line = spark.createDataFrame([(0.1,), (0.2,)], "pl_mw double")
    trafo_ = spark.createDataFrame([(3.0, -2.9)], "p_hv_mw double, p_lv_mw double")
    got = {r["branch"]: round(r["loss"], 9) for r in physics.branch_loss({"line": line, "trafo": trafo_, "impedance": line.where("pl_mw > 9")}).collect()}
    assert got == {"line": 0.3, "trafo": 0.1, "impedance": 0.0}
    assert physics.safe_sum(None, "x") == 0 and physics.safe_sum(line, "nope") == 0 and physics.safe_max(line, "pl_mw") == 0.2
    with pytest.raises(IntegrityError):
        physics.safe_sum(spark.createDataFrame([(float("nan"),)], "x double"), "x")
    ties = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "pos long, value double")
    assert physics.peak_step(ties).first()["pos"] == 1 and physics.peak_step(ties.where("pos > 9")).count() == 0
    year = timeaxis.generated_axis(spark, "2015-12-31 23:00:00", 35136).withColumnRenamed("step", "pos")
    got = [r["pos"] for r in physics.validation_positions(year, ties, ties).collect()]
    assert got == sorted({0, 1, 8784, 17568, 26352, 35135, 8263, 8264, 29095, 29096})
    double = lambda pdf: pd.DataFrame({"position": pdf["position"], "vm_pu": pdf["p"] * 2})
    assert physics.solve(spark.createDataFrame([(0, 1.0), (1, 2.0)], "position long, p double"), double, "position long, vm_pu double").agg({"vm_pu": "sum"}).first()[0] == 6


def small_cube(spark, n=400):
    c = spark.range(n).selectExpr("id AS step").crossJoin(spark.range(2).selectExpr("id AS bus"))
    base = c.selectExpr("step", "bus", "CAST(pmod(step * 7 + bus, 13) AS DOUBLE) AS load_p_mw", "1D AS load_q_mvar", "CAST(pmod(step, 5) AS DOUBLE) AS sgen_p_mw", "0D AS gen_p_mw", "0D AS storage_p_mw")
    return cubes.with_net_demand(base)


SMALL = Contract(tasks=(Task("t", "primary", 8, 4),))


def test_artifact_round_trip_and_tampering(spark, tmp_path):
    cube, split, out = small_cube(spark), split_at(0, 250, 325, 400), tmp_path / "a"
    ax = timeaxis.generated_axis(spark, "2016-01-01 00:00:00", 400)
    out.mkdir()
    artifacts.write_artifact(cube, ax, out, contract=SMALL, split=split)
    manifest = artifacts.verify_artifact(spark, out)
    again = artifacts.read_cube(spark, out)
    assert artifacts.series_fingerprint(again).first()["fingerprint"] == manifest["fingerprint"] and manifest["channels"] == list(CHANNELS)
    counts = windows.count_windows(split, SMALL.tasks[0].spec())
    plan = np.concatenate([np.load(x, allow_pickle=False) for x in sorted(Path(out, "windows/t").glob("*.npy"))])
    assert plan.shape == (sum(v for k, v in counts.items() if k != "dropped"), 6) and plan.dtype == np.int64 and np.all(np.diff(plan[:, 3]) > 0)
    for x in CHANNELS:
        whole = np.concatenate([np.load(f, allow_pickle=False) for f in sorted(Path(out, "channels", x).glob("*.npy"))])
        assert whole.shape == (400, 2) and whole.dtype == np.float32
    with pytest.raises(IntegrityError):
        artifacts.write_artifact(cube, ax, out, contract=SMALL, split=split)
    victim = next(iter(sorted(Path(out, "channels").rglob("*.npy"))))
    raw = bytearray(victim.read_bytes())
    raw[-3] ^= 1
    victim.write_bytes(bytes(raw))
    with pytest.raises(IntegrityError, match="changed"):
        artifacts.verify_artifact(spark, out)
    extra = victim.with_name("part-9.npy")
    extra.write_bytes(b"x")
    with pytest.raises(IntegrityError, match="not in the manifest"):
        artifacts.verify_artifact(spark, out)
    victim.unlink()
    with pytest.raises(IntegrityError, match="missing"):
        artifacts.verify_artifact(spark, out)
    (out / "manifest.json").unlink()
    with pytest.raises(IntegrityError):
        artifacts.verify_artifact(spark, out)


def test_artifact_refuses_bad_cubes(spark, tmp_path):
    ax = timeaxis.generated_axis(spark, "2016-01-01 00:00:00", 400)
    split, cube = split_at(0, 250, 325, 400), small_cube(spark)
    for bad in (cube.where("step <> 9 OR bus <> 1"), cube.withColumn("gen_p_mw", cube["gen_p_mw"] + float("nan")), cube.select("step", "bus", *reversed(CHANNELS))):
        with pytest.raises(IntegrityError):
            artifacts.write_artifact(bad, ax, tmp_path / "b", contract=SMALL, split=split)


def test_fingerprints(spark):
    cube = small_cube(spark, 40)
    f = lambda c: artifacts.series_fingerprint(c).first()[0]
    assert f(cube) == f(cube.repartition(5)) != f(cube.withColumn("gen_p_mw", cube["gen_p_mw"] + (cube["step"] == 3).cast("float")))
    t = {"bus": spark.createDataFrame([(0, 1.0), (1, None)], "element_id long, vn_kv double")}
    assert artifacts.network_fingerprint(t) == artifacts.network_fingerprint({"bus": t["bus"].repartition(3)}) != artifacts.network_fingerprint({"bus": t["bus"].where("element_id = 0")})


def test_file_digests(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc" * 10)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y.txt").write_bytes(b"")
    found = {r["name"]: r for r in files.digests(spark, f"file://{tmp_path}").collect()}
    assert set(found) == {"x.bin", "sub/y.txt"} and files.digests(spark, f"file://{tmp_path}", ".txt").first()["length"] == 0
    r = found["x.bin"]
    assert (r["name"], r["length"], r["sha256"]) == ("x.bin", 30, files.sha256_file(tmp_path / "x.bin"))


def experiment(tmp_path, **change):
    data = {"dataset": "d", "grids": ["g"], "resolution_minutes": 60, "train_fraction": 0.6, "val_fraction": 0.2, "test_fraction": 0.2, "seed": 1} | change
    (tmp_path / "data.json").write_text(json.dumps(data))
    (tmp_path / "exp.yaml").write_text("# an experiment\nexperiment: e\ndata_config: data.json\nmodels: [a, b]\nshifts:\n  - s\nseeds: [1, 2]\nmetrics: [mae]\n")
    return tmp_path / "exp.yaml"


def test_config(tmp_path):
    e, d = config.load_experiment(experiment(tmp_path), tmp_path)
    assert (e.models, e.shifts, e.seeds, d.grids, d.train_fraction) == (("a", "b"), ("s",), (1, 2), ("g",), 0.6)
    for change in ({"train_fraction": 0.7}, {"grids": []}, {"resolution_minutes": 7}, {"seed": -1}, {"dataset": " "}, {"train_fraction": "x"}):
        with pytest.raises(ConfigError):
            config.load_experiment(experiment(tmp_path, **change), tmp_path)
    with pytest.raises(ConfigError):
        config.read_mapping(tmp_path / "nothing")
    for raw in ({"models": ["a", "a"]}, {"models": []}, {"seeds": [1, 1]}, {"seeds": [-1]}, {"shifts": ["s", "s"]}, {"experiment": ""}):
        with pytest.raises(ConfigError):
            config.ExperimentConfig.of({"experiment": "e", "data_config": "x", "models": ["a"], "seeds": [1], "metrics": ["m"]} | raw, tmp_path)


def test_cli_and_provenance(tmp_path, capsys):
    exp = str(experiment(tmp_path))
    assert cli.main(["validate-config", exp, "--repo-root", str(tmp_path)]) == 0 and "\"experiment\": \"e\"" in capsys.readouterr().out
    assert cli.main(["self-check", exp, "--repo-root", str(tmp_path), "--output", str(tmp_path / "o")]) == 0
    m = json.loads((tmp_path / "o/run_manifest.json").read_text())
    assert m["git_commit"] is None and m["git_dirty"] is None and m["seed"] == 42 and len(m["config_sha256"]) == 64
    assert cli.main(["validate-config", str(tmp_path / "none"), "--repo-root", str(tmp_path)]) == 1
    path, digest = provenance.write_results({"b": 1, "a": None}, tmp_path / "r.json")
    assert path.read_text() == '{\n  "a": null,\n  "b": 1\n}\n' and digest == files.sha256_file(path)


def test_naive_benchmark_plan(spark):
    rows = benchmark.naive_benchmark(small_cube(spark), split_at(0, 250, 325, 400), SMALL.tasks, baselines=(benchmark.naive.LAST_VALUE,))
    got = {(r["channel"], r["level"]) for r in rows.collect()}
    assert len(got) == 8 and benchmark.report(rows)[0].startswith("t validation net_demand_p_mw last_value_v1: MAE")
    with pytest.raises(IntegrityError):
        benchmark.naive_benchmark(small_cube(spark), split_at(0, 250, 325, 400), SMALL.tasks, splits=("test",))


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 3 AS horizon", "CAST(id AS DOUBLE) AS y", "CAST(id % 7 AS DOUBLE) AS yhat")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streaming.run_once(streaming.running_metrics(stream, ["horizon"]), "running", "complete")
    from shiftframe.operators import metrics

    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, metrics.bus_micro(rows, ["horizon"]).collect()))
    ev = spark.sql("SELECT timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP '2024-01-01') AS ts, id % 2 AS bus, 'view' AS event_type, id AS cents FROM range(120)")
    ev.write.parquet(str(tmp_path / "ev"))
    streaming.run_once(streaming.step_sums(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), late="0 minutes"), "steps", "append", str(tmp_path / "cp"))
    assert spark.table("steps").where("start = TIMESTAMP '2024-01-01 00:00:00' AND bus = 0").first()["total"] == sum(range(0, 15, 2))


def test_models(spark, tmp_path):
    split = split_at(0, 900, 1050, 1200)
    cube = small_cube(spark, 1200)
    contract = Contract(tasks=(Task("t", "primary", 8, 4),))
    st = spark.createDataFrame([(b, b, *[0.0] * len(STATIC)) for b in (0, 1)], "bus long, bus_pos long, " + ", ".join(f"{x} double" for x in STATIC))
    cal = timeaxis.calendar_table(timeaxis.generated_axis(spark, "2016-01-01 00:00:00", 1200))
    settings = models.Config(trees=2, max_rows=400, min_rows=5, max_bins=16, leaves=6)
    bundle = models.fit(cube, split, st, cal, contract=contract, config=settings, quantiles=(0.5,), channels=(NET_P,), fingerprint="f")
    assert bundle.nodes.where("feature < 0").groupBy("alpha", "tree").count().where("count > 6").count() == 0 and bundle.nodes.select("alpha", "tree").distinct().count() == 4
    rows = models.predict(bundle, cube, split, st, cal, contract=contract, max_windows=5)
    assert rows.count() == 5 * 2 * 4 and rows.where("yhat IS NULL OR q50 IS NULL").count() == 0
    assert {r["level"] for r in models.evaluate(rows, cube, split, NET_P).collect()} == {"bus_micro", "bus_macro_active", "system_aggregate", "horizon_step"}
    shares = models.importances(bundle, NET_P)
    assert len(shares) == len(FEATURES) and sum(v for _, v in shares) == pytest.approx(1)
    saved = models.save(bundle, f"file://{tmp_path}/m")
    assert saved[1].endswith("net_demand_p_mw__q0p50")
    again = models.load(spark, f"file://{tmp_path}/m")
    other = models.predict(again, cube, split, st, cal, contract=contract, max_windows=5)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "m2").mkdir()
    spark.createDataFrame([('{"engine": "0.1"}',)], "value string").write.mode("overwrite").text(f"file://{tmp_path}/m2/bundle")
    with pytest.raises(IntegrityError):
        models.load(spark, f"file://{tmp_path}/m2")
    models.require_compatible(bundle, contract, "f")
    for bad in (lambda: models.require_compatible(bundle, contract, "g"), lambda: models.predict(bundle, cube, split, st, cal, contract=contract, name="test"), lambda: models.predict(bundle, cube, split, st, cal, contract=contract, max_windows=0)):
        with pytest.raises(IntegrityError):
            bad()


def test_nested_configuration(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a:\n  b: [1, 2]\n  c: {d: x}\ntext: |\n  one\n  two\n")
    assert config.read_mapping(tmp_path / "c.yaml") == {"a": {"b": [1, 2], "c": {"d": "x"}}, "text": "one\ntwo\n"}
    (tmp_path / "c.yaml").write_text("a: [1")
    with pytest.raises(ConfigError):
        config.read_mapping(tmp_path / "c.yaml")
    assert config.parse("a: [1, 2]\nb:\n- x\n- y\n") == {"a": [1, 2], "b": ["x", "y"]}


def test_overwriting_leaves_no_old_arrays(spark, tmp_path):
    (tmp_path / "cube").mkdir()
    for name in ("cube/part-0.npy", "manifest.json", "notes.txt"):
        (tmp_path / name).write_text("x")
    with pytest.raises(IntegrityError):
        artifacts.require_target(spark, tmp_path, overwrite=False)
    artifacts.require_target(spark, tmp_path, overwrite=True)
    assert sorted(x.name for x in tmp_path.rglob("*") if x.is_file()) == ["notes.txt"]
    assert Contract().to_dict()["split_policy"] and Contract().evaluation.notes
