import json

import pytest

from sightline import cli
from sightline.plans import catalogue, fixture
from sightline.sources import results, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scene"))
    tracks = fixture.tracks(spark, SF)
    tracks.write.parquet(f"{folder}/tracks.parquet")
    fixture.near_misses(spark, tracks).write.parquet(f"{folder}/near.parquet")
    return folder


def run(folder, analysis, *more, near=True):
    out = f"{folder}/out_{analysis}"
    made = cli.main([analysis, "--tracks", f"{folder}/tracks.parquet", *(["--near-misses", f"{folder}/near.parquet"] if near else []), "--out", out, *more])
    assert json.load(open(f"{out}/{analysis}_summary.json")) == json.loads(json.dumps(made))
    return made, out


def test_sweep_then_proximity(spark, scene, capsys):
    made, out = run(scene, "sweep")
    (want,) = catalogue.QUERIES["sweep_summary"](spark, SF).collect()
    assert made["summary"]["n_obs"] == want.n_obs and made["summary"]["int_wide"] == pytest.approx(want.int_wide, abs=1e-6)
    assert set(made["by_approach"]) == {"north", "south", "east", "west"}
    assert "--- by_approach north ---" in capsys.readouterr().out
    records = results.read_records(spark, f"{out}/ego_sweep_results.parquet")
    assert len(records.columns) == 26 and records.count() == want.n_obs
    near, _ = run(scene, "proximity", "--records", f"{out}/ego_sweep_results.parquet", near=False)
    bins = {r.bin_m: r.n_obs for r in catalogue.QUERIES["proximity_bins"](spark, SF).collect()}
    assert {r["bin_m"]: r["n_obs"] for r in near["bins"]} == bins


def test_configurations_and_frames(spark, scene):
    made, out = run(scene, "sensitivity", "--frame-step", "1")
    want = {(r.fov_deg, r.range_m): r.visibility_mean for r in catalogue.QUERIES["fov_range_sensitivity"](spark, SF).collect()}
    assert {(r["fov_deg"], r["range_m"]): pytest.approx(r["visibility_mean"], abs=1e-6) for r in made["table"]} == want
    assert results.read_sensitivity(spark, f"{out}/sensitivity_results.parquet").count() == 20
    _, out = run(scene, "ranges", "--max-frames", "3")
    assert results.read_ranges(spark, f"{out}/range_sensitivity.json").count() == 12


def test_conflicts(spark, scene):
    made, out = run(scene, "near-misses", "--with-pet", "--pet-thresh-s", "2")
    (want,) = catalogue.QUERIES["partner_ttc_summary_120"](spark, SF).collect()
    assert made["ttc"]["fov_120"]["partner_visible_rate"] == pytest.approx(want.partner_visible_rate, abs=1e-6)
    (r,) = results.read_near_miss_rates(spark, f"{out}/near-misses_summary.json").collect()
    assert int(r.ttc_fov_120_n_event_frames) == want.n_event_frames and "fov_360" in made["pet"]


@pytest.mark.parametrize("analysis,near", [("vehicles", False), ("traffic", True), ("occlusion", False), ("confidence", False), ("passing", False), ("following", False)])
def test_other_analyses(scene, analysis, near):
    made, _ = run(scene, analysis, near=near)
    assert made and all(made.values())


def test_vehicles_beside_a_grid_baseline(scene, tmp_path):
    totals = {"frames": 84, "int_wide": 0.4, "nearby": 0.5, "conflict": 0.6, "occluded": 3.0, "out_fov": 4.0, "out_range": 0.5, "total": 11}
    (tmp_path / "grid.json").write_text(json.dumps({"note": "x", "configs": {"120": totals, "360": {}}}))
    made, _ = run(scene, "vehicles", "--baseline", str(tmp_path / "grid.json"), near=False)
    rows = {r["design"]: r for r in made["comparison"]}
    assert set(rows) == {"grid", "vehicle_all", "vehicle_region", "vehicle_region_inbound"}
    assert rows["grid"]["n_obs"] == 84 * 60 and rows["grid"]["int_wide"] == 0.4 and rows["vehicle_all"]["n_obs"] > 0
    made, _ = run(scene, "vehicles", "--fov-deg", "90", "--baseline", str(tmp_path / "grid.json"), near=False)
    assert [r["int_wide"] for r in made["comparison"] if r["design"] == "grid (no 90 degree baseline)"] == [None]


def test_tables_for_a_console():
    assert sinks.table_text([{"name": "a", "n": 12, "x": 0.25}, {"name": "long", "n": 3, "x": None}], "t") == "--- t ---\nname   n      x\na     12  0.250\nlong   3      -"
    assert sinks.table_text([]) == "(no rows)"
