import json
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import config, conflicts, egos, frames, proximity, quantiles, trajectory, visibility, whatif
from sightline.sources import sinks, tables
from sightline.streaming import microbatch


def test_frames_stride_limit_and_even_samples(spark):
    df = spark.createDataFrame([(f,) for f in list(range(0, 9000, 3)) * 2], "frame_idx long")
    assert sorted(r[0] for r in frames.strided(df, 1000).collect()) == [0, 3000, 6000]
    assert sorted(r[0] for r in frames.strided(df, 10, limit=3, first=5, last=500).collect()) == [6, 36, 66]
    n = 3000
    assert sorted(r[0] for r in frames.evenly(df, 7).collect()) == [3 * (i * (n - 1) // 6) for i in range(7)]
    assert [r[0] for r in frames.evenly(df, 1).collect()] == [0]
    assert frames.evenly(df, 5000).count() == n and frames.evenly(df.limit(0), 5).count() == 0


def test_speeds_with_gaps_and_repeated_frames(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 3, 3.0, 0.0), (1, 3, 9.0, 0.0), (2, 0, 0.0, 0.0)]
    df = trajectory.speeds(spark.createDataFrame(rows, "track_id long, frame_idx long, bbox_center_x double, bbox_center_y double"))
    got = [(r.track_id, r.frame_idx, r.speed_mps) for r in df.orderBy("track_id", "frame_idx").collect()]
    assert got[0][2] is None and got[1][2] == pytest.approx(10.0) and got[4][2] is None
    assert sum(s is None for *_, s in got) == 3


def test_class_names(spark):
    df = spark.createDataFrame([("Bike",), ("motorbike",), ("bicycle",), ("CAR",), (None,)], "c string")
    assert [r[0] for r in df.select(tables.normalize_class(F.col("c"))).collect()] == ["bicycle", "motorbicycle", "bicycle", "car", None]


def test_missing_columns_fail(spark):
    with pytest.raises(ValueError, match="missing columns"):
        tables.tracks(spark.createDataFrame([(1,)], "frame_idx long"))


def test_episodes_break_at_gaps(spark):
    df = spark.createDataFrame([(1, f) for f in (1, 2, 3, 5, 6)] + [(2, 3)], "track_id long, frame_idx long")
    assert sorted((r.track_id, r.first_frame, r.n_frames) for r in trajectory.episodes(df).collect()) == [(1, 1, 3), (1, 5, 2), (2, 3, 1)]


def test_frames_without_vehicles(spark):
    obs = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.5, 1, 1, 2), (2, 0.0, 0.0, 0.0, 1.0, 1, 1, 2)], "frame_idx long, ego_x double, ego_y double, ego_heading_deg double, visibility_ratio_onboard double, n_occluded long, n_out_of_fov long, n_objects_total long")
    cars = spark.createDataFrame([(1, "car", 1.5, 1.0), (2, "pedestrian", 0.0, 0.0)], "frame_idx long, class_name string, bbox_center_x double, bbox_center_y double")
    near = proximity.nearest_vehicle(obs, cars)
    assert [(r.frame_idx, r.d_sensor) for r in near.orderBy("frame_idx").collect()] == [(1, 1.0), (2, None)]
    (b,) = proximity.bins(near).collect()
    assert (b.bin_m, b.n_obs, b.pct_obs) == ("[0,1.5)", 1, 50.0)
    by = {r.clearance_m: (r.n_kept, r.int_wide_visibility) for r in proximity.clearance_correction(near).collect()}
    assert by[0.0] == (2, 0.75) and by[4.0] == (1, 1.0)


def test_perspectives_and_partner(spark):
    nm = spark.createDataFrame([(0, 1, 2, "car", "truck"), (0, 1, 3, "car", "bicycle"), (0, 9, 1, "car", "car")], "frame_idx long, track_id_a long, track_id_b long, class_a string, class_b string")
    assert conflicts.perspectives(nm).count() == 5
    rows = [(0, 1, "car", 0.0, 0.0, 4.5, 2.0, 1.6, 0.0, 1.0), (0, 2, "truck", 10.0, 0.0, 8.0, 2.5, 3.0, 0.0, 1.0), (0, 3, "bicycle", -9.0, 0.0, 1.8, 0.6, 1.7, 0.0, 1.0)]
    t = tables.tracks(spark.createDataFrame(rows, tables.TRACKS))
    got = {(r.ego_track_id, r.partner_id): r.reason for r in conflicts.ttc_rows(t, nm).collect()}
    assert got == {(1, 2): "visible", (2, 1): "out_of_fov", (1, 3): "out_of_fov"}
    assert conflicts.ttc_summary(conflicts.ttc_rows(t, nm.limit(0))).collect() == []


def test_confidence_grid_falls_with_either_threshold(spark):
    views = spark.createDataFrame([(s / 100, s % 3 == 0, s % 2 == 0) for s in range(20, 100)] + [(None, True, True)], "score double, v120 boolean, v360 boolean")
    grid = {(r.tau_av, r.tau_rsu): r.cooperative for r in whatif.confidence_grid(views, (0.3, 0.6, 0.9)).collect()}
    assert all(grid[a, b] >= grid[x, y] for a, b in grid for x, y in grid if x >= a and y >= b)
    scores = [(s / 100, s % 2 == 0) for s in range(20, 100)]
    assert grid[0.6, 0.9] == pytest.approx(sum((v and s >= 0.6) or s >= 0.9 for s, v in scores) / 81)


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(120.0, 0.5), (360.0, 0.75)], "fov double, int_wide double")
    sinks.write_json(df, str(tmp_path / "out" / "rows.json"))
    text = (tmp_path / "out" / "rows.json").read_text()
    assert text.endswith("\n") and json.loads(text)[0] == {"fov": 120.0, "int_wide": 0.5}
    assert tables.read_rows_json(spark, str(tmp_path / "out" / "rows.json"), df.schema).count() == 2
    sinks.write_json({"ttc": {"fov_120": {"n": 3}}}, str(tmp_path / "doc.json"))
    assert tables.read_document_json(spark, str(tmp_path / "doc.json"), "ttc.fov_120.n", "pet.none").first()[:] == ("3", None)
    sinks.write_parquet(df, str(tmp_path / "p"), single=True)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from sightline.operators import egos, observe
    from sightline.operators.visibility import classified, visibility
    from sightline.plans import fixture

    scene = fixture.tracks(spark, "/root/testdata/sf0.001").where("frame_idx < 12")
    for lo in (0, 6):
        scene.where(f"frame_idx BETWEEN {lo} AND {lo + 5}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    grid = egos.grid(spark)
    out = str(tmp_path / "out")
    q = microbatch.observe_stream(microbatch.read_tracks_stream(spark, str(tmp_path / "in")), grid, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(out).select("frame_idx", "ego_id", "n_visible_onboard", "n_objects_total")
    want = observe.counts(classified(visibility(scene, grid))).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 720


def test_quantiles_against_numpy(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("a", "b", None)), rng.choice((rng.random(), float(rng.randint(0, 3)), None))) for _ in range(3000)] + [("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("w", -F.col("v"))
    shares = {"q0": 0.0, "q5": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    for direct in (0, 10_000):
        got = quantiles.summarised(df, ["k"], [F.count("v").alias("n")], {"v": shares, "w": {"w10": 0.1}}, direct).collect()
        assert len(got) == 6
        for r in got:
            v = [x for k, x in rows if k == r.k and x is not None]
            assert r.n == len(v)
            for name, q in shares.items():
                assert r[name] == (pytest.approx(np.quantile(v, q), abs=1e-12) if v else None)
            assert r.w10 == (pytest.approx(-np.quantile(v, 0.9), abs=1e-12) if v else None)
        (r,) = quantiles.summarised(df, [], [F.count("*").alias("n")], {"v": {"m": 0.5}}, direct).collect()
        assert r.m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_long_tracks_by_slabs(spark):
    """Speeds and episodes do not depend on the slabs, whatever stands at their borders."""
    rng = random.Random(11)
    rows = [(t, f, rng.random(), rng.random()) for t in range(4) for f in range(-70, 3000) if t == 0 or rng.random() > (0.02, 0.3, 0.9)[t - 1]]
    rows += [r[:2] + (0.5, 0.5) for r in rows[::17]]
    df = spark.createDataFrame(rows, "track_id long, frame_idx long, bbox_center_x double, bbox_center_y double")
    whole, runs = (sorted(map(tuple, x.collect()), key=str) for x in (trajectory.speeds(df), trajectory.episodes(df)))
    assert (0, -70, 3070, pytest.approx(307.0)) in runs and sum(r[2] for r in runs) == len({r[:2] for r in rows})
    for slab in (1, 7, 100, 1024):
        assert sorted(map(tuple, trajectory.speeds(df, slab=slab).collect()), key=str) == whole
        assert sorted(map(tuple, trajectory.episodes(df, slab=slab).collect()), key=str) == runs


def test_crossings_of_parked_and_moving_objects(spark):
    rng = random.Random(3)
    tracks = {t: [(f, rng.uniform(-9, 9), rng.uniform(-9, 9)) for f in range(30)] for t in range(5)}
    tracks |= {10: [(f, 1.0, 1.0) for f in range(4000)], 11: [(f + 7, 2.0, 1.0) for f in range(4000)], 12: [(f, -4.0, 3.99) for f in range(50)], 13: [(f, -4.0, 2.0) for f in range(50)]}
    df = spark.createDataFrame([(t, f, x, y) for t, rows in tracks.items() for f, x, y in rows], "track_id long, frame_idx long, bbox_center_x double, bbox_center_y double")
    pairs = [(a, b) for a in tracks for b in tracks if a != b]
    got = {(r.ego_track_id, r.partner_id): (r.crossing_m, r.ego_frame, r.partner_frame) for r in conflicts.pet_crossings(df, spark.createDataFrame(pairs, "ego_track_id long, partner_id long")).collect()}
    want = {}
    for a, b in pairs:
        u, v = (sorted({(x, y): f for f, x, y in reversed(tracks[t])}.items(), key=lambda p: p[1]) for t in (a, b))
        best = min((((x - z) ** 2 + (y - w) ** 2) ** 0.5, f, g) for (x, y), f in u for (z, w), g in v)
        if best[0] <= 2.0:
            want[a, b] = best
    assert got.keys() == want.keys() and got[10, 11] == (1.0, 0, 7)
    assert all(got[k] == (pytest.approx(want[k][0]), *want[k][1:]) for k in want)


def test_list_form_judges_each_repeated_row(spark):
    rows = [(0, 1, "car", 10.0, 0.0, 4.5, 2.0, 1.6, 0.0, 1.0), (0, 1, "car", 30.0, 0.0, 4.5, 2.0, 1.6, 0.0, 1.0), (0, 2, "truck", 20.0, 0.0, 8.0, 2.5, 3.0, 0.0, 1.0)]
    t = tables.tracks(spark.createDataFrame(rows, tables.TRACKS))
    pose = spark.createDataFrame([(0, "a", 0, 0.0, 0.0, 0.0)], "ego_id int, approach string, pos int, ego_x double, ego_y double, ego_h double")
    seen = lambda **k: sorted((r.track_id, r.x, r.reason) for r in visibility.classified(visibility.visibility(t, pose, **k)).collect())
    assert seen() == [(1, 30.0, "occluded"), (2, 20.0, "occluded")]
    assert seen(repeats=True) == [(1, 10.0, "visible"), (1, 30.0, "occluded"), (2, 20.0, "occluded")]


def test_parameters_and_sizes_are_checked(spark):
    with pytest.raises(ValueError, match="unknown sensor"):
        config.sensor_with({"fov": 1.0})
    many = spark.range(egos.MOST_POSES + 1).select(F.col("id").alias("ego_id"))
    with pytest.raises(ValueError, match="more than"):
        egos.few(many)


def test_frames_split_between_batches(spark, tmp_path):
    """Rows of a frame come in several files, some too late; what is judged is what a batch over the rows in time gives."""
    from sightline.operators import observe
    from sightline.plans import fixture

    rng = random.Random(8)
    rows = fixture.tracks(spark, "/root/testdata/sf0.001").where("frame_idx < 14").collect()
    parts = {n: [] for n in range(6)}
    for r in rows:
        parts[min(5, r.frame_idx // 3 + rng.randint(0, 1))].append(r)
    late = [r for r in rows if r.frame_idx == 0 and r.track_id % 4 == 0]
    parts = {n: [r for r in p if r not in late] + (late if n == 4 else []) for n, p in parts.items()}
    for n, p in parts.items():
        spark.createDataFrame(p, tables.TRACKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    grid, out, kept = egos.grid(spark, positions=2), str(tmp_path / "out"), str(tmp_path / "ck")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}")
    for _ in range(2):  # the second run finds nothing new
        microbatch.observe_stream(microbatch.read_tracks_stream(spark, str(tmp_path / "in")), grid, write, kept, lateness=4).awaitTermination(120)
    columns = ["frame_idx", "ego_id", *observe.COUNTS]
    judged, rest = spark.read.parquet(out).select(*columns), microbatch.flush(spark, grid, kept).select(*columns)
    in_time = spark.createDataFrame([r for r in rows if r not in late], tables.TRACKS)
    want = observe.counts(visibility.classified(visibility.visibility(in_time, grid))).select(*columns)
    got = judged.unionByName(rest)
    assert got.count() == want.count() == 14 * 8 and got.exceptAll(want).count() == 0 and 0 < rest.count() < 14 * 8
    assert microbatch.late_rows(spark, kept) == len(late)


def test_crowded_frames(spark):
    """Bins prepared or not, the blockers are the same; 4,000 objects in a frame are judged in some seconds."""
    rng = random.Random(12)
    kinds = (("car", 4.5, 1.9, 1.6), ("truck", 8.7, 2.6, 3.3), ("pedestrian", 0.7, 0.7, 1.7))

    def crowd(frame, n, wide):
        return [(frame, i, k, rng.choice((rng.uniform(-wide, wide), float(rng.randint(-9, 9)))), rng.uniform(-wide, wide), dx, dy, dz, rng.uniform(-3, 3), 1.0) for i in range(n) for k, dx, dy, dz in (rng.choice(kinds),)]

    grid = egos.grid(spark, positions=1)
    some = tables.tracks(spark.createDataFrame([r for f in range(6) for r in crowd(f, 150, 50)] + crowd(6, 3, 9) + [r for r in crowd(7, 90, 30) for _ in (0, 1)], tables.TRACKS))
    for k in ({"fovs": (60.0, 120.0, 360.0)}, {"fovs": (360.0,), "repeats": True}):
        one, other = (visibility.visibility(some, grid, crowd=n, **k) for n in (0, 10**6))
        assert one.count() == other.count() > 900 and one.exceptAll(other).count() == 0
        assert one.where("blocked").count() > 300
    many = tables.tracks(spark.createDataFrame(crowd(0, 4000, 400), tables.TRACKS))
    began = time.monotonic()
    assert visibility.visibility(many, grid, (360.0,)).where("blocked").count() > 1000
    assert time.monotonic() - began < 60


def test_pairs_within_the_gate_by_cells(spark):
    rng = random.Random(9)
    rows = [(f, t, rng.choice(("car", "truck", "pedestrian")), rng.choice((rng.uniform(-90, 90), 30.0 * rng.randint(-3, 3))), 30.0 * rng.randint(-3, 3), 4.5, 2.0, 1.6, 0.0, 1.0) for f in range(4) for t in range(60)]
    got = sorted(map(tuple, conflicts.pet_candidates(tables.tracks(spark.createDataFrame(rows, tables.TRACKS))).collect()))
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] != "pedestrian" and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 900}
    assert got == sorted(want) and len(got) > 100


def test_stored_frames_are_not_dealt_again(spark, tmp_path):
    from sightline.operators import observe
    from sightline.plans import fixture
    from sightline.sources import layout

    scene, grid = fixture.tracks(spark, "/root/testdata/sf0.001"), egos.grid(spark, positions=2)
    layout.store_frames(scene, str(tmp_path / "frames"), 3)
    assert len(list((tmp_path / "frames").glob("part-*"))) == 3
    stored = layout.stored_frames(spark, str(tmp_path / "frames"), 3)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    got = observe.counts(visibility.classified(visibility.visibility(stored, grid, by_frame=True)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount: 3 out of 3" in plan
    want = observe.counts(visibility.classified(visibility.visibility(scene, grid)))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    # one frame is one bucket's
    assert "SelectedBucketsCount: 1 out of 3" in stored.where("frame_idx = 5").groupBy("frame_idx").count()._jdf.queryExecution().executedPlan().toString()


def test_ordered_files_follow_one_another(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randint(0, 50), rng.choice("abc"), i) for i in range(5000)], "f int, a string, v int").repartition(7)
    sinks.write_ordered(df, str(tmp_path / "o"), ["f", "a"])
    back = spark.read.parquet(str(tmp_path / "o"))
    ranges = sinks.file_ranges(back, ["f", "a"]).collect()
    assert sum(r.n for r in ranges) == 5000 and all(r.after_the_one_before for r in ranges)
    df.write.parquet(str(tmp_path / "mixed"))
    assert not all(r.after_the_one_before for r in sinks.file_ranges(spark.read.parquet(str(tmp_path / "mixed")), ["f", "a"]).collect())


def test_crossings_in_a_crowded_cell(spark):
    """Objects that jitter about one place: every pair against all distances, and 200,000 points each in some seconds."""
    rng = np.random.default_rng(6)
    places = {1: (0.0, 0.0), 2: (0.3, 0.1), 3: (1.9, 0.0), 4: (30.0, 0.0), 5: (-1.2, 1.1)}
    points = {t: np.array(p) + rng.normal(scale=0.15, size=(900 if t < 5 else 5, 2)) for t, p in places.items()}
    make = lambda points: spark.createDataFrame([(t, f, float(x), float(y)) for t, xy in points.items() for f, (x, y) in enumerate(xy)], "track_id long, frame_idx long, bbox_center_x double, bbox_center_y double")
    pairs = spark.createDataFrame([(a, b) for a in places for b in places if a != b], "ego_track_id long, partner_id long")
    for few in (64, 10**9):
        got = {(r.ego_track_id, r.partner_id): (r.crossing_m, r.ego_frame, r.partner_frame) for r in conflicts.pet_crossings(make(points), pairs, few_points=few).collect()}
        for a in places:
            for b in places:
                d = np.hypot(*(points[a][:, None] - points[b][None]).transpose(2, 0, 1))
                i, j = np.unravel_index(d.argmin(), d.shape)
                if a != b and d[i, j] <= 2:
                    assert got.pop((a, b)) == (pytest.approx(d[i, j]), i, j)
        assert not got
    n = 200_000
    many = spark.range(2 * n).selectExpr("id % 2 AS track_id", "id AS frame_idx", "randn(1) * 0.2 + (id % 2) * 0.1 AS bbox_center_x", "randn(2) * 0.2 AS bbox_center_y")
    many.write.parquet(path := tempfile.mkdtemp(prefix="spark-crowd-") + "/p")
    began = time.monotonic()
    (r,) = conflicts.pet_crossings(spark.read.parquet(path), spark.createDataFrame([(0, 1)], "ego_track_id long, partner_id long")).collect()
    assert r.crossing_m < 1e-4 and time.monotonic() - began < 90


def test_short_paths_cross_as_arrays_and_move_once_for_each_pair(spark):
    rng = random.Random(3)
    points = [(f, t, float(rng.randrange(12)), float(rng.randrange(12)) / 2) for t in range(8) for f in range(rng.choice((1, 3, 9, 20)))]
    df = spark.createDataFrame(points, "frame_idx long, track_id long, bbox_center_x double, bbox_center_y double")
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(9) if a != b], "ego_track_id long, partner_id long")
    want = {}
    for a, b in ((a, b) for a in range(8) for b in range(8) if a != b):
        least = min((((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5, p[0], q[0]) for p in points if p[1] == a for q in points if q[1] == b)
        want |= {(a, b): least} if least[0] <= 2.0 else {}
    for few in (64, 9, 2):
        made = conflicts.pet_crossings(df, pairs, few_points=few)
        got = {(r.ego_track_id, r.partner_id): (r.crossing_m, r.ego_frame, r.partner_frame) for r in made.collect()}
        assert got.keys() == want.keys() and all(got[k][1:] == want[k][1:] and abs(got[k][0] - want[k][0]) < 1e-12 for k in want)
    plan = conflicts.pet_crossings(df, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "cax" not in plan
