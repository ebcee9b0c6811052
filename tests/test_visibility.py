import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import config as c
from sightline.operators import egos, observe
from sightline.operators import visibility as vis
from sightline.sources.tables import tracks

COLUMNS = ["frame_idx", "track_id", "class_name", "bbox_center_x", "bbox_center_y", "bbox_dx", "bbox_dy", "bbox_yaw"]
EGO = "ego_id int, approach string, pos int, ego_x double, ego_y double, ego_h double"


def scene(spark, rows, frame=0):
    full = [(frame, i, kind, float(x), float(y), float(dx), float(dy), float(yaw)) for i, kind, x, y, dx, dy, yaw in (r if len(r) == 7 else (r[0], "car", r[1], r[2], 4.5, 2.0, 0.0) for r in rows)]
    return tracks(spark.createDataFrame(full, COLUMNS))


def look(spark, rows, pose=(0.0, 0.0, 0.0), fov=120.0, sensor=None):
    sensor = sensor or c.SENSOR
    ego = spark.createDataFrame([(0, "a", 0, *map(float, pose))], EGO)
    seen = vis.classified(vis.visibility(scene(spark, rows), ego, (fov,), sensor), sensor["range_m"], sensor["near_blind_m"])
    return {r.track_id: (r.reason, r.occluded_by) for r in seen.collect()}


def test_ahead_is_visible_and_behind_is_out_of_view(spark):
    assert look(spark, [(1, 10, 0), (2, -10, 0)]) == {1: ("visible", None), 2: ("out_of_fov", None)}


def test_nearer_vehicle_hides_the_one_behind(spark):
    assert look(spark, [(10, 8, 0), (20, 16, 0)]) == {10: ("visible", None), 20: ("occluded", 10)}


def test_range_and_near_blind(spark):
    assert look(spark, [(1, 50, 0)]) == {1: ("out_of_range", None)}
    assert look(spark, [(1, 2.5, 0), (2, 3.0, 0), (3, 36.5, 0.0)])[1] == ("out_of_range", None)


def test_lane_samples_have_both_ends(spark):
    lanes = [("a", 0.0, 0.0, 10.0, 0.0, 90.0, 3), ("b", 1.0, 2.0, 10.0, 0.0, 90.0, 1)]
    got = [tuple(r) for r in egos.grid(spark, lanes).orderBy("ego_id").collect()]
    half = math.pi / 2
    assert got == [(0, "a", 0, 0.0, 0.0, half), (1, "a", 1, 5.0, 0.0, half), (2, "a", 2, 10.0, 0.0, half), (3, "b", 0, 1.0, 2.0, half)]


def wrapped(a):
    return (a + math.pi) % (2 * math.pi) - math.pi


def painted(rows, pose, fov, sensor):
    """Bins painted by occluders in order of range: an independent way to the same result."""
    h, half, n = pose[2], math.radians(fov) / 2, sensor["bins"]
    sx = pose[0] + sensor["forward_m"] * math.cos(h) - sensor["left_m"] * math.sin(h)
    sy = pose[1] + sensor["forward_m"] * math.sin(h) + sensor["left_m"] * math.cos(h)
    at = lambda b: min(n - 1, max(0, int((b + half) / (2 * half / n))))
    paint, out = {}, {}
    for i, kind, x, y, dx, dy, yaw in sorted(rows, key=lambda r: (math.hypot(r[2] - sx, r[3] - sy), r[0])):
        rng, rel = math.hypot(x - sx, y - sy), wrapped(math.atan2(y - sy, x - sx) - h)
        if abs(rel) > half:
            out[i] = ("out_of_fov", None)
        elif not sensor["near_blind_m"] < rng <= sensor["range_m"]:
            out[i] = ("out_of_range", None)
        else:
            near, who = paint.get(at(rel), (math.inf, None))
            out[i] = ("occluded", who) if rng > near + sensor["margin_m"] else ("visible", None)
        if kind not in c.OCCLUDERS:
            continue
        corners = [(x + a * dx / 2 * math.cos(yaw) - b * dy / 2 * math.sin(yaw), y + a * dx / 2 * math.sin(yaw) + b * dy / 2 * math.cos(yaw)) for a in (1, -1) for b in (1, -1)]
        near = min(math.hypot(u - sx, v - sy) for u, v in corners)
        rels = [wrapped(math.atan2(v - sy, u - sx) - h) for u, v in corners]
        ks = [at(r) for r in rels if -half <= r <= half]
        cells = set(ks)
        if len(ks) > 1:
            lo, hi = min(ks), max(ks)
            back = fov >= 360 and hi - lo > n // 2
            cells |= set(range(hi, n)) | set(range(lo + 1)) if back else set(range(lo, hi + 1))
        for k in cells:
            if near < paint.get(k, (math.inf, None))[0]:
                paint[k] = (near, i)
    return out


@pytest.mark.parametrize("fov,left", [(60.0, 0.0), (120.0, 0.4), (200.0, 0.0), (360.0, -0.3)])
def test_random_scenes_against_painted_bins(spark, fov, left):
    rng = random.Random(int(fov))
    sensor = c.sensor_with({"fov_deg": fov, "left_m": left})
    poses = [(i, "a", 0, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(-4, 4)) for i in range(6)]
    frames = {f: [(i, rng.choice(c.CLASSES), rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(0.5, 9), rng.uniform(0.5, 3), rng.uniform(-4, 4)) for i in range(14)] for f in range(25)}
    df = tracks(spark.createDataFrame([(f, *r) for f, rows in frames.items() for r in rows], COLUMNS))
    seen = vis.classified(vis.visibility(df, spark.createDataFrame(poses, EGO), (fov,), sensor), sensor["range_m"], sensor["near_blind_m"])
    got = {(r.frame_idx, r.ego_id, r.track_id): (r.reason, r.occluded_by) for r in seen.collect()}
    want = {(f, p[0], i): v for f, rows in frames.items() for p in poses for i, v in painted(rows, p[3:], fov, sensor).items()}
    assert got == want


def test_out_of_view_occluders_cast_shadows(spark):
    # a truck beside the ego, its centre out of view, reaches into the field of view
    rows = [(1, "truck", 2.0, 3.2, 9.0, 2.0, 0.0), (2, "pedestrian", 9.5, 4.6, 0.7, 0.7, 0.0)]
    got = look(spark, rows)
    assert got[1][0] == "out_of_fov" and got[2] == ("occluded", 1)


def test_repeated_track_counts_once_as_its_farthest_row(spark):
    got = look(spark, [(1, 10, 0), (1, 50, 0), (2, 20, 20)])
    assert got[1] == ("out_of_range", None) and len(got) == 2


def test_null_and_nan_geometry_is_left_out(spark):
    rows = [(0, 1, "car", 10.0, 0.0, 4.5, 2.0, 0.0), (0, 2, "car", float("nan"), 0.0, 4.5, 2.0, 0.0), (0, 3, "car", None, 0.0, 4.5, 2.0, 0.0), (None, 4, "car", 1.0, 0.0, 4.5, 2.0, 0.0)]
    assert [r.track_id for r in tracks(spark.createDataFrame(rows, COLUMNS)).collect()] == [1]


def test_lone_vehicle_keeps_a_row_of_zeros(spark):
    (r,) = observe.vehicle_sweep(scene(spark, [(1, 10, 0)])).collect()
    assert (r.n_objects_total, r.visibility_ratio_onboard, r.ego_track_id) == (0, None, 1)


def test_wrap_of_pi_and_negative_angles(spark):
    df = spark.createDataFrame([(math.pi,), (-math.pi,), (3 * math.pi,), (-7.0,)], "a double")
    got = [r.w for r in df.select(g.wrap(F.col("a")).alias("w")).collect()]
    assert got == pytest.approx([-math.pi, -math.pi, -math.pi, wrapped(-7.0)])


def test_angular_span(spark):
    df = spark.createDataFrame([([0.1, -0.2, 0.3],), ([3.0, -3.0],), ([1.0],), ([],)], "a array<double>")
    got = [(r.s.start, r.s.stop) for r in df.select(g.angular_span(F.col("a")).alias("s")).collect()]
    assert [x for pair in got for x in pair] == pytest.approx([-0.2, 0.3, 3.0, -3.0, 1.0, 1.0, 0.0, 0.0])


def test_invariants_on_the_derived_scene(spark):
    from sightline.plans import fixture

    scene_ = fixture.tracks(spark, "/root/testdata/sf0.001")
    near = fixture.near_misses(spark, scene_)
    o = observe.sweep(scene_, near, egos.grid(spark), (120.0, 360.0), (20.0, 35.0, 80.0))
    assert o.count() == 84 * 60 * 6
    assert not o.where("n_visible_onboard + n_occluded + n_out_of_fov + n_out_of_range <> n_objects_total").count()
    assert not o.where("nm_both_visible > nm_at_least_one_visible OR nm_at_least_one_visible > nm_total OR nm_ego_relevant_aware > nm_ego_relevant").count()
    assert not o.where("fov_deg = 360 AND n_out_of_fov > 0").count()
    by = {(r.fov_deg, r.range_m): r.n for r in o.groupBy("fov_deg", "range_m").agg(F.sum("n_out_of_range").alias("n")).collect()}
    assert all(by[f, 20.0] >= by[f, 35.0] >= by[f, 80.0] for f in (120.0, 360.0))
    row = o.orderBy("frame_idx", "approach", "pos").first()
    assert sum(v.total for v in row.class_visibility.values()) == row.n_objects_total
