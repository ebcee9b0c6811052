"""Objects are judged frame by frame: not multiplied by egos before, not joined or grouped again afterwards."""

import random

from pyspark.sql import functions as F

from sightline.operators import egos, observe, whatif
from sightline.operators import visibility as vis
from sightline.plans import catalogue, fixture
from sightline.sources import tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_of_all_objects_are_not_joined(spark):
    plan = plan_of(catalogue.QUERIES["confidence_joined"](spark, SF))
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_objects_are_gathered_once_and_judged_once(spark):
    for name in ("confidence_ungated", "object_decomposition", "fov_range_pivot", "stored_frames", "truck_occlusion_share", "proximity_bins"):
        plan = plan_of(catalogue.QUERIES[name](spark, SF))
        assert plan.count("+- ArrowEvalPython") == 1, name
        # nothing is gathered by more than the frame
        assert "ObjectHashAggregate(keys=[frame_idx" in plan and all("ego_id" not in line.split("functions")[0] for line in plan.splitlines() if "ObjectHashAggregate" in line), name


def test_counted_is_what_counts_counts(spark):
    scene, grid = fixture.repeated(fixture.tracks(spark, SF)), egos.grid(spark, positions=3)
    want = observe.counts(vis.classified(vis.visibility(scene, grid, (90.0, 360.0))))
    got = observe.counted(scene, grid, (90.0, 360.0)).select(*want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_views_of_repeated_tracks(spark):
    scene, grid = fixture.repeated(fixture.tracks(spark, SF).where("frame_idx < 20")), egos.grid(spark, positions=3)
    seen = vis.classified(vis.visibility(scene, grid, (120.0, 360.0)))
    want = whatif.both_views(seen, scene, grid)
    got = vis.rows_of_views(scene, grid, (120.0, 360.0), ("v120", "v360")).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    once = vis.rows_of_views(scene, grid, (120.0, 360.0), ("v120", "v360"), once=True).select("frame_idx", "ego_id", "track_id", "v120", "v360")
    assert once.exceptAll(whatif.scores_of_views(seen).select(*once.columns)).count() == 0 and once.count() == once.distinct().count() == want.select("frame_idx", "ego_id", "track_id").distinct().count()


def test_pairs_and_steps_agree_with_functions(spark):
    rng = random.Random(5)
    rows = [(f, i, rng.choice(("car", "truck", "bicycle")), float(rng.randrange(-12, 12)), float(rng.randrange(-12, 12)), 4.0, 2.0, 1.5, rng.choice((0.0, 1.0)), 0.5) for f in range(12) for i in range(9) for _ in range(1 + (f % 3 == 0))]
    scene, grid = tables.tracks(spark.createDataFrame(rows, tables.TRACKS)), egos.grid(spark, positions=2)
    for more in ({}, {"repeats": True}):
        one, other, stored = (vis.visibility(scene, grid, (120.0, 360.0), crowd=n, by_frame=b, **more).drop("blocker_height", "blocker_class") for n, b in ((0, False), (96, False), (96, True)))
        assert one.count() == other.count() == stored.count() and one.exceptAll(other).count() == 0
        rounded = [x.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in x.dtypes)) for x in (other, stored)]
        assert rounded[0].exceptAll(rounded[1]).count() == 0


def test_poses_that_see_a_track_are_counted_in_its_frame(spark):
    given = (fixture.repeated(fixture.tracks(spark, SF)), egos.grid(spark), (120.0, 360.0), ("v120", "v360"))
    rows = vis.rows_of_views(*given, once=True)
    summed = {(r.frame_idx, r.track_id): (r.n, r.a, r.b) for r in rows.groupBy("frame_idx", "track_id").agg(F.count("*").alias("n"), F.count_if("v120").alias("a"), F.count_if("v360").alias("b")).collect()}
    for crowd in (vis.CROWD, 4):
        counted = vis.times_seen(*given, crowd=crowd)
        got = counted.collect()
        assert {(r.frame_idx, r.track_id): (r.n, r.v120, r.v360) for r in got} == summed and len(got) == len(summed)
    for f in (whatif.ungated, whatif.confidence_curve, whatif.confidence_grid):
        assert sorted(f(counted).collect()) == sorted(f(rows).collect())


def exchanges(df):
    plan = plan_of(df)
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_record_in_order_is_dealt_once_by_ranges(spark):
    record = observe.ordered(observe.sweep(fixture.tracks(spark, SF), spark.createDataFrame([(3, 1, 2)], "frame_idx long, track_id_a long, track_id_b long"), egos.grid(spark), in_order=True), dealt=True)
    ranges = [line for line in exchanges(record) if "rangepartitioning" in line]
    assert len(ranges) == 1 and "REPARTITION" in ranges[0] and plan_of(record).count("+- ArrowEvalPython") == 1
    got = [tuple(r) for r in record.select("frame_idx", "approach", "pos").collect()]
    assert got == sorted(got) and len(set(got)) == 84 * 60


def test_near_misses_are_counted_in_the_frames_task(spark):
    tracks = fixture.repeated(fixture.tracks(spark, SF))
    near = fixture.near_misses(spark, tracks).select("frame_idx", "track_id_a", "track_id_b")
    some = near.limit(1).select("frame_idx", F.lit(10**9).alias("track_id_a"), "track_id_b")
    near = near.unionByName(near.where("track_id_a % 2 = 0")).unionByName(some)
    grid, fovs, keys = egos.grid(spark, positions=4), (120.0, 360.0), ("frame_idx", "ego_x", "ego_y", "fov_deg", "range_m")
    seen = vis.in_ranges(vis.visibility(tracks, grid, fovs), (20.0, 50.0))
    want = observe.near_miss_counts(seen, near).join(F.broadcast(grid), "ego_id").select(*keys, *observe.NEAR_MISS_COUNTS)
    for in_order in (False, True):
        for classes in (False, True):
            swept = observe.sweep(tracks, near, grid, fovs, (20.0, 50.0), classes=classes, in_order=in_order)
            assert swept.count() == 84 * 16 * 4
            got = swept.where("nm_total > 0").select(*keys, *observe.NEAR_MISS_COUNTS)
            assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert "os:" not in plan_of(observe.sweep(tracks, near, grid, classes=False))


def test_each_occluder_is_held_against_all_objects_of_an_observation():
    import numpy as np

    from sightline.operators import blockers

    rng, n, rows = np.random.default_rng(4), 7, 200
    far, near = rng.integers(1, 6, (rows, n)) * 1.0, rng.integers(1, 4, (rows, n)) * 1.0
    lo = rng.integers(0, 8, (rows, n)).astype(np.int16)
    hi, cbin, casts = (lo + rng.integers(0, 8, (rows, n))).astype(np.int16), rng.integers(-1, 12, (rows, n)).astype(np.int16), rng.random((rows, n)) < 0.7
    before = far.T[:, None] < far.T[None]
    got = blockers.by_pairs(before, far, near, cbin, [lo, hi], lo, hi, np.zeros((rows, n), dtype=bool), casts)
    for r in range(rows):
        for o in range(n):
            those = [(near[r, c], far[r, c], c) for c in range(n) if casts[r, c] and far[r, c] < far[r, o] and lo[r, c] <= cbin[r, o] <= hi[r, c]]
            assert got[r, o] == (min(those)[2] if those else -1)


def test_values_of_the_c_library_come_without_a_call_for_each():
    import math

    import numpy as np

    from sightline.operators import blockers

    calls = []

    def atan2(y, x):
        calls.append(1)
        return math.atan2(y, x)

    def off(y, x):
        return np.nextafter(np.arctan2(y, x), np.inf)

    off.nin = 2
    y, x = np.random.default_rng(3).normal(size=(2, 40, 50)) * 20.0
    found, probed = blockers.as_in_c(off, atan2), len(calls)
    got = found(y, x)
    assert len(calls) == probed and got.shape == y.shape
    assert got.ravel().tolist() == [math.atan2(*p) for p in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)]
    assert np.isnan(found(np.array([np.nan]), np.array([1.0]))).all()
