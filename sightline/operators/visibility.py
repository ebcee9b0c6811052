"""Which objects an ego's sensor sees, and what hides the others.

An object is hidden where an occluder nearer by centre covers the bin of the object's bearing, and the object is farther
than the nearest corner of the nearest such occluder by more than a margin. An occluder covers the bins of its corners
inside the field of view and those between the outermost ones; at a full circle, corners more than half the bins apart
cover the bins outside them instead. Every occluder counts, also one out of view or range itself.

Tracks are dealt by frame once and gathered to one array a frame; the poses that a frame meets come as another. Corners, ranges,
bearings and blockers of a batch of frames are array arithmetic (`blockers`), and only what comes of it is unfolded: nothing is
multiplied by egos and fields of view before, and nothing moves or is put in order again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import blockers
from .config import OCCLUDERS, sensor_with
from .egos import few


def prepared(tracks: DataFrame) -> DataFrame:
    """Tracks with the eight corner coordinates: computed once per track, not once per ego."""
    corners = g.box_corners(*(F.col(c) for c in ("bbox_center_x", "bbox_center_y", "bbox_dx", "bbox_dy", "bbox_yaw")))
    return tracks.withColumns({f"_{axis}{i}": c[axis == "y"] for i, c in enumerate(corners) for axis in "xy"})


def with_egos(tracks: DataFrame, egos: DataFrame, sensor: dict[str, float], self_exclude: bool, by_frame: bool = False) -> DataFrame:
    """Objects and egos of a frame, with ranges and relative bearings. by_frame: the tracks are stored in buckets of frames."""
    sx, sy = g.sensor_position(F.col("ego_x"), F.col("ego_y"), F.col("ego_h"), sensor["forward_m"], sensor["left_m"])
    poses = egos.withColumns({"_sx": sx, "_sy": sy})
    if "frame_idx" in egos.columns:
        keys = [c for c in ("ego_track_id", "ego_id") if c in egos.columns]
        met = tracks.join(poses.select("frame_idx", *keys, "_sx", "_sy", "ego_h"), "frame_idx")
        if self_exclude:
            met = met.where(F.col("track_id") != F.col("ego_track_id"))
    else:
        # a grid is a small table of poses that every frame meets; tracks are dealt by frame before they are multiplied
        keys = ["ego_id"]
        met = (tracks if by_frame else tracks.repartition("frame_idx")).crossJoin(few(poses.select(*keys, "_sx", "_sy", "ego_h")))
    dx, dy = F.col("bbox_center_x") - F.col("_sx"), F.col("bbox_center_y") - F.col("_sy")
    corner = [(F.col(f"_x{i}") - F.col("_sx"), F.col(f"_y{i}") - F.col("_sy")) for i in range(4)]
    return met.select(
        "frame_idx", *keys, "track_id", "class_name", "bbox_center_x", "bbox_center_y", "bbox_dz", "score",
        g.distance(dx, dy).alias("rng"), g.wrap(F.atan2(dy, dx) - F.col("ego_h")).alias("rel"),
        F.least(*(g.distance(u, v) for u, v in corner)).alias("near"),
        *(g.wrap(F.atan2(v, u) - F.col("ego_h")).alias(f"rel{i}") for i, (u, v) in enumerate(corner)),
    )


def with_bins(objects: DataFrame, fovs: Sequence[float], bins: int) -> DataFrame:
    """Each object per field of view: centre bin, corner bins (null outside), and the outermost of those."""
    half = F.col("half_fov")
    views = F.explode(F.array(*(F.struct(F.lit(float(f)).alias("fov_deg"), F.lit(math.radians(f) / 2.0).alias("half_fov")) for f in fovs))).alias("view")
    rows = objects.withColumn("view", views).select("*", "view.fov_deg", "view.half_fov").drop("view")
    in_fov = F.abs(F.col("rel")) <= half
    ks = {f"k{i}": F.when((F.col(f"rel{i}") >= -half) & (F.col(f"rel{i}") <= half), g.fov_bin(F.col(f"rel{i}"), half, bins)) for i in range(4)}
    rows = rows.withColumns({"in_fov": in_fov, "cbin": F.when(in_fov, g.fov_bin(F.col("rel"), half, bins)), **ks}).drop(*(f"rel{i}" for i in range(4)))
    outer = {"lo": F.least(*(f"k{i}" for i in range(4))), "hi": F.greatest(*(f"k{i}" for i in range(4)))}
    rows = rows.withColumns(outer)
    return rows.withColumn("back", F.coalesce(g.fills_round_the_back(half, F.col("lo"), F.col("hi"), bins), F.lit(False)))


def covers(c: Column, b: Column) -> Column:
    """Whether an occluder covers a bin."""
    corner = F.coalesce(c["k0"] == b, F.lit(False)) | F.coalesce(c["k1"] == b, F.lit(False)) | F.coalesce(c["k2"] == b, F.lit(False)) | F.coalesce(c["k3"] == b, F.lit(False))
    return F.when(c["back"], (b >= c["hi"]) | (b <= c["lo"]) | corner).otherwise((b >= c["lo"]) & (b <= c["hi"]))


def before(c: Column, o: Column) -> Column:
    """Whether an occluder is nearer than an object by centre; equal ranges are ordered by track."""
    return (c["rng"] < o["rng"]) | ((c["rng"] == o["rng"]) & (c["track_id"] < o["track_id"]))


def staircases(occluders: Column, bins: int, sectors: int = 18) -> Column:
    """For each bin the occluders that cover it, in order of range, that are nearer by corner than all before them.

    The last of them that stands before an object is the object's blocker. Bins are taken by sectors, so that an occluder
    is tested against the sectors and the bins of those it reaches, not against all bins.
    """
    wide = -(-bins // sectors)
    within = lambda k, low: F.coalesce((k >= low) & (k < low + wide), F.lit(False))

    def reaches(c: Column, low: Column) -> Column:
        corner = within(c["k0"], low) | within(c["k1"], low) | within(c["k2"], low) | within(c["k3"], low)
        return F.when(c["back"], (low + wide > c["hi"]) | (low <= c["lo"]) | corner).otherwise((c["lo"] < low + wide) & (c["hi"] >= low))

    def steps(covering: Column, kind: Column) -> Column:
        return F.aggregate(covering, kind, lambda acc, c: F.when((F.size(acc) == 0) | (c["near"] < F.element_at(acc, -1)["near"]), F.concat(acc, F.array(c))).otherwise(acc))

    def of_sectors(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: steps(F.filter(F.get(parts, F.floor(b / wide).cast("int")), lambda c: covers(c, b)), F.slice(occluders, 1, 0)))

    parts = lambda ordered: F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), lambda s: F.filter(ordered, lambda c: reaches(c, s * wide)))
    held = F.transform(F.array(F.array_sort(occluders)), parts)
    return F.get(F.transform(held, of_sectors), F.lit(0))


def _by_functions(tracks: DataFrame, egos: DataFrame, fovs: Sequence[float], sensor: dict[str, float], self_exclude: bool, occluders: Sequence[str], repeats: bool, crowd: int) -> DataFrame:
    """`visibility` of tracks stored in buckets of frames, by higher-order functions: what is grouped by frame afterwards stays where it is.

    Objects are gathered again for each ego and field of view. Where only counts are wanted, take `observe.counted`.
    """
    rows = with_bins(with_egos(prepared(tracks), egos, sensor, self_exclude, True), fovs, sensor["bins"])
    keys = [c for c in ("frame_idx", "ego_id", "ego_track_id", "fov_deg") if c in rows.columns]
    o = F.struct("track_id", "class_name", F.col("bbox_center_x").alias("x"), F.col("bbox_center_y").alias("y"), F.col("bbox_dz").alias("height"), "score", "rng", "rel", "in_fov", "cbin")
    c = F.struct("rng", "track_id", "near", "lo", "hi", "k0", "k1", "k2", "k3", "back", F.col("bbox_dz").alias("height"), "class_name")
    casts = F.col("class_name").isin(*occluders) & F.col("lo").isNotNull()
    grouped = rows.groupBy(*keys).agg(F.collect_list(o).alias("os"), F.collect_list(F.when(casts, c)).alias("cs"))
    repeated = F.size(F.array_distinct(F.transform("os", lambda x: x["track_id"]))) < F.size("os")
    farthest = F.filter("os", lambda x: ~F.exists("os", lambda y: (y["track_id"] == x["track_id"]) & (y["rng"] > x["rng"])))
    objects = F.col("os") if repeats else F.when(repeated, farthest).otherwise(F.col("os"))
    order = lambda x: F.struct(x["near"].alias("near"), x["rng"].alias("rng"), x["track_id"].alias("track_id"), x["height"].alias("height"), x["class_name"].alias("class_name"))

    def with_blocker(blocker_of) -> Column:
        """Objects with their blockers, for a function from an object to its blocker."""
        return F.transform(objects, lambda x: F.struct(x.alias("o"), F.when(x["in_fov"], blocker_of(x)).alias("b")))

    def of_all(x: Column) -> Column:
        return F.array_min(F.transform(F.filter("cs", lambda c: before(c, x) & covers(c, x["cbin"])), order))

    def of_bin(steps: Column) -> Column:
        return with_blocker(lambda x: F.get(F.transform(F.slice(F.reverse(F.filter(F.get(steps, x["cbin"]), lambda c: before(c, x))), 1, 1), order), F.lit(0)))

    # the steps of all bins are held as the one element of an array, so that they are made once for all objects
    many = F.get(F.transform(F.array(staircases(F.col("cs"), sensor["bins"])), of_bin), F.lit(0))
    found = grouped.select(*keys, F.explode(F.when(F.size("cs") > crowd, many).otherwise(with_blocker(of_all))).alias("f")).select(*keys, "f.o.*", "f.b")
    blocked = F.coalesce(F.col("rng") > F.col("b.near") + sensor["margin_m"], F.lit(False))
    out = found.withColumn("blocked", blocked)
    seen = {"blocker_id": "track_id", "blocker_near": "near", "blocker_height": "height", "blocker_class": "class_name"}
    return out.select(*keys, "track_id", "class_name", "x", "y", "height", "score", "rng", "rel", "in_fov", "blocked", *(F.when(F.col("blocked"), F.col(f"b.{c}")).alias(n) for n, c in seen.items()))


#: Objects of a frame from which on bins remember their nearest corner.
CROWD = 96
#: What an observation's objects are made of, and a frame's tracks.
_OBJECTS = "array<struct<o: int, rng: double, rel: double, in_fov: boolean, b: int, near: double>>"
_BOX = ("bbox_dx", "bbox_dy", "bbox_yaw")


def observations(tracks: DataFrame, egos: DataFrame, fovs: Sequence[float] = (120.0,), sensor: dict[str, float] | None = None, self_exclude: bool = False, occluders: Sequence[str] = OCCLUDERS, repeats: bool = False, crowd: int = CROWD, by_frame: bool = False, limits: dict | None = None, beside: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """Rows per frame, ego and field of view: its objects as one array, never multiplied before they are judged.

    Columns: frame_idx, ego keys, fov_deg, ts (the frame's tracks, in order), os (places in ts with range, bearing and blocker), and with
    limits (ranges, radii, centre, whether objects come too) the counts of `observe.sweep`, those that depend on a range for each. Tracks are dealt and gathered
    by frame once; poses come as an array to each frame. beside: a table with at most one row a frame, whose columns come along; with
    limits["pairs"] its column pairs holds the frame's near misses (track_id_a, track_id_b, events), which are counted, too.
    in_order: frames are dealt by ranges, so that what is put in order by frame afterwards does not move again.
    """
    rows, keys, extra = _frames(tracks, egos, fovs, sensor, self_exclude, occluders, repeats, crowd, by_frame, limits, beside, in_order)
    rows = rows.select("frame_idx", "ts", "es", *extra, F.explode("judged").alias("f"))
    views = F.array(*(F.lit(float(f)) for f in fovs))
    at = F.get("es", F.col("f.e"))
    return rows.select("frame_idx", *(at[k].alias(k) for k in keys), F.get(views, F.col("f.v")).alias("fov_deg"), "ts", *extra, *(F.col(f"f.{n}").alias(n) for n in blockers.names(limits)), *([F.col("f.os").alias("os")] if not limits or limits["objects"] else []))


def _frames(tracks: DataFrame, egos: DataFrame, fovs: Sequence[float], sensor: dict[str, float] | None, self_exclude: bool = False, occluders: Sequence[str] = OCCLUDERS, repeats: bool = False, crowd: int = CROWD, by_frame: bool = False, limits: dict | None = None, beside: DataFrame | None = None, in_order: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """One row a frame: its tracks, its poses, and for each pose and field of view what is judged; names of ego keys and further columns."""
    sensor = sensor_with(sensor)
    met, keys, extra = _gathered(tracks, egos, occluders, by_frame, beside, in_order)
    parts = _parts(["ego_track_id"] if self_exclude else [])
    if limits and limits.get("pairs"):
        parts += [F.coalesce(F.col(f"pairs.{c}"), F.array().cast("array<bigint>")) for c in ("track_id_a", "track_id_b", "events")]
    counted = "".join(f", {n}: bigint" for n in blockers.names(limits))
    objects = f", os: {_OBJECTS}" if not limits or limits["objects"] else ""
    judged = _judge([float(f) for f in fovs], int(sensor["bins"]), repeats, crowd, limits, (float(sensor["forward_m"]), float(sensor["left_m"])), f"array<struct<e: int, v: int{counted}{objects}>>")(*parts)
    return met.select("frame_idx", "ts", "es", *extra, judged.alias("judged")), keys, extra


def _gathered(tracks: DataFrame, egos: DataFrame, occluders: Sequence[str] = OCCLUDERS, by_frame: bool = False, beside: DataFrame | None = None, in_order: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """One row a frame: its tracks and its poses as arrays; names of ego keys and of columns of beside."""
    keys = [c for c in ("ego_track_id", "ego_id") if c in egos.columns] if "frame_idx" in egos.columns else ["ego_id"]
    pose = F.struct(*keys, "ego_x", "ego_y", "ego_h")
    track = F.struct("track_id", F.col("bbox_dz").alias("height"), "class_name", F.col("bbox_center_x").alias("x"), F.col("bbox_center_y").alias("y"), "score", F.col("class_name").isin(*occluders).alias("casts"), *_BOX)
    extra = [c for c in (beside.columns if beside is not None else []) if c != "frame_idx"]
    if in_order:
        # what stands beside a frame is dealt with its tracks: a join would deal both again, by hash
        rows = tracks.select("frame_idx", track.alias("t"))
        rows = rows.unionByName(beside, allowMissingColumns=True) if extra else rows
        dealt = rows.repartitionByRange(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame_idx")
        frames = dealt.groupBy("frame_idx").agg(F.sort_array(F.collect_list("t")).alias("ts"), *(F.first(c, ignorenulls=True).alias(c) for c in extra)).where(F.size("ts") > 0)
    else:
        dealt = tracks if by_frame else tracks.repartition("frame_idx")
        frames = dealt.groupBy("frame_idx").agg(F.sort_array(F.collect_list(track)).alias("ts"))
        frames = frames.join(beside, "frame_idx", "left") if extra else frames
    if "frame_idx" in egos.columns:
        met = frames.join(egos.groupBy("frame_idx").agg(F.collect_list(pose).alias("es")).hint("shuffle_merge"), "frame_idx")
    else:
        met = frames.crossJoin(F.broadcast(few(egos).agg(F.collect_list(pose).alias("es"))))
    return met, keys, extra


def _parts(more: Sequence[str]) -> list[Column]:
    """What is judged of a frame: columns of its tracks, then those of its poses."""
    casts = F.transform("ts.casts", lambda c: F.coalesce(c, F.lit(False)))
    return [F.col("ts.track_id"), casts, *(F.col(f"ts.{c}") for c in ("x", "y", *_BOX)), *(F.col(f"es.{c}") for c in ("ego_x", "ego_y", "ego_h", *more))]


def corner_bins(tracks: DataFrame, egos: DataFrame, fov: float = 120.0, sensor: dict[str, float] | None = None) -> DataFrame:
    """(frame_idx, ego key, track_id, cbin, k0 to k3, lo, hi) for each row of tracks and ego: bins of centre and corners, null outside, and the outermost of the corners'.

    Made in the frame's task and only then unfolded, by the functions that judge views.
    """
    sensor = sensor_with(sensor)
    met, keys, _ = _gathered(tracks, egos)
    binned, batches, half, bins, mount = blockers.binned, blockers.batches, math.radians(fov) / 2.0, int(sensor["bins"]), (float(sensor["forward_m"]), float(sensor["left_m"]))

    @F.arrow_udf("array<struct<ego: bigint, track_id: bigint, cbin: int, k0: int, k1: int, k2: int, k3: int>>")
    def judge(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for given in columns:
            for some in batches(given, 1):
                yield binned(some, half, bins, mount)

    rows = met.select("frame_idx", judge.asNondeterministic()(*_parts(keys[:1])).alias("judged")).select("frame_idx", F.inline("judged"))
    ks = [f"k{i}" for i in range(4)]
    return rows.withColumnRenamed("ego", keys[0]).withColumns({"lo": F.least(*ks), "hi": F.greatest(*ks)})


def rows_of_views(tracks: DataFrame, egos: DataFrame, fovs: Sequence[float], names: Sequence[str], range_m: float = 35.0, sensor: dict[str, float] | None = None, once: bool = False) -> DataFrame:
    """(frame_idx, ego keys, track_id, score, a column for each field of view: whether it is seen) for each row of tracks and ego.

    All fields of view of an object stand beside one another in its frame, so nothing is joined or grouped. Rows that share a track
    in a frame are seen where the farthest of them is; once: one row for those.
    """
    sensor = sensor_with(sensor)
    frames, keys, _ = _frames(tracks, egos, fovs, sensor)
    each = frames.select("frame_idx", "ts", "es", "judged", F.explode(F.sequence(F.lit(0), F.size("es") - 1)).alias("e"))
    views = [F.get("judged", F.col("e") * len(fovs) + i)["os"].alias(f"os{i}") for i in range(len(fovs))]
    rows = each.select("frame_idx", "ts", *(F.get("es", F.col("e"))[k].alias(k) for k in keys), *views).select("*", F.explode(F.sequence(F.lit(0), F.size("ts") - 1)).alias("p"))
    track = lambda p: F.get("ts", p)["track_id"]
    if once:
        rows = rows.where((F.col("p") == 0) | (track(F.col("p")) != F.coalesce(track(F.col("p") - 1), F.lit(0))))
    sees = lambda f: F.coalesce(f["in_fov"] & (f["rng"] > sensor["near_blind_m"]) & (f["rng"] <= range_m) & ~F.coalesce(f["rng"] > f["near"] + sensor["margin_m"], F.lit(False)), F.lit(False))
    # objects stand in the order of tracks; where some were left out, they are looked for
    seen = lambda os: F.when(F.size(os) == F.size("ts"), sees(F.get(os, F.col("p")))).otherwise(F.exists(os, lambda f: (track(f["o"]) == track(F.col("p"))) & sees(f)))
    return rows.select("frame_idx", *keys, track(F.col("p")).alias("track_id"), F.get("ts", F.col("p"))["score"].alias("score"), *(seen(f"os{i}").alias(n) for i, n in enumerate(names)))


def times_seen(tracks: DataFrame, egos: DataFrame, fovs: Sequence[float], names: Sequence[str], range_m: float = 35.0, sensor: dict[str, float] | None = None, crowd: int = CROWD) -> DataFrame:
    """(frame_idx, track_id, score, n, a column for each field of view) for each track of a frame: its poses, and how many of them see it.

    `rows_of_views` with once, counted over the poses in the frame's task: nothing is unfolded by pose.
    """
    sensor = sensor_with(sensor)
    met, _, _ = _gathered(tracks, egos)
    judged_of, batches, views, bins, mount = blockers.times_seen, blockers.batches, [float(f) for f in fovs], int(sensor["bins"]), (float(sensor["forward_m"]), float(sensor["left_m"]))
    limits = {"margin_m": float(sensor["margin_m"]), "near_blind_m": float(sensor["near_blind_m"]), "range_m": float(range_m)}

    @F.arrow_udf(f"array<struct<p: int, n: bigint{''.join(f', v{i}: bigint' for i in range(len(views)))}>>")
    def judge(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for given in columns:
            for some in batches(given, len(views)):
                yield judged_of(some, views, bins, crowd, limits, mount)

    rows = met.select("frame_idx", "ts", judge.asNondeterministic()(*_parts([])).alias("judged")).select("frame_idx", "ts", F.explode("judged").alias("f"))
    track = F.get("ts", F.col("f.p"))
    return rows.select("frame_idx", track["track_id"].alias("track_id"), track["score"].alias("score"), "f.n", *(F.col(f"f.v{i}").alias(n) for i, n in enumerate(names)))


# the few functions go with the query, so that workers need not find this package
cloudpickle.register_pickle_by_value(blockers)


def _judge(fovs: list[float], bins: int, repeats: bool, crowd: int, limits: dict | None, mount: tuple[float, float], kind: str):
    batches, observed = blockers.batches, blockers.observed

    @F.arrow_udf(kind)
    def judge(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for given in columns:
            for some in batches(given, len(fovs)):
                yield observed(some, fovs, bins, repeats, crowd, limits, mount)

    # Spark would otherwise call it a second time to leave out empty lists
    return judge.asNondeterministic()


def visibility(tracks: DataFrame, egos: DataFrame, fovs: Sequence[float] = (120.0,), sensor: dict[str, float] | None = None, self_exclude: bool = False, occluders: Sequence[str] = OCCLUDERS, repeats: bool = False, crowd: int = CROWD, by_frame: bool = False) -> DataFrame:
    """Rows per frame, ego, field of view and object, without a limit of range (see `classified`).

    Columns: frame_idx, ego keys, fov_deg, track_id, class_name, x, y, height, score, rng, rel, in_fov, blocked,
    blocker_id, blocker_near, blocker_height, blocker_class. Of rows that share a track in a frame the farthest counts, or, with
    repeats, each one. Equal ranges are ordered by track. crowd: objects of a frame from which on bins remember their nearest
    corner; by_frame: the tracks are stored in buckets of frames (see `sources.layout`), so that nothing is dealt.
    """
    sensor = sensor_with(sensor)
    if by_frame:
        return _by_functions(tracks, egos, fovs, sensor, self_exclude, occluders, repeats, crowd)
    rows = observations(tracks, egos, fovs, sensor, self_exclude, occluders, repeats, crowd)
    keys = [c for c in ("frame_idx", "ego_id", "ego_track_id", "fov_deg") if c in rows.columns]
    found = rows.select(*keys, "ts", F.explode("os").alias("f"))
    o, b = F.get("ts", F.col("f.o")), F.get("ts", F.col("f.b"))
    blocked = F.coalesce(F.col("f.rng") > F.col("f.near") + sensor["margin_m"], F.lit(False))
    seen = {"blocker_id": b["track_id"], "blocker_near": F.col("f.near"), "blocker_height": b["height"], "blocker_class": b["class_name"]}
    return found.select(*keys, *(o[c].alias(c) for c in ("track_id", "class_name", "x", "y", "height", "score")), "f.rng", "f.rel", "f.in_fov", blocked.alias("blocked"), *(F.when(blocked, c).alias(n) for n, c in seen.items()))


def classified(seen: DataFrame, range_m: float | Column = 35.0, near_blind_m: float = 1.5) -> DataFrame:
    """Adds reason, visible and occluded_by for a limit of range: out of view, then out of range, then occluded."""
    limit = F.lit(range_m) if isinstance(range_m, float | int) else range_m
    in_range = (F.col("rng") > near_blind_m) & (F.col("rng") <= limit)
    reason = F.when(~F.col("in_fov"), "out_of_fov").when(~in_range, "out_of_range").when(F.col("blocked"), "occluded").otherwise("visible")
    out = seen.withColumn("reason", reason)
    return out.withColumns({"visible": F.col("reason") == "visible", "occluded_by": F.when(F.col("reason") == "occluded", F.col("blocker_id"))})


def in_ranges(seen: DataFrame, ranges: Sequence[float], near_blind_m: float = 1.5) -> DataFrame:
    """`classified` for several limits at once; the blockers do not depend on the limit and are found once."""
    several = seen.withColumn("range_m", F.explode(F.array(*(F.lit(float(r)) for r in ranges))))
    return classified(several, F.col("range_m"), near_blind_m)
