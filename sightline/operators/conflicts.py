"""Ego-involved conflicts: perspectives of near misses, what the ego sees of its partner, and post-encroachment times."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import written
from .config import EGO_CLASSES, FRAME_S, REASONS, sensor_with
from .egos import vehicles
from . import paths
from .frames import in_window
from .quantiles import summarised
from .visibility import classified, visibility


def perspectives(near_misses: DataFrame, classes: Sequence[str] = EGO_CLASSES) -> DataFrame:
    """(frame_idx, ego_track_id, partner_id): one row for each party of a near miss that is a vehicle."""
    sides = F.array(
        F.when(F.col("class_a").isin(*classes), F.struct(F.col("track_id_a").alias("ego"), F.col("track_id_b").alias("partner"))),
        F.when(F.col("class_b").isin(*classes), F.struct(F.col("track_id_b").alias("ego"), F.col("track_id_a").alias("partner"))),
    )
    return near_misses.select("frame_idx", F.explode(F.array_compact(sides)).alias("p")).select("frame_idx", F.col("p.ego").alias("ego_track_id"), F.col("p.partner").alias("partner_id"))


def partner_status(tracks: DataFrame, wanted: DataFrame, fovs: Sequence[float] = (120.0,), heading: str = "yaw", sensor: dict[str, float] | None = None) -> DataFrame:
    """wanted: (frame_idx, ego_track_id, partner_id, ...). Each row that has both in its frame, with the partner's visibility.

    Only frames and egos that are wanted are worked on. The ego may be of any class here; it is left out of its scene.
    """
    sensor = sensor_with(sensor)
    egos = wanted.select("frame_idx", "ego_track_id").distinct()
    poses = vehicles(tracks.join(egos, (tracks.frame_idx == egos.frame_idx) & (tracks.track_id == egos.ego_track_id), "left_semi"), heading, classes=None)
    scene = tracks.join(egos.select("frame_idx").distinct(), "frame_idx", "left_semi")
    seen = classified(visibility(scene, poses.select("frame_idx", "ego_track_id", "ego_x", "ego_y", "ego_h"), fovs, sensor, self_exclude=True), sensor["range_m"], sensor["near_blind_m"])
    partner = seen.select("frame_idx", "ego_track_id", F.col("track_id").alias("partner_id"), "fov_deg", "visible", "reason", F.col("rng").alias("partner_range"), F.abs(F.degrees("rel")).alias("partner_bearing_abs_deg"))
    return wanted.join(partner, ["frame_idx", "ego_track_id", "partner_id"])


def ttc_rows(tracks: DataFrame, near_misses: DataFrame, fovs: Sequence[float] = (120.0,), heading: str = "yaw") -> DataFrame:
    """What the ego sees of its partner in every event frame, from both sides where both are vehicles."""
    rows = partner_status(tracks, written(perspectives(near_misses), "perspectives"), fovs, heading)
    pair = F.struct(F.least("ego_track_id", "partner_id").alias("a"), F.greatest("ego_track_id", "partner_id").alias("b"))
    return rows.withColumn("pair", pair)


def _shares(reason: str = "reason") -> list[Column]:
    """Shares of the four reasons, 0 where one is absent."""
    return [F.avg(F.when(F.col(reason) == r, 1.0).otherwise(0.0)).alias(f"share_{r}") for r in REASONS]


def ttc_summary(rows: DataFrame) -> DataFrame:
    """One row per field of view: rates over event frames, and over pairs at their closest frame and at any frame."""
    rows = written(rows.select("fov_deg", "pair", "visible", "reason", "partner_range", "partner_bearing_abs_deg", "frame_idx", "ego_track_id"), "partners")
    bearing = F.col("partner_bearing_abs_deg")
    rates = [
        F.count("*").alias("n_event_frames"), F.avg(F.col("visible").cast("double")).alias("partner_visible_rate"), *_shares(),
        F.avg((bearing > 60).cast("double")).alias("frac_partner_outside_120fov"), F.avg((bearing > 120).cast("double")).alias("frac_partner_behind_ego"),
    ]
    frames = summarised(rows, ["fov_deg"], rates, {"partner_range": {"median_partner_range_m": 0.5}, "partner_bearing_abs_deg": {"median_partner_bearing_deg": 0.5}})
    pairs = per_pair(rows).groupBy("fov_deg").agg(F.count("*").alias("n_unique_pairs"), F.avg(F.col("closest").cast("double")).alias("partner_visible_at_closest_frame"), F.avg(F.col("ever").cast("double")).alias("partner_visible_ever_in_event"))
    return frames.join(pairs, "fov_deg")


def per_pair(rows: DataFrame) -> DataFrame:
    """(fov_deg, pair, closest, ever): the partner seen at the closest frame (ties: first frame, smaller ego), and at any."""
    return rows.groupBy("fov_deg", "pair").agg(F.min_by("visible", F.struct("partner_range", "frame_idx", "ego_track_id")).alias("closest"), F.bool_or("visible").alias("ever"))


def pet_candidates(tracks: DataFrame, gate_m: float = 30.0, classes: Sequence[str] = EGO_CLASSES, first: int = 0, last: int = 0) -> DataFrame:
    """(ego_track_id, partner_id): ordered pairs, ego a vehicle, ever within the gate in one frame.

    Objects of a frame meet by cells four times as wide as the gate, of which a vehicle's gate touches four at most: crowded frames
    are spread over their cells, and objects in others never meet.
    """
    rows = in_window(tracks, first, last)
    of = lambda c: F.floor(c / (4 * gate_m)).cast("long")
    cell, reach = (lambda c: of(F.col(c))), gate_m * (1 + 1e-9)
    around = lambda c: F.explode(F.array_distinct(F.array(of(F.col(c) - reach), of(F.col(c) + reach))))
    a = rows.where(F.col("class_name").isin(*classes)).select("frame_idx", F.col("track_id").alias("ego_track_id"), F.col("bbox_center_x").alias("ax"), F.col("bbox_center_y").alias("ay"))
    a = a.withColumn("cx", around("ax")).withColumn("cy", around("ay"))
    b = rows.select("frame_idx", F.col("track_id").alias("partner_id"), F.col("bbox_center_x").alias("bx"), F.col("bbox_center_y").alias("by"), cell("bbox_center_x").alias("cx"), cell("bbox_center_y").alias("cy"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return a.join(b, ["frame_idx", "cx", "cy"]).where((F.col("ego_track_id") != F.col("partner_id")) & (dx * dx + dy * dy <= gate_m * gate_m)).select("ego_track_id", "partner_id").distinct()


# the few functions go with the query, so that workers need not find this package
cloudpickle.register_pickle_by_value(paths)

#: Points of a track, or of a track in one cell, and point pairs of two cells, up to which they are paired in full.
FEW_POINTS, FEW_PAIRS = 64, 4096


def pet_crossings(tracks: DataFrame, candidates: DataFrame, crossing_m: float = 2.0, first: int = 0, last: int = 0, few_points: int = FEW_POINTS) -> DataFrame:
    """Where the paths of a pair come closest, whenever each was there: frames of both, distance, time gap.

    Of a track's points at one place, only its first frame counts: it is the one that ties prefer, so parked objects are one point.
    Paths of few points are gathered once and meet as arrays, a row for each pair. Points of longer paths meet by cells as wide as
    the limit, a cell and its neighbours: points farther apart never do. Where some cell holds many points of a track, cells are
    pruned by a running best distance first.
    """
    rows = in_window(tracks, first, last).repartition("track_id")
    points = rows.groupBy("track_id", F.col("bbox_center_x").alias("x"), F.col("bbox_center_y").alias("y")).agg(F.min("frame_idx").alias("f"))
    both, pairs = ["ego_track_id", "partner_id"], candidates.select("ego_track_id", "partner_id")
    long = points.groupBy("track_id").agg(F.count("*").alias("n")).where(F.col("n") > few_points).select("track_id")
    if long.isEmpty():
        best = _met_as_arrays(points, pairs, crossing_m)
    else:
        long = written(long, "long", small=True)
        tagged = pairs.join(long.select(F.col("track_id").alias("ego_track_id"), F.lit(True).alias("la")), "ego_track_id", "left").join(long.select(F.col("track_id").alias("partner_id"), F.lit(True).alias("lb")), "partner_id", "left")
        tagged = written(tagged.select(*both, (F.col("la").isNotNull() | F.col("lb").isNotNull()).alias("long")), "pairs", small=True)
        short = _met_as_arrays(points.join(long, "track_id", "left_anti"), tagged.where("NOT long").select(*both), crossing_m)
        best = short.unionByName(_met_by_cells(rows, points, tagged.where("long").select(*both), crossing_m, few_points))
    gap = (F.abs(F.col("m.fa") - F.col("m.fb")) * FRAME_S).alias("pet_s")
    return best.select(*both, F.col("m.d").alias("crossing_m"), F.col("m.fa").alias("ego_frame"), F.col("m.fb").alias("partner_frame"), gap)


def _met_as_arrays(points: DataFrame, pairs: DataFrame, crossing_m: float) -> DataFrame:
    """(ego_track_id, partner_id, m): least distance within the limit and its frames, of paths that are gathered to arrays."""
    path = points.groupBy("track_id").agg(F.collect_list(F.struct("x", "y", "f")).alias("path"))
    side = lambda key, p: path.select(F.col("track_id").alias(key), F.col("path").alias(p))
    met = pairs.join(side("ego_track_id", "a"), "ego_track_id").join(side("partner_id", "b"), "partner_id")
    closest, limit = paths.closest, float(crossing_m)

    @F.arrow_udf("struct<d: double, fa: bigint, fb: bigint>")
    def crossing(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for given in columns:
            yield closest(given, limit)

    found = met.select("ego_track_id", "partner_id", crossing.asNondeterministic()(*(F.col(f"{p}.{c}") for p in "ab" for c in "xyf")).alias("m"))
    return found.where("m.d IS NOT NULL")


def _met_by_cells(rows: DataFrame, points: DataFrame, candidates: DataFrame, crossing_m: float, few_points: int) -> DataFrame:
    """The same for paths of any length, by cells."""
    a = points.select(F.col("track_id").alias("ego_track_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("f").alias("fa"))
    b = points.select(F.col("track_id").alias("partner_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("f").alias("fb"))
    spots = rows.groupBy("track_id", F.floor(F.col("bbox_center_x") / crossing_m), F.floor(F.col("bbox_center_y") / crossing_m))
    if spots.agg(F.count("*").alias("n")).where(F.col("n") > few_points).isEmpty():
        a, b = _in_cells(a, "a", crossing_m), _around(_in_cells(b, "b", crossing_m))
        met = candidates.join(a, "ego_track_id").join(b, ["partner_id", "cax", "cay"])
    else:
        met = _closing_in(a, b, candidates, crossing_m)
    d = g.distance(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    # points farther apart cannot be the pair's crossing: they go before anything is grouped
    near = met.withColumn("d", d).where(F.col("d") <= crossing_m)
    return near.groupBy("ego_track_id", "partner_id").agg(F.min(F.struct("d", "fa", "fb")).alias("m"))


def _in_cells(points: DataFrame, p: str, size: float) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    return points.withColumns({f"c{p}x": cell(f"{p}x"), f"c{p}y": cell(f"{p}y")})


def _around(cells: DataFrame) -> DataFrame:
    """Partners' cells, once for each cell of an ego that they touch."""
    near = lambda c: F.explode(F.array(*(F.col(c) + k for k in (-1, 0, 1))))
    return cells.withColumn("cax", near("cbx")).withColumn("cay", near("cby"))


def _closing_in(a: DataFrame, b: DataFrame, candidates: DataFrame, crossing_m: float, shrink: int = 8, levels: int = 6) -> DataFrame:
    """Points of both tracks of each pair that may be its closest ones.

    Cells of both tracks meet, each with its number of points and one of them. The least distance between such points bounds the
    pair's; cells farther apart than that go. What then holds few pairs of points is paired, the rest is cut into cells of an
    eighth the width, which meet in turn.
    """
    size, state, paired = crossing_m, None, []
    both = ["ego_track_id", "partner_id"]
    for level in range(levels):
        cells_a = _in_cells(a, "a", size).groupBy("ego_track_id", "cax", "cay").agg(F.count("*").alias("na"), F.min(F.struct("ax", "ay")).alias("ra"))
        cells_b = _in_cells(b, "b", size).groupBy("partner_id", "cbx", "cby").agg(F.count("*").alias("nb"), F.min(F.struct("bx", "by")).alias("rb"))
        if state is None:
            met = candidates.join(cells_a, "ego_track_id").join(_around(cells_b), ["partner_id", "cax", "cay"])
        else:
            up = lambda df, p: df.withColumns({f"u{p}{c}": F.floor(F.col(f"c{p}{c}") / shrink) for c in "xy"})
            met = state.join(up(cells_a, "a"), ["ego_track_id", "uax", "uay"]).join(up(cells_b, "b"), ["partner_id", "ubx", "uby"])
        met = written(met.select(*both, "cax", "cay", "cbx", "cby", "na", "nb", g.distance(F.col("ra.ax") - F.col("rb.bx"), F.col("ra.ay") - F.col("rb.by")).alias("d")), "cells")
        bound = met.groupBy(*both).agg(F.min("d").alias("best"))
        apart = lambda c: F.greatest(F.abs(F.col(f"ca{c}") - F.col(f"cb{c}")) - 1, F.lit(0)) * size
        left = met.join(bound, both).where(g.distance(apart("x"), apart("y")) <= F.least("best", F.lit(crossing_m)) * (1 + 1e-9))
        few = F.col("na") * F.col("nb") <= FEW_PAIRS
        some = left.where(few) if level < levels - 1 else left
        points_a, points_b = _in_cells(a, "a", size), _in_cells(b, "b", size)
        paired.append(some.select(*both, "cax", "cay", "cbx", "cby").join(points_a, ["ego_track_id", "cax", "cay"]).join(points_b, ["partner_id", "cbx", "cby"]).select(*both, "ax", "ay", "fa", "bx", "by", "fb"))
        state = left.where(~few).select(*both, *(F.col(f"c{p}{c}").alias(f"u{p}{c}") for p in "ab" for c in "xy"))
        if level == levels - 1 or state.isEmpty():
            break
        size /= shrink
    out = paired[0]
    for p in paired[1:]:
        out = out.unionByName(p)
    return out


def pet_conflicts(tracks: DataFrame, crossing_m: float = 2.0, pet_s: float = 5.0, gate_m: float = 30.0, first: int = 0, last: int = 0) -> DataFrame:
    """Crossing pairs with a short gap, and the frame with both present and closest: the instant to judge what the ego sees."""
    crossings = pet_crossings(tracks, pet_candidates(tracks, gate_m, first=first, last=last), crossing_m, first, last).where(F.col("pet_s") <= pet_s)
    rows = in_window(tracks, first, last)
    a = rows.select(F.col("track_id").alias("ego_track_id"), "frame_idx", F.col("bbox_center_x").alias("ax"), F.col("bbox_center_y").alias("ay"))
    b = rows.select(F.col("track_id").alias("partner_id"), "frame_idx", F.col("bbox_center_x").alias("bx"), F.col("bbox_center_y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    together = crossings.join(a, "ego_track_id").join(b, ["partner_id", "frame_idx"])
    closest = together.groupBy("ego_track_id", "partner_id", "pet_s").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "frame_idx")).alias("m"))
    classes = rows.groupBy(F.col("track_id").alias("partner_id")).agg(F.min_by("class_name", "frame_idx").alias("partner_class"))
    return closest.join(classes, "partner_id").select("ego_track_id", "partner_id", "partner_class", "pet_s", F.sqrt("m.d2").alias("min_sep_m"), F.col("m.frame_idx").alias("frame_idx"))


def pet_rows(tracks: DataFrame, conflicts: DataFrame, fovs: Sequence[float] = (120.0,), heading: str = "yaw") -> DataFrame:
    """What the ego sees of its partner at the instant of each conflict; mined once, seen at every field of view."""
    return partner_status(tracks, written(conflicts, "conflicts", small=True), fovs, heading)


def pet_summary(rows: DataFrame) -> DataFrame:
    rows = written(rows.select("fov_deg", "visible", "reason", "pet_s", "min_sep_m"), "partners", small=True)
    rates = [F.count("*").alias("n_conflict_pairs"), F.avg(F.col("visible").cast("double")).alias("partner_visible_rate"), *_shares()]
    return summarised(rows, ["fov_deg"], rates, {"pet_s": {"median_pet_s": 0.5}, "min_sep_m": {"median_min_sep_m": 0.5}})
