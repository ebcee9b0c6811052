"""The registered queries: each operator over the whole derived scene."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import config as c
from ..operators import conflicts, egos, frames, observe, proximity, summary, trajectory, whatif
from ..operators import visibility as vis
from ..sources import digests, layout, results, sinks, tables
from ..sources.shared import shared_dir
from . import fixture
from .oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Objects of a frame and an ego are grouped where the frame's tracks already are.
_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        return fixture.rounded(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def seen(spark: SparkSession, sf_dir: str, fovs: Sequence[float] = (120.0,)) -> DataFrame:
    """Classified objects from the grid of egos, of all frames."""
    return vis.classified(vis.visibility(fixture.tracks(spark, sf_dir), egos.grid(spark), fovs))


def observed(spark: SparkSession, sf_dir: str, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    tracks = fixture.tracks(spark, sf_dir)
    return observe.ratios(observe.counted(tracks, egos.grid(spark), beside=beside and beside(tracks)))


def placed(spark: SparkSession, sf_dir: str, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Observations with the poses of their egos."""
    poses = egos.grid(spark).withColumn("ego_heading_deg", F.degrees("ego_h")).drop("ego_h")
    return observed(spark, sf_dir, beside).join(F.broadcast(poses), "ego_id")


def swept(spark: SparkSession, sf_dir: str, fovs: Sequence[float] = (120.0,), ranges: Sequence[float] | None = None, positions: int | None = None, classes: bool = False, in_order: bool = False) -> DataFrame:
    """A sweep over configurations on all frames: geometry once, blockers once per field of view."""
    tracks = fixture.tracks(spark, sf_dir)
    return observe.sweep(tracks, fixture.near_misses(spark, tracks), egos.grid(spark, positions=positions), fovs, ranges, classes=classes, in_order=in_order)


@query
def ego_grid(spark, sf_dir):
    return observe.objects_near(fixture.tracks(spark, sf_dir), egos.grid(spark))


@query
def frame_stride(spark, sf_dir):
    return frames.strided(fixture.tracks(spark, sf_dir), 10)


@query
def frame_window(spark, sf_dir):
    return frames.in_window(fixture.tracks(spark, sf_dir), 20, 60).groupBy("frame_idx").agg(F.count("*").alias("n"))


@query
def frame_linspace_sample(spark, sf_dir):
    return frames.evenly(fixture.tracks(spark, sf_dir), 50)


@query
def range_bearing(spark, sf_dir):
    return vis.with_egos(vis.prepared(fixture.tracks(spark, sf_dir)), egos.grid(spark), c.SENSOR, False).select("frame_idx", "ego_id", "track_id", "rng", "rel", "near")


@query
def box_corners(spark, sf_dir):
    corners = geometry.box_corners(*(F.col(x) for x in ("bbox_center_x", "bbox_center_y", "bbox_dx", "bbox_dy", "bbox_yaw")))
    return fixture.tracks(spark, sf_dir).select("frame_idx", "track_id", *(p[k].alias(f"{'xy'[k]}{i}") for i, p in enumerate(corners) for k in (0, 1)))


@query
def corner_bins(spark, sf_dir):
    return vis.corner_bins(fixture.tracks(spark, sf_dir), egos.grid(spark))


def _row_level(fov: float) -> Query:
    return lambda spark, sf_dir: seen(spark, sf_dir, (fov,)).select("frame_idx", "ego_id", "track_id", "reason", "occluded_by")


for _fov in (60, 120, 180, 360):
    _f = _row_level(float(_fov))
    _f.__name__ = f"visibility_{_fov}"
    query(_f)


@query
def observation_counts(spark, sf_dir):
    return observed(spark, sf_dir).select("frame_idx", "ego_id", *observe.COUNTS[:5], "visibility_ratio_onboard")


@query
def nearby_visibility(spark, sf_dir):
    return observed(spark, sf_dir).select("frame_idx", "ego_id", "n_nearby_total", "n_nearby_visible", "nearby_visibility_ratio")


@query
def conflict_zone_visibility(spark, sf_dir):
    return observed(spark, sf_dir).select("frame_idx", "ego_id", "n_conflict_zone_total", "n_conflict_zone_visible", "conflict_zone_visibility_ratio")


@query
def class_visibility(spark, sf_dir):
    return observe.by_class(seen(spark, sf_dir)).drop("fov_deg")


def _near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.near_miss_counts(seen(spark, sf_dir), fixture.near_misses(spark, fixture.tracks(spark, sf_dir)))


@query
def near_miss_observations(spark, sf_dir):
    return _near_miss(spark, sf_dir).drop("fov_deg")


@query
def class_visibility_json(spark, sf_dir):
    seen_ = seen(spark, sf_dir)
    return observe.class_map(seen_).select("frame_idx", "ego_id", observe.class_json(F.col("class_visibility")).alias("class_visibility"))


@query
def sweep_record(spark, sf_dir):
    record = observe.ordered(swept(spark, sf_dir, classes=True, in_order=True), dealt=True)
    return record.withColumn("class_visibility", observe.class_json(F.col("class_visibility")))


@query
def near_miss_detectability(spark, sf_dir):
    return summary.detectability(_near_miss(spark, sf_dir))


@query
def sweep_summary(spark, sf_dir):
    return summary.sweep_summary(observed(spark, sf_dir))


@query
def sweep_by_approach(spark, sf_dir):
    return summary.by_approach(placed(spark, sf_dir))


def _sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.sensitivity(swept(spark, sf_dir, c.SENSITIVITY_FOVS, c.SENSITIVITY_RANGES, c.SENSITIVITY_POSITIONS))


def _ranges(spark: SparkSession, sf_dir: str, fovs: Sequence[float] = c.RANGE_FOVS) -> DataFrame:
    return summary.range_sensitivity(swept(spark, sf_dir, fovs, c.RANGES))


@query
def fov_range_sensitivity(spark, sf_dir):
    return _sensitivity(spark, sf_dir)


@query
def fov_range_pivot(spark, sf_dir):
    return summary.matrix(_sensitivity(spark, sf_dir), c.SENSITIVITY_RANGES)


@query
def range_sensitivity(spark, sf_dir):
    return _ranges(spark, sf_dir)


@query
def range_series(spark, sf_dir):
    return summary.range_series(_ranges(spark, sf_dir), 360.0, "int_wide")


@query
def fov_slice(spark, sf_dir):
    return summary.fov_slice(_sensitivity(spark, sf_dir), _ranges(spark, sf_dir, (360.0,)))


_VEHICLE = ("frame_idx", "ego_track_id", "ego_x", "ego_y", "ego_heading_deg", "ego_dist_to_center", "ego_inbound", *observe.COUNTS, "visibility_ratio_onboard", "nearby_visibility_ratio", "conflict_zone_visibility_ratio")


@query
def vehicle_ego_yaw(spark, sf_dir):
    return observe.vehicle_sweep(fixture.tracks(spark, sf_dir)).select(*_VEHICLE)


@query
def vehicle_ego_inward(spark, sf_dir):
    return observe.vehicle_sweep(fixture.tracks(spark, sf_dir), "inward").select(*_VEHICLE)


@query
def vehicle_ego_region_summary(spark, sf_dir):
    return summary.vehicle_summary(observe.vehicle_sweep(fixture.tracks(spark, sf_dir)))


@query
def inbound_share(spark, sf_dir):
    return summary.inbound_share(egos.vehicles(fixture.tracks(spark, sf_dir)))


@query
def design_comparison(spark, sf_dir):
    return summary.design_comparison(summary.sweep_summary(observed(spark, sf_dir)), summary.vehicle_summary(observe.vehicle_sweep(fixture.tracks(spark, sf_dir))))


def _ttc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = fixture.tracks(spark, sf_dir)
    return conflicts.ttc_rows(tracks, fixture.near_misses(spark, tracks), (120.0, 360.0))


@query
def partner_perspectives(spark, sf_dir):
    return conflicts.perspectives(fixture.near_misses(spark, fixture.tracks(spark, sf_dir)))


@query
def partner_ttc_rows(spark, sf_dir):
    return _ttc(spark, sf_dir).drop("pair")


def _ttc_summary(fov: float) -> Query:
    return lambda spark, sf_dir: conflicts.ttc_summary(_ttc(spark, sf_dir).where(F.col("fov_deg") == fov)).drop("fov_deg")


for _fov in (120, 360):
    _f = _ttc_summary(float(_fov))
    _f.__name__ = f"partner_ttc_summary_{_fov}"
    query(_f)


@query
def partner_closest(spark, sf_dir):
    return conflicts.per_pair(_ttc(spark, sf_dir)).select("fov_deg", "pair.a", "pair.b", "closest")


@query
def partner_ever_visible(spark, sf_dir):
    return conflicts.per_pair(_ttc(spark, sf_dir)).select("fov_deg", "pair.a", "pair.b", "ever")


@query
def reason_breakdown(spark, sf_dir):
    return conflicts.ttc_summary(_ttc(spark, sf_dir)).select("fov_deg", *(f"share_{x}" for x in c.REASONS))


@query
def near_miss_figure(spark, sf_dir):
    return summary.near_miss_figure(conflicts.ttc_summary(_ttc(spark, sf_dir)))


@query
def pet_candidates(spark, sf_dir):
    return conflicts.pet_candidates(fixture.tracks(spark, sf_dir))


@query
def pet_crossings(spark, sf_dir):
    tracks = fixture.tracks(spark, sf_dir)
    return conflicts.pet_crossings(tracks, conflicts.pet_candidates(tracks))


@query
def pet_conflicts(spark, sf_dir):
    return conflicts.pet_conflicts(fixture.tracks(spark, sf_dir), pet_s=2.0)


@query
def pet_summary(spark, sf_dir):
    tracks = fixture.tracks(spark, sf_dir)
    return conflicts.pet_summary(conflicts.pet_rows(tracks, conflicts.pet_conflicts(tracks, pet_s=2.0), (120.0, 360.0)))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.nearest_vehicle(placed(spark, sf_dir, proximity.vehicles_of), fixture.tracks(spark, sf_dir))


@query
def nearest_vehicle(spark, sf_dir):
    return _near(spark, sf_dir).select("frame_idx", "ego_id", "d_sensor", "d_center")


@query
def proximity_bins(spark, sf_dir):
    return proximity.bins(_near(spark, sf_dir))


@query
def clearance_correction(spark, sf_dir):
    return proximity.clearance_correction(_near(spark, sf_dir))


@query
def vertical_visibility(spark, sf_dir):
    return whatif.vertical(seen(spark, sf_dir))


@query
def vertical_list(spark, sf_dir):
    """The list form: rows that repeat a track in a frame are judged one by one."""
    tracks = fixture.repeated(fixture.tracks(spark, sf_dir))
    listed = vis.classified(vis.visibility(tracks, egos.grid(spark), repeats=True))
    return listed.select("frame_idx", "ego_id", "track_id", "x", "y", "rng", "reason", "blocker_near", "blocker_height")


@query
def sensor_height_curve(spark, sf_dir):
    return whatif.height_curve(seen(spark, sf_dir))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vis.times_seen(fixture.tracks(spark, sf_dir), egos.grid(spark), (120.0, 360.0), ("v120", "v360"))


@query
def confidence_ungated(spark, sf_dir):
    return whatif.ungated(_views(spark, sf_dir))


@query
def confidence_curve(spark, sf_dir):
    return whatif.confidence_curve(_views(spark, sf_dir))


@query
def confidence_grid(spark, sf_dir):
    return whatif.confidence_grid(_views(spark, sf_dir))


@query
def confidence_joined(spark, sf_dir):
    return vis.rows_of_views(fixture.tracks(spark, sf_dir), egos.grid(spark), (120.0, 360.0), ("v120", "v360"))


@query
def occlusion_shadow(spark, sf_dir):
    return whatif.occlusion_shadow(seen(spark, sf_dir))


@query
def truck_occlusion_share(spark, sf_dir):
    return whatif.truck_share(seen(spark, sf_dir))


@query
def lead_vehicle_benefit(spark, sf_dir):
    return whatif.lead_benefit(whatif.lead_vehicles(seen(spark, sf_dir)))


@query
def track_speeds(spark, sf_dir):
    return trajectory.speeds(fixture.tracks(spark, sf_dir)).select("track_id", "frame_idx", "speed_mps")


@query
def speed_summary(spark, sf_dir):
    return trajectory.speed_summary(trajectory.speeds(fixture.tracks(spark, sf_dir)))


@query
def dimension_summary(spark, sf_dir):
    return trajectory.dimension_summary(fixture.tracks(spark, sf_dir))


@query
def class_summary(spark, sf_dir):
    return trajectory.class_summary(fixture.tracks(spark, sf_dir))


@query
def track_length_stats(spark, sf_dir):
    return trajectory.track_lengths(fixture.tracks(spark, sf_dir))


@query
def arrival_rates(spark, sf_dir):
    return trajectory.arrival_rates(fixture.tracks(spark, sf_dir))


@query
def frame_bounds(spark, sf_dir):
    return trajectory.frame_bounds(fixture.tracks(spark, sf_dir))


@query
def near_miss_pair_types(spark, sf_dir):
    return trajectory.pair_types(fixture.near_misses(spark, fixture.tracks(spark, sf_dir)))


@query
def ttc_stats(spark, sf_dir):
    return trajectory.ttc_stats(fixture.near_misses(spark, fixture.tracks(spark, sf_dir)))


@query
def separation_stats(spark, sf_dir):
    return trajectory.separation_stats(fixture.near_misses(spark, fixture.tracks(spark, sf_dir)))


@query
def following_episodes(spark, sf_dir):
    return trajectory.episodes(trajectory.following(fixture.tracks(spark, sf_dir)))


@query
def following_stats(spark, sf_dir):
    return trajectory.episode_stats(trajectory.episodes(trajectory.following(fixture.tracks(spark, sf_dir))))


@query
def object_decomposition(spark, sf_dir):
    return summary.object_decomposition(observe.counted(fixture.tracks(spark, sf_dir), egos.grid(spark), (120.0, 360.0)))


@query
def verified_export(spark, sf_dir):
    """Texts written as files, a thousand ids of a language to a file, read back in chunks and held against their rows' digests."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("lang", F.lit("-")).alias("lang"), F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    folder = f"{shared_dir(spark)}/export"
    rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id").select("text", "lang", "part").write.partitionBy("lang", "part").text(folder)
    made = digests.digests(digests.files(spark, folder, "part-*")).select(F.regexp_extract("name", "lang=([^/]*)/", 1).alias("lang"), F.regexp_extract("name", "part=([^/]*)/", 1).cast("long").alias("part"), "size", "md5")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda r: F.concat(r["text"], F.lit("\n"))), "")
    wanted = rows.groupBy("lang", "part").agg(F.md5(texts.cast("binary")).alias("expected"))
    return made.join(wanted, ["lang", "part"], "full").select("lang", "part", "size", "md5", F.coalesce(F.col("md5") == F.col("expected"), F.lit(False)).alias("verified"))


@query
def stored_frames(spark, sf_dir):
    """Observation counts from tracks stored in buckets of frames: no exchange between the scan and the grouping."""
    path = f"{shared_dir(spark)}/frames"
    layout.store_frames(fixture.tracks(spark, sf_dir), path, 16)
    return observe.ratios(observe.counted(layout.stored_frames(spark, path, 16), egos.grid(spark), by_frame=True)).select("frame_idx", "ego_id", *observe.COUNTS[:5], "visibility_ratio_onboard")


@query
def ordered_record(spark, sf_dir):
    """The record written in its order and read back: rows by approach, and whether the files' ranges follow one another."""
    path = f"{shared_dir(spark)}/record"
    sinks.write_ordered(swept(spark, sf_dir, in_order=True), path, ["frame_idx", "approach", "pos"], dealt=True)
    back = spark.read.parquet(path)
    order = sinks.file_ranges(back, ["frame_idx", "approach", "pos"]).agg(F.bool_and("after_the_one_before").alias("in_order"))
    return back.groupBy("approach").agg(F.count("*").alias("n_obs"), F.sum("n_visible_onboard").alias("n_visible")).crossJoin(F.broadcast(order))


@query
def tracks_read(spark, sf_dir):
    """Tracks written and read back, all columns."""
    path = f"{shared_dir(spark)}/tracks"
    sinks.write_parquet(fixture.tracks(spark, sf_dir), path)
    return tables.read_tracks(spark, path)


@query
def tracks_projected(spark, sf_dir):
    """Tracks written and read back, three columns: the scan reads no more than those and what makes a row usable."""
    path = f"{shared_dir(spark)}/tracks"
    sinks.write_parquet(fixture.tracks(spark, sf_dir), path)
    return tables.read_tracks(spark, path, ["frame_idx", "track_id", "class_name"])


@query
def near_misses_read(spark, sf_dir):
    """Near misses written as they come and read back with class names in one spelling."""
    path = f"{shared_dir(spark)}/near"
    raw = fixture.near_misses(spark, fixture.tracks(spark, sf_dir), normalize=False)
    sinks.write_parquet(raw, path)
    return tables.read_near_misses(spark, path)


@query
def record_read(spark, sf_dir):
    """The sweep's record written and read back by its schema, per approach and place."""
    path = f"{shared_dir(spark)}/record"
    sinks.write_parquet(swept(spark, sf_dir), path)
    return results.read_records(spark, path).groupBy("approach", "ego_x", "ego_y").agg(F.count("*").alias("n_obs"), F.sum("n_occluded").alias("n_occluded"), F.sum("nm_ego_relevant").alias("nm_ego_relevant"), F.count("class_visibility").alias("n_class_maps"))


@query
def rows_json(spark, sf_dir):
    """Classes written as an indented JSON array and read back as rows."""
    path = f"{shared_dir(spark)}/classes.json"
    sinks.write_json(trajectory.class_summary(fixture.tracks(spark, sf_dir)), path)
    return tables.read_rows_json(spark, path, "class_name string, n_rows bigint, n_tracks bigint")


@query
def document_json(spark, sf_dir):
    """Bounds of the record written as a nested JSON document; values read back at key paths, one of which is absent."""
    path = f"{shared_dir(spark)}/bounds.json"
    (bounds,) = sinks.document(trajectory.frame_bounds(fixture.tracks(spark, sf_dir)))
    sinks.write_json({"record": {"bounds": bounds}, "kind": "tracks"}, path)
    return tables.read_document_json(spark, path, "record.bounds.last_frame", "record.bounds.n_frames", "kind", "record.none")


@query
def first_frames(spark, sf_dir):
    """The first 20 of every fifth frame."""
    return frames.strided(fixture.tracks(spark, sf_dir), 5, 20)


@query
def repeated_farthest(spark, sf_dir):
    """Of rows that share a track in a frame the farthest from the sensor counts."""
    seen_ = vis.classified(vis.visibility(fixture.repeated(fixture.tracks(spark, sf_dir)), egos.grid(spark)))
    return seen_.select("frame_idx", "ego_id", "track_id", "rng", "reason", "occluded_by")


@query
def object_spans(spark, sf_dir):
    """The smallest arc that covers an object's corners, from every pose."""
    rows = vis.with_egos(vis.prepared(fixture.tracks(spark, sf_dir)), egos.grid(spark), c.SENSOR, False)
    return rows.withColumn("span", geometry.span_of_four(*(F.col(f"rel{i}") for i in range(4)))).select("frame_idx", "ego_id", "track_id", "span.start", "span.stop")
