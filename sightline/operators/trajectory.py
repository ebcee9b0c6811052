"""Statistics of trajectories and near misses: speeds, sizes, durations, arrivals, episodes of following."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import written
from .config import FRAME_S
from .quantiles import summarised

#: Frames of a slab: a task sorts a track's rows of one slab, and borders of slabs carry over. An hour at 10 Hz.
SLAB = 36_000


def slab_of(frame: Column, slab: int = SLAB) -> Column:
    return F.floor(frame / slab)


def speeds(tracks: DataFrame, dt: float = FRAME_S, slab: int = SLAB) -> DataFrame:
    """Adds speed_mps from each row's previous frame of its track; null for the first and for repeated frames.

    Rows are put in order by track and slab; each slab's first row takes the last one of the slab before from a table with one row
    for each track and slab. Rows of one frame of a track are ordered by place.
    """
    place = F.struct("frame_idx", "bbox_center_x", "bbox_center_y")
    rows = tracks.withColumn("_slab", slab_of(F.col("frame_idx"), slab))
    ends = rows.groupBy("track_id", "_slab").agg(F.max(place).alias("_end"))
    carried = ends.select("track_id", "_slab", F.lag("_end").over(Window.partitionBy("track_id").orderBy("_slab")).alias("_carried"))
    w = Window.partitionBy("track_id", "_slab").orderBy("frame_idx", "bbox_center_x", "bbox_center_y")
    met = rows.join(carried, ["track_id", "_slab"], "left").withColumn("_before", F.coalesce(F.lag(place).over(w), F.col("_carried")))
    step = lambda c: F.col(c) - F.col("_before")[c]
    speed = F.try_divide(g.distance(step("bbox_center_x"), step("bbox_center_y")), step("frame_idx") * dt)
    return met.select(*tracks.columns, speed.alias("speed_mps"))


def speed_summary(with_speeds: DataFrame) -> DataFrame:
    """Per class with any speed: mean, median, sample deviation, 5th and 95th percentiles (interpolated)."""
    s = F.col("speed_mps")
    rows = written(with_speeds.where(s.isNotNull()).select("class_name", s), "speeds")
    return summarised(rows, ["class_name"], [F.avg(s).alias("mean"), F.stddev_samp(s).alias("std")], {"speed_mps": {"median": 0.5, "p05": 0.05, "p95": 0.95}})


def dimension_summary(tracks: DataFrame) -> DataFrame:
    long = written(tracks.unpivot(["class_name"], ["bbox_dx", "bbox_dy", "bbox_dz"], "dimension", "value"), "dimensions")
    return summarised(long, ["class_name", "dimension"], [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")], {"value": {"median": 0.5}})


def class_summary(tracks: DataFrame) -> DataFrame:
    """Per class: rows and tracks."""
    return tracks.groupBy("class_name", "track_id").agg(F.count("*").alias("n")).groupBy("class_name").agg(F.sum("n").alias("n_rows"), F.count("track_id").alias("n_tracks"))


def track_lengths(tracks: DataFrame) -> DataFrame:
    """Per class: statistics of frames per track."""
    n = F.col("n").cast("double")
    lengths = written(tracks.groupBy("class_name", "track_id").agg(F.count("*").alias("n")).select("class_name", "n"), "lengths")
    return summarised(lengths, ["class_name"], [F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min("n").alias("min"), F.max("n").alias("max")], {"n": {"median": 0.5}})


def arrival_rates(tracks: DataFrame, dt: float = FRAME_S) -> DataFrame:
    """Per class: tracks per minute of the record, and the sum over classes of the rates rounded to two places."""
    whole = tracks.agg(F.count_distinct("frame_idx").alias("total_frames"))
    per = tracks.groupBy("class_name").agg(F.count_distinct("track_id").alias("n_tracks")).crossJoin(F.broadcast(whole))
    minutes = F.col("total_frames") * dt / 60.0
    rated = per.withColumns({"duration_minutes": minutes, "tracks_per_minute": F.col("n_tracks") / minutes})
    total = rated.agg(F.sum(F.round("tracks_per_minute", 2)).alias("total_tracks_per_minute"))
    return rated.crossJoin(F.broadcast(total))


def frame_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count_distinct("frame_idx").alias("n_frames"))


def pair_types(near_misses: DataFrame) -> DataFrame:
    """Near misses (with normalised classes) per unordered pair of classes, most frequent first."""
    pair = F.concat_ws("-", F.least("class_a", "class_b"), F.greatest("class_a", "class_b"))
    return near_misses.groupBy(pair.alias("pair_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair_type")


def ttc_stats(near_misses: DataFrame) -> DataFrame:
    c = F.col("ttc")
    return summarised(written(near_misses.select(c), "ttc"), [], [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min")], {"ttc": {"median": 0.5, "p05": 0.05, "p95": 0.95}})


def separation_stats(near_misses: DataFrame) -> DataFrame:
    c = F.col("min_separation")
    return summarised(written(near_misses.select(c), "separation"), [], [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min")], {"min_separation": {"median": 0.5}})


def following(tracks: DataFrame, range_m: float = 15.0, cone_deg: float = 30.0, least_m: float = 0.5, follower: str = "car", leader: str = "truck") -> DataFrame:
    """Rows of followers with a leader of the frame within range and cone ahead.

    A frame's leaders become one array, so that followers are not multiplied by them.
    """
    leaders = tracks.where(F.col("class_name") == leader).groupBy("frame_idx").agg(F.collect_list(F.struct(F.col("bbox_center_x").alias("x"), F.col("bbox_center_y").alias("y"))).alias("_l"))

    def ahead(p):
        dx, dy = p["x"] - F.col("bbox_center_x"), p["y"] - F.col("bbox_center_y")
        d = g.distance(dx, dy)
        return (d < range_m) & (d > least_m) & (F.abs(g.wrap(F.atan2(dy, dx) - F.col("bbox_yaw"))) < F.radians(F.lit(cone_deg)))

    return tracks.where(F.col("class_name") == follower).join(leaders, "frame_idx").where(F.exists("_l", ahead)).drop("_l")


def episodes(rows: DataFrame, dt: float = FRAME_S, slab: int = SLAB) -> DataFrame:
    """Runs of consecutive frames per track: (track_id, first_frame, n_frames, seconds). Repeated frames count once.

    Runs are found within slabs; only those that reach a border of their slab, two for each track and slab at most, meet those
    of the next one.
    """
    w = Window.partitionBy("track_id", "_slab").orderBy("frame_idx")
    island = rows.select("track_id", "frame_idx", slab_of(F.col("frame_idx"), slab).alias("_slab")).withColumn("_island", F.col("frame_idx") - F.dense_rank().over(w))
    runs = island.groupBy("track_id", "_slab", "_island").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("_last")).withColumn("_from", F.col("_slab") * slab)
    at_border = (F.col("first_frame") == F.col("_from")) | (F.col("_last") == F.col("_from") + slab - 1)
    w = Window.partitionBy("track_id").orderBy("first_frame")
    starts = F.coalesce(F.col("first_frame") != F.lag("_last").over(w) + 1, F.lit(True))
    joined = runs.where(at_border).withColumn("_run", starts).withColumn("_run", F.sum(F.col("_run").cast("int")).over(w)).groupBy("track_id", "_run").agg(F.min("first_frame").alias("first_frame"), F.max("_last").alias("_last"))
    whole = runs.where(~at_border).select("track_id", "first_frame", "_last").unionByName(joined.drop("_run"))
    n = F.col("_last") - F.col("first_frame") + 1
    return whole.select("track_id", "first_frame", n.alias("n_frames"), (n * dt).alias("seconds"))


def episode_stats(runs: DataFrame) -> DataFrame:
    s, n = F.col("seconds"), F.col("n_frames")
    rows = written(runs.select("seconds", "n_frames"), "episodes")
    totals = [F.count("*").alias("n"), F.avg(s).alias("mean"), F.max(s).alias("max"), F.avg((n >= 20).cast("double")).alias("share_2s"), F.avg((n >= 50).cast("double")).alias("share_5s")]
    return summarised(rows, [], totals, {"seconds": {"median": 0.5, "p90": 0.9}})
