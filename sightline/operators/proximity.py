"""Bias from hypothetical egos that stand too near to real vehicles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .config import CLEARANCES, OCCLUDERS, PROXIMITY_EDGES, sensor_with


def vehicles_of(tracks: DataFrame, classes: Sequence[str] = OCCLUDERS) -> DataFrame:
    """(frame_idx, _v): a frame's vehicles as one array."""
    return tracks.where(F.col("class_name").isin(*classes)).groupBy("frame_idx").agg(F.collect_list(F.struct(F.col("bbox_center_x").alias("x"), F.col("bbox_center_y").alias("y"))).alias("_v"))


def nearest_vehicle(observations: DataFrame, tracks: DataFrame, sensor: dict[str, float] | None = None, classes: Sequence[str] = OCCLUDERS) -> DataFrame:
    """Adds d_sensor and d_center, distances to the nearest vehicle's centre; null in frames without a vehicle.

    observations: frame_idx, ego_x, ego_y, ego_heading_deg. A frame's vehicles become one array, so that observations
    are not multiplied by them; where observations have brought it along (see `vehicles_of`), nothing is joined.
    """
    sensor = sensor_with(sensor)
    sx, sy = g.sensor_position(F.col("ego_x"), F.col("ego_y"), F.radians("ego_heading_deg"), sensor["forward_m"], sensor["left_m"])
    met = observations.withColumns({"_sx": sx, "_sy": sy})
    if "_v" not in observations.columns:
        met = met.join(vehicles_of(tracks, classes), "frame_idx", "left")
    near = lambda x, y: F.array_min(F.transform("_v", lambda p: g.distance(F.col(x) - p["x"], F.col(y) - p["y"])))
    return met.withColumns({"d_sensor": near("_sx", "_sy"), "d_center": near("ego_x", "ego_y")}).drop("_v", "_sx", "_sy")


def distance_bin(d: Column, edges: Sequence[float] = PROXIMITY_EDGES) -> Column:
    """The label of the half-open bin; null beyond the edges and for null."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        label = f"[{lo:g},{hi:g})"
        out = F.when((d >= lo) & (d < hi) if math.isfinite(hi) else d >= lo, label).otherwise(out)
    return out


def bins(observations: DataFrame) -> DataFrame:
    """Per bin of d_sensor: observations, their percentage of all observations, and four means."""
    per = observations.withColumn("bin_m", distance_bin(F.col("d_sensor"))).groupBy("bin_m").agg(
        F.count("*").alias("n_obs"), F.avg("visibility_ratio_onboard").alias("mean_visibility"), F.avg("n_occluded").alias("mean_occluded"), F.avg("n_out_of_fov").alias("mean_out_of_fov"), F.avg("n_objects_total").alias("mean_total_obj")
    )
    # a window over the few bins, not over observations
    return per.withColumn("pct_obs", 100.0 * F.col("n_obs") / F.sum("n_obs").over(Window.partitionBy(F.lit(1)))).where("bin_m IS NOT NULL")


def clearance_correction(observations: DataFrame, clearances: Sequence[float] = CLEARANCES) -> DataFrame:
    """Mean visibility without observations whose ego is nearer than a clearance; clearance 0 is the baseline."""
    rules = observations.select("visibility_ratio_onboard", "d_center", F.explode(F.array(*(F.lit(float(c)) for c in (0.0, *clearances)))).alias("clearance_m"))
    keep = F.coalesce(F.col("d_center") >= F.col("clearance_m"), F.lit(True)) | (F.col("clearance_m") == 0)
    per = rules.groupBy("clearance_m").agg(F.count_if(keep).alias("n_kept"), (100.0 * (1 - F.count_if(keep) / F.count("*"))).alias("pct_dropped"), F.avg(F.when(keep, F.col("visibility_ratio_onboard"))).alias("int_wide_visibility"))
    base = F.max(F.when(F.col("clearance_m") == 0, F.col("int_wide_visibility"))).over(Window.partitionBy(F.lit(1)))
    return per.withColumn("delta", F.col("int_wide_visibility") - base)
