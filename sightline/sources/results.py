"""Typed reads of results written earlier: sweep records, sensitivity tables, range rows and near-miss summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import conform, read_document_json, read_rows_json


def _schema(longs: str, doubles: str, strings: str) -> T.StructType:
    kinds = ((strings, T.StringType()), (longs, T.LongType()), (doubles, T.DoubleType()))
    return T.StructType([T.StructField(c, kind) for names, kind in kinds for c in names.split()])


RECORD = _schema(
    "frame_idx n_objects_total n_visible_onboard n_occluded n_out_of_fov n_out_of_range n_nearby_total n_nearby_visible n_conflict_zone_total n_conflict_zone_visible"
    " nm_total nm_both_visible nm_at_least_one_visible nm_ego_relevant nm_ego_relevant_aware nm_detectable_onboard nm_detectable_cooperative",
    "ego_x ego_y ego_heading_deg visibility_ratio_onboard visibility_ratio_cooperative nearby_visibility_ratio conflict_zone_visibility_ratio",
    "approach class_visibility",
)
SENSITIVITY = _schema("", "fov_deg range_m visibility_mean visibility_median cooperative_benefit nm_detectability_onboard nm_detectability_cooperative vis_north vis_south vis_east vis_west", "")
RANGES = _schema("", "fov_deg range_m int_wide nearby conflict total", "")
RATES = tuple(f"ttc.fov_{fov}.{name}" for fov in (120, 360) for name in ("n_event_frames", "n_unique_pairs", "partner_visible_rate", "reason_breakdown"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The 26 columns of a sweep's observations; columns of near misses and classes may be missing and are null then."""
    optional = [f.name for f in RECORD if f.name.startswith("nm_") or f.name == "class_visibility"]
    return conform(spark.read.parquet(path), RECORD, optional)


def read_sensitivity(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), SENSITIVITY, [f.name for f in SENSITIVITY if f.name.startswith(("vis_", "nm_"))])


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The flat JSON rows of a range sweep."""
    return conform(read_rows_json(spark, path, RANGES), RANGES)


def read_near_miss_rates(spark: SparkSession, path: str) -> DataFrame:
    """One row with the rates and breakdowns of a near-miss summary, by field of view; null where one is missing."""
    return read_document_json(spark, path, *RATES)


def read_grid_baseline(spark: SparkSession, path: str, fov_deg: float, poses: int = 60) -> DataFrame:
    """The grid's row of a comparison with vehicles as egos, from a document with totals by field of view.

    The document: {"configs": {"120": {frames, int_wide, nearby, conflict, occluded, out_fov, out_range, total}, ...}}; a field of
    view that it has not gives a row of nulls, named so.
    """
    means = ("int_wide", "nearby", "conflict", "occluded", "out_fov", "out_range", "total")
    schema = f"configs map<string, struct<frames: bigint, {', '.join(f'{m}: double' for m in means)}>>"
    key = f"{fov_deg:g}"
    found = read_rows_json(spark, path, schema).select(F.try_element_at("configs", F.lit(key)).alias("c"))
    name = F.when(F.col("c").isNull(), f"grid (no {key} degree baseline)").otherwise("grid")
    return found.select(name.alias("design"), (F.col("c.frames") * poses).alias("n_obs"), *(F.col(f"c.{m}").alias(m) for m in means))
