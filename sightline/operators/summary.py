"""Summaries over observations, tables over configurations, and the inputs of figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import APPROACHES, REASONS, REGION_M
from .observe import ratio

MEANS = {
    "int_wide": "visibility_ratio_onboard", "nearby": "nearby_visibility_ratio", "conflict": "conflict_zone_visibility_ratio",
    "total": "n_objects_total", "visible": "n_visible_onboard", "occluded": "n_occluded", "out_fov": "n_out_of_fov", "out_range": "n_out_of_range",
}


def _means(names: Sequence[str]) -> list:
    return [F.avg(MEANS[n]).alias(n) for n in names]


def sweep_summary(observed: DataFrame) -> DataFrame:
    """One row: frames, observations and all means."""
    return observed.agg(F.count_distinct("frame_idx").alias("frames"), F.count("*").alias("n_obs"), *_means(list(MEANS)), F.avg("n_nearby_total").alias("nearby_total"), F.avg("n_nearby_visible").alias("nearby_visible"))


def by_approach(observed: DataFrame) -> DataFrame:
    v = "visibility_ratio_onboard"
    return observed.groupBy("approach").agg(F.count("*").alias("n_obs"), F.avg(v).alias("mean_visibility"), F.median(v).alias("median_visibility"), F.stddev_samp(v).alias("std_visibility"), F.avg("nearby_visibility_ratio").alias("mean_nearby_visibility"))


def detectability(observed: DataFrame, *keys: str) -> DataFrame:
    """Rates over all near misses; infrastructure sees all by assumption."""
    totals = observed.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("nm_total", "nm_both_visible", "nm_at_least_one_visible", "nm_ego_relevant", "nm_ego_relevant_aware")))
    return totals.withColumns({
        "both_visible_rate": ratio("nm_both_visible", "nm_total"), "at_least_one_visible_rate": ratio("nm_at_least_one_visible", "nm_total"),
        "ego_relevant_awareness_rate": ratio("nm_ego_relevant_aware", "nm_ego_relevant"), "cooperative_rate": F.lit(1.0),
    })


def sensitivity(observed: DataFrame, approaches: Sequence[str] = APPROACHES) -> DataFrame:
    """Per field of view and range: mean, median, benefit of cooperation, detectability, and a column per approach."""
    v = F.col("visibility_ratio_onboard")
    rate = F.coalesce(F.try_divide(F.sum("nm_detectable_onboard").cast("double"), F.sum("nm_total").cast("double")), F.lit(0.0))
    lanes = [F.avg(F.when(F.col("approach") == a, v)).alias(f"vis_{a}") for a in approaches]
    return observed.groupBy("fov_deg", "range_m").agg(F.avg(v).alias("visibility_mean"), F.median(v).alias("visibility_median"), (1.0 - F.avg(v)).alias("cooperative_benefit"), rate.alias("nm_detectability_onboard"), F.lit(1.0).alias("nm_detectability_cooperative"), *lanes)


def matrix(table: DataFrame, ranges: Sequence[float], value: str = "visibility_mean") -> DataFrame:
    """Fields of view down, ranges across, as columns r<range>."""
    return table.groupBy("fov_deg").agg(*(F.max(F.when(F.col("range_m") == r, F.col(value))).alias(f"r{r:g}") for r in ranges))


def range_sensitivity(observed: DataFrame) -> DataFrame:
    return observed.groupBy("fov_deg", "range_m").agg(*_means(("int_wide", "nearby", "conflict", "total")))


def vehicle_summary(observed: DataFrame, region_m: float = REGION_M) -> DataFrame:
    """All vehicle egos, those within the region, and those of them that head inwards: one grouping of tagged copies."""
    inside = F.col("ego_dist_to_center") <= region_m
    tags = F.array_compact(F.array(F.lit("all"), F.when(inside, F.lit("region")), F.when(inside & F.col("ego_inbound"), F.lit("region_inbound"))))
    tagged = observed.withColumn("subset", F.explode(tags))
    out = tagged.groupBy("subset").agg(F.count("*").alias("n_obs"), F.count_distinct("frame_idx").alias("frames"), *_means(list(MEANS)))
    return out.withColumn("mean_ego_per_frame", F.col("n_obs") / F.greatest(F.col("frames"), F.lit(1)))


def inbound_share(observed: DataFrame, region_m: float = REGION_M) -> DataFrame:
    return observed.where(F.col("ego_dist_to_center") <= region_m).agg(F.avg(F.col("ego_inbound").cast("double")).alias("inbound_share"))


def design_comparison(grid_summary: DataFrame, vehicle_summaries: DataFrame, name: Column | None = None) -> DataFrame:
    """The grid's row, under a name, over those of the vehicle designs."""
    cols = ["n_obs", "int_wide", "nearby", "conflict", "occluded", "out_fov", "out_range", "total"]
    grid = grid_summary.select((F.lit("grid") if name is None else name).alias("design"), *cols)
    return grid.unionByName(vehicle_summaries.select(F.concat(F.lit("vehicle_"), "subset").alias("design"), *cols))


def object_decomposition(observed: DataFrame) -> DataFrame:
    """Per field of view: mean numbers of objects seen, hidden, out of view and out of range."""
    return observed.groupBy("fov_deg").agg(*_means(("visible", "occluded", "out_fov", "out_range")))


def fov_slice(sensitivities: DataFrame, ranges: DataFrame, range_m: float = 35.0, wide: float = 360.0) -> DataFrame:
    """Visibility against field of view at one range; the full circle comes from the range table."""
    a = sensitivities.where(F.col("range_m") == range_m).select("fov_deg", F.col("visibility_mean").alias("visibility"))
    b = ranges.where((F.col("range_m") == range_m) & (F.col("fov_deg") == wide)).select("fov_deg", F.col("int_wide").alias("visibility"))
    return a.unionByName(b)


def range_series(ranges: DataFrame, fov_deg: float, key: str) -> DataFrame:
    return ranges.where(F.col("fov_deg") == fov_deg).select("range_m", F.col(key).alias("value")).orderBy("range_m")


def near_miss_figure(ttc: DataFrame) -> DataFrame:
    """The near-miss figure's bars from the summary per field of view: (panel, bar, part, bottom, height).

    Panel a has a bar of the partner's visible rate for each field of view and one of 1 for cooperation; panel b stacks the
    four reasons for each field of view, each part on the ones before it.
    """
    bar = F.concat(F.lit("fov_"), F.col("fov_deg").cast("int").cast("string"))
    part = lambda panel, name, text, bottom, height: F.struct(F.lit(panel).alias("panel"), name.alias("bar"), F.lit(text).alias("part"), bottom.alias("bottom"), height.alias("height"))
    zero, stacked = F.lit(0.0), []
    bottom = zero
    for reason in REASONS:
        height = F.coalesce(F.col(f"share_{reason}"), zero)
        stacked.append(part("b", bar, reason, bottom, height))
        bottom = bottom + height
    parts = ttc.select(F.explode(F.array(part("a", bar, "visible", zero, F.col("partner_visible_rate")), *stacked)).alias("p")).select("p.*")
    together = ttc.sparkSession.range(1).select(part("a", F.lit("cooperative"), "visible", zero, F.lit(1.0)).alias("p")).select("p.*")
    return parts.unionByName(together)
