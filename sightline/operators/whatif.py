"""What-ifs, on all frames or on a sample: height of the line of sight, detection confidence, and what a lead vehicle hides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import CLASSES, CONFIDENCES, LEAD_BEARING_DEG, LEAD_RANGE_M, OCCLUDERS, SENSOR_HEIGHT_M, SENSOR_HEIGHTS
from .egos import few
from .observe import keys_of


def _list(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def clears(sensor_height: Column) -> Column:
    """Whether the line from the sensor to the target's top passes over the blocker's top."""
    ray = sensor_height + (F.col("height") - sensor_height) * (F.col("blocker_near") / F.col("rng"))
    return F.coalesce(ray >= F.col("blocker_height"), F.lit(False))


def vertical(seen: DataFrame, sensor_height: float = SENSOR_HEIGHT_M, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Per class and overall: objects, planar visibility, and visibility with those seen over their blocker."""
    rows = seen.where(F.col("class_name").isin(*classes))
    again = (F.col("reason") == "occluded") & clears(F.lit(float(sensor_height)))
    return rows.rollup("class_name").agg(F.count("*").alias("n"), F.avg(F.col("visible").cast("double")).alias("planar"), F.avg((F.col("visible") | again).cast("double")).alias("vertical")).withColumn("scope", F.coalesce(F.initcap("class_name"), F.lit("Overall"))).drop("class_name")


def height_curve(seen: DataFrame, heights: Sequence[float] = SENSOR_HEIGHTS, classes: Sequence[str] = CLASSES) -> DataFrame:
    rows = seen.where(F.col("class_name").isin(*classes)).withColumn("sensor_height_m", F.explode(_list(heights)))
    again = (F.col("reason") == "occluded") & clears(F.col("sensor_height_m"))
    return rows.groupBy("sensor_height_m").agg(F.avg((F.col("visible") | again).cast("double")).alias("visibility"))


def both_views(seen: DataFrame, tracks: DataFrame, egos: DataFrame, fovs: tuple[float, float] = (120.0, 360.0)) -> DataFrame:
    """(frame_idx, ego_id, track_id, score, v120, v360) for every object and ego; unseen where a view has no row.

    seen holds both fields of view, all rows or the visible ones alone; it is grouped and joined once.
    """
    views = scores_of_views(seen.where("visible"), fovs).drop("score")
    scene = tracks.select("frame_idx", "track_id", "score").crossJoin(few(egos.select("ego_id")))
    return scene.join(views, ["frame_idx", "ego_id", "track_id"], "left").na.fill(False, ["v120", "v360"])


def scores_of_views(seen: DataFrame, fovs: tuple[float, float] = (120.0, 360.0)) -> DataFrame:
    """`both_views` from one table of both fields of view, by one grouping: for scenes without repeated tracks."""
    views = [F.bool_or(F.when(F.col("fov_deg") == f, F.col("visible")).otherwise(False)).alias(n) for f, n in zip(fovs, ("v120", "v360"), strict=True)]
    return seen.groupBy("frame_idx", "ego_id", "track_id").agg(F.first("score").alias("score"), *views)


def _counted(views: DataFrame) -> DataFrame:
    """Views with n, the poses of a row, and the numbers of them that see it: rows of one pose each are given it."""
    return views if "n" in views.columns else views.withColumns({"n": F.lit(1).cast("long"), **{v: F.col(v).cast("long") for v in ("v120", "v360")}})


def _share(part: Column) -> Column:
    return F.try_divide(F.sum(part).cast("double"), F.sum("n").cast("double"))


def confidence_curve(views: DataFrame, taus: Sequence[float] = CONFIDENCES) -> DataFrame:
    """Per threshold: share of objects seen with enough confidence, at both fields of view and by infrastructure alone.

    views: rows of `visibility.rows_of_views` or counts of `visibility.times_seen`; so below.
    """
    rows = _counted(views).withColumn("tau", F.explode(_list(taus)))
    sure = lambda c: F.when(F.col("score") >= F.col("tau"), F.col(c)).otherwise(0)
    return rows.groupBy("tau").agg(*(_share(sure(c)).alias(n) for n, c in (("fov_120", "v120"), ("fov_360", "v360"), ("v2i", "n"))))


def ungated(views: DataFrame) -> DataFrame:
    return _counted(views).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), _share(F.col("v120")).alias("fov_120"), _share(F.col("v360")).alias("fov_360"))


def confidence_grid(views: DataFrame, taus: Sequence[float] = CONFIDENCES) -> DataFrame:
    """Share seen on board at one threshold or by infrastructure at another.

    The outcome depends only on the view and on how many thresholds the score reaches, so counts per such cell are
    crossed with the grid, not the rows.
    """
    reach = F.coalesce(F.size(F.filter(_list(taus), lambda t: t <= F.col("score"))), F.lit(0))
    cells = _counted(views).groupBy(reach.alias("reach")).agg(F.sum("v360").alias("seen"), F.sum("n").alias("n"))
    step = F.explode(F.sequence(F.lit(1), F.lit(len(taus))))
    grid = cells.withColumn("i", step).withColumn("j", step)
    on = F.when(F.col("reach") >= F.col("j"), F.col("n")).when(F.col("reach") >= F.col("i"), F.col("seen")).otherwise(0)
    value = lambda k: F.element_at(_list(taus), F.col(k))
    return grid.groupBy("i", "j").agg((F.sum(on) / F.sum("n")).alias("cooperative")).select(value("i").alias("tau_av"), value("j").alias("tau_rsu"), "cooperative")


def _blocker_class() -> Column:
    return F.when(F.col("reason") == "occluded", F.coalesce("blocker_class", F.lit("car")))


def occlusion_shadow(seen: DataFrame, classes: Sequence[str] = OCCLUDERS) -> DataFrame:
    """Per occluder class: occluders that hid anything, objects hidden, and objects hidden per such occluder."""
    hidden = seen.where(F.col("reason") == "occluded").withColumn("occluder_class", _blocker_class())
    per = hidden.groupBy(*keys_of(seen), "occluded_by", "occluder_class").agg(F.count("*").alias("hidden"))
    return per.where(F.col("occluder_class").isin(*classes)).groupBy("occluder_class").agg(F.count("*").alias("n_occluders"), F.sum("hidden").alias("n_hidden"), F.avg("hidden").alias("shadow"))


def truck_share(seen: DataFrame) -> DataFrame:
    c = _blocker_class()
    return seen.agg(F.count_if(c == "truck").alias("by_truck"), F.count_if(c.isin(*OCCLUDERS)).alias("by_all")).withColumn("truck_share", F.try_divide(F.col("by_truck").cast("double"), F.col("by_all").cast("double")))


def lead_vehicles(seen: DataFrame, range_m: float = LEAD_RANGE_M, bearing_deg: float = LEAD_BEARING_DEG) -> DataFrame:
    """Per observation: class of the nearest visible vehicle ahead (null: none), objects, seen, and hidden by any truck."""
    ahead = F.col("class_name").isin(*OCCLUDERS) & F.col("visible") & (F.abs(F.degrees("rel")) < bearing_deg) & (F.col("rng") < range_m)
    return seen.groupBy(*keys_of(seen)).agg(
        F.min_by("class_name", F.when(ahead, F.struct("rng", "track_id"))).alias("lead_class"), F.count("*").alias("total"), F.count_if(F.col("visible")).alias("seen"),
        F.count_if(_blocker_class() == "truck").alias("hidden_by_trucks"),
    )


def lead_benefit(leads: DataFrame) -> DataFrame:
    """Per lead class: share of observations, mean visibility, and mean objects seen, behind trucks, otherwise hidden."""
    per = leads.groupBy("lead_class").agg(
        F.count("*").alias("n"), F.avg(F.col("seen") / F.col("total")).alias("visibility"), F.avg("seen").alias("mean_visible"), F.avg("hidden_by_trucks").alias("mean_hidden_by_trucks"), F.avg("total").alias("mean_total")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the few classes, none included
    return per.withColumns({"probability": share, "mean_other_hidden": F.greatest(F.col("mean_total") - F.col("mean_visible") - F.col("mean_hidden_by_trucks"), F.lit(0.0))}).where("lead_class IS NOT NULL")
