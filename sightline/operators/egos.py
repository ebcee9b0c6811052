"""Ego relations: (ego_id, approach, pos, ego_x, ego_y, ego_h) for grids; with frame_idx and ego_track_id for vehicles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from .config import CENTRE, EGO_CLASSES, LANES


#: Poses of a grid that every frame meets.
MOST_POSES = 10_000


def few(poses: DataFrame) -> DataFrame:
    """The grid, marked for broadcast after a check of its size."""
    if poses.limit(MOST_POSES + 1).count() > MOST_POSES:
        raise ValueError(f"more than {MOST_POSES} poses for every frame; give egos a frame_idx instead")
    return F.broadcast(poses)


def grid(spark: SparkSession, lanes: Sequence[tuple] = LANES, positions: int | None = None) -> DataFrame:
    """The hypothetical poses, evenly spaced on approach lanes with both ends included; numbered lane by lane."""
    names = ("approach", "x0", "y0", "x1", "y1", "heading_deg")
    counts = [positions or lane[-1] for lane in lanes]
    values = [F.struct(F.lit(sum(counts[:k])).alias("first"), F.lit(n).alias("n"), *(F.lit(v).alias(c) for c, v in zip(names, lane, strict=False))) for k, (lane, n) in enumerate(zip(lanes, counts, strict=True))]
    table = spark.range(1).select(F.inline(F.array(*values)))
    poses = table.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1))
    along = lambda a, b: F.col(a) + share * (F.col(b) - F.col(a))
    return poses.select((F.col("first") + F.col("pos")).alias("ego_id"), "approach", "pos", along("x0", "x1").alias("ego_x"), along("y0", "y1").alias("ego_y"), F.radians("heading_deg").alias("ego_h"))


def vehicles(tracks: DataFrame, heading: str = "yaw", classes: Sequence[str] | None = EGO_CLASSES, centre: tuple[float, float] = CENTRE) -> DataFrame:
    """Every detected vehicle (with classes None: every object) as an ego, heading along its yaw or at the centre."""
    if heading not in ("yaw", "inward"):
        raise ValueError(f"heading {heading!r}")
    dx, dy = F.lit(centre[0]) - F.col("bbox_center_x"), F.lit(centre[1]) - F.col("bbox_center_y")
    to_centre = F.atan2(dy, dx)
    chosen = tracks.where(F.col("class_name").isin(*classes)) if classes else tracks
    return chosen.select(
        "frame_idx", F.col("track_id").alias("ego_track_id"), F.col("bbox_center_x").alias("ego_x"), F.col("bbox_center_y").alias("ego_y"),
        (to_centre if heading == "inward" else F.col("bbox_yaw")).alias("ego_h"),
        g.distance(dx, dy).alias("ego_dist_to_center"),
        (F.abs(g.wrap(to_centre - F.col("bbox_yaw"))) < F.lit(g.TWO_PI / 4)).alias("ego_inbound"),
    )
