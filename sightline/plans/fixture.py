"""A scene derived from the events table: tracks and near misses as pure functions of event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The text is for both engines; {div} is their integer division. Exponents make literals doubles in both.
_HELPERS = """
SELECT e AS event_id, e {div} 12 AS frame_idx, t AS track_id, t % 4 AS ap, t % 20 AS kind,
       (29 * t) % 37 * 71e-2 + (e {div} 12) % 50 * 1e-1 * (11e-1 + (13 * t) % 17 * 53e-2) AS s, (11 * t) % 13 * 47e-2 - 13e-1 AS lat
FROM (SELECT CAST(event_id AS BIGINT) AS e, CAST(event_id AS BIGINT) {div} 600 * 12 + CAST(event_id AS BIGINT) % 12 AS t FROM events) AS base
"""
_TRACKS = """
SELECT frame_idx, track_id,
       CASE WHEN kind < 12 THEN 'car' WHEN kind < 15 THEN 'truck' WHEN kind < 18 THEN 'pedestrian' ELSE 'bicycle' END AS class_name,
       CASE ap WHEN 0 THEN 53e-1 + lat WHEN 1 THEN 82e-1 + lat WHEN 2 THEN 40e0 - s ELSE -25e0 + s END AS bbox_center_x,
       CASE ap WHEN 0 THEN 40e0 - s WHEN 1 THEN -20e0 + s WHEN 2 THEN 86e-1 + lat ELSE 54e-1 + lat END AS bbox_center_y,
       CASE WHEN kind < 12 THEN 45e-1 WHEN kind < 15 THEN 87e-1 WHEN kind < 18 THEN 7e-1 ELSE 18e-1 END AS bbox_dx,
       CASE WHEN kind < 12 THEN 19e-1 WHEN kind < 15 THEN 26e-1 WHEN kind < 18 THEN 7e-1 ELSE 6e-1 END AS bbox_dy,
       CASE WHEN kind < 12 THEN 16e-1 WHEN kind < 15 THEN 33e-1 ELSE 17e-1 END AS bbox_dz,
       CASE ap WHEN 0 THEN -15707963267948966e-16 WHEN 1 THEN 15707963267948966e-16 WHEN 2 THEN 3141592653589793e-15 ELSE 0e0 END + ((17 * event_id) % 11 - 5) * 1e-2 AS bbox_yaw,
       3e-1 + (37 * event_id) % 66 * 1e-2 AS score
FROM helpers
"""
_RAW_NAME = "CASE {p}.class_name WHEN 'car' THEN 'Car' WHEN 'truck' THEN 'Truck' WHEN 'pedestrian' THEN 'Pedestrian' ELSE 'Bike' END"
_NEAR_MISSES = f"""
SELECT frame_idx, track_id_a, track_id_b, class_a, class_b, CASE WHEN (track_id_a + track_id_b) % 5 = 0 THEN NULL ELSE 2e-1 + 31e-2 * d END AS ttc, d AS min_separation
FROM (SELECT a.frame_idx, a.track_id AS track_id_a, b.track_id AS track_id_b, {_RAW_NAME.format(p="a")} AS class_a, {_RAW_NAME.format(p="b")} AS class_b,
             sqrt((a.bbox_center_x - b.bbox_center_x) * (a.bbox_center_x - b.bbox_center_x) + (a.bbox_center_y - b.bbox_center_y) * (a.bbox_center_y - b.bbox_center_y)) AS d
      FROM tracks AS a JOIN tracks AS b ON a.frame_idx = b.frame_idx AND a.track_id < b.track_id) AS pairs
WHERE d < 3e0
"""


def duck_ctes() -> str:
    """The CTEs helpers, tracks and nm for DuckDB."""
    return f"helpers AS ({_HELPERS.format(div='//')}), tracks AS ({_TRACKS}), nm_raw AS ({_NEAR_MISSES}), nm AS (SELECT * REPLACE (replace(lower(class_a), 'bike', 'bicycle') AS class_a, replace(lower(class_b), 'bike', 'bicycle') AS class_b) FROM nm_raw)"


#: Events are dealt to frames in order.
OBJECTS_PER_FRAME = 12


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks_of(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))


def tracks_of(spark: SparkSession, events: DataFrame) -> DataFrame:
    from ..sources.tables import tracks as usable

    helpers = _sql(spark, _HELPERS.format(div="div"), events=events.select("event_id"))
    return usable(_sql(spark, _TRACKS, helpers=helpers))


#: Every track with a number divisible by 7 stands in its frame a second time, 6 m and 3 m off.
_REPEATED = "SELECT * FROM tracks UNION ALL SELECT * REPLACE (bbox_center_x + 6e0 AS bbox_center_x, bbox_center_y + 3e0 AS bbox_center_y) FROM tracks WHERE track_id % 7 = 0"


def repeated(scene: DataFrame) -> DataFrame:
    """The scene with some tracks twice in a frame."""
    twice = scene.where("track_id % 7 = 0").withColumns({"bbox_center_x": F.col("bbox_center_x") + 6.0, "bbox_center_y": F.col("bbox_center_y") + 3.0})
    return scene.unionByName(twice)


def near_misses(spark: SparkSession, scene: DataFrame, normalize: bool = True) -> DataFrame:
    from ..sources.tables import near_misses as usable

    return usable(_sql(spark, _NEAR_MISSES, tracks=scene), normalize)


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **tables)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, counts as longs: what both engines agree on."""
    return df.select(*((F.round(c, places) if t == "double" else F.col(c).cast("long") if t == "int" else F.col(c)).alias(c) for c, t in df.dtypes))
