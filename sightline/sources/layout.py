"""Tracks stored in buckets of frames: objects of a frame stand in one file, in order, and are not dealt again to meet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import TRACKS


def store_frames(tracks: DataFrame, path: str, buckets: int) -> None:
    """Writes tracks to path as a table of so many buckets, rows in order of frames within; an existing one is overwritten.

    Choose buckets by size: a task reads one whole bucket. Row groups hold stretches of frames, so windows of frames skip the rest.
    """
    spark, name = tracks.sparkSession, f"frames_{uuid.uuid4().hex}"
    # dealt as the buckets are, each task writes one file
    dealt = tracks.select(*TRACKS.names).repartition(buckets, "frame_idx")
    dealt.write.mode("overwrite").bucketBy(buckets, "frame_idx").sortBy("frame_idx", "track_id").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay


def stored_frames(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The tracks that store_frames wrote to path with so many buckets."""
    name = f"frames_{uuid.uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRACKS)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING PARQUET LOCATION '{path}' CLUSTERED BY (frame_idx) SORTED BY (frame_idx, track_id) INTO {buckets} BUCKETS")
    return spark.table(name)
