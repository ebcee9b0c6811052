"""Keeps the record of what every pose of the grid observes, frame by frame, as tracks arrive.

    python -m jobs.observe --tracks TRACKS --near-misses NEAR --out OUT
    python -m jobs.observe --events EVENTS --out OUT

OUT/records has a partition for each slab of frames, in order within; OUT/mark says up to where it is done: slabs before
the open one are final, the open one is made anew when more of its frames have come. A run reads only frames from the
open slab on, writes only those slabs, by overwriting their partitions, and then appends a mark. A run that dies leaves the
old mark, and the next one writes the same slabs again. Frames are taken in order: rows for a slab that is already final
come in with --since.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sightline.operators import egos, observe
from sightline.plans import fixture
from sightline.sources import tables

from .common import config_of, log_of, started

MARK = StructType([StructField(c, LongType()) for c in ("open_slab", "last_frame", "n_rows")])
LOG = log_of("observe")


def scene_from(spark: SparkSession, first_frame: int, tracks: str | None = None, near_misses: str | None = None, events: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tracks and near misses from a frame on, read from their tables or derived from a table of events.

    The limit goes into the scan: files and row groups of earlier frames are not read.
    """
    if events:
        own = fixture.tracks_of(spark, spark.read.parquet(events).where(F.col("event_id") >= first_frame * fixture.OBJECTS_PER_FRAME))
        return own, fixture.near_misses(spark, own)
    from_there = F.col("frame_idx") >= first_frame
    return tables.tracks(spark.read.parquet(tracks).where(from_there)), tables.near_misses(spark.read.parquet(near_misses).where(from_there))


def run(spark: SparkSession, out: str, tracks: str | None = None, near_misses: str | None = None, events: str | None = None, config: dict | None = None, since: int | None = None) -> dict:
    """One run; returns what it read and wrote. since: the slab to make anew from, in place of the mark's."""
    config = config or config_of("observe")
    frames = config["slab_frames"]
    mark = tables.left_by(spark, f"{out}/mark", MARK).orderBy(F.desc("open_slab"), F.desc("n_rows")).first()
    first = since if since is not None else mark["open_slab"] if mark else 0
    scene, near = scene_from(spark, first * frames, tracks, near_misses, events)
    seen = scene.agg(F.count("*").alias("n_rows"), F.max("frame_idx").alias("last_frame")).first()
    LOG.info("mark %s; read %s rows of tracks from frame %s on, up to frame %s", tuple(mark) if mark else "none", seen["n_rows"], first * frames, seen["last_frame"])
    if not seen["n_rows"] or since is None and mark and (seen["n_rows"], seen["last_frame"]) == (mark["n_rows"], mark["last_frame"]):
        LOG.info("nothing new")
        return {"read": seen["n_rows"], "slabs": 0, "written": 0}
    record = observe.sweep(scene, near, egos.grid(spark, positions=config["positions"]), config["fovs"], [config["range_m"]], classes=True)
    record = record.withColumns({"class_visibility": observe.class_json(F.col("class_visibility")), "slab": F.floor(F.col("frame_idx") / frames)})
    # a slab is a bounded number of frames, so a task holds whole slabs and each has one file, in order
    dealt = record.repartition("slab").sortWithinPartitions("slab", "frame_idx", "approach", "pos", "fov_deg")
    dealt.write.partitionBy("slab").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{out}/records")
    last = seen["last_frame"] // frames
    in_open = scene.where(F.col("frame_idx") >= last * frames).count()
    spark.createDataFrame([(last, seen["last_frame"], in_open)], MARK).coalesce(1).write.mode("append").parquet(f"{out}/mark")
    written = records(spark, out).where(F.col("slab") >= first).count()
    LOG.info("wrote %s observations in slabs %s to %s; open slab %s has %s rows", written, first, last, last, in_open)
    return {"read": seen["n_rows"], "slabs": last - first + 1, "written": written}


def records(spark: SparkSession, out: str) -> DataFrame:
    """The whole record as it stands."""
    made = spark.read.parquet(f"{out}/records")
    return made.withColumn("slab", F.col("slab").cast("long"))


def main(arguments: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="jobs.observe", description="Keep the record of observations up to date.")
    p.add_argument("--tracks", help="Parquet of tracked objects")
    p.add_argument("--near-misses", help="Parquet of near misses, with --tracks")
    p.add_argument("--events", help="Parquet of events from which a scene is derived, instead of --tracks")
    p.add_argument("--out", required=True)
    p.add_argument("--since", type=int, help="make slabs from this one on anew")

    def act(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
        if bool(a.events) == bool(a.tracks and a.near_misses):
            p.error("give either --events or both --tracks and --near-misses")
        return run(spark, a.out, a.tracks, a.near_misses, a.events, config, a.since)

    return started(p, "observe", act, arguments)


if __name__ == "__main__":
    main()
