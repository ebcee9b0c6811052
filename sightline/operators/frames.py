"""Choosing frames: window, stride, limit, evenly spaced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_window(df: DataFrame, first: int = 0, last: int = 0) -> DataFrame:
    """Rows with first <= frame_idx <= last; 0 leaves a side open. Reaches the Parquet scan as a filter."""
    df = df.where(F.col("frame_idx") >= first) if first else df
    return df.where(F.col("frame_idx") <= last) if last else df


def ranked_frames(df: DataFrame) -> DataFrame:
    """(frame_idx, pos): distinct frames with their position from 0.

    Positions come from counts per range of frames, so no task sees all frames.
    """
    frames = df.select("frame_idx").distinct().withColumn("slab", F.floor(F.col("frame_idx") / 4096))
    counts = frames.groupBy("slab").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("slab").orderBy("frame_idx"))
    return frames.withColumn("rank", rank).join(before, "slab").select("frame_idx", (F.col("before") + F.col("rank") - 1).alias("pos"))


def strided(df: DataFrame, step: int = 1, limit: int = 0, first: int = 0, last: int = 0) -> DataFrame:
    """Every step-th of the window's frames, the first `limit` of those (0: all)."""
    pos = ranked_frames(in_window(df, first, last))
    out = pos.where(F.col("pos") % step == 0)
    if limit:
        out = out.where(F.col("pos") < step * limit)
    return out.select("frame_idx")


def evenly(df: DataFrame, k: int) -> DataFrame:
    """k frames (all, if fewer) at positions floor(i * (n - 1) / (k - 1)); the first alone for k = 1."""
    pos = ranked_frames(df)
    n = pos.agg(F.count("*").alias("n"))
    i = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(k)) - 1)).alias("i")).where("n > 0")
    wanted = i.select(F.expr(f"CASE WHEN least(n, {k}) = 1 THEN 0L ELSE i * (n - 1) div (least(n, {k}) - 1) END").alias("pos"))
    return pos.join(F.broadcast(wanted), "pos", "left_semi").select("frame_idx")


def of_frames(df: DataFrame, frames: DataFrame) -> DataFrame:
    return df.join(frames, "frame_idx", "left_semi")
