"""Visibility of arriving frames, whole or split between batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import observe
from ..operators.config import sensor_with
from ..operators.visibility import classified, visibility
from ..sources.tables import TRACKS, left_by, tracks

#: What a batch leaves for the next: rows of frames that may still grow, and up to where frames have been judged.
HELD = T.StructType([*TRACKS.fields, T.StructField("batch", T.LongType())])
MARK = T.StructType([T.StructField("last_frame", T.LongType()), T.StructField("n_late", T.LongType()), T.StructField("batch", T.LongType())])


def read_tracks_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of tracks as they arrive."""
    return spark.readStream.schema(TRACKS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def observe_stream(stream: DataFrame, egos: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, fovs: Sequence[float] = (120.0,), sensor: dict[str, float] | None = None, lateness: int | None = None) -> StreamingQuery:
    """Observation counts of every batch, handed to the sink with the batch's number: write them by it to stay exactly once.

    Without lateness, batches hold whole frames. With it, a frame is judged when rows of a frame more than `lateness` frames on
    have come; until then its rows are held in the checkpoint's folder, from batch to batch, each under its number, so
    that a batch that is tried again starts from the same rows. Rows of frames already judged are late: they are left out and
    counted, see `late_rows`. `flush` judges what is held at the end.
    """
    sensor = sensor_with(sensor)

    def judged(df: DataFrame, number: int) -> None:
        seen = classified(visibility(df, egos, fovs, sensor), sensor["range_m"], sensor["near_blind_m"])
        sink(observe.ratios(observe.counts(seen)).withColumn("batch", F.lit(number)), number)

    def batch(df: DataFrame, number: int) -> None:
        if lateness is None:
            judged(tracks(df), number)
            return
        rows, mark = _with_held(df.sparkSession, tracks(df), checkpoint, number)
        done = max(mark, (rows.agg(F.max("frame_idx")).first()[0] or mark) - lateness - 1)
        fresh = F.col("frame_idx") > mark
        late = rows.where(~fresh).count()
        judged(rows.where(fresh & (F.col("frame_idx") <= done)), number)
        _leave(rows.where(fresh & (F.col("frame_idx") > done)), done, late, checkpoint, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _with_held(spark: SparkSession, rows: DataFrame, checkpoint: str, number: int) -> tuple[DataFrame, int]:
    """The batch's rows with those held by the batch before, and the last frame judged; -1 at first."""
    mark = left_by(spark, f"{checkpoint}/mark", MARK).where(F.col("batch") == number - 1).first()
    held = left_by(spark, f"{checkpoint}/held", HELD).where(F.col("batch") == number - 1).drop("batch")
    return rows.unionByName(held), mark["last_frame"] if mark else -1


def _leave(held: DataFrame, done: int, late: int, checkpoint: str, number: int) -> None:
    spark = held.sparkSession
    by_batch = lambda df, name: df.withColumn("batch", F.lit(number).cast("long")).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{checkpoint}/{name}")
    by_batch(held, "held")
    by_batch(spark.createDataFrame([(done, late)], "last_frame long, n_late long").coalesce(1), "mark")


def late_rows(spark: SparkSession, checkpoint: str) -> int:
    """Rows that came after their frame was judged."""
    return left_by(spark, f"{checkpoint}/mark", MARK).agg(F.sum("n_late")).first()[0] or 0


def flush(spark: SparkSession, egos: DataFrame, checkpoint: str, fovs: Sequence[float] = (120.0,), sensor: dict[str, float] | None = None) -> DataFrame:
    """Observation counts of the frames that the last batch has left, when no more rows will come."""
    sensor = sensor_with(sensor)
    last = left_by(spark, f"{checkpoint}/mark", MARK).agg(F.max("batch")).first()[0]
    held = left_by(spark, f"{checkpoint}/held", HELD).where(F.col("batch") == last).drop("batch")
    return observe.ratios(observe.counts(classified(visibility(held, egos, fovs, sensor), sensor["range_m"], sensor["near_blind_m"])))
