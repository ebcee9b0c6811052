"""Typed reads of the input tables, class names and derived results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKS = T.StructType(
    [T.StructField("frame_idx", T.LongType()), T.StructField("track_id", T.LongType()), T.StructField("class_name", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("bbox_center_x", "bbox_center_y", "bbox_dx", "bbox_dy", "bbox_dz", "bbox_yaw", "score")]
)
NEAR_MISSES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("frame_idx", "track_id_a", "track_id_b")]
    + [T.StructField(c, T.StringType()) for c in ("class_a", "class_b")]
    + [T.StructField(c, T.DoubleType()) for c in ("ttc", "min_separation")]
)
GEOMETRY = ("bbox_center_x", "bbox_center_y", "bbox_dx", "bbox_dy", "bbox_yaw")


def conform(df: DataFrame, schema: T.StructType, optional: Sequence[str] = ()) -> DataFrame:
    """The schema's columns, cast; NaN becomes null. Missing columns fail unless optional; those become null."""
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in optional]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")

    def one(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name).cast(f.dataType)
        return (F.nanvl(c, F.lit(None).cast("double")) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name)

    return df.select(*map(one, schema))


def tracks(df: DataFrame) -> DataFrame:
    """Rows usable as objects: keys and geometry are there."""
    out = conform(df, TRACKS, optional=("bbox_dz", "score"))
    return out.dropna(subset=["frame_idx", "track_id", *GEOMETRY])


def near_misses(df: DataFrame, normalize: bool = True) -> DataFrame:
    out = conform(df, NEAR_MISSES, optional=("class_a", "class_b", "ttc", "min_separation")).dropna(subset=["frame_idx", "track_id_a", "track_id_b"])
    return out.withColumns({c: normalize_class(F.col(c)) for c in ("class_a", "class_b")}) if normalize else out


def read_tracks(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = tracks(spark.read.parquet(path))
    return df.select(*columns) if columns else df


def read_near_misses(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    return near_misses(spark.read.parquet(path), normalize)


def normalize_class(name: Column) -> Column:
    """Lower case; every literal `bike` becomes `bicycle`."""
    return F.replace(F.lower(name), F.lit("bike"), F.lit("bicycle"))


def read_rows_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array of flat rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_document_json(spark: SparkSession, path: str, *keys: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row with the values at dotted key paths of a nested JSON document; null where a path is absent."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    whole = df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).alias("doc"))
    return whole.select(*(F.get_json_object("doc", "$." + k).alias(k.replace(".", "_")) for k in keys)) if keys else df


def left_by(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What an earlier run wrote to path; an empty table where there is nothing yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def verified(here: DataFrame, manifest: DataFrame) -> DataFrame:
    """here and manifest (name, md5): per name of the manifest whether it is here and its digest agrees."""
    found = here.select("name", F.lower("md5").alias("actual"))
    return manifest.join(found, "name", "left").select("name", F.col("actual").isNotNull().alias("present"), F.coalesce(F.lower("md5") == F.col("actual"), F.lit(False)).alias("verified"))
