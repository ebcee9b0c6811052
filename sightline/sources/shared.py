"""The folder that the driver and all executors share, and tables written there once and read several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting for shuffle files of finished queries.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new name in the folder all executors share: spark.checkpoint.dir; where that is unset and all runs in this process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="sightline-")
            spark.sparkContext.setCheckpointDir(base)
    if ":" not in base:  # a path of the default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/sightline-{uuid.uuid4().hex}"


def in_waves(df: DataFrame, waves: int = 8) -> DataFrame:
    """df in at most so many partitions for each core of the cluster, or, where that is more, an eighth of the shuffle partitions at eight waves.

    Whoever runs a cluster sets shuffle partitions by bytes; so no task gathers more than eight of those, and with fewer waves,
    for rows of a few numbers, more of them in proportion.
    """
    spark = df.sparkSession
    return df.coalesce(max(waves * spark.sparkContext.defaultParallelism, waves * int(spark.conf.get("spark.sql.shuffle.partitions")) // 64))


def written(df: DataFrame, name: str = "table", small: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs nothing written.

    Its shuffle files go when it is written, not when the driver happens to collect garbage. Tasks are those of `in_waves`: eight
    waves, or one where rows are small, a few numbers each: not a file for each partition.
    """
    spark = df.sparkSession
    df = in_waves(df, 1 if small else 8)
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
