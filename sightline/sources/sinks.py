"""Writing results: Parquet folders or single files, pretty JSON documents and tables for a console."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").parquet(path)


def write_ordered(df: DataFrame, path: str, keys: Sequence[str], dealt: bool = False) -> None:
    """Writes rows in order of the keys: files hold ranges that follow one another, and so do row groups within.

    No task sorts more than its range, and nothing is gathered into one file. dealt: partitions are ranges of the first key already
    (`observe.sweep` with in_order), so rows do not move, and are not computed a second time for a sample of their keys.
    """
    (df if dealt else df.repartitionByRange(*keys)).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def file_ranges(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(file, n, first, last, after_the_one_before) for each file of a stored table, by its rows' keys; one row for each file."""
    key = F.struct(*keys)
    per = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    before = F.lag("last").over(Window.orderBy("first", "last"))
    return per.withColumn("after_the_one_before", F.coalesce(before <= F.col("first"), F.lit(True)))


def document(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a short aggregate as plain values."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a summary")
    return [r.asDict(recursive=True) for r in rows]


def write_json(value: dict | list | DataFrame, path: str) -> None:
    """A summary as indented JSON with a final line end, on any file system that Spark can write."""
    value = document(value) if isinstance(value, DataFrame) else value
    data = (json.dumps(value, indent=2) + "\n").encode()
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def table_text(rows: DataFrame | Sequence[dict], title: str = "", places: int = 3) -> str:
    """A short aggregate as lines of aligned columns: numbers to the right, missing values as a dash."""
    rows = document(rows) if isinstance(rows, DataFrame) else list(rows)
    names = list(rows[0]) if rows else []
    show = lambda v: "-" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    cells = [[show(r[c]) for c in names] for r in rows]
    wide = [max(map(len, column)) for column in zip(names, *cells, strict=True)]
    right = [all(r[c] is None or isinstance(r[c], int | float) for r in rows) for c in names]
    line = lambda values: "  ".join(v.rjust(w) if r else v.ljust(w) for v, w, r in zip(values, wide, right, strict=True)).rstrip()
    body = [line(x) for x in [names, *cells]] if rows else ["(no rows)"]
    return "\n".join([*([f"--- {title} ---"] if title else []), *body])
