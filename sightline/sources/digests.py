"""Digests of files of any size, read in small chunks, and folders held against a manifest.

Files are listed by Spark's reader for binary files, of which only names, sizes and times are asked; tasks then read the bytes,
a chunk at a time. An MD5 of a whole file needs its bytes in order, so it is one task's work in constant memory, whatever
the size; ranges of a file are read side by side, and `range_digest` makes one digest of theirs. What a ledger knows as
verified is left out by a join before anything is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import left_by

CHUNK = 1 << 20
LEDGER = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.TimestampType()), T.StructField("md5", T.StringType())])


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    local = re.match(r"file:/*(/.*)", path)
    if local or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), local[1] if local else path
    return pyarrow.fs.FileSystem.from_uri(path)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, path, size, modified) of the files below a folder whose names fit the pattern; name is the path below the folder."""
    base = re.sub(r"^[a-z0-9+.-]+:/*", "/", folder.rstrip("/")) + "/"
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
        found = spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    rows = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    # the reader passes over empty files, which its index knows; their time of change is not told
    every = spark.createDataFrame([(unquote(p),) for p in found.inputFiles()], "path string")
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")
    empty = every.join(rows.select(plain("path").alias("_there")), plain("path") == F.col("_there"), "left_anti")
    rows = rows.unionByName(empty.withColumns({"size": F.lit(0).cast("long"), "modified": F.lit(None).cast("timestamp")}))
    return rows.select(F.substring_index("path", base, -1).alias("name"), "path", "size", "modified")


def digests(some: DataFrame, range_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """some (name, path, size, modified) with offset, length and md5: a row for each file, or with range_bytes for each range of one.

    An empty file has the digest of no bytes. A file that is shorter than it was listed is an error.
    """
    step = F.lit(range_bytes) if range_bytes else F.greatest("size", F.lit(1))
    cut = some.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), step.cast("long"))))
    cut = cut.withColumn("length", F.least(F.col("size") - F.col("offset"), step.cast("long")))
    schema = T.StructType([*cut.schema.fields, T.StructField("md5", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["path", "offset", "length"]).to_pylist()
            for i, row in enumerate(rows):
                fs, path = _opened(row["path"])
                digest, left = hashlib.md5(usedforsecurity=False), row["length"]
                with fs.open_input_file(path) as file:
                    file.seek(row["offset"])
                    while left:
                        data = file.read(min(left, chunk_bytes))
                        if not data:
                            raise EOFError(f"{path} ends {left} bytes early")
                        digest.update(data)
                        left -= len(data)
                yield batch.slice(i, 1).append_column("md5", pa.array([digest.hexdigest()], pa.string()))

    # files are few and large: each is dealt by itself
    return cut.repartition("path", "offset").mapInArrow(read, schema)


def range_digest(ranges: DataFrame) -> DataFrame:
    """(name, path, size, modified, md5): one digest of each file, that of its ranges' digests in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "md5")))
    return ranges.groupBy("name", "path", "size", "modified").agg(parts.alias("_p")).withColumn("md5", F.md5(F.array_join(F.transform("_p", lambda p: p["md5"]), "").cast("binary"))).drop("_p")


def verify(spark: SparkSession, folder: str, manifest: DataFrame, ledger: str | None = None, force: bool = False, pattern: str = "*") -> DataFrame:
    """manifest (name, md5): (name, path, size, modified, md5, expected, status) for each name of the manifest and each file.

    status: known (the ledger has it with this size, time of change and digest: it is not read again, unless force), verified,
    mismatch, missing, or extra for files that the manifest does not name. Digests may be in upper case; of a name that the
    manifest repeats, one row counts.
    """
    wanted = manifest.select("name", F.lower("md5").alias("expected")).dropDuplicates(["name"])
    past = left_by(spark, ledger, LEDGER) if ledger and not force else spark.createDataFrame([], LEDGER)
    past = past.select("name", "size", "modified", F.col("md5").alias("expected")).distinct().withColumn("known", F.lit(True))
    met = files(spark, folder, pattern).join(wanted, "name", "full").join(past, ["name", "size", "modified", "expected"], "left")
    here, known = F.col("path").isNotNull() & F.col("expected").isNotNull(), F.coalesce("known", F.lit(False))
    read = digests(met.where(here & ~known).drop("known"))
    status = F.when(F.col("md5") == F.col("expected"), "verified").otherwise("mismatch")
    columns = ("name", "path", "size", "modified", "md5", "expected", "status")
    rest = F.when(known, "known").when(F.col("path").isNull(), "missing").otherwise("extra")
    unread = met.where(~here | known).withColumns({"status": rest, "md5": F.when(known, F.col("expected"))})
    return read.withColumn("status", status).select(*columns).unionByName(unread.select(*columns))


def remember(report: DataFrame, ledger: str) -> None:
    """Adds what was verified to the ledger."""
    report.where("status = 'verified'").select("name", "size", "modified", "md5").write.mode("append").parquet(ledger)


def drop_mismatches(report: DataFrame) -> DataFrame:
    """Deletes files whose digest is another than the manifest's; (name) of those deleted, once the result is read."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, bare = _opened(path)
                if fs.get_file_info([bare])[0].is_file:  # a task that is tried again finds it gone
                    fs.delete_file(bare)
            yield batch.select(["name"])

    return report.where("status = 'mismatch'").select("name", "path").mapInArrow(delete, "name string")
