"""Shared plumbing: heavy keys, marked ids and what Python workers are handed; written tables come from sources.shared."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import in_waves, shared_dir, written  # noqa: F401

#: A key counts as heavy from HEAVY_ROWS rows on, or from 1/HEAVY_SHARE of all rows where that is less: what a task gathers
#: of a light key is bounded whatever the input, and of n rows there are at most HEAVY_SHARE + n / HEAVY_ROWS heavy keys.
HEAVY_SHARE, HEAVY_ROWS = 400, 1_000_000
#: Rows and bytes that a Python worker is handed at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def heavy_from(total: int | Column) -> Column:
    """From how many rows on a key of a table with `total` rows is heavy."""
    total = total if isinstance(total, Column) else F.lit(total)
    return F.least(F.lit(HEAVY_ROWS), F.floor(total / HEAVY_SHARE) + 1)


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """The heavy keys of df with their numbers of rows; few enough to broadcast."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") >= heavy_from(F.col("_all"))).select(key, "_n")


def sheltered(df: DataFrame, *used: str) -> None:
    """Fails early and plainly where a column is missing, and bounds what goes to Python at once, by rows and by bytes."""
    missing = [c for c in used if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB"))
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def lookup_join(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Left join of rows to a table with one row per key, without gathering the rows of heavy keys.

    heavy: the column `key`, as few rows as heavy_keys gives. Their entries are broadcast; all other rows meet theirs in a
    join on the key, where rows of heavy keys carry a key of their own each. Null keys find nothing.
    """
    values = [c for c in table.columns if c != key]
    few = table.join(F.broadcast(heavy.select(key)), key, "left_semi")
    few = few.select(F.col(key).alias("_heavy"), *(F.col(c).alias(f"_heavy_{c}") for c in values))
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("_heavy"), "left")
    lonely = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    spread = marked.withColumn("_on", F.when(F.col("_heavy").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(lonely))
    light = table.select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_light"), *(F.col(c).alias(f"_light_{c}") for c in values))
    joined = spread.join(light, F.col("_on") == F.col("_light"), "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_heavy_{c}", f"_light_{c}").alias(c) for c in values))


def marked_ids(rows: DataFrame, ids: DataFrame, column: str = "id", most: int = 1 << 20) -> DataFrame:
    """Adds maybe: whether a row's id may be among ids, by a table of 16 bits for each id, 64 * most bits at most; null ids are not.

    Beyond some 50 million ids the table fills, and more rows are marked than need be.
    """
    words = 1 << min(max(ids.count() // 4, 1024).bit_length(), most.bit_length() - 1)
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    table = ids.select(spot("id").alias("_s")).groupBy((F.col("_s") / 64).cast("long").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(_s, 64) AS int))")).alias("_bits"))
    named = rows.withColumn("_s", spot(F.col(column).cast("long"))).withColumn("_word", (F.col("_s") / 64).cast("long")).join(F.broadcast(table), "_word", "left")
    bit = F.expr("coalesce(shiftrightunsigned(_bits, cast(pmod(_s, 64) AS int)) & 1 = 1, FALSE)")
    return named.withColumn("maybe", bit & F.col(column).isNotNull()).select(*rows.columns, "maybe")


def release() -> None:
    """Gives memory that this Python worker has freed back to the system: idle workers live on beside those of later stages.

    Large blocks are mapped one by one from then on, so that they go back as soon as they are freed.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc alone has it
        libc.mallopt(-3, 1 << 20)  # the threshold of mapped blocks; it would grow with the blocks freed
        libc.malloc_trim(0)


def releasing(act: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """act, for mapInPandas, with `release` before and after."""

    @functools.wraps(act)
    def run(batches: Iterator) -> Iterator:
        release()
        yield from act(batches)
        release()

    return run


def even_keys(spark: SparkSession, n: int, most: int = 200_000) -> Sequence[int]:
    """n numbers of which hash partitioning into n partitions puts one in each: tasks then hold one group each, not a chance number.

    Beyond `most` the numbers are 0 to n - 1, a range: what reaches the driver and goes to tasks stays bounded.
    """
    if n > most:
        return range(n)
    spots = spark.range(32 * n).groupBy(F.expr(f"pmod(hash(id), {n})").alias("at")).agg(F.min("id").alias("id")).collect()
    keys = {r["at"]: r["id"] for r in spots}
    return [keys.get(i, 32 * n + i) for i in range(n)]
