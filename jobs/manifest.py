"""Keeps a manifest of a table of texts as files are added to it: sizes and a digest for each source.

    python -m jobs.manifest --texts TABLE --out OUT --checkpoint CHECKPOINT [--expected MANIFEST]

A file stream takes the files that are new since its checkpoint and writes a row of sizes and digests for each record to
CHECKPOINT/records, a partition for each batch and part; a batch that is tried again overwrites its own. Then the parts
whose records have grown since OUT was written are summed up anew and overwrite their partitions of OUT; the others are
left alone. Texts are read once, when they arrive. A source's digest does not depend on the order or the files of its
records, so a copy of the table can be held against it: --expected names an earlier manifest, and sources that differ from
it are logged and returned.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.quantiles import summarised
from sightline.sources import tables

from .common import config_of, log_of, started

RECORDS = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("id", T.LongType()), T.StructField("missing", T.BooleanType())]
    + [T.StructField(c, T.LongType()) for c in ("n_chars", "n_bytes")]
    + [T.StructField(c, T.StringType()) for c in ("record_md5", "text_md5")]
    + [T.StructField(c, T.IntegerType()) for c in ("batch", "part")]
)
MANIFEST = T.StructType(
    [T.StructField("source", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("n_records", "n_missing", "n_bytes", "distinct_texts", "first_id", "last_id")]
    + [T.StructField(c, T.DoubleType()) for c in ("median_chars", "p05_chars", "p95_chars")]
    + [T.StructField("digest", T.StringType()), T.StructField("part", T.IntegerType())]
)
LOG = log_of("manifest")


def as_glob(path: str) -> str:
    """A pattern of that one name: a file stream takes a folder or a pattern, not the path of a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def digested(texts: DataFrame, config: dict) -> DataFrame:
    """A row for each record: sizes, the digest of its text, and of its key and text, where null and empty differ."""
    text, key, source = F.col(config["text"]).cast("string"), F.col(config["key"]).cast("long"), F.col(config["group"]).cast("string")
    named = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.when(text.isNull(), "-").otherwise(F.concat(F.lit("+"), text)))
    body = F.coalesce(text, F.lit(""))
    part = F.pmod(F.crc32(F.coalesce(source, F.lit(""))), F.lit(config["parts"])).cast("int")
    return texts.select(
        source.alias("source"), key.alias("id"), text.isNull().alias("missing"), F.length(body).cast("long").alias("n_chars"), F.octet_length(body).cast("long").alias("n_bytes"),
        F.md5(named).alias("record_md5"), F.md5(body).alias("text_md5"), part.alias("part"),
    )


def _half(digest: str, at: int) -> Column:
    """15 hexadecimal digits of a digest as a number, to be summed without loss."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")


def summed(records: DataFrame) -> DataFrame:
    """The manifest's rows of some parts: equal texts of a source first, then the source."""
    sums = [F.sum(_half("record_md5", at)).cast("decimal(38,0)").alias(f"h{at}") for at in (1, 16)]
    texts = records.groupBy("part", "source", "text_md5").agg(F.count("*").alias("n"), F.count_if("missing").alias("n_missing"), F.sum("n_bytes").alias("n_bytes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), *sums)
    whole = texts.groupBy("part", "source").agg(
        F.sum("n").alias("n_records"), F.sum("n_missing").alias("n_missing"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("distinct_texts"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"),
        F.md5(F.concat_ws(":", F.sum("n").cast("string"), F.sum("h1").cast("string"), F.sum("h16").cast("string"))).alias("digest"),
    )
    sizes = summarised(records, ["part", "source"], [F.count("*").alias("_n")], {"n_chars": {"median_chars": 0.5, "p05_chars": 0.05, "p95_chars": 0.95}}).drop("_n")
    same = (whole["part"] == sizes["part"]) & whole["source"].eqNullSafe(sizes["source"])
    return whole.join(sizes, same).select(*(whole[f.name] if f.name in whole.columns else sizes[f.name] for f in MANIFEST))


def run(spark: SparkSession, texts: str, out: str, checkpoint: str, config: dict | None = None, expected: str | None = None) -> dict:
    """One run; returns what it read and wrote, and with expected the sources that differ."""
    config = config or config_of("manifest")
    kept = f"{checkpoint}/records"

    def take(batch: DataFrame, number: int) -> None:
        rows = digested(batch, config).withColumn("batch", F.lit(number))
        # parts become files of the size that the session advises; a large one is split
        rows.hint("rebalance", "part").select(*RECORDS.names).write.partitionBy("batch", "part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(kept)
        LOG.info("batch %s: taken", number)

    before = tables.left_by(spark, kept, RECORDS).count()
    arriving = spark.readStream.schema(spark.read.parquet(texts).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(as_glob(texts))
    arriving = arriving.select(config["key"], config["text"], config["group"])
    arriving.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start().awaitTermination()
    records = tables.left_by(spark, kept, RECORDS)
    counts = records.groupBy("part").agg(F.count("*").alias("n"))
    done = tables.left_by(spark, out, MANIFEST).groupBy("part").agg(F.sum("n_records").alias("done"))
    parts = [r["part"] for r in counts.join(done, "part", "left").where("done IS NULL OR done <> n").select("part").collect()]
    total = records.count()
    LOG.info("read %s new records of %s, %s in all; parts that have grown: %s of %s", total - before, texts, total, len(parts), config["parts"])
    if parts:
        made = summed(records.where(F.col("part").isin(parts)))
        made.repartition("part").sortWithinPartitions("part", "source").write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)
        LOG.info("wrote parts %s of %s", sorted(parts), out)
    report = {"read": total - before, "records": total, "parts": len(parts)}
    if expected:
        report["different"] = sorted(r["name"] for r in compared(manifest(spark, out), manifest(spark, expected)).where("NOT verified").collect())
        LOG.info("sources that differ from %s: %s", expected, report["different"] or "none")
    return report


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The whole manifest as it stands."""
    return tables.left_by(spark, out, MANIFEST)


def compared(here: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, present, verified) for each source of an expected manifest; a null source has the name of a dash."""
    name = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))
    return tables.verified(here.select(name.alias("name"), F.col("digest").alias("md5")), expected.select(name.alias("name"), F.col("digest").alias("md5")))


def main(arguments: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="jobs.manifest", description="Keep a manifest of a table of texts up to date.")
    p.add_argument("--texts", required=True, help="Parquet file or folder of texts")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--expected", help="an earlier manifest to hold this one against")
    return started(p, "manifest", lambda spark, a, config: run(spark, a.texts, a.out, a.checkpoint, config, a.expected), arguments)


if __name__ == "__main__":
    main()
