"""The corpus pipeline: quality, near duplicates, long repeats, benchmark leaks, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. Every stage works on all rows
that its predecessor kept.

In every stage null and empty texts count as texts without bytes or words, very long texts count whole, an empty table
gives an empty result, and further columns of the input are carried along unchanged, whatever their names are. What a
stage does with repeated rows, ties and rows without an id is said there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sightline.llm import decontaminate, jaccard, packing, quality, suffixes
from sightline.llm.common import in_waves, marked_ids, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage sees columns besides those of documents under names of its own, so that none can clash."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = docs.columns
        names = [c if c in COLUMNS else f"carried_{i}" for i, c in enumerate(own)]
        kept = stage(spark, docs.toDF(*names), sf_dir)
        return in_waves(kept.select(*names).toDF(*own))

    return run_stage


@carrying
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Each of repeated rows counts and has the same result. Null sources and languages are a site of their own. Without
    labels all documents stay. A posterior equal to the limit keeps the document.
    """
    return quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep")


@F.pandas_udf(BinaryType())
def set_name(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: jaccard.digest_of(h) if len(h := jaccard.shingles(t)) else None)


@carrying
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row with the smallest id stays.

    Rows are judged one by one, also where they share an id: of rows with the smallest id of their group, one with the
    least name of its set of shingles, and of those the least text, stays. Documents without words or an id stay.
    """
    rows = jaccard.join(docs, named=True).where("digest IS NOT NULL").groupBy("doc_id", "digest", "first").agg(F.count("*").alias("n"))
    gone = written(rows.where("NOT first OR n > 1"), "gone", small=True)
    marked = marked_ids(docs, gone.select(F.col("doc_id").alias("id")), "doc_id")
    maybe = marked.where("maybe").select(*docs.columns, set_name("text").alias("digest"))
    judged = maybe.join(gone, ["doc_id", "digest"], "left")
    once = judged.where("first").groupBy("doc_id", "digest").agg(F.min_by(F.struct(*docs.columns), "text").alias("row")).select("row.*")
    stay = judged.where("first IS NULL").select(*docs.columns).unionByName(once.select(*docs.columns))
    return marked.where("NOT maybe").select(*docs.columns).unionByName(stay)


@carrying
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long repeats go, but for their first document; bytes left of broken characters too, and texts left empty.

    Rows that share an id do not remove each other's bytes, and each loses what its own text holds; rows without an id
    lose nothing. Null and empty texts stay.
    """
    cut = suffixes.without_repeats(docs, whole_characters=True)
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.col("kept").cast("string"))
    n_chars = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("text", text).withColumn("n_chars", n_chars).where("kept IS NULL OR length(text) > 0")


@carrying
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their ids; repeated rows go or stay alike.

    Items without words match nothing; items count whatever their ids, and an empty benchmark keeps all documents.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into windows.

    Repeated rows are packed once each, null and empty texts as the end token alone; pieces of one length are dealt to
    their places by task and order there; further columns are left out.
    """
    # workers of earlier stages still stand beside: less memory than the operator takes by itself
    return packing.pack(docs, packing.tokenizer_path(), known=1 << 19, at_once=1 << 21)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Several stages cannot be expressed in SQL; tests/llm/test_pipeline.py compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
