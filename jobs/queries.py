"""The jobs as queries: each runs twice into one new folder and returns what stands there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.plans import fixture
from sightline.plans.oracles import ORACLES as LIBRARY
from sightline.sources.shared import shared_dir

from . import manifest, observe
from .common import config_of


def job1_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/observe"
    for _ in range(2):
        observe.run(spark, out, events=f"{sf_dir}/events.parquet")
    return fixture.rounded(observe.records(spark, out))


def job2_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark)
    for _ in range(2):
        manifest.run(spark, f"{sf_dir}/documents.parquet", f"{base}/manifest", f"{base}/checkpoint")
    return fixture.rounded(manifest.manifest(spark, f"{base}/manifest").drop("part"))


QUERIES = {"job1_observe": job1_observe, "job2_manifest": job2_manifest}
ORACLES = {
    "job1_observe": f"SELECT *, frame_idx // {config_of('observe')['slab_frames']} AS slab FROM ({LIBRARY['sweep_record']}) AS record",
    "job2_manifest": """
WITH records AS (SELECT source, doc_id AS id, text IS NULL AS missing, length(coalesce(text, '')) AS n_chars, strlen(coalesce(text, '')) AS n_bytes,
    md5(coalesce(doc_id::VARCHAR, '') || CASE WHEN text IS NULL THEN '-' ELSE '+' || text END) AS record_md5, md5(coalesce(text, '')) AS text_md5 FROM documents)
SELECT source, count(*) AS n_records, count(*) FILTER (missing) AS n_missing, sum(n_bytes)::BIGINT AS n_bytes, count(DISTINCT text_md5) AS distinct_texts, min(id) AS first_id, max(id) AS last_id,
    median(n_chars)::DOUBLE AS median_chars, round(quantile_cont(n_chars, 0.05), 6) AS p05_chars, round(quantile_cont(n_chars, 0.95), 6) AS p95_chars,
    md5(count(*) || ':' || sum(('0x' || substr(record_md5, 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(record_md5, 16, 15))::BIGINT)::VARCHAR) AS digest
FROM records GROUP BY source""",
}
