"""Quantiles of many rows with few different values are taken from the numbers of those."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import quantiles


def test_few_different_values_are_counted(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 37 * F.col("id") % 11).cast("double").alias("v"), F.lit(None).cast("double").alias("w"))
    got = quantiles.summarised(df, ["k"], [F.count("*").alias("n")], {"v": {"p05": 0.05, "m": 0.5, "p99": 0.99}, "w": {"none": 0.5}}, direct=10_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "percentile_approx" not in plan
    rows = {r.k: r for r in got.collect()}
    for k in (0, 1):
        v = [float(i % 37 * i % 11) for i in range(k, 20_000, 2)]
        assert rows[k].n == len(v) and rows[k].none is None
        assert [rows[k].p05, rows[k].m, rows[k].p99] == pytest.approx(np.quantile(v, [0.05, 0.5, 0.99]).tolist(), abs=1e-12)
