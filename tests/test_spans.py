import random

from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_span_of_four_is_the_span_without_an_array(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([tuple(rng.choice((rng.uniform(-3.1, 3.1), 0.0, 1.0)) for _ in range(4)) for _ in range(500)] + [(-3.1, 3.1, 3.0, -3.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    both = df.select(g.span_of_four(*(F.col(c) for c in "abcd")).alias("s"), g.angular_span(F.array(*"abcd")).alias("w")).select(*(F.round(f"{x}.{e}", 9).alias(f"{x}_{e}") for x in "sw" for e in ("start", "stop")))
    assert both.where("s_start <> w_start OR s_stop <> w_stop").count() == 0
    assert "transform(" not in catalogue.QUERIES["object_spans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
