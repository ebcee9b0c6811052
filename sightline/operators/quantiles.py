"""Exact quantiles per group beside other totals, in few passes over a narrow table that is written once.

Up to `DIRECT` rows the exact aggregate does it in the same grouping as the totals: it keeps a group's values in one task.
Beyond that, where groups have few different values, those are counted first and the exact aggregate takes them by their
numbers. Else boundaries from a sketch cut each group's values into SLICES slices; rows are counted by slice where
they are, counts tell in which slice a rank lies, and only rows of those slices move and are put in order, each slice on
its own. All ways give the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: A power of two.
SLICES = 4096
DIRECT = 4_000_000
#: Groups up to this number have their boundaries broadcast: 32 KB each.
FEW_GROUPS = 500


def summarised(rows: DataFrame, keys: Sequence[str], totals: Sequence[Column], wanted: Mapping[str, Mapping[str, float]], direct: int = DIRECT) -> DataFrame:
    """Per group of rows: totals, and quantiles of columns: {column: {name: share}}.

    A quantile is linear between the two nearest values. Null values count for nothing; a group without values has null.
    rows are read several times: give a table that is stored, see `sources.shared.written`.
    """
    if rows.count() <= direct:
        exact = [F.percentile(F.col(c).cast("double"), F.lit(float(q))).alias(name) for c, names in wanted.items() for name, q in names.items()]
        return rows.groupBy(*keys).agg(*totals, *exact)
    group = F.struct(F.lit(0).alias("_all"), *(F.col(k) for k in keys))
    per_group = rows.groupBy(*keys).agg(*totals).withColumn("_k", group)
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in wanted)))
    long = rows.select(group.alias("_k"), values.alias("_x")).where("_x._v IS NOT NULL").select(F.struct("_k", "_x._c").alias("_g"), "_x._v")
    # the estimate chooses the way, not the result; by half, so that it may be wrong by much
    few = long.agg(F.approx_count_distinct(F.struct("_g", "_v"))).first()[0] <= direct // 2
    return per_group.join((_counted if few else _ranked)(long, wanted), "_k", "left").drop("_k")


def _counted(long: DataFrame, wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(_k, one column for each quantile), from the numbers of different values."""
    shares = sorted({float(q) for names in wanted.values() for q in names.values()})
    numbers = long.groupBy("_g", "_v").agg(F.count("*").alias("_n"))
    exact = numbers.groupBy("_g").agg(*(F.percentile("_v", F.lit(q), F.col("_n")).alias(f"_q{i}") for i, q in enumerate(shares)))
    picked = [F.max(F.when(F.col("_g._c") == c, F.col(f"_q{shares.index(float(q))}"))).alias(name) for c, names in wanted.items() for name, q in names.items()]
    return exact.groupBy(F.col("_g._k").alias("_k")).agg(*picked)


def _ranked(long: DataFrame, wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(_k, one column for each quantile), by slices."""
    slices = SLICES
    sketch = long.groupBy("_g").agg(F.percentile_approx("_v", [i / slices for i in range(1, slices)], 10 * slices).alias("_edges"))
    edges = written(sketch, "edges", small=True)
    edges = F.broadcast(edges) if edges.count() <= FEW_GROUPS else edges
    # a value's slice is the number of edges below it, found by halving
    cut = long.join(edges, "_g").withColumn("_slice", F.lit(0))
    step = slices // 2
    while step:
        cut = cut.withColumn("_slice", F.col("_slice") + F.when(F.element_at("_edges", F.col("_slice") + step) < F.col("_v"), step).otherwise(0))
        step //= 2
    cut = cut.select("_g", "_v", "_slice")
    sizes = cut.groupBy("_g", "_slice").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sizes.select("_g", "_slice", "_m", before.alias("_before"), F.sum("_m").over(Window.partitionBy("_g")).alias("_total"))
    shares = F.explode(F.array(*(F.lit(q) for q in sorted({float(q) for names in wanted.values() for q in names.values()})))).alias("_q")
    place = (F.col("_total") - 1) * F.col("_q")
    asked = spans.select("_g", "_slice", "_before", "_m", "_total", shares).withColumns({"_low": F.floor(place), "_high": F.ceil(place), "_rest": place - F.floor(place)})
    holds = lambda r: (F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_before") + F.col("_m"))
    asked = written(asked.where(holds("_low") | holds("_high")).groupBy("_g", "_slice", "_before").agg(F.collect_list(F.struct("_q", "_low", "_high", "_rest")).alias("_asked")), "asked", small=True)
    counted = cut.join(asked.select("_g", "_slice"), ["_g", "_slice"], "left_semi").groupBy("_g", "_slice", "_v").agg(F.count("*").alias("_n"))
    last = F.sum("_n").over(Window.partitionBy("_g", "_slice").orderBy("_v"))
    placed = counted.withColumn("_last", last).join(asked, ["_g", "_slice"]).select("_g", "_v", (F.col("_before") + F.col("_last") - F.col("_n")).alias("_from"), (F.col("_before") + F.col("_last")).alias("_to"), F.inline("_asked"))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to")), F.col("_v")))
    found = placed.groupBy("_g", "_q").agg(at("_low").alias("_a"), at("_high").alias("_b"), F.max("_rest").alias("_rest"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_rest")
    picked = [F.max(F.when((F.col("_g._c") == c) & (F.col("_q") == float(q)), value_at)).alias(name) for c, names in wanted.items() for name, q in names.items()]
    return found.groupBy(F.col("_g._k").alias("_k")).agg(*picked)
