"""Operator 3: hierarchical empirical Bayes quality classifier.

Boosted trees on counts of the whole text give each document its evidence, a log-odds of being good. Grouped sums of the
evidence's probabilities over hosts, and over paths within hosts, give posteriors: a Beta prior fitted to the spread
between hosts pulls sparse hosts to the global mean, and one fitted to the spread within hosts pulls sparse paths to
their host. A document is kept where its evidence, moved by its path's log-odds against the global ones, reaches `cut`.

The trees are fitted on a hash-ordered sample of at most `sample` labelled documents; sums count every document. Null
hosts and paths form a site of their own, null texts count as empty ones, repeated rows get equal results and each
counts, very long texts count whole, extra columns of the input stay out, an empty table gives an empty result. Without labels
every document is kept; with labels of one kind each has that kind's smoothed rate as evidence.
Sites reach the documents by broadcast where they are counted to be at most `few_sites`, else by a join in which the
rows of heavy sites are not gathered.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import heavy_keys, lookup_join, sheltered, written

_GROUPS = [range(65, 91), range(97, 123), range(48, 58), [10], [32, 9], [124], [33, 63], [35, 36, 37, 38, 42, 64, 126, 94], [44, 46, 59, 58], [60, 62, 123, 125, 91, 93], range(128, 256), range(0, 9)]
_CLASSES = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    _CLASSES[list(_g), _i] = 1


def features(text: str | None) -> list[float]:
    """Shares of byte classes, word and line statistics, of the whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shares = (np.bincount(raw, minlength=256) @ _CLASSES) / max(1, len(raw))
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(map(operator.eq, words, words[1:]))
    return [
        *shares.tolist(), float(np.log1p(len(raw))), float(np.log1p(n)), len(text) / max(1, n), len(set(words)) / max(1, n), again / max(1, n - 1),
        max(map(len, words), default=0), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
    ]


WIDTH = len(features(""))


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> Boosted | None:
    """At most `sample` labelled ids, and twice as many documents, both chosen by hash, reach the driver as features; None without any."""
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    wanted = wanted.orderBy(F.xxhash64(key), key).limit(sample)
    chosen = documents.select(key, F.col(text).cast("string").alias("_text")).join(F.broadcast(wanted), key)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["_label"].astype(int), "x": [features(t) for t in b["_text"]]})

    rows = chosen.select("_label", "_text").mapInPandas(measure, "label int, x array<double>").orderBy(F.xxhash64("x"), "x", "label").limit(2 * sample).collect()
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, WIDTH)
    return Boosted(rounds=60).fit(x, np.array([r.label for r in rows], dtype=float)) if rows else None


def evidence(text: Column, model: Boosted | None) -> Column:
    """Log-odds of being good; the trees' score, limited to +-8. Labels of one kind give all texts that kind's smoothed rate."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            p = model.probability(np.array([features(t) for t in s], dtype=float).reshape(-1, WIDTH)) if model else np.ones(len(s))
            p = np.clip(p, 3.4e-4, 1 - 3.4e-4)
            yield pd.Series(np.log(p / (1 - p)))

    return score(text.cast("string"))


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _strength(groups: DataFrame, share: str, around: Column, n: str) -> Column:
    """Beta prior strength by moments: the spread of group means beyond what sampling explains, in one aggregate."""
    weight = F.col(n).cast("double")
    between = F.sum(weight * (F.col(share) - around) * (F.col(share) - around)) / F.sum(weight)
    within = F.sum(around * (1 - around)) / F.sum(weight)
    centre = F.sum(weight * around * (1 - around)) / F.sum(weight)
    return F.least(F.greatest(centre / F.greatest(between - within, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1e6))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """scored: host, path, p. One row per site (host and path) with host_posterior, path_posterior and shift (log-odds)."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("mean"))
    hosts = hosts.crossJoin(F.broadcast(whole)).withColumn("host_share", F.col("host_s") / F.col("host_n"))
    prior = hosts.agg(_strength(hosts, "host_share", F.col("mean"), "host_n").alias("host_strength"))
    hosts = hosts.crossJoin(F.broadcast(prior)).withColumn("host_posterior", (F.col("host_s") + F.col("host_strength") * F.col("mean")) / (F.col("host_n") + F.col("host_strength")))
    both = paths.join(hosts, "host").withColumn("share", F.col("s") / F.col("n"))
    prior = both.agg(_strength(both, "share", F.col("host_share"), "n").alias("path_strength"))
    both = both.crossJoin(F.broadcast(prior)).withColumn("path_posterior", (F.col("s") + F.col("path_strength") * F.col("host_posterior")) / (F.col("n") + F.col("path_strength")))
    return both.select(_site(), "host_posterior", "path_posterior", (_logit(F.col("path_posterior")) - _logit(F.col("mean"))).alias("shift"))


def _site() -> Column:
    return F.concat(F.length("host").cast("string"), F.lit(":"), F.col("host"), F.col("path")).alias("site")


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", sample: int = 6000, cut: float = 0.4, weight: float = 0.5, few_sites: int = 50_000, with_text: bool = True) -> DataFrame:
    """The documents' columns (text only if with_text), then host_posterior, path_posterior, evidence, quality_posterior and keep (names of the input's own columns win)."""
    sheltered(documents, key, text, host, path)
    model = fit(documents, labels, key, text, label, sample)
    own = documents.columns
    held = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    at = {c: f"c{own.index(c)}" for c in (text, host, path)}
    named = held.withColumns({"host": F.coalesce(F.concat(F.lit("+"), F.col(at[host]).cast("string")), F.lit("-")), "path": F.coalesce(F.concat(F.lit("+"), F.col(at[path]).cast("string")), F.lit("-"))})
    scored = named.withColumn("evidence", evidence(F.col(at[text]), model))
    scored = written(scored if with_text else scored.drop(at[text]), "scored")  # texts are read and scored once
    sites = written(site_posteriors(scored.select("host", "path", (1 / (1 + F.exp(-F.col("evidence")))).alias("p"))), "sites", small=True)
    rows = scored.withColumn("site", _site())
    if sites.limit(few_sites + 1).count() <= few_sites:
        joined = rows.join(F.broadcast(sites), "site", "left")
    else:
        joined = lookup_join(rows, sites, "site", heavy_keys(rows.select("site"), "site"))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(weight) * F.col("shift"))))
    made = {"host_posterior": F.col("host_posterior"), "path_posterior": F.col("path_posterior"), "evidence": F.col("evidence"), "quality_posterior": quality, "keep": quality >= cut}
    return joined.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own) if with_text or c != text), *(c.alias(n) for n, c in made.items() if n not in own))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(documents.select("doc_id", "text", "source", "lang"), labels, with_text=False)


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
