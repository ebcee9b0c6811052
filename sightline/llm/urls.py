"""Operator 5: url filter. Host and path rules decide first; boosted trees on lexical features decide the rest.

The trees learn from labelled urls: any table of urls and labels, or else the urls that a rule decides. Suffix statistics
count every url and every suffix; they reach the urls by broadcast where they are counted to be at most `few_suffixes`,
else by a join in which the urls of heavy suffixes are not gathered. Fitting reads a hash-ordered sample of at most
`sample` labelled urls, of which only the features reach the driver.

Null urls and urls without "://" have an empty host and path, no rule, and are judged by their features like any other.
Repeated rows give repeated results and each counts, ties between rules go to the rule that sorts first, very long urls
count whole, extra columns of the input are ignored. An empty table gives an empty result; without any labelled url the
verdict is allow, with a probability of 0, and with labels of one kind all urls have that kind's smoothed rate.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import heavy_keys, lookup_join, sheltered, written

#: The rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy", "hyphens", "parameters", "fragment", "www", "suffix_share", "suffix_rate")


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), AZ, az), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; ties go to the rule that sorts first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str, share: float, rate: float) -> tuple[float, ...]:
    url = url or ""
    rest = url.partition("://")[2] or url
    query = rest.partition("#")[0].partition("?")[2]
    count = lambda s: sum(map(str.isdigit, s)) / len(s) if s else 0.0
    return (
        len(url), len(host), len(path), len(query), path.count("/"), host.count(".") + 1 if host else 0, count(url), count(host), _entropy(url), _entropy(host),
        url.count("-"), query.count("&") + 1 if query else 0, float("#" in url), float(host.startswith("www.")), share, rate,
    )


def _features(b: pd.DataFrame) -> np.ndarray:
    columns = (b[c] for c in ("url", "host", "path", "suffix_share", "suffix_rate"))
    return np.array([lexical(*x) for x in zip(*columns, strict=True)], dtype=float).reshape(-1, len(FEATURES))


def suffix_statistics(rows: DataFrame, prior: float) -> tuple[DataFrame, int]:
    """(suffix, suffix_share of all urls, suffix_rate, the smoothed share of blocked among labelled ones), and the number of labelled urls."""
    counts = rows.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    counts = written(counts, "suffixes", small=True)
    whole = counts.agg(F.sum("n"), F.sum("labelled"), F.sum("blocked")).first()
    n, labelled, blocked = (float(v or 0) for v in whole)
    mean = (blocked + prior) / (labelled + 2 * prior)
    stats = counts.select("suffix", (F.col("n") / max(n, 1.0)).alias("suffix_share"), ((F.col("blocked") + prior * mean) / (F.col("labelled") + prior)).alias("suffix_rate"))
    return stats, int(labelled)


def fit(labelled: DataFrame, n: int, sample: int, held_out: int = 5) -> tuple[Boosted | None, float | None]:
    """labelled: the columns of features, label (1 block, 0 allow) and order, a hash; `n` rows. None where there are none.

    Also the share of right verdicts on every `held_out`-th of the sampled urls, by trees that have not seen them: trees of all
    of them follow. Null where that leaves nothing to learn from or to judge.
    """
    share = 1 << 20
    few = labelled.where(F.pmod("order", F.lit(share)) < max(1, share * 2 * sample // max(n, 1)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"order": b["order"], "label": b["label"].astype(int), "x": list(_features(b)), "x_url": b["url"].fillna("")})

    columns = ("order", "label", "url", "host", "path", "suffix_share", "suffix_rate")
    chosen = few.select(*columns).mapInPandas(measure, "order long, label int, x array<double>, x_url string").orderBy("order", "label", "x", "x_url").limit(sample).collect()
    x, y = np.array([r.x for r in chosen], dtype=float).reshape(-1, len(FEATURES)), np.array([r.label for r in chosen], dtype=float)
    # equal urls fall on one side: the order is a hash of the row, so it is the url that decides here
    apart = np.array([zlib.crc32(r.x_url.encode()) % held_out == 0 for r in chosen], dtype=bool)
    right = None
    if apart.any() and not apart.all():
        right = float(((Boosted().fit(x[~apart], y[~apart]).probability(x[apart]) >= 0.5) == (y[apart] > 0)).mean())
    return (Boosted().fit(x, y) if chosen else None), right


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Iterable[tuple[str, str]] = RULES, labels: DataFrame | None = None, sample: int = 20_000, prior: float = 50.0, cut: float = 0.5, few_suffixes: int = 50_000) -> DataFrame:
    """Per row: key, url, host, path, rule, verdict, block_probability, held_out_accuracy.

    labels: (url, label 1 block or 0 allow) to learn from, else the rules' own verdicts. held_out_accuracy is the same for all rows:
    how many of the sampled labelled urls trees judge rightly that have not seen them. It says what the verdicts without
    a rule are worth only for urls like the labelled ones; with the rules' verdicts as labels that is how well the trees
    repeat the rules.
    """
    sheltered(pages, key, url)

    def prepared(df: DataFrame, *keep: Column) -> DataFrame:
        host, path = split_url(F.col(url))
        base = df.select(*keep, F.col(url).cast("string").alias("url"), host.alias("host"), path.alias("path"))
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return base.withColumns({"rule": rule, "rule_verdict": verdict})

    # the key travels as text: pandas would make long columns with nulls inexact
    rows = prepared(pages, F.col(key).cast("string").alias("_key"))
    if labels is None:
        label = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
        training = rows.select("url", "host", "path", label.alias("label"), F.xxhash64("url", "_key").alias("order"))
        stats, n = suffix_statistics(training, prior)
    else:
        training = prepared(labels, F.col("label").cast("int").alias("label")).select("url", "host", "path", "label", F.xxhash64("url", "label").alias("order"))
        stats, n = suffix_statistics(training.select("host", "label").unionByName(rows.select("host", F.lit(None).cast("int").alias("label"))), prior)
    few = stats.limit(few_suffixes + 1).count() <= few_suffixes

    def informed(df: DataFrame) -> DataFrame:
        named = df.withColumn("suffix", suffix_of(F.col("host")))
        return named.join(F.broadcast(stats), "suffix", "left") if few else lookup_join(named, stats, "suffix", heavy_keys(named.select("suffix"), "suffix"))

    model, right = fit(informed(training.where("label IS NOT NULL")), n, sample)
    kind = pages.schema[key].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(block_probability=model.probability(_features(b)) if model else 0.0)

    columns = "_key string, url string, host string, path string, rule string, rule_verdict string, suffix_share double, suffix_rate double"
    scored = informed(rows).select(*(c.split()[0] for c in columns.split(", "))).mapInPandas(score, columns + ", block_probability double")
    learned = F.when(F.col("block_probability") >= cut, "block").otherwise("allow")
    return scored.select(F.col("_key").cast(kind).alias(key), "url", "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), "block_probability", F.lit(right).cast("double").alias("held_out_accuracy"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


QUERIES = {"op5_urls": op5_urls}
ORACLES: dict[str, str] = {}
