import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, share, most):
    """Each step by itself: shares by weight, capped ones leave, the others share the rest."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, rest = {}, list(order), share * sum(sizes.values())
    while free:
        per = rest / sum(w[s] for s in free)
        full = [s for s in free if w[s] * per > most * sizes[s]]
        if not full:
            return out | {s: w[s] * per for s in free}
        for s in full:
            out[s] = most * sizes[s]
            rest -= out[s]
        free = [s for s in free if s not in full]
    return out


def checked(docs, rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """Everything but the direction of the draws; returns the largest distance of a source from its target, as a share of it."""
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(((r.doc_id, r.source, r["size"]) for r in rows), key=str) == sorted(((d, s, size(t)) for d, t, s in docs), key=str)
    total, taken = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        total[s] += size(t)
    for r in rows:
        taken[r.source] += r.taken
    want = shares(total, weights, share, most)
    for r in rows:
        assert r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1.0, want[r.source])
        p = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"] and (r["size"] == 0 or int(p) <= r.copies <= -int(-p // 1))
    return max(abs(taken[s] - want[s]) / max(want[s], 1) for s in total)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert checked([(r.doc_id, r.text, r.source) for r in docs.collect()], rows) < 0.02
    again = mixing.mix(docs.repartition(7, "text")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "p q r", "b"), (None, "p q r", "b"), (4, "word " * 30_000, "c"), (5, "one", "hot"), (6, " \t\n", "empty"), (7, " é ü", "é")]
    rows += [(8, "same words here", "hot")] * 700 + [(i, "w " * (i % 9), "hot") for i in range(9, 400)]
    docs = spark.createDataFrame([(*r, 1.5, 2) for r in rows], "doc_id long, text string, source string, target double, size long")
    got = mixing.mix(docs)
    assert checked(rows, got.collect()) <= 1
    back = mixing.repeated(docs, got)
    assert back.columns == docs.columns
    told = {(r.doc_id, r.source): r.n for r in got.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    assert {(r.doc_id, r.source): r.n for r in back.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()} == told
    assert mixing.mix(docs.limit(0)).count() == 0


def test_many_blocks_stay_near_the_targets_and_are_fair(spark):
    """Several steps of the tree; every size gets its share of copies."""
    rng = np.random.default_rng(3)
    size = np.minimum(rng.pareto(1.1, 60_000) * 20 + 1, 5_000).astype(int)
    docs = spark.createDataFrame([(int(i), int(n), "hot" if i % 3 else f"s{i % 7}") for i, n in enumerate(size)], "doc_id long, n int, source string")
    docs = docs.select("doc_id", F.repeat(F.lit("w "), F.col("n")).alias("text"), "source")
    rows = mixing.mix(docs, share=0.7).toPandas()
    per = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 20).all()
    hot = rows[rows.source == "hot"]
    for low, high in ((1, 8), (8, 64), (64, 6000)):
        some = hot[(hot["size"] >= low) & (hot["size"] < high)]
        assert abs(some.copies.mean() - (hot.target / hot.source_size).iloc[0]) < 0.05
