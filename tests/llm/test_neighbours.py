import numpy as np
from pyspark.sql import functions as F

from sightline.llm import neighbours


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in queries:
        s = x @ np.array(v, dtype=np.float64)
        keep = ids != i
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[i] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def recall(got, want):
    hits = total = 0
    for i, near in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1))
        assert len(mine) == len(near)
        assert all(a[2] > b[2] - 1e-12 and (a[2] > b[2] or a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        hits += len({v for _, v, _ in mine} & {v for v, _ in near})
        total += len(near)
    return hits / total


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = neighbours.op6_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert recall(got, want) >= 0.9
    exact = dict(rows)
    for r in got[:200]:
        total = 0.0
        for a, b in zip(exact[r.query_id], exact[r.vec_id]):
            total += a * b
        assert r.score == total


def test_recall_with_many_lists(spark):
    """12,000 vectors in 90 lists with the registered parameters: lists are pruned, and recall holds."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(60, 24))
    x = centre[rng.integers(0, 60, 12_000)] + rng.normal(size=(12_000, 24)) * 0.45
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), F.col("id") % 40 == 0).collect()
    assert recall(got, brute(rows, [r for r in rows if r[0] % 40 == 0], 20)) >= 0.9


def test_unequal_norms_and_hot_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)) * rng.uniform(0.2, 3, size=(1500, 1))
    x[200:900] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, list_size=32, shelf=64, block=16).collect()
    assert recall(got, brute(rows, [r for r in rows if r[0] % 50 == 0], 20)) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], "x"), (20, [2.0, 1.0], "x"), (20, [2.0, 1.0], "x"), (1, None, "x"), (2, [0.0, 0.0], "x"), (3, [None, 1.0], "x"), (40, [float("nan"), 1.0], "x"), (5, [float("inf"), 0.0], "x"), (None, [1.0, 1.0], "x"), (6, [1.0], "x"), (7, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 4.0), (20, 1, 0, 4.0)]
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_lists_are_balanced():
    """On isotropic, clustered and skewed vectors no list holds over four times the mean."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    for x in (rng.normal(size=(6000, 32)), centre[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16)), centre[rng.zipf(1.6, 6000) % 40] + 0.2 * rng.normal(size=(6000, 16))):
        x = x / np.sqrt((x**2).sum(1))[:, None]
        c = neighbours.balanced_centroids(x[:3000], 60)
        n = np.bincount(((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1), minlength=len(c))
        assert 30 <= len(c) <= 120 and n.max() <= 4 * n.mean(), (len(c), n.max(), n.mean())
