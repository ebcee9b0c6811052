"""Operator 6: approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted by one coordinate, which makes largest inner product the same as smallest distance. Centroids come
from balanced k-means on a hash-ordered sample of at most `sample` vectors; every vector is then indexed: in the list of
its nearest centroid and, at a boundary, also in those of further centroids nearly as close that are not behind one
already chosen. A query finds centroids by best-first search on an in-memory graph of them, keeps the lists whose
distance is within a ratio of the best, and is scored in double precision against the vectors of those lists.

The ratio follows from `recall`: the true neighbours of `trials` sampled vectors among all rows tell which ratio opens a
list of the wanted share of them, and how many lists that takes, so pruning adapts to the table at every size. Lists are
split into parts of bounded size, and so are the queries that meet a list, so a list that holds a third of all vectors
is many tasks. What is broadcast, centroids and their graph, is bounded by `most_lists`.

Scores are summed coordinate by coordinate, so that they do not depend on which vectors are scored together. Vectors that
are null, zero, hold nulls or non-finite numbers, or differ in length from most take no part, nor do rows without an id.
Rows that share an id count as one candidate, with the largest score. Ties go to the smaller id. Extra columns of the
input are ignored. An empty table gives an empty result; with fewer than k other vectors a query gets all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_waves, sheltered, written


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.where(F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).select("width")
    return rows.join(F.broadcast(width), F.size("v") == F.col("width")).select("id", "v")


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, pull: float = 0.15, repairs: int = 10) -> np.ndarray:
    """About k centroids with lists of like length: k-means in which full clusters look farther, then repairs.

    Lifted vectors lie on one sphere, and centroids are put on it too: one nearer to the middle would be near to all. A repair
    splits clusters of over twice the mean along their longest direction and drops those of under a quarter.
    """
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    rng = np.random.default_rng(7)
    radius = np.sqrt((x**2).sum(1).max())
    c = x[rng.choice(len(x), k, replace=False)]

    def nearest(weight: np.ndarray) -> np.ndarray:
        near = np.empty(len(x), dtype=np.int64)
        for i in range(0, len(x), 4096):
            d = np.maximum((x[i : i + 4096] ** 2).sum(1)[:, None] - 2 * x[i : i + 4096] @ c.T + (c**2).sum(1), 0)
            near[i : i + 4096] = (d * weight).argmin(1)
        return near

    def means(near: np.ndarray) -> np.ndarray:
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        made = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), len(c))])
        length = np.sqrt((made**2).sum(1))[:, None]
        return np.where(length > 0, made * radius / np.maximum(length, 1e-300), made)

    weight = np.ones(k)
    for _ in range(rounds):
        near = nearest(weight)
        c = means(near)
        weight = 1 + pull * np.clip(np.bincount(near, minlength=len(c)) * len(c) / len(x) - 1, -1, 4)
    for _ in range(repairs):
        near = nearest(np.ones(len(c)))
        n = np.bincount(near, minlength=len(c))
        mean = len(x) / len(c)
        large, small = np.flatnonzero(n > 2 * mean), np.flatnonzero(n < mean / 4)
        if not len(large) and not len(small):
            break
        halves = []
        for j in large:
            own = x[near == j]
            side = (own - own.mean(0)) @ np.linalg.svd(own - own.mean(0), full_matrices=False)[2][0]
            halves += [own[side <= np.median(side)].mean(0), own[side > np.median(side)].mean(0)] if (side > np.median(side)).any() else [own.mean(0)]
        c = np.concatenate([c[np.setdiff1d(np.arange(len(c)), np.union1d(large, small))], *([np.array(halves)] if halves else [])])
        c = means(nearest(np.ones(len(c))))
    return c


class Graph:
    """Centroids with links to near ones, and a few far ones, searched best first."""

    def __init__(self, c: np.ndarray, degree: int = 24, far: int = 4) -> None:
        self.c = c
        rng = np.random.default_rng(11)
        links = []
        for i in range(0, len(c), 512):
            d = (c[i : i + 512] ** 2).sum(1)[:, None] - 2 * c[i : i + 512] @ c.T + (c**2).sum(1)
            links.append(np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1])
        near = np.concatenate(links) if links else np.zeros((0, 0), dtype=np.int64)
        self.links = np.concatenate([near, rng.integers(0, max(1, len(c)), (len(c), far))], 1)
        self.entries = rng.choice(len(c), min(8, len(c)), replace=False) if len(c) else np.zeros(0, dtype=np.int64)

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        """About the `width` nearest centroids, as (distance, number), nearest first."""

        def distance(at: np.ndarray) -> np.ndarray:
            return ((self.c[at] - q) ** 2).sum(1)

        seen = np.zeros(len(self.c), dtype=bool)
        seen[self.entries] = True
        todo = sorted(zip(distance(self.entries).tolist(), self.entries.tolist(), strict=True))
        best = [(-d, i) for d, i in todo[:width]]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = np.unique(self.links[i])
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            for d, j in zip(distance(new).tolist(), new.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-d, j))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, j))
                else:
                    continue
                heapq.heappush(todo, (d, j))
        return sorted((-d, i) for d, i in best)


def lists_of(x: np.ndarray, c: np.ndarray, slack: float, most: int) -> list[list[int]]:
    """For each vector its nearest centroid, then those within the slack, unless closer to a chosen one than to the vector."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0))
    tried = min(len(c), 4 * most)
    order = np.argpartition(d, tried - 1, axis=1)[:, :tried] if tried < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    out = []
    for row, cand in zip(d, order, strict=True):
        cand = cand[np.lexsort((cand, row[cand]))]
        chosen = [int(cand[0])]
        limit = (1 + slack) * row[cand[0]]
        for j in cand[1:]:
            if len(chosen) == most or row[j] > limit:
                break
            if all(((c[j] - c[i]) ** 2).sum() > row[j] ** 2 * 0.25 for i in chosen):
                chosen.append(int(j))
        out.append(chosen)
    return out


def shelves(c: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The number of each list's shelf. Lists follow each other from one centroid to the nearest that is left, and fill a shelf up to `most` vectors."""
    place, left = np.zeros(len(c), dtype=np.int64), np.ones(len(c), dtype=bool)
    at, number, held = 0, 0, 0
    for _ in range(len(c)):
        if held and held + sizes[at] > most:
            number, held = number + 1, 0
        place[at], left[at] = number, False
        held += int(sizes[at])
        if left.any():
            rest = np.flatnonzero(left)
            at = rest[((c[rest] - c[at]) ** 2).sum(1).argmin()]
    return place


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, each summed from the first coordinate to the last."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, q, strict=True):
        total += a * b
    return total


def _top(scores: np.ndarray, x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the k largest, ties to the smaller id; `scores` may be off by rounding."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        slack = 1e-12 * float(np.abs(q).sum() * np.abs(x).max())
        at = np.flatnonzero(scores >= cut - slack)
    exact = products(x[at], q)
    order = np.lexsort((ids[at], -exact))[:k]
    return at[order], exact[order]


def true_neighbours(rows: DataFrame, trials: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(trial, vector) of the k best of all rows for each trial, its own id left out: trials * k vectors at most."""
    shared = rows.sparkSession.sparkContext.broadcast((trials, own))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, mine = shared.value
        ids, x = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0, q.shape[1]))
        score = np.zeros((len(q), 0))
        for b in batches:
            if not len(b):
                continue
            more = np.stack(b["v"].to_numpy())
            new = b["id"].to_numpy()
            s = np.where(new[None, :] == mine[:, None], -np.inf, q @ more.T)
            at = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
            score = np.concatenate([score, np.take_along_axis(s, at, 1)], 1)
            ids, x = np.concatenate([ids, new[at]], 1), np.concatenate([x, more[at]], 1)
            at = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, ids, x = np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1), np.take_along_axis(x, at[:, :, None], 1)
        t, n = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"trial": t, "score": score[t, n], "v": [v.tobytes() for v in x[t, n]]})

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        return b.nlargest(k, "score")[["trial", "v"]]

    found = in_waves(rows, 2).mapInPandas(best, "trial long, score double, v binary")
    out = found.groupBy("trial").applyInPandas(merge, "trial long, v binary").collect()
    return np.array([r.trial for r in out], dtype=np.int64), np.array([np.frombuffer(r.v, dtype=np.float64) for r in out]).reshape(len(out), -1)


def search(
    vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = 20_000, list_size: int = 128, most_lists: int = 4096,
    replicas: int = 4, slack: float = 0.1, recall: float = 0.97, trials: int = 256, shelf: int = 8192, block: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `queries` (on the column id) selects, its k nearest."""
    sheltered(vectors, key, vector)
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    counted = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not counted.n:
        return spark.createDataFrame([], schema)
    bound = float(counted.m)
    floor = 1e-4 * bound  # of squared distances: below it a ratio says nothing
    chosen = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect()

    def lifted(x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(bound - (x**2).sum(1), 0))
        return np.column_stack([x, extra])

    sampled = np.array([r.v for r in chosen])
    centroids = balanced_centroids(lifted(sampled), int(min(max(1, counted.n // list_size), most_lists, max(1, len(chosen) // 4))))
    shared = spark.sparkContext.broadcast(Graph(centroids))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value.c
        for b in batches:
            x = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, c.shape[1] - 1))
            ids, out = b["id"].to_numpy(), []
            for i in range(0, len(x), 1024):
                for n, found in zip(range(i, len(x)), lists_of(lifted(x[i : i + 1024]), c, slack, replicas), strict=False):
                    out += [(j, ids[n], x[n].tobytes()) for j in found]
            yield pd.DataFrame(out, columns=["list", "id", "v"])

    # near lists stand on a shelf together: a query meets the shelves of its lists once each, whatever the number of lists
    postings = written(rows.mapInPandas(index, "list long, id long, v binary"), "postings")
    sizes = np.zeros(len(centroids), dtype=np.int64)
    for r in postings.groupBy("list").count().collect():  # at most most_lists rows
        sizes[r["list"]] = r["count"]

    # how far the lists of true neighbours are, as ratios to the nearest list, decides how many are opened
    tried, found = true_neighbours(rows, sampled[:trials], np.array([r.id for r in chosen[:trials]]), k)
    ratio, width = 1.0, len(centroids)
    if len(tried):
        q = lifted(sampled[:trials], query=True)
        d = np.maximum((q**2).sum(1)[:, None] - 2 * q @ centroids.T + (centroids**2).sum(1), floor)
        d = np.sqrt(d / d.min(1, keepdims=True))
        lists = [x for i in range(0, len(found), 1024) for x in lists_of(lifted(found[i : i + 1024]), centroids, slack, replicas)]
        ratio = float(np.quantile([d[t, x].min() for t, x in zip(tried, lists, strict=True)], recall, method="higher")) * (1 + 1e-9)
        width = min(len(centroids), int(1.25 * (d <= ratio).sum(1).max()) + 8)
    place = shelves(centroids, sizes, shelf)
    # the sample's k best bound what any other list may add: they are candidates, and lists return what is not worse
    own = np.array([r.id for r in chosen], dtype=np.int64)
    once_each = np.unique(own, return_index=True)[1]
    held = spark.sparkContext.broadcast((sizes, place, own[once_each], sampled[once_each]))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, (size, at, sample_ids, sample_x) = shared.value, held.value
        for b in batches:
            out = []
            for i, v in zip(b["id"], b["v"], strict=True):
                v = np.array(v)
                q = lifted(v[None, :], query=True)[0]
                found = graph.search(q, width)
                limit = ratio**2 * max(found[0][0], floor)
                near = [j for d, j in found if max(d, floor) <= limit]
                got = int(size[near].sum())
                if got < replicas * (k + 1):  # so few might hold less than k others: further lists, nearest first
                    rest = np.setdiff1d(np.arange(len(size)), near)
                    for j in rest[np.argsort(((graph.c[rest] - q) ** 2).sum(1), kind="stable")].tolist():
                        if got >= replicas * (k + 1):
                            break
                        got += int(size[j])
                        near.append(j)
                best, exact = _top(np.where(sample_ids == i, -np.inf, sample_x @ v), sample_x, v, sample_ids, k)
                least = exact[-1] - 1e-12 * (np.abs(v).sum() * bound**0.5) if len(exact) == k else -np.inf
                there = np.unique(at[near]).tolist()
                out += [(j, i, v.tobytes(), least, sample_ids[best] if j == there[0] else [], exact if j == there[0] else []) for j in there]
            yield pd.DataFrame(out, columns=["shelf", "query_id", "q", "least", "ids", "scores"])

    asked = written(rows.where(queries).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").mapInPandas(probe, "shelf long, query_id long, q binary, least double, ids array<long>, scores array<double>"), "probes")
    there, met = np.bincount(place, sizes).astype(np.int64), np.zeros(int(place.max()) + 1, dtype=np.int64)
    for r in asked.groupBy("shelf").count().collect():
        met[r["shelf"]] = r["count"]
    # at most most_lists rows each: a long shelf is split, and so are the queries that meet it
    split = [(j, int(-(-there[j] // shelf)), int(-(-met[j] // block))) for j in range(len(met)) if there[j] and met[j]]
    split = spark.createDataFrame(split, "shelf long, parts long, blocks long")
    standing = spark.createDataFrame(list(enumerate(place.tolist())), "list long, shelf long")
    left = postings.join(F.broadcast(standing), "list").join(F.broadcast(split), "shelf").withColumn("p", F.pmod(F.xxhash64("id"), "parts")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = asked.join(F.broadcast(split), "shelf").withColumn("b", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def score(some: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(some) and len(ask):
            some = some.drop_duplicates(["id", "v"]).sort_values("id", kind="stable")  # copies of a boundary vector
            ids = some["id"].to_numpy()
            x = np.frombuffer(b"".join(some["v"]), dtype=np.float64).reshape(len(ids), -1)
            q = np.frombuffer(b"".join(ask["q"]), dtype=np.float64).reshape(len(ask), -1)
            names, least = ask["query_id"].to_numpy(), ask["least"].to_numpy()
            for n in range(0, len(q), 128):
                for i, v, s, low in zip(names[n : n + 128], q[n : n + 128], q[n : n + 128] @ x.T, least[n : n + 128], strict=True):
                    at, exact = _top(np.where((ids == i) | (s < low), -np.inf, s), x, v, ids, k)
                    out.append((np.full(len(at), i), ids[at], exact))
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ("shelf", "p", "b")
    found = left.select(*keys, "id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "q", "least").groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
    known = asked.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("z")).select("query_id", F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score"))
    once = found.unionByName(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


QUERIES = {"op6_neighbours": op6_neighbours}
ORACLES: dict[str, str] = {}
