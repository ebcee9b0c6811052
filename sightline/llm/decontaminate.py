"""Operator 7: benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of words. Their features are the benchmark items' rarer words, weighted by inverse
document frequency over the whole corpus. A randomised SVD of all passages' TF-IDF rows (one pass: per task a sketch
AᵀAΩ of features by rank, summed by blocks, then a Nyström decomposition) gives a latent space. Passages whose cosine to
an item, or to a passage of an item longer than a window, reaches `cosine` there are candidates. Around a candidate, a document matches an item where the longest common
subsequence of words covers enough of the item, or covers less of it but also enough of the item's answer, its last
sentence. Exact passages and paraphrases that keep the order of most words are found this way. Items with at most `few`
features say too little to a cosine: their candidates are the passages that hold one of the features.

The benchmark is worked in blocks of `block` different items: each block's model is broadcast on its own, and where there
are several, the results of each are written before the next one. An item is a row's id and
text: texts may share an id, and items with a null id count like all others. Null and empty texts, and items without
words, match nothing; repeated rows of either table get repeated results; ties between places go to the first; very long texts
are searched whole; extra columns of the input are left as they are. An empty benchmark matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_waves, sheltered, written
from .jaccard import _MULTIPLIERS, _powers, mix

_U = np.uint64
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
MATCHES = "array<struct<item_id:long,cosine:double,lcs:double,answer:double,at:long,times:long>>"


def word_codes(text: str | None) -> np.ndarray:
    """A hash for each word of the text in lower case: runs of ASCII letters, digits and all other characters beyond ASCII."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=_U)
    edge = np.flatnonzero(np.diff(_INSIDE[raw], prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    _powers.reach(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((raw.astype(_U) + _U(1)) * _powers.up[: len(raw)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * _powers.down[start] + (stop - start).astype(_U) * _MULTIPLIERS[0])


class Lookup:
    """Positions in a sorted array of hashes, or -1; most absent hashes fail in a small table."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(known & _U((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, positions in known) of those that are known."""
        if not len(self.known):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.table[(h & _U((1 << 20) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        ok = self.known[i] == h[at]
        return at[ok], i[ok]


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray
    times: int


def items_of(rows: list[tuple[int | None, str | None, int]]) -> list[Item]:
    """Items, from (id, text, number of such rows), with their answer: the last sentence, or the last quarter where there is only one."""
    out = []
    for i, text, times in rows:
        words = word_codes(text)
        if not len(words):
            continue
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if len(word_codes(s))]
        answer = word_codes(sentences[-1]) if len(sentences) > 1 else words[-max(1, len(words) // 4) :]
        out.append(Item(i, words, answer, times))
    return out


def places_of(a: np.ndarray) -> dict[int, int]:
    """For each word the bits of its places."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    return where


def passages(words: np.ndarray, window: int) -> list[np.ndarray]:
    """The whole, and for more words than a window holds also half-overlapping windows of it, the last one at its end."""
    if len(words) <= window:
        return [words]
    starts = [*range(0, len(words) - window, max(1, window // 2)), len(words) - window]
    return [words, *(words[s : s + window] for s in starts)]


def subsequence(a: np.ndarray, b: np.ndarray, where: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where = places_of(a) if where is None else where
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Model:
    """A block of items with its features, weights and latent space; searches one text at a time."""

    def __init__(self, items: list[Item], features: np.ndarray, weight: np.ndarray, basis: np.ndarray, window: int, cosine: float, lcs: float, lcs_answer: float, answer: float, few: int = 3) -> None:
        self.items, self.window = items, window
        self.cosine, self.lcs, self.lcs_answer, self.answer = cosine, lcs, lcs_answer, answer
        self.basis = (basis * weight[:, None]).astype(np.float32)
        # an item's words as numbers among all items' words, and how often it has each
        self.vocabulary = Lookup(np.unique(np.concatenate([x.words for x in items])))
        known = self.vocabulary.known
        self.feature = np.full(len(known), -1)
        self.feature[np.searchsorted(known, features)] = np.arange(len(features))
        self.owns, self.bits = [], []
        owner, rows = [], []
        for n, item in enumerate(items):
            self.owns.append(np.unique(np.searchsorted(known, item.words), return_counts=True))
            self.bits.append(places_of(item.words))
            for passage in passages(item.words, window):
                f = self.feature[np.searchsorted(known, np.unique(passage))]
                owner.append(n)
                rows.append(self.basis[f[f >= 0]].sum(0))
        self.owner, z = np.array(owner), np.array(rows, dtype=np.float32)
        self.latent = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        self.own, self.often = (np.concatenate(x) for x in zip(*self.owns, strict=True))
        self.edge = np.concatenate([[0], np.cumsum([len(x) for x, _ in self.owns])[:-1]])
        marks = [self.feature[x] for x, _ in self.owns]
        self.short = {n: f[f >= 0] for n, f in enumerate(marks) if (f >= 0).sum() <= few}
        self.least = lcs_answer * np.array([len(x.words) for x in items])

    def search(self, text: str | None) -> list[tuple[int | None, float, float, float, int, int]]:
        words = word_codes(text)
        there, v = self.vocabulary.find(words)
        # the words that text and item have in common, each as often as both have it, bound the common subsequence
        shared = np.minimum(np.bincount(v, minlength=len(self.feature))[self.own], self.often)
        possible = np.add.reduceat(shared, self.edge) >= self.least
        if not possible.any():
            return []
        f = self.feature[v]
        at, f = there[f >= 0], f[f >= 0]
        start, lo, hi = windows(len(words), at, self.window, 1)
        if not len(start):
            return []
        rows = np.flatnonzero(possible[self.owner])
        owner = self.owner[rows]
        sums = np.zeros((len(at) + 1, self.basis.shape[1]), dtype=np.float32)
        np.cumsum(self.basis[f], axis=0, out=sums[1:])
        z = sums[hi] - sums[lo]
        cos = z @ self.latent[rows].T / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        near, row = np.nonzero(cos >= self.cosine)
        pairs = [owner[row] * len(start) + near]
        for n in self.short.keys() & set(np.flatnonzero(possible).tolist()):
            places = np.append(0, np.cumsum(np.isin(f, self.short[n])))
            pairs.append(n * len(start) + np.flatnonzero(places[hi] > places[lo]))
        pairs = np.unique(np.concatenate(pairs))
        if not len(pairs):
            return []
        first = np.flatnonzero(np.diff(pairs // len(start), prepend=-1))
        spot = np.full(len(self.vocabulary.known), -1)
        out = []
        for chosen in np.split(pairs, first[1:]):
            n = int(chosen[0]) // len(start)
            found = self.best(n, chosen % len(start), start, words, there, v, spot)
            if found:
                w, *rest = found
                out.append((self.items[n].item_id, float(cos[w, owner == n].max()), *rest, self.items[n].times))
        return out

    def best(self, n: int, near: np.ndarray, start: np.ndarray, words: np.ndarray, there: np.ndarray, v: np.ndarray, spot: np.ndarray) -> tuple[int, float, float, int] | None:
        """The first of the best places around windows `near`: window, shares of the item and its answer, first word."""
        item, (own, often) = self.items[n], self.owns[n]
        size, least = len(item.words), self.least[n]
        spot[own] = np.arange(len(own))
        mine = spot[v]
        spot[own] = -1
        at, mine = there[mine >= 0], mine[mine >= 0]
        span, step = size + max(4, size // 3), max(1, size // 4)
        a, e = np.maximum(0, start[near] - size), np.minimum(len(words), start[near] + self.window + size)
        enough = np.searchsorted(at, e) - np.searchsorted(at, a) >= least
        near, a, e = near[enough], a[enough], e[enough]
        steps = -(-np.maximum(1, e - a - span + step) // step)
        w = np.repeat(near, steps)
        begin = np.repeat(a, steps) + step * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
        lo, hi = np.searchsorted(at, begin), np.searchsorted(at, np.minimum(begin + span, np.repeat(e, steps)))
        found, seen = None, set()
        for k in np.flatnonzero(hi - lo >= least):
            x, y = int(lo[k]), int(hi[k])
            if (x, y) in seen:
                continue
            seen.add((x, y))
            bound = np.minimum(np.bincount(mine[x:y], minlength=len(own)), often).sum()
            if bound < least or (found and bound <= found[1] * size):
                continue
            part = words[at[x:y]]
            share = subsequence(item.words, part, self.bits[n]) / size
            if share >= self.lcs_answer and (not found or share > found[1]):
                good = subsequence(item.answer, part) / len(item.answer)
                if share >= self.lcs or good >= self.answer:
                    found = (int(w[k]), share, good, int(begin[k]))
                    if share >= 1.0:
                        break
        return found


def windows(n: int, at: np.ndarray, window: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the half-overlapping windows with `least` features or more, and the ranges of features in them."""
    start = np.arange(0, max(1, n - window // 2), window // 2)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, start + window)
    ok = hi - lo >= least
    return start[ok], lo[ok], hi[ok]


def document_frequency(documents: DataFrame, text: str, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and for each hash the number of documents with that word; over all documents."""
    lookup = Lookup(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(len(known), dtype=np.int64)
        for b in batches:
            for t in b["text"]:
                n += 1
                _, f = lookup.find(word_codes(t))
                there = np.zeros(len(known), dtype=bool)
                there[f] = True
                total += there
        full = np.flatnonzero(total)
        yield pd.DataFrame({"f": np.append(full, -1), "n": np.append(total[full], n)})

    rows = documents.select(F.col(text).cast("string").alias("text")).mapInPandas(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(len(known), dtype=np.int64), 0
    for r in rows:  # at most one row for each word of the items of a block
        if r.f < 0:
            n = r.n
        else:
            out[r.f] = r.n
    return n, out


def latent_basis(documents: DataFrame, text: str, features: np.ndarray, weight: np.ndarray, rank: int, window: int, over: int = 16, stripe: int = 256) -> np.ndarray:
    """Right singular vectors (features by rank) of the matrix of all passages' normalised TF-IDF rows."""
    k = min(rank + over, len(features))
    omega = np.random.default_rng(17).normal(size=(len(features), k)).astype(np.float32)
    lookup = Lookup(features)
    scaled = (omega * weight[:, None]).astype(np.float32)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = np.zeros((len(features), k), dtype=np.float32)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            """Z += Aᵀ(AΩ) for the windows held: each is a run of features."""
            f = np.concatenate([x for x, _ in held])
            size = np.concatenate([s for _, s in held])
            edge = np.concatenate([[0], np.cumsum(size)[:-1]])
            y = np.add.reduceat(scaled[f], edge, axis=0) / np.add.reduceat(weight[f] ** 2, edge)[:, None]
            order = np.argsort(f, kind="stable")
            row = np.repeat(np.arange(len(size)), size)[order]
            cut = np.flatnonzero(np.diff(f[order], prepend=-1))
            z[f[order][cut]] += np.add.reduceat(y[row], cut, axis=0).astype(np.float32) * weight[f[order][cut]][:, None]
            held.clear()

        n = 0
        for b in batches:
            for t in b["text"]:
                words = word_codes(t)
                at, f = lookup.find(words)
                _, lo, hi = windows(len(words), at, window)
                if len(lo):
                    size = hi - lo
                    inside = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
                    held.append((f[inside], size))
                    n += len(inside)
                if n > 20_000:
                    add()
                    n = 0
        if held:
            add()
        for i in range(0, len(z), stripe):
            yield pd.DataFrame({"stripe": [i], "z": [z[i : i + stripe].tobytes()]})

    def total(b: pd.DataFrame) -> pd.DataFrame:
        z = np.sum([np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in b["z"]], axis=0)
        return pd.DataFrame({"stripe": b["stripe"].iloc[:1], "z": [z.astype(np.float32).tobytes()]})

    # as many partial sketches as two waves of tasks, whatever the number of input splits
    texts = in_waves(documents.select(F.col(text).cast("string").alias("text")), 2)
    parts = texts.mapInPandas(sketch, "stripe long, z binary").groupBy("stripe").applyInPandas(total, "stripe long, z binary").collect()
    z = np.zeros((len(features), k))
    for r in parts:
        block = np.frombuffer(r.z, dtype=np.float32).reshape(-1, k)
        z[r.stripe : r.stripe + len(block)] = block
    core = omega.T @ z
    core = (core + core.T) / 2 + 1e-6 * max(1e-9, float(np.trace(core)) / k) * np.eye(k)
    s, u = np.linalg.eigh(core)
    s = np.maximum(s, 1e-9 * max(float(s.max()), 1e-30))
    left, _, _ = np.linalg.svd(z @ (u / np.sqrt(s)), full_matrices=False)
    return left[:, : min(rank, left.shape[1])]


def models(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rank: int = 256, window: int = 48, block: int = 2000, cosine: float = 0.35, lcs: float = 0.75, lcs_answer: float = 0.6, answer: float = 0.6, common: float = 0.02, fewest: int = 8) -> Iterator[tuple[Model, bool]]:
    """A model for each block of items in turn, and whether it is the only one. Features: an item's words in at most a share `common` of documents, or its `fewest` rarest."""
    sheltered(documents, text)
    sheltered(benchmark, item, item_text)
    # one row for each id and text; the digest of the text gives those of one id an order
    every = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL")
    every = written(every.groupBy("i", "t").agg(F.count("*").alias("times")).withColumn("d", F.sha2(F.col("t").cast("binary"), 256)), "items")
    rest, only = every, every.count() <= block
    while True:
        rows = rest.orderBy(F.col("i").asc_nulls_first(), "d").limit(block).collect()
        if not rows:
            return
        i, d = rows[-1].i, rows[-1].d
        rest = every.where(F.col("i").isNotNull() | (F.col("d") > d)) if i is None else every.where((F.col("i") > i) | ((F.col("i") == i) & (F.col("d") > d)))
        rows = [(r.i, r.t, r.times) for r in rows]
        items = items_of(rows)
        known = np.unique(np.concatenate([np.zeros(0, dtype=_U), *(x.words for x in items)]))
        if not len(known):
            continue
        n, df = document_frequency(documents, text, known)
        keep = np.zeros(len(known), dtype=bool)
        for x in items:
            f = np.searchsorted(known, np.unique(x.words))
            keep[f[df[f] <= common * n]] = True
            keep[f[np.argsort(df[f], kind="stable")[:fewest]]] = True
        features, weight = known[keep], np.log((n + 1) / (df[keep] + 0.5)).astype(np.float32)
        weight = np.maximum(weight, 1e-3)
        basis = latent_basis(documents, text, features, weight, rank, window)
        yield Model(items, features, weight, basis, window, cosine, lcs, lcs_answer, answer), only


def matches(text: Column, model: Model, spark: SparkSession) -> Column:
    """For each text the items of a block that it holds: item_id, cosine, shares of the item and of its answer, first word."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(MATCHES)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = [[dict(zip(("item_id", "cosine", "lcs", "answer", "at", "times"), x, strict=True)) for x in shared.value.search(t)] for t in s]
            yield pd.Series(out)

    return search(text.cast("string"))


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each document and item that it holds: key, item_id, cosine, lcs, answer, at."""
    sheltered(documents, key, text)
    kind = documents.schema[key].dataType.simpleString()
    out = documents.sparkSession.createDataFrame([], f"`{key}` {kind}, item_id long, cosine double, lcs double, answer double, at long")
    for model, only in models(documents, benchmark, text, **options):
        rows = documents.select(F.col(key).alias("_key"), matches(F.col(text), model, documents.sparkSession).alias("m"))
        rows = rows.select("_key", F.explode("m").alias("m"))
        rows = rows.select("_key", "m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m.times"))))
        rows = rows.select(F.col("_key").alias(key), "m.item_id", "m.cosine", "m.lcs", "m.answer", "m.at")
        if only:
            return rows
        out = out.unionByName(written(rows, "matches"))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    left = documents
    for model, only in models(documents, benchmark, text, **options):
        left = left.where(F.size(matches(F.col(text), model, documents.sparkSession)) == 0)
        left = left if only else written(left, "clean")
    return left


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES: dict[str, str] = {}
