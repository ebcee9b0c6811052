"""Operator 8: exact Jaccard join on word 5-shingles by a token-group matrix.

Documents with the same set of shingles are one node. Nodes meet in blocks of bounded rows and bytes; a block is a matrix
of nodes and tokens, in which similar nodes are partitioned into groups that store the union of their tokens. A node's
overlap with a union bounds its overlap with each member, and only groups whose bound qualifies are opened. That happens
twice: on bitmaps, which tells the nodes that can have a link in the block at all, then for those on their full sets.
There links are found and united at once: a block gives each node's least partner in the block's components, never more
rows than nodes, and no pair leaves it.

The first blocks are nodes with the same minimum hash. They find most links, and their components are merged. The second
ones make the result complete: every node posts the shingles of its prefix, of which two sets at the threshold must share
one; the nodes that share a shingle, are not all connected yet and have like sizes form blocks, and where they are too
many, blocks that meet pairwise.

Shingles are 64-bit hashes, sets are named by 128 bits. Prefixes put shingles last that are frequent in a sample of about
`order_sample` documents, counted in a table of fixed size; the sample moves work, not results. Shingles that are frequent
there are posted by node, all others by shingle, so no task gathers a frequent one.

Null and empty texts and texts without words have an empty set, link with nothing and are their own component. Repeated
rows are one node; rows that share an id but not a text are separate documents with one id. Rows without an id are left
out. Very long texts count whole. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_from, heavy_keys, in_waves, lookup_join, marked_ids, release, releasing, sheltered, written
from .graph import components

_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=_U)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
SEEDS = (0x1234567, 0x9ABCDEF1)
WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as any text so far needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_powers = _Powers()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word: A-Z lower-cased, words between space and the characters 9 to 13."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=_U)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    _powers.reach(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((raw.astype(_U) + _U(1)) * _powers.up[: len(raw)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * _powers.down[start] + (stop - start).astype(_U))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; of the whole sequence where it has fewer words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    total = np.full(n, min(len(w), WORDS), dtype=_U)
    for j in range(min(len(w), WORDS)):
        total += w[j : j + n] * _MULTIPLIERS[j]
    return np.unique(mix(total))


def digest_of(hashes: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return hashlib.blake2b(hashes, digest_size=16).digest()


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """4 to 8 bits per shingle, a power of two in all: a longer bitmap folds onto a shorter one."""
    width = 1 << max(9, min(17, (4 * len(hashes) - 1).bit_length()))
    bits = np.zeros(width, dtype=bool)
    bits[(hashes & _U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


#: Slots of the table that counts the sampled documents' shingles, and of one row of it on its way to the driver.
SLOTS, STRIPE = 1 << 22, 1 << 14
#: So many of a node's blocks are known where it meets others, to leave out nodes met before; LATER stands for none.
NAMES, LATER = 8, np.iinfo(np.int64).max


def prefix(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The shingles of which any set at the threshold must share one: the first in the order of (frequency class, hash)."""
    n = len(hashes)
    length = n + (-4 * n // 5) + 1
    level = order[(hashes & _U(SLOTS - 1)).astype(np.int64)]
    return hashes[np.argsort(level, kind="stable")[:length]]


def shingle_order(rows: DataFrame, total: int, sample: int) -> tuple[np.ndarray, int]:
    """(frequency class by slot, class from which a shingle is posted by node), from about `sample` documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(SLOTS, dtype=np.uint32)
        for b in batches:
            for text in b["text"]:
                slot, n = np.unique((shingles(text) & _U(SLOTS - 1)).astype(np.int64), return_counts=True)
                table[slot] += n.astype(np.uint32)
        for i in range(0, SLOTS, STRIPE):
            if table[i : i + STRIPE].any():
                yield pd.DataFrame({"stripe": [i], "counts": [np.minimum(table[i : i + STRIPE], 65535).astype(np.uint16).tobytes()]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        counts = np.sum([np.frombuffer(x, dtype=np.uint16).astype(np.uint32) for x in b["counts"]], axis=0)
        return pd.DataFrame({"stripe": b["stripe"].iloc[:1], "counts": [_level(counts).tobytes()]})

    chosen = rows.where(F.pmod(F.xxhash64("id", "th"), F.lit(max(total, 1))) < sample).select("text")
    chosen = in_waves(chosen, 2)
    order = np.zeros(SLOTS, dtype=np.uint8)
    for r in chosen.mapInPandas(count, "stripe long, counts binary").groupBy("stripe").applyInPandas(add, "stripe long, counts binary").collect():
        order[r.stripe : r.stripe + STRIPE] = np.frombuffer(r.counts, dtype=np.uint8)
    taken = min(total, sample)
    often = min(max(taken // 400, 16), max(16, 1_000_000 * taken // max(total, 1)))
    return order, int(_level(np.array([often]))[0])


def _level(counts: np.ndarray) -> np.ndarray:
    """Frequency classes: below 4, then quarters of octaves."""
    return np.where(counts < 4, 0, np.floor(4 * np.log2(np.maximum(counts, 4) / 4)) + 1).astype(np.uint8)


def _ids(documents: DataFrame, key: str, text: str) -> DataFrame:
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull())
    return rows.withColumn("th", F.xxhash64("text"))


def signatures(rows: DataFrame, order: np.ndarray, node_bits: int) -> DataFrame:
    """(id, th, n, digest, node, key0.., bits, prefix) of every row, as a written table."""
    shared = rows.sparkSession.sparkContext.broadcast(order)
    keys = [f"key{k}" for k in range(len(SEEDS))]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, th, text in zip(b["id"].to_numpy(), b["th"].to_numpy(), b["text"], strict=True):
                h = shingles(text)
                if len(h):
                    name = digest_of(h)
                    node = int.from_bytes(name[:8], "little", signed=True) >> (64 - node_bits)
                    least = [int(mix(h ^ _U(s)).min().astype(np.int64)) for s in SEEDS]
                    out.append((i, th, len(h), name, node, *least, bitmap(h).tobytes(), prefix(h, shared.value).tobytes()))
                else:
                    out.append((i, th, 0, b"", 0, *(0 for _ in SEEDS), b"", b""))
            yield pd.DataFrame(out, columns=["id", "th", "n", "digest", "node", *keys, "bits", "prefix"])

    schema = "id long, th long, n long, digest binary, node long, " + "".join(f"{k} long, " for k in keys) + "bits binary, prefix binary"
    return written(rows.select("id", "th", "text").mapInPandas(releasing(sign), schema), "signatures")


def distinct_sets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed with a node for each set, nodes): where two sets have one number, all but one of them get another."""
    while True:
        columns = [F.first(c).alias(c) for c in ("n", *(f"key{k}" for k in range(len(SEEDS))), "bits")]
        nodes = written(signed.where("n > 0").groupBy("node").agg(F.min("digest").alias("digest"), F.max("digest").alias("_last"), F.min(F.struct("id", "th")).alias("rep"), *columns), "nodes")
        twice = nodes.where("digest <> _last").select(F.col("node").alias("_node"), F.col("digest").alias("_digest"))
        if twice.isEmpty():  # as a rule, up to some 10^9 sets
            return signed, nodes.drop("_last")
        moved = F.col("_digest").isNotNull() & (F.col("digest") != F.col("_digest"))
        signed = written(signed.join(F.broadcast(twice), F.col("node") == F.col("_node"), "left").withColumn("node", F.when(moved, F.xxhash64("node", "digest")).otherwise(F.col("node"))).drop("_node", "_digest"), "signatures")


def shared_prefixes(signed: DataFrame, order: np.ndarray, often: int, buckets: int) -> DataFrame:
    """(group, node): the nodes that share a prefix shingle; shingles shared by the same nodes are one group (per bucket)."""
    shared = signed.sparkSession.sparkContext.broadcast(order)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pd.DataFrame:
            nodes = np.repeat(np.array(list(held), dtype=np.int64), [len(v) for v in held.values()])
            tokens = np.concatenate(list(held.values()))
            bucket = ((tokens >> _U(40)) % _U(buckets)).astype(np.int64)
            hot = shared.value[(tokens & _U(SLOTS - 1)).astype(np.int64)] >= often
            bucket = np.where(hot, -1 - ((mix(nodes.view(_U)) >> _U(20)) % _U(buckets)).astype(np.int64), bucket)
            at = np.argsort(bucket, kind="stable")
            cut, stop = _runs(bucket[at])
            return pd.DataFrame({"bucket": bucket[at[cut]], "tokens": [tokens[at[s:e]].tobytes() for s, e in zip(cut, stop, strict=True)], "nodes": [nodes[at[s:e]].tobytes() for s, e in zip(cut, stop, strict=True)]})

        for b in batches:
            for node, data in zip(b["node"].to_numpy(), b["prefix"], strict=True):
                if node not in held:
                    held[node] = np.frombuffer(data, dtype=_U)
                    size += len(held[node])
            if size > 750_000:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        release()
        tokens = np.frombuffer(b"".join(b["tokens"]), dtype=_U)
        nodes = np.frombuffer(b"".join(b["nodes"]), dtype=np.int64)
        at = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[at], nodes[at]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])])
        tokens, nodes = tokens[new], nodes[new]
        if b["bucket"].iloc[0] < 0:  # a frequent shingle is its own group, of which this is a part
            return pd.DataFrame({"group": mix(tokens).view(np.int64), "node": nodes})
        start, stop = _runs(tokens)
        count = stop - start
        start, count = start[count > 1], count[count > 1]
        if not len(start):
            return pd.DataFrame({"group": [], "node": []}, dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(mix(nodes.view(_U)), dtype=_U)]).astype(_U)
        group = mix(sums[start + count] - sums[start] + count.astype(_U)).view(np.int64)
        group, first = np.unique(group, return_index=True)
        start, count = start[first], count[first]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return pd.DataFrame({"group": np.repeat(group, count), "node": nodes[np.repeat(start, count) + inner]})

    posted = signed.where("n > 0").select("node", "prefix").mapInPandas(releasing(post), "bucket long, tokens binary, nodes binary")
    return posted.groupBy("bucket").applyInPandas(meet, "group long, node long")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return start, np.append(start[1:], len(x))


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bit i of the wide map counts as bit i modulo the narrow width."""
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether 100 * overlap >= 80 * (a + b - overlap)."""
    return 9 * overlap >= 4 * (a + b)


def _missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a and of b, how many bits of a's row are not in b's; in slices of bounded memory."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.bitwise_count(a[i : i + step, None, :] & ~b[None, :, :]).sum(2, dtype=np.int64)
    return out


def may_link(comps: np.ndarray, n: np.ndarray, bits: list[bytes], part: np.ndarray | None = None, before: np.ndarray | None = None, group: int = 32) -> np.ndarray:
    """For each node whether the bounds by bitmaps leave a partner of another component; groups are opened only where their union's does.

    part: where a block holds two parts, only nodes of different ones are partners. before: rows of numbers of earlier blocks;
    nodes that have one in common have met there.
    """
    out = np.zeros(len(n), dtype=bool)
    order = np.argsort(n, kind="stable")
    part = np.zeros(len(n), dtype=np.int64) if part is None else part
    before = np.zeros((len(n), 0), dtype=np.int64) if before is None else before
    apart = bool((part != part[0]).any())
    lo = 0
    # nodes of like size together: bitmaps fold to the narrowest of a run, and sizes beyond 5/4 cannot link
    for hi in np.append(np.flatnonzero(4 * n[order[1:]] > 5 * n[order[:-1]]) + 1, len(order)).tolist():
        at, lo = order[lo:hi], hi
        if len(at) > 1 and (comps[at] != comps[at[0]]).any():
            at = at[np.argsort(comps[at], kind="stable")]
            i, j = _may_link(comps[at], n[at], [bits[x] for x in at], group)
            i, j = at[i], at[j]
            if apart:
                ok = part[i] != part[j]
                i, j = i[ok], j[ok]
            met = np.zeros(len(i), dtype=bool)
            for x in range(0, len(i) if before.shape[1] else 0, 1 << 16):
                a, b = before[i[x : x + (1 << 16)]], before[j[x : x + (1 << 16)]]
                met[x : x + (1 << 16)] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] != LATER)).any((1, 2))
            out[i[~met]] = out[j[~met]] = True
    return out


def _may_link(comp: np.ndarray, n: np.ndarray, bits: list[bytes], group: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that the bounds leave; nodes come sorted by component. A block has few enough for its pairs."""
    width = min(map(len, bits))
    maps = np.stack([fold(np.frombuffer(b, dtype=np.uint8), width) for b in bits]).view(_U)
    start = np.concatenate([np.arange(s, e, group) for s, e in zip(*_runs(comp), strict=True)]) if len(np.unique(comp)) * 4 < len(comp) else np.arange(0, len(comp), group)
    stop = np.append(start[1:], len(comp))
    union = np.bitwise_or.reduceat(maps, start, axis=0)
    smallest, largest = np.minimum.reduceat(n, start), np.maximum.reduceat(n, start)
    one = comp[start] == comp[stop - 1]
    may = (5 * (n[:, None] - _missing(maps, union)) >= 4 * n[:, None]) & (5 * largest >= 4 * n[:, None]) & (4 * smallest <= 5 * n[:, None])
    may &= ~(one & (comp[start] == comp[:, None])) & (start < np.arange(len(n))[:, None])
    first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for g in np.flatnonzero(may.any(0)):
        rows, theirs = np.flatnonzero(may[:, g]), slice(start[g], stop[g])
        bound = np.minimum(n[rows, None] - _missing(maps[rows], maps[theirs]), n[theirs] - _missing(maps[theirs], maps[rows]).T)
        i, j = np.nonzero(enough(bound, n[rows, None], n[theirs]) & (comp[rows, None] != comp[theirs]))
        first.append(rows[i])
        second.append(j + start[g])
    return np.concatenate(first), np.concatenate(second)


def united(comps: np.ndarray, sets: list[np.ndarray], group: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links (component, smaller component) that unite the components of a block's nodes as their full sets do.

    Nodes are taken in turn. The tokens that a node shares with the union of a group of earlier ones bound the overlap with
    each; groups that qualify are opened, and members in other components are compared exactly.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets])
    least = np.array([x[0] for x in sets], dtype=_U)
    order = np.argsort(least) if len(np.unique(comps)) == m else np.lexsort((least, comps))
    comps, size, sets = comps[order], size[order], [sets[i] for i in order]
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    edge = np.append(0, np.cumsum(size))
    mine = [token[s:e] for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    names, root = np.unique(comps, return_inverse=True)
    start = np.arange(0, m, group)
    unions = [np.unique(token[edge[s] : edge[min(s + group, m)]]) for s in start]
    union_edge = np.append(0, np.cumsum([len(u) for u in unions]))
    union = np.concatenate(unions)
    smallest, largest = np.minimum.reduceat(size, start), np.maximum.reduceat(size, start)
    there = np.zeros(int(token.max()) + 1, dtype=bool)
    for i in range(1, m):
        g = i // group + 1  # groups with earlier nodes
        open_ = (5 * largest[:g] >= 4 * size[i]) & (4 * smallest[:g] <= 5 * size[i])
        open_ &= np.logical_or.reduceat(root[: min(g * group, m)] != root[i], start[:g])
        if not open_.any():
            continue
        there[mine[i]] = True
        overlap = np.add.reduceat(there[union[: union_edge[g]]], union_edge[:g], dtype=np.int64)
        open_ &= enough(overlap, size[i], smallest[:g])
        near = np.concatenate([np.arange(s, min(s + group, i)) for s in start[:g][open_]]) if open_.any() else np.zeros(0, dtype=np.int64)
        near = near[(root[near] != root[i]) & (5 * size[near] >= 4 * size[i]) & (4 * size[near] <= 5 * size[i])]
        if len(near):
            shared = np.add.reduceat(there[np.concatenate([mine[j] for j in near])], np.append(0, np.cumsum(size[near])[:-1]), dtype=np.int64)
            for r in np.unique(root[near[enough(shared, size[i], size[near])]]):
                lo, hi = min(r, root[i]), max(r, root[i])
                root[root == hi] = lo
        there[mine[i]] = False
    # a component's number is the place of its name, so the least number in a root is the least name
    _, first = np.unique(np.unique(comps, return_inverse=True)[1], return_index=True)
    least = names[root[first]]
    moved = least != names
    return names[moved], least[moved]


def _by_key(batches: Iterator[pd.DataFrame], columns: list[str], act: Callable[..., pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """Calls act with the columns of each key's rows. Rows come sorted by key; one that goes on in the next batch waits for it."""
    held: list[pd.DataFrame] = []
    for b in itertools.chain(batches, [None]):
        if b is not None and not len(b):
            continue
        if held and (b is None or b["key"].iloc[0] != held[-1]["key"].iloc[-1] or b["key"].iloc[-1] != b["key"].iloc[0]):
            whole = pd.concat([*held, b]) if b is not None else pd.concat(held)
            held = []
        elif b is None:
            return
        else:
            held.append(b)
            continue
        start, stop = _runs(whole["key"].to_numpy())
        if b is not None:
            held = [whole.iloc[start[-1] :]]
            start, stop = start[:-1], stop[:-1]
        key = whole["key"].to_numpy()
        found = [act(key[s], *(whole[c].to_numpy()[s:e] for c in columns)) for s, e in zip(start.tolist(), stop.tolist(), strict=True) if e - s > 1]
        found = [x for x in found if x is not None and len(x)]
        if found:
            yield pd.concat(found)


def linked(blocks: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """blocks (key, name, part, names, node, comp): links (a, b) that unite the components of the nodes that meet in a block."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bound(key: int, name: np.ndarray, part: np.ndarray, names: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
        before = np.full((len(node), NAMES), LATER)
        for i, x in enumerate(names):
            x = np.asarray(x, dtype=np.int64)
            x = x[x < name[0]]
            before[i, : len(x)] = x
        ok = may_link(comp, n, list(bits), part, before)
        return pd.DataFrame({"key": key, "node": node[ok], "comp": comp[ok]})

    def unite(key: int, comp: np.ndarray, hashes: np.ndarray) -> pd.DataFrame:
        a, b = united(comp, [np.frombuffer(x, dtype=_U) for x in hashes])
        return pd.DataFrame({"a": a, "b": b})

    columns = ["name", "part", "names", "node", "comp", "n", "bits"]
    mapped = blocks.join(nodes.select("node", "n", "bits").hint("merge"), "node").select("key", *columns).repartition(parts, "key").sortWithinPartitions("key")
    left = written(mapped.mapInPandas(releasing(lambda x: _by_key(x, columns, bound)), "key long, node long, comp long"), "qualified", small=True)
    sets = left.join(full_sets(left, nodes, rows).hint("merge"), "node").select("key", "comp", "hashes").repartition(parts, "key").sortWithinPartitions("key")
    return written(sets.mapInPandas(releasing(lambda x: _by_key(x, ["comp", "hashes"], unite)), "a long, b long").distinct(), "links", small=True)


def full_sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted nodes, as a written table. One text for each is read again, found by its id and its hash."""
    at = written(nodes.select("node", "digest", "rep.id", "rep.th").join(wanted.select("node").distinct().hint("merge"), "node"), "wanted", small=True)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            ok = [digest_of(h) == name for h, name in zip(sets, b["digest"], strict=True)]
            yield pd.DataFrame({"node": b["node"][ok], "hashes": [h.tobytes() for h, good in zip(sets, ok, strict=True) if good]})

    maybe = marked_ids(rows, at.select("id"), "id").where("maybe").select("id", "th", "text")
    met = maybe.join(at.hint("shuffle_hash"), ["id", "th"]).groupBy("node", "digest").agg(F.first("text").alias("text"))
    return written(met.select("node", "digest", "text").mapInPandas(read, "node long, hashes binary"), "sets")


def dealt(members: DataFrame, facts: DataFrame, part: int, tokens: int, meet: bool) -> DataFrame:
    """Blocks (key, name, part, names, node, comp) of members (group, node, comp), of which facts (group, name, m, size, lo) tells what they hold.

    A block has about `part` nodes and `tokens` shingles at most, twice that where two parts meet. meet: the parts of a
    group meet pairwise; else they stand alone, each with the group's node `lo` as well. names: the least names of the
    node's groups, in which it meets all others.
    """
    total = facts.agg(F.sum("m")).first()[0] or 0
    facts = facts.withColumn("parts", F.greatest(F.ceil(F.col("m") / part), F.ceil(F.col("size") / tokens)).cast("long"))
    heavy = facts.where(F.col("m") >= heavy_from(total)).select("group")
    rows = lookup_join(members, facts.select("group", "name", "parts"), "group", heavy).where("parts IS NOT NULL")
    rows = written(rows.select("name", "node", "comp", "parts", F.pmod(F.xxhash64("node", "name"), "parts").alias("part")).distinct(), "dealt", small=True)
    whole = rows if meet else rows.where("parts = 1")
    names = whole.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("name")), 1, NAMES).alias("names"))
    if meet:
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("p"), F.greatest("part", o).alias("q")))
        rows = rows.withColumn("pq", F.explode(others)).withColumn("key", F.xxhash64("name", "pq.p", "pq.q"))
    else:
        first = facts.where("parts > 1").select("name", F.col("lo").alias("node"), F.col("lo").alias("comp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        rows = rows.select("name", "node", "comp", "part").unionByName(first).distinct().withColumn("key", F.xxhash64("name", "part"))
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    return rows.select("key", "name", "part", "node", "comp").join(names.hint("merge"), "node", "left").withColumn("names", F.coalesce("names", F.array().cast("array<long>")))


def first_links(nodes: DataFrame, rows: DataFrame, part: int, tokens: int) -> DataFrame:
    """Links among the nodes that have a minimum hash in common."""
    keys = F.array(*(F.xxhash64(F.lit(k), f"key{k}") for k in range(len(SEEDS))))
    members = nodes.select("node", F.col("node").alias("comp"), "n", F.explode(keys).alias("group"))
    facts = members.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.min("node").alias("lo")).where("m > 1")
    facts = written(facts.withColumn("name", F.col("group")), "facts", small=True)
    return linked(dealt(members.drop("n"), facts, part, tokens, False), nodes, rows)


def last_links(groups: DataFrame, comps: DataFrame, nodes: DataFrame, rows: DataFrame, part: int, tokens: int) -> DataFrame:
    """Links between components, among the nodes that share a prefix shingle.

    Sizes within 5/4 of each other fall in one band or in neighbouring ones. In a group with the next band a node stands
    there; in its own band it stands where there is no next one, or a band before whose nodes come up to it. So any two such
    nodes meet, in one place if there are no more than two bands. Groups of the same nodes are one.
    """
    known = nodes.select("node", "n").join(comps.hint("merge"), "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp"))
    placed = written(groups.join(known.hint("merge"), "node"), "placed")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("long")
    open_ = placed.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.collect_set(band).alias("bands")).where("lo < hi")
    open_ = written(open_, "open", small=True)
    heavy = open_.where(F.col("m") >= heavy_from(open_.agg(F.sum("m")).first()[0] or 0)).select("group")
    members = lookup_join(placed, open_.select("group", "bands"), "group", heavy).where("bands IS NOT NULL").distinct()
    after, before = F.array_contains("bands", band + 1), F.array_contains("bands", band - 1)
    stands = F.array_compact(F.array(F.when(after, F.xxhash64("group", band + 1)), F.when(~after | before, F.xxhash64("group", band))))
    members = written(members.select(F.explode(stands).alias("group"), "node", "n", "comp"), "members")
    facts = members.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("sign")).where("lo < hi")
    facts = written(facts.withColumn("name", F.xxhash64("sign", "m", "size", "lo", "hi")), "facts", small=True)
    return linked(dealt(members.drop("n"), facts, part, tokens, True), nodes, rows)


def join(documents: DataFrame, key: str = "doc_id", text: str = "text", order_sample: int = 20_000, part: int = 256, tokens: int = 1 << 20, named: bool = False, node_bits: int = 64) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest id reachable by links.

    named: also digest, the name of the row's set (null for empty sets), and first, whether id and digest are the least of
    the component. node_bits: bits of the numbers that stand for sets.
    """
    sheltered(documents, key, text)
    spark = documents.sparkSession
    rows = _ids(documents, key, text)
    order, often = shingle_order(rows, rows.count(), order_sample)
    signed, nodes = distinct_sets(signatures(rows, order, node_bits))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, int((nodes.agg(F.sum("n")).first()[0] or 0) // 5 // 1_000_000) + 1)

    comps = written(components(first_links(nodes, rows, part, tokens)), "components", small=True)
    late = components(last_links(shared_prefixes(signed, order, often, buckets), comps, nodes, rows, part, tokens)).select(F.col("node").alias("component"), F.col("component").alias("_whole"))
    placed = nodes.select("node", "digest", "rep.id").join(comps, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    placed = placed.join(late, "component", "left").select("digest", "id", F.coalesce("_whole", "component").alias("component")) if not late.isEmpty() else placed
    placed = written(placed, "placed", small=True)
    least = placed.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("least")).select("component", F.col("least.id").alias("component_id"), F.col("least.digest").alias("least"))
    found = lookup_join(placed.select("digest", "component"), least, "component", heavy_keys(placed.select("component"), "component"))
    found = found.select(F.hex("digest").alias("name"), "component_id", (F.col("digest") == F.col("least")).alias("least"))
    # a set that many documents share must not gather them: its documents meet it by broadcast
    ids = signed.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.hex("digest")).alias("name"))
    out = lookup_join(ids, found, "name", heavy_keys(ids.where("n_shingles > 0").select("name"), "name"))
    extra = [F.unhex("name").alias("digest"), F.coalesce(F.col("least") & (F.col("id") == F.col("component_id")), F.lit(True)).alias("first")] if named else []
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), *extra)


def pairs_of(part: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a block whose full sets link; where the block holds two parts, one of each."""
    size = np.array([len(x) for x in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    edge = np.append(0, np.cumsum(size))
    apart = bool((part != part[0]).any())
    there = np.zeros(int(token.max()) + 1, dtype=bool)
    first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(len(sets) - 1):
        there[token[edge[i] : edge[i + 1]]] = True
        shared = np.add.reduceat(there[token[edge[i + 1] :]], edge[i + 1 : -1] - edge[i + 1], dtype=np.int64)
        there[token[edge[i] : edge[i + 1]]] = False
        ok = enough(shared, size[i], size[i + 1 :])
        if apart:
            ok &= part[i + 1 :] != part[i]
        (j,) = np.nonzero(ok)
        first.append(np.full(len(j), i))
        second.append(j + i + 1)
    return np.concatenate(first), np.concatenate(second)


def links(documents: DataFrame, key: str = "doc_id", text: str = "text", order_sample: int = 20_000, part: int = 256, tokens: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """All links, between classes of documents with equal sets: (a, b) and (key, class, n_copies, n_links).

    A class is named by its smallest id; a < b are classes whose sets link. A document's n_links counts all other documents that
    link with it, those of its own class included. Links lie within components, so the nodes of each component meet in blocks,
    part by part: the work follows the pairs within components, which near copies fill with links. Documents without words or id
    have no class and no links.
    """
    sheltered(documents, key, text)
    joined = written(join(documents, key, text, order_sample, part, tokens, named=True).where("n_shingles > 0").select(F.col(key).alias("id"), "component_id", "digest"), "joined")
    rows = _ids(documents, key, text)
    order, _ = shingle_order(rows, rows.count(), order_sample)
    _, nodes = distinct_sets(signatures(rows, order, 64))
    classes = joined.groupBy("digest", "component_id").agg(F.min("id").alias("class"), F.count("*").alias("n_copies"))
    classes = written(nodes.select("node", "digest", "n").join(classes, "digest"), "classes")
    facts = classes.groupBy(F.col("component_id").alias("group")).agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.min("node").alias("lo")).where("m > 1")
    facts = written(facts.withColumn("name", F.xxhash64("group")), "facts", small=True)
    blocks = dealt(classes.select(F.col("component_id").alias("group"), "node", F.col("node").alias("comp")), facts, part, tokens, True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bound(key: int, part: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
        ok = may_link(node, n, list(bits), part)
        return pd.DataFrame({"key": key, "part": part[ok], "node": node[ok]})

    def pairs(key: int, part: np.ndarray, node: np.ndarray, hashes: np.ndarray) -> pd.DataFrame:
        i, j = pairs_of(part, [np.frombuffer(x, dtype=_U) for x in hashes])
        return pd.DataFrame({"x": node[i], "y": node[j]})

    columns = ["part", "node", "n", "bits"]
    mapped = blocks.select("key", "part", "node").join(nodes.select("node", "n", "bits").hint("merge"), "node").select("key", *columns).repartition(parts, "key").sortWithinPartitions("key")
    left = written(mapped.mapInPandas(releasing(lambda x: _by_key(x, columns, bound)), "key long, part long, node long"), "qualified", small=True)
    sets = left.join(full_sets(left, nodes, rows).hint("merge"), "node").select("key", "part", "node", "hashes").repartition(parts, "key").sortWithinPartitions("key")
    found = sets.mapInPandas(releasing(lambda x: _by_key(x, ["part", "node", "hashes"], pairs)), "x long, y long")
    of = lambda end, name: classes.select(F.col("node").alias(end), F.col("class").alias(name), F.col("n_copies").alias(f"n_{name}"))
    both = written(found.join(of("x", "p"), "x").join(of("y", "q"), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("n_p")).otherwise(F.col("n_q")).alias("n_a"), F.when(F.col("p") < F.col("q"), F.col("n_q")).otherwise(F.col("n_p")).alias("n_b")), "links")
    sides = both.select(F.col("a").alias("class"), F.col("n_b").alias("n")).unionByName(both.select(F.col("b").alias("class"), F.col("n_a").alias("n")))
    counts = classes.select(F.hex("digest").alias("name"), "class", "n_copies").join(sides.groupBy("class").agg(F.sum("n").alias("n")), "class", "left")
    counts = counts.select("name", "class", "n_copies", (F.col("n_copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    named = joined.select("id", F.hex("digest").alias("name"))
    return both.select("a", "b"), lookup_join(named, counts, "name", heavy_keys(named, "name")).select(F.col("id").alias(key), "class", "n_copies", "n_links")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_jaccard": op8_jaccard}
ORACLES: dict[str, str] = {}
