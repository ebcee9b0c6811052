"""External induced sorting: a suffix order with common-prefix values from disk-backed bucket queues.

The text is an array of symbols in which 0 ends a piece. Left-most S suffixes are ordered first, by names that double in
length until they differ or exceed `depth`. Then all L suffixes are induced from them in one ascending sweep, and all S
suffixes from the L suffixes in a descending one. Each bucket is a queue, which is a priority queue here because tuples
arrive in the order of their suffixes. A tuple is a suffix's position and its common prefix with the suffix before it in
the bucket; that value is carried along by minima over the sweep since the bucket's last arrival. A sweep works through
blocks of tuples, not single ones. Queues keep their newest blocks in memory and write older ones to the scratch folder
once all queues together exceed `memory` bytes; the text and its types may be memory-mapped files.

Common prefixes are exact up to `depth` and not less than it beyond; suffixes equal to that depth come in any order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np


#: Tuples that a sweep takes at once.
STEP = 1 << 19


class Scratch:
    """Memory shared by queues, and files for what exceeds it. folder: a pyarrow file system and a path, or None."""

    def __init__(self, folder: tuple | None = None, memory: int = 256 << 20) -> None:
        self.folder, self.memory, self.held, self.made = folder, memory, 0, 0
        self.queues: list[Queue] = []

    def write(self, data: bytes) -> str:
        fs, base = self.folder
        fs.create_dir(base, recursive=True)
        path = f"{base}/{self.made}"
        self.made += 1
        with fs.open_output_stream(path) as out:
            out.write(data)
        return path

    def read(self, path: str) -> bytes:
        with self.folder[0].open_input_stream(path) as f:
            data = f.read()
        self.folder[0].delete_file(path)
        return data

    def close(self) -> None:
        if self.made:
            self.folder[0].delete_dir(self.folder[1])


class Queue:
    """Blocks of (positions, common prefixes), first in first out."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.blocks = scratch, deque()
        scratch.queues.append(self)

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.append((pos, lcp))
        self.scratch.held += pos.nbytes + lcp.nbytes
        if self.scratch.held > self.scratch.memory and self.scratch.folder:
            for q in self.scratch.queues:
                q.spill()

    def spill(self) -> None:
        """Writes all blocks in memory as one file."""
        kept, self.blocks = self.blocks, deque()
        run: list[tuple] = []

        def flush() -> None:
            if run:
                pos, lcp = (np.concatenate(x) for x in zip(*run, strict=True))
                self.blocks.append((self.scratch.write(pos.tobytes() + lcp.tobytes()), len(pos)))
                self.scratch.held -= pos.nbytes + lcp.nbytes
                run.clear()

        for b in kept:
            if isinstance(b[0], str):
                flush()
                self.blocks.append(b)
            else:
                run.append(b)
        flush()

    def _load(self, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(b[0], str):
            data = self.scratch.read(b[0])
            return np.frombuffer(data, np.int64, b[1]), np.frombuffer(data, np.uint8, b[1], 8 * b[1])
        self.scratch.held -= b[0].nbytes + b[1].nbytes
        return b

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the front, joined up to STEP tuples, until there are none; more may be pushed meanwhile."""
        while self.blocks:
            some, size = [], 0
            while self.blocks and (not some or size < STEP):
                some.append(self._load(self.blocks.popleft()))
                size += len(some[-1][0])
            yield some[0] if len(some) == 1 else tuple(np.concatenate(x) for x in zip(*some, strict=True))

    def pop_back(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while self.blocks:
            yield self._load(self.blocks.pop())


def types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the next one. The last suffix is one."""
    n = len(t)
    change = np.flatnonzero(np.append(t[:-1] != t[1:], True))
    rises = np.append(t[change[:-1]] < t[change[:-1] + 1], True)
    return np.repeat(rises, np.diff(change, prepend=-1))[:n]


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to depth."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    for d in range(depth):
        x, y = a[live] + d, b[live] + d
        inside = np.maximum(x, y) < len(t)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[t[x] == t[y]]
        if not len(live):
            break
        out[live] = d + 1
    return out.astype(np.uint8)


def _refined(order: np.ndarray, name: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Orders the places `tied` of each name by key, gives the parts names of their own, and returns the places still tied."""
    by = np.lexsort((key, name[tied]))
    order[tied], key, group = order[tied][by], key[by], name[tied][by]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    name[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
    return tied[~(new & np.append(new[1:], True))]


def order_seeds(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, depth: int) -> np.ndarray:
    """The seeds in the order of their suffixes.

    The string from a seed to the next one gets a name by its symbols and types. Seeds whose names are shared are told
    apart by the name one further, then two, then four: named strings double in length until they differ or reach `depth`.
    """
    m = len(seeds)
    stop = np.append(seeds[1:], len(t) - 1) - seeds + 1
    code = (t.astype(np.uint16) << np.uint16(1)) + is_s + np.uint16(1)
    order, name, tied = np.arange(m), np.zeros(m, dtype=np.int64), np.arange(m)
    at = 0
    while len(tied) and at < depth:
        own = order[tied]
        key = np.zeros(len(tied), dtype=np.uint64)
        for j in range(6):
            symbol = code[np.minimum(seeds[own] + (at + j), len(t) - 1)]
            key = (key << np.uint64(10)) | np.where(at + j < stop[own], symbol, 0).astype(np.uint64)
        at += 6
        tied = _refined(order, name, tied, key)
        tied = tied[stop[order[tied]] > at]  # equal strings that have ended have one name
    step = 1
    rank = np.empty(m, dtype=np.int64)
    rank[order] = name
    first = np.append(True, name[1:] != name[:-1])
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied) and 2 * step < depth:  # a seed and the next are two symbols apart at least
        later = order[tied] + step
        tied = _refined(order, name, tied, np.where(later < m, rank[np.minimum(later, m - 1)], -1))
        rank[order] = name
        step *= 2
    return seeds[order]


class _Minima:
    """Minima of ranges of one block, by a table of powers of two."""

    def __init__(self, x: np.ndarray) -> None:
        self.table = [x]
        step = 1
        while 2 * step <= len(x):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over lo..hi, both inside; lo <= hi."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.uint8)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table[k][lo[m]], self.table[k][hi[m] + 1 - (1 << int(k))])
        return out


class _Sweep:
    """One direction of induction: takes emitted suffixes in order and queues their predecessors of the wanted type."""

    def __init__(self, t: np.ndarray, is_s: np.ndarray, wanted: bool, queues: list[Queue], depth: int) -> None:
        self.t, self.is_s, self.wanted, self.queues, self.depth = t, is_s, wanted, queues, depth
        self.pending = np.zeros(len(queues), dtype=np.int64) - 1  # least common prefix since the last arrival; -1: none yet

    def emit(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for i in range(0, len(pos), STEP):
            self._emit(pos[i : i + STEP], lcp[i : i + STEP])

    def _emit(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        at = np.flatnonzero(pos > 0)
        before = pos[at] - 1
        ok = self.is_s[before] == self.wanted
        at, before = at[ok], before[ok]
        symbol = self.t[before]
        whole = int(lcp.min())
        first_seen = self.pending.copy()
        np.minimum(self.pending, whole, out=self.pending)
        if not len(at):
            return
        by = np.argsort(symbol, kind="stable")
        at, before, symbol = at[by], before[by], symbol[by]
        start = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        stop = np.append(start[1:], len(symbol))
        minima = _Minima(lcp)
        lo = np.empty(len(at), dtype=np.int64)
        lo[1:] = at[:-1] + 1
        lo[start] = 0
        value = minima.of(lo, at).astype(np.int64)
        own = symbol[start].astype(np.int64)
        value[start] = np.minimum(value[start], first_seen[own])
        value = np.minimum(value + 1, self.depth).astype(np.uint8)
        last = at[stop - 1] + 1
        rest = np.full(len(own), self.depth, dtype=np.int64)
        inside = last < len(lcp)
        if inside.any():
            rest[inside] = minima.of(last[inside], np.full(int(inside.sum()), len(lcp) - 1))
        self.pending[own] = rest
        for c, a, b in zip(own.tolist(), start.tolist(), stop.tolist(), strict=True):
            self.queues[c].push(before[a:b], value[a:b])


def suffixes(t: np.ndarray, depth: int, scratch: Scratch | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the suffix given before) in descending order of suffixes. t ends with one 0."""
    if not len(t):
        return
    scratch = scratch or Scratch()
    n, symbols = len(t), int(t.max()) + 1
    is_s = types(t)
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    seeds = order_seeds(t, is_s, seeds.astype(np.int64), depth)
    seed_lcp = np.zeros(len(seeds), dtype=np.uint8)
    if len(seeds) > 1:
        seed_lcp[1:] = common(t, seeds[:-1], seeds[1:], depth)
    cut = np.searchsorted(t[seeds], np.arange(symbols + 1)) if len(seeds) else np.zeros(symbols + 1, dtype=np.int64)

    large, kept = [Queue(scratch) for _ in range(symbols)], [Queue(scratch) for _ in range(symbols)]
    sweep = _Sweep(t, is_s, False, large, depth)
    for c in range(symbols):
        last = None
        for pos, lcp in large[c].pop():
            kept[c].push(pos, lcp)
            sweep.emit(pos, lcp)
            last = pos[-1:]
        pos, lcp = seeds[cut[c] : cut[c + 1]], seed_lcp[cut[c] : cut[c + 1]].copy()
        if len(pos):
            lcp[0] = common(t, last, pos[:1], depth)[0] if last is not None else 0
            sweep.emit(pos, lcp)

    small = [Queue(scratch) for _ in range(symbols)]
    sweep = _Sweep(t, is_s, True, small, depth)
    for c in range(symbols - 1, -1, -1):
        last = None
        for pos, lcp in small[c].pop():
            sweep.emit(pos, lcp)
            yield pos, lcp
            last = pos[-1:]
        carried = None  # common prefix of the block's last suffix with the one given before it
        for pos, lcp in kept[c].pop_back():
            down = pos[::-1]
            if carried is None:
                first = common(t, last, down[:1], depth)[0] if last is not None else 0
            else:
                first = carried
            value = np.append(np.uint8(first), lcp[:0:-1]).astype(np.uint8)
            carried = lcp[0]
            sweep.emit(down, value)
            yield down, value
            last = down[-1:]
        if c == 0:
            end = np.array([n - 1], dtype=np.int64)
            yield end, common(t, last, end, depth) if last is not None else np.zeros(1, dtype=np.uint8)
    scratch.close()
