"""Operator 4: packing token sequences into windows by non-negative least squares on the length histogram.

Each document's tokens are cut at multiples of the window; whole windows stand alone, and the rest of each document, if
any, is one piece. All combinations of two lengths, and combinations of three with one on a grid, that fill a window
are the columns of a least-squares problem against the histogram of piece lengths; it is solved for non-negative repeat
counts by coordinate descent, rounded down to what the histogram holds, and what remains is packed greedily, largest
first. The histogram has one bin per length and is the only thing that reaches the driver; pieces find their place by
their rank among the pieces of their length, from counts per task, so no piece of text or token moves.

Null and empty texts have the end token alone. Repeated rows are packed once each; very long texts are tokenised whole;
extra columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import releasing, sheltered, written

#: Texts with a character outside this set go to the tokenizer as a whole.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u017f\u2013-\u2026\u20ac]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Where a byte-level tokenizer cuts texts of plain characters: no id spans a cut. A run of white space before something else
#: is parted before its last character first; then each piece gets a zero byte, which plain texts do not hold, in front.
SPACES = (r"(\s+)(\s\S)", "\\1\x00\\2")
CUTS = (rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\x00{_LETTER}{_NUMBER}]+| ?[{_NUMBER}]+|\s+", "\x00\\0")

class Encoder:
    """Ids of a tokenizer file as little-endian unsigned 32-bit bytes.

    All ids are the tokenizer's. Where it cuts texts before it looks up ids, as byte-level ones do, plain texts are cut here
    in the same places, and the tokenizer is asked once for each different piece; `most` pieces are remembered at a time.
    """

    def __init__(self, path: str, most: int = 1 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cutter = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)  # a character of a byte-level token is a byte
        self.sizes[list(vocabulary.values())] = [len(k) for k in vocabulary]
        # new words gain nothing from the tokenizer's own memory of words
        self.fresh = Tokenizer.from_file(path) if self.cuts else self.tokenizer
        if self.cuts and hasattr(self.fresh.model, "_resize_cache"):
            self.fresh.model._resize_cache(0)
        self.most = most
        self.known: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_some([text])[0]

    def _joined(self, words: list[str], joint: str) -> dict[str, bytes]:
        """The ids of each word from those of one text, told apart by bytes; nothing where the tokenizer cuts that otherwise."""
        (found,) = self.fresh.encode_batch_fast([joint.join(words)], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        reach = np.append(0, np.cumsum(self.sizes[ids]))
        sizes = np.array([len(w.encode()) for w in words])
        stop = np.cumsum(sizes + len(joint)) - len(joint)
        a, b = np.searchsorted(reach, stop - sizes), np.searchsorted(reach, stop)
        if reach[-1] != stop[-1] or (reach[a] != stop - sizes).any() or (reach[b] != stop).any():
            return {}
        data = ids.tobytes()
        return {w: data[x:y] for w, x, y in zip(words, (4 * a).tolist(), (4 * b).tolist(), strict=True)}

    def encode_some(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pieces are cut and counted together, and those not known yet go to the tokenizer together."""
        plain = [i for i, t in enumerate(texts) if self.cuts and not PLAIN.search(t) and not any(s in t for s in self.special)]
        marked = pa.array([texts[i] for i in plain], pa.large_string())
        for pattern, mark in (SPACES, CUTS):
            marked = pc.replace_substring_regex(marked, pattern, mark)
        pieces = pc.split_pattern(marked, "\x00")
        number = pieces.flatten().dictionary_encode()
        offsets = pieces.offsets.to_numpy()
        del marked, pieces
        words = number.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.known], words)
        found = [self.known[w] for w in words]
        ids, size = np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64)
        at = number.indices.to_numpy()
        n = size[at]
        reach = np.append(0, np.cumsum(n))
        first = (np.cumsum(size) - size)[at] - reach[:-1]
        place = np.repeat(first.astype(np.int32), n)  # fits: ids at hand are fewer than characters
        place += np.arange(reach[-1], dtype=np.int32)
        data = ids[place].tobytes()
        edge = (4 * reach[offsets]).tolist()
        made = {i: data[a:b] for i, a, b in zip(plain, edge[:-1], edge[1:], strict=True)}
        return [made[i] if i in made else self.whole(t) for i, t in enumerate(texts)]

    def _learn(self, new: list[str], there: list[str]) -> None:
        """Asks the tokenizer for the ids of new pieces; there are all pieces of the texts at hand, which stay known."""
        known = self.known
        if len(known) + len(new) > self.most:  # the words of these texts stay, and with them the frequent ones
            self.known = known = {p: known[p] for p in ["", *there] if p in known}
        # pieces are asked for in one text, in which it cuts between them: those with a space before follow each other,
        # those without stand between tabulators; white space alone is asked for by itself
        spaced, bare = [p for p in new if p[0] == " " and p[1:2].strip()], [p for p in new if p[0] not in " \n\t\r"]
        for words, joint in ((spaced, ""), (bare, "\t")):
            for i in range(0, len(words), 10_000):
                known.update(self._joined(words[i : i + 10_000], joint))
        rest = [p for p in new if p not in known]
        for piece, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[piece] = array.array("I", found.ids).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most: int = 1 << 20) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = most
    return _encoders[path]


PIECES = "key string, start long, length long, ids_crc32 long, doc_tokens long, block long, local_rank long"


def pieces(documents: DataFrame, tokenizer: str, key: str, text: str, window: int, end_id: int, known: int, at_once: int) -> DataFrame:
    """A written table of pieces: each with the number of its partition and its rank there among pieces of its length.

    The number is the partition's own, not its task's: a task may run through several partitions.
    """
    named = documents.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("block"))
    end = array.array("I", [end_id]).tobytes()
    step = 4 * window

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def encoded(keys: list, texts: list[str]) -> Iterator[tuple]:
            """Keys and ids, of about `at_once` characters at a time."""
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= at_once or i + 1 == len(texts):
                    yield from zip(keys[first : i + 1], encode_some(texts[first : i + 1]), strict=True)
                    first, size = i + 1, 0

        encode_some = encoder(tokenizer, known).encode_some
        seen: dict[int, int] = {}
        for batch in batches:
            out = []
            block = batch["block"].iloc[0] if len(batch) else 0
            for k, found in encoded(batch["key"].tolist(), batch["text"].tolist()):
                ids = found + end
                n = len(ids) // 4
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    length = len(part) // 4
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    out.append((k, i // 4, length, zlib.crc32(part), n, block, rank))
            yield pd.DataFrame(out, columns=["key", "start", "length", "ids_crc32", "doc_tokens", "block", "local_rank"])

    return written(named.mapInPandas(releasing(cut), PIECES), "pieces")


def combinations(window: int, present: np.ndarray, grid: int = 32) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill the window, of lengths that occur; triples have one on the grid."""
    low = np.arange(1, window // 2 + 1)
    found = [np.stack([low, window - low, np.zeros_like(low)], 1)]
    for a in range(grid, window - 1, grid):
        b = np.arange(1, (window - a) // 2 + 1)
        found.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    rows = np.unique(np.sort(np.concatenate(found), 1), axis=0)
    there = np.concatenate([[True], present])
    return rows[there[rows].all(1)]


def repeat_counts(rows: np.ndarray, histogram: np.ndarray, ease: float = 1e-6) -> np.ndarray:
    """Non-negative least squares of the combinations' lengths against the histogram, by greedy coordinate descent.

    It stops when no single change of a count by one half or more improves the fit: smaller ones vanish in rounding. Each
    step lessens the squared error by a quarter or more, so it does stop. Of a large total, changes below its share `ease`
    are left to the next solution, see `plan`, which looks at the rest alone.
    """
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    left = np.concatenate([[0.0], histogram.astype(float)])
    total = float(left.sum())
    used = (rows > 0).astype(float)
    norm = np.array([sum(np.bincount(r[r > 0]) ** 2) for r in rows], dtype=float)
    # the rows that hold each length: a step changes the gains of those alone
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    holder, cut = order // rows.shape[1], np.searchsorted(flat[order], np.arange(len(left) + 1))
    step = np.maximum((left[rows] * used).sum(1) / norm, -x)
    gain = step * step * norm
    while True:
        j = int(np.argmax(gain))
        if abs(step[j]) < max(0.5, ease * total):
            break
        x[j] += step[j]
        lengths = rows[j][rows[j] > 0]
        np.subtract.at(left, lengths, step[j])
        at = np.concatenate([holder[cut[n] : cut[n + 1]] for n in set(lengths.tolist())])
        step[at] = np.maximum((left[rows[at]] * used[at]).sum(1) / norm[at], -x[at])
        gain[at] = step[at] * step[at] * norm[at]
    return x


def plan(histogram: np.ndarray, window: int, grid: int = 32) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> times in a sequence) with repeats, that use up the histogram exactly (bin i: length i + 1)."""
    left = np.concatenate([[0], histogram.astype(np.int64)])
    patterns: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        patterns.append((pattern, times))
        for length, k in pattern.items():
            left[length] -= k * times

    if left[window]:
        take({window: 1}, int(left[window]))
    # what a solution leaves is solved again, at its own scale, as long as that uses up half of it
    before = 2 * int(left.sum()) + 1
    while 0 < int(left.sum()) <= before // 2:
        before = int(left.sum())
        rows = combinations(window, left[1:] > 0, grid)
        x = repeat_counts(rows, left[1:])
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            lengths, k = np.unique(rows[j][rows[j] > 0], return_counts=True)
            times = int(min(round(x[j]), *(left[lengths] // k)))
            if times > 0:
                take(dict(zip(lengths.tolist(), k.tolist(), strict=True)), times)
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return patterns
        pattern: dict[int, int] = {}
        gap = window
        while gap:
            i = np.searchsorted(there, gap, side="right") - 1
            if i < 0:
                break
            length = int(there[i])
            k = min(gap // length, int(left[length]))
            pattern[length] = k
            gap -= k * length
            there = there[:i]
        take(pattern, int(min(left[n] // k for n, k in pattern.items())))


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, times per sequence, first sequence, offset): where the pieces of a length go, by rank."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            out.append((length, rank.get(length, 0), k, sequence, offset))
            rank[length] = rank.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, grid: int = 32, known: int = 1 << 20, at_once: int = 1 << 22) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A worker remembers the ids of up to `known` different pieces of text and cuts `at_once` characters together: memory for time.
    """
    sheltered(documents, key, text)
    kind = documents.schema[key].dataType.simpleString()
    parts = pieces(documents, tokenizer, key, text, window, end_id, known, at_once)
    per_block = parts.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_block.select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = np.zeros(window, dtype=np.int64)
    for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `window` rows
        histogram[r.length - 1] = r.n
    where = slots(plan(histogram, window, grid))
    starts = (where[:, 0] << 48) + where[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b.pop("rank").to_numpy(np.int64)
            found = where[np.searchsorted(starts, (length << 48) + rank, side="right") - 1].reshape(-1, 5)
            turn = rank - found[:, 1]
            yield b.assign(sequence_id=found[:, 3] + turn // found[:, 2], offset=found[:, 4] + turn % found[:, 2] * length)

    ranked = parts.join(offsets, ["length", "block"]).select("key", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local_rank")).alias("rank"))
    placed = ranked.mapInPandas(place, "key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.select(F.col("key").cast(kind).alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
