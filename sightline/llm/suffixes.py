"""Operator 2: removal of long byte strings that an earlier document holds, by sharded external induced sorting.

A byte goes where it is covered by a string of `length` bytes that also starts in a document with a smaller id. Sorting
the suffixes of a whole corpus would move every byte many times, so shards are cut first: each window of `length` bytes
is keyed by the least hash of the 24-byte strings inside it, equal windows have equal keys, and only windows whose key
occurs in two different texts can matter. Runs of such windows with one key are pieces of text, and all pieces of a key
meet in one shard, so shards never need each other. A shard is suffix-sorted by `induced.suffixes`, whose queues carry
suffixes and common prefixes through memory and the shared folder; neighbours with a common prefix of `length` or more
are one group, and its windows outside the smallest document are removed. Equal pieces are reduced to the one in the
smallest document, before they move and again in the shard, where pieces alone under their key need no sorting. Keys in
more than 1/400 of the texts, or in over 20,000, are dealt by their windows' full hash.

Exact copies of a text share the work of the one with the smallest id: they go as a whole (from `length` bytes on).
Null and empty texts have no bytes; rows without an id lose nothing and remove nothing; rows that share an id do not
remove each other's bytes, and each loses what its own text holds; texts count whole; an empty table gives an empty
result; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced
from .common import HEAVY_SHARE, even_keys, heavy_keys, lookup_join, marked_ids, release, releasing, shared_dir, sheltered, written
from .jaccard import _powers, mix

_U = np.uint64
GRAM = 24
#: Bytes of a text's digest that name it while keys are counted.
DIGEST = 16


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of every string of k bytes."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    _powers.reach(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((raw.astype(_U) + _U(1)) * _powers.up[: len(raw)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers.down[:n])


def window_keys(raw: np.ndarray, length: int) -> np.ndarray:
    """For every window of `length` bytes the least hash of the 24-byte strings in it."""
    h = rolling(raw, GRAM)
    w = length - GRAM + 1
    if len(h) < w:
        return np.zeros(0, dtype=_U)
    step = 1
    while 2 * step <= w:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = w - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return start, np.append(start[1:], len(x))


def digest_of(raw: np.ndarray) -> bytes:
    return hashlib.sha256(raw).digest()


def planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte by byte: their leading bytes repeat and compress."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(_U).ravel()


def short_digest(column: Column) -> Column:
    """The first DIGEST bytes of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(column, 256)), 1, DIGEST)


def shared_keys(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """(digest, keys, hot): for each text the keys that other texts have too; hot ones are in over 1/400 of the texts."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def flush() -> pd.DataFrame:
            count = [len(v) for v in held.values()]
            keys = np.concatenate([np.zeros(0, dtype=_U), *held.values()])
            text = np.repeat(np.arange(len(held), dtype=np.uint16), count)
            names = list(held)
            bucket = ((keys >> _U(32)) % _U(buckets)).astype(np.int64)
            at = np.lexsort((keys, bucket))
            cut = np.searchsorted(bucket[at], np.arange(buckets + 1))
            out = []
            for i in np.flatnonzero(np.diff(cut)):
                part = at[cut[i] : cut[i + 1]]
                used, number = np.unique(text[part], return_inverse=True)
                out.append((i, planes(keys[part]), number.astype(np.uint16).tobytes(), b"".join(names[j] for j in used)))
            return pd.DataFrame(out, columns=["bucket", "keys", "texts", "names"])

        for b in batches:
            for t in b["text"]:
                raw = raw_bytes(t)
                if len(raw) >= length:
                    name = digest_of(raw)[:DIGEST]
                    if name not in held:
                        keys = window_keys(raw, length)
                        held[name] = np.unique(keys[runs(keys)[0]])
                        size += len(held[name])
                if size > 500_000 or len(held) == 1 << 16:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        release()
        keys = np.concatenate([from_planes(x) for x in b["keys"]])
        names = [x[i : i + DIGEST] for x in b["names"] for i in range(0, len(x), DIGEST)]
        base = np.cumsum([0, *(len(x) // DIGEST for x in b["names"])])
        text = np.concatenate([np.frombuffer(x, dtype=np.uint16).astype(np.int64) + n for x, n in zip(b["texts"], base, strict=False)])
        known = {n: i for i, n in enumerate(dict.fromkeys(names))}
        names_once = list(known)
        text = np.array([known[n] for n in names], dtype=np.int64)[text]
        order = np.lexsort((text, keys))
        keys, text = keys[order], text[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))
        keys, text = keys[new], text[new]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(start, len(keys)))
        many = np.repeat(count, count)
        keys, text, many = keys[many > 1], text[many > 1], many[many > 1]
        # texts go on by parts of the corpus, many in a row: rows do not multiply with the buckets
        part = np.array([int.from_bytes(n[:8], "little") % buckets for n in names_once], dtype=np.int64)
        order = np.lexsort((text, part[text])) if len(text) else text
        keys, text, many = keys[order], text[order], many[order]
        out = []
        for s, e in zip(*runs(part[text]), strict=True):
            cut, end = runs(text[s:e])
            out.append((part[text[s]], b"".join(names_once[t] for t in text[s + cut]), (end - cut).astype(np.int64).tobytes(), keys[s:e].tobytes(), many[s:e].astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["part", "names", "sizes", "keys", "many"])

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        release()
        names = [x[i : i + DIGEST] for x in b["names"] for i in range(0, len(x), DIGEST)]
        known = {n: i for i, n in enumerate(dict.fromkeys(names))}
        sizes = np.frombuffer(b"".join(b["sizes"]), dtype=np.int64)
        text = np.repeat(np.array([known[n] for n in names], dtype=np.int64), sizes)
        keys, many = np.frombuffer(b"".join(b["keys"]), dtype=_U), np.frombuffer(b"".join(b["many"]), dtype=np.int64)
        order = np.argsort(text, kind="stable")
        keys, many = keys[order], many[order]
        cut, end = runs(text[order])
        return pd.DataFrame({"digest": list(known), "keys": [keys[s:e].tobytes() for s, e in zip(cut, end, strict=True)], "many": [many[s:e].tobytes() for s, e in zip(cut, end, strict=True)]})

    posted = rows.select("text").mapInPandas(releasing(post), "bucket long, keys binary, texts binary, names binary")
    met = posted.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "part long, names binary, sizes binary, keys binary, many binary")
    whole = met.repartition(buckets, "part").groupBy("part").applyInPandas(gather, "digest binary, keys binary, many binary")
    return written(whole.select("digest", F.array(F.struct("keys", "many")).alias("found")), "keys")


PIECES = "deal long, shard long, docs binary, tags binary, starts binary, sizes binary, keys binary, bytes binary"


def packed(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray, shards: np.ndarray) -> list[tuple]:
    """Rows of PIECES without bytes, for each of the shards given per piece."""
    order = np.argsort(shards, kind="stable")
    out = []
    for s, e in zip(*runs(shards[order]), strict=True):
        at = order[s:e]
        out.append((int(shards[at[0]]), doc[at].tobytes(), tag[at].tobytes(), start[at].tobytes(), size[at].tobytes(), b"", b""))
    return out


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(_U)) % _U(buckets)).astype(np.int64)


def equal_pieces(text: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each piece, whether a smaller document holds an equal one)."""
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(x, len(number)) for x in text), dtype=np.int64, count=len(text))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    return kind, doc > least[kind]


def pieces(candidates: DataFrame, length: int, shards: int, buckets: int, hot_from: int, deal: Sequence[int], block_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of text by shard, in blocks; of equal pieces of a block those in the smallest document.

    A piece names its document by id, which decides who is smaller, and by a tag of its text, as texts may share an id. What goes in the other documents of the block is known already; it comes as rows of shards below 0, one for each
    bucket of documents. deal has a number for each bucket and shard, by which they are dealt to tasks.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text: list[bytes] = []
        facts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pd.DataFrame:
            doc, tag, start, size, key = (np.concatenate(x) for x in zip(*facts, strict=True))
            _, gone = equal_pieces(text, doc)
            out = packed(doc[gone], tag[gone], start[gone], size[gone], -1 - bucket_of(doc[gone], buckets))
            shard = ((key >> _U(20)) % _U(shards)).astype(np.int64)
            order = np.flatnonzero(~gone)
            order = order[np.argsort(shard[order], kind="stable")]
            for s, e in zip(*runs(shard[order]), strict=True):
                at = order[s:e]
                out.append((int(shard[at[0]]), doc[at].tobytes(), tag[at].tobytes(), start[at].tobytes(), size[at].tobytes(), key[at].tobytes(), b"".join([text[i] for i in at])))
            return pd.DataFrame([(deal[buckets + r[0]], *r) for r in out], columns=[c.split()[0] for c in PIECES.split(", ")])

        for b in batches:
            for doc, name, whole_text, found in zip(b["id"].to_numpy(), b["digest"], b["text"], b["found"], strict=True):
                raw = raw_bytes(whole_text)
                data = raw.tobytes()
                keys = window_keys(raw, length)
                known = np.concatenate([np.frombuffer(f["keys"], dtype=_U) for f in found])
                many = np.concatenate([np.frombuffer(f["many"], dtype=np.int64) for f in found])
                order = np.argsort(known)
                known, many = known[order], many[order]
                start, stop = runs(keys)
                key = keys[start]
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                ok = known[at] == key
                start, stop, key, hot = start[ok], stop[ok], key[ok], many[at[ok]] >= hot_from
                if hot.any():
                    whole = rolling(raw, length)
                    one = np.concatenate([np.arange(s, e) for s, e in zip(start[hot], stop[hot], strict=True)])
                    start, stop, key = np.concatenate([start[~hot], one]), np.concatenate([stop[~hot], one + 1]), np.concatenate([key[~hot], whole[one]])
                size = stop + (length - 1) - start
                text += [data[s:e] for s, e in zip(start.tolist(), (start + size).tolist(), strict=True)]
                facts.append((np.full(len(start), doc, dtype=np.int64), np.full(len(start), np.frombuffer(name, dtype=np.int64)[0]), start.astype(np.int64), size.astype(np.int64), key))
                held += int(size.sum()) + 168 * len(size)
                if held > block_bytes:
                    yield flush()
                    text.clear()
                    facts.clear()
                    held = 0
        if facts:
            yield flush()

    return candidates.select("id", "digest", "text", "found").mapInPandas(releasing(cut), PIECES)


def sorted_spans(text: list[bytes], doc: np.ndarray, start: np.ndarray, length: int, scratch: induced.Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Windows (piece, start) that also start in a smaller document, from the shard's suffix order."""
    t = np.frombuffer(b"\x00".join(text) + b"\x00", dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    stop = np.cumsum([len(x) + 1 for x in text])
    t[stop - 1] = 0
    first = np.append(0, stop[:-1])
    gone: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(pos: np.ndarray, begin: np.ndarray) -> None:
        """Groups of suffixes with a common prefix of `length`: windows inside their pieces, outside the smallest document."""
        count = np.diff(np.append(begin, len(pos)))
        several = np.repeat(count > 1, count)
        group, pos = np.repeat(np.arange(len(count)), count)[several], pos[several]
        p = np.searchsorted(stop, pos, side="right")
        ok = stop[p] - 1 - pos >= length
        pos, group, p = pos[ok], group[ok], p[ok]
        if len(pos):
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            d = doc[p]
            over = d > np.repeat(np.minimum.reduceat(d, cut), np.diff(np.append(cut, len(d))))
            gone.append((p[over], (start[p] + pos - first[p])[over]))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pos, lcp in induced.suffixes(t, length, scratch):
        begin = np.flatnonzero(lcp < length)
        if not len(begin):
            held.append((pos, lcp))
            continue
        if held or begin[0] > 0:
            head = np.concatenate([*(x for x, _ in held), pos[: begin[0]]])
            settle(head, np.zeros(1, dtype=np.int64))
        last = begin[-1]
        settle(pos[begin[0] : last], begin[:-1] - begin[0])
        held = [(pos[last:], lcp[last:])]
    if held:
        settle(np.concatenate([x for x, _ in held]), np.zeros(1, dtype=np.int64))
    return tuple(np.concatenate(x) for x in zip(*gone, strict=True)) if gone else (np.zeros(0, dtype=np.int64),) * 2


def numbered(doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each (document, tag), documents and tags by number)."""
    order = np.lexsort((tag, doc))
    new = np.append(True, (doc[order][1:] != doc[order][:-1]) | (tag[order][1:] != tag[order][:-1])) if len(doc) else np.zeros(0, dtype=bool)
    number = np.empty(len(doc), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, doc[order][new], tag[order][new]


def runs_of(doc: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (document, start, stop) of the bytes covered."""
    if not len(doc):
        return doc, at, at
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    end = at + (size[order] if isinstance(size, np.ndarray) else size)
    reach = end.copy()
    # running maximum of the ends within a document
    new_doc = np.append(True, doc[1:] != doc[:-1])
    lift = np.cumsum(new_doc).astype(np.int64) << 40
    reach = np.maximum.accumulate(reach + lift) - lift
    new = new_doc | np.append(True, at[1:] > reach[:-1])
    cut = np.flatnonzero(new)
    return doc[cut], at[cut], reach[np.append(cut[1:] - 1, len(doc) - 1)]


def shard_spans(blocks: DataFrame, length: int, shards: int, buckets: int, folder: str, memory: int) -> DataFrame:
    """(id, tag, spans): for each document the bytes that go, as packed starts and stops.

    In a shard, equal pieces are reduced first, like in a block. A key that is then left with one piece has no other
    windows to meet; the pieces of all other keys are sorted.
    """

    def sort(b: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        shard = int(b["shard"].iloc[0])
        doc, tag, start, size = (np.frombuffer(b"".join(b[c]), dtype=np.int64) for c in ("docs", "tags", "starts", "sizes"))
        if shard >= 0:
            key = np.frombuffer(b"".join(b["keys"]), dtype=_U)
            data = b"".join(b["bytes"])
            edge = np.append(0, np.cumsum(size)).tolist()
            text = [data[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True)]
            del b, data
            kind, gone = equal_pieces(text, doc)
            gone_parts = [(doc[gone], tag[gone], start[gone], size[gone])]
            at = np.flatnonzero(~gone)
            pair = np.unique(np.stack([key[at], kind[at].view(_U)]), axis=1)
            names, count = np.unique(pair[0], return_counts=True)
            several = names[count > 1]
            if len(several):
                at = at[several[np.minimum(np.searchsorted(several, key[at]), len(several) - 1)] == key[at]]
                system, base = fs.FileSystem.from_uri(folder)
                scratch = induced.Scratch((system, f"{base}/{shard}-{TaskContext.get().taskAttemptId()}"), memory)
                p, s = sorted_spans([text[i] for i in at], doc[at], start[at], length, scratch)
                gone_parts.append((doc[at[p]], tag[at[p]], s, np.full(len(p), length)))
            doc, tag, start, size = (np.concatenate(x) for x in zip(*gone_parts, strict=True))
        number, docs, tags = numbered(doc, tag)
        number, start, stop = runs_of(number, start, size)
        doc, tag = docs[number], tags[number]
        rows = packed(doc, tag, start, stop, bucket_of(doc, buckets))
        release()
        return pd.DataFrame([x[:5] for x in rows], columns=["bucket", "docs", "tags", "starts", "stops"])

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        doc, tag, start, stop = (np.frombuffer(b"".join(b[c]), dtype=np.int64) for c in ("docs", "tags", "starts", "stops"))
        number, docs, tags = numbered(doc, tag)
        number, start, stop = runs_of(number, start, stop - start)
        cut, end = runs(number)
        release()
        return pd.DataFrame({"id": docs, "tag": [t.tobytes() for t in tags], "spans": [np.stack([start[s:e], stop[s:e]]).tobytes() for s, e in zip(cut, end, strict=True)]})

    # as many tasks as shards, so that what a task reads does not grow with the corpus
    spans = blocks.repartition(2 * shards, "deal").groupBy("deal").applyInPandas(sort, "bucket long, docs binary, tags binary, starts binary, stops binary")
    return written(spans.groupBy("bucket").applyInPandas(merge, "id long, tag binary, spans binary"), "spans")


def repeated_spans(rows: DataFrame, length: int, shard_bytes: int, memory: int) -> tuple[DataFrame, bool]:
    """rows (id, text): (id, tag, spans) of the texts that lose bytes, but for copies of a text; and whether an id stands on several rows."""
    spark = rows.sparkSession
    known = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(shuffles, int((size.bytes or 0) // 13 // 1_000_000) + 1)

    facts = known.select("id", short_digest(F.col("text")).alias("digest"))
    keys = shared_keys(known, length, buckets)
    reps = facts.groupBy("digest").agg(F.min("id").alias("rep"))
    wanted = keys.join(reps, "digest").select(F.col("rep").alias("id"), "digest", "found")
    repeated = duplicated(known)
    # they meet by the digest alone, by which the keys are dealt already; the ids are compared then
    named = wanted.withColumnRenamed("id", "_rep").hint("shuffle_hash")
    texts = filtered_ids(known, written(wanted.select("id"), "ids", small=True)).join(named, "digest").where("id <= _rep AND id >= _rep").drop("_rep")
    # where an id stands on several rows with one text, one of them is enough
    candidates = texts.groupBy("id", "digest").agg(F.first("text").alias("text"), F.first("found").alias("found")) if repeated else texts
    shards = max(shuffles, int((size.bytes or 0) // shard_bytes) + 1)
    blocks = pieces(candidates, length, shards, shards, min(max(3, size.n // HEAVY_SHARE), 20_000), even_keys(spark, 2 * shards))
    return shard_spans(blocks, length, shards, max(shuffles, int((size.n or 0) // 100_000) + 1), shared_dir(spark), memory), repeated


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, shard_bytes: int = 12 << 20, memory: int = 96 << 20) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256."""
    sheltered(documents, key, text)
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    spans, repeated = repeated_spans(rows, length, shard_bytes, memory)
    return results(rows, spans, key, length, repeated, documents.schema[key].dataType.simpleString())


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, shard_bytes: int = 8 << 20, memory: int = 64 << 20, whole_characters: bool = False) -> DataFrame:
    """The documents with kept: the bytes that remain of a text that loses some, else null. Only texts that may lose some move.

    whole_characters: bytes left of a broken character go too.
    """
    sheltered(documents, key, text)
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    spans, _ = repeated_spans(rows, length, shard_bytes, memory)
    tag = lambda digest: F.substring(digest, 1, 8)
    copied = copies_of(rows.select("id", F.octet_length("text").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest")), length)
    whole = written(copied.where("rep < id").select("id", tag("digest").alias("tag")).distinct(), "whole", small=True)
    # a text is the first of its copies and has spans, or goes as a whole
    gone = spans.unionByName(whole.withColumn("spans", F.lit(None).cast("binary"))).withColumn("some", F.lit(True))
    marked = marked_ids(documents, gone.select("id"), key)

    @F.pandas_udf("binary")
    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        kept = [cut_bytes(raw_bytes(t), some)[0] if some is not None else b"" for t, some in zip(texts, spans, strict=True)]
        return pd.Series([b.decode("utf-8", "ignore").encode() for b in kept] if whole_characters else kept, dtype=object)

    own = [f"`{c}`" for c in documents.columns]
    maybe = marked.where("maybe").select(*own, F.col(key).cast("long").alias("_id"), tag(F.unhex(F.sha2(F.col(text).cast("string"), 256))).alias("_tag"))
    met = maybe.join(gone.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), "spans", "some").hint("shuffle_hash"), ["_id", "_tag"], "left")
    some = met.where("some").select(*own, left(F.col(text).cast("string"), "spans").alias("kept"))
    rest = lambda df: df.select(*own, F.lit(None).cast("binary").alias("kept"))
    return rest(marked.where("NOT maybe")).unionByName(rest(met.where("some IS NULL"))).unionByName(some)


def cut_bytes(raw: np.ndarray, spans: bytes) -> tuple[bytes, int]:
    """What is left of a text without its spans, and their number."""
    start, stop = np.frombuffer(spans, dtype=np.int64).reshape(2, -1)
    keep = np.ones(len(raw), dtype=bool)
    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
        keep[s:e] = False
    return raw[keep].tobytes(), len(start)


def duplicated(known: DataFrame) -> bool:
    """Whether an id stands on several rows."""
    return known.groupBy("id").count().where("count > 1").limit(1).count() > 0


def filtered_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, digest, text) of the rows whose id may be among ids."""
    return marked_ids(rows, ids).where("maybe").select("id", short_digest(F.col("text")).alias("digest"), "text")


def copies_of(base: DataFrame, length: int) -> DataFrame:
    """base (id, n_bytes, digest, ...) with rep: the smallest id of the rows with the digest, for texts of `length` bytes that stand on several."""
    able = F.col("id").isNotNull() & (F.col("n_bytes") >= length)
    copies = base.where(able).groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("digest", "rep")
    copies = written(copies, "copies", small=True)
    keyed = base.withColumn("on", F.when(able, F.hex("digest")))
    return lookup_join(keyed, copies.select(F.hex("digest").alias("on"), "rep"), "on", heavy_keys(keyed.where("on IS NOT NULL"), "on")).drop("on")


def results(rows: DataFrame, spans: DataFrame, key: str, length: int, repeated: bool, kind: str) -> DataFrame:
    """Copies of a text go whole; the first of it loses its spans; all other rows keep everything."""
    texts = filtered_ids(rows, spans).withColumn("tag", F.substring("digest", 1, 8))
    spanned = texts.join(spans.hint("shuffle_hash"), ["id", "tag"])
    spanned = spanned.groupBy("id", "digest").agg(F.first("text").alias("text"), F.first("spans").alias("spans")) if repeated else spanned

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, some in zip(b["id"].to_numpy(), b["text"], b["spans"], strict=True):
                raw = raw_bytes(text)
                left, n = cut_bytes(raw, some)
                out.append((i, digest_of(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=["id", "digest", "n_removed", "n_spans", "kept_sha256"])

    changed = spanned.select("id", "text", "spans").mapInPandas(cut, "id long, digest binary, n_removed long, n_spans long, kept_sha256 string")
    body = F.coalesce(F.col("text"), F.lit(""))
    base = rows.select("id", F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("digest"))
    met = copies_of(base, length).join(changed, ["id", "digest"], "left")
    copy = F.coalesce(F.col("rep") < F.col("id"), F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    return met.select(
        F.col("id").cast(kind).alias(key), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_suffixes": op2_suffixes}
ORACLES: dict[str, str] = {}
