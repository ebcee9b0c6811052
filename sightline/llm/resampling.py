"""Importance resampling towards a target distribution, on hashed word n-grams.

One scan of each text keeps the running CRC states of the last n starts, extends each by a space and the next word and
emits the bucket of every run of 1 to n words (`ring`). Those buckets are written once, as two or four bytes each; counts
over all documents, the weights of documents and the draw follow from that table, texts are not read again.

A bucket's gain compares its share of the target's features with its share of the documents'; a document's weight is its
mean gain. Noise that follows from a document's id is added, and the documents with the highest scores are drawn: a sample
without replacement in proportion to the exponentials of the weights.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sheltered, written

#: Bytes to lower case for A-Z; digits, a-z and all bytes of other characters stay, the rest parts words.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
MOST_BUCKETS = 1 << 20
#: Scores differ by less than twice 1000 * ln(2^64) and the noise: there are few bands of so many scores.
BAND = 1024


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def ring(words: list[bytes], n: int) -> list[int]:
    """CRC-32 of every run of 1 to n consecutive words joined by spaces, in the order in which the runs end."""
    states: deque[int] = deque()
    out: list[int] = []
    for word in words:
        if len(states) == n:
            states.popleft()
        if states:
            further = b" " + word
            for i, state in enumerate(states):
                states[i] = zlib.crc32(further, state)
        states.append(zlib.crc32(word))
        out += states
    return out


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(rows: DataFrame, n: int, buckets: int, key: str | None, text: str) -> DataFrame:
    """(id, n_words, buckets): each row's feature buckets as little-endian integers of two or four bytes."""
    kind = _kind(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found = [], []
            for value in batch.column(1):
                words = words_of(value.as_py())
                lengths.append(len(words))
                found.append((np.array(ring(words, n), dtype=np.uint32) % buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(found, pa.binary())], names=["id", "n_words", "buckets"])

    ids = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return rows.select(ids.alias("id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(scan, "id long, n_words long, buckets binary")


def counted(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket. Each task sums its own; what comes to the driver is one number for each bucket."""
    kind = _kind(buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(v.as_py() for v in batch.column(0)), dtype=kind), minlength=buckets)
        (there,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    sums = table.select("buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share of the target over that of the documents, floored."""
    buckets, of_source, of_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (of_source + buckets) / ((float(s) + 1) * (of_target + buckets)))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def weighed(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of the gains of a row's features, 0 without any."""
    kind = _kind(len(gains))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_py(), dtype=kind) for v in batch.column(2)]
            means = [int(gains[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array(means, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return table.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, percent: int) -> DataFrame:
    """scored (id, n_features, score, entered) with rank: 1, 2, 3... for the highest scores of percent of the entered rows, else null.

    Scores are whole numbers of a narrow range, so counts by score are few; they tell how many rows stand above each
    score, and rows are put in order only among those that share one.
    """
    entered = scored.where("entered")
    counts = entered.groupBy("score").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("score") / BAND))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = counts.groupBy("band").agg(F.sum("n").alias("n"))
    quota = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    bands = bands.select("band", before(Window.orderBy(F.desc("band"))).alias("over"), quota.alias("quota"))
    starts = counts.withColumn("within", before(Window.partitionBy("band").orderBy(F.desc("score")))).join(F.broadcast(bands), "band")
    starts = starts.select("score", (F.col("over") + F.col("within")).alias("above"), "quota").where("above < quota")
    placed = scored.join(F.broadcast(starts), "score", "left")
    high = F.col("entered") & F.col("above").isNotNull()
    among = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features"))
    rank = F.col("above") + among
    chosen = placed.where(high).withColumn("rank", F.when(rank <= F.col("quota"), rank))
    rest = placed.where(~high).withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(rest).select(*scored.columns, F.col("rank").cast("long").alias("rank"))


def resample(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document: its key, n_words, n_features, weight, score and rank (null where it is not drawn).

    Null and empty texts have no features, weight 0 and only their noise as score; they stay undrawn where least_words is
    over 0. Repeated rows count and are drawn one by one; rows of one score are ordered by key, nulls last, then by number of
    features. A null key has the noise of the bare seed. An empty target or an empty table gives gains from the smoothing
    alone and an empty result. Other columns are left out. Texts of any length are scanned whole.
    """
    sheltered(documents, key, text)
    sheltered(target, target_text)
    if not 0 < buckets <= MOST_BUCKETS or n < 1:
        raise ValueError(f"n must be positive and buckets from 1 to {MOST_BUCKETS}")
    table = written(features(documents, n, buckets, key, text), "features")
    gains = gains_of(counted(table, buckets), counted(features(target, n, buckets, None, target_text), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(table, gains).withColumns({"score": F.col("weight") + noise, "entered": F.col("n_words") >= least_words})
    ranked = drawn(written(scored, "scored", small=True), percent)
    return ranked.select(F.col("id").alias(key), "n_words", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(documents, benchmark).drop("n_words")


_WORDS = r"unnest(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w"
QUERIES = {"op11_resampling": op11_resampling}
ORACLES: dict[str, str] = {
    "op11_resampling": f"""
WITH steps AS (SELECT list(c ORDER BY i) AS table_ FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)) AS q),
docs AS (SELECT row_number() OVER () AS row_, doc_id, text FROM documents),
words AS (SELECT row_, {_WORDS.format(text="text")} FROM docs),
wanted AS (SELECT {_WORDS.format(text="text")} FROM benchmark),
spelt AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM words UNION SELECT w FROM wanted) AS q),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(length(x) // 2)]), lambda c, b: xor(c >> 8, table_[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelt CROSS JOIN steps),
s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY 1),
sizes AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS of_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS of_t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (of_s + 10000) / ((s.n::DOUBLE + 1) * (of_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket) CROSS JOIN sizes),
weights AS (SELECT row_, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (row_)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (n_features >= 20) OVER () AS entered FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= entered * 10 // 100 THEN place END AS rank FROM placed
"""
}
