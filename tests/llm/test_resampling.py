import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UP))


def runs(found, n):
    """All runs, each joined and hashed by itself."""
    return [zlib.crc32(" ".join(found[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(found) - k + 1)]


def brute(docs, target, n, buckets, least, percent):
    feats = [(d, words(t), [h % buckets for h in runs(words(t), n)]) for d, t in docs]
    s, t = Counter(b for _, _, f in feats for b in f), Counter(h % buckets for x in target for h in runs(words(x), n))
    of_s, of_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (of_s + buckets) / ((s[b] + 1.0) * (of_t + buckets))))
    rows = []
    for d, w, f in feats:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    among = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(among[: percent * len(among) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


@given(st.text(max_size=60), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_ring_is_every_run(text, n):
    found = resampling.words_of(text.encode("utf-8", "ignore"))
    assert [w.decode() for w in found] == words(text.encode("utf-8", "ignore").decode())
    assert Counter(resampling.ring(found, n)) == Counter(runs([w.decode() for w in found], n))


def test_whole_table_against_brute_force(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    pairs, texts = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    for n, buckets in ((1, 10_000), (3, 70_000)):
        got = resampling.resample(docs, target, n=n, buckets=buckets).collect()
        assert sorted(map(tuple, got), key=str) == brute(pairs, texts, n, buckets, 20, 10)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    same = " ".join(["one two three"] * 10)
    rows = [(1, None, 7), (2, "", 7), (3, "É été A1-b\x00c", 7), (4, same, 7), (4, same, 7), (4, same + " more", 7), (None, same, 7), (5, long, 7), (6, "word " * 20, 7), (6, "word " * 20, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    target = spark.createDataFrame([("three more", 1), (None, 2)], "text string, id long")
    got = resampling.resample(docs, target, percent=70)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:2] for r in rows], ["three more"], 1, 10_000, 20, 70)
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == len(rows)


def test_draws_lean_towards_the_target(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"{'near' if i % 5 == 0 else 'far'}{k}" for k in range(40)], 60)) for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rng.choice([f"near{k}" for k in range(40)], 60)),) for _ in range(30)], "text string")
    drawn = [r.doc_id for r in resampling.resample(docs, target).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 50 and sum(d % 5 == 0 for d in drawn) > 35
