import hashlib
import random

import numpy as np

from sightline.llm import suffixes


def brute(rows, length=50):
    """rows: (id, text). Every string of `length` bytes with the smallest id it starts in."""
    least = {}
    data = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    for i, b in data:
        if i is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                if least.get(w, i) >= i:
                    least[w] = i
    out = []
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        if i is not None:
            for s in range(len(b) - length + 1):
                if least[b[s : s + length]] < i:
                    gone[s : s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((i is None, i or 0, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **kw):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(df, **kw).collect())


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30) for _ in range(5)]
    rows = []
    for i in range(220):
        text = prose(rng.randint(1, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(shared)[rng.randint(0, 40) :] + text[at:]
        rows.append((i, text))
    rows += [(i + 300, rows[3][1]) for i in range(40)] + [(i + 400, shared[0] + str(i)) for i in range(80)]
    rows += [(500, "ab" * 400), (501, "ab" * 100), (502, "a" * 30), (503, "a" * 49), (504, "a" * 50), (505, "a" * 51), (506, "x" * 49), (507, "x" * 49), (508, None), (509, ""), (None, rows[3][1]), (0, rows[5][1]), (0, rows[0][1]), (510, "word " * 20_000), (511, "word " * 3_000 + "\u0000end")]
    rng.shuffle(rows)
    return rows


def test_planted_overlaps_copies_and_odd_texts(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    want = brute(rows)
    assert got(df) == want
    assert got(df, memory=5_000) == want


def test_repeated_ids_with_equal_and_different_texts(spark):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefg hij") for _ in range(n))
    shared = prose(180)
    rows = [(1, shared), (2, shared + prose(30)), (2, prose(250)), (2, prose(250))]
    rows += [(3, prose(20) + shared[20:] + prose(9)), (3, shared), (3, shared), (4, shared), (4, rows[2][1][:200] + "x"), (4, rows[2][1][:200] + "x")]
    rows += [(5 + i % 6, prose(40) + shared[i : i + 90] + prose(rng.randint(0, 60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    expected = {(i, t, None if n == 0 else sha) for i, t in rows for _, j, _, n, _, sha in brute([(k, x) for k, x in rows if k < i] + [(i, t)]) if j == i}
    left = suffixes.without_repeats(df).collect()
    assert len(left) == len(rows)
    assert {(r.doc_id, r.text, None if r.kept is None else hashlib.sha256(r.kept).hexdigest()) for r in left} == expected


def test_kept_bytes(spark):
    rows = [(i, t, f"x{n}") for n, (i, t) in enumerate(planted()[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    want = {}
    for n, i, size, removed, spans, sha in brute([(i, t) for i, t, _ in rows]):
        want.setdefault((n, i), []).append((size, removed, sha))
    left = suffixes.without_repeats(df)
    assert left.columns == ["doc_id", "text", "id", "kept"]
    got = {}
    for r in left.collect():
        raw = (r.text or "").encode()
        kept = raw if r.kept is None else r.kept
        assert r.kept is None or len(kept) < len(raw)
        got.setdefault((r.doc_id is None, r.doc_id or 0), []).append((len(raw), len(raw) - len(kept), hashlib.sha256(kept).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup(empty).collect() == [] and suffixes.without_repeats(empty).collect() == []
