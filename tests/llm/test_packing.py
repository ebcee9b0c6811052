import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import packing


def check(spark, rows, window=2048):
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = packing.pack(df, packing.tokenizer_path(), window=window).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for d, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append(ids)
    for d, copies in want.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == d)
        expect = sorted((i, len(ids[i : i + window]), zlib.crc32(np.array(ids[i : i + window], "<u4").tobytes()), len(ids)) for ids in copies for i in range(0, len(ids), window))
        assert mine == expect
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return len(by) * window - sum(r.length for r in got), len(got)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(-1, None, ""), (-2, "", ""), (-3, "<|endoftext|> a", ""), (-4, "日本語 \x1c\x1d é   x\n\n\ty  ", ""), (-5, "a  b   c'll\r\n 12x  z ", ""), (-6, "word " * 30_000, ""), (None, "none", "")]
    padding, pieces = check(spark, rows + odd + rows[:3])
    assert padding < 0.01 * 2048 * pieces / 2


def test_small_window_and_empty_table(spark):
    check(spark, [(i, "a b c d e f g h"[: 2 * i], "") for i in range(9)] * 3, window=4)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=64, max_size=64))
def test_plan_uses_up_any_histogram(counts):
    h = np.array(counts)
    used = np.zeros(65, dtype=int)
    for pattern, times in packing.plan(h, 64, grid=8):
        assert times > 0 and sum(n * k for n, k in pattern.items()) <= 64
        for n, k in pattern.items():
            used[n] += k * times
    assert (used[1:] == h).all()


def test_cut_texts_of_the_table_have_the_tokenizers_ids(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own = packing.Encoder(packing.tokenizer_path(), most=500)
    assert own.cuts
    assert all(own.encode(t) == own.whole(t) for t in texts)
    whole = packing.Encoder(packing.tokenizer_path())
    assert whole.encode_some(texts) == [own.whole(t) for t in texts]


PLAIN_TEXT = st.text(st.sampled_from("aZé\u017fß09²½ª'sltrevmd.,!\u2013\u2026€ \t\n\r-_<|>") | st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=60)


@settings(max_examples=600, deadline=None)
@given(st.lists(PLAIN_TEXT, max_size=4))
def test_cut_texts_have_the_ids_of_whole_ones(texts):
    encoder = packing.encoder(packing.tokenizer_path())
    encoder.known = {"": b""}
    assert encoder.encode_some(texts) == [encoder.whole(t) for t in texts]


def test_more_partitions_than_tasks(spark):
    """A task that runs through several partitions keeps their pieces apart."""
    docs = spark.createDataFrame([(i, "a b c d e f g h"[: i % 14]) for i in range(700)], "doc_id long, text string").repartition(100)
    got = packing.pack(docs, packing.tokenizer_path(), window=16).collect()
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(got) == 700 == len(set(places))
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 16


def test_padding_does_not_grow_with_the_corpus():
    """The same shares of lengths at three scales: what is padded does not become a larger share."""
    rng = np.random.default_rng(4)
    shape = np.zeros(512)
    shape[:400] = rng.pareto(1.5, 400) + 0.05
    shares = []
    for scale in (10**3, 10**6, 10**10):
        h = (shape * scale).astype(np.int64)
        plan = packing.plan(h, 512, grid=16)
        full, used = sum(times for _, times in plan) * 512, int((h * np.arange(1, 513)).sum())
        shares.append((full - used) / used)
    assert max(shares) < 0.005 and shares[2] <= shares[0]
