import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import decontaminate as dc

rng = random.Random(9)
WORDS = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
COMMON = WORDS[:30]


def prose(n, r):
    return [r.choice(COMMON) if r.random() < 0.4 else r.choice(WORDS) for _ in range(n)]


def corpus():
    r = random.Random(2)
    items = [" ".join(prose(r.randint(16, 60), r)).capitalize() + ". " + " ".join(prose(8, r)) + "." for _ in range(40)]
    docs, want = [], set()
    for i in range(400):
        words = prose(r.randint(5, 400), r)
        if i % 8 == 0:
            n = r.randrange(40)
            text = items[n].split()
            if i % 16 == 0:  # a paraphrase: a tenth of the words replaced, some put in
                text = [r.choice(WORDS) if r.random() < 0.1 else w for w in text]
                text.insert(len(text) // 2, "really")
            at = r.randint(0, len(words))
            words[at:at] = text
            want.add((i, n))
        docs.append((i, " ".join(words), "x"))
    return docs, [(n, t) for n, t in enumerate(items)], want


def test_passages_and_paraphrases_and_clean_documents(spark):
    docs, items, want = corpus()
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "... !!", "x"), (None, "short", "x"), (0, docs[0][1], "x")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items + [(100, None), (101, ""), (None, "words here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()}
    assert got - want == set()
    assert len(want & got) >= 0.97 * len(want)
    assert {(i, n) for i, n in want if i % 16} <= got
    left = dc.clean(d, b)
    assert left.columns == d.columns
    ids = {r.doc_id for r in left.collect()}
    assert not ids & {i for i, _ in got} and len(ids) == 400 + 4 - len({i for i, _ in got})
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, b, block=15).collect()} >= {(i, n) for i, n in want if i % 16}


def test_short_and_long_items_that_stand_there(spark):
    r = random.Random(12)
    rare = lambda n: ["".join(r.choice("nopqrstuvwxyz") for _ in range(8)) for _ in range(n)]
    items = [(n, " ".join(rare(size))) for n, size in enumerate([1, 1, 2, 3, 5, 250, 1000])]
    crowd = " ".join(rare(200))
    docs = [(n, " ".join(prose(90, r)) + f" {t} " + " ".join(prose(90, r))) for n, t in items] + [(50, crowd), (51, " ".join(t for _, t in items[:5]))]
    docs += [(100 + i, " ".join(prose(120, r))) for i in range(100)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (9, crowd)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(d, b).collect()}
    assert got == {(n, n) for n, _ in items} | {(50, 9)} | {(51, n) for n in range(5)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.contaminated(docs, items.limit(0)).collect() == []
    assert dc.contaminated(docs.limit(0), items).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20), st.lists(st.integers(0, 5), max_size=25))
def test_subsequence_against_dynamic_programming(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert dc.subsequence(np.array(a), np.array(b, dtype=int)) == t[-1][-1]


def test_exact_passages_of_the_table(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " " + " ".join(dc.re.findall(r"\w+", t.lower())) + " "
    texts = [(r.doc_id, norm(r.text)) for r in d.collect()]
    want = {(i, r.item_id) for r in b.collect() for i, t in texts if norm(r.text) in t}
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()} == want


def test_recall_of_paraphrases_and_long_items_against_brute_force(spark):
    r = random.Random(4)
    rare = ["".join(r.choice("nopqrstuvwxyz") for _ in range(8)) for _ in range(30000)]
    write = lambda n, share: [r.choice(rare) if r.random() < share else r.choice(COMMON) for _ in range(n)]
    items = [(n, write(size, 0.5)) for n, size in enumerate([12, 25, 40, 60, 120, 250, 500, 900] * 5)]
    docs = []
    for k in range(3):  # copies, copies without a fifth of the words, and without most of the rare words as far as 0.76 stays
        for n, words in items:
            at = [i for i, w in enumerate(words) if w in COMMON]
            odd = [i for i in range(len(words)) if i not in at] if k == 2 else list(range(len(words)))
            gone = set(r.sample(odd, min(len(odd), int(len(words) * (0, 0.2, 0.24)[k]))))
            text = [r.choice(rare) if i in gone else w for i, w in enumerate(words)]
            docs.append((len(docs), " ".join(write(r.randint(0, 300), 0.3) + text + write(r.randint(0, 300), 0.3))))
    docs += [(len(docs) + i, " ".join(write(200, 0.3))) for i in range(300)]
    want = set()
    for i, t in docs[: 3 * len(items)]:
        words = dc.word_codes(t)
        for n, w in items:
            own, span = dc.word_codes(" ".join(w)), len(w) + max(4, len(w) // 3)
            if np.isin(own, words).mean() >= 0.75:
                best = max(dc.subsequence(own, words[s : s + span]) for s in range(0, max(1, len(words) - span + 1)))
                if best >= 0.75 * len(own):
                    want.add((i, n))
    assert want >= {(k * len(items) + n, n) for k in range(3) for n, _ in items}
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")).collect()}
    assert got <= want
    assert {(n, n) for n, _ in items} <= got
    assert len(got) >= 0.95 * len(want), (len(got), len(want), sorted((i // len(items), len(items[n][1])) for i, n in want - got))


def test_repeated_and_missing_item_ids_across_blocks(spark):
    _, items, _ = corpus()
    rows = [(7 if n < 30 else None if n < 35 else n, t) for n, t in items] + [(7, items[3][1])]
    docs = [(n, "so " + t + " and more") for n, t in items]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(rows, "item_id long, text string")
    want = sorted([(n, -1 if i is None else i) for n, (i, _) in enumerate(rows[:40])] + [(3, 7)])
    for block in (4, 10, 2000):
        got = sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in dc.contaminated(d, b, block=block).collect())
        assert got == want
        assert dc.clean(d, b, block=block).collect() == []
