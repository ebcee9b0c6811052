import random
import re

import numpy as np

from sightline.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(UP))
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        seen = {}
        for x in s:
            for j in where[x]:
                seen[j] = seen.get(j, 0) + 1
        for j, c in seen.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def got(df, **kw):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, **kw).collect())


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(df) == brute(rows)


def test_planted_groups_and_shared_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(260):  # near copies of one text: some reach each other only through others
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = word()
        rows.append((i * 3, " ".join(w)))
    rows += [(i * 3 + 1, " ".join(passage + [word() for _ in range(rng.randint(0, 40))])) for i in range(200)]
    rows += [(i * 3 + 2, " ".join(base)) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(df) == want
    assert got(df, part=16, tokens=500, order_sample=50) == want


def test_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "A b", "x"), (5, "a B", "x"), (6, "a b", "x"), (7, "a b c d e", "x"), (8, "a b c d e", "x"), (9, long, "x"), (10, long + " end", "x"), (8, "a b c d e", "x"), (11, "É x", "x"), (12, "é x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    want = brute([(i, t) for i, t, _ in rows])
    assert sorted(set(got(df))) == want
    assert jaccard.join(df.limit(0)).collect() == []


def by_rows(rows):
    """Rows are vertices, also where they share an id: (id, size of the set, least id of the component)."""
    numbered = [(n, t) for n, (_, t) in enumerate(rows)]
    least = {}
    for n, _, c in brute(numbered):
        least[c] = min(least.get(c, 1 << 62), rows[n][0])
    return sorted((rows[n][0], size, least[c]) for n, size, c in brute(numbered))


def test_repeated_ids_and_sets_with_one_number(spark):
    rng = random.Random(9)
    text = lambda k: " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, c), (4, c + " z"), (5, c + " z"), (4, "alone"), (7, b + " y q"), (2, c)]
    rows += [(10 + i % 7, text("n")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == by_rows(rows)
    assert got(df, node_bits=3) == by_rows(rows)


def test_many_near_copies_at_the_threshold(spark):
    """Some 2,000 near copies, many of them with no link, in blocks that meet pairwise; more links than rows may leave."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(64)]
    rows = []
    for i in range(2000):
        w = list(base)
        for at in rng.sample(range(8, 64, 5), rng.choice((0, 1, 2, 3))):
            w[at] = f"{rng.choice('xyz')}{at}" if rng.random() < 0.5 else f"r{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert len({c for *_, c in want}) > 20
    assert got(df) == want
    assert got(df, part=64, tokens=2000) == want


def test_bounds_never_reject_a_link():
    rng = np.random.default_rng(0)
    for n in (1, 30, 700, 5000):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a = np.unique(pool[:n])
        for share in (0.98, 0.9, 0.6):
            b = np.unique(np.concatenate([a[: max(1, int(n * share))], pool[n : n + n // 20]]))
            link = bool(jaccard.enough(len(np.intersect1d(a, b)), len(a), len(b)))
            sizes, maps = np.array([len(a), len(b)]), [jaccard.bitmap(a).tobytes(), jaccard.bitmap(b).tobytes()]
            assert jaccard.may_link(np.array([1, 2]), sizes, maps).all() or not link
            assert not jaccard.may_link(np.array([3, 3]), sizes, maps).any()
            x, y = jaccard.united(np.array([7, 2]), [a, b])
            assert (x.tolist(), y.tolist()) == (([7], [2]) if link else ([], []))


def test_blocks_unite_like_brute_force():
    rng = np.random.default_rng(5)
    for group in (1, 4, 32):
        pool = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
        sets = [np.unique(rng.choice(pool, rng.integers(20, 58), replace=False)) for _ in range(90)]
        comps = rng.integers(0, 40, 90)
        parent = {int(c): int(c) for c in comps}

        def find(c, parent=parent):
            while parent[c] != c:
                c = parent[c]
            return c

        for i in range(90):
            for j in range(i):
                if jaccard.enough(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    a, b = find(int(comps[i])), find(int(comps[j]))
                    parent[max(a, b)] = min(a, b)
        a, b = jaccard.united(comps, sets, group)
        found = dict(zip(a.tolist(), b.tolist(), strict=True))
        assert found == {c: find(c) for c in parent if find(c) != c}
        assert found


def brute_links(rows):
    """Pairs of rows that link, from all pairs that share a shingle; numbers of links by row."""
    sets = [(i, s) for i, s in ((i, sets_of([(i, t)])[i]) for i, t in rows) if s]
    where, pairs = {}, set()
    for n, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(n)
    for m in where.values():
        pairs |= {(a, b) for a in m for b in m if a < b}
    linked = [(a, b) for a, b in pairs if enough_shared(sets[a][1], sets[b][1])]
    count = [0] * len(sets)
    for a, b in linked:
        count[a] += 1
        count[b] += 1
    least = {}
    for i, s in sets:
        least[frozenset(s)] = min(i, least.get(frozenset(s), i))
    between = {tuple(sorted((least[frozenset(sets[a][1])], least[frozenset(sets[b][1])]))) for a, b in linked if sets[a][1] != sets[b][1]}
    return sorted(between), sorted((i, least[frozenset(s)], count[n]) for n, (i, s) in enumerate(sets))


def enough_shared(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_links_against_brute_force(spark):
    """Near copies of several texts, at and around the threshold, copies, and a group larger than a part."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for size, copies in ((60, 45), (12, 20), (4, 3), (200, 10)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            last = rng.randint(0, size // 8)
            text[size - last :] = [word() for _ in range(last)]
            rows += [(n + k, " ".join(text)) for k in range(rng.choice((1, 1, 3)))]
            n += 5
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (5003, "one two"), (None, "one two"), (5004, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (256, 16):
        pairs, docs = jaccard.links(df, part=part)
        want_pairs, want_docs = brute_links([r for r in rows if r[0] is not None])
        assert sorted(map(tuple, pairs.collect())) == want_pairs and len(want_pairs) > 200
        assert sorted((r.doc_id, r["class"], r.n_links) for r in docs.collect()) == want_docs
    pairs, docs = jaccard.links(df.limit(0))
    assert pairs.count() == docs.count() == 0


def test_links_of_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs, docs = jaccard.links(df)
    want_pairs, want_docs = brute_links([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(map(tuple, pairs.collect())) == want_pairs and sorted((r.doc_id, r["class"], r.n_links) for r in docs.collect()) == want_docs
