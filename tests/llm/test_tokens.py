import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import tokens


def brute(model, word):
    """The best segmentation by trying all of them."""
    full = tokens.MARK + word

    def rest(i):
        if i == len(full):
            return (0.0, 0)
        n = len(full[i].encode("utf-8", "surrogatepass"))
        s, c = rest(i + 1)
        options = [(s + n * model.byte, c - n)]
        for j in range(i + 1, len(full) + 1):
            if full[i:j] in model.score:
                s, c = rest(j)
                options.append((s + model.score[full[i:j]], c - 1))
        return max(options)

    return -rest(0)[1], rest(0)[0]


PIECES = [tokens.MARK, "a", "b", "ab", "ba", tokens.MARK + "a", tokens.MARK + "ab", "aba", "bb", "é"]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abéz", min_size=1, max_size=8), max_size=12))
def test_shared_prefixes_against_all_segmentations(words):
    model = tokens.Unigram(PIECES)
    counts = model.count_all(words)
    for w in words:
        count, score = brute(model, w)
        assert counts[w] == count or abs(score - _score(model, w)) < 1e-9


def _score(model, word):
    full, best = tokens.MARK + word, [(0.0, 0)]
    for end in range(1, len(full) + 1):
        best.append(model._extend(full, end, best))
    return best[-1][0]


def test_real_vocabulary(spark):
    model = tokens.Unigram.from_sentencepiece(tokens.vocabulary_path())
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "a" * 50_000 + " b", "x"), (-4, "日本 \u0000x", "x"), (-4, "日本 \u0000x", "x"), (None, "of", "x")], "doc_id long, text string, n_tokens string")
    rows = df.select("doc_id", "text", "lang").withColumnRenamed("lang", "n_tokens").unionByName(extra)
    got = tokens.count_tokens(rows, tokens.vocabulary_path(), remembered=2000).collect()
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    assert len(got) == len(texts)
    want = sorted((d is None, d or 0, len((t or "").split()), sum(model.count_all([w])[w] for w in (t or "").split())) for d, t in random.Random(1).sample(texts, 30) + texts[-6:])
    have = {(r.doc_id is None, r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in got}
    assert set(want) <= have


def test_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), tokens.vocabulary_path()).collect() == []
