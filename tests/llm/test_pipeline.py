import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import quality
from sightline.llm.common import written

from .test_jaccard import brute as components
from .test_suffixes import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["quality", "near_duplicates", "repeats", "decontamination", "packing"]

    kept = written(by["quality"](spark, docs, SF))
    assert kept.columns == docs.columns
    judged = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged.collect() if r.keep)

    once = written(by["near_duplicates"](spark, kept, SF))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i, _, c in components(rows) if i == c)

    cut = written(by["repeats"](spark, once, SF))
    want = {i: (n, gone) for _, i, n, gone, *_ in repeats([(r.doc_id, r.text) for r in once.collect()])}
    assert {r.doc_id for r in cut.collect()} == {i for i, (n, gone) in want.items() if n > gone or not gone}
    for r in cut.collect():
        n, gone = want[r.doc_id]
        assert r.n_chars == len(r.text) and 0 <= n - gone - len(r.text.encode()) <= 6 * max(1, gone)

    clean = written(by["decontamination"](spark, cut, SF))
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [norm(t) for t in benchmark]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect() if not any(t in norm(r.text) for t in items)}

    packed = by["packing"](spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated ids with equal and different texts, and columns with clashing names."""
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."
    a, b, c, passage = prose(80), prose(90), prose(70), prose(60)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, prose(50)), (4, c), (4, c), (4, c + " z"), (5, None), (6, ""), (None, a), (None, None), (7, prose(20_000)), (8, passage + prose(40)), (9, prose(30) + passage), (9, prose(45)), (9, prose(20) + passage + prose(9)), (10, "one two")]
    full = [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else "s", None if n % 3 == 0 or t is None else len(t), n, f"k{n}", float(n), n % 2 == 0, b"x") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, evidence double, keep boolean, digest binary"), rows


def test_stages_with_odd_rows_and_clashing_columns(spark):
    docs, rows = odd_documents(spark)
    by = dict(corpus_pipeline.STAGES)
    names = docs.columns
    for name in ("quality", "near_duplicates", "repeats", "decontamination"):
        out = by[name](spark, docs, SF)
        assert out.columns == names and out.schema == docs.schema
        kept = out.collect()
        carried = {r.id: r for r in docs.collect()}
        assert len({r.id for r in kept}) == len(kept)
        for r in kept:  # what is carried along is untouched, and so is the text but for repeats
            assert [r[c] for c in names if c not in ("text", "n_chars")] == [carried[r.id][c] for c in names if c not in ("text", "n_chars")]
            assert name == "repeats" or (r.text, r.n_chars) == (carried[r.id].text, carried[r.id].n_chars)
        stayed = {r.id for r in kept}
        if name == "near_duplicates":
            numbered = [(n, t) for n, (i, t) in enumerate(rows) if i is not None]
            groups = {}
            for n, _, c in components(numbered):
                groups.setdefault(c, []).append(n)
            for members in groups.values():
                least = min(rows[n][0] for n in members)
                left = [n for n in members if n in stayed]
                assert len(left) == 1 and rows[left[0]][0] == least, members
            assert {n for n, (i, _) in enumerate(rows) if i is None} <= stayed
        elif name == "repeats":
            gone = {}
            for n, (i, t) in enumerate(rows):
                for _, j, size, removed, *_ in repeats([(k, x) for m, (k, x) in enumerate(rows) if m == n or (k is not None and i is not None and k < i)]):
                    if j == (i or 0) and size == len((t or "").encode()):
                        gone[n] = removed
            for n, (_, t) in enumerate(rows):
                size = len((t or "").encode())
                assert (n in stayed) == (not gone[n] or gone[n] < size)
            assert all(len(r.text or "") == len(rows[r.id][1] or "") - gone[r.id] for r in kept)
        else:
            assert name != "decontamination" or stayed == set(range(len(rows)))
    assert by["packing"](spark, docs, SF).groupBy("doc_id").count().count() == 11


def test_no_labels_and_no_benchmark(spark, tmp_path):
    docs, rows = odd_documents(spark)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    by = dict(corpus_pipeline.STAGES)
    for name in ("quality", "decontamination"):
        assert by[name](spark, docs, f"file://{tmp_path}").count() == len(rows)


def test_every_decision_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() < docs.where(F.col("doc_id").isNotNull()).count()
