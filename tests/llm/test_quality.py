import math

import numpy as np

from sightline.llm import quality


def test_held_out_accuracy_and_clean_documents_stay(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitting, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.classify(d.select("doc_id", "text", "source", "lang"), fitting).drop("text").join(held, "doc_id").toPandas()
    good = got[got.quality == 1]
    assert good.keep.mean() > 0.99
    assert (got.keep == (got.quality == 1)).mean() > 0.97


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None, "a"), (2, "", "s", "en", "b"), (2, "", "s", "en", "b"), (None, "word " * 50_000, "s", None, "c"), (3, "good words here", "s", "en", "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    got = quality.classify(d, labels)
    assert got.columns[:5] == d.columns and len(got.columns) == len(set(got.columns))
    assert got.count() == 5
    joined = quality.classify(d, labels, few_sites=0)
    assert sorted(map(str, joined.collect())) == sorted(map(str, got.collect()))
    none = quality.classify(d, labels.limit(0)).collect()
    assert all(r.keep for r in none)
    assert quality.classify(d.limit(0), labels).collect() == []


def test_labels_of_one_kind_and_repeated_ids(spark):
    rows = [(i, f"words of text {i} here", "s", "en") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for kind in (0, 1):
        labels = spark.createDataFrame([(i, kind) for i in range(30)], "doc_id long, quality int")
        assert {r.keep for r in quality.classify(d, labels).collect()} == {bool(kind)}
    # one id on most rows: the bound on labelled rows must not leave one kind of label out
    many = spark.createDataFrame([(1, f"GOOD {i} line", "s", "en") for i in range(200)] + [(2, f"bad! {i} ###", "s", "en") for i in range(200)], d.schema)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = quality.classify(many, labels, sample=100).collect()
    assert sum(r.keep == (r.doc_id == 1) for r in got) > 390


def test_posteriors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{i % 7 if i % 3 else 0}", f"p{i % 4}", float(rng.random())) for i in range(500)]
    got = {r.site: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    mean = np.mean([r[2] for r in rows])
    by_host, by_path = {}, {}
    for h, p, v in rows:
        by_host.setdefault(h, []).append(v)
        by_path.setdefault((h, p), []).append(v)

    def strength(groups):
        w = sum(len(v) for v, _ in groups)
        between = sum(len(v) * (np.mean(v) - m) ** 2 for v, m in groups) / w
        within = sum(m * (1 - m) for _, m in groups) / w
        centre = sum(len(v) * m * (1 - m) for v, m in groups) / w
        return min(max(centre / max(between - within, 1e-6) - 1, 1.0), 1e6)

    k1 = strength([(v, mean) for v in by_host.values()])
    k2 = strength([(v, np.mean(by_host[h])) for (h, _), v in by_path.items()])
    for (h, p), v in by_path.items():
        host = (sum(by_host[h]) + k1 * mean) / (len(by_host[h]) + k1)
        path = (sum(v) + k2 * host) / (len(v) + k2)
        r = got[f"{len(h)}:{h}{p}"]
        assert math.isclose(r.host_posterior, host, rel_tol=1e-6) and math.isclose(r.path_posterior, path, rel_tol=1e-6)
