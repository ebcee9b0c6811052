import random
import re
import time

from pyspark.sql import functions as F

from sightline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(UP))
    starts, found = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                found.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))


CASES = [
    None, "", "   ", "word", "Under the MIT License", "x under-the--MIT license. Under the mit license under the mit license",
    "CC BY-NC CC-BY-NC cc by nc 4.0", "Licensed under the Apache License, Version 2.0.", "apache license version 20",
    "éunder the mit license", "under the mit licenseé", "ccby nc", "İ under the mit license K", "under the mit license " * 300,
    "This work is licensed under the GNU General Public License, version 3.", "all rights reserved", "\x00cc\x7fby\x7fnc",
]


def test_base_against_brute_force(spark):
    rows = [(i, t, "t") for i, t in enumerate(CASES)] + [(4, CASES[4], "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect())
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=lambda r: r[:2])


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = licenses.scan(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        want = all_spans(texts[r.doc_id])
        assert [(d.start, d.stop, d.priority, d.rule, d.label) for d in r.detections] == want
        assert set(filter(None, r.labels.split(","))) == {s[4] for s in want} | set(filter(None, r.base_labels.split(",")))


def test_spans_priority_and_containment(spark):
    df = spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3. See the ISC license.")], "doc_id long, text string")
    (r,) = licenses.scan(df).collect()
    assert r.labels == "gpl-3,isc"
    assert [(d.label, d.priority) for d in r.detections] == [("gpl-3", 90), ("isc", 65)]
    assert len(licenses.rules()) > 400 and len({p for _, _, p, *_ in licenses.LICENSES} | {p for _, p, *_ in licenses.TEXTS}) > 250


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(df).collect() == []


def expansions(pattern):
    """Strings that a pattern matches: every alternative, every optional part with and without, repeats at both ends."""
    from re import _parser

    def run(items):
        out = [""]
        for op, arg in items:
            kind = str(op)
            if kind == "LITERAL":
                more = [chr(arg)]
            elif kind == "IN":
                more = ["7" if "DIGIT" in str(arg) else "x" if "WORD" in str(arg) else chr(v) for k, v in arg if str(k) == "LITERAL"] or ["7" if "DIGIT" in str(arg) else "x"]
            elif kind == "ANY":
                more = ["x"]
            elif kind == "SUBPATTERN":
                more = run(arg[3])
            elif kind == "BRANCH":
                more = [x for branch in arg[1] for x in run(branch)]
            elif kind == "MAX_REPEAT":
                low, high, inner = arg
                one = run(inner)
                more = [x * n for x in one for n in {low, max(low, min(int(high), low + 1))}]
            else:
                raise AssertionError(kind)
            out = [a + b for a in out for b in more]
        return out

    return run(_parser.parse(pattern))


def test_every_alternative_passes_gate_and_keywords(spark):
    texts = [(label, t) for label, spdx, name, _ in licenses.LICENSES for t in [*expansions(name), *("spdx license identifier " + x for x in expansions(spdx))]]
    texts += [(label, t) for label, pattern, *_ in licenses.TEXTS for t in expansions(pattern)]
    assert len(texts) > 400
    missing = []
    for i, label, keywords, pattern, *_ in licenses.rules():
        if pattern.startswith(" (?:licensed|released"):
            continue
        tried = [t for own, t in texts if own == label and re.search(pattern, f" {t} ")]
        missing += [(i, t) for t in tried if not any(a in t for a in licenses.anchors()) or not any(f" {k}" in f" {t} " for k in keywords.split("|"))]
    assert not missing
    framed = [(n, label, t if t.startswith("spdx") else f"Licensed under the {t}") for n, (label, t) in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(n, t) for n, _, t in framed], "doc_id long, text string")).collect()}
    every = licenses.rules()
    for n, label, t in framed:
        norm = " " + " ".join(WORD.findall(t.translate(UP))) + " "
        found = [(p, i) for i, _, _, pattern, p, _ in every if re.search(pattern, norm)]
        assert found and max(p for p, _ in found) in [d.priority for d in got[n].detections], (label, t)


def all_spans(text):
    """Every rule on the whole normalised text, without gate or keywords; a span inside any kept one needs a higher priority."""
    norm = " " + " ".join(WORD.findall((text or "").translate(UP))) + " "
    spans = [(m.start(), m.end(), n, i, label) for i, label, _, pattern, n, _ in licenses.rules() for m in re.finditer(pattern, norm, re.ASCII)]
    kept = []
    for s in sorted(spans, key=lambda x: (x[0], -x[1], -x[2], x[3])):
        if not any(k[0] <= s[0] and k[1] >= s[1] and k[2] >= s[2] for k in kept):
            kept.append(s)
    return kept


def test_labels_against_brute_force(spark):
    rng = random.Random(6)
    words = "the licence of this software is under terms and public domain gnu cc by nc 4 0 version 2 free general you may not use only".split()
    parts = [t for _, _, name, _ in licenses.LICENSES for t in expansions(name)[:3]] + [expansions(p)[-1] for _, p, *_ in licenses.TEXTS]
    parts += ["licensed under the", "this work is distributed under the terms of the", "see the", "SPDX-License-Identifier:", "subject to the terms of the"]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(250)]
    texts += ["permission is hereby granted x the mit license " * 40, None, ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, text in enumerate(texts):
        want = all_spans(text)
        assert [(d.start, d.stop, d.priority, d.rule, d.label) for d in got[i].detections] == want, text
        assert set(filter(None, got[i].labels.split(","))) == {s[4] for s in want} | set(filter(None, brute(text)[4].split(",")))


def test_inner_span_of_middle_priority(spark):
    """One kept span reaches further than another: the first still suppresses what lies in it."""
    spans = "array(named_struct('start', 0, 'negative_stop', -10, 'negative_priority', -90, 'rule', 1, 'label', 'a', 'sure', 1D), named_struct('start', 5, 'negative_stop', -12, 'negative_priority', -50, 'rule', 2, 'label', 'b', 'sure', 1D), named_struct('start', 6, 'negative_stop', -9, 'negative_priority', -70, 'rule', 3, 'label', 'c', 'sure', 1D))"
    (r,) = spark.range(1).select(licenses._swept(F.expr(spans)).alias("kept")).collect()
    assert [k.label for k in r.kept] == ["a", "b"]


def test_creative_commons_names_in_full(spark):
    cases = [
        ("Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
        ("under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 License", "cc-by-nc-nd"),
        ("Creative Commons Zero 1.0 Universal", "cc0-1"),
        ("Creative Commons Attribution Non-Commercial 4.0", "cc-by-nc-4"),
        ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
        ("Creative Commons Attribution-NoDerivs 3.0", "cc-by-nd"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {i: label for i, (_, label) in enumerate(cases)}


def test_many_matches_in_one_text(spark):
    """Chunks of the folds join without a seam; a text with 60,000 matches is scanned in some seconds."""
    unit = "the licence of x: Licensed under the Apache License, Version 2.0. GNU GPL v3; cc by nc 4.0, see the MIT license and more words "
    sizes = [1, 31, 32, 33, 127, 128, 129, 400]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(n, unit * n) for n in sizes], "doc_id long, text string")).collect()}
    one = all_spans(unit)
    long = len(" " + " ".join(WORD.findall(unit.translate(UP))))
    for n in sizes:
        want = [(a + i * long, b + i * long, p, rule, label) for i in range(n) for a, b, p, rule, label in one]
        assert len(one) >= 4 and [(d.start, d.stop, d.priority, d.rule, d.label) for d in got[n].detections] == want
    began = time.monotonic()
    (r,) = licenses.scan(spark.createDataFrame([(1, "under the mit license x " * 60_000)], "doc_id long, text string")).selectExpr("n_base", "size(detections) AS n").collect()
    assert (r.n_base, r.n) == (60_000, 60_000) and time.monotonic() - began < 60
