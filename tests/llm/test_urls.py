import duckdb
import numpy as np

from sightline.llm import urls
from sightline.llm.boosting import Boosted


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


CASES = [None, "", "no scheme", "http://Example.COM/en/x", "http://www.example.com/en/?q", "http://a.b.net/es/1", "http://net/fr/", "http://com", "http://com/", "HTTP://X.com?a/b", "http://notexample.com/en/", "http:///en/", "a://b://c/d", "http://É.NET/es/", "http://x.net/fr#/", "http://x.org/" + "a1" * 5000, "http://a\nb.com/\nx"]


def test_rules_against_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(CASES)] + [(3, CASES[3], "x"), (None, CASES[3], "x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, best = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


RULES_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, name, start) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, verdict, name || start AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(name || start) DESC) AS place
  FROM named JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
)
SELECT page_id, host, path, rule, verdict FROM named LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)
"""


def test_whole_table_against_sql(spark):
    want = {r[0]: r[1:] for r in duckdb.sql(RULES_SQL.replace("FROM pages", "FROM '/root/testdata/sf0.1/pages.parquet'")).fetchall()}
    got = urls.op5_urls(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict == ("block" if r.block_probability >= 0.5 else "allow")


def test_empty_table_and_no_labels(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    (r,) = urls.judge(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")).collect()
    assert (r.verdict, r.rule, r.block_probability) == ("allow", None, 0.0)


def test_few_and_many_suffixes_give_the_same(spark):
    rows = [(i, f"http://h{i}.s{i % 40 if i % 3 else 0}/a{i}", i % 2) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, suffix int")
    labels = pages.select("url", pages.suffix.alias("label"))
    few, many = (sorted(map(str, urls.judge(pages, labels=labels, few_suffixes=n).collect())) for n in (50_000, 3))
    assert few == many and len(few) == 300


def test_trees_learn_held_out_labels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    p = Boosted(rounds=80, depth=4).fit(x[:3000], y[:3000]).probability(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.9


def test_held_out_urls(spark):
    bad = [f"http://free{i}-{i * 7}-win.biz{i % 3}.org/a{i}?x={i}&y={i}&z={i}" for i in range(300)]
    good = [f"http://www.site{chr(97 + i % 20)}.org/about/{chr(97 + i % 7) * 4}" for i in range(300)]
    labels = spark.createDataFrame([(u, 1) for u in bad[:200]] + [(u, 0) for u in good[:200]], "url string, label int")
    pages = spark.createDataFrame(list(enumerate(bad[200:] + good[200:])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels=labels).collect()}
    assert sum(got[i] == ("block" if i < 100 else "allow") for i in got) >= 195
