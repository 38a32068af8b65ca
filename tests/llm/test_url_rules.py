"""URL judgements against plain versions."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import url_rules as rules
from quern.llm.queries import URL_RULES

URLS = [
    "https://a.example.net/en/1", "https://a.example.net/de/1", "http://EXAMPLE.com/de/x?y#z", "http://notexample.com/de/", "https://b.org/fr/", "https://b.org/fr", "https://b.org/FR/", "ftp://x.net", "x://net/", "x://sub.net/p",
    "no scheme example.net/en/", "", None, "http://", "http://?q", "http://Ünet.NET/Ä", "a://b://net/", "http://h.org\n/fr/", "http://" + "a" * 5000 + ".net/en/", "http://example.net/en/#f",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i if i != 3 else None, u, "old", "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, mined string")


@pytest.fixture(scope="module")
def no_rules(spark):
    return spark.createDataFrame([], "rule_id long, items array<array<string>>, confidence double, support double")


def test_fixed_rules(pages, no_rules):
    got = rules.judge(pages, no_rules, URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = plain(r["url"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), r["url"]


def test_without_fixed_rules_and_empty_tables(pages, no_rules):
    assert {r["verdict"] for r in rules.judge(pages, no_rules, []).collect()} == {"allow"}
    assert rules.judge(pages.limit(0), no_rules, URL_RULES).count() == 0
    labels = pages.sparkSession.createDataFrame([], "doc_id long, quality int")
    assert rules.mine(pages, labels, F.col("quality") == 0).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, f"http://{'spam' if bad else 'good'}{i % 3}.example.org/{'win' if bad or i % 5 == 0 else 'news'}/{i}?{'ref=1' if i % 2 else 'q=2'}"))
        labels.append((i, 0 if bad else 1) if i % 50 else (i, None))
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_mined_rules_are_those_of_brute_force(labelled):
    pages, labels = labelled
    found = rules.mine(pages, labels, F.col("quality") == 0, support=0.01, confidence=0.6, least_rows=5).collect()
    mined = {tuple(sorted(x)): r["confidence"] for r in found for x in itertools.product(*r["items"])}
    label = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    rows = [(set(r["t"]), label[r["page_id"]] == 0) for r in pages.select("page_id", rules.tokens("url").alias("t")).collect() if r["page_id"] in label]
    counts = {}
    for items, bad in rows:
        for k in range(1, len(items) + 1):
            for c in itertools.combinations(sorted(items), k):
                n = counts.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += bad
    least = max(0.01 * len(rows), 5)
    sure = {c: b / n for c, (n, b) in counts.items() if b >= least and b / n >= 0.6}
    want = {c: p for c, p in sure.items() if not any(set(o) < set(c) and q >= p for o, q in sure.items())}
    assert want and mined == pytest.approx(want)


def test_mined_rules_fit_by_containment(labelled):
    pages, labels = labelled
    mined = rules.mine(pages, labels, F.col("quality") == 0, support=0.01, confidence=0.6, least_rows=5)
    sets = [set(x) for r in mined.collect() for x in itertools.product(*r["items"])]
    own = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", rules.tokens("url").alias("t")).collect()}
    for r in rules.judge(pages, mined, []).collect():
        assert (r["verdict"] == "block") == any(s <= own[r["page_id"]] for s in sets)


def test_many_equal_deep_urls_make_one_rule(spark):
    deep = "http://a.b.example.org/" + "/".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    pages = spark.createDataFrame([(i, deep if i < 40 else f"http://good.example.com/{chr(97 + i % 26)}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 40 else 1) for i in range(400)], "doc_id long, quality int")
    mined = rules.mine(pages, labels, F.col("quality") == 0)
    rows = mined.collect()
    assert len(rows) == 1 and len(rows[0]["items"]) == 1 and len(rows[0]["items"][0]) > 40 and rows[0]["support"] == pytest.approx(0.1)
    got = rules.judge(pages, mined, [])
    assert {r["page_id"] for r in got.filter("verdict = 'block'").collect()} == set(range(40))


def test_the_plan_has_no_python(labelled):
    pages, labels = labelled
    plan = rules.judge(pages, rules.mine(pages, labels, F.col("quality") == 0, least_rows=5), URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
