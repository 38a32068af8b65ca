"""Exact search against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import topk_search as topk


def vectors(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.4, (n, d)) * (rng.random((n, d)) < 0.5)
    v[n // 2 : n // 2 + 60] = v[0]  # ties
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


ODD = [(900, None), (920, [1.0, None]), (940, [float("nan"), 1.0]), (960, [float("inf")]), (None, [1.0] * 16), (980, []), (1000, [2.0]), (1020, [0.5] * 20), (0, [9.0] * 16), (7, [0.1] * 16)]


def plain(rows, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)  # noqa: B905
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").filter(topk.usable("embedding")).select("vec_id", topk.whole_components("embedding").alias("v"))
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") % 20 == 0, k, vector="v").collect())


def test_search_with_odd_rows_and_ties(spark):
    rows = vectors() + ODD
    assert search(spark, rows) == plain(rows)


def test_search_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    rows = vectors(300, 8, 1)
    assert search(spark, rows, 5) == plain(rows, 5)


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0]), (1, [2.0]), (20, [1.0])]
    assert search(spark, rows) == plain(rows)
    assert search(spark, [(0, [1.0])]) == [] and search(spark, []) == []


@pytest.mark.parametrize("scale", [1, 10**4, 10**7])
def test_accumulation_is_the_exact_product(scale):
    rng = np.random.default_rng(2)
    q = rng.integers(-90, 90, (9, 30)) * (rng.random((9, 30)) < 0.3) * scale
    c = rng.integers(-90, 90, (200, 30)) * (rng.random((200, 30)) < np.linspace(0, 1, 30)) * scale
    q[:, 7], c[:, 7] = 5, 3
    lists = lambda m: topk.postings(pa.chunked_array([pa.array(m.tolist(), pa.list_(pa.int64()))]))
    assert (topk.accumulate(*lists(q), len(q), topk.Index(*lists(c), len(c))) == q.dot(c.T)).all()


def test_very_long_vectors(spark):
    rng = np.random.default_rng(4)
    long = lambda n: [(i, float(x)) for i, x in zip(sorted(rng.choice(1_000_000, n, replace=False).tolist()), rng.normal(0, 1, n), strict=True)]
    rows = vectors(100, 8, 3)
    for i, pairs in ((500, long(2000)), (501, long(300_000))):
        v = np.zeros(1_000_000)
        v[[p for p, _ in pairs]] = [x for _, x in pairs]
        rows.append((i, v.tolist()))
    assert search(spark, rows, 3) == plain(rows, 3)


def test_sums_beyond_64_bits_are_an_error(spark):
    for value in (1e30, 1e8 * 2.0**10):
        with pytest.raises(Exception, match="beyond 64 bits"):
            search(spark, [(0, [value] * 200), (1, [value] * 200)])


def test_other_columns_dont_matter(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], "x", "y", "z") for i in range(50)], "vec_id long, embedding array<double>, q string, id string, `a.b` string")
    got = topk.search(rows.withColumn("embedding", topk.whole_components("embedding")), F.col("vec_id") % 20 == 0, 3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 9
