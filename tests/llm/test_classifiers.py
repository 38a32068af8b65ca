"""The quality classifier and the toxicity models: held-out accuracy, exact counts, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import ODD

from quern.llm import ftrl_quality as quality
from quern.llm import kn_toxicity as toxicity

BAD = ["vile", "rotten", "horrid", "nasty"]


def corpus(n=900):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(vocabulary, 80).tolist()
        toxic, junk = i % 6 == 0, i % 5 == 0
        if toxic:
            for at in rng.integers(0, 80, 5):
                words[at] = BAD[int(rng.integers(0, 4))]
        if junk:
            words = [w + "###" if k % 2 else w for k, w in enumerate(words)]
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    docs, labels = corpus()
    more = [(10_000, 1, None), (None, 1, 1), (3, None, None)]
    return docs_of(docs, clash=["score", "predicted", "cls", "fold"]), spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("make, at, parts, held", [(quality.quality, 1, 3, 1), (toxicity.toxicity, 2, 5, 0)])
def test_held_out_documents_are_classified(tables, make, at, parts, held):
    docs, labels, truth = tables
    got = {r["doc_id"]: r for r in make(docs, labels).collect()}
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    own = [x for x in truth if zlib.crc32(str(x[0]).encode()) % parts == held]
    assert {x[0] for x in own} == {i for i, r in got.items() if r["held_out"]}
    assert np.mean([got[x[0]]["predicted"] == x[at] for x in own]) > 0.97


def test_only_ordinary_documents_stay(tables):
    docs, labels, truth = tables
    kept = toxicity.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(x[0] in ids) == (x[2] == 0) for x in truth]) > 0.97


def plain_values(rows, asked):
    """The values by the formulas, over dictionaries."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    paired = lambda t: list(zip(["^", *split(t)], split(t), strict=False))
    own = [Counter(x for t, c in rows if c == k for x in paired(t)) for k in (0, 1)]
    both = own[0] + own[1]
    single = [Counter(w for _, w in x.elements()) for x in (*own, both)]

    def order(n0, n1, n):
        total = [max(1, sum(x.values())) for x in (n0, n1, n)]
        seen = Counter(n.values())
        d = min(0.95, seen[1] / (seen[1] + 2 * seen[2])) if seen[1] else 0.5
        rest = [1 - sum(max(v - toxicity.DISCOUNT, 0) for v in x.values()) / t for x, t in zip((n0, n1), total, strict=False)]

        def ratio(x):
            s = (n[x] - d) / total[2] if n[x] else 1.0
            k = [max(y[x] - toxicity.DISCOUNT, 0) / t + r * s for y, t, r in zip((n0, n1), total, rest, strict=False)]
            p = [toxicity.SHARED * s + (1 - toxicity.SHARED) * y for y in k]
            return math.log(p[1] / p[0])

        return ratio

    words, pairs = order(*single), order(*own, both)
    out = []
    for t in asked:
        n = len(split(t))
        total = sum(map(words, split(t))) + toxicity.PAIRS * sum(pairs(x) for x in paired(t) if both[x])
        out.append(total / (n + toxicity.PRIOR) if n else None)
    return out


@pytest.mark.parametrize("slots, bits, segment", [((19, 21), (25, 27), 16_384), ((2, 3), (5, 6), 300), ((3, 2), (3, 3), 257)])
def test_values_are_those_of_a_plain_model(spark, slots, bits, segment):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["aa", "bb", "Cc", "dd", "ee", *(f"w{k}" for k in range(60))], int(rng.integers(0, 40)))) for k in range(300)]
    rows = [(t, int(k % 3 == 0)) for k, t in enumerate(texts)]
    model = toxicity.count_model(spark.createDataFrame(rows, "text string, cls int").repartition(5), 0, slots, bits)
    asked = [*texts, None, "", " ... ", "unseen", "aa unseen aa", "aa " * 50_000, "aa bb " * 3] + [f"w{k} new{k}" for k in range(600)]
    got = dict(toxicity.values(spark.createDataFrame(list(enumerate(asked)), "id long, text string").repartition(3), model, "id", most=segment).toLocalIterator())
    assert len(got) == len(asked)
    for i, value in enumerate(plain_values(rows, asked)):
        assert got[i] == pytest.approx(value, abs=1e-9) if value is not None else got[i] is None


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(3)
    n0, n1 = rng.integers(0, 9, 500), rng.integers(0, 4, 500)
    n = n0 + n1
    n0, n1, n = n0[n > 0], n1[n > 0], n[n > 0]
    over = [np.maximum(x - toxicity.DISCOUNT, 0).sum() for x in (n0, n1)]
    order = toxicity.Order(len(n), (n == 1).sum(), (n == 2).sum(), n0.sum(), n1.sum(), n.sum(), *over)
    shared = (n - order.d) / order.total
    for own, total, rest in zip((n0, n1), order.own, order.rest, strict=True):
        p = toxicity.SHARED * shared + (1 - toxicity.SHARED) * (np.maximum(own - toxicity.DISCOUNT, 0) / total + rest * shared)
        unseen = order.d * len(n) / order.total * (toxicity.SHARED + (1 - toxicity.SHARED) * rest)
        assert p.sum() + unseen == pytest.approx(1)


def test_the_curve_ascends_and_separates():
    x = np.linspace(-1, 1, 200)
    at, height = toxicity.fit_curve(x, (x > 0.3).astype(float), np.ones(200))
    assert (np.diff(at) >= 0).all() and (np.diff(height) >= 0).all() and abs(np.interp(0.3, at, height) - 0.5) < 0.45
    assert np.interp(0.2, at, height) < 0.1 and np.interp(0.4, at, height) > 0.9
    assert (toxicity.fit_curve(np.zeros(0), np.zeros(0), np.zeros(0))[1] == 0).all()


@pytest.mark.parametrize("make", [quality.quality, toxicity.toxicity])
def test_odd_rows_and_missing_labels(spark, docs_of, tables, make):
    kinds = "doc_id long, quality int, toxic int"
    docs = docs_of(ODD)
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)], kinds)
    for labels in (some, some.limit(0), spark.createDataFrame([(4, 1, 1), (6, 1, 1), (7, 1, 1)], kinds)):
        got = make(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert make(docs_of([]), some).count() == 0


def plain_weights(examples):
    """FTRL-proximal over dictionaries."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.SMOOTH + math.sqrt(n[i])) / quality.RATE + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, label in examples:
            x = {**x, "intercept": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.RATE * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_updates_follow_the_leader(spark, tables):
    docs, labels, _ = tables
    rows = quality.sample(docs, labels, max_rows=200).orderBy("hash").collect()
    assert len(rows) == 200
    examples = [(dict(zip(np.frombuffer(bytes(r["at"]), "<u4").tolist(), np.frombuffer(bytes(r["v"])).tolist(), strict=True)), r["cls"]) for r in rows]
    want = plain_weights(examples)
    w, intercept = quality.fit(docs, labels, max_rows=200)
    assert intercept == pytest.approx(want.pop("intercept")) and set(np.flatnonzero(w)) <= set(want)
    assert all(w[i] == pytest.approx(x, rel=1e-5, abs=1e-7) for i, x in want.items())


def test_scores_are_sparse_dot_products(spark, tables):
    docs, labels, _ = tables
    w, b = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    for r in docs.limit(50).collect():
        raw = b + sum(float(w[i]) * v for i, v in zip(*quality.features(r["text"]), strict=True))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-raw)))


def test_a_labelled_id_that_repeats_trains_once(spark, docs_of):
    docs, labels = corpus(60)
    other = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    many = spark.range(100_000).selectExpr("CAST(5 AS BIGINT) AS doc_id", f"'{docs[5][1]}' AS text", "'en' AS lang", "'s' AS source", "CAST(1 AS BIGINT) AS n_chars")
    once, often = quality.sample(docs_of(docs), other), quality.sample(docs_of(docs).unionByName(many), other)
    key = lambda df: sorted((r["hash"], r["cls"]) for r in df.collect())
    assert key(once) == key(often)
    own = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    different = spark.range(5000).selectExpr(f"CAST({own} AS BIGINT) AS doc_id", "CONCAT('text ', id) AS text")
    assert quality.sample(different, other.filter(f"doc_id = {own}"), max_rows=10).count() == 10


def test_large_partitions_are_counted_in_pieces(tables, monkeypatch):
    batches = tables[0].selectExpr("text", "CAST(doc_id % 2 AS INT) AS cls").toArrow().to_batches()
    total = lambda found: toxicity._summed(*toxicity._read(toxicity.pa.Table.from_batches(found), "pairs"))
    once = list(toxicity._count(iter(batches), 4))
    monkeypatch.setattr(toxicity, "HELD", 100)
    often = list(toxicity._count(iter(batches * 3), 4))
    assert len(often) > len(once) == 1
    (keys, counts), (again, more) = total(once), total(often)
    assert (again == keys).all() and all((y == 3 * x).all() for x, y in zip(counts, more, strict=True))


def test_columns_of_any_name_stay(tables):
    docs, labels, _ = tables
    odd = docs.selectExpr("*", "1 AS __0", "2 AS `a.b`", "3 AS bad")
    kept = toxicity.keep_ordinary(odd, labels)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
