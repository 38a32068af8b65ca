"""Mixing: targets by water filling, the flight's invariants, determinism."""

from collections import Counter

import numpy as np
import pytest
from llm.conftest import ODD

from quern.llm import cube_mixing as cube


def plain_targets(sizes, budget=1.5, most=2.0, weights=(3, 1, 2)):
    w = [weights[i % 3] for i in range(len(sizes))]
    total, capped = budget * sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: rest * w[i] / sum(w[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i] + 1e-9}
        if not over:
            return [most * s if i in capped else share[i] for i, s in enumerate(sizes)]
        capped |= over


def test_targets_share_the_excess(spark):
    rng = np.random.default_rng(1)
    sizes = {f"s{i:02d}": int(x) for i, x in enumerate(rng.integers(10, 3000, 17))} | {None: 500}
    units = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, size long, m long")
    got = {r["source"]: r["target"] for r in cube.targets(units).collect()}
    assert list(got.values()) and [got[k] for k in sizes] == pytest.approx(plain_targets(list(sizes.values())))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_a_flight_keeps_totals_and_leaves_two(n):
    rng = np.random.default_rng(n)
    p, m, s = np.full(n, 0.37), np.ones(n), rng.integers(0, 5000, n).astype(float)
    q = cube.fly(p, m, s, np.random.default_rng(0))
    assert ((q > 0) & (q < 1)).sum() <= 2 and ((q >= 0) & (q <= 1)).all()
    assert q.sum() == pytest.approx(p.sum(), abs=1e-5) and (q * s).sum() == pytest.approx((p * s).sum(), rel=1e-6, abs=1e-3)


def test_a_flight_of_equal_units_and_of_inclusion_chances():
    q = cube.fly(np.full(9, 0.5), np.ones(9), np.full(9, 7.0), np.random.default_rng(0))
    assert ((q > 0) & (q < 1)).sum() <= 1
    sizes = np.random.default_rng(1).integers(1, 100, 12).astype(float)
    mean = np.mean([cube.fly(np.full(12, 0.3), np.ones(12), sizes, np.random.default_rng(k)) for k in range(2000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(["w"] * int(k)) for k in rng.integers(1, 400, n)]


@pytest.fixture(scope="module")
def mixture(docs_of):
    rows = [(i, t, "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i, t in enumerate(texts(900, 3))]
    return rows, docs_of(rows)


def test_taken_words_come_near_their_targets(mixture):
    rows, docs = mixture
    got = {r["doc_id"]: r for r in cube.mixed(docs).collect()}
    assert len(got) == len(rows)
    for source in {r[3] for r in rows}:
        own = [got[r[0]] for r in rows if r[3] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.005)
    assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got.values())


def test_reruns_agree_whatever_the_partitions(mixture):
    docs = mixture[1]
    first = sorted(tuple(r) for r in cube.mixed(docs).collect())
    assert first == sorted(tuple(r) for r in cube.mixed(docs.repartition(7, "n_chars")).collect())


def test_blocks_meet_level_by_level(mixture, monkeypatch):
    monkeypatch.setattr(cube, "BLOCK", 16)
    got = cube.mixed(mixture[1]).collect()
    by = {}
    for r in got:
        x = by.setdefault((r["source_size"], r["target"]), [0, 0])
        x[0] += r["taken"]
    assert len(got) == 900 and all(abs(taken[0] - key[1]) < 0.02 * key[1] for key, taken in by.items())


def test_equal_rows_come_near_the_target_too(docs_of):
    rows = [(1, "one two three", "en", "s")] * 1000 + [(2, "a b c d e f g", "en", "t")] * 3001 + [(3, "x y", "en", "t")]
    docs = docs_of(rows)
    got = cube.mixed(docs).collect()
    sizes = {"s": 3000, "t": 7 * 3001 + 2}
    want = dict(zip(("s", "t"), plain_targets(list(sizes.values())), strict=True))
    for source, i in (("s", (1,)), ("t", (2, 3))):
        own = [r for r in got if r["doc_id"] in i]
        assert len(own) == sum(r[0] in i for r in rows) and all(r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[source]) <= 7
    words = Counter()
    for r in cube.take(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert words == {k: sum(r["taken"] for r in got if (r["doc_id"] == 1) == (k == "s")) for k in ("s", "t")}


def test_a_table_of_one_repeated_row(docs_of):
    got = cube.mixed(docs_of([(1, "one two three", "en", "s")] * 1000)).collect()
    assert abs(sum(r["taken"] for r in got) - 4500) <= 3 and {r["target"] for r in got} == {4500.0}


def test_rows_that_differ_in_other_columns_stay_themselves(docs_of):
    docs = docs_of([(1, "one two three", lang, "s") for lang in ("en", "de", "fr", "es")] * 5, clash=["__copies"]).selectExpr("*", "'x' AS `a.b`", "1 AS __0")
    got = cube.take(docs)
    assert got.columns == docs.columns
    seen = Counter(r["lang"] for r in got.collect())
    assert set(seen) == {"en", "de", "fr", "es"} and sum(seen.values()) == 30 and all(5 <= n <= 10 for n in seen.values())


def test_the_same_source_lands_alike_beside_a_large_one(mixture, monkeypatch):
    monkeypatch.setattr(cube, "BLOCK", 200)
    by = {}
    for r in cube.mixed(mixture[1]).collect():
        by[r["source_size"], r["target"]] = by.get((r["source_size"], r["target"]), 0) + r["taken"]
    assert all(abs(taken - key[1]) <= 5 for key, taken in by.items())


def test_rows_are_taken_as_decided(mixture):
    rows, docs = mixture
    want = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in cube.mixed(docs).collect()}
    got = {}
    taken = cube.take(docs.selectExpr("*", "'x' AS copies", "'y' AS h"))
    for r in taken.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert taken.columns == [*docs.columns, "copies", "h"] and got == {k: v for k, v in want.items() if v}


def test_odd_rows_and_empty_tables(docs_of):
    got = cube.mixed(docs_of(ODD)).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert cube.take(docs_of(ODD)).columns == docs_of(ODD).columns
    assert cube.mixed(docs_of([])).count() == 0 and cube.take(docs_of([])).count() == 0
    only_null = cube.mixed(docs_of([(1, None, "en", "s")])).first()
    assert (only_null["size"], only_null["target"], only_null["taken"]) == (0, 0.0, 0)
