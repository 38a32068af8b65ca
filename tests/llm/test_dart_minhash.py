"""Near-duplicate classes against brute force, and the signatures' estimates."""

from collections import Counter

import numpy as np
import pytest
from llm.conftest import ODD

from quern.llm import dart_minhash as mh


def plain_classes(rows, threshold=0.8):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and (x & y).total() >= threshold * (x | y).total():
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def random_text(rng, n=120):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def edited(rng, text, edits):
    words = text.split()
    for at in rng.integers(0, len(words), edits):
        words[at] = f"e{rng.integers(0, 10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    rng = np.random.default_rng(5)
    rows, passage = [], random_text(rng, 150)
    for i in range(30):
        base = random_text(rng)
        rows += [(len(rows) + k, edited(rng, base, k % 5), "en", f"s{i}") for k in range(1 + i % 6)]
    rows += [(1000 + k, passage + " " + random_text(rng, 100), "en", "p") for k in range(40)]
    return rows


@pytest.mark.parametrize("n, j", [(500, 0.8), (3, 0.5), (4000, 0.6)])
def test_agreement_estimates_jaccard(n, j):
    rng = np.random.default_rng(n)
    both = round(2 * n * j / (1 + j))
    sets = []
    for _ in range(30):
        c, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (both, n - both, n - both))
        sets += [(np.concatenate([c, a]), None), (np.concatenate([c, b]), None)]
    s = mh.signatures(sets)
    assert (s > 0).all() and abs((s[::2] == s[1::2]).mean() - both / (2 * n - both)) < 0.03


def test_weighted_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(9)
    w1 = rng.random(100) * 4
    w2 = w1 * rng.random(100)
    got = []
    for k in range(30):
        names = rng.integers(0, 2**63, 100).astype(np.uint64) + np.uint64(k)
        s = mh.signatures([(names, w1), (names, w2)])
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.03


def check(found, rows):
    classes = plain_classes(rows)
    smallest = {}
    for (i, *_), c in zip(rows, classes, strict=True):
        smallest[c] = min([x for x in (smallest.get(c), i) if x is not None], default=None)
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == sorted((i, smallest[c], classes.count(c)) for (i, *_), c in zip(rows, classes, strict=True))


def test_classes_match_brute_force(docs_of, families):
    check(mh.near_duplicates(docs_of(families)).collect(), families)


def test_one_of_each_class_stays_with_all_columns(docs_of, families):
    rows = [*families, families[0], (7777, families[1][1], None, None)]
    kept = mh.keep_one(docs_of(rows, clash=["h", "class_id", "root"]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "class_id", "root"]
    classes = plain_classes(rows)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted({min(rows[i][0] for i in range(len(rows)) if classes[i] == c) for c in classes})


def test_a_large_family_and_exact_copies_are_one_class(docs_of):
    rng = np.random.default_rng(6)
    base = random_text(rng, 300)
    rows = [(i, edited(rng, base, 3) if i % 2 else base, "en", "s") for i in range(400)]
    assert {r["class_id"] for r in mh.near_duplicates(docs_of(rows)).collect()} == {0}


@pytest.mark.parametrize("block", [mh.BLOCK, 7])
def test_a_large_family_without_its_base_matches_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(mh, "BLOCK", block)
    rng = np.random.default_rng(11)
    base = random_text(rng, 200)
    rows = [(i, edited(rng, base, 1 + i % 5), "en", "s") for i in range(500)]
    check(mh.near_duplicates(docs_of(rows)).collect(), rows)


def test_pairs_in_a_template_that_all_share_are_found(docs_of):
    rng = np.random.default_rng(12)
    template, rows = random_text(rng, 400), []
    for k in range(8):  # 0.83 within a pair, 0.78 to all others
        own = random_text(rng, 20)
        rows += [(2 * k + j, f"{template} {own} {random_text(rng, 32)}", "en", "s") for j in (0, 1)]
    classes = plain_classes(rows)
    assert len(set(classes)) == 8
    check(mh.near_duplicates(docs_of(rows)).collect(), rows)


def test_repeated_shingles_weigh(docs_of):
    rng = np.random.default_rng(13)
    line, rows = random_text(rng, 10), []
    for k, (a, b) in enumerate([(20, 25), (20, 40), (2, 30)]):
        base = random_text(rng, 20)
        rows += [(2 * k, f"{base} {' '.join([line] * a)}", "en", "s"), (2 * k + 1, f"{base} {' '.join([line] * b)}", "en", "s")]
    found = mh.near_duplicates(docs_of(rows)).collect()
    check(found, rows)
    assert len({r["class_id"] for r in found}) == 5
    assert len({r["class_id"] for r in mh.near_duplicates(docs_of(rows[2:4]), weighted=False).collect()}) == 1


def test_comparisons_of_a_hot_text_are_dealt_to_many_tasks(docs_of, families, monkeypatch):
    monkeypatch.setattr(mh, "TOGETHER", 3)
    check(mh.near_duplicates(docs_of(families)).collect(), families)


def test_columns_of_any_name_stay(docs_of, families):
    docs = docs_of([*families, families[0]], clash=["__key", "__h", "__id"]).selectExpr("*", "1 AS `a.b`", "2 AS __0")
    kept = mh.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(plain_classes(families)))


def test_odd_rows_and_empty_tables(docs_of):
    rows = [r for r in ODD if r[0] is not None]
    wordless = {1, 2, 3}
    found = mh.near_duplicates(docs_of(ODD)).collect()
    assert len(found) == len(ODD)
    check([r for r in found if r["doc_id"] is not None and r["doc_id"] not in wordless], [r for r in rows if r[0] not in wordless])
    assert all(r["class_id"] == r["doc_id"] and r["class_size"] == 1 for r in found if r["doc_id"] in wordless)
    assert len(mh.keep_one(docs_of(ODD)).collect()) == len({r[1] for r in ODD})
    assert mh.near_duplicates(docs_of([])).count() == 0 and mh.keep_one(docs_of([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"x", b"y")], "a binary, b binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in mh.components(edges).collect()}
    assert all(roots[bytes([i])] == b"\x00" for i in range(61)) and roots[b"y"] == b"x" and len(roots) == 63
