"""The pipeline's stages, one behind the other, on small tables."""

import os

import pytest
from conftest import SMALL
from llm.conftest import ODD

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")


def test_stages_one_by_one(spark):
    import corpus_pipeline
    from quern.llm import queries
    from quern.llm.common import table

    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    found = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        rows = docs.collect()
        assert all(before[r["doc_id"]] == r for r in rows), name
        found.append([r["doc_id"] for r in rows])
    good = {r["doc_id"] for r in queries.op8_quality_rules(spark, SMALL).collect() if r["kept"]}
    assert set(found[0]) == good and len(found[0]) == len(good)
    assert set(found[1]) <= set(found[0]) and len(found[1]) > 0.7 * len(found[0])
    assert len(set(found[2])) == len(found[2]) and set(found[2]) <= set(found[1])
    assert set(found[3]) <= set(found[2])
    words = lambda ids: sum(len(before[i]["text"].encode().split()) for i in ids)
    assert words(found[3]) == pytest.approx(1.5 * words(found[2]), rel=0.05)
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in coded) == sorted(found[3])
    assert all(r["n_bytes"] == len(before[r["doc_id"]]["text"].encode()) and len(r["ids"]) == 4 * r["n_tokens"] for r in coded)


def test_odd_rows_and_names_pass_all_stages(spark, docs_of):
    import corpus_pipeline

    long = [" ".join(f"w{(i * 37 + j * 101) % 997}" for j in range(60 + i)) for i in range(80)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(long)] + ODD + [(None, long[0] + " more", None, None), (500, long[3], "de", "t")]
    docs = docs_of(rows, clash=["__copies", "__key", "__h", "score", "kept", "cls", "fold", "h"]).selectExpr("*", "1 AS `a.b`", "2 AS __0")
    columns, texts = docs.columns, {r[1] for r in rows}
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SMALL).cache()
            assert now.columns == columns, name
            found = now.collect()
            assert {r["text"] for r in found} <= texts and bool(found) != empty, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, SMALL).count() == len(found)


def test_run_agrees_with_itself(spark):
    import corpus_pipeline

    one, two = (sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()) for _ in range(2))
    assert one == two and one


def test_a_cut_gives_the_garbage_of_the_driver_back(spark, monkeypatch):
    from quern.llm import common

    spark.sparkContext._jvm.System.gc()
    held = spark.sparkContext._jvm.java.lang.Object()
    there = spark.sparkContext._jvm.java.lang.ref.WeakReference(held)
    del held
    monkeypatch.setattr(common, "HEAP_PART", 0.0, raising=False)
    assert common.cut(spark.range(3)).count() == 3
    assert there.get() is None


def test_the_part_of_the_model_that_the_driver_gets_is_compressed():
    import numpy as np

    from quern.llm import kn_toxicity as kn

    keys = np.arange(50_000, dtype=np.uint64) | np.uint64(kn._ALONE << 32)
    one = np.ones(len(keys), np.int64)
    (row,) = [r for b in kn._part(kn._blobs("words", keys, (one, one, 2 * one), 1), (16, 16), (20, 20)) for r in b.to_pylist()]
    found = [kn._array(row[c], "<i8") for c in ("n0", "n1", "n")]
    assert len(found[0]) > 30_000 and (found[0] == 1).all() and (found[2] == 2).all()
    assert sum(len(row[c]) for c in ("n0", "n1", "n")) < len(found[0])
