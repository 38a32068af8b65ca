"""Hand-made cases and invariants of the engine's operators."""

import math
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import code, text, tokens
from quern.operators import advantages, batch, importance, losses, metrics, partition, sampling, tasks


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("a", 0, 1.0, 3), ("a", 1, 3.0, 1), ("b", 2, 2.0, 5), ("c", 3, 4.0, 2), ("c", 4, 4.0, 2), ("c", 5, 4.0, 0)]
    return spark.createDataFrame(rows, "uid string, sample_idx int, score double, response_length int")


def adv(df, key="sample_idx"):
    return [r["advantage"] for r in df.orderBy(key).collect()]


def test_grpo_groups_of_one_two_and_equal_scores(groups):
    assert adv(advantages.grpo(groups)) == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2), 2.0, 0, 0, 0], abs=1e-5)


def test_loop_and_vectorised_rloo_differ_only_for_singles(groups):
    loop, fast = adv(advantages.rloo(groups)), adv(advantages.rloo_vectorized(groups))
    assert loop == pytest.approx([-2, 2, 2, 0, 0, 0]) and fast == pytest.approx([-2, 2, 0, 0, 0, 0])


def test_passk_raises_for_a_single_response(groups):
    with pytest.raises(PySparkException):
        advantages.grpo_passk(groups).collect()


def test_opo_weighs_by_length(groups):
    assert adv(advantages.opo(groups))[:3] == pytest.approx([1 - 1.5, 3 - 1.5, 2.0])


def test_estimator_names_are_unique():
    with pytest.raises(ValueError):
        advantages.register("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        advantages.estimator("none")


def test_gae_passes_masked_places_on(spark):
    rows = [(1, 0, 1, 0.0, 0.5), (1, 1, 0, 9.0, 9.0), (1, 2, 1, 1.0, 0.25)]
    df = spark.createDataFrame(rows, "seq long, pos int, mask int, reward double, value double")
    got = {r["pos"]: r["advantage"] for r in advantages.gae(df, 0.9, 0.8).collect()}
    last = 1.0 - 0.25
    assert got == pytest.approx({2: last, 1: last, 0: 0.9 * 0.25 - 0.5 + 0.9 * 0.8 * last})


def test_whitened_values_have_mean_zero_and_unit_variance(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x), 1) for x in rng.normal(3, 2, 200)] + [(1e6, 0)], "x double, mask int")
    got = np.array([r["w"] for r in advantages.masked_whiten(df, "x", "w").filter("mask = 1").collect()])
    assert abs(got.mean()) < 1e-9 and abs(got.std(ddof=1) - 1) < 1e-6


def test_importance_weights_never_exceed_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i // 10), int(i % 10), int(rng.random() < 0.8), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(-1, 1, (200, 2)))]
    df = spark.createDataFrame(rows, "seq long, pos int, mask int, old_logp double, rollout_logp double")
    for level in ("token", "sequence", "geometric"):
        top = importance.importance_weights(df, 2.0, level, veto=None).agg(F.max("is_weight")).first()[0]
        assert top <= 2.0
    with pytest.raises(ValueError):
        importance.importance_weights(df, 2.0, "word")


def test_named_reduction_follows_substrings(spark):
    df = spark.createDataFrame([("loss", 1.0), ("loss", 3.0), ("max_x", 1.0), ("max_x", 5.0), ("minibatch/y", 2.0), ("minibatch/y", 4.0)], "name string, value double")
    assert dict(metrics.reduce_named(df).collect()) == {"loss": 2.0, "max_x": 5.0, "minibatch/y": 2.0}


def test_majority_takes_the_first_seen_of_equal_votes(spark):
    df = spark.createDataFrame([("q", 0, "b", 0.1), ("q", 1, "a", 0.9), ("q", 2, "a", 0.7), ("q", 3, "b", 0.3)], "uid string, i int, pred string, v double")
    r = metrics.majority(df, ["uid"], "pred", "v", "i").first()
    assert (r["pred"], r["n"], r["value"]) == ("b", 2, 0.1)


def test_exact_extremes_agree_with_the_bootstrap(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("q", i, float(x)) for i, x in enumerate(rng.random(12))], "uid string, i int, v double")
    boot = metrics.bootstrap(df, ["uid"], "v", "i", 4, times=20_000).first()
    best = metrics.expected_extreme(df, ["uid"], "v", [4]).first()["expected"]
    worst = metrics.expected_extreme(df, ["uid"], "v", [4], worst=True).first()["expected"]
    assert boot["best_mean"] == pytest.approx(best, abs=0.01) and boot["worst_mean"] == pytest.approx(worst, abs=0.01)


@pytest.fixture(scope="module")
def numbered(spark):
    return spark.range(10).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("x"))


def xs(df):
    return [r["x"] for r in df.orderBy("pos").collect()]


def test_batch_algebra_identities(numbered):
    assert xs(batch.take_slice(batch.repeat(numbered, 2), 0, None, 2)) == xs(numbered)
    assert xs(batch.unpad(batch.pad_to_divisor(numbered, 4))) == xs(numbered)
    assert xs(batch.pad_to_divisor(numbered, 4)) == [*range(0, 100, 10), 0, 10]
    assert xs(batch.union_columns(numbered, numbered)) == xs(numbered)
    assert xs(batch.unfold(batch.fold(numbered, 3, ["x"]), 3, ["x"])) == xs(numbered)
    assert xs(batch.pad_boundary(numbered, 2, first=True))[-2:] == [0, 0]


def test_padding_wraps_more_than_once(spark):
    two = spark.createDataFrame([(0, 7), (1, 8)], "pos long, x long")
    assert xs(batch.pad_to_divisor(two, 5)) == [7, 8, 7, 8, 7]


def test_batch_errors(numbered):
    with pytest.raises(ValueError):
        batch.pop(numbered, "none")
    with pytest.raises(ValueError):
        batch.rename(numbered, ["x"], ["y", "z"])
    with pytest.raises(PySparkException):
        batch.chunk(numbered, 3).collect()
    with pytest.raises(PySparkException):
        batch.union_columns(numbered, numbered.withColumn("x", F.col("x") + 1)).collect()
    with pytest.raises(ValueError):
        batch.concat([numbered, numbered.drop("x")])


def test_partitions_cover_and_balance():
    rng = np.random.default_rng(3)
    costs = rng.integers(1, 1000, 200).astype(float).tolist()
    for equal in (False, True):
        parts = partition.differencing(costs, 8, equal)
        sums = np.bincount(parts, costs, 8)
        assert sums.max() - sums.min() < 0.02 * sums.mean()
        if equal:
            assert set(np.bincount(parts)) == {25}
    assert set(partition.least_loaded(costs, 8)) == set(range(8))
    with pytest.raises(ValueError):
        partition.differencing([1.0], 2)
    assert partition.micro_batch_count(10, 1000, 300, divisor=4) == 4


def test_loss_modes_are_checked(spark):
    df = spark.createDataFrame([(1, 0, 1, 2.0)], "seq long, pos int, mask int, x double")
    with pytest.raises(ValueError):
        losses.aggregate_loss(df, F.col("x"), "mean")
    with pytest.raises(ValueError):
        losses.kl("full")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_response_mask_ends_with_the_first_stop(spark):
    assert one(spark, tokens.until_stop(F.array(*map(F.lit, [5, 9, 2, 7, 1])), [2, 1])) == [1, 1, 1, 0, 0]
    assert one(spark, tokens.until_stop(F.array(*map(F.lit, [5, 9])), [2])) == [1, 1]


def test_truncations(spark):
    a = F.array(*map(F.lit, range(7)))
    assert one(spark, tokens.truncate(a, 5, "middle")) == [0, 1, 4, 5, 6]
    assert one(spark, tokens.truncate(a, 3, "left")) == [4, 5, 6]
    with pytest.raises(PySparkException):
        one(spark, tokens.truncate(a, 3, "error"))


def test_ragged_rows_with_an_empty_response_mark_nothing(spark):
    r = one(spark, tokens.ragged(F.array(*map(F.lit, [0, 4, 5])), F.array(*map(F.lit, [0, 1, 1])), F.lit(0)))
    assert (r["input_ids"], r["position_ids"], r["loss_mask"]) == ([4, 5], [0, 1], [0, 0])


@pytest.mark.parametrize(
    "said, found",
    [("Answer: 1,000 dollars", "1000"), ("x\nAnswer: x = $\\frac12$", "\\frac{1}{2}"), ("Answer: \\sqrt3", "\\sqrt{3}"), ("Answer: \\boxed{7}", "7"), ("no", "[INVALID]"), ("Answer: 1\nAnswer: \\text{two}", "two")],
)
def test_final_answers(spark, said, found):
    assert one(spark, text.dapo_answer(F.lit(said))) == found


@pytest.mark.parametrize("said, found", [(r"a \boxed{1} b \boxed{\frac{1}{2}} c", r"\boxed{\frac{1}{2}}"), (r"\boxed{1", None), ("none", None), (r"\fbox{x}", r"\fbox{x}")])
def test_last_boxed_matches_braces(spark, said, found):
    assert one(spark, text.last_boxed(F.lit(said))) == found


def test_answers_and_formats(spark):
    assert one(spark, text.format_ok(F.lit("a</think>\n<answer>b</answer>"))) == 1.0
    assert one(spark, text.format_ok(F.lit("<answer>b</answer>"))) == 0.0
    assert one(spark, text.extract_answer(F.lit("# Output: 5"), F.lit("code_out"))) == "5"
    assert one(spark, text.extract_answer(F.lit("<think>x</think>the input is 7."), F.lit("code_in"))) == "7"
    with pytest.raises(PySparkException):
        one(spark, text.extract_answer(F.lit("x"), F.lit("other")))
    assert one(spark, text.compare_output(F.lit("1.0 2"), F.lit("1 2.0000001"))) == "numbers"


def test_snippets():
    assert code.execute("def f(x):\n    return x + 1", ["f(1)", "f('a')"])[0] == (True, "2")
    assert not code.execute("while True: pass", ["1"], seconds=1)[0][0]
    assert not code.execute("x = input()", ["x"])[0][0]
    assert not code.deterministic("import random\ndef f(): return random.random()", "")[0]
    assert code.input_right("def f(x): return x * 2", "4", ["2", "3", "))", "1 + 1"]) == [True, False, False, True]
    assert code.has_banned("import os.path", ["os"]) and not code.has_banned("x = 'os'", ["os"]) and code.has_banned("import os.path as p", ["os.path"], strict=True)
    assert code.has_banned("def f(:", ["f"]) and code.has_banned("assert x", [], ["assert"])
    assert code.redefines("def g(): pass", ["g"]) and not code.redefines("x = 1", ["g"])


def test_rewrites():
    assert code.without_comments('def f():\n    """d"""\n    return 1  # c') == "def f():\n    return 1"
    assert code.definitions_only("import os\nx = 1\ndef f(): return 2").startswith("import os\ndef f():")
    assert code.rename_entry("def g(x): return g(x) + gg(x)") == "def f(x): return f(x) + gg(x)"
    assert code.parse_task("no code") is None
    two = "```python\ndef a(): pass\ndef b(): pass\n```"
    assert code.parse_task(two, False, False) is None and code.parse_task(two, False, False, single=False)["code"].count("def f") == 1


def test_literals():
    assert code.same_literals("[1, 2]", "(1, 2)") and code.same_literals("{1, 2}", "{2, 1}") and not code.same_literals("1", "2") and code.same_literals("abc", " abc")
    assert code.truth("[1, True]") and not code.truth("[1, 0]") and code.truth("Yes") and not code.truth("maybe")


def test_tasks_filters(spark):
    rows = [(1, "code_in", "c", None, "i", "o", None, None, 0.5), (2, "code_func", None, "p", None, None, ["1"], ["2"], 0.1), (3, None, "c", "p", "i", "o", None, None, None), (4, "code_out", "", None, "i", None, None, None, 0.9)]
    df = spark.createDataFrame(rows, "task_id long, task_type string, code string, problem string, input string, output string, inputs array<string>, outputs array<string>, difficulty double")
    valid, invalid = tasks.split_proposals(df)
    assert {r.task_id for r in valid.collect()} == {1, 2} and {r.task_id for r in invalid.collect()} == {4}
    assert {r.task_id for r in tasks.clean(df).collect()} == {1, 2, 3}
    levels = {r.task_id: r.l for r in df.select("task_id", sampling.level("difficulty").alias("l")).collect()}
    assert levels == {1: "medium", 2: "easy", 3: None, 4: "hard"}


@pytest.mark.parametrize(
    "given, gold, right",
    [("1,000", "1000", True), ("50%", "0.5", True), ("(1, 2)", "(1,2)", True), ("[1,2]", "(1,2)", False), ("3.7", "4", False), ("\\frac{1}{2}", "0.5", True), ("2 cm", "2", True), (None, "1", False), ("", "1", False), ("3.14159", "3.1416", True), ("1/2", "2/4", False)],
)
def test_grades(spark, given, gold, right):
    from quern.functions import mathgrade

    assert one(spark, mathgrade.grade(F.lit(given).cast("string"), F.lit(gold))) is right


def test_case_scoring():
    from quern.functions import rewards

    assert rewards.run_cases("def f(a, b):\n    return a + b", ["1\n2", "3\n4"], ["3", "8"], "f") == [1, 0]
    assert rewards.run_cases("print(sum(map(int, input().split())))", ["1 2", "x"], ["3\n", "0"], None) == [1, -1]
    assert rewards.run_cases("def f(:", ["1"], ["1"], "f") == [-2]
    assert rewards.run_cases("import sys\nprint(sys.stdin.read(), end='')", ["1.0 2"], ["1 2.0000001"], None) == [1]


def test_registries_refuse_second_functions():
    from quern.functions import rewards
    from quern.sources import readers

    for register in (rewards.register_scorer("math"), rewards.register_manager("dapo"), readers.register("parquet"), losses.register("gspo")):
        with pytest.raises(ValueError):
            register(lambda *_: None)
    for get in (rewards.scorer, rewards.manager, readers.reader, losses.policy_loss):
        with pytest.raises(ValueError):
            get("none")


def test_scorers_from_files(spark, tmp_path):
    from quern.functions import rewards

    (tmp_path / "own.py").write_text("def score(responses, golds, bonus=0.0):\n    return (responses == golds) + bonus\n")
    own = rewards.load_scorer(str(tmp_path / "own.py"), "score", bonus=0.5, unknown=1)
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "r string, g string")
    assert sorted(r["s"] for r in df.select(own(F.col("r"), F.col("g")).alias("s")).collect()) == [0.5, 1.5]


def test_readers(spark, tmp_path):
    from quern.sources import readers

    made = []
    table = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.staged(spark, str(tmp_path / "t"), table).count() == 3
    assert made == [1]
    assert readers.json_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.json_lines(spark, str(tmp_path / "none"), skip_missing=False)
    with pytest.raises(NotImplementedError):
        readers.reader("taco")(spark, "")


def test_a_stream_without_a_full_batch_gives_up(spark, tmp_path):
    from quern.streaming.accumulate import GroupAccumulator

    own = GroupAccumulator(str(tmp_path / "a"), batch=3, most=3)
    rows = lambda uid, k: spark.createDataFrame([(f"{uid}", k, 0.0), (f"{uid}", k + 1, 1.0)], "uid string, event_id long, acc double")
    own(rows("a", 0), 0)
    own(rows("b", 2), 1)
    own(rows("b", 2), 1)  # a retried epoch sees the same state
    own(rows("c", 4), 2)
    assert {r["uid"] for r in spark.read.parquet(str(tmp_path / "a" / "batches")).collect()} == {"a", "b", "c"}
    for k in (3, 4):
        own(rows("d", 10), k)
    with pytest.raises(RuntimeError):
        own(rows("d", 12), 5)


def test_an_instance_of_everything_runs_on_empty_frames(spark):
    rollouts = spark.createDataFrame([], "uid string, sample_idx int, score double, acc double, response_length int, pred int, task_type string, data_source string, event_id long, prompt_length int")
    for f in (advantages.grpo, advantages.rloo, advantages.opo, advantages.gpg, advantages.grpo_vectorized):
        assert f(rollouts).count() == 0
    assert sampling.informative(rollouts, "acc").count() == 0 and metrics.per_task_metrics(rollouts).count() == 0
    assert metrics.validation_report(rollouts, ["acc"]).count() == 0 and metrics.majority(rollouts, ["uid"], "pred", "acc", "sample_idx").count() == 0
    toks = spark.createDataFrame([], "seq long, pos int, mask int, reward double, value double, old_logp double, new_logp double, ref_logp double, rollout_logp double, adv double")
    assert advantages.gae(toks).count() == 0 and importance.importance_weights(toks, 2.0).count() == 0
    assert losses.vanilla(toks).count() == 1 and importance.mismatch_metrics(toks).count() == 1
    empty = spark.createDataFrame([], "pos long, x long")
    for made in (batch.repeat(empty, 2), batch.pad_to_divisor(empty, 3), batch.positions(empty.drop("pos"), "x"), batch.union_columns(empty, empty), batch.chunk(empty, 2)):
        assert made.count() == 0


def plain_differencing(costs, k):
    """Merged states carry their members."""
    states = [(c, n, sorted([(c, [i]), *[(0.0, [])] * (k - 1)], key=lambda x: -x[0])) for n, (c, i) in enumerate(sorted((c, i) for i, c in enumerate(costs)))]
    for n in range(len(states), 2 * len(states) - 1):
        (_, _, a), (_, _, b), *states = sorted(states, key=lambda x: (x[2][-1][0] - x[2][0][0], x[1]))
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)), key=lambda x: -x[0])
        states.append((None, n, parts))
    return [next(p for p, (_, m) in enumerate(states[0][2]) if i in m) for i in range(len(costs))]


@pytest.mark.parametrize("kind", ["few", "many", "negative", "rounded"])
def test_differencing_is_that_of_the_plain_version(kind):
    rng = np.random.default_rng(3)
    for n in (3, 8, 70, 120):
        costs = {"few": rng.integers(0, 4, n), "many": rng.random(n), "negative": rng.integers(-3, 3, n), "rounded": rng.random(n).round(1)}[kind].astype(float).tolist()
        for k in (1, 2, 3):
            assert partition.differencing(costs, k) == plain_differencing(costs, k)


def test_differencing_takes_time_about_linear_in_the_costs():
    n = np.random.default_rng(4).integers(0, 100, 300_000)
    costs = 24576.0 * n + n * n
    began = time.process_time()
    part = partition.differencing(costs.tolist(), 8)
    assert time.process_time() - began < 15
    assert np.ptp(np.bincount(part, costs, 8)) <= costs.max() and len(part) == len(costs)


def test_the_balanced_query_takes_every_event(spark, tmp_path):
    from quern.plans import shapes

    events = spark.range(400).selectExpr("id + 100000 AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id AS user_id", "concat('t', id % 2) AS event_type", "1.0D AS value", """'{"k": 7}' AS props""")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = shapes.balanced_partitions(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("t0", 8, True), ("t1", 8, True)]


@pytest.mark.parametrize("n", [3, 4, 11])
def test_the_chunk_query_takes_any_number_of_rows(spark, tmp_path, n):
    from quern.plans import shapes

    spark.range(n).selectExpr("id * 3 AS vec_id", "array(1.0F) AS embedding", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = shapes.chunk(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(3 * i, i // (n // 4) if n >= 4 else None) for i in range(n)]


def test_the_passk_query_takes_groups_of_one(spark, tmp_path):
    import harness

    from quern.plans import registry

    events = spark.range(7).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id % 4 AS user_id", "'t' AS event_type", "id * id * 1.0D AS value", """'{"k": 7}' AS props""")
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = harness.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    query, sql = registry.QUERIES["grpo_passk"], registry.ORACLE_SQL["grpo_passk"]
    assert harness.difference(spark, str(tmp_path), query, sql, con) is None
    got = {r["event_id"]: r["advantage"] for r in query(spark, str(tmp_path)).collect()}
    assert got[3] is None and got[0] == 0.0 and got[4] > 0


def test_the_synthesis_query_takes_every_task(spark, tmp_path, monkeypatch):
    from quern.plans import flows

    parts = spark.range(30).selectExpr("id + 1 AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size", "1.0D AS p_retailprice")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(flows.synthesis, "until_valid", lambda pool, *rest, **more: (pool, None))
    monkeypatch.setattr(flows.synthesis, "publish", lambda frames: frames[0].selectExpr("*", "'' AS code", "'' AS input", "'' AS output", "0.0D AS difficulty"))
    assert flows.synthesis_loop(spark, str(tmp_path)).count() == 30


def test_equal_snippets_run_once(spark):
    from quern.plans import synthesis

    source = "import os\ndef f(x):\n    return (x, os.getpid())"
    rows = [(i, "s", ["s"], "code_out", source, str(i % 2), None) for i in range(12)]
    rows += [(12, "s", ["s"], "code_out", source, None, None), (13, "s", ["s"], "code_out", None, "1", None)]
    tasks_ = spark.createDataFrame(rows, "task_id long, skill string, detected_skill array<string>, task_type string, code string, input string, output string").repartition(4)
    valid, invalid = synthesis.verify(tasks_, [], 4, F.col("attempt") <= 2, 0.1, 0.9)
    got = {r["task_id"]: r["output"] for r in valid.collect()}
    assert sorted(got) == list(range(12))
    assert {i % 2: x for i, x in got.items()} == {0: got[0], 1: got[1]} and len(set(got.values())) == 2
    assert sorted((r["task_id"], r["reason"]) for r in invalid.collect()) == [(12, "did not run"), (13, "not well formed")]


def test_the_sampler_query_sees_a_late_difference(spark, tmp_path, monkeypatch):
    from quern.plans import extras

    parts = spark.range(60).selectExpr("id + 1 AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size", "1.0D AS p_retailprice")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    assert extras.samplers(spark, str(tmp_path)).first()["sorted_"]
    calls = []

    def ordered(df, how, key, seed=0):
        calls.append(how)
        return df.orderBy(F.when(F.col(key) > 55, F.col(key) * (-1) ** len(calls)).otherwise(-1000), key)

    monkeypatch.setattr(extras.sampling, "ordered", ordered)
    assert not extras.samplers(spark, str(tmp_path)).first()["sorted_"]


def test_null_scores_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), (None, 2, 1.0)], "uid string, sample_idx int, score double")
    got = {r["sample_idx"]: r["advantage"] for r in advantages.rloo(df).collect()}
    assert got[0] is None and got[2] == 1.0 and len(got) == 3


def test_a_streamed_coefficient_goes_on_where_it_ended(spark, tmp_path):
    from quern.streaming.accumulate import CoefficientState

    kl = [(i, 0.05 + 0.02 * i, 64) for i in range(6)]
    kinds = "step long, current_kl double, n int"
    whole = {r["step"]: r["coefficient"] for r in metrics.adaptive_coefficient(spark.createDataFrame(kl, kinds), 0.2, 0.1, 1000.0).collect()}
    own = CoefficientState(str(tmp_path / "c"), 0.2, 0.1, 1000.0)
    for epoch, part in enumerate((kl[:2], [], kl[2:5], kl[5:])):
        for _ in range(2):  # retried
            own(spark.createDataFrame(part, kinds), epoch)
    got = {r["step"]: r["coefficient"] for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == pytest.approx(whole)


def test_resampling_takes_the_row_at_each_point(spark):
    import hashlib

    rows = [(i, float((i * 7) % 5)) for i in range(300)] + [(1000, 400.0)]
    df = spark.createDataFrame(rows, "event_id long, score double").repartition(5)
    got = sorted((r["draw"], r["event_id"]) for r in advantages.resample(df, "event_id", 500, 7).collect())
    weights = [max(s * s + 1e-8, 1e-8) for _, s in rows]
    ends, want = np.cumsum(weights), []
    for k in range(500):
        point = int(hashlib.md5(f"{k}:7".encode()).hexdigest()[:13], 16) / 2**52 * ends[-1]
        want.append((k, rows[int(np.searchsorted(ends, point, "right"))][0]))
    assert got == want


def test_recurrences_of_a_long_sequence(spark):
    n = 30_000
    df = spark.range(n).selectExpr("'s' AS seq", "CAST(id AS INT) AS pos", "CAST(id % 3 != 1 AS INT) AS mask", "CAST(id % 7 AS DOUBLE) AS reward", "0.5D AS value")
    got = {r["pos"]: r for r in advantages.gae(df, 0.9, 0.8).collect()}
    following, advantage = 0.0, 0.0
    for i in reversed(range(n)):
        if i % 3 != 1:
            advantage = i % 7 + 0.9 * following - 0.5 + 0.9 * 0.8 * advantage
            following = 0.5
        assert got[i]["advantage"] == advantage
    assert advantages.reinforce_plus_plus(df).count() == n


def test_every_case_of_a_program_runs():
    from quern.functions import rewards

    numbers = [str(k) for k in range(14)]
    assert rewards.run_cases("def f(x):\n    return x if x < 11 else -x", numbers, numbers, "f") == [1] * 11 + [0] * 3
    assert rewards.run_cases("def f(x):\n    return x", numbers, numbers, "f", most=10) == [1] * 10


def test_different_snippets_run_once_and_answer_every_row(spark):
    from quern.functions import code

    rows = spark.createDataFrame([(i, None if i % 3 == 2 else f"s{i % 3}") for i in range(30)], "i long, s string")
    got = code.once(rows, ["s"], F.concat(F.coalesce("s", F.lit("none")), F.lit("!")), "out").collect()
    assert sorted((r["i"], r["out"]) for r in got) == [(i, "none!" if i % 3 == 2 else f"s{i % 3}!") for i in range(30)]


def test_snippets_are_rewritten():
    from quern.functions import code

    source = 'import os\nclass Äb:\n    """Doc."""\n    def make(self, x):\n        "Doc."\n        self.x = x\n    def two(self):\n        """Only."""\nclass C(Äb):\n    def own(self):\n        return 1\nprint(2)  # said\n'
    assert "def __init__(self, x):" in code.named_constructors(source) and "def own(self)" in code.named_constructors(source) and "def two" in code.named_constructors(source)
    bare = code.without_comments(source)
    assert "Doc." not in bare and "#" not in bare and "pass" in bare
    assert "print" not in code.definitions_only(source) and "import os" in code.definitions_only(source)
    assert code.named_constructors("class :") == "class :"
