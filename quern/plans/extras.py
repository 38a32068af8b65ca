"""Queries over mathematical answers, test cases, rewards, and smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import code, mathgrade, rewards, text, tokens
from quern.operators import metrics, sampling, tasks
from quern.plans import synthesis, views
from quern.plans.registry import query
from quern.plans.views import ROLLOUTS, TASKS, TOKENS, table
from quern.sources import writers

K, R, T = {"k": TASKS}, {"r": ROLLOUTS}, {"t": TOKENS}
_I = "(task_id % 5)"


def pick(column, *values):
    return F.element_at(F.array(*(F.lit(v) if not hasattr(v, "alias") else v for v in values)), (F.col(column) % len(values) + 1).cast("int"))


@query(f"SELECT task_id, CASE WHEN {_I} IN (0, 1, 3) THEN 1.0 ELSE 0.0 END AS score FROM {{k}}", "score", **K)
def math_boxed(spark, d):
    said = pick("task_id", "so \\boxed{\\dfrac12} it is", "x \\boxed{1} then \\boxed{\\frac{1}{2}}", "\\boxed{\\frac{1}{3}}", "\\fbox{1/2}", "1/2")
    rows = views.tasks(spark, d).select("task_id", said.alias("r"))
    return rows.select("task_id", mathgrade.boxed_score(F.col("r"), F.lit("0.5")).alias("score"))


@query(f"SELECT task_id, ['x=3', '2\\frac{{1}}{{2}}', '\\sqrt{{2}}', '7', '\\frac{{3}}{{4}}'][{_I} + 1] AS form FROM (SELECT task_id FROM {{k}})".replace("'x=3'", "'3'"), **K)
def math_normal_form(spark, d):
    said = pick("task_id", "x = 3", "2\\tfrac12", "\\sqrt2", "7^\\circ\\text{ degrees}", "3/4")
    return views.tasks(spark, d).select("task_id", mathgrade.strip_latex(said).alias("form"))


@query(f"SELECT task_id, {_I} IN (0, 1, 2) AS right FROM {{k}}", **K)
def math_grade(spark, d):
    given, gold = pick("task_id", "1,000", "50%", "(1, 2)", "[1, 2]", "3.7"), pick("task_id", "1000 cm", "0.5", "(1,2)", "(1, 3)", "4")
    rows = views.tasks(spark, d).select("task_id", given.alias("a"), gold.alias("b"))
    return rows.select("task_id", mathgrade.grade(F.col("a"), F.col("b")).alias("right"))


@query(f"SELECT task_id, ['7', '3', '12', 'no digit', '9'][{_I} + 1] AS answer, {_I} <> 3 AS found FROM {{k}}", **K)
def math_stated(spark, d):
    said = pick("task_id", "Thus the answer is 7", "x = 3", "\\boxed{12}", "answer: no digit", "9 is the answer to it")
    rows = views.tasks(spark, d).select("task_id", said.alias("s")).withColumn("x", mathgrade.stated_answer(F.when(F.col("task_id") % 5 == 1, F.lit("The answer is x = 3")).otherwise(F.col("s"))))
    return rows.select("task_id", "x.answer", "x.found")


@query(f"SELECT task_id, {_I} IN (0, 1, 2) AS safe FROM {{k}}", **K)
def evaluation_safe(spark, d):
    return views.tasks(spark, d).select("task_id", mathgrade.safe_to_evaluate(pick("task_id", "x+1", "sqrt(y)", "2*3", "a+b+c", "x^{2}")).alias("safe"))


@query(f"SELECT task_id, CASE {_I} WHEN 0 THEN '1,1' WHEN 1 THEN '1,0' WHEN 2 THEN '-1,-1' WHEN 3 THEN '-2,-2' ELSE '1,1' END AS results, CASE {_I} WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 4 THEN 1.0 ELSE 0.0 END AS passed FROM {{k}}", "passed", **K)
def case_scores(spark, d):
    source = pick("task_id", "def f(x):\n    return x * 2", "def f(x):\n    return 4", "def f(x):\n    return y", "def f(:", "print(int(input()) * 2)")
    rows = views.tasks(spark, d).select("task_id", source.alias("s"), F.when(F.col("task_id") % 5 != 4, "f").alias("f"))
    rows = code.once(rows, ["s", "f"], rewards.case_results(F.col("s"), F.array(F.lit("2"), F.lit("3")), F.array(F.lit("4"), F.lit("6")), F.col("f")), "r")
    return rows.select("task_id", F.array_join("r", ",").alias("results"), rewards.passed_part(F.col("r")).alias("passed"))


@query(f"SELECT task_id, CASE WHEN {_I} = 0 THEN '1,0,1' WHEN {_I} = 1 THEN '-4,-4,-4' WHEN {_I} = 2 THEN '1,-4,-4' ELSE '-2,-3,1' END AS codes FROM {{k}}", **K)
def settled_status(spark, d):
    x = F.when(F.col("task_id") % 5 == 0, F.array(*map(F.lit, [1, 0, 1]))).when(F.col("task_id") % 5 == 1, F.array(*map(F.lit, [-4, 1, 1]))).when(F.col("task_id") % 5 == 2, F.array(*map(F.lit, [1, -4, 1]))).otherwise(F.array(*map(F.lit, [-2, -3, 1])))
    return views.tasks(spark, d).select("task_id", F.array_join(rewards.settle_status(x), ",").alias("codes"))


@query("SELECT uid, sample_idx, n - 1 AS pos, CASE WHEN n > 60 THEN -(n - 60) / 40.0 ELSE 0 END + CASE WHEN acc = 1 THEN 1 ELSE 0 END AS reward FROM (SELECT *, greatest(response_length, 1) AS n FROM {r} WHERE response_length > 0)", "reward", "sample_idx pos", **R)
def reward_manager(spark, d):
    rows = views.rollouts(spark, d).filter("response_length > 0").withColumns({"response": F.when(F.col("acc") == 1, "#### 7").otherwise("#### 8"), "ground_truth": F.lit("7"), "data_source": F.lit("gsm8k")})
    own = rewards.manager("dapo")(rows, ["gsm8k"], longest=100, buffer=40)
    return own.groupBy("uid", "sample_idx").agg(F.max("pos").alias("pos"), F.sum("token_reward").alias("reward"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CASE WHEN value > 150 THEN 1 ELSE 0 END ELSE CASE WHEN value > 150 THEN 1 ELSE -1 END END AS score FROM events", "score")
def scorer_registry(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "gsm8k").otherwise("dapo").alias("data_source"), F.when(F.col("value") > 150, "x #### 7\nAnswer: 7").otherwise("x #### 8\nAnswer: 8").alias("response"), F.lit("7").alias("ground_truth"))
    return rewards.score(e, ["gsm8k", "dapo"]).select("event_id", "score")


@query("SELECT avg(reward) AS mean, max(reward) AS max, min(reward) AS min, stddev_pop(reward) AS std FROM {t} WHERE mask = 1", "mean max min std", **T)
def distributed_stats(spark, d):
    return metrics.spread(views.tokens(spark, d), "reward", "mask")


@query("SELECT max(event_id) AS event_id, max_by(score, event_id) AS score FROM {r}", "score", **R)
def newest(spark, d):
    return metrics.newest(views.rollouts(spark, d), "event_id", "score")


_MOE = 48 * (2048 * 8 * 768 * 3 + 2048 * 128 + 2048 * 128 * (2 * 32 + 2 * 4)) + 2 * 151936 * 2048


@query(f"SELECT sum(n) AS tokens, (sum(n) * (6.0 * {_MOE}) + sum(n * n) * (12.0 * {128 * 32 * 48})) / 1e12 AS teraflops FROM (SELECT CAST(response_length AS DOUBLE) AS n FROM {{r}})", "tokens teraflops", digits=3, **R)
def mfu_experts(spark, d):
    weights = metrics.model_weights(48, 2048, 151936, 32, 4, 128, 768, experts=128, active=8)
    own = metrics.flops(views.rollouts(spark, d), weights, 12.0 * 128 * 32 * 48)
    return own.select("tokens", (F.col("flops") / 1e12).alias("teraflops"))


@query("SELECT task_id, list_sort(list_distinct(detected_skill)) = list_sort(list_distinct([skill, category])) AS same FROM {k}", **K)
def set_equality(spark, d):
    return views.tasks(spark, d).select("task_id", text.same_sets(F.col("detected_skill"), F.array("skill", "category")).alias("same"))


@query("SELECT task_id, s AS sample_idx FROM {k}, range(3) AS t(s)", longs="sample_idx", **K)
def fan_out(spark, d):
    return sampling.fan_out(views.tasks(spark, d), 3).select("task_id", "sample_idx")


@query("SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'text:see |image:|text: and |video:' ELSE 'text:none' END AS parts FROM {k}", **K)
def message_segments(spark, d):
    s = text.segments(F.when(F.col("task_id") % 2 == 0, "see <image> and <video>").otherwise("none"))
    return views.tasks(spark, d).select("task_id", F.array_join(F.transform(s, lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["text"], F.lit("")))), "|").alias("parts"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN value > 150 THEN 1.0 ELSE 0.0 END AS flag, 2 AS n FROM events", "k flag", "n")
def flat_metrics(spark, d):
    wrapped = F.concat(F.lit('{"a": '), F.col("props"), F.lit(', "b": {"flag": '), (F.col("value") > 150).cast("string"), F.lit(', "text": "no"}}'))
    rows = table(spark, d, "events").select("event_id", text.flat_numbers(wrapped).alias("m"))
    return rows.select("event_id", F.col("m")["a/k"].alias("k"), F.col("m")["b/flag"].alias("flag"), F.size("m").alias("n"))


@query("SELECT event_id, value AS score, 2.0 * value AS twice FROM events", "score twice")
def nested_keys(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct(F.struct(F.col("value").alias("x"), F.array("value").alias("one")).alias("inner")).alias("outer"))
    return rows.select("event_id", F.col("outer.inner.x").alias("score"), (F.element_at("outer.inner.one", 1) * 2).alias("twice"))


@query("SELECT event_id, event_type IN ('click', 'view') AS b, 3 AS n, 7.5 AS total FROM events", "total", "n")
def conversions(spark, d):
    rows = table(spark, d, "events")
    numbers = text.str_to_numbers(F.lit("1, 2.5,4"))
    return rows.select("event_id", text.str_to_bool(F.when(F.col("event_type").isin("click", "view"), "Yes").otherwise("0")).alias("b"), F.size(numbers).alias("n"), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT conv_id, len(list_concat(string_split(text, ' '), ['#'])) AS n, true AS same FROM conversations", longs="n")
def token_mismatch(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.split("text", " ").alias("w"))
    whole = F.concat("w", F.array(F.lit("#")))
    return rows.select("conv_id", F.size(whole).alias("n"), tokens.same_tokens(whole, F.array(F.col("w"), F.array(F.lit("#")))).alias("same"))


@query("SELECT event_id, least(n, 20) AS valid, 20 AS width FROM (SELECT event_id, response_length AS n FROM {r})", longs="valid width", **R)
def response_masks(spark, d):
    mask = F.concat(tokens.ones(F.col("prompt_length"), 8, left=True), tokens.ones(F.least(F.col("response_length"), F.lit(20)), 20))
    rows = views.rollouts(spark, d).select("event_id", tokens.response_mask(mask, F.lit(20)).alias("m"))
    return rows.select("event_id", tokens.total("m").alias("valid"), F.size("m").alias("width"))


@query("SELECT task_id, CASE WHEN task_id % 3 > 0 THEN 'a,b' ELSE '' END AS skills FROM {k}", **K)
def reflections(spark, d):
    said = F.when(F.col("task_id") % 3 > 0, '{"main_skill": "a", "other_skills": ["b"]}').otherwise("no json")
    return views.tasks(spark, d).select("task_id", F.array_join(text.detected_skills(said), ",").alias("skills"))


@query("SELECT task_id, 'c' || task_id AS code, 'x|y' AS skills FROM {k} WHERE task_id % 2 = 1", **K)
def crossovers(spark, d):
    said = F.concat(F.lit('{"code": "'), F.when(F.col("task_id") % 2 == 1, F.concat(F.lit("c"), F.col("task_id").cast("string"))).otherwise(""), F.lit('", "skill_combination": ["x", "y"]}'))
    rows = synthesis.crossover(views.tasks(spark, d).select("task_id", said.alias("response")))
    return rows.select("task_id", "code", F.array_join("skill_combination", "|").alias("skills"))


@query("SELECT task_id, code, skills FROM {k}, (VALUES ('a', 's|t'), ('b', 'u')) AS v(code_, skills), LATERAL (SELECT code_ AS code) WHERE task_id % 2 = 0".replace("task_id, code, skills FROM {k}", "k.task_id, x.c AS code, v.skills FROM {k} k").replace("LATERAL (SELECT code_ AS code)", "LATERAL (SELECT code_ AS c) x"), **K)
def curricula(spark, d):
    good = '{"tasks": [{"code": "a", "input": "1", "skill": ["s", "t"]}, {"code": "b", "input": "2", "skill": ["u"]}]}'
    rows = views.tasks(spark, d).select("task_id", F.when(F.col("task_id") % 2 == 0, good).otherwise('{"tasks": [{"code": "a", "skill": [" "]}]}').alias("response"))
    return synthesis.curriculum(rows).select("task_id", "code", F.array_join("detected_skill", "|").alias("skills"))


@query("SELECT task_id, 'Write one function f that exercises the skill ' || skill || ' (' || category || '), with an input and its output.' AS prompt FROM {k}", **K)
def prompt_rendering(spark, d):
    rows = views.tasks(spark, d).select("task_id", "skill", F.col("category").alias("skill_description"))
    return synthesis.prompts(rows, "code_out", "init").select("task_id", "prompt")


@query("SELECT task_id, CASE task_id % 3 WHEN 0 THEN 'most readers solved it.' WHEN 1 THEN 'the code failed or was not deterministic: boom' ELSE 'odd' END AS failure, CASE task_type WHEN 'code_out' THEN 'What does f(' || coalesce(input, '') || ') give? ' || code WHEN 'code_in' THEN 'Which input of f gives ' || coalesce(output, '') || '? ' || code ELSE 'Find the function: ' || coalesce(problem, '') END AS prompt FROM {k}", **K)
def failure_texts(spark, d):
    rows = views.tasks(spark, d).withColumns({"reason": pick("task_id", "too easy", "did not run", "odd"), "feedback": F.lit("boom")})
    return synthesis.questions(synthesis.failures(rows)).select("task_id", "failure", "prompt")


@query("SELECT category, string_agg(skill || ': ' || category, chr(10) ORDER BY skill) AS skills FROM (SELECT DISTINCT category, skill FROM {k}) GROUP BY category", **K)
def skill_lists(spark, d):
    return synthesis.skill_list(views.tasks(spark, d).withColumn("skill_description", F.col("category")))


@query("SELECT task_type, task_type || ': ' || count(*) || ' tasks, mean success ' || printf('%.2f', avg(difficulty)) AS profile FROM {k} GROUP BY task_type", **K)
def performance_profiles(spark, d):
    return synthesis.performance_profile(views.tasks(spark, d))


@query("SELECT task_id FROM {k} WHERE problem IS NOT NULL AND difficulty <= 0.5", **K)
def retry_filters(spark, d):
    rows = views.tasks(spark, d).withColumn("hints", F.when(F.col("difficulty") <= 0.5, F.array(F.lit("h"))))
    return tasks.with_hints(tasks.again(rows)).select("task_id")


@query("SELECT 'event_type' AS column, sum(length(event_type)) AS bytes FROM events", longs="bytes")
def size_report(spark, d):
    return writers.size_report(table(spark, d, "events").select("event_type"))


@query("SELECT code AS input FROM {k} ORDER BY md5(code || ':42'), code LIMIT 50", **K)
def validation_sample(spark, d):
    return writers.validation_sample(views.tasks(spark, d).select(F.col("code").alias("input")), 50)


@query("SELECT 50 AS n, true AS sorted_", longs="n")
def samplers(spark, d):
    rows = views.tasks(spark, d)
    first = sampling.ordered(rows, "sequential", "task_id").limit(50).agg(F.count("*").alias("n"), (F.max("task_id") < 60).alias("s"))
    numbered = lambda x: sampling.ordered(x, "random", "task_id", 3).select("task_id").rdd.zipWithIndex().map(lambda r: (r[1], r[0][0])).toDF("at long, task_id long")
    one, two = numbered(rows), numbered(rows.repartition(7, "task_id"))
    same = one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    return first.select("n", (F.col("s") & F.lit(same)).alias("sorted_"))
