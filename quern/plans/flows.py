"""Queries over code, files, streams and the synthesis loop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import code
from quern.operators.lineage import shared_dir
from quern.operators.metrics import group_index
from quern.plans import synthesis, views
from quern.plans.registry import query
from quern.plans.views import METRICS, ROLLOUTS, TASKS, table
from quern.sources import readers, schemas, writers
from quern.streaming import accumulate


def scratch(spark) -> str:
    """A fresh folder below the session's shared one."""
    return f"{shared_dir(spark)}/flow-{uuid.uuid4().hex}"


def _messages(spark, d):
    t = views.tasks(spark, d)
    body = F.concat(F.lit('```python\nimport math\ndef go(x):\n    """doc"""\n    # '), F.col("code"), F.lit("\n    print(x)\n    return x + "), F.col("task_id").cast("string"), F.lit("\n```\n```input\n1\n```\n"))
    return t.select("task_id", F.concat(body, F.when(F.col("task_id") % 5 != 0, F.lit("```output\n2\n```")).otherwise("")).alias("m"))


@query("SELECT task_id, CASE WHEN task_id % 5 <> 0 THEN 'import math' || chr(10) || chr(10) || 'def f(x):' || chr(10) || '    return x + ' || task_id END AS code, CASE WHEN task_id % 5 <> 0 THEN 'import math' END AS imports FROM {k}", k=TASKS)
def parse_code_task(spark, d):
    t = _messages(spark, d).withColumn("t", code.parse_task_col(F.col("m"), comments=False, prints=False))
    return t.select("task_id", "t.code", F.when(F.size("t.imports") >= 0, F.array_join("t.imports", ",")).alias("imports"))


@query("SELECT task_id, task_id % 3 = 0 AS banned FROM {k}", k=TASKS)
def banned_imports(spark, d):
    t = views.tasks(spark, d).select("task_id", F.concat(F.when(F.col("task_id") % 3 == 0, "from os.path import join").otherwise("import math"), F.lit("\nx = 'import os'")).alias("c"))
    return t.select("task_id", code.banned_col(F.col("c"), ["os", "sys"]).alias("banned"))


@query("SELECT task_id, task_id % 2 = 0 AS same FROM {k}", k=TASKS)
def literal_equality(spark, d):
    t = views.tasks(spark, d).select("task_id", F.concat(F.lit("[1, {'a': {2, 3}}, "), F.col("task_id").cast("string"), F.lit("]")).alias("a"), F.concat(F.lit("(1, {'a': {3, 2}}, "), (F.col("task_id") + F.col("task_id") % 2).cast("string"), F.lit(")")).alias("b"))
    return t.select("task_id", code.same_literals_col(F.col("a"), F.col("b")).alias("same"))


@query("SELECT task_id, task_id % 4 <> 1 AS ok, CASE task_id % 4 WHEN 0 THEN '3' WHEN 1 THEN 'banned import' WHEN 2 THEN '[1, 1]' ELSE '''a''' END AS result FROM {k}", k=TASKS)
def execution_gate(spark, d):
    sources = F.array(*map(F.lit, ["def f(x):\n    return x + 2", "import os\ndef f(x):\n    return 1", "def f(x):\n    return [x] * 2", "def f(x):\n    return 'a' * x"]))
    t = views.tasks(spark, d).select("task_id", F.element_at(sources, (F.col("task_id") % 4 + 1).cast("int")).alias("c"))
    return code.once(t, ["c"], code.gate_col(F.col("c"), F.lit("1"), ["os"]), "g").select("task_id", "g.ok", "g.result")


@query("SELECT task_id, skill, task_type, difficulty, array_to_string(detected_skill, '|') AS detected FROM {k} WHERE task_type = 'code_in'", "difficulty", k=TASKS)
def json_lines(spark, d):
    path = scratch(spark)
    rows = views.tasks(spark, d)
    writers.json_lines(rows.filter("task_id % 2 = 0"), f"{path}/even")
    writers.json_lines(rows.filter("task_id % 2 = 1"), f"{path}/odd")
    back = readers.json_lines(spark, [f"{path}/even", f"{path}/odd", f"{path}/none"], schemas.TASK, "code_in")
    return back.select("task_id", "skill", "task_type", "difficulty", F.array_join("detected_skill", "|").alias("detected"))


@query("SELECT stage, iteration, task_type, count(*) AS n FROM {k}, (VALUES ('init', 0), ('mutate', 0), ('mutate', 1)) AS s(stage, iteration) GROUP BY ALL", longs="iteration n", k=TASKS)
def stage_layout(spark, d):
    path = scratch(spark)
    for stage, iteration in (("init", 0), ("mutate", 0), ("mutate", 1), ("init", 0)):
        writers.stage(views.tasks(spark, d).select("task_id", "task_type"), path, stage, iteration)
    rows = spark.read.schema("task_id long, stage string, iteration int, task_type string").json(path)
    return rows.groupBy("stage", "iteration", "task_type").agg(F.count("*").alias("n"))


@query("SELECT 'p' || i AS problem_id, 'text ' || i || chr(10) || CASE WHEN i % 2 = 0 THEN 'Two seconds.' ELSE 'Time limit: 3 seconds' END || chr(10) || 'Memory limit: 256 MB' AS problem, 's' || i AS solution FROM range(4) AS t(i)")
def seed_problems(spark, d):
    path = scratch(spark)
    body = [f'"p{i}": {{"description": "text {i}", "runtime_limit": 3, "runtime_limit_sentences": [{chr(34) + "Two seconds." + chr(34) if i % 2 == 0 else ""}], "memory_limit": 256, "memory_limit_sentences": [], "solution_python3": "s{i}"}}' for i in range(4)]
    spark.createDataFrame([("{" + ", ".join(body) + "}",)], "value string").coalesce(1).write.text(path)
    return readers.reader("usaco")(spark, path)


@query("SELECT uid, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY sample_idx) AS responses FROM {r} GROUP BY uid", r=ROLLOUTS)
def nested_responses(spark, d):
    rows = writers.nested_responses(views.rollouts(spark, d).select("uid", "sample_idx", "event_id"), "uid", "sample_idx", "event_id")
    return rows.select("uid", F.array_join("responses", ",").alias("responses"))


@query("SELECT step, name, value FROM {m}", "value", digits=4, m=METRICS)
def metric_sink(spark, d):
    path = scratch(spark)
    rows = views.metrics(spark, d).cache()
    for (step,) in rows.select("step").distinct().orderBy("step").collect():  # one row a training step
        writers.metrics(rows.filter(F.col("step") == step), path)
    rows.unpersist()
    return spark.read.schema(schemas.METRIC).json(path)


@query("SELECT event_id FROM {r} WHERE uid IN (SELECT uid FROM (SELECT uid, min(event_id) AS first FROM {r} GROUP BY uid HAVING count(*) = 1 OR stddev_pop(acc) > 0) ORDER BY first, uid LIMIT 10)", r=ROLLOUTS)
def stream_groups(spark, d):
    path = scratch(spark)
    events = table(spark, d, "events")
    events.write.parquet(f"{path}/arrivals")  # a folder that a stream can watch
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/arrivals")
    own = accumulate.GroupAccumulator(f"{path}/groups", 10)

    def rollouts(df, epoch):
        uid = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
        own(df.select(uid.alias("uid"), "event_id", (F.col("value") > 150).cast("double").alias("acc")), epoch)

    accumulate.accumulate(stream, rollouts, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/groups/batches").select("event_id")


_STEPS = "SELECT row_number() OVER (ORDER BY step) - 1 AS step, value / 40000 AS kl FROM {m} WHERE name = 'perf/click/mean'"


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED ({_STEPS}), r AS (SELECT step, 0.2 * (1 + greatest(least(kl / 0.1 - 1, 0.2), -0.2) * 64 / 10000) AS coefficient FROM s WHERE step = 0
 UNION ALL SELECT s.step, coefficient * (1 + greatest(least(kl / 0.1 - 1, 0.2), -0.2) * 64 / 10000) FROM r JOIN s ON s.step = r.step + 1) SELECT * FROM r""",
    "coefficient", "step", digits=8, m=METRICS,
)
def stream_kl_controller(spark, d):
    path = scratch(spark)
    rows = group_index(views.metrics(spark, d).filter("name = 'perf/click/mean'"), "step")
    rows = rows.select(F.col("gid").alias("step"), (F.col("value") / 40000).alias("current_kl"), F.lit(64).alias("n"))
    rows.write.parquet(f"{path}/steps")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/steps")
    own = accumulate.CoefficientState(f"{path}/coefficient", 0.2, 0.1, 10000.0)
    accumulate.accumulate(stream, own, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/coefficient").select("step", "coefficient")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", "total", "n", digits=4)
def window_counts(spark, d):
    rows = table(spark, d, "events")
    return accumulate.windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def synthesis_loop(spark, d):
    pool = views.tasks(spark, d).select("task_id", "skill", "category", "detected_skill", F.lit("use it").alias("skill_description"))
    found, _ = synthesis.until_valid(pool, "code_out", lambda t: synthesis.mock_responder(t), ["os", "sys"], F.xxhash64("task_id", "attempt") % 2 == 0, trials=3, high=0.95)
    return synthesis.publish([found]).select("task_id", "skill", "code", "input", "output", "difficulty")


@query("SELECT task_id, hints_used, difficulty FROM (SELECT task_id, CASE WHEN d > 2 THEN 1 WHEN d = 2 THEN 2 WHEN d = 1 THEN 3 ELSE 4 END AS hints_used, CASE WHEN d > 2 THEN 0.2 WHEN d = 2 THEN 0.4 WHEN d = 1 THEN 0.6 ELSE 0.8 END AS difficulty FROM (SELECT task_id, task_id % 4 AS d FROM {k}))", "difficulty", "hints_used", k=TASKS)
def hint_ladder(spark, d):
    rows = views.tasks(spark, d).select("task_id", F.col("code").alias("problem"), F.concat("inputs", "inputs", "inputs", "inputs").alias("hints"))

    def judge(x):
        given = F.size(F.regexp_extract_all("problem", F.lit(r"Hint \d+: "), F.lit(0)))
        need = F.greatest(4 - F.col("task_id") % 4, F.lit(1))
        return x.select("task_id", F.when(given >= need, given * 0.2).otherwise(0.0).alias("difficulty"))

    return synthesis.hint_ladder(rows, judge, 0.1).select("task_id", "hints_used", "difficulty")


@query("SELECT task_id, variant, code FROM {k}, (VALUES ('v1', 'a'), ('v2', 'b')) AS v(variant, code_) , LATERAL (SELECT code_ || task_id AS c2) WHERE task_id % 3 > 0".replace("variant, code FROM", "variant, c2 AS code FROM"), k=TASKS)
def mutations(spark, d):
    good = F.concat(F.lit('{"v1":{"code":"a'), F.col("task_id").cast("string"), F.lit('"},"v2":{"code":"b'), F.col("task_id").cast("string"), F.lit('"}}'))
    rows = views.tasks(spark, d).select("task_id", F.when(F.col("task_id") % 3 > 0, good).otherwise(F.lit('{"v1":{"code":""}}')).alias("response"))
    return synthesis.mutations(rows).select("task_id", "variant", "code")
