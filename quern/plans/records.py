"""Queries over readers, writers, frames' columns and single rules that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import code, text
from quern.operators import batch, partition
from quern.plans import views
from quern.plans.flows import scratch
from quern.plans.registry import query
from quern.plans.views import ROLLOUTS, TASKS, table
from quern.sources import readers, writers

R, K = {"r": ROLLOUTS}, {"k": TASKS}


@query("SELECT task_id, task_id % 4 IN (0, 3) AS again FROM {k}", **K)
def redefinitions(spark, d):
    sources = F.array(*map(F.lit, ["def f(x):\n    return x", "def g(x):\n    return x", "class A:\n    def f(self):\n        return 1", "def f(:"]))
    rows = views.tasks(spark, d).select("task_id", F.element_at(sources, (F.col("task_id") % 4 + 1).cast("int")).alias("c"))
    return code.once(rows, ["c"], code.redefines_col(F.col("c"), ["f"]), "again").select("task_id", "again")


@query("SELECT event_id, score AS points, acc, uid FROM {r}", "points acc", **R)
def pop_rename(spark, d):
    taken, rest = batch.pop(views.rollouts(spark, d).select("event_id", "uid", "score", "acc", "pred"), "pred")
    assert taken.columns == ["pred"]
    return batch.rename(rest, ["score"], ["points"])


@query("SELECT event_id // 512 AS step, count(*) AS n, 8 AS parts, true AS fair FROM {r} GROUP BY step HAVING count(*) >= 8", longs="step n parts", **R)
def greedy_partitions(spark, d):
    rows = views.rollouts(spark, d).withColumn("step", F.floor(F.col("event_id") / 512)).withColumn("cost", (F.col("response_length") + 1).cast("double"))
    parts = partition.balanced(rows.select("event_id", "step", "cost"), "cost", 8, "event_id", ["step"], greedy=True)
    own = parts.groupBy("step", "part").agg(F.sum("cost").alias("s"), F.max("cost").alias("m"), F.count("*").alias("n"))
    # the least loaded part takes the next row, so no two parts differ by more than the largest row
    found = own.groupBy("step").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), (F.max("s") - F.min("s") <= F.max("m")).alias("fair"))
    return found.filter("n >= 8")


@query("SELECT task_id, code AS answer FROM {k}", **K)
def verifier_answers(spark, d):
    said = F.concat(F.lit("<think>maybe <answer>no</answer></think>so <answer>"), F.col("code"), F.lit("</answer>"))
    return views.tasks(spark, d).select("task_id", text.verifier_answer(said, F.lit("code_func")).alias("answer"))


@query("SELECT event_id, 0.9 * acc + 0.1 * CASE WHEN pred > 2 THEN 1 ELSE 0 END AS score FROM {r}", "score", **R)
def geometry_scores(spark, d):
    return views.rollouts(spark, d).select("event_id", text.geo3k(F.col("acc"), F.when(F.col("pred") > 2, 1.0).otherwise(0.0)).alias("score"))


@query("SELECT CAST(event_id AS VARCHAR) AS input, uid AS output, data_source AS gts, score, pred, event_id % 2 AS step FROM {r}", "score", "pred step", **R)
def generations_dump(spark, d):
    path = scratch(spark)
    rows = views.rollouts(spark, d).select(F.col("event_id").cast("string").alias("input"), F.col("uid").alias("output"), F.col("data_source").alias("gts"), "score", "pred", (F.col("event_id") % 2).alias("at"))
    for step in (0, 1, 1):  # a step that is written again replaces itself
        writers.generations(rows.filter(F.col("at") == step), path, step, ["pred"])
    return spark.read.schema("input string, output string, gts string, score double, pred int, step int").json(path)


@query("SELECT category, count(*) AS n FROM {k} GROUP BY category", longs="n", **K)
def staged_table(spark, d):
    path = scratch(spark)
    make = lambda: views.tasks(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    readers.staged(spark, path, make)
    return readers.staged(spark, path, lambda: make().limit(0))


@query("SELECT l_orderkey, l_quantity FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice FROM orders", "l_quantity")
def table_files(spark, d):
    path = scratch(spark)
    table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax").write.parquet(f"{path}/a")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("l_quantity"), F.lit(0.0).alias("l_tax")).write.parquet(f"{path}/b")
    return readers.reader("parquet")(spark, [f"{path}/a", f"{path}/b"], ["l_orderkey", "l_quantity"])


@query("SELECT c_custkey, c_name FROM customer")
def json_files(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    rows.filter("c_custkey % 2 = 0").write.json(f"{path}/a")
    rows.filter("c_custkey % 2 = 1").write.json(f"{path}/b")
    return readers.reader("json")(spark, [f"{path}/a", f"{path}/b"], "c_custkey long, c_name string")
