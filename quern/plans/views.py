"""Logical views over the fixture tables: rollouts, tokens, tasks and others, with the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str, by: str = "type") -> DataFrame:
    """One row per sampled response. by: groups of a user and an event type, or of a user and a day (some of one row)."""
    e = table(spark, sf_dir, "events")
    part = F.col("event_type") if by == "type" else F.date_format("ts", "yyyy-MM-dd")
    uid = F.concat_ws(":", F.col("user_id").cast("string"), part)
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(uid.alias("uid"), "ts", "event_id", F.col("value").alias("score"), (F.col("value") > 150).cast("double").alias("acc"), F.col("event_type").alias("task_type"), F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("data_source"), k.alias("response_length"), (k % 5).alias("pred"), (F.col("user_id") % 7 + 1).cast("int").alias("prompt_length"))
    order = W.partitionBy("uid").orderBy("ts", "event_id")
    return rows.withColumn("sample_idx", F.row_number().over(order) - 1).drop("ts")


_ROLLOUTS = """SELECT {uid} AS uid, event_id, value AS score, CAST(value > 150 AS DOUBLE) AS acc, event_type AS task_type,
 'src' || CAST(user_id % 3 AS VARCHAR) AS data_source, CAST(json_extract_string(props, '$.k') AS INT) AS response_length,
 CAST(json_extract_string(props, '$.k') AS INT) % 5 AS pred, CAST(user_id % 7 + 1 AS INT) AS prompt_length,
 row_number() OVER (PARTITION BY {uid} ORDER BY ts, event_id) - 1 AS sample_idx FROM events"""
ROLLOUTS = _ROLLOUTS.format(uid="(CAST(user_id AS VARCHAR) || ':' || event_type)")
ROLLOUTS_DAY = _ROLLOUTS.format(uid="(CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d'))")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token: seq, pos from 0, mask (0 or 1), reward, value, and four log-probabilities."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("uid"))
    rows = li.withColumn("pos", F.row_number().over(order) - 1).join(o, "l_orderkey")
    old = -3.0 * q / 50.0
    return rows.select(
        F.col("l_orderkey").alias("seq"), "uid", "pos", (F.col("l_returnflag") != "N").cast("int").alias("mask"),
        (F.col("l_discount") + 0.0).alias("reward"), F.col("l_tax").alias("value"), old.alias("old_logp"),
        (old + (n - 3.0) / 4.0 - F.col("l_tax")).alias("new_logp"), (old + (n - 2.0) / 10.0).alias("ref_logp"),
        (old * 0.75 - n / 16.0).alias("rollout_logp"), (F.col("l_discount") * 10.0 - 0.45 + F.col("l_tax")).alias("adv"),
    )


TOKENS = """SELECT l_orderkey AS seq, o_custkey AS uid, pos, CAST(l_returnflag <> 'N' AS INT) AS mask, l_discount + 0.0 AS reward, l_tax AS value,
 -3.0 * l_quantity / 50.0 AS old_logp, -3.0 * l_quantity / 50.0 + (l_linenumber - 3.0) / 4.0 - l_tax AS new_logp,
 -3.0 * l_quantity / 50.0 + (l_linenumber - 2.0) / 10.0 AS ref_logp, -3.0 * l_quantity / 50.0 * 0.75 - l_linenumber / 16.0 AS rollout_logp,
 l_discount * 10.0 - 0.45 + l_tax AS adv FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
 l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS pos FROM lineitem) JOIN orders ON o_orderkey = l_orderkey"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per generated task, with skills, difficulty and test inputs and outputs."""
    p = table(spark, sf_dir, "part")
    nxt = F.lead("p_type").over(W.partitionBy("p_brand").orderBy("p_partkey"))
    words = F.split("p_name", " ")
    return p.select(
        F.col("p_partkey").alias("task_id"), F.col("p_type").alias("skill"), F.col("p_brand").alias("category"), F.col("p_name").alias("code"),
        (F.col("p_size") / 50.0).alias("difficulty"), F.array("p_type", F.coalesce(nxt, F.lit("NONE"))).alias("detected_skill"),
        F.element_at(F.array(F.lit("code_in"), F.lit("code_out"), F.lit("code_func")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("task_type"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("problem"), F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("in "), F.col("p_brand"))).alias("input"),
        F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("out "), F.col("p_brand"))).alias("output"), words.alias("inputs"), F.transform(words, F.upper).alias("outputs"),
    )


TASKS = """SELECT p_partkey AS task_id, p_type AS skill, p_brand AS category, p_name AS code, p_size / 50.0 AS difficulty,
 [p_type, coalesce(lead(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey), 'NONE')] AS detected_skill,
 ['code_in', 'code_out', 'code_func'][p_partkey % 3 + 1] AS task_type, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS problem,
 CASE WHEN p_partkey % 7 <> 0 THEN 'in ' || p_brand END AS input, CASE WHEN p_partkey % 11 <> 0 THEN 'out ' || p_brand END AS output,
 string_split(p_name, ' ') AS inputs, list_transform(string_split(p_name, ' '), lambda x: upper(x)) AS outputs FROM part"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, name, value): one step a day of events."""
    e = table(spark, sf_dir, "events").select(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("step"), "event_type", "value")
    day = e.groupBy("step", "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("most"), F.round(F.min("value"), 4).alias("least"))
    named = F.array(*(F.struct(F.concat(F.lit(f"{a}/"), F.col("event_type"), F.lit(f"/{b}")).alias("name"), F.col(c).alias("value")) for a, b, c in (("perf", "mean", "total"), ("critic", "max", "most"), ("critic", "min", "least"))))
    return day.select("step", F.explode(named).alias("m")).select("step", "m.name", "m.value")


METRICS = """SELECT step, unnest([{'name': 'perf/' || event_type || '/mean', 'value': round(sum(value), 4)}, {'name': 'critic/' || event_type || '/max', 'value': round(max(value), 4)},
 {'name': 'critic/' || event_type || '/min', 'value': round(min(value), 4)}], recursive := true) FROM (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, event_type, value FROM events) GROUP BY step, event_type"""
