"""Queries over batches, tasks and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import batch, partition, sampling, tasks
from quern.plans import views
from quern.plans.registry import query
from quern.plans.views import METRICS, ROLLOUTS, TASKS, TOKENS, table

E_ = "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, label, list_transform(embedding, lambda x: CAST(floor(x * 64) AS BIGINT)) AS e FROM embeddings"
A = {"a": E_}
K = {"k": TASKS}


def arrays(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * F.lit(64.0).cast("float"))).alias("e"))
    return batch.positions(rows, "vec_id")


@query("SELECT vec_id, pos FROM {a}", longs="pos", **A)
def positions(spark, d):
    return arrays(spark, d).select("vec_id", "pos")


@query("SELECT vec_id, out_pos AS pos FROM (SELECT pos * 7 % 100 AS idx, pos AS out_pos FROM {a} WHERE pos < 150) JOIN {a} ON idx = pos", longs="pos", **A)
def select_idxs(spark, d):
    rows = arrays(spark, d)
    return batch.select_idxs(rows, rows.filter("pos < 150").select((F.col("pos") * 7 % 100).alias("idx"), F.col("pos").alias("out_pos"))).select("vec_id", "pos")


@query("SELECT vec_id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM {a} WHERE label % 2 = 0", longs="pos", **A)
def select_mask(spark, d):
    return batch.select_mask(arrays(spark, d), F.col("label") % 2 == 0).select("vec_id", "pos")


@query("SELECT vec_id, (pos - 10) // 3 AS pos FROM {a} WHERE pos >= 10 AND pos < 200 AND (pos - 10) % 3 = 0", longs="pos", **A)
def slice_step(spark, d):
    return batch.take_slice(arrays(spark, d), 10, 200, 3).select("vec_id", "pos")


@query("SELECT vec_id, pos * 3 + r AS pos FROM {a}, range(3) AS t(r)", longs="pos", **A)
def repeat_interleave(spark, d):
    return batch.repeat(arrays(spark, d), 3).select("vec_id", "pos")


@query("SELECT vec_id, r * (SELECT count(*) FROM embeddings) + pos AS pos FROM {a}, range(3) AS t(r)", longs="pos", **A)
def repeat_tile(spark, d):
    return batch.repeat(arrays(spark, d), 3, interleave=False).select("vec_id", "pos")


@query("SELECT vec_id, rep FROM (SELECT vec_id, unnest(range(label % 4)) AS rep FROM {a})", longs="rep", **A)
def sample_repeat(spark, d):
    return batch.repeat_by(arrays(spark, d).withColumn("n", F.col("label") % 4), "n").select("vec_id", "rep")


@query("SELECT vec_id, pos * 4 + i AS pos, array_to_string(e[i * 16 + 1:i * 16 + 16], ',') AS e FROM {a}, range(4) AS t(i)", longs="pos", **A)
def unfold_chunks(spark, d):
    return batch.unfold_chunks(arrays(spark, d), 4, ["e"]).select("vec_id", "pos", F.array_join("e", ",").alias("e"))


@query("SELECT pos // 5 AS pos, string_agg(vec_id, ',' ORDER BY pos) AS ids FROM {a} GROUP BY pos // 5", longs="pos", **A)
def fold(spark, d):
    return batch.fold(arrays(spark, d), 5, ["vec_id"]).select("pos", F.array_join("vec_id", ",").alias("ids"))


@query("SELECT pos, vec_id FROM {a}", longs="pos", **A)
def unfold(spark, d):
    return batch.unfold(batch.fold(arrays(spark, d), 5, ["vec_id"]), 5, ["vec_id"])


@query("SELECT vec_id, pos // ((SELECT count(*) FROM embeddings) // 4) AS chunk FROM {a}", longs="chunk", **A)
def chunk(spark, d):
    return batch.chunk(arrays(spark, d), 4, even=False).select("vec_id", "chunk")


@query("SELECT vec_id, pos // 64 AS part FROM {a}", longs="part", **A)
def split(spark, d):
    return batch.split(arrays(spark, d), 64).select("vec_id", "part")


@query("SELECT vec_id, pos // 64 AS batch FROM {a} WHERE pos // 64 < (SELECT count(*) FROM embeddings) // 64", longs="batch", **A)
def loader_batches(spark, d):
    return batch.batches(arrays(spark, d), 64).select("vec_id", "batch")


@query("SELECT epoch, b AS batch, count(*) AS n FROM (SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY pos) - 1) // 50 AS b FROM {a}, range(2) AS t(epoch)) GROUP BY epoch, b", longs="epoch batch n", **A)
def mini_batches(spark, d):
    return batch.mini_batches(arrays(spark, d), 50, 2).groupBy("epoch", "batch").agg(F.countDistinct("vec_id").alias("n"))


@query("WITH a AS (SELECT * FROM {a}), n AS (SELECT count(*) AS n, (96 - count(*) % 96) % 96 AS p FROM a) SELECT vec_id, pos, false AS padding FROM a UNION ALL SELECT vec_id, n + i, true FROM n, range((SELECT p FROM n)) AS t(i) JOIN a ON pos = i % (SELECT n FROM n)", longs="pos", **A)
def pad_divisor(spark, d):
    return batch.pad_to_divisor(arrays(spark, d), 96).select("vec_id", "pos", "padding")


@query("SELECT vec_id, pos FROM {a}", longs="pos", **A)
def unpad(spark, d):
    return batch.unpad(batch.pad_to_divisor(arrays(spark, d), 96)).select("vec_id", "pos")


@query("WITH a AS (SELECT * FROM {a}), n AS (SELECT count(*) AS n FROM a) SELECT vec_id, pos FROM a UNION ALL SELECT vec_id, n + i FROM a, n, range(5) AS t(i) WHERE pos = n - 1", longs="pos", **A)
def pad_boundary(spark, d):
    return batch.pad_boundary(arrays(spark, d), 5, first=False).select("vec_id", "pos")


@query("WITH a AS (SELECT * FROM {a}) SELECT vec_id, pos FROM a UNION ALL SELECT vec_id, (SELECT count(*) FROM a) + pos FROM a WHERE pos < 30", longs="pos", **A)
def concat(spark, d):
    rows = arrays(spark, d).select("vec_id", "pos")
    return batch.concat([rows, rows.filter("pos < 30")])


@query("SELECT vec_id, pos, label, len(e) AS width FROM {a}", longs="pos label width", **A)
def union_columns(spark, d):
    rows = arrays(spark, d)
    return batch.union_columns(rows.select("pos", "vec_id", "label"), rows.select("pos", "vec_id", F.size("e").alias("width")))


@query("SELECT vec_id, pos FROM {a}", longs="pos", **A)
def reorder_restore(spark, d):
    rows = arrays(spark, d).select("vec_id", "pos")
    back = rows.select(F.col("pos").alias("idx"), (F.lit(rows.count() - 1) - F.col("pos")).alias("out_pos"))
    return batch.restore(batch.reorder(rows, back), back)


@query("SELECT a.vec_id, b.label AS other FROM {a} a LEFT JOIN (SELECT pos, label FROM {a} WHERE pos < 100) b USING (pos)", longs="other", **A)
def zip_null(spark, d):
    rows = arrays(spark, d)
    return batch.zip_rows(rows.select("pos", "vec_id"), rows.filter("pos < 100").select("pos", F.col("label").alias("other"))).select("vec_id", "other")


@query("SELECT seq, pos, greatest(sum(mask) OVER (PARTITION BY seq ORDER BY pos) - 1, 0) AS position_id FROM {t}", longs="seq pos position_id", t=TOKENS)
def position_ids(spark, d):
    return batch.position_ids(views.tokens(spark, d), "seq").select("seq", "pos", "position_id")


@query("SELECT vec_id, CASE WHEN r % 2 = 0 THEN r // 2 ELSE (n + 1) // 2 + n // 2 - 1 - r // 2 END AS place FROM (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS r, count(*) OVER () AS n FROM {a})", longs="place", **A)
def interleave_ends(spark, d):
    return batch.interleave_ends(arrays(spark, d), "label", "vec_id").select("vec_id", "place")


@query("SELECT seq, pos, sum(c) OVER (PARTITION BY seq ORDER BY pos) AS run FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR mask = lag(mask) OVER w THEN 0 ELSE 1 END AS c FROM {t} WINDOW w AS (PARTITION BY seq ORDER BY pos))", longs="seq pos run", t=TOKENS)
def run_groups(spark, d):
    return batch.run_groups(views.tokens(spark, d), "seq", "mask").select("seq", "pos", "run")


@query("SELECT seq, pos, CASE WHEN pos = n - 1 THEN 1.5 ELSE 0 END AS token_reward FROM (SELECT seq, pos, count(*) OVER (PARTITION BY seq) - 1 AS n FROM {t})", "token_reward", "seq pos", t=TOKENS)
def place_reward(spark, d):
    from pyspark.sql import Window as W

    from quern.functions import tokens

    rows = views.tokens(spark, d).withColumns({"n": F.count("*").over(W.partitionBy("seq")) - 1, "r": F.lit(1.5)})
    return tokens.place_reward(rows, "r", "n").select("seq", "pos", "token_reward")


@query("SELECT name, step, value FROM {m} WHERE step IN (SELECT step FROM {m} INTERSECT SELECT 3)", "value", m=METRICS, digits=4)
def key_intersection(spark, d):
    rows = views.metrics(spark, d)
    return rows.join(rows.select("step").intersect(spark.createDataFrame([(3,)], "step long")), "step", "left_semi").select("name", "step", "value")


# --- tasks --------------------------------------------------------------------------------------------------------


@query("SELECT task_id, CASE WHEN task_type IN ('code_in', 'code_out') THEN coalesce(code <> '', false) ELSE coalesce(problem <> '', false) END AS ok FROM {k}", **K)
def proposal_split(spark, d):
    return views.tasks(spark, d).select("task_id", tasks.proposal_ok().alias("ok"))


@query("SELECT task_id, list_contains(detected_skill, CASE WHEN task_id % 4 = 0 THEN 'ECONOMY' ELSE skill END) AS ok FROM {k}", **K)
def skill_check(spark, d):
    rows = views.tasks(spark, d).withColumn("skill", F.when(F.col("task_id") % 4 == 0, "ECONOMY").otherwise(F.col("skill")))
    return rows.select("task_id", tasks.skill_ok().alias("ok"))


@query("SELECT task_id FROM {k} WHERE difficulty > 0.2 AND difficulty < 0.8", **K)
def difficulty_band(spark, d):
    return views.tasks(spark, d).filter(tasks.in_band("difficulty", 0.2, 0.8)).select("task_id")


_COMPLETE = "CASE WHEN task_type IN ('code_in', 'code_out') THEN code IS NOT NULL AND input IS NOT NULL AND output IS NOT NULL AND difficulty IS NOT NULL ELSE problem IS NOT NULL AND inputs IS NOT NULL AND outputs IS NOT NULL AND difficulty IS NOT NULL END"


@query(f"SELECT task_type, count(*) FILTER ({_COMPLETE}) AS kept, count(*) FILTER (NOT {_COMPLETE}) AS removed FROM {{k}} GROUP BY task_type", **K)
def task_clean(spark, d):
    return tasks.removed_counts(views.tasks(spark, d))


_PARTS = "(SELECT * FROM {k} WHERE difficulty <= 0.1) i, (SELECT * FROM {k} WHERE difficulty > 0.9) v"


def _invalid_valid(spark, d):
    rows = views.tasks(spark, d)
    return rows.filter("difficulty <= 0.1"), rows.filter("difficulty > 0.9")


@query("SELECT task_id, from_task, code, input, output FROM (SELECT i.task_id, v.task_id AS from_task, v.code, v.input, v.output, row_number() OVER (PARTITION BY i.task_id ORDER BY v.task_id) AS rn FROM " + _PARTS + " WHERE list_contains(v.detected_skill, i.skill)) WHERE rn = 1", **K)
def assign_invalid(spark, d):
    invalid, valid = _invalid_valid(spark, d)
    return tasks.assign_invalid(invalid, valid).select("task_id", "from_task", "code", "input", "output")


@query("SELECT s.skill, k.task_id AS combo_id FROM (SELECT DISTINCT skill FROM {k} WHERE task_id % 2 = 0) s, {k} k WHERE list_contains(k.detected_skill, s.skill)", **K)
def combos(spark, d):
    rows = views.tasks(spark, d)
    return tasks.combos_with(rows.filter("task_id % 2 = 0"), rows.select(F.col("task_id").alias("combo_id"), F.col("detected_skill").alias("skills")))


@query("SELECT array_to_string(list_sort(list_distinct(detected_skill)), '|') AS combo, min_by(code, task_id) AS code FROM {k} GROUP BY 1", **K)
def combo_first_code(spark, d):
    return tasks.first_by_combo(views.tasks(spark, d), "detected_skill", "code", "task_id").select(F.array_join("combo", "|").alias("combo"), "code")


@query("SELECT task_id FROM {k} WHERE code NOT IN (SELECT code FROM {k} WHERE task_id < 40)", **K)
def anti_code(spark, d):
    rows = views.tasks(spark, d)
    return tasks.without_code(rows, rows.filter("task_id < 40")).select("task_id")


@query("SELECT task_id FROM {k} WHERE skill IN (SELECT skill FROM {k} WHERE task_id < 3)", **K)
def semi_skill(spark, d):
    rows = views.tasks(spark, d)
    return tasks.of_skills(rows, rows.filter("task_id < 3")).select("task_id")


@query("SELECT DISTINCT category AS skill FROM {k} WHERE difficulty <= 0.02 EXCEPT SELECT category FROM {k} WHERE difficulty > 0.98", **K)
def diff_skills(spark, d):
    rows = views.tasks(spark, d).withColumn("skill", F.col("category"))
    return tasks.unsolved_skills(rows.filter("difficulty <= 0.02"), rows.filter("difficulty > 0.98"))


@query("SELECT task_id, skill, category, CASE WHEN input IS NULL OR output IS NULL THEN coalesce(CASE WHEN input IS NULL THEN 'no input' END, '') || '/' || coalesce(CASE WHEN output IS NULL THEN 'no output' END, '') || '/' || code END AS reject FROM {k}", **K)
def reject_struct(spark, d):
    rows = views.tasks(spark, d).withColumns({"reason": F.when(F.col("input").isNull(), "no input"), "feedback": F.when(F.col("output").isNull(), "no output")})
    part = lambda c: F.coalesce(F.col(f"reject.{c}"), F.lit(""))
    return tasks.rejects(rows).select("task_id", "skill", "category", F.when(F.col("reject").isNotNull(), F.concat(part("reason"), F.lit("/"), part("feedback"), F.lit("/"), part("code"))).alias("reject"))


@query("SELECT task_id, code || chr(10) || chr(10) || array_to_string(list_transform(inputs[1:2], lambda x, i: 'Hint ' || i || ': ' || x), chr(10)) AS problem FROM {k}", **K)
def hints(spark, d):
    rows = views.tasks(spark, d).withColumns({"problem": F.col("code"), "hints": F.col("inputs")})
    return tasks.add_hints(rows, 2).select("task_id", "problem")


@query("SELECT task_id, array_to_string(list_concat(inputs, [skill])[1:(len(inputs) + 1) // 2], ',') AS observed, array_to_string(list_concat(inputs, [skill])[(len(inputs) + 1) // 2 + 1:], ',') AS hidden FROM {k}", **K)
def observed_hidden(spark, d):
    rows = tasks.observed_hidden(views.tasks(spark, d).withColumn("x", F.concat("inputs", F.array("skill"))), "x")
    return rows.select("task_id", F.array_join("observed", ",").alias("observed"), F.array_join("hidden", ",").alias("hidden"))


@query("SELECT task_id, CASE WHEN task_type = 'code_func' THEN '[' || array_to_string(list_transform(list_zip(inputs, outputs)[len(inputs) // 2 + 1:], lambda p: '[\"' || p[1] || '\",\"' || p[2] || '\"]'), ',') || ']' ELSE output END AS truth FROM {k}", **K)
def ground_truth(spark, d):
    return views.tasks(spark, d).select("task_id", tasks.ground_truth().alias("truth"))


@query("SELECT task_id, CASE WHEN difficulty < 0.3 THEN 'easy' WHEN difficulty <= 0.6 THEN 'medium' ELSE 'hard' END AS level FROM {k}", **K)
def levels(spark, d):
    return views.tasks(spark, d).select("task_id", sampling.level("difficulty").alias("level"))


@query("SELECT level, least(count(*), 10) AS n FROM (SELECT CASE WHEN difficulty < 0.3 THEN 'easy' WHEN difficulty <= 0.6 THEN 'medium' ELSE 'hard' END AS level FROM {k}) GROUP BY level", longs="n", **K)
def level_samples(spark, d):
    return sampling.sample_by_level(views.tasks(spark, d), "difficulty", "task_id").groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT task_id FROM {k} ORDER BY task_id LIMIT 100", **K)
def max_samples(spark, d):
    return sampling.first_rows(views.tasks(spark, d), 100, "task_id").select("task_id")


@query("SELECT task_id FROM {k} ORDER BY md5(task_id || ':42'), task_id LIMIT 100", **K)
def max_samples_seeded(spark, d):
    return sampling.sample_rows(views.tasks(spark, d), 100, "task_id", 42).select("task_id")


@query("SELECT category, count(DISTINCT skill) AS n FROM {k} GROUP BY category", longs="n", **K)
def flatten_clusters(spark, d):
    members = views.tasks(spark, d).groupBy("category").agg(F.collect_set(F.struct("skill", F.col("skill").alias("description"))).alias("members"))
    return tasks.flatten_clusters(members).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(t, 'unknown') AS kind FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS t FROM events)")
def lookup_default(spark, d):
    rows = views.rollouts(spark, d).select("event_id", "uid")
    kinds = views.rollouts(spark, d).filter("task_type <> 'click'").groupBy("uid").agg(F.first("task_type").alias("kind"))
    return tasks.lookup(rows, kinds, "uid", "kind").select("event_id", "kind")


@query("SELECT task_id, skill || ': ' || category AS lines FROM {k}", **K)
def skill_strings(spark, d):
    rows = views.tasks(spark, d).withColumn("m", F.create_map("skill", "category"))
    return rows.select("task_id", tasks.skill_lines(rows, "m").alias("lines"))


@query("SELECT o_orderkey, status, CASE WHEN bad THEN -4 ELSE code END AS code FROM (SELECT *, max(code = -4) OVER (PARTITION BY status ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM (SELECT o_orderkey, o_orderpriority AS status, CASE WHEN o_orderkey % 1000 = 7 THEN -4 WHEN o_orderkey % 3 = 0 THEN -2 ELSE 1 END AS code FROM orders))", longs="code")
def sandbox_status(spark, d):
    from pyspark.sql import Window as W

    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("status"), F.when(F.col("o_orderkey") % 1000 == 7, -4).when(F.col("o_orderkey") % 3 == 0, -2).otherwise(1).alias("code"))
    before = W.partitionBy("status").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("code", F.when(F.coalesce(F.max(F.col("code") == -4).over(before), F.lit(False)), -4).otherwise(F.col("code")))


@query("SELECT event_id, 24576 * n + n * n AS cost FROM (SELECT event_id, CAST(response_length AS BIGINT) AS n FROM {r})", longs="cost", r=ROLLOUTS)
def workload(spark, d):
    return views.rollouts(spark, d).select("event_id", partition.workload(F.col("response_length").cast("long")).alias("cost"))


@query("SELECT event_type AS step, 8 AS parts, true AS ok FROM events GROUP BY event_type", longs="parts")
def balanced_partitions(spark, d):
    rows = views.rollouts(spark, d).withColumn("cost", partition.workload(F.col("response_length").cast("double")))
    parts = partition.balanced(rows.select("event_id", "task_type", "cost"), "cost", 8, "event_id", ["task_type"])
    sums = parts.groupBy("task_type", "part").agg(F.sum("cost").alias("s"), F.count("*").alias("n"))
    whole = table(spark, d, "events").groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("all"))
    steps = sums.groupBy(F.col("task_type").alias("step")).agg(F.count("*").alias("parts"), (F.max("s") - F.min("s") < 0.02 * F.avg("s")).alias("near"), F.sum("n").alias("n"))
    return steps.join(whole, "step").select("step", "parts", (F.col("near") & (F.col("n") == F.col("all"))).alias("ok"))


@query("SELECT event_id // 512 AS step, count(*) AS n, least(count(*), CAST(ceil(sum(response_length) / 4096.0) AS BIGINT)) AS parts, true AS near FROM {r} GROUP BY step", longs="step n parts", r=ROLLOUTS)
def micro_batches(spark, d):
    rows = views.rollouts(spark, d).select("event_id", "response_length", F.floor(F.col("event_id") / 512).alias("step"))
    parts = partition.micro_batches(rows, "response_length", "event_id", 4096, keys=["step"])
    own = parts.groupBy("step", "part").agg(F.sum("response_length").alias("t"), F.count("*").alias("n"))
    return own.groupBy("step").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), (F.max("t") - F.min("t") <= 0.1 * F.avg("t") + 20).alias("near"))


@query("SELECT o_orderkey AS k, CAST(o_custkey % 3 AS INT) AS n, sum(l) AS tokens FROM (SELECT o_orderkey, o_custkey, l_linenumber AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey, o_custkey", longs="n tokens")
def token_totals(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_linenumber").alias("tokens"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).alias("n")).join(li, "k")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.none') AS none FROM events", longs="k")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT event_id, ok FROM (SELECT event_id, list_contains([1, 2], user_id % 4) AS ok FROM events)")
def curriculum_valid(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when((F.col("user_id") % 4).isin(1, 2), F.lit('{"tasks":[{"code":"c","skill":["a","b"]}]}')).when(F.col("user_id") % 4 == 3, F.lit('{"tasks":[{"code":"c","skill":["a"," "]}]}')).otherwise(F.lit("no json")).alias("r"))
    return rows.select("event_id", text.curriculum_ok(F.from_json("r", text.CURRICULUM)["tasks"]).alias("ok"))



