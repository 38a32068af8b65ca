"""Queries over texts and token sequences: parsing, scoring, masks and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text, tokens
from quern.plans.registry import query
from quern.plans.views import table

# Wrapped texts: the fixtures have no tags or fences, so both sides add the same ones.
_RESPONSE = """SELECT doc_id, ['code_in', 'code_out', 'code_func'][doc_id % 3 + 1] AS task_type, CASE doc_id % 6 WHEN 0 THEN '<think>' || h || '</think> <answer>' || t || '</answer>'
 WHEN 1 THEN '<think>' || h || '</think>' || chr(10) || chr(10) || ' ' || chr(10) || '```output' || chr(10) || t || chr(10) || '```' WHEN 2 THEN h || '</think><answer>```python' || chr(10) || t || '```</answer>'
 WHEN 3 THEN '```input' || chr(10) || t || chr(10) || '```' WHEN 4 THEN 'so <output> ' || t || ' </output> and <output>' || h || '</output>' ELSE t END AS r, h, t FROM
 (SELECT doc_id, substr(text, 1, 40) AS h, replace(substr(text, 41), chr(10), ' ') AS t FROM documents)"""


def responses(spark, d):
    """Every whole text: its first 40 characters as h and the others, on one line, as t."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.substring("text", 1, 40).alias("h"), F.translate(F.substring("text", 41, 2**31 - 1), "\n", " ").alias("t"))
    h, t = F.col("h"), F.col("t")
    kinds = [
        F.concat(F.lit("<think>"), h, F.lit("</think> <answer>"), t, F.lit("</answer>")), F.concat(F.lit("<think>"), h, F.lit("</think>\n\n \n```output\n"), t, F.lit("\n```")),
        F.concat(h, F.lit("</think><answer>```python\n"), t, F.lit("```</answer>")), F.concat(F.lit("```input\n"), t, F.lit("\n```")), F.concat(F.lit("so <output> "), t, F.lit(" </output> and <output>"), h, F.lit("</output>")), t,
    ]
    order = F.element_at(F.array(F.lit("code_in"), F.lit("code_out"), F.lit("code_func")), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.select("doc_id", order.alias("task_type"), F.element_at(F.array(*kinds), (F.col("doc_id") % 6 + 1).cast("int")).alias("r"), "h", "t")


V = {"v": _RESPONSE}
_TRIM = "regexp_replace({}, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')"
_STRIPPED = _TRIM.format("regexp_replace(regexp_replace(r, '(?s)<think>.*?</think>', '', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, {_STRIPPED} AS out FROM {{v}}", **V)
def strip_think(spark, d):
    return responses(spark, d).select("doc_id", text.strip_think("r").alias("out"))


@query(f"SELECT doc_id, {_TRIM.format(chr(39).join(['regexp_replace(', '```json', ' || r || ', '```', ', ', '```json\\s*|\\s*```', ', ', '', ', ', 'g', ')']))} AS out FROM {{v}}", **V)
def strip_json(spark, d):
    rows = responses(spark, d)
    return rows.select("doc_id", text.strip_json(F.concat(F.lit("```json"), F.col("r"), F.lit("```"))).alias("out"))


@query(f"SELECT doc_id, CASE WHEN regexp_full_match({_TRIM.format('r')}, '(?s).*?</think>\\s*<answer>.*?</answer>') THEN 1.0 ELSE 0.0 END AS ok FROM {{v}}", "ok", **V)
def format_reward(spark, d):
    return responses(spark, d).select("doc_id", text.format_ok("r").alias("ok"))


def _first(x: str, p: str) -> str:
    return f"regexp_extract_all({x}, '{p}', 1)[1]"


def _last(x: str, p: str) -> str:
    return f"regexp_extract_all({x}, '{p}', 1)[-1]"


def _answer_sql() -> str:
    parts = []
    for kind, word in text.FENCES.items():
        fence = _TRIM.format(_first("s", f"(?is)```{word}\\s*\\n?(.*?)\\n?```"))
        if kind == "code_func":
            rest = _TRIM.format("s")
        else:  # the first fallback's lookahead isn't needed: the texts have no such comment
            rest = "coalesce(" + ", ".join(_last("s", p) for p in (f"(?is){word}\\s*\\((.*?)\\)", f"(?is)<{word}>\\s*(.*?)(?:</{word}>|\\s*$)", f"(?is)the {word} is\\s*(.*?)\\.?$")) + ", s)"
        parts.append(f"WHEN '{kind}' THEN coalesce({fence}, {rest})")
    space = f"coalesce({_first(_TRIM.format('r'), '(?is)<answer>\\s*(.*?)\\s*</answer>')}, {_STRIPPED})"
    return f"SELECT doc_id, CASE task_type {' '.join(parts)} END AS answer FROM (SELECT doc_id, task_type, {{space}} AS s FROM {{v}})".replace("{space}", space)


@query(_answer_sql(), **V)
def extract_answer(spark, d):
    return responses(spark, d).select("doc_id", text.extract_answer("r", "task_type", tagged=True).alias("answer"))


@query("SELECT doc_id, CASE WHEN ok <> 1 THEN -1 WHEN acc > 0 THEN acc ELSE -0.5 END AS reward FROM (SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 2) THEN 1 ELSE 0 END AS ok, CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 0 END AS acc FROM {v})", "reward", **V)
def task_reward(spark, d):
    rows = responses(spark, d)
    return rows.select("doc_id", text.task_reward(F.when(F.col("doc_id") % 4 == 0, 0.5).otherwise(0.0), text.format_ok("r")).alias("reward"))


_HINTS = "'```hint' || chr(10) || h || chr(10) || '```' || repeat('```hint' || chr(10) || t || '```', CAST(doc_id % 5 AS INT)) || '```hint  ```'"


@query(f"SELECT doc_id, CASE WHEN len(x) >= 3 THEN array_to_string(x[1:4], '|') END AS hints FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all({_HINTS}, '(?is)```hint\\s*\\n?(.*?)\\n?```', 1), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS x FROM {{v}})", **V)
def parse_hints(spark, d):
    one = lambda c: F.concat(F.lit("```hint\n"), F.col(c), F.lit("```"))
    message = F.concat(F.lit("```hint\n"), F.col("h"), F.lit("\n```"), F.repeat(one("t"), (F.col("doc_id") % 5).cast("int")), F.lit("```hint  ```"))
    return responses(spark, d).select("doc_id", F.array_join(text.parse_hints(message), "|").alias("hints"))


@query(f"SELECT doc_id, CASE WHEN len(x) >= 2 THEN array_to_string(x[-2:], '|') || '#' || {_TRIM.format('h')} END AS parsed FROM (SELECT doc_id, h, list_transform(regexp_extract_all(repeat('```input' || chr(10) || t || CAST(doc_id AS VARCHAR) || '```', CAST(doc_id % 4 AS INT)), '(?is)```input\\s*\\n?(.*?)\\n?```', 1), lambda x: {_TRIM.format('x')}) AS x FROM {{v}})", **V)
def parse_inputs(spark, d):
    message = F.concat(F.repeat(F.concat(F.lit("```input\n"), F.col("t"), F.col("doc_id").cast("string"), F.lit("```")), (F.col("doc_id") % 4).cast("int")), F.lit("<problem>"), F.col("h"), F.lit("</problem>"))
    p = text.parse_inputs(message, 2)
    return responses(spark, d).select("doc_id", F.when(p.isNotNull(), F.concat(F.array_join(p["inputs"], "|"), F.lit("#"), p["problem"])).alias("parsed"))


@query(f"SELECT doc_id, {_TRIM.format('split_part(h || chr(58) || t, chr(58), 1)')} AS error FROM {{v}}", **V)
def parse_error(spark, d):
    return responses(spark, d).select("doc_id", text.parse_error(F.concat(F.col("h"), F.lit(":"), F.col("t"))).alias("error"))


_CODE = "['# Test it', 'sample_input = 3', 'print (f(2))', 'x = f([1])', 'def f(x): return x', 'assert x', 'value = 1', ' input '][doc_id % 8 + 1]"


@query("SELECT doc_id, " + " OR ".join(f"regexp_matches(c, '(?m){p}')" for p in text.TEST_INPUT) + f" AS found FROM (SELECT doc_id, {_CODE} AS c FROM documents)")
def has_test_input(spark, d):
    codes = F.array(*map(F.lit, ["# Test it", "sample_input = 3", "print (f(2))", "x = f([1])", "def f(x): return x", "assert x", "value = 1", " input "]))
    return table(spark, d, "documents").select("doc_id", text.has_test_input(F.element_at(codes, (F.col("doc_id") % 8 + 1).cast("int"))).alias("found"))


_MATH = "h || ' #### ' || CAST(doc_id * 1234 AS VARCHAR) || ',0 and ' || CASE WHEN doc_id % 3 = 0 THEN '#### 7' ELSE '12.' END"


def _math():
    return F.concat(F.col("h"), F.lit(" #### "), (F.col("doc_id") * 1234).cast("string"), F.lit(",0 and "), F.when(F.col("doc_id") % 3 == 0, "#### 7").otherwise("12."))


@query(f"SELECT doc_id, regexp_replace(regexp_extract_all(m, '#### (-?[0-9.,]+)', 1)[-1], '[,$]', '', 'g') AS strict, list_filter(regexp_extract_all(m, '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.'))[-1] AS flexible FROM (SELECT doc_id, right({_MATH}, 300) AS m FROM {{v}})", **V)
def gsm8k(spark, d):
    return responses(spark, d).select("doc_id", text.gsm8k_answer(_math()).alias("strict"), text.gsm8k_answer(_math(), strict=False).alias("flexible"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[INVALID]' ELSE CAST(doc_id * 1000 AS VARCHAR) END AS pred, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 1.0 ELSE -1.0 END AS score FROM {v}", "score", **V)
def dapo_math(spark, d):
    answer = F.when(F.col("doc_id") % 2 == 0, F.col("t")).otherwise(F.concat(F.lit("x\nAnswer: x = $"), F.format_number(F.col("doc_id") * 1000, 0), F.lit("$ dollars")))
    r = text.dapo(answer, F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") * 1000).cast("string")).otherwise("none"))
    return responses(spark, d).select("doc_id", r["pred"].alias("pred"), r["score"].alias("score"))


# an article's end may be the next one's beginning, so they go in two rounds
_WORD = "'(^|[^\\p{{L}}\\p{{N}}_])(?:a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g'"
_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({{}}), '[!-/:-@\\[-`{{{{-~]', '', 'g'), {_WORD}), {_WORD}), '\\s+', ' ', 'g'))"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"SELECT doc_id, CASE WHEN {_NORM.format('t')} = {_NORM.format('g')} THEN 1.0 ELSE 0.0 END AS em, CASE WHEN contains({_NORM.format('t')}, {_NORM.format('g')}) THEN 1.0 ELSE 0.0 END AS sub_em FROM (SELECT doc_id, t, CASE WHEN doc_id % 2 = 0 THEN translate(t, '{_LOWER}', '{_UPPER}') || '!' ELSE split_part(t, ' ', 3) END AS g FROM {{v}})", "em sub_em", **V)
def qa_em(spark, d):
    golds = F.array(F.when(F.col("doc_id") % 2 == 0, F.concat(F.translate("t", _LOWER, _UPPER), F.lit("!"))).otherwise(F.element_at(F.split(F.concat(F.col("t"), F.lit("  ")), " "), 3)))
    said = F.concat(F.lit("<answer>x</answer><answer>"), F.col("t"), F.lit("</answer>"))
    return responses(spark, d).select("doc_id", text.qa_score(said, golds).alias("em"), text.qa_score(said, golds, inside=True).alias("sub_em"))


@query("SELECT doc_id, least(-(n - (1500 - 400)) / 400.0, 0) AS penalty FROM (SELECT doc_id, n_chars AS n FROM documents)", "penalty")
def overlong(spark, d):
    return table(spark, d, "documents").select("doc_id", text.overlong(F.col("n_chars"), 1500, 400).alias("penalty"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'exact' WHEN doc_id % 3 = 1 THEN 'lines' ELSE 'none' END AS how FROM {v}", **V)
def compare_output(spark, d):
    t = F.concat(F.lit("w "), F.col("t"))
    gold = F.when(F.col("doc_id") % 3 == 0, t).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n "), t, F.lit("\n\n"))).otherwise("other")
    return responses(spark, d).select("doc_id", text.compare_output(t, gold).alias("how"))


@query("SELECT doc_id, lower(x) IN ('true', '1', 'yes', 'y') OR coalesce(TRY_CAST(x AS DOUBLE) <> 0, false) AS b FROM (SELECT doc_id, ['True', '0', 'no', 'Yes', '2.5', 'y', ''][doc_id % 7 + 1] AS x FROM documents)")
def to_bool(spark, d):
    x = F.element_at(F.array(*map(F.lit, ["True", "0", "no", "Yes", "2.5", "y", ""])), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.to_bool(x).alias("b"))


@query("SELECT vec_id, vec_id % 2 = 0 AS near FROM embeddings")
def arrays_close(spark, d):
    e = table(spark, d, "embeddings").withColumn("a", F.col("embedding").cast("array<double>"))
    other = F.transform("a", lambda x: x + F.when(F.col("vec_id") % 2 == 0, 1e-10).otherwise(0.5))
    return e.select("vec_id", text.close(F.col("a"), other).alias("near"))


@query("SELECT event_id, CASE WHEN data_source = 'src0' THEN score / 10 WHEN data_source = 'src1' THEN acc ELSE 0.9 * acc + 0.1 END AS score FROM (SELECT event_id, value AS score, CAST(value > 150 AS DOUBLE) AS acc, 'src' || CAST(user_id % 3 AS VARCHAR) AS data_source FROM events)", "score")
def score_dispatch(spark, d):
    from quern.plans import views

    acc = F.col("acc")
    return views.rollouts(spark, d).select("event_id", text.by_source("data_source", {"src0": F.col("score") / 10, "src1": acc, "src2": text.geo3k(acc, F.lit(1.0))}).alias("score"))


# --- tokens: one id per word, the word's length (so that both engines agree without a vocabulary) ----------------------

_IDS = "SELECT conv_id, turn, role, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: CAST(length(x) AS INT)) AS ids FROM conversations"
C = {"c": _IDS}


def ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.transform(tokens.words("text"), F.length).alias("ids"))


_CSV = lambda x: f"array_to_string({x}, ',')"


def _csv(c):
    return F.array_join(c, ",")


@query(f"SELECT conv_id, turn, {_CSV('list_concat(ids[1:32], repeat([0], 32 - len(ids[1:32])))')} AS right_, {_CSV('list_concat(repeat([0], 32 - len(ids[-32:])), ids[-32:])')} AS left_, {_CSV('CASE WHEN len(ids) > 32 THEN list_concat(ids[1:16], ids[-16:]) ELSE ids END')} AS middle FROM {{c}}", **C)
def pad_truncate(spark, d):
    return ids(spark, d).select("conv_id", "turn", _csv(tokens.pad_or_truncate("ids", 32)).alias("right_"), _csv(tokens.pad_or_truncate("ids", 32, left=True, how="left")).alias("left_"), _csv(tokens.truncate("ids", 32, "middle")).alias("middle"))


@query(f"SELECT conv_id, turn, {_CSV('list_transform(ids, lambda x, i: CASE WHEN p IS NULL OR p = 0 OR i <= p THEN 1 ELSE 0 END)')} AS mask FROM (SELECT *, list_position(list_transform(ids, lambda x: x IN (7, 9)), true) AS p FROM {{c}})", **C)
def eos_mask(spark, d):
    return ids(spark, d).select("conv_id", "turn", _csv(tokens.until_stop("ids", [7, 9])).alias("mask"))


_PAIR = "SELECT a.conv_id, a.turn, a.ids AS p, b.ids AS r FROM {c} a JOIN {c} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def pairs(spark, d):
    x = ids(spark, d)
    return x.select("conv_id", "turn", F.col("ids").alias("p")).join(x.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("r")), ["conv_id", "turn"])


@query(f"SELECT conv_id, turn, {_CSV('list_concat(x[1:64], repeat([0], 64 - len(x[1:64])))')} AS input_ids, {_CSV('list_transform(range(64), lambda i: CASE WHEN i < least(len(x), 64) THEN 1 ELSE 0 END)')} AS attention_mask, {_CSV('list_transform(range(64), lambda i: CASE WHEN i >= len(p) - 1 AND i < least(len(x), 64) - 1 THEN 1 ELSE 0 END)')} AS loss_mask FROM (SELECT *, list_concat(p, r, [99]) AS x FROM ({_PAIR}))", **C)
def sft_mask(spark, d):
    s = tokens.sft_row("p", "r", 99, 64)
    return pairs(spark, d).select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", *(_csv(f"s.{c}").alias(c) for c in ("input_ids", "attention_mask", "loss_mask")))


@query(f"SELECT conv_id, turn, {_CSV('list_concat(x[1:48], repeat([0], 48 - len(x[1:48])))')} AS chosen, {_CSV('list_concat(y[1:48], repeat([0], 48 - len(y[1:48])))')} AS rejected FROM (SELECT conv_id, turn, list_concat(p, r, [99]) AS x, list_concat(p, p, [99]) AS y FROM ({_PAIR}))", **C)
def pref_pairs(spark, d):
    s = tokens.preference_pair("p", "r", "p", 99, 48)
    return pairs(spark, d).select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", _csv(F.col("s")[0]).alias("chosen"), _csv(F.col("s")[1]).alias("rejected"))


@query("SELECT conv_id, turn, e - n AS start, e AS end, CASE WHEN role = 'assistant' THEN greatest(n - 2, 0) ELSE 0 END AS loss_tokens FROM (SELECT *, len(ids) AS n, sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM {c})", longs="start end loss_tokens", **C)
def multiturn_mask(spark, d):
    return tokens.turn_masks(ids(spark, d).withColumn("n_tokens", F.size("ids").cast("long"))).select("conv_id", "turn", "start", "end", "loss_tokens")


@query("SELECT conv_id, bool_and(coalesce(CASE role WHEN 'system' THEN n = 1 WHEN 'user' THEN l IS NULL OR l IN ('system', 'assistant') WHEN 'assistant' THEN l = 'user' END, false)) AS ok FROM (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS l FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id")
def role_order(spark, d):
    return tokens.role_order_ok(table(spark, d, "conversations"))


@query("SELECT conv_id, turn FROM {c} WHERE len(ids) <= 20", **C)
def length_filter(spark, d):
    return ids(spark, d).filter(tokens.not_too_long("ids", 20)).select("conv_id", "turn")


@query("SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations)", longs="id")
def vocabulary(spark, d):
    return tokens.vocabulary(table(spark, d, "conversations").select(tokens.words("text").alias("w")), "w")


@query(f"SELECT conv_id, turn, {_CSV('ids')} AS input_ids, {_CSV('list_transform(range(len(ids)), lambda i: CASE WHEN i >= len(ids) - least(len(ids), 5) THEN 1 ELSE 0 END)')} AS loss_mask FROM {{c}} WHERE len(ids) BETWEEN 1 AND 40", **C)
def ragged(spark, d):
    rows = ids(spark, d).filter(F.size("ids").between(1, 40))
    padded = rows.select("conv_id", "turn", tokens.pad("ids", 40, left=True).alias("a"), tokens.ones(F.size("ids"), 40, left=True).alias("m"), F.least(F.size("ids"), F.lit(5)).alias("r"))
    return padded.select("conv_id", "turn", tokens.ragged("a", "m", "r").alias("s")).select("conv_id", "turn", _csv("s.input_ids").alias("input_ids"), _csv("s.loss_mask").alias("loss_mask"))


@query(f"SELECT conv_id, turn, {_CSV('list_concat(repeat([0], 16 - len(p[-16:])), p[-16:], r[1:24], repeat([0], 24 - len(r[1:24])))')} AS input_ids, list_sum(list_transform(r[1:24], lambda x, i: CASE WHEN coalesce(q, 0) = 0 OR i <= q THEN 1 ELSE 0 END)) AS response_length FROM (SELECT *, list_position(list_transform(r[1:24], lambda x: x = 9), true) AS q FROM ({_PAIR}))", longs="response_length", **C)
def rollout_rows(spark, d):
    s = tokens.rollout_row("p", "r", [9], 16, 24)
    own = pairs(spark, d).select("conv_id", "turn", s.alias("s"))
    return own.select("conv_id", "turn", _csv("s.input_ids").alias("input_ids"), F.nullif(F.aggregate("s.response_mask", F.lit(0), lambda a, x: a + x), F.lit(0)).alias("response_length"))
