"""The task synthesis loop: propose, parse, verify, reject and try again; mutate, cross, induce; clean and publish.

Proposals and attempts come from a responder, any function from a frame with ``prompt`` to the frame with ``response``. Each trial
is one plan over frames whose result is cut off by a checkpoint in the shared folder, so retries neither recompute earlier
trials nor lose them with an executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import code, text
from quern.operators import tasks
from quern.operators.lineage import cut as _cut

Responder = Callable[[DataFrame], DataFrame]

#: Our wording of the prompts: what a task of a type is, and what is asked for in a mode; the braces name columns.
_TYPES = {
    "code_out": "Write one function f that exercises the skill {skill} ({skill_description}), with an input and its output.",
    "code_in": "Write one function f that exercises the skill {skill} ({skill_description}), with an input and its output; a reader will be asked for the input.",
    "code_func": "State a problem whose answer is a function that needs the skill {skill} ({skill_description}), with several inputs.",
}
_MODES = {
    "init": "",
    "iterative": " An earlier try was rejected: {failure} Its code was {code}. Write a better one.",
    "mutate": " Make harder variants of this code along {attributes}, as one JSON object by variant: {code}",
    "crossover": " Combine it with the skills {skills} and this code, as one JSON object: {code}",
    "curriculum": " Given this record, {profile}, propose the next tasks as a JSON object with the list tasks.",
    "hint": " Give three or four hints, each in its own block, for the problem: {problem}",
}
PROMPTS = {(kind, mode): what + how for kind, what in _TYPES.items() for mode, how in _MODES.items()}
BANNED_NOTE = " Don't use: {banned}."
#: What a reader is asked: to predict, or to name the skills that were used.
PREDICT = {"code_out": "What does f({input}) give? {code}", "code_in": "Which input of f gives {output}? {code}", "code_func": "Find the function: {problem}"}
REFLECT = "Which skill does this code need most, and which others? Answer as JSON with main_skill and other_skills. {code}"
#: Failures by their kind.
FAILURES = {"not well formed": "the answer's blocks could not be read.", "did not run": "the code failed or was not deterministic: {feedback}", "too easy": "most readers solved it.", "too hard": "hardly any reader solved it.", "skill not used": "the code does not need the skill."}


def render(template: str, columns: list[str]) -> Column:
    """The template with its braces replaced by columns; a null is empty."""
    out = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def _plain(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("string", "bigint", "double", "int")]


def prompts(df: DataFrame, task_type: str, mode: str, banned: list[str] | None = None) -> DataFrame:
    """df with ``prompt``."""
    if (task_type, mode) not in PROMPTS:
        raise ValueError(f"no prompt for {task_type} {mode}")
    template = PROMPTS[task_type, mode] + (BANNED_NOTE.replace("{banned}", ", ".join(banned)) if banned else "")
    return df.withColumn("prompt", render(template, _plain(df)))


def questions(df: DataFrame) -> DataFrame:
    """df with ``prompt``: what a reader of the row's task type is asked."""
    out = F.lit(None).cast("string")
    for kind, template in PREDICT.items():
        out = F.when(F.col("task_type") == kind, render(template, _plain(df))).otherwise(out)
    return df.withColumn("prompt", out)


def reflections(df: DataFrame) -> DataFrame:
    """df with ``prompt``: which skills its code needs."""
    return df.withColumn("prompt", render(REFLECT, _plain(df)))


def failures(df: DataFrame) -> DataFrame:
    """df with ``failure``: its reason in words; an unknown reason as it stands."""
    out = F.coalesce(F.col("reason"), F.lit(""))
    for reason, template in FAILURES.items():
        out = F.when(F.col("reason") == reason, render(template, _plain(df))).otherwise(out)
    return df.withColumn("failure", out)


def skill_list(df: DataFrame, limit_text: str = "\n") -> DataFrame:
    """(category, skills): a category's skills with their descriptions, one a line in the order of their names."""
    lines = F.sort_array(F.collect_set(F.concat("skill", F.lit(": "), F.coalesce("skill_description", F.lit("")))))
    return df.groupBy("category").agg(F.array_join(lines, limit_text).alias("skills"))


def performance_profile(df: DataFrame) -> DataFrame:
    """(task_type, profile): mean difficulty and count by level, as a line of text."""
    own = df.groupBy("task_type").agg(F.avg("difficulty").alias("m"), F.count("*").alias("n"))
    return own.select("task_type", F.format_string("%s: %d tasks, mean success %.2f", "task_type", "n", "m").alias("profile"))


def mock_responder(seed: int = 0, miss: int = 4) -> Responder:
    """Deterministic answers: code whose shape depends on a hash of the prompt; one of ``miss`` is malformed."""

    def answer(df: DataFrame) -> DataFrame:
        h = F.pmod(F.xxhash64("prompt", F.lit(seed)), F.lit(1_000_000)).cast("long")
        good = F.concat(F.lit("```python\ndef g(x):\n    # it\n    return x + "), (h % 97).cast("string"), F.lit("\n```\n```input\n"), (h % 11).cast("string"), F.lit("\n```\n```output\n"), (h % 97 + h % 11).cast("string"), F.lit("\n```"))
        return df.withColumn("response", F.when(h % miss == 0, F.lit("no code today")).otherwise(good))

    return answer


def propose(pool: DataFrame, task_type: str, responder: Responder, mode: str = "init") -> DataFrame:
    """The pool with the parsed task; code is null where the response isn't well formed."""
    said = responder(prompts(pool, task_type, mode))
    parsed = said.drop("code", "input", "output", "imports").withColumn("t", code.parse_task_col(F.col("response"), comments=False))
    return parsed.select(*[c for c in parsed.columns if c not in ("t", "prompt", "response")], "t.*").withColumn("task_type", F.lit(task_type))


def solve(df: DataFrame, attempts: int, right: Column) -> DataFrame:
    """(task_id, difficulty): the part of the attempts that are right. right: a condition over the task and ``attempt``."""
    rows = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    return rows.groupBy("task_id").agg(F.avg(right.cast("double")).alias("difficulty"))


def verify(df: DataFrame, banned: list[str], attempts: int, right: Column, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): proposals that have code, run, and are solved more often than ``low`` and less often than ``high``. A proposal
    whose skill wasn't detected is invalid and goes on as well. Cheap checks come first, and code runs only on what is left, once for
    each different code and input."""
    proposed = _cut(df)
    valid, invalid = tasks.split_proposals(proposed)
    unskilled = valid.filter(~tasks.skill_ok()).withColumn("reason", F.lit("skill not used"))
    ran = _cut(code.once(valid, ["code", "input"], code.gate_col(F.col("code"), F.col("input"), banned), "g"))
    alive = ran.filter("g.ok").withColumn("output", F.col("g.result")).drop("g", "difficulty")
    dead = ran.filter(~F.coalesce(F.col("g.ok"), F.lit(False))).withColumn("reason", F.lit("did not run")).drop("g")
    scored = _cut(alive.join(solve(alive, attempts, right), "task_id"))
    kept = scored.filter(tasks.in_band("difficulty", low, high))
    off = scored.filter(~tasks.in_band("difficulty", low, high)).withColumn("reason", F.when(tasks.too_hard("difficulty", low), "too hard").otherwise("too easy"))
    rest = invalid.withColumn("reason", F.lit("not well formed"))
    for part in (unskilled, dead, off):
        rest = rest.unionByName(part, allowMissingColumns=True)
    return kept, rest


def until_valid(pool: DataFrame, task_type: str, responder: Callable[[int], Responder], banned: list[str], right: Column, trials: int = 4, attempts: int = 10, low: float = 0.1, high: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(valid, skills that stayed unsolved) after up to ``trials`` rounds; each round asks again for skills without a valid task."""
    open_, found = pool, None
    for trial in range(trials):
        kept, _ = verify(propose(open_, task_type, responder(trial)), banned, attempts, right, low, high)
        kept = _cut(kept)
        found = kept if found is None else found.unionByName(kept, allowMissingColumns=True)
        open_ = _cut(pool.join(found.select("skill").distinct(), "skill", "left_anti"))
        if open_.isEmpty():
            break
    return found, open_


def mutations(df: DataFrame, response: str = "response") -> DataFrame:
    """One row per variant of a JSON response that maps variants to tasks; responses with a variant without code give none."""
    rows = df.withColumn("__m", F.from_json(response, text.MUTATIONS))
    whole = F.coalesce((F.size("__m") > 0) & F.forall(F.map_values("__m"), lambda v: F.coalesce(v["code"], F.lit("")) != ""), F.lit(False))
    return rows.filter(whole).select(*df.columns, F.explode("__m").alias("variant", "v")).select(*[c for c in df.columns if c not in ("code", "input", "description", "complexity_attributes")], "variant", "v.*")


def crossover(df: DataFrame, response: str = "response") -> DataFrame:
    """The task of a JSON response; without code none."""
    rows = df.withColumn("v", F.from_json(response, text.CROSSOVER)).filter(F.coalesce(F.col("v.code"), F.lit("")) != "")
    return rows.select(*[c for c in df.columns if c not in ("code", "input", "skill_combination", "crossover_description")], "v.*")


def curriculum(df: DataFrame, response: str = "response") -> DataFrame:
    """One row per task of a JSON response that is valid as a whole, with detected_skill."""
    rows = df.withColumn("__t", F.from_json(response, text.CURRICULUM)["tasks"]).filter(text.curriculum_ok(F.col("__t")))
    return rows.select(*[c for c in df.columns if c not in ("code", "input", "reasoning", "detected_skill", "skill")], F.explode("__t").alias("t")).select("*", F.col("t.skill").alias("detected_skill"), "t.code", "t.input", "t.reasoning").drop("t")


def hint_ladder(df: DataFrame, judge: Callable[[DataFrame], DataFrame], low: float, levels: int = 4) -> DataFrame:
    """Tasks that are too hard are asked again with one more hint, up to all. judge gives (task_id, difficulty). The result has
    ``hints_used`` and the difficulty at the first level above ``low``."""
    open_, out = df, None
    for n in range(1, levels + 1):
        scored = _cut(open_.drop("difficulty").join(judge(tasks.add_hints(open_, n)), "task_id").withColumn("hints_used", F.lit(n)))
        solved = scored.filter(~tasks.too_hard("difficulty", low))
        out = solved if out is None else out.unionByName(solved)
        open_ = scored.filter(tasks.too_hard("difficulty", low)).drop("hints_used")
    return out


def publish(frames: list[DataFrame]) -> DataFrame:
    """All complete records."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return tasks.clean(rows)
