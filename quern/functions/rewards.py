"""Rewards: a registry of scorers, scoring by test cases, and managers that place rewards on tokens."""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import code, mathgrade, text, tokens

Scorer = Callable[..., Column]
_SCORERS: dict[str, Scorer] = {}
_MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def _register(table: dict, name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if table.get(name, f) is not f:
            raise ValueError(f"another function has the name {name}")
        table[name] = f
        return f

    return add


def register_scorer(name: str) -> Callable:
    """Register a scorer (response, gold, **options) -> Column under a data source's name."""
    return _register(_SCORERS, name)


def register_manager(name: str) -> Callable:
    return _register(_MANAGERS, name)


def _get(table: dict, name: str) -> Callable:
    if name not in table:
        raise ValueError(f"nothing has the name {name}; there are {sorted(table)}")
    return table[name]


def scorer(name: str) -> Scorer:
    return _get(_SCORERS, name)


def manager(name: str) -> Callable[..., DataFrame]:
    return _get(_MANAGERS, name)


register_scorer("gsm8k")(lambda response, gold, **o: text.gsm8k(response, gold, **o))
register_scorer("math")(lambda response, gold: mathgrade.boxed_score(response, gold))
register_scorer("dapo")(lambda response, gold: text.dapo(response, gold)["score"])
register_scorer("qa")(lambda response, gold, **o: text.qa_score(response, F.array(gold), **o))
register_scorer("geo")(lambda response, gold: text.geo3k(F.coalesce(mathgrade.equivalent(mathgrade.boxed_answer(response), gold).cast("double"), F.lit(0.0)), F.when(response.rlike(r"(?s)\A.*<think>.*</think>.*\\boxed\{.*\}.*\z"), 1.0).otherwise(0.0)))
register_scorer("numbers")(lambda response, gold: mathgrade.grade(mathgrade.stated_answer(response)["answer"], gold).cast("double"))


def score(df: DataFrame, names: list[str], source: str = "data_source", response: str = "response", gold: str = "ground_truth") -> DataFrame:
    """df with ``score`` by the scorer that its data source names; another source raises."""
    return df.withColumn("score", text.by_source(source, {n: scorer(n)(F.col(response), F.col(gold)) for n in names}))


def load_scorer(path: str, name: str, **options) -> Scorer:
    """The function ``name`` of a Python file, (responses, golds, **options) -> scores over pandas series, as a scorer.

    The file is read on the driver and its source goes to the workers, so they need no access to the path."""
    with open(path) as f:
        source = f.read()
    spec = importlib.util.spec_from_loader("scorer", loader=None)
    module = importlib.util.module_from_spec(spec)
    exec(compile(source, path, "exec"), module.__dict__)  # noqa: S102  the caller's own file
    if name not in module.__dict__:
        raise AttributeError(f"{path} has no {name}")
    known = inspect.signature(module.__dict__[name]).parameters
    given = {k: v for k, v in options.items() if k in known or any(p.kind is p.VAR_KEYWORD for p in known.values())}

    def run(responses: pd.Series, golds: pd.Series) -> pd.Series:
        scope: dict = {"__name__": "scorer"}
        exec(compile(source, "scorer", "exec"), scope)  # noqa: S102
        return pd.Series(scope[name](responses, golds, **given)).astype(float)

    return lambda response, gold, **_: F.pandas_udf(run, "double")(response, gold)


# --- test cases ---------------------------------------------------------------------------------------------------


def run_cases(source: str, inputs: list[str], outputs: list[str], function: str | None, most: int | None = None, seconds: int = 10) -> list[int]:
    """1 or 0 of each case (of the first ``most``, if given), -1 where it failed to run, -2 if the code doesn't load. With a function its arguments
    are the lines of an input, and results are compared as literals; without one the program reads the input and prints."""
    cases = list(zip(inputs[:most], outputs[:most], strict=False))
    if code._tree(source) is None:
        return [-2] * len(cases)
    if function:
        found = code.execute(source, [f"{function}({', '.join(i.strip().splitlines())})" for i, _ in cases], seconds)
        return [int(code.same_literals(o, r)) if ok else -1 for (_, o), (ok, r) in zip(cases, found, strict=True)]
    out = []
    for given, want in cases:
        found = code.run_program(source, given, seconds)
        out.append(-1 if found is None else int(_same_lines(found, want)))
    return out


def _same_lines(said: object, want: str) -> bool:
    lines = lambda x: [y.strip() for y in str(x).strip().split("\n") if y.strip()]
    a, b = lines(said), lines(want)
    if a == b:
        return True
    try:
        x, y = ([float(w) for line in z for w in line.split()] for z in (a, b))
    except ValueError:
        return False
    return len(x) == len(y) and all(abs(p - q) <= 1e-8 + 1e-5 * abs(q) for p, q in zip(x, y, strict=True))


def case_results(source: Column, inputs: Column, outputs: Column, function: Column, most: int | None = None, seconds: int = 10) -> Column:
    """The results of the cases (array<int>)."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([run_cases(x or "", list(y), list(z), w, most, seconds) if y is not None and z is not None else [] for x, y, z, w in zip(a, b, c, d, strict=True)])

    return F.pandas_udf(run, "array<int>")(source, inputs, outputs, function)


def settle_status(results: Column) -> Column:
    """After the first compile error (-4) all later results are -4."""
    first = F.array_position(results, -4)
    return F.transform(results, lambda x, i: F.when((first > 0) & (i >= first - 1), -4).otherwise(x))


def passed_part(results: Column) -> Column:
    """The part of the cases with the result 1; 0 without a case."""
    return F.coalesce(F.try_divide(F.size(F.filter(results, lambda x: x == 1)).cast("double"), F.size(results).cast("double")), F.lit(0.0))


def program(response: Column) -> Column:
    """The last fenced Python block, or all of it."""
    return F.coalesce(text.last_match(response, r"(?s)```python\s*\n?(.*?)\n?```"), response)


# --- managers -----------------------------------------------------------------------------------------------------


def _placed(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per token of each response, with its reward at the last valid one; scores that are there already stay."""
    rows = df.withColumn("__score", F.coalesce(F.col("rm_scores"), F.col("score")) if "rm_scores" in df.columns else F.col("score"))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.greatest(F.col("response_length") - 1, F.lit(0)))))
    return tokens.place_reward(rows, "__score", "response_length").select("uid", "sample_idx", "pos", "token_reward", *keep)


@register_manager("naive")
def naive(df: DataFrame, names: list[str], **_) -> DataFrame:
    return _placed(score(df, names), ["score"])


@register_manager("batch")
def batch(df: DataFrame, names: list[str], **_) -> DataFrame:
    return naive(df, names)


@register_manager("prime")
def prime(df: DataFrame, names: list[str], **_) -> DataFrame:
    """Failures count 0."""
    return _placed(score(df, names).withColumn("score", F.coalesce("score", F.lit(0.0))), ["score"])


@register_manager("dapo")
def dapo(df: DataFrame, names: list[str], longest: int = 0, buffer: int = 0, factor: float = 1.0, **_) -> DataFrame:
    """With the penalty of overlong responses; the raw reward and whether a penalty fell are kept."""
    rows = score(df, names).withColumn("reward_raw", F.col("score"))
    penalty = text.overlong(F.col("response_length"), longest, buffer, factor) if buffer else F.lit(0.0)
    rows = rows.withColumn("overlong_reward", penalty).withColumn("score", F.col("score") + F.col("overlong_reward"))
    return _placed(rows.withColumn("overlong", F.col("overlong_reward") < 0), ["reward_raw", "overlong_reward", "overlong"])
