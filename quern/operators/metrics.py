"""Metrics over rollouts and tokens: one-row statistics, grouped reports, validation at N, timing and control."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.batch import positions


def long_form(row: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, name, value) of numeric columns."""
    keys = keys or []
    names = [c for c in row.columns if c not in keys]
    return row.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names))).alias("m")).select(*keys, "m.name", "m.value")


def per_source_mean(df: DataFrame, group: str = "uid", source: str = "data_source", score: str = "score") -> DataFrame:
    """(source, mean_score, n): the mean over groups of their mean score."""
    own = df.groupBy(source, group).agg(F.avg(score).alias("m"))
    return own.groupBy(source).agg(F.avg("m").alias("mean_score"), F.count("*").alias("n"))


def pass_rate(df: DataFrame, keys: list[str], attempt: str, score: str = "acc") -> DataFrame:
    """(keys, pass_rate): the mean over attempts of each attempt's mean."""
    own = df.groupBy(*keys, attempt).agg(F.avg(score).alias("m"))
    return own.groupBy(*keys).agg(F.avg("m").alias("pass_rate"))


def group_statistics(df: DataFrame, group: str = "uid", score: str = "score", eps: float = 1e-6) -> DataFrame:
    """(group, mean, std, n): a single row has mean 0 and deviation 1; the variance is floored at eps."""
    n = F.count("*")
    return df.groupBy(group).agg(F.when(n == 1, 0.0).otherwise(F.avg(score)).alias("mean"), F.when(n == 1, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp(score), F.lit(eps)))).alias("std"), n.alias("n"))


def group_index(df: DataFrame, group: str = "uid") -> DataFrame:
    """df with ``gid``: groups numbered from 0 in the order of their names. Different names alone are numbered, range by range, then joined."""
    return df.join(positions(df.select(group).distinct(), group, pos="gid"), group)


def _ends(c: Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}/mean"), F.max(c).alias(f"{name}/max"), F.min(c).alias(f"{name}/min")]


def rollout_metrics(df: DataFrame, max_response: int, max_prompt: int) -> DataFrame:
    """(name, value): scores of responses that aren't empty, lengths, clipping and the part of empty responses."""
    some = F.col("response_length") > 0
    length, prompt = F.col("response_length").cast("double"), F.col("prompt_length").cast("double")
    full = lambda c, most: F.avg((c == most).cast("double"))
    row = df.agg(
        *_ends(F.when(some, F.col("score")), "critic/score"), *_ends(F.when(some, F.col("acc")), "critic/rewards"), *_ends(length, "response_length"), full(length, max_response).alias("response_length/clip_ratio"),
        *_ends(F.when(some, length), "response_length_non_aborted"), F.avg(F.when(some, (length == max_response).cast("double"))).alias("response_length_non_aborted/clip_ratio"),
        F.avg((~some).cast("double")).alias("response/aborted_ratio"), *_ends(prompt, "prompt_length"), full(prompt, max_prompt).alias("prompt_length/clip_ratio"),
    )
    return long_form(row)


def token_metrics(df: DataFrame, adv: str = "adv", ret: str = "ret", value: str = "value") -> DataFrame:
    """(name, value): advantages, returns, values and the explained variance over valid tokens."""
    v = df.filter("mask = 1")
    explained = 1 - F.var_samp(F.col(ret) - F.col(value)) / (F.var_samp(ret) + 1e-5)
    return long_form(v.agg(*_ends(F.col(adv), "critic/advantages"), *_ends(F.col(ret), "critic/returns"), *_ends(F.col(value), "critic/values"), explained.alias("critic/vf_explained_var")))


def per_task_metrics(df: DataFrame, task: str = "task_type", score: str = "score", raw: str = "acc") -> DataFrame:
    """(task, ...): score and raw reward by task type; empty responses don't count, an empty type is unknown."""
    name = F.coalesce(F.nullif(F.col(task), F.lit("")), F.lit("unknown"))
    return df.filter("response_length > 0").groupBy(name.alias("task")).agg(
        F.avg(score).alias("mean"), F.max(score).alias("max"), F.min(score).alias("min"), F.count("*").alias("n"), F.avg(raw).alias("raw_mean"), F.max(raw).alias("raw_max"), F.min(raw).alias("raw_min"),
    )


def timing(seconds: DataFrame, rollouts: DataFrame) -> DataFrame:
    """seconds (section, seconds) with per_token_ms: by response tokens for ``gen``, by all tokens for the other known sections."""
    total = rollouts.agg(F.sum("response_length").alias("r"), F.sum(F.col("response_length") + F.col("prompt_length")).alias("a"))
    known = F.when(F.col("section") == "gen", F.col("r")).when(F.col("section").isin("ref", "values", "adv", "update_critic", "update_actor"), F.col("a"))
    return seconds.join(F.broadcast(total)).select("section", "seconds", F.try_divide(F.col("seconds") * 1000, known.cast("double")).alias("per_token_ms"))


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return F.try_divide(tokens, seconds * devices)


def reduce_named(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, name, value): the maximum of names with "max", the minimum of names with "min", else the mean."""
    by = by or []
    rule = F.when(F.col("name").contains("max"), F.max("value")).when(F.col("name").contains("min"), F.min("value")).otherwise(F.avg("value"))
    return df.groupBy(*by, "name").agg(rule.alias("value"))


# --- validation at N ----------------------------------------------------------------------------------------------


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, std): the deviation is the population's."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def expected_extreme(df: DataFrame, keys: list[str], value: str, sizes: list[int], worst: bool = False) -> DataFrame:
    """(keys, size, expected): the exact mean of the best (or worst) of ``size`` draws with replacement."""
    own = W.partitionBy(*keys)
    rank = F.row_number().over(own.orderBy(F.desc(value) if worst else F.asc(value)))
    rows = df.select(*keys, F.col(value).alias("v"), (rank / F.count("*").over(own)).alias("hi"), ((rank - 1) / F.count("*").over(own)).alias("lo"))
    rows = rows.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    return rows.groupBy(*keys, "size").agg(F.sum(F.col("v") * (F.pow("hi", "size") - F.pow("lo", "size"))).alias("expected"))


def majority(df: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """(keys, pred, n, value): the most frequent vote, of equal ones the first seen, with the value of its first row."""
    own = df.groupBy(*keys, F.col(vote).alias("pred")).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("value"))
    return own.groupBy(*keys).agg(F.max_by(F.struct("pred", "n", "value"), F.struct("n", -F.col("first"))).alias("b")).select(*keys, "b.*")


def bootstrap(df: DataFrame, keys: list[str], value: str, order: str, size: int, times: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, best_mean, best_std, worst_mean, worst_std): of ``times`` resamples of ``size`` values each, drawn by numpy's legacy
    generator from the seed, so that groups with the same number of values use the same draws. A group must fit a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(order)[value].to_numpy(float)
        at = np.random.RandomState(seed).randint(0, len(v), (times, size))
        best, worst = v[at].max(axis=1), v[at].min(axis=1)
        return pd.DataFrame([[*rows[keys].iloc[0], best.mean(), best.std(), worst.mean(), worst.std()]])

    kinds = dict(df.dtypes)
    return df.select(*keys, value, order).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", best_mean double, best_std double, worst_mean double, worst_std double")


def ladder(n: Column) -> Column:
    """2, 4, 8, ... up to and with n."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.pow(F.lit(2.0), i).cast("int")), lambda x: x < n)
    return F.when(n > 1, F.array_distinct(F.concat(powers, F.array(n.cast("int"))))).otherwise(F.array().cast("array<int>"))


def validation_report(df: DataFrame, values: list[str], source: str = "data_source", group: str = "uid", pred: str | None = "pred", order: str = "sample_idx") -> DataFrame:
    """(source, var, metric, value): means over groups of mean@N, std@N, the exact best@n, worst@n and the majority's value at N.

    Each group's numbers of draws run 2, 4, 8, ... up to its own size N.
    """
    keys = [source, group, "var"]
    named = F.explode(F.array(*(F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("v")) for v in values))).alias("x")
    own = W.partitionBy(*keys)
    # one shuffle on the keys serves the window and every aggregate below, for all variables
    rows = df.select(source, group, order, *([pred] if pred else []), named).select(source, group, order, *([pred] if pred else []), "x.var", "x.v")
    rows = rows.withColumns({"rank": F.row_number().over(own.orderBy("v", order)), "n": F.count("*").over(own)})
    label = lambda name, n, end="": F.concat(F.lit(f"{name}@"), n.cast("string"), F.lit(end))
    base = rows.groupBy(*keys, "n").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    pairs = F.array(F.struct(label("mean", F.col("n")).alias("metric"), F.col("mean").alias("value")), F.struct(label("std", F.col("n")).alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("value")))
    parts = [base.select(source, "var", F.explode(pairs).alias("m"))]
    at = lambda i: F.pow(i / F.col("n"), F.col("size"))
    i, rest = F.col("rank"), F.col("n") - F.col("rank")
    drawn = rows.withColumn("size", F.explode(ladder(F.col("n")))).groupBy(*keys, "size").agg(F.sum(F.col("v") * (at(i) - at(i - 1))).alias("best"), F.sum(F.col("v") * (at(rest + 1) - at(rest))).alias("worst"))
    parts.append(drawn.select(source, "var", F.explode(F.array(*(F.struct(label(x, F.col("size"), "/mean").alias("metric"), F.col(x).alias("value")) for x in ("best", "worst")))).alias("m")))
    if pred:
        votes = rows.groupBy(*keys, "n", F.col(pred).alias("pred")).agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.min_by("v", order).alias("v"))
        whole = votes.filter("n > 1").groupBy(*keys, "n").agg(F.max_by("v", F.struct("votes", -F.col("first"))).alias("value"))
        parts.append(whole.select(source, "var", F.struct(label("maj", F.col("n")).alias("metric"), "value").alias("m")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(source, "var", "m.metric", "m.value").filter("value is not null").groupBy(source, "var", "metric").agg(F.avg("value").alias("value"))


def sections(report: DataFrame, source: str = "data_source") -> DataFrame:
    """report with ``section``: val-core for mean, maj and best at the source's largest n of its core variable (acc, else the reward)."""
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    own = W.partitionBy(source)
    core = F.when(F.max((F.col("var") == "acc").cast("int")).over(own) == 1, F.lit("acc")).otherwise(F.lit("score"))
    rows = report.withColumn("__n", n).withColumn("__most", F.max("__n").over(W.partitionBy(source, "var"))).withColumn("__core", core)
    is_core = (F.col("var") == F.col("__core")) & F.col("metric").rlike("^(mean|maj|best)") & (F.col("__n") == F.col("__most"))
    return rows.withColumn("section", F.when(is_core, "val-core").otherwise("val-aux")).drop("__n", "__most", "__core")


# --- control and cost ---------------------------------------------------------------------------------------------


def adaptive_coefficient(steps: DataFrame, start: float, target: float, horizon: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, step, coefficient): after each step (step, current_kl, n) the coefficient grows by 1 + clip(kl / target - 1, +-0.2) n / horizon.

    The product over earlier steps is a sum of logarithms over an ordered window, so no sequential task is needed.
    """
    error = F.greatest(F.least(F.col("current_kl") / target - 1, F.lit(0.2)), F.lit(-0.2))
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    factor = 1 + error * F.col("n") / horizon
    return steps.select(*(keys or []), "step", (start * F.exp(F.sum(F.log(factor)).over(w))).alias("coefficient"))


def imbalance(df: DataFrame, part: str, cost: str) -> DataFrame:
    """One row: least, largest, spread and mean of the parts' summed costs."""
    own = df.groupBy(part).agg(F.sum(cost).alias("s"))
    return own.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("spread"), F.avg("s").alias("mean"))


def tail_ratio(df: DataFrame, value: str, part: float = 0.9) -> DataFrame:
    """One row: the part's quantile, the share of rows above it, least and largest."""
    at = F.broadcast(df.agg(F.percentile(value, F.lit(part)).alias("p")))  # one row
    return df.join(at).agg(F.max("p").alias("quantile"), F.avg((F.col(value) > F.col("p")).cast("double")).alias("above"), F.min(value).alias("least"), F.max(value).alias("most"))


def model_weights(layers: int, hidden: int, vocab: int, heads: int, kv_heads: int, head_dim: int, inter: int, experts: int = 0, active: int = 0, shared: int = 0, gated: bool = True, norms: int = 0) -> int:
    """Weights that a token meets in a decoder: attention, the feed-forward layer (of three matrices if gated, else two; of the active
    and shared experts and their gate if there are experts), further ``norms`` a layer, and both embeddings."""
    forward = hidden * inter * (3 if gated else 2) * (active + shared if experts else 1) + hidden * experts
    attention = hidden * head_dim * (2 * heads + 2 * kv_heads)
    return layers * (forward + attention + norms) + 2 * vocab * hidden


def latent_weights(layers: int, hidden: int, vocab: int, heads: int, nope: int, rope: int, value: int, kv_rank: int, q_rank: int | None, inter: int, moe_inter: int, experts: int, active: int, shared: int, dense_layers: int) -> int:
    """The same for a decoder with latent attention and experts behind its first dense layers."""
    q = nope + rope
    queries = hidden * heads * q if q_rank is None else hidden * q_rank + heads * q * q_rank
    attention = queries + hidden * (kv_rank + rope) + heads * (nope + value) * kv_rank + heads * value * hidden
    sparse = hidden * experts + hidden * moe_inter * (active + shared) * 3 + attention
    return sparse * (layers - dense_layers) + (hidden * inter * 3 + attention) * dense_layers + 2 * vocab * hidden


def flops(df: DataFrame, weights: int, pairs: float, length: str = "response_length", window: int | None = None, window_pairs: float = 0.0) -> DataFrame:
    """(tokens, flops) of forward and backward passes: six per weight and token, and ``pairs`` for each pair of places; layers with a
    sliding window count ``window_pairs`` for pairs no further apart."""
    n = F.col(length).cast("double")
    near = F.sum(n * F.least(n, F.lit(float(window)))) * window_pairs if window else F.lit(0.0)
    return df.agg(F.sum(n).alias("tokens"), (F.sum(n) * (6.0 * weights) + F.sum(n * n) * pairs + near).alias("flops"))


def dense_flops(df: DataFrame, layers: int, hidden: int, heads: int, kv_heads: int, head_dim: int, inter: int, vocab: int, length: str = "response_length") -> DataFrame:
    """flops of a dense decoder with full attention: twelve per layer, head and dimension for each pair of places."""
    return flops(df, model_weights(layers, hidden, vocab, heads, kv_heads, head_dim, inter), 12.0 * head_dim * heads * layers, length)


def utilisation(flops: Column, seconds: Column, peak: float, devices: int) -> Column:
    """The part of the devices' peak that was used."""
    return F.try_divide(flops, seconds * (peak * devices))


def fixed_coefficient(steps: DataFrame, value: float) -> DataFrame:
    """(step, coefficient): the same after every step."""
    return steps.select("step", F.lit(value).alias("coefficient"))


def controller(kind: str, **options):
    """The coefficient controller of a kind: fixed or adaptive."""
    if kind == "fixed":
        return lambda steps: fixed_coefficient(steps, options["value"])
    if kind == "adaptive":
        if options["horizon"] <= 0:
            raise ValueError("the horizon is above 0")
        return lambda steps: adaptive_coefficient(steps, options["start"], options["target"], options["horizon"])
    raise ValueError(f"no controller has the name {kind}")


def spread(df: DataFrame, value: str, mask: str | None = None) -> DataFrame:
    """One row: mean, maximum, minimum and population deviation of the valid values over all partitions."""
    c = F.when(F.col(mask) == 1, F.col(value)) if mask else F.col(value)
    return df.agg(F.avg(c).alias("mean"), F.max(c).alias("max"), F.min(c).alias("min"), F.stddev_pop(c).alias("std"))


def newest(df: DataFrame, step: str, value: str) -> DataFrame:
    """One row: the value of the largest step."""
    return df.agg(F.max(step).alias(step), F.max_by(value, step).alias(value))
