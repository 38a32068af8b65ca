"""Grouped advantage estimators over sampled responses and tokens.

Response-level estimators take a frame with a group column, a score and, where needed, a length, and add ``advantage``.
They use windows over the group, so one shuffle on the group serves all of them. Token-level estimators take an exploded
token frame (seq, pos, mask, reward, ...). Recurrences over a response's tokens (gae, reinforce_plus_plus) gather them in order in
arrays of bounded length and walk them in Arrow batches in time linear in the tokens; a higher-order function would copy its
growing result at every token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.batch import positions

_ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Register an estimator; a name may be registered again only with the same function."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if _ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"another estimator has the name {name}")
        _ESTIMATORS[name] = f
        return f

    return add


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in _ESTIMATORS:
        raise ValueError(f"no estimator has the name {name}; there are {sorted(_ESTIMATORS)}")
    return _ESTIMATORS[name]


def _group(group: str) -> tuple[Column, Column, Column]:
    own = W.partitionBy(group)
    return F.count("*").over(own), F.avg("score").over(own), F.stddev_samp("score").over(own)


@register("grpo")
def grpo(df: DataFrame, group: str = "uid", by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """Distance from the group's mean, in its standard deviations unless by_std is off; a single response keeps its score."""
    n, mean, std = _group(group)
    away = F.col("score") - F.when(n == 1, 0.0).otherwise(mean)
    return df.withColumn("advantage", away / (F.when(n == 1, 1.0).otherwise(std) + eps) if by_std else away)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, group: str = "uid", by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """As grpo, with the variance floored at eps before its root is taken."""
    n, mean, std = _group(group)
    away = F.col("score") - F.when(n == 1, 0.0).otherwise(mean)
    return df.withColumn("advantage", away / (F.when(n == 1, 1.0).otherwise(F.sqrt(F.greatest(std * std, F.lit(eps)))) + eps) if by_std else away)


@register("grpo_passk")
def grpo_passk(df: DataFrame, group: str = "uid", by_std: bool = True, eps: float = 1e-6, order: str = "sample_idx", singles: bool = False) -> DataFrame:
    """Only the best response of a group gets its lead over the second; groups of one raise, or with ``singles`` get null."""
    n, _, std = _group(group)
    best = W.partitionBy(group).orderBy(F.desc("score"), order)
    lead = F.col("score") - F.lead("score").over(best)
    value = F.when(F.row_number().over(best) == 1, lead / (std + eps) if by_std else lead).otherwise(0.0)
    if not singles:
        value = F.when(n < 2, F.raise_error(F.lit("a group needs two responses")).cast("double")).otherwise(value)
    return df.withColumn("advantage", value)


@register("rloo")
def rloo(df: DataFrame, group: str = "uid") -> DataFrame:
    """Distance from the mean of the other responses; a single response keeps its score."""
    n, mean, _ = _group(group)
    return df.withColumn("advantage", F.when(n == 1, F.col("score")).otherwise((F.col("score") - mean) * n / F.greatest(n - 1, F.lit(1))))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, group: str = "uid") -> DataFrame:
    """As rloo, but 0 for a single response."""
    n, mean, _ = _group(group)
    return df.withColumn("advantage", F.when(n == 1, 0.0).otherwise((F.col("score") - mean) * n / F.greatest(n - 1, F.lit(1))))


@register("opo")
def opo(df: DataFrame, group: str = "uid", length: str = "response_length") -> DataFrame:
    """Distance from the group's mean weighted by length; a single response keeps its score."""
    own = W.partitionBy(group)
    base = F.try_divide(F.sum(F.col(length) * F.col("score")).over(own), F.sum(length).over(own))
    return df.withColumn("advantage", F.col("score") - F.when(F.count("*").over(own) == 1, 0.0).otherwise(base))


@register("gpg")
def gpg(df: DataFrame, group: str = "uid", f_norm: float = 1.0) -> DataFrame:
    """Distance from the group's mean, scaled by all responses over those whose score isn't 0."""
    n, mean, _ = _group(group)
    total = df.agg(F.count("*").alias("__n"), F.greatest(F.count_if(F.col("score") != 0), F.lit(1)).alias("__m"))
    rows = df.withColumn("__away", F.col("score") - F.when(n == 1, 0.0).otherwise(mean)).join(F.broadcast(total))  # one row
    return rows.withColumn("advantage", F.col("__n") / F.col("__m") * F.col("__away") / f_norm).drop("__n", "__m", "__away")


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame, group: str = "uid", length: str = "response_length") -> DataFrame:
    """Distance from the group's mean on each token, whitened over all tokens; a response weighs its length."""
    n, mean, _ = _group(group)
    rows = df.withColumn("__away", F.col("score") - F.when(n == 1, 0.0).otherwise(mean))
    x, w = F.col("__away"), F.col(length)
    total = rows.agg(F.sum(w).alias("__n"), (F.sum(x * w) / F.sum(w)).alias("__mean"), (F.sum(x * x * w) / F.sum(w)).alias("__square"))
    var = (F.col("__square") - F.col("__mean") * F.col("__mean")) * F.col("__n") / (F.col("__n") - 1)
    rows = rows.join(F.broadcast(total))  # one row
    return rows.withColumn("advantage", (x - F.col("__mean")) / F.sqrt(var + 1e-8)).drop("__away", "__n", "__mean", "__square")


# --- tokens -------------------------------------------------------------------------------------------------------


def masked_whiten(df: DataFrame, column: str, out: str, mask: str = "mask", shift_mean: bool = True) -> DataFrame:
    """column less its masked mean over its masked deviation, over all rows."""
    kept = F.when(F.col(mask) == 1, F.col(column))
    total = df.agg(F.avg(kept).alias("__mean"), F.var_samp(kept).alias("__var"))
    rows = df.join(F.broadcast(total))  # one row
    white = (F.col(column) - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)
    return rows.withColumn(out, white if shift_mean else white + F.col("__mean")).drop("__mean", "__var")


def _scan(df: DataFrame, seq: str, keep: list[str], out: list[str], walk: Callable[[list[dict]], Iterator[tuple]]) -> DataFrame:
    """(seq, pos, keep, out): walk gives the values of out (doubles) for each of a sequence's tokens, from the last to the first."""
    arrays = df.groupBy(seq).agg(F.sort_array(F.collect_list(F.struct("pos", *keep)), asc=False).alias("__t"))
    kinds = {f.name: f.dataType for f in df.select(seq, "pos", *keep).schema.fields}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in (seq, "pos", *keep)), *(T.StructField(c, T.DoubleType()) for c in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__t")
            tokens, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            found = [x for row in lists.to_pylist() for x in walk(row)]
            columns = [batch.column(seq).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), *(tokens.field(c) for c in ("pos", *keep))]
            columns += [pa.array(x, pa.float64()) for x in (zip(*found, strict=True) if found else [[]] * len(out))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrays.mapInArrow(run, schema)


def _or_none(run: Callable[[], float]) -> float | None:
    """The value, or null if a part of it is null."""
    try:
        return run()
    except TypeError:
        return None


@register("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 0.95, seq: str = "seq") -> DataFrame:
    """(seq, pos, mask, reward, value, advantage, ret): generalised advantages before whitening; masked places pass the state on."""

    def walk(tokens: list[dict]) -> Iterator[tuple]:
        following, advantage = 0.0, 0.0
        for t in tokens:
            if t["mask"] == 1:
                advantage = _or_none(lambda: t["reward"] + gamma * following - t["value"] + gamma * lam * advantage)  # noqa: B023
                following = t["value"]
            yield (advantage,)

    return _scan(df, seq, ["mask", "reward", "value"], ["advantage"], walk).withColumn("ret", F.col("advantage") + F.col("value"))


@register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 0.99, seq: str = "seq") -> DataFrame:
    """(seq, pos, mask, reward, ret): discounted returns that start anew behind a masked place; whiten ret for the advantage."""

    def walk(tokens: list[dict]) -> Iterator[tuple]:
        carry = 0.0
        for t in tokens:
            ret = _or_none(lambda: t["reward"] + gamma * carry)  # noqa: B023
            carry = ret if t["mask"] == 1 else 0.0
            yield (ret,)

    return _scan(df, seq, ["mask", "reward"], ["ret"], walk)


@register("remax")
def remax(df: DataFrame, seq: str = "seq", baseline: str = "baseline") -> DataFrame:
    """ret: the masked rewards from here on; advantage: less the sequence's baseline where the mask is 1."""
    after = W.partitionBy(seq).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("ret", F.sum(F.col("reward") * F.col("mask")).over(after))
    return rows.withColumn("advantage", F.col("ret") - F.col(baseline) * F.col("mask"))


def kl_penalised(df: DataFrame, beta: float, kl: Column) -> DataFrame:
    """Token rewards less beta times the masked divergence."""
    return df.withColumn("penalised", F.col("reward") - beta * kl * F.col("mask"))


def batch_kl(df: DataFrame, kl: Column, seq: str = "seq") -> DataFrame:
    """(current_kl): the mean over sequences of their masked mean divergence."""
    own = df.groupBy(seq).agg((F.sum(kl * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("k"))
    return own.agg(F.avg("k").alias("current_kl"))


def resampling_weights(df: DataFrame, method: str = "pow", power: float = 2.0) -> DataFrame:
    """df with the weight by which a response is drawn again: pow, max_min or max_random."""
    if method not in ("pow", "max_min", "max_random"):
        raise ValueError(f"no weighting has the name {method}")
    ends = F.broadcast(df.agg(F.max("score").alias("__max"), F.min("score").alias("__min")))  # one row
    s = F.col("score")
    weight = {"pow": F.pow(F.abs(s), F.lit(power)), "max_min": F.when((s == F.col("__max")) | (s == F.col("__min")), 1.0).otherwise(0.0), "max_random": F.when(s == F.col("__max"), 0.4).otherwise(0.1)}[method]
    return df.join(ends).withColumn("weight", F.greatest(weight + 1e-8, F.lit(1e-8))).drop("__max", "__min")


def resample(df: DataFrame, key: str, n: int, seed: int = 0, method: str = "pow", power: float = 2.0) -> DataFrame:
    """n rows drawn with replacement by weight. In the order of key each row takes as much of the line from 0 to the sum of weights as it
    weighs, and a draw the row where its point falls; points are hashes of draw and seed. The line is cut into as many equal pieces as
    there are rows or draws; a row lies in the pieces it touches, so rows and points meet by an equi-join on the piece."""
    weighted = positions(resampling_weights(df, method, power), key, pos="__pos")
    spark = df.sparkSession
    # a row's piece of the line begins behind the weights of its range of positions and of the ranges before it, and ends where the next begins
    span = F.floor(F.col("__pos") / 65_536)
    order = W.orderBy("__span")  # one row a span
    spans = weighted.groupBy(span.alias("__span")).agg(F.sum("weight").alias("w"))
    spans = spans.select("__span", F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__base"), "w")
    total = spans.agg(F.coalesce(F.sum("w"), F.lit(1.0))).first()[0]
    spans = spans.select("__span", "__base", F.lead("__base").over(order).alias("__next"))
    own = W.partitionBy("__span").orderBy("__pos")
    rows = weighted.withColumn("__span", span).join(F.broadcast(spans), "__span")
    rows = rows.withColumn("__from", F.col("__base") + F.coalesce(F.sum("weight").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("__to", F.coalesce(F.lead("__from").over(own), "__next"))
    pieces = max(1, n)
    piece = lambda x: F.coalesce(F.least(F.floor(x / total * pieces), F.lit(pieces - 1)), F.lit(pieces - 1))
    rows = rows.filter(F.col("__to").isNull() | (F.col("__to") >= F.col("__from"))).withColumn("__piece", F.explode(F.sequence(piece(F.col("__from")), piece(F.col("__to")))))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.lit(seed))), 1, 13), 16, 10).cast("double") / 2.0**52
    draws = spark.range(n).select(F.col("id").cast("int").alias("draw"), (part * total).alias("__point")).withColumn("__piece", piece(F.col("__point")))
    hit = (F.col("__point") >= F.col("__from")) & F.coalesce(F.col("__point") < F.col("__to"), F.lit(True))
    return rows.join(draws, "__piece").filter(hit).drop("__piece", "__span", "__pos", "__base", "__next", "__to", "__from", "__point")
