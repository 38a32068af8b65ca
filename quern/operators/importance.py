"""Importance weights between the sampling and the training policy, and diagnostics of their mismatch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.losses import clamp, masked_mean

BOUND = 20.0


def _log_ratio() -> Column:
    return F.col("old_logp") - F.col("rollout_logp")


def importance_weights(df: DataFrame, threshold: float, level: str = "token", mode: str = "truncate", lower: float | None = None, veto: float | None = 1e-4, seq: str = "seq") -> DataFrame:
    """df with raw_weight (before truncation), log_value (that metrics compare), vetoed, and is_weight.

    level: token, sequence (the product of a sequence's ratios) or geometric (their mean). mode: truncate at the threshold or
    mask outside [lower, threshold]; lower is 1 / threshold unless given. A token below the veto zeroes its sequence.
    """
    if level not in ("token", "sequence", "geometric") or mode not in ("truncate", "mask"):
        raise ValueError(f"no level {level} with mode {mode}")
    lower = 1 / threshold if lower is None else lower
    own, m = W.partitionBy(seq), F.col("mask")
    value = {"token": _log_ratio(), "sequence": F.sum(_log_ratio() * m).over(own), "geometric": F.sum(_log_ratio() * m).over(own) / (F.sum(m).over(own) + 1e-8)}[level]
    awful = (_log_ratio() < math.log(veto)) & (m == 1) if veto else F.lit(False)
    rows = df.withColumns({"log_value": value, "catastrophic": awful}).withColumns({"raw_weight": F.exp(clamp(F.col("log_value"), -BOUND, BOUND)), "vetoed": F.max("catastrophic").over(own)})
    w = F.col("raw_weight")
    kept = F.least(w, F.lit(threshold)) if mode == "truncate" else F.when(w.between(lower, threshold), w).otherwise(0.0)
    return rows.withColumn("is_weight", kept * (1 - F.col("vetoed").cast("int")) * m)


def importance_metrics(df: DataFrame, threshold: float, level: str = "token", lower: float | None = None, veto: float | None = 1e-4, seq: str = "seq") -> DataFrame:
    """One row of statistics of the raw weights: mean, extremes, spread, effective sample size, tails, vetoes and sequence means."""
    lower = 1 / threshold if lower is None else lower
    rows = importance_weights(df, threshold, level, "truncate", lower, veto, seq)
    w, m, x = F.col("raw_weight"), F.col("mask"), F.col("log_value")
    inner = F.least(F.greatest(w, F.lit(lower)), F.lit(threshold))
    high, low = (w > threshold, w < lower) if level == "token" else (x > math.log(threshold), x < math.log(lower))
    share = lambda c: masked_mean(c.cast("double"))
    valid = F.when(m == 1, w)
    flat = rows.agg(
        masked_mean(w).alias("mean"), F.max(valid).alias("max"), F.min(valid).alias("min"), share(high).alias("high"), share(low).alias("low"), share(F.col("catastrophic")).alias("catastrophic"),
        F.sqrt(F.greatest(masked_mean(inner * inner) - masked_mean(inner) * masked_mean(inner), F.lit(0.0))).alias("std"),
        (1 / (masked_mean(inner * inner) / ((masked_mean(inner) + 1e-8) * (masked_mean(inner) + 1e-8)))).alias("ess"),
    )
    own = rows.groupBy(seq).agg(masked_mean(w).alias("w"), F.max("vetoed").alias("v"), F.max(x).alias("x"))
    s = F.col("w")
    each = own.agg(
        F.avg(s).alias("seq_mean"), F.stddev_samp(s).alias("seq_std"), F.max(s).alias("seq_max"), F.min(s).alias("seq_min"), F.max(F.abs(s - 1)).alias("seq_max_deviation"),
        F.avg((s > threshold).cast("double")).alias("seq_high"), F.avg((s < lower).cast("double")).alias("seq_low"), F.avg(F.col("v").cast("double")).alias("vetoed"),
        F.exp(F.least(F.max("x"), F.lit(BOUND))).alias("__max"), F.exp(F.min("x")).alias("__min"), F.avg((F.col("x") > math.log(threshold)).cast("double")).alias("__high"), F.avg((F.col("x") < math.log(lower)).cast("double")).alias("__low"),
    )
    found = flat.join(F.broadcast(each))  # one row each
    if level != "token":
        found = found.withColumns({"max": F.col("__max"), "min": F.col("__min")})
    if level == "sequence":
        found = found.withColumns({"high": F.col("__high"), "low": F.col("__low")})
    return found.drop("__max", "__min", "__high", "__low")


def mask_metrics(df: DataFrame, threshold: float, level: str = "token", lower: float | None = None, seq: str = "seq") -> DataFrame:
    """(masked_fraction, seq_masked_fraction) of weights outside [lower, threshold]."""
    lower = 1 / threshold if lower is None else lower
    rows = importance_weights(df, threshold, level, "mask", lower, None, seq).withColumn("out", (~F.col("raw_weight").between(lower, threshold)).cast("double"))
    own = rows.groupBy(seq).agg((F.sum(F.col("out") * F.col("mask")) > 0).cast("double").alias("any"), F.max("out").alias("one"))
    return rows.agg(masked_mean(F.col("out")).alias("masked_fraction")).join(F.broadcast(own.agg(F.avg("any" if level == "token" else "one").alias("seq_masked_fraction"))))


def mismatch_metrics(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: perplexities of both policies, divergences, and the differences of log-perplexity. Sequences without a valid token
    have the mean log-probability 0."""
    r = _log_ratio()
    own = df.groupBy(seq).agg(masked_mean(F.col("old_logp")).alias("t"), masked_mean(F.col("rollout_logp")).alias("r"))
    d = F.col("r") - F.col("t")
    each = own.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"), F.avg(-F.col("t")).alias("training_log_ppl"), F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(d).alias("log_ppl_diff"), F.avg(F.abs(d)).alias("log_ppl_abs_diff"), F.max(d).alias("log_ppl_diff_max"), F.min(d).alias("log_ppl_diff_min"), F.avg(F.exp(d)).alias("ppl_ratio"),
    )
    return each.join(F.broadcast(df.agg(masked_mean(-r).alias("kl"), masked_mean(F.exp(r) - r - 1).alias("k3_kl"))))


def probability_metrics(df: DataFrame) -> DataFrame:
    """One row: maximum, mean and deviation of the probabilities' distance, and their correlation, over valid tokens."""
    rows = df.filter("mask = 1").select(F.exp("old_logp").alias("a"), F.exp("rollout_logp").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return rows.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.corr("a", "b").alias("pearson"))


def token_differences(df: DataFrame, left: str, right: str, seq: str = "seq") -> DataFrame:
    """(seq, differences): valid places whose values differ."""
    return df.groupBy(seq).agg(F.sum(((F.col(left) != F.col(right)) & (F.col("mask") == 1)).cast("long")).alias("differences"))
