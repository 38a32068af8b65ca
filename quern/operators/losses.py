"""Policy and value objectives as aggregates over an exploded token frame (seq, pos, mask, adv, log-probabilities)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOSSES: dict[str, Callable[..., DataFrame]] = {}
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def register(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if _LOSSES.get(name, f) is not f:
            raise ValueError(f"another loss has the name {name}")
        _LOSSES[name] = f
        return f

    return add


def policy_loss(name: str) -> Callable[..., DataFrame]:
    if name not in _LOSSES:
        raise ValueError(f"no loss has the name {name}; there are {sorted(_LOSSES)}")
    return _LOSSES[name]


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def masked_mean(x: Column, mask: str = "mask") -> Column:
    return F.sum(x * F.col(mask)) / (F.sum(mask) + 1e-8)


def _share(condition: Column) -> Column:
    return masked_mean(condition.cast("double"))


def aggregate_loss(df: DataFrame, loss: Column, mode: str = "token-mean", seq: str = "seq", width: int | None = None, **others: Column) -> DataFrame:
    """One row: ``loss`` under the mode, and further masked aggregates. width: the padded length that seq-mean-token-sum-norm divides
    by, else the longest sequence. Sequences without a valid token count 0 under seq-mean-token-mean."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "token-mean":
        return df.agg(masked_mean(loss).alias("loss"), *(c.alias(n) for n, c in others.items()))
    own = df.groupBy(seq).agg(F.sum(loss * F.col("mask")).alias("s"), F.sum("mask").alias("m"), F.max("pos").alias("p"))
    total = {"seq-mean-token-sum": F.avg("s"), "seq-mean-token-mean": F.avg(F.coalesce(F.try_divide("s", F.col("m")), F.lit(0.0))), "seq-mean-token-sum-norm": F.sum("s") / (F.lit(width) if width else F.max("p") + 1)}
    found = own.agg(total[mode].alias("loss"))
    return found.join(F.broadcast(df.agg(*(c.alias(n) for n, c in others.items())))) if others else found


def kl(name: str, logp: str = "new_logp", ref: str = "ref_logp") -> Column:
    """The estimate of the divergence with this name; a trailing + (straight-through gradients) has the same value."""
    d = F.col(logp) - F.col(ref)
    name = name.rstrip("+")
    if name in ("kl", "k1"):
        return d
    if name == "abs":
        return F.abs(d)
    if name in ("mse", "k2"):
        return 0.5 * d * d
    if name in ("low_var_kl", "k3"):
        r = clamp(-d, -20.0, 20.0)
        return clamp(F.exp(r) - r - 1, -10.0, 10.0)
    raise ValueError(f"no divergence has the name {name}")



def _delta() -> Column:
    return F.col("new_logp") - F.col("old_logp")


@register("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 3.0, mode: str = "token-mean", weight: Column | None = None) -> DataFrame:
    """Dual-clip objective: loss, clip_fraction, approx_kl, clip_fraction_lower."""
    if c <= 1:
        raise ValueError("c is greater than 1")
    d = clamp(_delta(), -20.0, 20.0)
    ratio, a = F.exp(d), F.col("adv")
    plain, clipped, floor = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high), -a * c
    most = F.greatest(plain, clipped)
    loss = F.when(a < 0, F.least(floor, most)).otherwise(most)
    loss = loss if weight is None else loss * weight
    return aggregate_loss(df, loss, mode, clip_fraction=_share(clipped > plain), approx_kl=masked_mean(-d), clip_fraction_lower=_share((most > floor) & (a < 0)))


@register("gspo")
def gspo(df: DataFrame, low: float = 0.2, high: float = 0.2, seq: str = "seq", weight: Column | None = None) -> DataFrame:
    """The ratio is a sequence's: loss (always the mean of sequences' means), clip_fraction, approx_kl."""
    own = W.partitionBy(seq)
    rows = df.withColumn("__r", F.exp(clamp(F.sum(_delta() * F.col("mask")).over(own) / F.greatest(F.sum("mask").over(own), F.lit(1)), high=10.0)))
    a, ratio = F.col("adv"), F.col("__r")
    plain, clipped = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high)
    loss = F.greatest(plain, clipped)
    return aggregate_loss(rows, loss if weight is None else loss * weight, "seq-mean-token-mean", seq, clip_fraction=_share(clipped > plain), approx_kl=masked_mean(-_delta()))


@register("gpg")
def gpg(df: DataFrame, mode: str = "token-mean", weight: Column | None = None) -> DataFrame:
    """Minus log-probability times advantage."""
    loss = -F.col("new_logp") * F.col("adv")
    return aggregate_loss(df, loss if weight is None else loss * weight, mode)


def covariance(df: DataFrame) -> DataFrame:
    """df with each token's covariance term of advantage and log-probability about their masked means."""
    means = F.broadcast(df.agg(masked_mean(F.col("adv")).alias("__a"), masked_mean(F.col("new_logp")).alias("__l")))  # one row
    return df.join(means).withColumn("cov", (F.col("adv") - F.col("__a")) * (F.col("new_logp") - F.col("__l"))).drop("__a", "__l")


def _first_by(df: DataFrame, condition: Column, order: list[Column], part: float) -> DataFrame:
    """df with ``picked``: whether a token is among the first max(1, part of the valid tokens) that fulfil the condition."""
    n = df.agg(F.sum("mask")).first()[0] or 0
    k = max(1, int(part * n))
    keys = df.filter(condition).select("seq", "pos", *(c.alias(f"__o{i}") for i, c in enumerate(order))).orderBy(*(F.col(f"__o{i}") for i in range(len(order))), "seq", "pos").limit(k)
    return df.join(keys.select("seq", "pos", F.lit(True).alias("picked")), ["seq", "pos"], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))


@register("kl_cov")
def kl_cov(df: DataFrame, part: float = 0.0002, coefficient: float = 1.0, mode: str = "token-mean") -> DataFrame:
    """Tokens of the largest covariance also pay coefficient times |log ratio|: loss, abs_kl."""
    rows = _first_by(covariance(df), F.col("mask") == 1, [-F.round("cov", 9)], part)
    d = _delta()
    loss = -F.col("adv") * F.exp(d) + F.when(F.col("picked"), coefficient * F.abs(d)).otherwise(0.0)
    return aggregate_loss(rows, loss, mode, abs_kl=masked_mean(F.abs(d)))


@register("clip_cov")
def clip_cov(df: DataFrame, part: float = 0.0002, low: float = 0.2, high: float = 0.2, bounds: tuple[float, float] = (1.0, 5.0), mode: str = "token-mean", seed: int = 0) -> DataFrame:
    """A part of the tokens with a covariance inside the bounds, picked by a hash, doesn't count: loss, clip_fraction, approx_kl."""
    ratio, a = F.exp(_delta()), F.col("adv")
    plain, clipped = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high)
    inside = (F.col("cov") > bounds[0]) & (F.col("cov") < bounds[1]) & (F.col("mask") == 1) & ~(clipped > plain)
    rows = _first_by(covariance(df), inside, [F.md5(F.concat_ws(":", F.col("seq").cast("string"), F.col("pos").cast("string"), F.lit(str(seed))))], part)
    loss = F.when(F.col("picked"), 0.0).otherwise(F.greatest(plain, clipped))
    return aggregate_loss(rows, loss, mode, clip_fraction=_share(F.col("picked")), approx_kl=masked_mean(-_delta()))


@register("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.2, high: float = 0.2, seq: str = "seq") -> DataFrame:
    """The geometric mean of a sequence's one-sidedly clipped ratios: loss, clip_fraction, approx_kl, clip_fraction_lower."""
    d, a = _delta(), F.col("adv")
    cut = clamp(d, -low, high)
    own = F.signum(a) * F.least(F.signum(a) * d, F.signum(a) * cut)
    n = F.sum("mask") + 1e-8
    per = df.groupBy(seq).agg((F.sum(own * F.col("mask")) / n).alias("r"), (F.sum(a * F.col("mask")) / n).alias("a"))
    found = per.agg(F.avg(-F.col("a") * F.exp("r")).alias("loss"))
    return found.join(F.broadcast(df.agg(_share((d != cut) & (a > 0)).alias("clip_fraction"), masked_mean(-d).alias("approx_kl"), _share((d != cut) & (a < 0)).alias("clip_fraction_lower"))))


def value_loss(df: DataFrame, prediction: str, value: str = "value", ret: str = "ret", clip: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """Half the larger of the squared errors of the prediction and the clipped one: loss, clip_fraction."""
    p, v, r = F.col(prediction), F.col(value), F.col(ret)
    cut = F.greatest(F.least(p, v + clip), v - clip)
    one, two = (p - r) * (p - r), (cut - r) * (cut - r)
    return aggregate_loss(df, 0.5 * F.greatest(one, two), mode, clip_fraction=_share(two > one))


def sft_loss(df: DataFrame, logp: str = "new_logp", seq: str = "seq") -> DataFrame:
    """Minus the mean log-probability under the mask shifted one place left; the last place of a sequence doesn't count."""
    shifted = F.coalesce(F.lead("mask").over(W.partitionBy(seq).orderBy("pos")), F.lit(0))
    rows = df.withColumn("__m", shifted)
    return rows.agg((-F.sum(F.col(logp) * F.col("__m")) / F.sum("__m")).alias("loss"))


def composite_loss(df: DataFrame, entropy: Column, entropy_coefficient: float, kl_coefficient: float, kl_name: str = "low_var_kl", **policy) -> DataFrame:
    """loss: the dual-clip objective less entropy and plus divergence, each with its coefficient; the parts beside it."""
    own = vanilla(df, **policy).withColumnRenamed("loss", "policy_loss")
    more = df.agg(masked_mean(entropy).alias("entropy"), masked_mean(kl(kl_name)).alias("kl_loss"))
    total = F.col("policy_loss") - entropy_coefficient * F.col("entropy") + kl_coefficient * F.col("kl_loss")
    return own.join(F.broadcast(more)).withColumn("loss", total)
