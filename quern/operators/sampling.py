"""Sampling: informative groups, batches of whole groups, bounded and levelled samples, seeded orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(key: str, seed: int) -> Column:
    """A repeatable pseudo-random order of rows by key and seed, whatever their partitions."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def informative(df: DataFrame, metric: str, group: str = "uid") -> DataFrame:
    """df with ``keep``: the group has one row, or its metric isn't the same everywhere."""
    own = W.partitionBy(group)
    return df.withColumn("keep", (F.count("*").over(own) == 1) | F.coalesce(F.max(metric).over(own) > F.min(metric).over(own), F.lit(False)))


def group_table(df: DataFrame, metric: str, group: str = "uid", order: str = "pos") -> DataFrame:
    """(group, task_type, first, keep): one row per group."""
    return df.groupBy(group).agg(F.min("task_type").alias("task_type"), F.min(order).alias("first"), ((F.count("*") == 1) | F.coalesce(F.max(metric) > F.min(metric), F.lit(False))).alias("keep"))


def filtered_groups(df: DataFrame, metric: str, group: str = "uid") -> DataFrame:
    """The groups that say nothing."""
    return group_table(df, metric, group, metric).filter("NOT keep").select(group)


def first_groups(groups: DataFrame, batch: int, group: str = "uid") -> DataFrame:
    """The batch's first kept groups in the order of arrival."""
    return groups.filter("keep").orderBy("first", group).limit(batch)


def aligned(df: DataFrame, metric: str, batch: int, group: str = "uid", order: str = "pos") -> DataFrame:
    """The rows of the first ``batch`` informative groups; the rest is tossed."""
    chosen = first_groups(group_table(df, metric, group, order), batch, group).select(group)
    return df.join(chosen, group, "left_semi")


def counts(df: DataFrame, metric: str, batch: int, group: str = "uid", order: str = "pos") -> DataFrame:
    """(task_type, filtered, tossed, used): groups by what became of them."""
    groups = group_table(df, metric, group, order)
    used = first_groups(groups, batch, group).select(group, F.lit(True).alias("used"))
    rows = groups.join(used, group, "left").withColumn("used", F.coalesce("used", F.lit(False)))
    return rows.groupBy(F.coalesce("task_type", F.lit("unknown")).alias("task_type")).agg(F.count_if(~F.col("keep")).alias("filtered"), F.count_if(F.col("keep") & ~F.col("used")).alias("tossed"), F.count_if("used").alias("used"))


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows with the smallest keys, in order."""
    return df.orderBy(key).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, in a seeded order."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def level(difficulty: str) -> Column:
    """easy below 0.3, medium to 0.6, hard to 1, else null. Difficulty is a success rate; the names follow its size."""
    x = F.col(difficulty)
    return F.when((x >= 0) & (x < 0.3), "easy").when((x >= 0.3) & (x <= 0.6), "medium").when((x > 0.6) & (x <= 1), "hard")


def sample_by_level(df: DataFrame, difficulty: str, key: str, n: int = 10, seed: int = 0) -> DataFrame:
    """Up to n rows of each level, in a seeded order."""
    rows = df.withColumn("level", level(difficulty)).filter("level is not null")
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy("level").orderBy(seeded(key, seed), key))).filter(F.col("__rank") <= n).drop("__rank")


def ordered(df: DataFrame, how: str, key: str, seed: int = 0, custom: Column | None = None) -> DataFrame:
    """df in the order of a sampler: sequential by key, random by seed, or custom by a column."""
    if how == "sequential":
        return df.orderBy(key)
    if how == "random":
        return df.orderBy(seeded(key, seed), key)
    if how == "custom" and custom is not None:
        return df.orderBy(custom, key)
    raise ValueError(f"no sampler has the name {how}")


def fan_out(df: DataFrame, n: int, temperature: float = 1.0) -> DataFrame:
    """Each row n times, numbered by ``sample_idx``; without temperature one sample is all there is."""
    if temperature == 0 and n != 1:
        raise ValueError("without temperature n is 1")
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
