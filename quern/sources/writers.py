"""Sinks: JSON lines, partitioned stages, generations, nested responses, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.sampling import seeded


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def stage(df: DataFrame, path: str, stage: str, iteration: int) -> None:
    """Under path/stage=.../iteration=.../task_type=...; other stages and iterations stay as they are."""
    rows = df.withColumns({"stage": F.lit(stage), "iteration": F.lit(iteration)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "iteration", "task_type").json(path)


def generations(df: DataFrame, path: str, step: int, extras: list[str] | None = None) -> None:
    """input, output, gts, score and the extras of a step."""
    rows = df.select("input", "output", "gts", "score", *(extras or []), F.lit(step).alias("step"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").json(path)


def nested_responses(df: DataFrame, key: str, order: str, response: str) -> DataFrame:
    """One row per key with its responses in order."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, response))).alias("r"))
    return rows.select(key, F.transform("r", lambda x: x[response]).alias("responses"))


def metrics(df: DataFrame, path: str) -> None:
    """Append (step, name, value)."""
    df.select("step", "name", "value").write.mode("append").partitionBy("step").json(path)


def validation_sample(df: DataFrame, n: int, key: str = "input", seed: int = 42) -> DataFrame:
    """n rows in a seeded order that doesn't depend on partitions."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def size_report(df: DataFrame) -> DataFrame:
    """(column, bytes) of the texts' UTF-8 and of other values' texts, largest first."""
    sizes = df.agg(*(F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))))
    return sizes.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, sizes.columns)), F.array(*sizes.columns))).alias("column", "bytes")).orderBy(F.desc("bytes"), "column")
