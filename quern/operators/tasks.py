"""Filters, joins and set operations over task records and skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a complete record of a type needs.
NEEDS = {"code_in": ("code", "input", "output", "difficulty"), "code_out": ("code", "input", "output", "difficulty"), "code_func": ("problem", "inputs", "outputs", "difficulty")}


def proposal_ok() -> Column:
    """A function task has a problem, another task code; null for records without a type."""
    return F.when(F.col("task_type").isin("code_in", "code_out"), F.coalesce(F.col("code") != "", F.lit(False))).when(F.col("task_type") == "code_func", F.coalesce(F.col("problem") != "", F.lit(False)))


def split_proposals(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid); records without a type are in neither."""
    if "problem" not in df.columns:
        df = df.withColumn("problem", F.lit(None).cast("string"))
    return df.filter(proposal_ok()), df.filter(~proposal_ok())


def skill_ok(skill: str = "skill", detected: str = "detected_skill") -> Column:
    return F.coalesce(F.array_contains(detected, F.col(skill)), F.lit(False))


def in_band(score: str, low: float, high: float) -> Column:
    """Strictly between the bounds."""
    return (F.col(score) > low) & (F.col(score) < high)


def complete() -> Column:
    """All that the record's type needs is there; records of other types pass."""
    out = F.lit(True)
    for kind, needs in NEEDS.items():
        all_there = F.lit(True)
        for c in needs:
            all_there = all_there & F.col(c).isNotNull()
        out = F.when(F.col("task_type") == kind, all_there).otherwise(out)
    return out


def clean(df: DataFrame) -> DataFrame:
    """Only complete records. (Removing from a list while walking it would skip neighbours; this filter doesn't.)"""
    for c in sorted({c for needs in NEEDS.values() for c in needs} - set(df.columns)):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.filter(complete())


def removed_counts(df: DataFrame) -> DataFrame:
    """(task_type, kept, removed)."""
    return df.groupBy("task_type").agg(F.count_if(complete()).alias("kept"), F.count_if(~complete()).alias("removed"))


def rejects(df: DataFrame) -> DataFrame:
    """(task_id, skill, category, reject): reason, feedback and code where there is a reason or feedback, else null."""
    some = F.col("reason").isNotNull() | F.col("feedback").isNotNull()
    return df.select("task_id", "skill", "category", F.when(some, F.struct("reason", "feedback", "code")).alias("reject"))


def assign_invalid(invalid: DataFrame, valid: DataFrame, order: str = "task_id") -> DataFrame:
    """Invalid tasks whose skill some valid task was found to need, with the first such task's code, input and output.

    The first task of each skill is found before the join, by partial aggregation, so the join's right side has one row a skill.
    """
    needs = valid.select(F.explode(F.array_distinct("detected_skill")).alias("skill"), order, "code", "input", "output")
    first = needs.groupBy("skill").agg(F.min_by(F.struct(F.col(order).alias("from_task"), "code", "input", "output"), order).alias("t"))
    return invalid.drop("code", "input", "output").join(first, "skill").select(*(c for c in invalid.columns if c not in ("code", "input", "output")), "t.*")


def combos_with(skills: DataFrame, combos: DataFrame) -> DataFrame:
    """(skill, combo_id): combinations that contain each skill."""
    return skills.select("skill").distinct().join(combos.select(F.explode(F.array_distinct("skills")).alias("skill"), "combo_id"), "skill")


def combo_key(skills: str) -> Column:
    """The same for any order of the same skills."""
    return F.array_sort(F.array_distinct(skills))


def first_by_combo(df: DataFrame, skills: str, value: str, order: str) -> DataFrame:
    """(combo, value): the first value of each set of skills."""
    return df.groupBy(combo_key(skills).alias("combo")).agg(F.min_by(value, order).alias(value))


def without_code(df: DataFrame, solved: DataFrame) -> DataFrame:
    return df.join(solved.select("code").distinct(), "code", "left_anti")


def of_skills(df: DataFrame, skills: DataFrame) -> DataFrame:
    return df.join(skills.select("skill").distinct(), "skill", "left_semi")


def unsolved_skills(invalid: DataFrame, valid: DataFrame) -> DataFrame:
    return invalid.select("skill").distinct().join(valid.select("skill").distinct(), "skill", "left_anti")


def lookup(df: DataFrame, dimension: DataFrame, key: str, value: str, default: str = "unknown") -> DataFrame:
    """df with the dimension's value of its key, or the default. The dimension has one row a key."""
    return df.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def flatten_clusters(clusters: DataFrame) -> DataFrame:
    """(skill, category, skill_description) of clusters (category, members)."""
    return clusters.select("category", F.explode("members").alias("m")).select("m.skill", "category", F.col("m.description").alias("skill_description"))


def add_hints(df: DataFrame, n: int) -> DataFrame:
    """The problem with its first n hints below it, numbered; without the hints column."""
    lines = F.transform(F.slice("hints", 1, n) if n else F.array().cast("array<string>"), lambda h, i: F.concat(F.lit("Hint "), (i + 1).cast("string"), F.lit(": "), h))
    return df.withColumn("problem", F.concat("problem", F.lit("\n\n"), F.array_join(lines, "\n"))).drop("hints")


def observed_hidden(df: DataFrame, column: str) -> DataFrame:
    """df with the first half of the array (shorter if odd) and the rest."""
    half = F.floor(F.size(column) / 2).cast("int")
    return df.withColumns({"observed": F.slice(column, 1, half), "hidden": F.slice(column, half + 1, F.size(column))})


def ground_truth() -> Column:
    """Of a function task the second half of its pairs, of others the output; as JSON text."""
    pairs = F.transform(F.arrays_zip(F.col("inputs").alias("i"), F.col("outputs").alias("o")), lambda p: F.array(p["i"], p["o"]))
    half = F.floor(F.size("inputs") / 2).cast("int")
    return F.when(F.col("task_type") == "code_func", F.to_json(F.slice(pairs, half + 1, F.size("inputs")))).otherwise(F.col("output"))


def skill_lines(df: DataFrame, column: str) -> Column:
    """A map as lines ``name: description``."""
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def too_hard(score: str, low: float) -> Column:
    return F.col(score) <= low


def again(df: DataFrame) -> DataFrame:
    """Invalid function tasks that can be asked again: they have a problem, inputs and outputs."""
    return df.filter(F.col("problem").isNotNull() & F.col("inputs").isNotNull() & F.col("outputs").isNotNull())


def with_hints(df: DataFrame) -> DataFrame:
    return df.filter(F.col("hints").isNotNull())
