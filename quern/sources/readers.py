"""Sources: seed problems, JSON lines, Parquet, staged tables, and a registry of further readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import schemas

_READERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Register a reader (spark, path, **options) -> DataFrame."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if _READERS.get(name, f) is not f:
            raise ValueError(f"another reader has the name {name}")
        _READERS[name] = f
        return f

    return add


def reader(name: str) -> Callable[..., DataFrame]:
    if name not in _READERS:
        raise ValueError(f"no reader has the name {name}; there are {sorted(_READERS)}")
    return _READERS[name]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_SEED = "map<string,struct<description:string,runtime_limit:double,runtime_limit_sentences:array<string>,memory_limit:double,memory_limit_sentences:array<string>,solution_python3:string>>"


@register("usaco")
def seeds(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Seed problems from JSON files that map ids to problems: each text with its sentences on time and memory."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _SEED)).alias("problem_id", "p"))
    sentence = lambda c, form: F.coalesce(F.try_element_at(F.col(f"p.{c}_sentences"), F.lit(1)), F.format_string(form, F.col(f"p.{c}")))
    text = F.concat_ws("\n", "p.description", sentence("runtime_limit", "Time limit: %.0f seconds"), sentence("memory_limit", "Memory limit: %.0f MB"))
    rows = raw.select("problem_id", text.alias("problem"), F.col("p.solution_python3").alias("solution"))
    return rows if most is None else rows.orderBy("problem_id").limit(most)


@register("taco")
def _taco(spark: SparkSession, path: str, **_: object) -> DataFrame:
    raise NotImplementedError("this data set isn't supported")


@register("jsonl")
def json_lines(spark: SparkSession, paths: list[str] | str, schema: str = schemas.TASK, task_type: str | None = None, skip_missing: bool = True) -> DataFrame:
    """The rows of all files, of one task type if asked. Files that aren't there are skipped unless skip_missing is off."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in paths if exists(spark, p)]
    if len(there) < len(paths) and not skip_missing:
        raise FileNotFoundError(str(sorted(set(paths) - set(there))))
    rows = spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)
    return rows if task_type is None else rows.filter(F.col("task_type") == task_type)


@register("parquet")
def parquet(spark: SparkSession, paths: list[str] | str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return rows.select(*columns) if columns else rows


@register("json")
def json(spark: SparkSession, paths: list[str] | str, schema: str | None = None) -> DataFrame:
    found = spark.read.schema(schema) if schema else spark.read
    return found.json(paths)


def staged(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; if it isn't there it is made and written first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
