"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words: space and \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator is about to use for its own output."""
    return df.drop(*names)


def aliased(df: DataFrame, name: str | None = None):
    """df with its columns renamed to __0, __1, ..., names that no operator uses; or the new one of the column of this name."""
    if name is not None:
        return F.col(f"__{df.columns.index(name)}")
    return df.toDF(*(f"__{i}" for i in range(len(df.columns))))


def named(rows: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of aliased(df) in rows, under the names that they have in df."""
    return rows.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(df.columns)))


def shared_dir(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir. Without one, a temporary folder serves a local session; on a cluster that is
    an error, since executors could not read it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if where is None:
        where = sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quern-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is there goes when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that later steps neither recompute it nor depend on an executor."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out


def tidy(spark: SparkSession) -> None:
    """Give back what the driver holds of finished steps: its Python's free memory, and once the JVM's heap has grown to ``HEAP_PART`` of
    its bound, the garbage there. Spark forgets shuffles and broadcasts only behind a collection, and the heap shrinks only then."""
    gc.collect()
    _trim()
    runtime = spark.sparkContext._jvm.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_PART * runtime.maxMemory():
        spark.sparkContext._jvm.System.gc()


#: See tidy.
HEAP_PART = 0.4


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_OWNED: list = [None, None]


def owned(name: str, make: Callable):
    """A worker's table of known words or the like. A worker keeps one at a time, so that those of earlier steps go."""
    if _OWNED[0] != name:
        _OWNED[:] = [name, make()]
    return _OWNED[1]


#: Rows of an Arrow batch at most: whole texts are long, and executors hold a batch on both sides of each worker.
ARROW_ROWS = 1000


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow, with batches of at most ARROW_ROWS rows from now on in the session."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, ARROW_ROWS)
    return df.mapInArrow(run, schema)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few rows at a time become Python objects. Behind the last one the worker, which stays for later
    tasks, gives its free memory back."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    batch = None
    _trim()


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo parts: the fold that labels are split by. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % F.lit(parts), F.lit(0)).cast("int")
