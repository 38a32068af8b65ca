"""Streams: informative groups until a batch is full, controller state, metric appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import sampling
from quern.operators.metrics import adaptive_coefficient, reduce_named
from quern.sources.readers import exists


class GroupAccumulator:
    """Collects informative groups over generation batches until ``batch`` of them are there, writes them as one training batch,
    tosses the rest, and starts anew. ``most`` generation batches without a full one raise.

    The state (kept rows so far) is a table in the checkpoint folder, replaced as a whole per generation batch and named by its
    epoch, so a retried epoch finds the same input.
    """

    def __init__(self, path: str, batch: int, metric: str = "acc", group: str = "uid", order: str = "event_id", most: int = 10):
        self.path, self.batch, self.metric, self.group, self.order, self.most = path, batch, metric, group, order, most

    def _state(self, spark: SparkSession, epoch: int) -> tuple[DataFrame | None, int, int]:
        """Rows kept before the epoch, generation batches they came from, and training batches so far."""
        meta = f"{self.path}/meta/{epoch - 1}"
        if epoch == 0 or not exists(spark, meta):
            return None, 0, 0
        m = spark.read.json(meta).first()
        return (spark.read.parquet(f"{self.path}/state/{epoch - 1}") if m["rows"] else None), m["waited"], m["made"]

    def __call__(self, df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        before, waited, made = self._state(spark, epoch)
        fresh = sampling.informative(df, self.metric, self.group).filter("keep").drop("keep")
        rows = (fresh if before is None else before.unionByName(fresh)).persist()
        try:
            groups = rows.groupBy(self.group).agg(F.min(self.order).alias("first"))
            if groups.count() >= self.batch:
                chosen = groups.orderBy("first", self.group).limit(self.batch).select(self.group)
                rows.join(chosen, self.group, "left_semi").write.mode("overwrite").parquet(f"{self.path}/batches/batch={made}")
                kept, waited, made = 0, 0, made + 1
            else:
                waited += 1
                if waited >= self.most:
                    raise RuntimeError(f"no full batch after {waited} generation batches")
                kept = rows.count()
                if kept:
                    rows.write.mode("overwrite").parquet(f"{self.path}/state/{epoch}")
        finally:
            rows.unpersist()
        spark.createDataFrame([(kept, waited, made)], "rows long, waited long, made long").coalesce(1).write.mode("overwrite").json(f"{self.path}/meta/{epoch}")


def accumulate(stream: DataFrame, accumulator: GroupAccumulator, checkpoint: str) -> StreamingQuery:
    """Run the accumulator over all generation batches that are there."""
    return stream.writeStream.foreachBatch(accumulator).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reduce_stream(stream: DataFrame) -> DataFrame:
    """(step, name, value) reduced by name within each step."""
    return reduce_named(stream, ["step"])


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows over event time. An addition of this engine."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


class CoefficientState:
    """The adaptive coefficient over a stream of steps (step, current_kl, n): each epoch goes on from where the one before it ended.

    Written per epoch under the path, so a retried epoch replaces its own result only."""

    def __init__(self, path: str, start: float, target: float, horizon: float):
        self.path, self.start, self.target, self.horizon = path, start, target, horizon

    def __call__(self, df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        start = self.start
        for before in range(epoch - 1, -1, -1):  # the last epoch that had steps
            if exists(spark, f"{self.path}/epoch={before}"):
                last = spark.read.parquet(f"{self.path}/epoch={before}").agg(F.max_by("coefficient", "step")).first()[0]
                if last is not None:
                    start = last
                    break
        adaptive_coefficient(df, start, self.target, self.horizon).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
