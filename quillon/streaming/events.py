"""Structured Streaming: idempotent ingest, windows, and the cycle of stages over micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, like: str | None = None) -> DataFrame:
    """A stream over parquet files with the schema of those that are there."""
    import os

    schema = spark.read.parquet(like or path).schema
    folder, name = os.path.split(path.rstrip("/"))
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Rows of a stream once each by ``key``, as far back as ``late`` of event time."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp"))
    return timed.withWatermark("_time", late).dropDuplicatesWithinWatermark([key]).drop("_time")


def windowed(stream: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """Counts of a stream by windows of ``length`` and ``by``; a window is given out once it is ``late``."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return timed.groupBy(F.window("_time", length).alias("window"), *by).agg(F.count("*").alias("n"))


def run_to_end(stream: DataFrame, step: Callable[[DataFrame, int], None], name: str = "cycle") -> None:
    """Work off all that is there, batch by batch, with ``step``; progress is kept in the shared checkpoint folder."""
    place = f"{checkpoint_dir(stream.sparkSession)}/{name}-{uuid4().hex}"
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def cycle(stream: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], sink: str, most_errors: int = 10) -> Callable[[], int]:
    """A continuous cycle: each batch goes through ``stages`` and is written under ``sink`` by batch id.

    A batch that fails is counted and left out; after ``most_errors`` in a row the query
    fails. A batch written again replaces itself, so a restart repeats nothing.
    """
    state = {"errors": 0, "batches": 0}

    def step(batch: DataFrame, epoch: int) -> None:
        try:
            out = batch
            for stage in stages:
                out = stage(out)
            out.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")
            state["errors"] = 0
            state["batches"] += 1
        except Exception:
            state["errors"] += 1
            if state["errors"] >= most_errors:
                raise

    def run() -> int:
        run_to_end(stream, step)
        return state["batches"]

    return run


def deduplicated_counts(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, events) of a parquet table read as a stream, repeated ids dropped."""
    place = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    stream = deduplicated(read_stream(spark, path), "event_id", "ts")
    query = stream.select("event_id", "event_type").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count("*").alias("events"))
