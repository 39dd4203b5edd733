"""Resumable ingest and running counters with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_status(status: DataFrame, key: str = "source") -> DataFrame:
    """Each source's last status row of an append-only table."""
    return status.groupBy(key).agg(F.max_by(F.struct(*(c for c in status.columns if c != key)), "finished").alias("s")).select(key, "s.*")


def pending(work: DataFrame, status: DataFrame, key: str = "source", done: tuple[str, ...] = ("completed", "skipped_long")) -> DataFrame:
    """Work whose last status is not done; failed work comes again."""
    return work.join(latest_status(status, key).where(F.col("status").isin(*done)), key, "left_anti")


def ingest(spark: SparkSession, schema: str, source: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """New Parquet files through ``process`` to ``out``, each batch in a folder of its own, so that a batch that is
    run again after a failure replaces what it left; ends when all files there are have been taken."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each id; ids are remembered as long as the watermark allows."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counters(stream: DataFrame, by: str) -> DataFrame:
    """Running count of each value, for ``complete`` or ``update`` mode."""
    return stream.groupBy(by).agg(F.count("*").alias("n"))


def annotate_new(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of a stream whose key an already written table has not."""
    return stream.join(known.select(key).distinct(), key, "left_anti")
