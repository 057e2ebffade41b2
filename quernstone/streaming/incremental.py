"""Incremental runs of row-wise operators.

Operators that look at one row at a time run unchanged on a stream of JSON files; each micro-batch is written by
split or decision. Operators that need the whole table (frequencies, quantiles, splits) stay in batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def json_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def route(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, decision: str = "decision") -> StreamingQuery:
    """Runs what is there and stops; a batch that is run again overwrites its own folder, so that every row is there once."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").partitionBy(decision).parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
