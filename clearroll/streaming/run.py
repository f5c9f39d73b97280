"""Running a stream to the end of what is there, into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's table and checkpoint.

    It lies in the folder all executors share, see :func:`shared_checkpoint_dir`.
    """
    return f"{shared_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table of the inputs, one file or a folder of them, as a stream of its files.

    A table without files raises when its schema is read.
    """
    from ..sources.derived import table

    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}.parque[t]")  # a glob may name a file, a plain path only a folder


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process all that is available and return the written rows.

    In append mode rows go to a parquet sink, exactly once.  In update mode every batch
    is written to its own folder, replaced if the batch is retried, and the rows carry
    ``batch_id``; :func:`latest_updates` keeps the last one per key.
    """
    spark = stream.sparkSession
    base = folder or work_folder(spark, "stream")
    target, state = f"{base}/table", f"{base}/checkpoint"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", target).outputMode("append")
        writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(target)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(save).outputMode(mode)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", target).parquet(target)


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row per key of a table of updates."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    newest = updates.groupBy(*keys).agg(F.max(F.struct("batch_id", *rest)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
