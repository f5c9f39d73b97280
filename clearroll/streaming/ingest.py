"""Arriving files validated batch by batch, and failed tasks tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import canonical_rows


def validate_arrivals(
    spark: SparkSession,
    arrivals: str,
    schema: str,
    target: str,
    checkpoint: str,
    validate: Callable[[DataFrame], DataFrame] | None = None,
    files_per_trigger: int = 100,
):
    """Every new CSV file in a folder: rows cleaned, checked and written.

    Good rows go through ``validate`` (any batch plan) to ``target/good``, the others to
    ``target/bad``, each batch in a folder of its own that a retry replaces.  Returns the
    started query, which ends when all files there have been taken.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        checked = canonical_rows(batch)
        good = validate(checked.good) if validate else checked.good
        good.write.mode("overwrite").parquet(f"{target}/good/batch_id={batch_id}")
        checked.bad.write.mode("overwrite").parquet(f"{target}/bad/batch_id={batch_id}")

    files = (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(arrivals)
    )
    return (
        files.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def retry_failed(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Tasks to run again: failed, never successful, with attempts left.

    ``attempts`` has task_id, status and attempt; one aggregate decides per task.
    """
    per_task = attempts.groupBy("task_id").agg(
        F.max("attempt").alias("attempts"),
        F.bool_or(F.col("status") == "completed").alias("_ok"),
        F.bool_or(F.col("status") == "failed").alias("_failed"),
    )
    return per_task.where(F.col("_failed") & ~F.col("_ok") & (F.col("attempts") < most)).select(
        "task_id", (F.col("attempts") + 1).alias("attempt")
    )


def retry_stream(results: DataFrame, queue: str, checkpoint: str, most: int = 3):
    """Results of tasks as they arrive; after each batch the tasks due again are written to ``queue``.

    The attempts of a task are counted in the state store (see :func:`retry_failed`), so a
    batch costs as much as it brings, however long the history is.  A batch writes a folder
    of its own, ``batch_id=``, which a retry of the batch replaces.
    """

    def one_batch(due: DataFrame, batch_id: int) -> None:
        due.write.mode("overwrite").parquet(f"{queue}/batch_id={batch_id}")

    return (
        retry_failed(results, most).writeStream.foreachBatch(one_batch)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
