"""Streaming evaluation: sample files as they arrive, results appended, running totals.

There is no event time in the data, so there are no windows or watermarks: results are appended exactly once by
batch id, and totals are kept as one row a batch, so a reader can poll from a cursor without missing rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import SAMPLE


def read_sample_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder."""
    return spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def exact_matches(samples: DataFrame) -> DataFrame:
    """One row for each error sample: whether its code already equals its target."""
    return samples.filter(F.coalesce("has_errors", F.lit(False))).select("sample_index", (F.col("code") == F.col("fixed")).alias("exact"))


def append_results(stream: DataFrame, folder: str, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame] = exact_matches, *, once: bool = True) -> StreamingQuery:
    """Evaluate each batch and write it under its batch id; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    """batch, n, exact, running_rate (percent) after each batch."""
    from pyspark.sql import Window

    per = spark.read.parquet(folder).groupBy("batch").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"))
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("running_rate", 100.0 * F.sum("exact").over(upto) / F.sum("n").over(upto))


def counted(stream: DataFrame, name: str) -> StreamingQuery:
    """A running count of samples by has_errors, as an in-memory table."""
    table = stream.groupBy(F.coalesce("has_errors", F.lit(False)).alias("has_errors")).agg(F.count("*").alias("n"))
    return table.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
