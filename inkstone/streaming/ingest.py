"""Incremental ingest: new files are parsed once, what fails goes to a table of its own, and the stream goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.sources import parse

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the documents that appear under a folder."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.[dD][oO][cC]").option("recursiveFileLookup", "true").load(root)
    return found.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def ingest(stream: DataFrame, target: str, checkpoint: str, password: str | None = None) -> StreamingQuery:
    """Parses what has arrived and stops. Each batch is a folder of its own, named by its number and replaced whole, so a
    batch that runs again after a failure leaves its rows once."""

    def save(batch: DataFrame, number: int) -> None:
        whole = f"{target}/documents/batch={number}"
        parse.parse(batch, "path", password=password).write.mode("overwrite").parquet(whole)
        # The model is read back, not parsed again, for the table of failures: three narrow columns of it.
        kept = batch.sparkSession.read.parquet(whole).filter("status = 'failed'").select("path", "error_class", "error_message")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{target}/errors/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, at: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by key and window, one after another or, with ``slide``, one each such step; state of a window goes once events
    can be no later than ``late``."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Counts by key and stretch of events that are less than ``gap`` apart; a stretch is given once no event can join it."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def run_once(stream: DataFrame, folder: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` applied to all that a stream has now, by micro-batches, with its result as a table."""
    spark = stream.sparkSession
    result = change(stream)
    result.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")
