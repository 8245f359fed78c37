"""Documents that keep coming: only new content is processed, only touched documents are cut and indexed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def distinct_content(stream: DataFrame, column: str = "text", at: str | None = None, delay: str = "1 day") -> DataFrame:
    """The stream with ``sha256``, and each content once.

    With an event time, contents are remembered for ``delay``; without, for good.
    """
    hashed = stream.withColumn("sha256", F.sha2(F.col(column), 256))
    if at:
        return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["sha256"])
    return hashed.dropDuplicates(["sha256"])


def process(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``step(batch, number)`` on every batch; a batch that fails is run again with its number."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def index_into(path: str) -> Callable[[DataFrame, int], None]:
    """A step that cuts a batch's pages into chunks, a folder for each batch: a batch that comes again replaces it."""
    from pagewright.operators.structure import chunk

    def step(batch: DataFrame, number: int) -> None:
        pages = batch.select(F.col("sha256").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("markdown"))
        chunk(pages).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def job_states(events: DataFrame, at: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Latest state of each job in each window of event time; works on a stream and on a table."""
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    last = F.max_by(F.struct("event_type", at), F.struct(at, "event_id"))
    return rows.groupBy(F.window(at, width).alias("w"), "user_id").agg(last.alias("j"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "user_id", F.col("j.event_type").alias("state"), "n")
