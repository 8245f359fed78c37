"""States of background jobs as an append-only table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("queued", "running")


def current(events: DataFrame) -> DataFrame:
    """The jobs table of ``events(id, document_id, kind, state, progress, detail, error, at)``: the latest of each job.

    Started and finished times come from the first event that says so; progress has three places; a document that any
    event names stays known.
    """
    order = F.struct("at", "progress")
    last = lambda c: F.max_by(c, order)
    first = lambda test: F.min(F.when(test, F.col("at")))
    known = F.max_by("document_id", F.when(F.col("document_id").isNotNull(), F.col("at")))
    return events.groupBy("id").agg(
        known.alias("document_id"), last("kind").alias("kind"), last("state").alias("state"), F.bround(last("progress"), 3).alias("progress"),
        last("detail").alias("detail"), last("error").alias("error"), F.min("at").alias("created_at"),
        first(F.col("state") == "running").alias("started_at"), first(F.col("state").isin("complete", "failed")).alias("finished_at"),
    )


def interrupt(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what was open has failed."""
    open_ = F.col("state").isin(*OPEN)
    error = F.when(open_, "interrupted: the server restarted").otherwise(F.col("error"))
    return jobs.withColumn("error", error).withColumn("state", F.when(open_, "failed").otherwise(F.col("state")))


def active(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("state").isin(*OPEN)).alias("active"))


def history(events: DataFrame) -> DataFrame:
    """Events with the state before."""
    return events.withColumn("previous", F.lag("state").over(Window.partitionBy("id").orderBy("at", "progress")))
