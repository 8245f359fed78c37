"""Engines that read a page again from its image and propose a text. They are plug-ins; none is part of this package."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.workspace import ship

PROPOSALS = "document_id string, page_number int, markdown string, confidence double, warnings array<string>, model string, failure string"


class CorrectionEngine(Protocol):
    """``correct`` gets a page's text and whether to look closer, and returns the model's reply as text."""

    name: str

    def available(self) -> bool: ...

    def correct(self, document_id: str, page_number: int, markdown: str, closer: bool = False) -> str: ...


def targets(pages: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Pages to read again: those that are named, else what came from a scan or OCR."""
    if chosen is None:
        return pages.where(F.col("source_scanned") | F.col("ocr_used"))
    return pages.join(chosen.select("document_id", "page_number").distinct(), ["document_id", "page_number"], "left_semi")


def propose(pages: DataFrame, engine: CorrectionEngine, closer: bool = False) -> DataFrame:
    """Proposals for ``pages(document_id, page_number, markdown)``.

    A reply that is no JSON keeps its text without trust. An engine that isn't available, or fails on a page, leaves a
    row with the reason, no text and no confidence.
    """
    from pagewright.sources.files import proposal

    ship(pages.sparkSession)
    up, name = engine.available(), engine.name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, failures = [], []
            for r in batch.itertuples():
                try:
                    replies.append(engine.correct(r.document_id, r.page_number, r.markdown or "", closer) if up else None)
                    failures.append(None if up else f"{name} is not available")
                except Exception as e:  # one page's failure is a row
                    replies.append(None)
                    failures.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"document_id": batch.document_id, "page_number": batch.page_number, "reply": replies, "failure": failures})

    told = pages.select("document_id", "page_number", "markdown").mapInPandas(run, "document_id string, page_number int, reply string, failure string")
    p = proposal(F.coalesce("reply", F.lit("")))
    failed = F.col("failure").isNotNull()
    return told.withColumn("p", p).select(
        "document_id", "page_number", F.when(failed, "").otherwise(F.col("p.markdown")).alias("markdown"), F.when(failed, 0.0).otherwise(F.col("p.confidence")).alias("confidence"),
        F.when(failed, F.array("failure")).otherwise(F.col("p.warnings")).alias("warnings"), F.lit(name).alias("model"), "failure",
    )


def better_of(first: DataFrame, second: DataFrame) -> DataFrame:
    """Audit rows of two readings: the second only where it has strictly fewer warnings."""
    key = ["document_id", "page_number"]
    columns = first.columns
    pair = first.select(*key, F.struct(*columns).alias("a")).join(second.select(*key, F.struct(*columns).alias("b")), key, "left")
    wins = F.col("b").isNotNull() & (F.size("b.warnings") < F.size("a.warnings"))
    return pair.select(F.when(wins, F.col("b")).otherwise(F.col("a")).alias("r")).select("r.*")
