"""Engines that turn documents into pages. They run on the executors, on batches of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from pagewright.workspace import ship

PAGES = "document_id string, page_number int, markdown string, ocr_used boolean, is_scanned boolean, math_fonts boolean, native_chars int, has_images boolean, engine string, quality_tier string, error string"


class EngineUnavailable(RuntimeError):
    """The engine isn't installed here."""


class ExtractionEngine(Protocol):
    """``inspect`` and ``extract`` get a file's bytes; both return a row for each page, numbers from 1."""

    name: str
    quality_tier: str

    def available(self) -> bool: ...

    def version(self) -> str: ...

    def inspect(self, content: bytes) -> list[dict]: ...

    def extract(self, content: bytes, pages: list[int] | None = None) -> list[dict]: ...


class MarkdownEngine:
    """Reads UTF-8 Markdown whose pages are separated by form feeds."""

    name, quality_tier = "markdown", "fast"

    def available(self) -> bool:
        return True

    def version(self) -> str:
        return "1"

    def inspect(self, content: bytes) -> list[dict]:
        return [{"page_number": i, "native_chars": len(t.strip()), "has_images": "![" in t} for i, t in enumerate(content.decode("utf-8", "replace").split("\f"), 1)]

    def extract(self, content: bytes, pages: list[int] | None = None) -> list[dict]:
        texts = enumerate(content.decode("utf-8", "replace").split("\f"), 1)
        return [{"page_number": i, "markdown": t, "ocr_used": False, "is_scanned": False, "math_fonts": False, "native_chars": len(t.strip()), "has_images": "![" in t} for i, t in texts if pages is None or i in pages]


class _Absent:
    def __init__(self, name: str, quality_tier: str, what: str):
        self.name, self.quality_tier, self.what = name, quality_tier, what

    def available(self) -> bool:
        return False

    def version(self) -> str:
        return ""

    def inspect(self, content: bytes) -> list[dict]:
        raise EngineUnavailable(f"{self.name}: {self.what} is not installed")

    extract = inspect


#: Names by which engines are asked for.
ENGINES: dict[str, Callable[[], ExtractionEngine]] = {
    "markdown": MarkdownEngine,
    **{name: lambda: _Absent("pymupdf4llm", "fast", "a PDF reader") for name in ("pymupdf4llm", "pymupdf", "fast")},
    "marker": lambda: _Absent("marker", "high", "a layout engine"),
}


def get_engine(name: str) -> ExtractionEngine:
    if name not in ENGINES:
        raise EngineUnavailable(f"unknown engine: {name}")
    return ENGINES[name]()


def extract(files: DataFrame, engine: ExtractionEngine) -> DataFrame:
    """Pages of ``files(document_id, content[, pages])``. A file that fails gives one row with ``error`` and no page."""
    if not engine.available():
        raise EngineUnavailable(f"{engine.name} is not available")
    ship(files.sparkSession)
    names = [c.strip().split(" ")[0] for c in PAGES.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                common = {"document_id": r.document_id, "engine": engine.name, "quality_tier": engine.quality_tier}
                pages = getattr(r, "pages", None)
                try:
                    rows += [common | p for p in engine.extract(bytes(r.content), None if pages is None else list(pages)) if (p.get("markdown") or "").strip() or p.get("is_scanned") or engine.quality_tier == "fast"]
                except Exception as e:  # one file's failure is a row, not the job's end
                    rows.append(common | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([{n: row.get(n) for n in names} for row in rows], columns=names).astype({"page_number": "Int32", "native_chars": "Int32"})

    return files.mapInPandas(run, PAGES)


def renumber(extracted: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages that an engine numbers from 1 within what it was asked for, with the numbers that were asked for.

    Where a document's pages are as many as were asked for, the k-th takes the k-th number; else numbers stay.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    k = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    n = F.count("*").over(Window.partitionBy("document_id"))
    a = extracted.withColumn("__k", k).withColumn("__n", n)
    b = wanted.select("document_id", F.col("page_number").alias("__wanted")).distinct()
    b = b.withColumn("__k", F.row_number().over(Window.partitionBy("document_id").orderBy("__wanted"))).withColumn("__m", F.count("*").over(Window.partitionBy("document_id")))
    rows = a.join(b, ["document_id", "__k"], "left")
    number = F.when(F.col("__n") == F.col("__m"), F.col("__wanted")).otherwise(F.col("page_number"))
    return rows.select(*(number.alias(c) if c == "page_number" else F.col(c) for c in extracted.columns))
