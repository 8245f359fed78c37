"""Files in and out: document folders, word lists, engine JSON, page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.repair import lexicon_table


def document_files(spark: SparkSession, path: str, pattern: str = "*.pdf", content: bool = True) -> DataFrame:
    """(path, length, content) of the files below a folder, or of one file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "length", *(["content"] if content else []))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(folded, word) of a word list, a word a line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n")).alias("position", "value"))
    return lexicon_table(lines)


def engine_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, json, meta) of an engine's output folders: <document_id>/<name>.json and <name>_meta.json."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("p"))
    rows = rows.withColumn("document_id", F.regexp_extract("p", r"([^/]+)/[^/]+$", 1)).withColumn("is_meta", F.col("p").endswith("_meta.json"))
    return rows.groupBy("document_id").agg(F.min_by("value", F.when(~F.col("is_meta"), F.col("p"))).alias("json"), F.min_by("value", F.when(F.col("is_meta"), F.col("p"))).alias("meta"))


def write_page_files(pages: DataFrame, folder: str) -> None:
    """Pages as Parquet by document; the files of the documents that are written again are replaced."""
    spark = pages.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        pages.select("page_number", "markdown", "document_id").repartition("document_id").write.mode("overwrite").partitionBy("document_id").parquet(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select(F.col("document_id").cast("string"), "page_number", "markdown")


def read_library_folder(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, page_number, markdown) of documents/<id>/pages/NNNN.md; names that are no number are skipped."""
    rows = spark.read.text(f"{root}/documents/*/pages", wholetext=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("p"))
    number = F.regexp_extract("p", r"/(\d+)\.md$", 1)
    return rows.where(number != "").select(F.regexp_extract("p", r"/documents/([^/]+)/pages/", 1).alias("document_id"), number.cast("int").alias("page_number"), F.col("value").alias("markdown"))


def metadata(json: Column, schema: str) -> Column:
    """A metadata JSON by a schema; a missing or broken one has nulls."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def proposal(content: Column) -> Column:
    """struct(markdown, confidence, warnings) of a model's reply: its JSON object, else its text without trust."""
    clean = F.regexp_replace(content, r"^\s+|\s+$", "")
    told = F.from_json(F.regexp_extract(clean, r"(?s)\{.*\}", 0), "markdown string, confidence double, warnings array<string>")
    ok = F.coalesce(told["markdown"], F.lit("")) != ""
    text = F.regexp_replace(F.regexp_replace(clean, r"^```(?:markdown)?|```$", ""), r"^\s+|\s+$", "")
    return F.when(ok, F.struct(told["markdown"].alias("markdown"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(told["confidence"], F.lit(0.0)))).alias("confidence"), F.coalesce(told["warnings"], F.array().cast("array<string>")).alias("warnings"))).otherwise(
        F.struct(text.alias("markdown"), F.lit(0.0).alias("confidence"), F.array(F.lit("non-JSON model response")).alias("warnings"))
    )
