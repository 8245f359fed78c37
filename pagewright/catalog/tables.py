"""The document tables as the queries see them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as long, as SQL has them."""
    whole = (t.IntegerType, t.ShortType, t.ByteType)
    return df.select(*(F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, whole) else F.col(f"`{f.name}`") for f in df.schema))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, a page for each turn; what users wrote counts as scanned, the rest of odd turns as OCR."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("markdown"), "role",
        (F.col("role") == "user").alias("source_scanned"), (F.col("role") == "system").alias("ocr_used"), F.length("text").alias("char_count"),
    )


PAGES_SQL = """pages_ AS (SELECT conv_id::VARCHAR AS document_id, turn + 1 AS page_number, text AS markdown, role,
  role = 'user' AS source_scanned, role = 'system' AS ocr_used, length(text) AS char_count FROM conversations)"""


def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as library entries."""
    d = table(spark, sf_dir, "documents")
    sha = F.sha2("text", 256)
    return d.select(
        F.col("doc_id").cast("string").alias("id"), sha.alias("sha256"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("filename"),
        F.when(F.col("lang") != "fr", F.concat_ws(" ", "lang", F.col("doc_id").cast("string"))).otherwise("").alias("title"), F.lit("complete").alias("status"), F.when(F.col("source") == "src1", "scanned").otherwise("digital_text").alias("kind"),
        F.lit(1).alias("page_count"), F.col("lang").alias("language"), F.lit("fast").alias("quality_tier"), F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("created_at"),
    )


DOCUMENTS_SQL = """docs_ AS (SELECT doc_id::VARCHAR AS id, sha256(text) AS sha256, source || '-' || doc_id AS filename,
  CASE WHEN lang <> 'fr' THEN lang || ' ' || doc_id ELSE '' END AS title, 'complete' AS status,
  CASE WHEN source = 'src1' THEN 'scanned' ELSE 'digital_text' END AS kind, 1 AS page_count, lang AS language,
  'fast' AS quality_tier, n_chars AS size_bytes, doc_id AS created_at FROM documents)"""

#: What the built-in scores come to, in SQL, for a column m.
ASSESS_SQL = r"""SELECT *, CASE WHEN length(s) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0
    - CASE WHEN letters < 20 THEN 0.5 ELSE 0 END - CASE WHEN unmatched THEN 0.3 ELSE 0 END - CASE WHEN unbalanced THEN 0.15 ELSE 0 END)) END AS raw
  FROM (SELECT *, length(regexp_replace(s, '[^\p{L}]', '', 'g')) AS letters,
    (length(u) - length(replace(u, '$$', ''))) // 2 % 2 <> 0 OR (length(u) - length(replace(u, '$', ''))) % 2 <> 0 AS unmatched,
    len(list_filter(bodies, lambda b: length(replace(b, '{', '')) <> length(replace(b, '}', '')))) > 0 AS unbalanced
    FROM (SELECT *, regexp_replace(m, '^\s+|\s+$', '', 'g') AS s, regexp_extract_all(m, '(?s)\$\$(.+?)\$\$', 1) AS bodies,
      regexp_replace(replace(m, '\$', ''), '(?s)\$\$(.+?)\$\$', '', 'g') AS u FROM {source}))"""
STATE_SQL = "CASE WHEN raw >= 0.75 THEN 'good' WHEN raw >= 0.45 THEN 'warning' ELSE 'bad' END"
FOLD_SQL = "replace(lower(strip_accents({0})), 'ς', 'σ')"
