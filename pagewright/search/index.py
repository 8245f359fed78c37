"""A full-text index as tables: postings with positions, passage lengths, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.search import scan
from pagewright.workspace import ship

#: Columns of the index and what a word in them weighs.
WEIGHTS = {"search_text": 1.0, "heading": 2.0, "fuzzy": 0.1}


@dataclass
class Index:
    """``postings(chunk_id, col, term, tf, positions)``, ``lengths(chunk_id, len)``, ``totals(n, avgdl)``: one row.

    An index that isn't written yet has the ``texts`` it is made of too: queries read them, a passage at a time.
    """

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame
    texts: DataFrame | None = None

    def save(self, path: str, buckets: int = 64) -> None:
        """Write the index; postings are clustered by term, so that a query reads few row groups."""
        self.postings.repartitionByRange(buckets, "col", "term").sortWithinPartitions("col", "term").write.mode("overwrite").partitionBy("col").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "totals")))

    def populated(self) -> bool:
        return not self.postings.isEmpty()


def build(chunks: DataFrame, stem_headings: bool = False) -> Index:
    """The index of ``chunks(chunk_id, heading, search_text)``.

    ``search_text`` is what :func:`pagewright.functions.text.index_text` makes of a passage. Headings are folded but keep their endings, as they stand in the index by default; ``stem_headings`` cuts them too.
    """
    ship(chunks.sparkSession)
    heading = F.coalesce("heading", F.lit(""))
    heading = T.stem(T.fold(heading)) if stem_headings else heading
    text = F.coalesce("search_text", F.lit(""))
    rows = chunks.select("chunk_id", text.alias("text"), T.fold(heading).alias("heading"))
    texts = rows.select("chunk_id", T.spaced_tokens(F.col("text")).alias("t"), T.spaced_tokens(F.col("heading")).alias("h"), *T.gram_text(F.col("text")))
    key, texts_of = texts.schema["chunk_id"].dataType.simpleString(), lambda *columns: texts.select("chunk_id", *columns)
    words = texts_of("t", "h").mapInArrow(scan.word_postings, f"chunk_id {key}, col string, term string, tf long, positions array<int>")
    grams = texts_of("t", "g", "cut").mapInArrow(scan.gram_postings, f"chunk_id {key}, term string, tf long")
    grams = grams.select("chunk_id", F.lit("fuzzy").alias("col"), "term", "tf", F.array().cast("array<int>").alias("positions"))
    lengths = texts.mapInArrow(scan.lengths, f"chunk_id {key}, len long")
    return Index(words.unionByName(grams), lengths, lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")), texts)


def frequencies(index: Index) -> DataFrame:
    """(col, term, df, cf): how many passages have a term in a column, and how often."""
    if index.texts is None:
        return index.postings.groupBy("col", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return index.texts.mapInArrow(scan.frequencies, "col string, term string, df long, cf long").groupBy("col", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def refresh(index: Index, chunks: DataFrame, touched: DataFrame) -> Index:
    """The index after the chunks of some documents changed: ``touched(chunk_id)`` go, ``chunks`` come."""
    new = build(chunks)
    gone = touched.select("chunk_id").union(chunks.select("chunk_id")).distinct()
    keep = lambda df: df.join(gone, "chunk_id", "left_anti")
    lengths = keep(index.lengths).unionByName(new.lengths)
    return Index(keep(index.postings).unionByName(new.postings), lengths, lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")))
