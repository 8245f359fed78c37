"""A corpus pipeline of four stages; each works on all rows that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, mixing, rule_ensemble, simhash_bk
from pagewright.llm.queries import table, vocabulary_path
from pagewright.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of these documents."""
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash_bk.keep_one_similar(Workspace(spark, "near-dedup"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each pass that takes words of a document."""
    return mixing.Mix(Workspace(spark, "mix"), docs).texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, encoded and decoded again: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("bpe", encode)]

#: SQL can't tell a classifier's fit; the pipeline is tested against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
