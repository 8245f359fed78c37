"""Ranked search: BM25 against SQLite's full-text index, phrases, filters, stages."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.search import index as I
from pagewright.search import query as S

WORDS = "alpha beta gamma delta epsilon theorem proof matrix series integral sum limit".split()
CHUNKS = "chunk_id long, document_id string, page_start int, page_end int, heading string, chunk_type string, content string, search_text string, math_count int, token_estimate int"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [(i, f"d{i % 3}", i % 9, i % 9 + i % 2, rng.choice([None, "Theorem 1", "proof", "Matrix Series"]), rng.choice(["proof", "paragraph"]), t := " ".join(rng.choices(WORDS, k=rng.randint(1, 40))), t, 0, 1) for i in range(120)]


@pytest.fixture(scope="module")
def chunks(spark, corpus):
    return spark.createDataFrame(corpus, CHUNKS).cache()


@pytest.fixture(scope="module")
def index(chunks):
    return I.build(chunks)


def grams(text):
    return " ".join(w[i : i + 3] for w in text.split() if len(w) >= 4 for i in range(len(w) - 2))


@pytest.fixture(scope="module")
def sqlite(corpus):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(search_text, heading, fuzzy, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, search_text, heading, fuzzy) VALUES (?, ?, ?, ?)", [(r[0], r[7], r[4] or "", grams(r[7])) for r in corpus])
    return con


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


@pytest.mark.parametrize(
    ("query", "match", "stage"),
    [("theorem", "{search_text heading} : (theorem)", 0), ("matrix proof", "{search_text heading} : (matrix proof)", 0), ("gamma gamma delta", "{search_text heading} : (gamma OR gamma OR delta)", 1), ("integrul", "{fuzzy} : (int OR nte OR teg OR egr OR gru OR rul)", 2), ('"alpha beta"', '{search_text heading} : ("alpha beta")', 0)],
)
def test_scores_are_those_of_a_full_text_index(spark, index, sqlite, query, match, stage):
    told = dict(sqlite.execute("SELECT rowid, -bm25(f, 1.0, 2.0, 0.1) FROM f WHERE f MATCH ?", (match,)).fetchall())
    found = {r.chunk_id: r.score for r in S.hits(index, queries(spark, query)).where(F.col("stage") == stage).collect()}
    assert set(found) == set(told) and told
    assert all(abs(found[i] - told[i]) < 1e-9 for i in told)


def test_stages_widen_one_by_one(spark, index, chunks):
    found = S.search(index, chunks, queries(spark, "alpha", "alpha nosuchword", "theorxm", "zzzz", "", "(", '"no such phrase"'), 5).collect()
    how = {r.query_id: r.match for r in found}
    assert how == {0: "exact", 1: "partial", 2: "approximate"}
    assert max(r.rank for r in found) == 5 and all(len(r.snippet) <= 324 for r in found)


def test_filters_narrow_before_the_stage(spark, index, chunks):
    rows = [(0, "alpha", "d1", 2, 3, "proof"), (1, "alpha", None, None, None, None)]
    asked = spark.createDataFrame(rows, "query_id long, query string, document_id string, page_lo int, page_hi int, chunk_type string")
    found = S.search(index, chunks, asked, 1000).collect()
    mine = [r for r in found if r.query_id == 0]
    assert mine and all(r.document_id == "d1" and r.page_start <= 3 and r.page_end >= 2 and r.chunk_type == "proof" for r in mine)
    scores = {r.chunk_id: r.score for r in found if r.query_id == 1}
    assert all(scores[r.chunk_id] == r.score for r in mine)


def test_index_is_saved_and_refreshed(spark, index, chunks, tmp_path):
    index.save(str(tmp_path / "i"), 4)
    again = I.Index.load(spark, str(tmp_path / "i"))
    key = lambda i: sorted(map(tuple, S.hits(i, queries(spark, "matrix")).select("chunk_id", F.round("score", 9)).collect()))
    assert again.populated() and key(again) == key(index)
    changed = chunks.where("chunk_id < 10").withColumn("search_text", F.lit("matrix only"))
    new = I.refresh(index, changed, changed)
    assert key(new) == key(I.build(chunks.where("chunk_id >= 10").unionByName(changed)))


def test_query_plan_joins_on_terms(spark, index):
    plan = S.hits(index, queries(spark, "alpha"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_greek_inflection_meets(spark):
    rows = spark.createDataFrame([(1, None, "Η συνάρτηση και τα μερικά κλάσματα")], "chunk_id long, heading string, content string")
    i = I.build(rows.withColumn("search_text", T.index_text(F.col("content"))))
    found = {r.query_id for r in S.hits(i, queries(spark, "ΣΥΝΆΡΤΗΣΗΣ", "μερικών κλασμάτων")).where("stage = 0").collect()}
    assert found == {0, 1}
