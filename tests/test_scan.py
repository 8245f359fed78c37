"""Indexes that are read a passage at a time: without shuffles, and with the results of written ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.search import index as I
from pagewright.search import query as S
from pagewright.search import scan

ODD = ["", " ", "alpha_beta gamma_1 _x_ abcd", "lpha beta gam", "𝒳𝒴𝒵𝒲 ðelta 𐐷𐐷𐐷𐐷", "alpha beta alpha beta alpha", "the\x00re was a alpha", "x", None, "a__b __ _", "αλφα βητα", "1234 56 789a"]
CHUNKS = "chunk_id string, document_id string, page_start int, page_end int, heading string, chunk_type string, content string, search_text string, math_count int, token_estimate int"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta theorem alphabet betas be".split()
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(60)] * 3
    rows = [(f"c{i}", f"d{i % 3}" if i % 7 else None, i % 9 if i % 5 else None, i % 9 + i % 2, rng.choice([None, "Álpha beta", "beta"]), rng.choice(["proof", None]), t, t, 0, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNKS).repartition(5).cache()


@pytest.fixture(scope="module")
def written(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    I.build(chunks).save(path, 3)
    return I.Index.load(spark, path)


def asked(spark):
    texts = ["alpha beta", "alpha alpha nosuch", '"alpha beta"', '"beta alpha beta"', "alphabxt", "gamma_1", "x", "", "𐐷𐐷𐐷𐐷", "theorem delta gamma", '"beta" nosuch "alpha"', '"the re was"']
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_counts_and_scores_need_no_shuffle(spark, chunks):
    index = I.build(chunks)
    for df in (index.postings, index.lengths, S.hits(index, asked(spark))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_postings_are_the_tokens_and_trigrams_of_each_passage(spark, chunks):
    from pagewright.functions import text as T

    text = F.coalesce("search_text", F.lit(""))
    grams = F.when(F.contains(text, F.lit("_")), T.tokens(F.array_join(T.trigrams(text), " "))).otherwise(T.trigrams(text))
    columns = [("search_text", T.tokens(text)), ("heading", T.index_tokens(F.coalesce("heading", F.lit("")))), ("fuzzy", grams)]
    told = None
    for name, c in columns:
        each = chunks.select("chunk_id", F.lit(name).alias("col"), F.posexplode(c).alias("at", "term"))
        told = each if told is None else told.unionByName(each)
    told = told.groupBy("chunk_id", "col", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("at"))
    told = told.withColumn("positions", F.when(F.col("col") == "fuzzy", F.array().cast("array<int>")).otherwise(F.col("at")))
    index, columns = I.build(chunks), ("chunk_id", "col", "term", "tf", "positions")
    assert rows(index.postings, *columns) == rows(told, *columns)
    lengths = told.groupBy("chunk_id").agg(F.sum("tf").alias("len"))
    assert rows(index.lengths.where("len > 0"), "chunk_id", "len") == rows(lengths, "chunk_id", "len")
    assert index.lengths.count() == chunks.count()


def test_frequencies_are_those_of_the_postings(chunks, written):
    columns = ("col", "term", "df", "cf")
    told = rows(I.frequencies(written), *columns)
    assert {r[0] for r in told} == {"search_text", "heading", "fuzzy"} and told == rows(I.frequencies(I.build(chunks)), *columns)


def test_read_and_written_indexes_score_alike(spark, chunks, written):
    columns = ("query_id", "stage", "chunk_id", "score")
    told = rows(S.hits(written, asked(spark)), *columns)
    assert {r[1] for r in told} == {0, 1, 2} and told == rows(S.hits(I.build(chunks), asked(spark)), *columns)
    assert told == rows(S.hits(I.build(chunks), asked(spark), size_bound=3), *columns)
    assert [r for r in told if r[1] == 1] == rows(S.hits(I.build(chunks), asked(spark), stages=(S.PARTIAL,)), *columns)


@pytest.mark.parametrize("filtered", [False, True])
def test_read_and_written_indexes_rank_alike(spark, chunks, written, filtered):
    queries = asked(spark)
    if filtered:
        n = F.substring("query_id", 2, 9).cast("int")
        queries = queries.withColumns({"document_id": F.when(n % 3 > 0, F.lit("d1")), "page_lo": F.when(n % 2 > 0, n % 5), "page_hi": F.when(n % 4 > 0, F.lit(6)), "chunk_type": F.when(n % 5 == 0, "proof")})
    columns = ("query_id", "rank", "chunk_id", "match", "score", "snippet")
    told = rows(S.search(written, chunks, queries, 7), *columns)
    assert told and told == rows(S.search(I.build(chunks), chunks, queries, 7), *columns)


def test_the_best_are_kept_whatever_the_blocks(monkeypatch):
    rng, ids = np.random.default_rng(3), [f"c{i}" for i in range(400)]
    f = rng.integers(0, 4, (400, 5)).astype(float)
    scorer = scan.Scorer(pa.array([7, 8, 9]), np.array([0, 0, 1, 2]), np.array([0, 1, 2, 1]), np.array([2, 2, 1, 5]), np.array([0, 3, 5, 6, 7, 7]), np.array([0, 1, 3, 0, 1, 2, 3]), np.array([0.5, 0.5, 0.2, 0.3, 0.3, 1.0, 0.1]), 9.0, 1.2, 0.75)
    lists = lambda values, kind: pa.array([values(r) for r in f], pa.list_(kind))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([9] * 400, pa.int64()), lists(lambda r: np.flatnonzero(r).astype(np.int32), pa.int32()), lists(lambda r: r[r > 0], pa.float64())], ["chunk_id", "len", "ids", "f"])

    def best(batches):
        found = [r for b in batches for r in b.to_pylist()]
        first = {q: min(r["stage"] for r in found if r["query_id"] == q) for q in {r["query_id"] for r in found}}
        order = sorted((r["query_id"], -round(r["score"], 9), r["chunk_id"]) for r in found if r["stage"] == first[r["query_id"]])
        return [r for q in first for r in [x for x in order if x[0] == q][:10]]

    told = best(scorer.all([batch]))
    for cells in (4, 64, 1 << 18):
        monkeypatch.setattr(scan, "CELLS", cells)
        found = list(scorer.best({}, 10)([batch.slice(k, 90) for k in range(0, 400, 90)]))
        assert best(found) == told and sum(b.num_rows for b in found) < 200


def test_trigrams_are_coded_by_table_and_by_sorting_alike(monkeypatch):
    rng = random.Random(5)
    gram = np.array([scan.pack("".join(rng.choices("abé𝒳日", k=rng.randint(1, 3)))) for _ in range(500)], np.int64)
    for most in (1 << 20, 0):
        monkeypatch.setattr(scan, "MOST_TABLE", most)
        names, code = scan._coded(gram)
        assert (names[code] == gram).all() and (np.diff(names) > 0).all()
    assert [len(x) for x in scan._coded(gram[:0])] == [0, 0]
