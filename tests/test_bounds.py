"""Work that must not grow by how often something is named, and memory not with a batch."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.functions import quality as Q
from pagewright.functions import text as T
from pagewright.functions.udf import SLICE_BYTES, batch_udf, slices


def _plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_look_at_a_page_once(spark):
    pages = spark.createDataFrame([("a page",), (None,), (" 　 ",)], "markdown string").repartition(1).select(Q.assess(F.col("markdown")).alias("q"))
    plan = _plan(pages.select("q.score", "q.state", "q.issues", "q.has_text", "q.display_math_count"))
    assert plan.count(r"[\x{FFFD}\x{E000}-\x{F8FF}]") == 1
    assert [tuple(r) for r in pages.select("q.score", "q.state", "q.issues", "q.char_count", "q.has_text").collect()] == [(0.5, "warning", ["almost_no_text"], 6, False)] + [(0.0, "bad", ["empty_page"], 0, False)] * 2


def test_letters_are_counted_up_to_twenty(spark):
    texts = ["1-" * 50 + "é" * 19, "𝒳 " * 19 + "λ", "a\n" * 19, "a\n" * 20]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    assert sorted((r.t, r.has) for r in rows.select("t", Q.assess(F.col("t"))["has_text"].alias("has")).collect()) == sorted(zip(texts, [False, True, False, True], strict=True))


def test_trimming_is_python_stripping(spark):
    texts = ["\x1c a b\xa0\n", "​a​", "", "　", "\x85a᠎ "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sorted((r.t, r.s) for r in rows.select("t", T.trim(F.col("t")).alias("s")).collect()) == sorted((t, t.strip()) for t in texts)


def test_functions_get_a_batch_in_slices(spark):
    @batch_udf("n int, counts map<string,int>, words array<string>")
    def seen(text, other):
        size = sum(len(t) for t in text if t)
        return pd.DataFrame({"n": [size] * len(text), "counts": [{} if t is None else {t[:1]: k} for t, k in zip(text, other, strict=True)], "words": [None if t is None else [t[:1]] for t in text]})

    rows = spark.range(400).repartition(1).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("é"), 20_000)).alias("t"), F.col("id").cast("int").alias("k"))
    found = rows.select("id", seen("t", "k").alias("s")).select("id", "s.*").orderBy("id").collect()
    assert max(r.n for r in found) * 2 <= SLICE_BYTES and len(found) == 400  # letters of two bytes
    assert all((r.counts, r.words) == ({"é": r.id}, ["é"]) if r.id % 9 else (r.counts, r.words) == ({}, None) for r in found)


def test_slices_are_whole_and_in_order():
    arrays = (pa.array(["a" * (k % 50) for k in range(1000)]), pa.array(range(1000)))
    parts = list(slices(arrays, 600))
    assert [x for p in parts for x in p[1].to_pylist()] == list(range(1000)) and all(sum(a.nbytes for a in p) <= 600 for p in parts)
    assert len(list(slices((pa.array(["a" * 5000]),), 600))) == 1 and [len(p[0]) for p in slices((pa.array([], pa.string()),))] == [0]
