"""Queries of the index and of ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.catalog import query
from pagewright.catalog.tables import FOLD_SQL, longs, table
from pagewright.functions import text as T
from pagewright.search import index as I
from pagewright.search import query as S


def chunks(spark, sf_dir):
    """Documents as passages under a heading each."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("document_id"), F.concat_ws(" ", "lang", "source").alias("heading"), T.fold(F.col("text")).alias("search_text"), F.lit("paragraph").alias("chunk_type"), F.col("text").alias("content"), (F.col("doc_id") % 50).alias("page_start"), (F.col("doc_id") % 50 + F.col("doc_id") % 4).alias("page_end"), F.lit(0).alias("math_count"), F.length("text").alias("token_estimate"))


def asked(spark, sf_dir, words: int = 3):
    """The first words of each benchmark item, the last one damaged where the item's number is odd."""
    b = table(spark, sf_dir, "benchmark")
    start = F.array_join(F.slice(F.split("text", " "), 1, words), " ")
    return b.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 1, F.concat(start, F.lit("zq"))).otherwise(start).alias("query"))


def _split(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _grams(text: str) -> str:
    long = rf"list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4)"
    return f"list_filter(flatten(list_transform({long}, lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))), lambda g: NOT contains(g, '_'))"


INDEX_SQL = f"""d_ AS (SELECT doc_id, {FOLD_SQL.format('text')} AS t, {FOLD_SQL.format("lang || ' ' || source")} AS h FROM documents),
w_ AS (SELECT doc_id, 'search_text' AS col, unnest({_split('t')}) AS term FROM d_ UNION ALL SELECT doc_id, 'heading', unnest({_split('h')}) FROM d_ UNION ALL SELECT doc_id, 'fuzzy', unnest({_grams('t')}) FROM d_),
p_ AS (SELECT col, term, doc_id, count(*) AS tf FROM w_ GROUP BY ALL),
l_ AS (SELECT doc_id, (SELECT count(*) FROM w_ WHERE w_.doc_id = d_.doc_id) AS len FROM d_),
tot_ AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l_)"""
ASKED_SQL = f"""q_ AS (SELECT item_id AS query_id, {FOLD_SQL.format("array_to_string(string_split(text, ' ')[1:3], ' ') || CASE WHEN item_id % 2 = 1 THEN 'zq' ELSE '' END")} AS q FROM benchmark),
t_ AS (SELECT query_id, 0 AS stage, unnest({_split('q')}) AS term FROM q_ UNION ALL SELECT query_id, 1, unnest({_split('q')}) FROM q_ WHERE len({_split('q')}) > 1 UNION ALL SELECT query_id, 2, unnest({_grams('q')}) FROM q_),
u_ AS (SELECT query_id, stage, term, count(*) AS times FROM t_ GROUP BY ALL),
k_ AS (SELECT query_id, stage, count(*) AS wanted FROM u_ GROUP BY ALL)"""
HITS_SQL = f"""{INDEX_SQL}, {ASKED_SQL},
f_ AS (SELECT query_id, stage, term, doc_id, max(times) AS times, sum(CASE col WHEN 'heading' THEN 2.0::DOUBLE WHEN 'fuzzy' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END * tf) AS f
  FROM u_ JOIN p_ USING (term) WHERE (stage = 2) = (col = 'fuzzy') GROUP BY ALL),
n_ AS (SELECT query_id, stage, term, count(*) AS df FROM f_ GROUP BY ALL),
s_ AS (SELECT query_id, stage, doc_id, count(*) AS matched, sum(times * CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS score
  FROM f_ JOIN n_ USING (query_id, stage, term) JOIN l_ USING (doc_id), tot_ GROUP BY ALL),
hits_ AS (SELECT query_id, stage, doc_id AS chunk_id, score FROM s_ JOIN k_ USING (query_id, stage) WHERE stage <> 0 OR matched = wanted)"""


@query(f"WITH {INDEX_SQL} SELECT col, term, doc_id AS chunk_id, tf FROM p_ WHERE col <> 'fuzzy'")
def postings(spark, sf_dir):
    return I.build(chunks(spark, sf_dir)).postings.where("col <> 'fuzzy'").select("col", "term", "chunk_id", "tf")


@query(f"WITH {INDEX_SQL} SELECT col, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p_ GROUP BY col, term")
def term_df(spark, sf_dir):
    return I.frequencies(I.build(chunks(spark, sf_dir)))


@query(f"WITH {INDEX_SQL} SELECT doc_id AS chunk_id, len, n, round(avgdl, 6) AS avgdl FROM l_, tot_")
def chunk_lengths(spark, sf_dir):
    i = I.build(chunks(spark, sf_dir))
    return i.lengths.crossJoin(F.broadcast(i.totals)).select("chunk_id", "len", "n", F.round("avgdl", 6).alias("avgdl"))


def _hits(spark, sf_dir, stage):
    return S.hits(I.build(chunks(spark, sf_dir)), asked(spark, sf_dir), stages=(stage,)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {HITS_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM hits_ WHERE stage = 0")
def search_exact(spark, sf_dir):
    return _hits(spark, sf_dir, S.EXACT)


@query(f"WITH {HITS_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM hits_ WHERE stage = 1")
def search_partial(spark, sf_dir):
    return _hits(spark, sf_dir, S.PARTIAL)


@query(f"WITH {HITS_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM hits_ WHERE stage = 2")
def search_approximate(spark, sf_dir):
    return _hits(spark, sf_dir, S.APPROXIMATE)


CASCADE_SQL = f"""{HITS_SQL}, b_ AS (SELECT query_id, min(stage) AS stage FROM hits_ GROUP BY query_id),
r_ AS (SELECT query_id, chunk_id, stage, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits_ JOIN b_ USING (query_id, stage))"""


@query(f"WITH {CASCADE_SQL} SELECT query_id, rank, chunk_id, ['exact', 'partial', 'approximate'][stage + 1] AS match FROM r_ WHERE rank <= 10")
def search_cascade(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return longs(S.search(I.build(c), c, asked(spark, sf_dir)).select("query_id", "rank", "chunk_id", "match"))


@query(f"""WITH {HITS_SQL}, g_ AS (SELECT hits_.* FROM hits_ JOIN documents ON chunk_id = doc_id WHERE lang = 'en' AND doc_id % 50 + doc_id % 4 >= 10 AND doc_id % 50 <= 20),
b_ AS (SELECT query_id, min(stage) AS stage FROM g_ GROUP BY query_id), r_ AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM g_ JOIN b_ USING (query_id, stage))
SELECT query_id, rank, chunk_id FROM r_ WHERE rank <= 10""")
def search_filtered(spark, sf_dir):
    c = chunks(spark, sf_dir)
    q = asked(spark, sf_dir).select("query_id", "query", F.lit("en").alias("document_id"), F.lit(10).alias("page_lo"), F.lit(20).alias("page_hi"), F.lit("paragraph").alias("chunk_type"))
    return longs(S.search(I.build(c), c, q).select("query_id", "rank", "chunk_id"))


@query(f"""WITH x AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array({FOLD_SQL.format("array_to_string(string_split(text, ' ')[1:3], ' ')")}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') AS q FROM benchmark),
y AS (SELECT doc_id, ' ' || array_to_string({_split(FOLD_SQL.format('text'))}, ' ') || ' ' AS t FROM documents)
SELECT item_id AS query_id, doc_id AS chunk_id FROM x JOIN y ON contains(t, ' ' || q || ' ') ORDER BY 1, 2""")
def search_phrase(spark, sf_dir):
    quoted = asked(spark, sf_dir).join(table(spark, sf_dir, "benchmark"), F.col("query_id") == F.col("item_id"))
    start = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    q = quoted.select("query_id", F.concat(F.lit('"'), start, F.lit('"')).alias("query"))
    return S.hits(I.build(chunks(spark, sf_dir)), q).select("query_id", "chunk_id")


def flagship(spark, sf_dir):
    """Ranked search of all benchmark items over all documents, with snippets."""
    c = chunks(spark, sf_dir)
    return S.search(I.build(c), c, asked(spark, sf_dir))


@query(f"""WITH {CASCADE_SQL} SELECT query_id, rank, CASE WHEN length(f) > 320 THEN regexp_replace(left(f, 320), ' [^ ]*$', '') || ' ...' ELSE f END AS snippet
FROM (SELECT query_id, rank, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM r_ JOIN documents ON chunk_id = doc_id WHERE rank <= 10)""")
def search_snippets(spark, sf_dir):
    return longs(flagship(spark, sf_dir).select("query_id", "rank", "snippet"))
