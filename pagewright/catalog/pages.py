"""Queries of page scores, passages, headings and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.catalog import query
from pagewright.catalog.tables import ASSESS_SQL, PAGES_SQL, STATE_SQL, conversation_pages, longs, table
from pagewright.catalog.texts import _literal, _values
from pagewright.functions import quality as Q
from pagewright.operators import structure
from pagewright.plans import documents as D

ASSESS_DOCS = ASSESS_SQL.replace("{source}", "(SELECT doc_id, lang, text AS m FROM documents)")


@query(f"SELECT doc_id, round(raw, 3)::DOUBLE AS score, {STATE_SQL} AS state, length(s) AS char_count, length(s) > 0 AND letters >= 20 AS has_text, len(bodies)::BIGINT AS display_math FROM ({ASSESS_DOCS})")
def page_quality(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", Q.assess(F.col("text")).alias("q"))
    return longs(q.select("doc_id", "q.score", "q.state", "q.char_count", "q.has_text", F.col("q.display_math_count").alias("display_math")))


@query(f"SELECT lang, {STATE_SQL} AS state, count(*) AS n FROM ({ASSESS_DOCS}) GROUP BY 1, 2")
def quality_histogram(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("lang", Q.assess(F.col("text"))["state"].alias("state"))
    return q.groupBy("lang", "state").agg(F.count("*").alias("n"))


@query(f"SELECT quality::BIGINT AS quality, state, count(*) AS n FROM (SELECT doc_id, {STATE_SQL} AS state FROM ({ASSESS_DOCS})) JOIN labels USING (doc_id) GROUP BY 1, 2")
def quality_vs_labels(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", Q.assess(F.col("text"))["state"].alias("state"))
    return longs(q.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "state").agg(F.count("*").alias("n")))


@query(r"""SELECT doc_id, (length(u) - length(replace(u, '$$', ''))) // 2 % 2 <> 0 OR (length(u) - length(replace(u, '$', ''))) % 2 <> 0 AS unmatched
FROM (SELECT doc_id, regexp_replace(replace(text, '\$', ''), '(?s)\$\$(.+?)\$\$', '', 'g') AS u FROM documents)""")
def unmatched_dollars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Q.unmatched_dollars(F.col("text")).alias("unmatched"))


@query("SELECT doc_id, (1 + length(replace(text, '$', '')) % 3)::BIGINT AS math_count FROM documents")
def math_count(spark, sf_dir):
    plain = F.replace("text", F.lit("$"), F.lit(""))
    extra = F.repeat(F.lit(" $a$ and $$b$$ "), F.lit(1))
    k = F.length(plain) % 3
    marked = F.concat(F.lit("$x_1$ "), plain, F.when(k == 2, extra).when(k == 1, " $c$").otherwise(""))
    return longs(table(spark, sf_dir, "documents").select("doc_id", Q.math_count(marked).alias("math_count")))


@query(r"""SELECT doc_id, round(CASE WHEN length(t) = 0 THEN 0 ELSE (length(t) - length(regexp_replace(t, '[\x{2200}-\x{22FF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{2A00}-\x{2AFF}\x{2100}-\x{214F}\x{2070}-\x{209F}\x{0370}-\x{03FF}]', '', 'g')))::DOUBLE / length(t) END, 9) AS density,
  round(CASE WHEN length(t) = 0 THEN 0 ELSE (length(t) - length(regexp_replace(t, '[\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{2070}-\x{209F}]', '', 'g')))::DOUBLE / length(t) END, 9) AS strong
FROM (SELECT doc_id, replace(replace(text, 'th', 'π∑'), 'e', '²') AS t FROM documents)""")
def math_density(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit("th"), F.lit("π∑")), F.lit("e"), F.lit("²"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.round(Q.math_density(F.col("t")), 9).alias("density"), F.round(Q.math_density(F.col("t"), True), 9).alias("strong"))


LOOKS = [("plain words", False), ("a ∑ b", True), ("$x$ here", True), ("καλημέρα κόσμε", True)]


@query(_literal([(*r, r[1] and r[0] != "καλημέρα κόσμε") for r in LOOKS], ["text", "mathematical", "in_greek"]))
def looks_mathematical(spark, sf_dir):
    rows = _values(spark, [(t,) for t, _ in LOOKS], "text string")
    return rows.select("text", Q.looks_mathematical(F.col("text")).alias("mathematical"), Q.looks_mathematical(F.col("text"), True).alias("in_greek"))


@query(r"""SELECT doc_id, CASE WHEN l > 0 AND (l - length(regexp_replace(x, '[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]', '', 'g')))::DOUBLE / l > 0.3 THEN 'ell' ELSE 'eng' END AS language
FROM (SELECT doc_id, x, length(x) AS l FROM (SELECT doc_id, regexp_replace(CASE WHEN lang = 'fr' THEN replace(replace(replace(t, 'e', 'ε'), 'a', 'α'), 'n', 'ν') ELSE t END, '[^\p{L}]', '', 'g') AS x FROM (SELECT doc_id, lang, replace(text, '$', '') AS t FROM documents)))""")
def greek_ratio_language(spark, sf_dir):
    t = F.replace("text", F.lit("$"), F.lit(""))
    greek = F.translate(t, "ean", "εαν")
    return table(spark, sf_dir, "documents").select("doc_id", Q.language(F.when(F.col("lang") == "fr", greek).otherwise(t)).alias("language"))


ASSESSED = [
    ("# Title\n\nA clean paragraph of ordinary readable prose.", 1.0, "good", ""),
    ("   \n", 0.0, "bad", "empty_page"),
    ("Some text " + "�" * 40, 0.0, "bad", "almost_no_text,garbled_chars:80.00%"),
    ("The book costs \\$40 and the shipping \\$5.", 1.0, "good", ""),
    ("A text with enough letters $a + b and more of it", 0.7, "warning", "unbalanced_math_delimiters"),
    ("Enough letters to be a text $$\\frac{a}{b$$ here", 0.85, "good", "unbalanced_braces_in_display_math"),
    ("Enough letters \\int f \\sum g \\prod h outside of math", 0.85, "good", "latex_outside_math:3"),
    ("Enough letters to be a page of text $$\\frac{x}{f(x) \\cdot g'(x)}$$", 0.85, "good", "underbrace_as_fraction:1"),
    ("Enough letters to be a page of text $$g(x) = \\phi(x) \\to g(x) = -1$$", 0.9, "good", "contradictory_definition:1"),
    ("Enough letters to be a page of text $$a = b, \\quad b = c$$", 1.0, "good", ""),
]


@query(_literal(ASSESSED, ["text", "score", "state", "issues"]).replace("\n", "' || chr(10) || '"))
def page_issues(spark, sf_dir):
    rows = _values(spark, [(x[0],) for x in ASSESSED], "text string").withColumn("q", Q.assess(F.col("text")))
    return rows.select("text", "q.score", "q.state", F.array_join("q.issues", ",").alias("issues"))


@query("SELECT 'Plain letters enough for a page of text' AS text, 0.4::DOUBLE AS score, 'bad' AS state, 'display_math_missing' AS issues")
def display_math_missing(spark, sf_dir):
    rows = _values(spark, [("Plain letters enough for a page of text",)], "text string")
    rows = rows.withColumn("q", Q.missing_display_math(Q.assess(F.col("text")), F.lit(True)))
    return rows.select("text", "q.score", "q.state", F.array_join("q.issues", ",").alias("issues"))


@query(f"""WITH {PAGES_SQL} SELECT document_id, page_number, sha256(markdown) AS page_hash, round(raw, 3)::DOUBLE AS quality_score, {STATE_SQL} AS quality_state,
  source_scanned AND NOT (length(s) > 0 AND letters >= 20) AND NOT ocr_used AS needs_ocr FROM ({ASSESS_SQL.replace("{source}", "(SELECT *, markdown AS m FROM pages_)")})""")
def scored_pages(spark, sf_dir):
    pages = conversation_pages(spark, sf_dir).withColumnRenamed("source_scanned", "is_scanned").withColumn("math_fonts", F.lit(False)).drop("char_count")
    return longs(D.score_pages(pages).select("document_id", "page_number", "page_hash", "quality_score", "quality_state", "needs_ocr"))


@query(f"""WITH {PAGES_SQL} SELECT document_id, count(*) AS page_count, coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (st <> 'good'), '') AS low_quality
FROM (SELECT document_id, page_number, {STATE_SQL} AS st FROM ({ASSESS_SQL.replace("{source}", "(SELECT *, markdown AS m FROM pages_)")})) GROUP BY document_id""")
def import_rollup(spark, sf_dir):
    pages = conversation_pages(spark, sf_dir).withColumnRenamed("source_scanned", "is_scanned").withColumn("math_fonts", F.lit(False)).drop("char_count")
    return D.rollup(D.score_pages(pages)).select("document_id", "page_count", F.array_join("low_quality_pages", ",").alias("low_quality"))


@query("SELECT conv_id::VARCHAR AS document_id, false AS greek_document, false AS greek_functions FROM conversations GROUP BY conv_id")
def document_flags(spark, sf_dir):
    return D.document_flags(conversation_pages(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- structure


@query()
def chunk_documents(spark, sf_dir):
    return longs(structure.chunk(conversation_pages(spark, sf_dir)))


@query(r"""SELECT conv_id::VARCHAR AS document_id, sum(len(list_filter(regexp_split_to_array(text, '[\s]+'), lambda w: w <> '')))::BIGINT AS n_words,
  sha256(string_agg(regexp_replace(text, '\s', '', 'g'), '' ORDER BY turn)) AS letters FROM conversations GROUP BY conv_id""")
def chunk_content_kept(spark, sf_dir):
    chunks = structure.chunk(conversation_pages(spark, sf_dir))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    letters = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.regexp_replace("content", r"\s", "").alias("t")))), lambda x: x["t"])
    return chunks.groupBy("document_id").agg(F.sum(words).alias("n_words"), F.sha2(F.array_join(letters, ""), 256).alias("letters"))


CHUNKED = [("d", 1, "# Proof\n\nAn opening sentence."), ("d", 2, "Λύση Έχουμε δύο συναρτήσεις.\n\nΤέλος."), ("d", 3, "$$\na\n\nb\n$$\n\nΆσκηση 4 x")]
CHUNKS = [("d", 0, 1, 1, "Proof", "proof", "# Proof\n\nAn opening sentence."), ("d", 1, 2, 3, "Λύση", "solution", "Λύση Έχουμε δύο συναρτήσεις.\n\nΤέλος.\n\n$$\na\n\nb\n$$"), ("d", 2, 3, 3, "Άσκηση 4", "exercise", "Άσκηση 4 x")]


@query(_literal(CHUNKS, ["document_id", "ordinal", "page_start", "page_end", "heading", "chunk_type", "content"]).replace("\n", "' || chr(10) || '"))
def chunk_structure(spark, sf_dir):
    pages = _values(spark, CHUNKED, "document_id string, page_number int, markdown string")
    return longs(structure.chunk(pages).select("document_id", "ordinal", "page_start", "page_end", "heading", "chunk_type", "content"))


@query("""WITH o AS (SELECT o_custkey::VARCHAR AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, o_orderpriority AS raw_heading FROM orders),
g AS (SELECT *, sum(CASE WHEN raw_heading = prev THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY ordinal) AS run FROM
  (SELECT *, lag(raw_heading) OVER (PARTITION BY document_id ORDER BY ordinal) AS prev FROM o)),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, run ORDER BY ordinal) AS k, count(*) OVER (PARTITION BY document_id, run) AS n FROM g)
SELECT document_id, ordinal, raw_heading, CASE WHEN n > 1 THEN raw_heading || ' (' || k || '/' || n || ')' ELSE raw_heading END AS heading FROM k""")
def number_headings(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    ordinal = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = o.select(F.col("o_custkey").cast("string").alias("document_id"), ordinal.alias("ordinal"), F.col("o_orderpriority").alias("raw_heading"))
    return longs(structure.number_headings(rows))


@query("""SELECT user_id::VARCHAR AS document_id, event_id AS line_number, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS current FROM events""")
def carry_headings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.col("event_id").alias("line_number"), F.when(F.col("event_type") == "signup", F.col("props")).alias("heading"))
    return structure.carry_headings(rows).select("document_id", "line_number", "current")


@query("""SELECT conv_id AS request_id, conv_id::VARCHAR AS document_id, 'user' AS heading, min(turn) + 1 AS page_start, max(turn) + 1 AS page_end, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content
FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def section_assemble(spark, sf_dir):
    p = conversation_pages(spark, sf_dir)
    chunks = p.select("document_id", (F.col("page_number") - 1).alias("ordinal"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.col("role").alias("raw_heading"), F.col("role").alias("heading"), F.col("markdown").alias("content"))
    requests = p.select("document_id").distinct().select(F.col("document_id").cast("long").alias("request_id"), "document_id", F.lit("User").alias("section"))
    return longs(structure.section(chunks, requests))


@query("""SELECT DISTINCT conv_id::VARCHAR AS document_id, role AS heading FROM conversations""")
def section_headings(spark, sf_dir):
    return conversation_pages(spark, sf_dir).select("document_id", F.col("role").alias("heading")).distinct()
