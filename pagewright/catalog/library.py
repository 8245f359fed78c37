"""Queries of imports, look-ups, updates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.catalog import query
from pagewright.catalog.tables import DOCUMENTS_SQL, PAGES_SQL, conversation_pages, library_documents, longs, table
from pagewright.catalog.texts import _literal, _values
from pagewright.functions import quality as Q
from pagewright.plans import documents as D
from pagewright.sources.files import proposal
from pagewright.streaming import jobs as J
from pagewright.streaming import landing


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("", F.lit("in/"), F.format_string("%012d", "doc_id"), F.when(F.col("lang") == "es", ".txt").otherwise(".pdf")).alias("path"), F.length("text").alias("length"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 7 + 1).alias("page_count"), "lang")


FILES_SQL = "files_ AS (SELECT 'in/' || lpad(doc_id::VARCHAR, 12, '0') || CASE WHEN lang = 'es' THEN '.txt' ELSE '.pdf' END AS path, length(text) AS length, sha256(text) AS sha256, doc_id % 7 + 1 AS page_count, lang FROM documents)"


@query(f"WITH {FILES_SQL} SELECT path, CASE WHEN lang = 'es' THEN 'not a PDF file' WHEN length > 5000 THEN 'file is larger than the limit' WHEN page_count > 6 THEN 'more pages than the limit' END AS error FROM files_")
def import_guard_limits(spark, sf_dir):
    return D.guard(_files(spark, sf_dir), 5000, 6).select("path", "error")


@query(f"WITH {FILES_SQL} SELECT sha256, min(path) AS path FROM files_ GROUP BY sha256")
def dedup_by_hash(spark, sf_dir):
    return D.first_of_hash(_files(spark, sf_dir)).select("sha256", "path")


@query(f"WITH {FILES_SQL} SELECT path, sha256 FROM files_ f WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = 'en' AND sha256(d.text) = f.sha256)")
def cache_probe_anti(spark, sf_dir):
    known = library_documents(spark, sf_dir).withColumn("status", F.when(F.col("language") == "en", "complete").otherwise("pending"))
    return D.not_cached(_files(spark, sf_dir), known).select("path", "sha256")


@query("""WITH p AS (SELECT conv_id::VARCHAR AS document_id, turn + 1 AS page_number, length(text) AS c, role = 'user' AS img FROM conversations),
g AS (SELECT document_id, count(*) FILTER (c < 60 AND img) AS s, count(*) AS n, coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (c < 60 AND img), '') AS scanned, coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (c > 0 AND c < 400 AND img), '') AS layer FROM p GROUP BY document_id)
SELECT document_id, CASE WHEN s::DOUBLE / n >= 0.8 THEN 'scanned' WHEN s > 0 THEN 'mixed' ELSE 'digital_text' END AS kind, scanned, layer FROM g""")
def scan_kind(spark, sf_dir):
    p = conversation_pages(spark, sf_dir).select("document_id", "page_number", F.col("char_count").alias("native_chars"), F.col("source_scanned").alias("has_images"))
    return D.scan_kind(p).select("document_id", "kind", F.array_join("scanned_pages", ",").alias("scanned"), F.array_join("ocr_layer_pages", ",").alias("layer"))


FONTS = [("CMEX10", True), ("ABCDEF+STIXMath-Regular", True), ("LatinModernMath", True), ("CMMI10", False), ("Times", False), ("Foo-Math", True)]


@query(_literal(FONTS, ["font", "math"]))
def math_fonts(spark, sf_dir):
    return _values(spark, [(f,) for f, _ in FONTS], "font string").select("font", D.has_math_font(F.array("font")).alias("math"))


# ---------------------------------------------------------------------------------------------- look-ups


REFS = ["5", "src1-", "en 3", "no such", "src9-9.pdf", "fr"]


@query(f"""WITH {DOCUMENTS_SQL}, r AS (SELECT unnest({REFS!r}) AS ref),
f AS (SELECT ref, 0 AS k, id FROM r JOIN docs_ ON ref = id UNION ALL SELECT ref, 1, id FROM r JOIN docs_ ON starts_with(lower(id), lower(ref)) UNION ALL SELECT ref, 2, id FROM r JOIN docs_ ON ref = sha256
  UNION ALL SELECT ref, 3, id FROM r JOIN docs_ ON ref = filename OR ref = title UNION ALL SELECT ref, 4, id FROM r JOIN docs_ ON contains(lower(filename), lower(ref))),
b AS (SELECT ref, min(k) AS k FROM f GROUP BY ref), n AS (SELECT f.ref, count(DISTINCT id) AS n, min(id) AS id FROM f JOIN b ON f.ref = b.ref AND f.k = b.k GROUP BY f.ref)
SELECT r.ref, CASE WHEN n = 1 THEN id END AS document_id, CASE WHEN n IS NULL THEN 'no document matches' WHEN n > 1 THEN 'ambiguous' END AS error FROM r LEFT JOIN n ON r.ref = n.ref""")
def resolve_reference(spark, sf_dir):
    return D.resolve(library_documents(spark, sf_dir), _values(spark, [(r,) for r in REFS], "ref string"))


REQUESTED_SQL = "req AS (SELECT conv_id::VARCHAR AS document_id, p::BIGINT AS page_number FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([1, 3, 7]) AS p))"


def _requests(spark, sf_dir):
    ids = conversation_pages(spark, sf_dir).select("document_id").distinct()
    return ids.select("document_id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(7), F.lit(3))).alias("page_number"))


@query(f"WITH {PAGES_SQL}, {REQUESTED_SQL} SELECT r.document_id, r.page_number, p.markdown IS NOT NULL AS found, p.markdown, p.ocr_used FROM req r LEFT JOIN pages_ p ON r.document_id = p.document_id AND r.page_number = p.page_number")
def get_pages_left(spark, sf_dir):
    pages = conversation_pages(spark, sf_dir).withColumn("quality_state", F.lit("good")).withColumn("verification_state", F.lit("pending"))
    return longs(D.get_pages(pages, _requests(spark, sf_dir)).select("document_id", "page_number", "found", "markdown", "ocr_used"))


@query(f"WITH {PAGES_SQL}, {REQUESTED_SQL} SELECT document_id, page_number FROM req EXCEPT SELECT document_id, page_number FROM pages_")
def missing_pages_anti(spark, sf_dir):
    return longs(D.missing_pages(conversation_pages(spark, sf_dir), _requests(spark, sf_dir)))


@query(f"""WITH {PAGES_SQL}, b AS (SELECT document_id, page_number, page_number % 3 AS ordinal, 'Text' AS block_type, char_count FROM pages_)
SELECT p.document_id, p.page_number, CASE WHEN p.ocr_used THEN b.ordinal || ':' || b.block_type || ':' || b.char_count END AS blocks FROM pages_ p JOIN b USING (document_id, page_number)""")
def pages_with_blocks_nested(spark, sf_dir):
    pages = conversation_pages(spark, sf_dir)
    blocks = pages.select("document_id", "page_number", (F.col("page_number") % 3).alias("ordinal"), F.lit("Text").alias("block_type"), "char_count")
    rows = D.get_pages(pages.withColumn("quality_state", F.lit("good")).withColumn("verification_state", F.lit("pending")), pages.select("document_id", "page_number"), blocks)
    told = F.when(F.col("blocks").isNotNull(), F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["ordinal"].cast("string"), b["block_type"], b["char_count"].cast("string"))), ","))
    return longs(rows.select("document_id", "page_number", told.alias("blocks")))


@query(f"WITH {DOCUMENTS_SQL} SELECT id AS document_id, 'p' || (created_at % 4) AS asked, CASE WHEN created_at % 4 <> 1 THEN 'invalid page' END AS error FROM docs_")
def valid_pages(spark, sf_dir):
    docs = library_documents(spark, sf_dir)
    requests = docs.select(F.col("id").alias("document_id"), F.array((F.col("created_at") % 4).cast("int")).alias("pages"))
    rows = D.valid_pages(requests, docs)
    return rows.select("document_id", F.concat(F.lit("p"), F.array_join("pages", ",")).alias("asked"), "error")


@query("""SELECT p_partkey::VARCHAR AS document_id, round(CASE WHEN small THEN 0.0 ELSE x0 END, 6)::DOUBLE AS x0, round(CASE WHEN small THEN 600.0 ELSE x1 END, 6)::DOUBLE AS x1 FROM (SELECT *, x1 - x0 < 4 AS small FROM (SELECT p_partkey, greatest(0.0, p_size * 13.0 - 8) AS x0, least(600.0, p_size * 13.0 + 50.0 + 8) AS x1 FROM part))""")
def render_regions(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("block"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(900).alias("max_tokens"), "p_size")
    x = F.col("p_size") * 13.0
    blocks = part.select("document_id", "page_number", F.col("block").alias("ordinal"), F.struct(x.alias("x0"), F.lit(10.0).alias("y0"), (x + 50.0).alias("x1"), F.lit(90.0).alias("y1")).alias("bbox"))
    rows = D.region(part.drop("p_size"), blocks)
    return rows.select("document_id", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


# ---------------------------------------------------------------------------------------------- updates


def _states(spark, sf_dir):
    """Stored pages with a verification state of every kind."""
    p = conversation_pages(spark, sf_dir)
    state = F.when(F.col("role") == "user", F.element_at(F.array(F.lit("approved"), F.lit("needs_correction"), F.lit("unreadable"), F.lit("pending")), (F.col("char_count") % 4 + 1).cast("int"))).otherwise("not_needed")
    return p.select(
        "document_id", "page_number", "markdown", F.sha2("markdown", 256).alias("page_hash"), "source_scanned", "ocr_used", state.alias("verification_state"),
        F.concat(F.lit("note "), F.col("char_count").cast("string")).alias("verification_note"), F.lit(5).cast("long").alias("verified_at"),
        (F.lit(0.5) + F.col("char_count") % 50 / 100.0).alias("quality_score"), F.when(F.col("char_count") % 50 >= 25, "good").otherwise("warning").alias("quality_state"), F.array(F.lit("issue")).alias("quality_issues"),
        (F.col("char_count") % 3).alias("math_count"), F.lit(0).alias("table_count"), "char_count", F.when(F.col("role") == "assistant", "fast").otherwise("high").alias("quality_tier"), (F.col("char_count") < 60).alias("needs_ocr"),
    )


STATES_SQL = PAGES_SQL + """, states_ AS (SELECT document_id, page_number, markdown, sha256(markdown) AS page_hash, source_scanned, ocr_used,
  CASE WHEN role = 'user' THEN ['approved', 'needs_correction', 'unreadable', 'pending'][char_count % 4 + 1] ELSE 'not_needed' END AS verification_state, 'note ' || char_count AS verification_note, 5 AS verified_at,
  0.5::DOUBLE + char_count % 50 / 100.0::DOUBLE AS quality_score, CASE WHEN char_count % 50 >= 25 THEN 'good' ELSE 'warning' END AS quality_state, char_count % 3 AS math_count, char_count,
  CASE WHEN role = 'assistant' THEN 'fast' ELSE 'high' END AS quality_tier, char_count < 60 AS needs_ocr FROM pages_)"""


@query(f"""WITH {STATES_SQL}, new AS (SELECT *, sha256(m) AS h FROM (SELECT document_id, page_number + 1 AS page_number, CASE WHEN page_number % 2 = 0 THEN markdown || '!' ELSE (SELECT markdown FROM states_ s WHERE s.document_id = p.document_id AND s.page_number = p.page_number + 1) END AS m, page_number % 3 = 0 AS scan FROM states_ p))
SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.page_number, b.page_number) AS page_number,
  CASE WHEN b.page_number IS NULL THEN a.verification_state WHEN a.page_number IS NULL THEN CASE WHEN scan THEN 'pending' ELSE 'not_needed' END
    WHEN a.page_hash IS DISTINCT FROM h AND scan THEN 'pending' WHEN NOT scan THEN 'not_needed' ELSE a.verification_state END AS verification_state,
  CASE WHEN a.page_number IS NOT NULL AND b.page_number IS NOT NULL AND a.page_hash IS DISTINCT FROM h THEN NULL ELSE a.verification_note END AS verification_note,
  CASE WHEN b.page_number IS NOT NULL AND a.page_hash <> h THEN NULL ELSE a.verified_at END::BIGINT AS verified_at
FROM states_ a FULL JOIN new b ON a.document_id = b.document_id AND a.page_number = b.page_number""")
def verification_upsert(spark, sf_dir):
    old = _states(spark, sf_dir)
    ahead = old.select("document_id", (F.col("page_number") - 1).alias("page_number"), F.col("markdown").alias("same"))
    new = old.join(ahead, ["document_id", "page_number"], "left")
    text = F.when(F.col("page_number") % 2 == 0, F.concat("markdown", F.lit("!"))).otherwise(F.col("same"))
    new = new.select("document_id", (F.col("page_number") + 1).alias("page_number"), F.sha2(text, 256).alias("page_hash"), (F.col("page_number") % 3 == 0).alias("source_scanned"), F.lit(False).alias("ocr_used"))
    return longs(D.upsert_pages(old, new).select("document_id", "page_number", "verification_state", "verification_note", "verified_at"))


@query(f"""WITH {DOCUMENTS_SQL} SELECT coalesce(a.id, b.id) AS id, coalesce(a.filename, b.filename) AS filename, coalesce(b.status, a.status) AS status, coalesce(b.page_count, a.page_count)::BIGINT AS page_count
FROM (SELECT * FROM docs_ WHERE language <> 'de') a FULL JOIN (SELECT id, 'new ' || filename AS filename, 'processing' AS status, 9 AS page_count FROM docs_ WHERE language <> 'es') b ON a.id = b.id""")
def merge_full_outer(spark, sf_dir):
    docs = library_documents(spark, sf_dir)
    new = docs.where("language <> 'es'").withColumn("filename", F.concat(F.lit("new "), F.col("filename"))).withColumn("status", F.lit("processing")).withColumn("page_count", F.lit(9))
    return longs(D.upsert_documents(docs.where("language <> 'de'"), new).select("id", "filename", "status", "page_count"))


@query(f"WITH {PAGES_SQL} SELECT document_id, page_number, CASE WHEN document_id::BIGINT % 2 = 0 THEN 'new' ELSE role END AS role FROM pages_ WHERE document_id::BIGINT % 2 = 1 OR page_number <= 2")
def replace_document_rows(spark, sf_dir):
    p = conversation_pages(spark, sf_dir).select("document_id", "page_number", "role")
    new = p.where((F.col("document_id").cast("long") % 2 == 0) & (F.col("page_number") <= 2)).withColumn("role", F.lit("new"))
    return longs(D.replace_rows(p, new, ["document_id"]))


@query(f"WITH {PAGES_SQL} SELECT document_id, page_number FROM pages_ WHERE document_id NOT IN (SELECT document_id FROM pages_ WHERE role = 'system')")
def delete_cascade(spark, sf_dir):
    p = conversation_pages(spark, sf_dir)
    return longs(D.delete_documents({"pages": p}, p.where("role = 'system'"))["pages"].select("document_id", "page_number"))


@query(f"""WITH {PAGES_SQL} SELECT document_id, page_number, CASE WHEN document_id IN (SELECT document_id FROM pages_ WHERE role = 'system') THEN true ELSE source_scanned END AS source_scanned FROM pages_""")
def scanned_semi(spark, sf_dir):
    p = conversation_pages(spark, sf_dir)
    docs = p.groupBy(F.col("document_id").alias("id")).agg(F.when(F.max(F.col("role") == "system"), "scanned").otherwise("mixed").alias("kind"))
    return longs(D.backfill_scanned(p, docs).select("document_id", "page_number", "source_scanned"))


@query(f"""WITH {STATES_SQL}, r AS (SELECT *, ['approved', 'needs_correction', 'unreadable', 'nonsense'][char_count % 4 + 1] AS verdict, CASE WHEN char_count % 3 = 0 THEN NULL ELSE 'because' END AS note FROM states_)
SELECT document_id, page_number, CASE WHEN verdict = 'approved' OR verdict <> 'nonsense' AND note IS NOT NULL THEN verdict ELSE verification_state END AS verification_state, CASE WHEN verdict = 'approved' OR verdict <> 'nonsense' AND note IS NOT NULL THEN note ELSE verification_note END AS verification_note FROM r""")
def record_reviews(spark, sf_dir):
    p = _states(spark, sf_dir)
    verdict = F.element_at(F.array(F.lit("approved"), F.lit("needs_correction"), F.lit("unreadable"), F.lit("nonsense")), (F.col("char_count") % 4 + 1).cast("int"))
    reviews = p.select("document_id", "page_number", verdict.alias("verdict"), F.when(F.col("char_count") % 3 != 0, "because").alias("note"), F.lit(9).cast("long").alias("at"))
    return longs(D.record_reviews(p, reviews)[0].select("document_id", "page_number", "verification_state", "verification_note"))


CORRECTIONS = [
    ("fine", "Text $x$ $y$", "Text $x$ $y$!", 0.9, False, ""),
    ("empty", "Text", "  ", 0.0, False, "empty_model_output,missing_or_invalid_confidence"),
    ("latin", "κείμενο $f(x)=x$", "h autigropu tus $f(x)=x$", 0.99, True, "greek_prose_ratio_too_low,latin_transliteration_detected"),
    ("lost", r"\frac a \sqrt b $x$ $y$", r"\frac{1}{x", 0.9, False, "formula_inventory_dropped:6->1,unbalanced_latex_braces"),
    ("odd", "Text", "Text $x [unreadable]", 0.9, False, "contains_unreadable_placeholder,unbalanced_math_delimiters"),
    ("short", "a" * 100, "a", 0.9, False, "candidate_too_short"),
]


@query(_literal([(c[0], c[5], c[5] == "") for c in CORRECTIONS], ["name", "warnings", "applied"]))
def correction_validation(spark, sf_dir):
    rows = _values(spark, [c[:5] for c in CORRECTIONS], "name string, original string, candidate string, confidence double, greek boolean")
    w = Q.correction_warnings(F.col("original"), F.col("candidate"), F.col("confidence"), F.lit(None).cast("array<string>"), F.col("greek"))
    rows = rows.select("name", w.alias("w"), "confidence")
    return rows.select("name", F.array_join("w", ",").alias("warnings"), Q.accepted(F.col("w"), F.col("confidence")).alias("applied"))


def _proposals(spark, sf_dir):
    p = _states(spark, sf_dir).withColumn("greek_document", F.lit(False))
    made = p.where("source_scanned").select("document_id", "page_number", F.concat("markdown", F.lit(" (read again)")).alias("markdown"), F.when(F.col("char_count") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"), F.when(F.col("char_count") % 5 == 0, F.array(F.lit("model doubts"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.lit("m").alias("model"), F.lit(7).cast("long").alias("at"))
    return p, D.judge_corrections(p, made)


@query(f"""WITH {STATES_SQL} SELECT document_id, page_number, CASE WHEN NOT source_scanned THEN markdown WHEN applied THEN markdown || ' (read again)' ELSE markdown END AS markdown,
  CASE WHEN NOT source_scanned THEN verification_state WHEN applied THEN 'approved' WHEN doubt OR cheap THEN 'needs_correction' ELSE verification_state END AS verification_state
FROM (SELECT *, char_count % 5 = 0 AS doubt, false AS cheap, char_count % 5 <> 0 AND char_count % 2 = 0 AS applied FROM states_)""")
def apply_corrections(spark, sf_dir):
    pages, audit = _proposals(spark, sf_dir)
    return longs(D.apply_corrections(pages, audit).select("document_id", "page_number", "markdown", "verification_state"))


@query(f"""WITH {STATES_SQL} SELECT document_id, page_number, CASE WHEN char_count % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN char_count % 5 = 0 THEN 'model doubts' ELSE '' END AS warnings, char_count % 5 <> 0 AND char_count % 2 = 0 AS applied FROM states_ WHERE source_scanned""")
def correction_history(spark, sf_dir):
    audit = _proposals(spark, sf_dir)[1]
    return longs(audit.select("document_id", "page_number", "confidence", F.array_join("warnings", ",").alias("warnings"), "applied"))


REPLIES = [('{"markdown": "new text", "confidence": 1.7, "warnings": ["x"]}', "new text", 1.0, "x"), ("Sure:\n{\"markdown\": \"t\"}", "t", 0.0, ""), ("```markdown\nraw\n```", "raw", 0.0, "non-JSON model response")]


@query(_literal(REPLIES, ["reply", "markdown", "confidence", "warnings"]).replace("\n", "' || chr(10) || '"))
def model_replies(spark, sf_dir):
    rows = _values(spark, [(r[0],) for r in REPLIES], "reply string").withColumn("p", proposal(F.col("reply")))
    return rows.select("reply", "p.markdown", "p.confidence", F.array_join("p.warnings", ",").alias("warnings"))


# ---------------------------------------------------------------------------------------------- reports


@query(f"WITH {STATES_SQL} SELECT document_id, page_number FROM states_ WHERE quality_tier = 'fast' AND (quality_score < 0.75 OR math_count > 0 OR needs_ocr)")
def upgrade_candidates(spark, sf_dir):
    return longs(D.upgrade_candidates(_states(spark, sf_dir)))


@query(f"WITH {STATES_SQL} SELECT document_id, CASE WHEN count(*) FILTER (quality_tier = 'fast') = 0 THEN 'high' ELSE 'mixed' END AS quality_tier FROM states_ GROUP BY document_id")
def document_tier(spark, sf_dir):
    return D.document_tier(_states(spark, sf_dir))


@query(f"""WITH {STATES_SQL} SELECT document_id, page_number, verification_state, row_number() OVER (PARTITION BY document_id ORDER BY CASE verification_state WHEN 'needs_correction' THEN 0 WHEN 'unreadable' THEN 1 ELSE 2 END, quality_score NULLS FIRST, math_count DESC, page_number) AS position,
  concat_ws('; ', CASE WHEN source_scanned THEN 'source is a scan' END, CASE WHEN ocr_used THEN 'OCR used' END, 'issue', CASE WHEN math_count > 0 THEN math_count || ' equation(s)' END) AS reasons
FROM states_ WHERE (source_scanned OR ocr_used) AND verification_state IN ('pending', 'needs_correction', 'unreadable')""")
def review_queue(spark, sf_dir):
    q = D.review_queue(_states(spark, sf_dir), 100)
    return longs(q.select("document_id", "page_number", "verification_state", "position", F.array_join("reasons", "; ").alias("reasons")))


@query(f"""WITH {STATES_SQL} SELECT document_id, count(*) AS pages_stored, sum(math_count)::BIGINT AS equations, sum(char_count)::BIGINT AS chars, round(avg(quality_score), 3) AS mean_quality, count(*) FILTER (quality_tier = 'high') AS high_quality_pages,
  coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (source_scanned), '') AS source_scanned, coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (verification_state IN ('pending', 'needs_correction', 'unreadable')), '') AS unverified,
  coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (quality_tier = 'fast' AND (quality_score < 0.75 OR math_count > 0 OR needs_ocr)), '') AS candidates, 0::BIGINT AS corrections FROM states_ GROUP BY document_id""")
def document_status(spark, sf_dir):
    p = _states(spark, sf_dir)
    docs = p.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("page_count")).select("id", F.lit("").alias("title"), F.lit("f").alias("filename"), F.lit("complete").alias("status"), F.lit("mixed").alias("kind"), "page_count")
    chunks, jobs = p.select("document_id"), _values(spark, [], "id string, document_id string, kind string, state string, created_at long")
    runs, fixes = _values(spark, [], "id long, document_id string, engine string, ok boolean"), _values(spark, [], "document_id string, applied boolean")
    s = D.status(docs, p, chunks, jobs, runs, fixes)
    lists = {"source_scanned": "source_scanned", "unverified_pages": "unverified", "upgrade_candidates": "candidates"}
    return longs(s.select("document_id", "pages_stored", "equations", "chars", "mean_quality", "high_quality_pages", "corrections", *(F.coalesce(F.array_join(a, ","), F.lit("")).alias(b) for a, b in lists.items())))


@query(f"WITH {STATES_SQL} SELECT document_id, page_number, quality_score, quality_state, math_count FROM states_ WHERE quality_state <> 'good'")
def page_report(spark, sf_dir):
    return longs(D.page_report(_states(spark, sf_dir), True).select("document_id", "page_number", "quality_score", "quality_state", "math_count"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS pages, (SELECT count(*) FROM conversations) AS chunks, (SELECT sum(length(text) % 3)::BIGINT FROM conversations) AS equations")
def library_stats(spark, sf_dir):
    p = _states(spark, sf_dir)
    return D.stats(library_documents(spark, sf_dir), p, p)


@query(f"WITH {STATES_SQL} SELECT id AS document_id, 1::BIGINT AS page_count, coalesce(e, 0) AS equations, 0::BIGINT AS tables, coalesce(c, 0) AS chunks FROM (SELECT doc_id::VARCHAR AS id FROM documents) LEFT JOIN (SELECT document_id, sum(math_count)::BIGINT AS e, count(*) AS c FROM states_ GROUP BY document_id) ON id = document_id")
def cache_hit_stats(spark, sf_dir):
    p = _states(spark, sf_dir)
    return longs(D.cache_hit(library_documents(spark, sf_dir), p, p))


@query(f"WITH {DOCUMENTS_SQL} SELECT id, CASE WHEN title = '' THEN filename ELSE title END AS title, created_at FROM docs_")
def list_documents(spark, sf_dir):
    return D.list_documents(library_documents(spark, sf_dir)).select("id", "title", "created_at")


@query("""WITH f AS (SELECT user_id::VARCHAR AS document_id, event_type AS engine, min(event_id) AS first FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT document_id, string_agg(engine, ',' ORDER BY first) AS engines FROM f GROUP BY document_id""")
def engines_used(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("engine"), (F.col("event_type") != "error").alias("ok"))
    return D.engines_used(runs).select("document_id", F.array_join("engines", ",").alias("engines"))


@query("SELECT user_id::VARCHAR AS document_id, arg_max(event_id, (ts, event_id)) AS job_id, arg_max(event_type, (ts, event_id)) AS job_state FROM events GROUP BY user_id")
def latest_job(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("document_id"), F.lit("import").alias("kind"), F.col("event_type").alias("state"), F.col("ts").alias("created_at"))
    return D.latest_jobs(jobs).select("document_id", "job_id", "job_state")


def _job_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.element_at(F.create_map(*(F.lit(x) for x in ("view", "queued", "click", "running", "purchase", "complete", "error", "failed", "signup", "running"))), F.col("event_type"))
    return e.select(F.col("user_id").alias("id"), F.when(F.col("value") > 10, F.col("user_id").cast("string")).alias("document_id"), F.lit("import").alias("kind"), state.alias("state"), F.col("value").alias("progress"), F.col("props").alias("detail"), F.lit(None).cast("string").alias("error"), F.col("event_id").alias("at"))


JOB_EVENTS_SQL = """ev AS (SELECT user_id AS id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, round(value, 3) AS progress, event_id AS tick FROM events)"""


@query(f"""WITH {JOB_EVENTS_SQL} SELECT id, arg_max(state, tick) AS state, arg_max(progress, tick) AS progress, min(tick) AS created_at, min(tick) FILTER (state = 'running') AS started_at, min(tick) FILTER (state IN ('complete', 'failed')) AS finished_at FROM ev GROUP BY id""")
def job_state_latest(spark, sf_dir):
    return J.current(_job_events(spark, sf_dir)).select("id", "state", "progress", "created_at", "started_at", "finished_at")


@query(f"""WITH {JOB_EVENTS_SQL} SELECT id, CASE WHEN s IN ('queued', 'running') THEN 'failed' ELSE s END AS state, CASE WHEN s IN ('queued', 'running') THEN 'interrupted: the server restarted' END AS error FROM (SELECT id, arg_max(state, tick) AS s FROM ev GROUP BY id)""")
def jobs_interrupted(spark, sf_dir):
    return J.interrupt(J.current(_job_events(spark, sf_dir))).select("id", "state", "error")


@query(f"WITH {JOB_EVENTS_SQL} SELECT count(*) FILTER (s IN ('queued', 'running')) AS active FROM (SELECT id, arg_max(state, tick) AS s FROM ev GROUP BY id)")
def jobs_active(spark, sf_dir):
    return J.active(J.current(_job_events(spark, sf_dir)))


@query("SELECT date_trunc('hour', ts) AS window_start, user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1, 2")
def job_windows(spark, sf_dir):
    return landing.job_states(table(spark, sf_dir, "events"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def stream_dedup(spark, sf_dir):
    """The documents as a stream, each content once; run to its end and returned as a table."""
    from pagewright.workspace import Workspace

    ws = Workspace(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    stream = landing.landing(spark, f"{sf_dir}/documents.parquet*", schema)
    out = ws.path("out")
    landing.process(landing.distinct_content(stream).select("sha256"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), ws.path("checkpoint"), once=True).awaitTermination()
    return spark.read.schema("sha256 string, batch int").parquet(out).select("sha256")


# ---------------------------------------------------------------------------------------------- documents as text


@query(r"""SELECT conv_id::VARCHAR AS document_id, string_agg('<!-- page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY conv_id""")
def document_md(spark, sf_dir):
    return D.document_markdown(conversation_pages(spark, sf_dir))


@query(f"""WITH {DOCUMENTS_SQL} SELECT id AS document_id, '{{"created_at":' || created_at || ',"filename":"' || filename || '","kind":"' || kind || '","language":"' || language || '"}}' AS metadata FROM docs_""")
def metadata_json(spark, sf_dir):
    docs = library_documents(spark, sf_dir)
    return D.metadata_json(docs).select("document_id", F.to_json(F.from_json("metadata", "created_at long, filename string, kind string, language string")).alias("metadata"))


@query(r"""SELECT conv_id::VARCHAR AS document_id, turn + 1 AS page_number, list_aggregate(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> ''),
  lambda b: '<p>' || replace(replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') || '</p>'), 'string_agg', chr(10)) AS html FROM conversations""")
def proofread_html(spark, sf_dir):
    return longs(D.proofread_html(conversation_pages(spark, sf_dir)))


@query(f"""WITH {PAGES_SQL} SELECT role AS engine, count(*) AS pages, sum(char_count)::BIGINT AS seconds, round(count(*)::DOUBLE / sum(char_count), 2) AS pages_per_second FROM pages_ GROUP BY role""")
def engine_benchmark(spark, sf_dir):
    p = conversation_pages(spark, sf_dir).withColumnRenamed("role", "engine")
    b = D.benchmark_engines(p.select("engine", F.col("char_count").alias("duration_s")), p)
    return longs(b.select("engine", "pages", "seconds", "pages_per_second"))
