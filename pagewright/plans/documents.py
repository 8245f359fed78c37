"""What a library of documents keeps and reports, as plans over its tables.

Every call of a single-document library is a set-oriented plan here: one aggregation for all documents, joins on keys for
updates. Tables are immutable; an update returns the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import quality as Q
from pagewright.functions import text as T

UPGRADE_BELOW = 0.75
LANGUAGE_PAGES, LANGUAGE_CHARS = 20, 40_000
VERDICTS = ("approved", "needs_correction", "unreadable")
NO_TEXT_CHARS, OCR_LAYER_CHARS, SCANNED_SHARE = 60, 400, 0.8
#: Fonts with large operators and delimiters.
MATH_FONTS = r"(?i)CMEX|MSAM|MSBM|RSFS|EUFM|EUSM|STIXMath|LatinModernMath|XITSMath|CambriaMath|AsanaMath|TeXGyre\w*Math|[-+]Math"


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _pages_where(test: Column, page: str = "page_number") -> Column:
    """Ascending page numbers for which the test holds."""
    return F.sort_array(F.collect_list(F.when(test, F.col(page))))


# ---------------------------------------------------------------------------------------------- before import


def hashed(files: DataFrame) -> DataFrame:
    """``files(path, length, content)`` with sha256 and document_id."""
    sha = F.sha2("content", 256)
    return files.select("path", "length", sha.alias("sha256"), T.document_uuid(sha).alias("document_id"))


def guard(files: DataFrame, max_bytes: int = 0, max_pages: int = 0, pdf_only: bool = True) -> DataFrame:
    """``files(path, length[, page_count])`` with ``error``: why a file isn't taken, null if it is. Zero is no limit;
    an engine that takes other files than PDF still has limits."""
    error = F.when(F.lit(pdf_only) & ~F.lower("path").endswith(".pdf"), "not a PDF file")
    if max_bytes:
        error = error.when(F.col("length") > max_bytes, "file is larger than the limit")
    if max_pages and "page_count" in files.columns:
        error = error.when(F.col("page_count") > max_pages, "more pages than the limit")
    return files.withColumn("error", error)


def first_of_hash(files: DataFrame) -> DataFrame:
    """One row for each content: of equal files the one with the smallest path."""
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    return files.withColumn("__n", first).where("__n = 1").drop("__n")


def not_cached(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose content isn't there yet, complete."""
    return files.join(documents.where("status = 'complete'").select("sha256"), "sha256", "left_anti")


def scan_kind(pages: DataFrame) -> DataFrame:
    """(document_id, kind, scanned_pages, ocr_layer_pages) of ``pages(document_id, page_number, native_chars, has_images)``."""
    scanned = (F.col("native_chars") < NO_TEXT_CHARS) & F.col("has_images")
    layer = (F.col("native_chars") > 0) & (F.col("native_chars") < OCR_LAYER_CHARS) & F.col("has_images")
    found = pages.groupBy("document_id").agg(F.count_if(scanned).alias("s"), F.count("*").alias("n"), _pages_where(scanned).alias("scanned_pages"), _pages_where(layer).alias("ocr_layer_pages"))
    kind = F.when(F.col("s") / F.col("n") >= SCANNED_SHARE, "scanned").when(F.col("s") > 0, "mixed").otherwise("digital_text")
    return found.select("document_id", kind.alias("kind"), "scanned_pages", "ocr_layer_pages")


def has_math_font(fonts: Column) -> Column:
    return F.exists(fonts, lambda f: f.rlike(MATH_FONTS))


# ---------------------------------------------------------------------------------------------- page scores


def document_flags(pages: DataFrame) -> DataFrame:
    """(document_id, greek_document, greek_functions): what page repairs need to know of the whole document.

    The language is judged by the first pages' text; functions are Greek if the document is and any page writes one.
    """
    from pagewright.operators.repair import looks_greek_mathematical

    first = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    rows = pages.select("document_id", "page_number", F.coalesce("markdown", F.lit("")).alias("t")).withColumn("k", first)
    listed = F.sort_array(F.collect_list(F.when(F.col("k") <= LANGUAGE_PAGES, F.struct("k", F.substring("t", 1, LANGUAGE_CHARS).alias("t")))))
    start = F.substring(F.array_join(F.transform(listed, lambda x: x["t"]), ""), 1, LANGUAGE_CHARS)
    found = rows.groupBy("document_id").agg(start.alias("start"), F.max(looks_greek_mathematical(F.col("t"))).alias("f"))
    greek = Q.greek_share(Q.drop(F.col("start"), Q.FLOWING_MATH, " ")) > Q.GREEK_SHARE
    return found.select("document_id", greek.alias("greek_document"), (greek & F.col("f")).alias("greek_functions"))


def score_pages(pages: DataFrame) -> DataFrame:
    """``pages(document_id, page_number, markdown, is_scanned, ocr_used, math_fonts)`` with scores and flags.

    Adds page_hash, quality_score, quality_state, quality_issues, math_count, table_count, char_count, needs_ocr,
    mathematical.
    """
    quality = Q.missing_display_math(F.col("__q"), F.col("math_fonts"))
    rows = pages.withColumn("__q", Q.assess(F.col("markdown"))).withColumn("__q", quality)
    mathematical = Q.looks_mathematical(F.coalesce("markdown", F.lit(""))) | F.array_contains("__q.issues", "display_math_missing")
    return rows.select(
        *pages.columns,
        F.sha2("markdown", 256).alias("page_hash"),
        F.col("__q.score").alias("quality_score"),
        F.col("__q.state").alias("quality_state"),
        F.col("__q.issues").alias("quality_issues"),
        F.col("__q.math_count").alias("math_count"),
        F.col("__q.table_count").alias("table_count"),
        F.col("__q.char_count").alias("char_count"),
        Q.needs_ocr(F.col("is_scanned"), F.col("__q.has_text"), F.col("ocr_used")).alias("needs_ocr"),
        mathematical.alias("mathematical"),
    )


def rollup(scored: DataFrame) -> DataFrame:
    """(document_id, page_count, equations, tables, math_pages, low_quality_pages, repairs) of an import."""
    base = scored.groupBy("document_id").agg(
        F.count("*").alias("page_count"), F.sum("math_count").alias("equations"), F.sum("table_count").alias("tables"),
        _pages_where(F.col("mathematical")).alias("math_pages"), _pages_where(F.col("quality_state") != "good").alias("low_quality_pages"),
    )
    if "repairs" not in scored.columns:
        return base
    kinds = scored.select("document_id", F.explode("repairs").alias("k", "v")).groupBy("document_id", "k").agg(F.sum("v").cast("int").alias("v"))
    kinds = kinds.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("repairs"))
    return base.join(kinds, "document_id", "left")


# ---------------------------------------------------------------------------------------------- updates


def merge(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, the new row, but the ``kept`` columns of the old."""
    a, b = old.alias("a"), new.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    there, came = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()
    pick = lambda c: F.when(came & (~there if c in kept else F.lit(True)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return a.join(b, on, "full_outer").select(*(pick(c).alias(c) for c in old.columns))


def upsert_documents(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Known documents take status, kind, page_count and error of the new rows; names and times stay as first told."""
    return merge(documents, new, ["id"], [c for c in documents.columns if c not in ("id", "status", "kind", "page_count", "error")])


def upsert_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Pages take the new rows; what was verified stays verified only as long as the text does.

    A changed text that comes from a scan or OCR is pending; a text from neither needs no verification; else the state
    stays. The note goes when the hash changes (null counts as a value), the time when two known hashes differ.
    """
    a, b = pages.alias("a"), new.alias("b")
    key = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page_number") == F.col("b.page_number"))
    came, there = F.col("b.page_number").isNotNull(), F.col("a.page_number").isNotNull()
    changed = ~F.col("a.page_hash").eqNullSafe(F.col("b.page_hash"))
    risky = F.col("b.source_scanned") | F.col("b.ocr_used")
    special = {
        "verification_state": F.when(~came, F.col("a.verification_state")).when(~there, F.when(risky, "pending").otherwise("not_needed")).when(changed & risky, "pending").when(~risky, "not_needed").otherwise(F.col("a.verification_state")),
        "verification_note": F.when(came & there & changed, F.lit(None)).otherwise(F.col("a.verification_note")),
        "verified_at": F.when(came & (F.col("a.page_hash") != F.col("b.page_hash")), F.lit(None)).otherwise(F.col("a.verified_at")),
    }
    pick = lambda c: special.get(c, F.when(came, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}"))
    return a.join(b, key, "full_outer").select(*(pick(c).alias(c) for c in pages.columns))


def replace_rows(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with all rows of the new rows' keys replaced: chunks of a document, blocks of a page."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``ids(document_id)``; ``documents`` goes by id."""
    gone = ids.select("document_id").distinct()
    key = lambda name, df: df.join(gone, df["id" if name == "documents" else "document_id"] == gone["document_id"], "left_anti")
    return {name: key(name, df) for name, df in tables.items()}


def record_reviews(pages: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with the verdicts, rejected reviews with ``error``) for ``reviews(document_id, page_number, verdict, note, at)``.

    A verdict that isn't known, one other than approval without a note, and one on a page that isn't there are rejected.
    Of several on a page the latest holds. Texts don't change.
    """
    known = reviews.join(pages.select("document_id", "page_number", F.lit(True).alias("__there")), ["document_id", "page_number"], "left")
    error = (
        F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict")
        .when((F.col("verdict") != "approved") & (F.coalesce(T.trim(F.col("note")), F.lit("")) == ""), "a note is needed")
        .when(F.col("__there").isNull(), "no such page")
    )
    checked = known.withColumn("error", error).drop("__there")
    last = checked.where("error is null").groupBy("document_id", "page_number").agg(F.max_by(F.struct("verdict", "note", "at"), "at").alias("__r"))
    rows = pages.join(last, ["document_id", "page_number"], "left")
    new = {"verification_state": "verdict", "verification_note": "note", "verified_at": "at"}
    out = rows.select(*(F.when(F.col("__r").isNotNull(), F.col(f"__r.{new[c]}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in pages.columns))
    return out, checked.where("error is not null")


def judge_corrections(pages: DataFrame, proposals: DataFrame, apply: bool = True) -> DataFrame:
    """Audit rows of ``proposals(document_id, page_number, markdown, confidence, warnings, model, at)``.

    (document_id, page_number, original_markdown, proposed_markdown, model, confidence, warnings, applied, created_at).
    ``pages`` tells by ``greek_document`` whether Greek prose is expected.
    """
    rows = proposals.select("document_id", "page_number", F.col("markdown").alias("proposed_markdown"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"), F.col("warnings").alias("__w"), "model", F.col("at").alias("created_at"))
    rows = rows.join(pages.select("document_id", "page_number", F.col("markdown").alias("original_markdown"), "greek_document"), ["document_id", "page_number"])
    warnings = Q.correction_warnings(F.col("original_markdown"), F.col("proposed_markdown"), F.col("confidence"), F.col("__w"), F.col("greek_document"))
    rows = rows.withColumn("warnings", warnings)
    applied = Q.accepted(F.col("warnings"), F.col("confidence")) & F.lit(apply)
    return rows.withColumn("applied", applied).select("document_id", "page_number", "original_markdown", "proposed_markdown", "model", "confidence", "warnings", "applied", "created_at")


def apply_corrections(pages: DataFrame, audit: DataFrame) -> DataFrame:
    """Pages after the corrections: applied ones are text and approved, doubtful ones wait with their reasons as note."""
    last = audit.groupBy("document_id", "page_number").agg(F.max_by(F.struct("proposed_markdown", "warnings", "applied", "created_at"), "created_at").alias("__c"))
    rows = pages.join(last, ["document_id", "page_number"], "left")
    applied = F.coalesce(F.col("__c.applied"), F.lit(False))
    doubtful = F.coalesce(F.size("__c.warnings") > 0, F.lit(False)) & ~applied
    score = Q.assess(F.col("__c.proposed_markdown"))
    new = {
        "markdown": F.when(applied, F.col("__c.proposed_markdown")),
        "page_hash": F.when(applied, F.sha2("__c.proposed_markdown", 256)),
        "quality_score": F.when(applied, score["score"]),
        "quality_state": F.when(applied, score["state"]),
        "quality_issues": F.when(applied, score["issues"]),
        "math_count": F.when(applied, score["math_count"]),
        "char_count": F.when(applied, score["char_count"]),
        "verification_state": F.when(applied, "approved").when(doubtful, "needs_correction"),
        "verification_note": F.when(doubtful, F.array_join("__c.warnings", ", ")),
        "verified_at": F.when(applied, F.col("__c.created_at")),
    }
    return rows.select(*(F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in pages.columns))


def changed_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of pages whose text differs: what must be scored, chunked and indexed again."""
    a = before.select("document_id", "page_number", F.sha2("markdown", 256).alias("x"))
    b = after.select("document_id", "page_number", F.sha2("markdown", 256).alias("y"))
    return a.join(b, ["document_id", "page_number"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("document_id", "page_number")


def upgrade_pages(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """Pages with those of ``extracted`` taken over as high quality; others stay as they are."""
    return upsert_pages(pages, extracted.withColumn("quality_tier", F.lit("high")))


def document_tier(pages: DataFrame) -> DataFrame:
    """(document_id, quality_tier): high when no fast page is left."""
    fast = F.count_if(F.col("quality_tier") == "fast")
    return pages.groupBy("document_id").agg(F.when(fast == 0, "high").otherwise("mixed").alias("quality_tier"))


def backfill_scanned(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages of documents that are scans count as scanned."""
    scans = documents.where("kind = 'scanned'").select(F.col("id").alias("document_id"))
    of = pages.join(scans, "document_id", "left_semi").select("document_id").distinct().withColumn("__s", F.lit(True))
    return pages.join(of, "document_id", "left").withColumn("source_scanned", F.coalesce("__s", "source_scanned")).drop("__s")


# ---------------------------------------------------------------------------------------------- look-ups


def title(documents: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename"))


def resolve(documents: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, document_id, error) for each ``refs(ref)``: by id or its beginning, hash, name, part of the name.

    The first of these that fits decides; if it fits several documents, the reference is ambiguous.
    """
    ref, low = F.col("ref"), F.lower("ref")
    d = documents.select(F.col("id").alias("d_id"), F.col("sha256").alias("d_sha"), F.col("filename").alias("d_name"), F.col("title").alias("d_title"))
    asked = refs.select("ref").distinct()
    by = lambda on, rank: asked.join(d, on).select("ref", F.lit(rank).alias("rank"), "d_id")
    exact = by(ref == F.col("d_id"), 0).union(by(ref == F.col("d_sha"), 2))
    exact = exact.union(by(ref == F.col("d_name"), 3)).union(by(ref == F.col("d_title"), 3))
    # the references of one call are few; documents are scanned once for beginnings and parts
    part = by(F.startswith(F.lower("d_id"), low), 1).union(by(F.contains(F.lower("d_name"), low), 4))
    found = exact.union(part).distinct()
    best = found.groupBy("ref").agg(F.min("rank").alias("best"))
    ids = found.join(best, "ref").where("rank = best").groupBy("ref").agg(F.count_distinct("d_id").alias("n"), F.min("d_id").alias("d_id"))
    rows = refs.join(ids, "ref", "left")
    error = F.when(F.col("n").isNull(), "no document matches").when(F.col("n") > 1, "ambiguous")
    return rows.select("ref", F.when(F.col("n") == 1, F.col("d_id")).alias("document_id"), error.alias("error"))


def get_pages(pages: DataFrame, requests: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(document_id, page_number, found, markdown, ocr_used, quality_state, verification_state[, blocks]).

    A row for each distinct request; pages that aren't there are not found. Blocks come with pages read by OCR.
    """
    asked = requests.select("document_id", "page_number").distinct()
    rows = asked.join(pages.select("document_id", "page_number", "markdown", "ocr_used", "quality_state", "verification_state"), ["document_id", "page_number"], "left")
    rows = rows.withColumn("found", F.col("markdown").isNotNull()).withColumn("markdown", T.page_cut(F.col("markdown")))
    columns = ["document_id", "page_number", "found", "markdown", "ocr_used", "quality_state", "verification_state"]
    if blocks is None:
        return rows.select(columns)
    nested = blocks.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("ordinal", "block_type", "char_count"))).alias("__b"))
    rows = rows.join(nested, ["document_id", "page_number"], "left")
    return rows.select(*columns, F.when(F.col("ocr_used"), F.col("__b")).alias("blocks"))


def missing_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.select("document_id", "page_number").distinct().join(pages, ["document_id", "page_number"], "left_anti")


def valid_pages(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``requests(document_id, pages)`` with sorted distinct ``pages`` and ``error`` if any is outside of the document."""
    rows = requests.join(documents.select(F.col("id").alias("document_id"), "page_count"), "document_id", "left")
    bad = F.exists("pages", lambda p: p.isNull() | (p < 1) | (p > F.col("page_count")))
    error = F.when(F.col("page_count").isNull(), "no such document").when(bad, "invalid page")
    return rows.select("document_id", F.sort_array(F.array_distinct("pages")).alias("pages"), error.alias("error"))


def page_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in page order; a box without its first corner is none."""
    box = F.when(F.col("bbox.x0").isNotNull(), F.col("bbox"))
    return blocks.withColumn("bbox", box).orderBy("document_id", "page_number", "ordinal")


def get_chunks(chunks: DataFrame, documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ``ids(chunk_id)`` with their documents' names."""
    names = documents.select(F.col("id").alias("document_id"), title(documents).alias("document"))
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id").join(names, "document_id")


def upgrade_candidates(pages: DataFrame, below: float = UPGRADE_BELOW, math_pages: bool = True, most: int = 0) -> DataFrame:
    """(document_id, page_number) of fast pages that a better engine should read; ``most`` of each document, 0: all."""
    wanted = (F.col("quality_score") < below) | F.col("needs_ocr")
    wanted = wanted | (F.col("math_count") > 0) if math_pages else wanted
    rows = pages.where((F.col("quality_tier") == "fast") & wanted).select("document_id", "page_number")
    if not most:
        return rows
    k = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    return rows.withColumn("__k", k).where(F.col("__k") <= most).drop("__k")


def review_queue(pages: DataFrame, limit: int = 20) -> DataFrame:
    """Pages that wait for a reader, the most urgent first, with ``reasons``: of each document ``limit``, 1 to 100."""
    open_ = pages.where((F.col("source_scanned") | F.col("ocr_used")) & F.col("verification_state").isin("pending", "needs_correction", "unreadable"))
    urgency = F.when(F.col("verification_state") == "needs_correction", 0).when(F.col("verification_state") == "unreadable", 1).otherwise(2)
    told = F.array(F.when(F.col("source_scanned"), "source is a scan"), F.when(F.col("ocr_used"), "OCR used"))
    equations = F.array(F.when(F.col("math_count") > 0, F.concat(F.col("math_count").cast("string"), F.lit(" equation(s)"))))
    reasons = F.filter(F.concat(told, F.coalesce("quality_issues", _empty("string")), equations), lambda r: r.isNotNull())
    order = Window.partitionBy("document_id").orderBy(urgency, F.asc_nulls_first("quality_score"), F.desc("math_count"), "page_number")
    rows = open_.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max(1, min(100, limit)))
    return rows.select("document_id", "position", "page_number", "verification_state", "verification_note", "quality_score", "quality_state", "math_count", reasons.alias("reasons"))


# ---------------------------------------------------------------------------------------------- reports


def list_documents(documents: DataFrame) -> DataFrame:
    """Documents, the newest first."""
    return documents.select("id", title(documents).alias("title"), "page_count", "status", "kind", "language", "quality_tier", "created_at").orderBy(F.desc("created_at"), "id")


def status(documents: DataFrame, pages: DataFrame, chunks: DataFrame, jobs: DataFrame, runs: DataFrame, corrections: DataFrame) -> DataFrame:
    """A row for each document: counts, lists of pages by what they need, latest job, engines, corrections."""
    state = F.col("verification_state")
    per_page = pages.groupBy("document_id").agg(
        F.count("*").alias("pages_stored"), F.sum("math_count").alias("equations"), F.sum("table_count").alias("tables"), F.sum("char_count").alias("chars"),
        F.round(F.avg("quality_score"), 3).alias("mean_quality"), F.count_if(F.col("quality_tier") == "high").alias("high_quality_pages"),
        _pages_where(F.col("needs_ocr")).alias("needs_ocr"), _pages_where(F.col("source_scanned")).alias("source_scanned"), _pages_where(F.col("ocr_used")).alias("ocr_used"),
        _pages_where(F.col("math_count") > 0).alias("math_pages"), _pages_where(F.col("quality_state").isin("warning", "bad")).alias("low_quality_pages"),
        _pages_where(state.isin("pending", "needs_correction", "unreadable")).alias("unverified_pages"), _pages_where(state == "approved").alias("approved_pages"),
    )
    candidates = upgrade_candidates(pages).groupBy("document_id").agg(F.sort_array(F.collect_list("page_number")).alias("upgrade_candidates"))
    per_chunk = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    fixes = corrections.groupBy("document_id").agg(F.count("*").alias("corrections"), F.count_if(F.col("applied")).alias("corrections_applied"))
    out = documents.select(F.col("id").alias("document_id"), title(documents).alias("title"), "status", "kind", "page_count")
    for part in (per_page, candidates, per_chunk, latest_jobs(jobs), engines_used(runs), fixes):
        out = out.join(part, "document_id", "left")
    return out.fillna(0, ["pages_stored", "chunks", "corrections", "corrections_applied"])


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """(document_id, job_id, job_kind, job_state) of each document's latest job; of equally late ones the largest id."""
    last = F.max_by(F.struct("id", "kind", "state"), F.struct("created_at", "id"))
    rows = jobs.where("document_id is not null").groupBy("document_id").agg(last.alias("j"))
    return rows.select("document_id", F.col("j.id").alias("job_id"), F.col("j.kind").alias("job_kind"), F.col("j.state").alias("job_state"))


def engines_used(runs: DataFrame) -> DataFrame:
    """(document_id, engines): distinct engines of successful runs in the order of their first run."""
    first = runs.where("ok").groupBy("document_id", "engine").agg(F.min("id").alias("first"))
    listed = F.sort_array(F.collect_list(F.struct("first", "engine")))
    return first.groupBy("document_id").agg(F.transform(listed, lambda x: x["engine"]).alias("engines"))


def page_report(pages: DataFrame, problems_only: bool = False) -> DataFrame:
    rows = pages.where("quality_state <> 'good'") if problems_only else pages
    return rows.select("document_id", "page_number", "quality_score", "quality_state", "quality_issues", "math_count", "table_count", "char_count", "ocr_used", "needs_ocr", "verification_state")


def stats(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals."""
    one = lambda df, agg: df.agg(agg)
    total = one(documents, F.count("*").alias("documents")).crossJoin(one(pages, F.count("*").alias("pages")))
    return total.crossJoin(one(chunks, F.count("*").alias("chunks"))).crossJoin(one(pages, F.coalesce(F.sum("math_count"), F.lit(0)).alias("equations")))


def cache_hit(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, page_count, equations, tables, chunks) that an import of known content answers with."""
    per_page = pages.groupBy("document_id").agg(F.sum("math_count").alias("e"), F.sum("table_count").alias("t"))
    per_chunk = chunks.groupBy("document_id").agg(F.count("*").alias("c"))
    rows = documents.where("status = 'complete'").select(F.col("id").alias("document_id"), "page_count")
    rows = rows.join(per_page, "document_id", "left").join(per_chunk, "document_id", "left")
    return rows.select("document_id", "page_count", *(F.coalesce(a, F.lit(0)).alias(b) for a, b in (("e", "equations"), ("t", "tables"), ("c", "chunks"))))


def benchmark_engines(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(engine, pages, seconds, pages_per_second, equations, display_equations, tables, chars, failing) of a comparison."""
    q = pages.withColumn("q", Q.assess(F.col("markdown")))
    per = q.groupBy("engine").agg(F.count("*").alias("pages"), F.sum("q.math_count").alias("equations"), F.sum("q.display_math_count").alias("display_equations"), F.sum("q.table_count").alias("tables"), F.sum("q.char_count").alias("chars"), F.count_if(F.col("q.state") != "good").alias("pages_failing_gate"))
    spent = runs.groupBy("engine").agg(F.sum("duration_s").alias("seconds"))
    speed = F.when(F.col("seconds") > 0, F.bround(F.col("pages") / F.col("seconds"), 2))
    return per.join(spent, "engine").withColumn("pages_per_second", speed)


# ---------------------------------------------------------------------------------------------- documents as text


def document_markdown(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(document_id, markdown): title, then each page under its mark, joined by blank lines."""
    part = F.concat(F.lit("<!-- page "), F.col("page_number").cast("string"), F.lit(" -->\n\n"), T.trim(F.coalesce("markdown", F.lit(""))))
    joined = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", part.alias("t")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    if documents is None:
        return joined.select("document_id", F.concat(body, F.lit("\n")).alias("markdown"))
    rows = joined.join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("__t")), "document_id", "left")
    head = F.when(F.coalesce("__t", F.lit("")) != "", F.concat(F.lit("# "), F.col("__t"), F.lit("\n\n"))).otherwise("")
    return rows.select("document_id", F.concat(head, body, F.lit("\n")).alias("markdown"))


def metadata_json(documents: DataFrame) -> DataFrame:
    """(document_id, metadata): every column as JSON, keys in order."""
    return documents.select(F.col("id").alias("document_id"), F.to_json(F.struct(*sorted(documents.columns))).alias("metadata"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def proofread_html(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, html): a page's Markdown to read beside its image; math stays for the browser."""
    blocks = F.filter(F.transform(F.split("markdown", r"\n\s*\n"), T.trim), lambda b: b != "")
    level = lambda b: F.least(F.lit(6), F.length(F.regexp_extract(b, "^(#+) ", 1)))

    def shown(b: Column) -> Column:
        heading = F.concat(F.lit("<h"), level(b).cast("string"), F.lit(">"), escape_html(T.trim(F.regexp_replace(b, "^#+", ""))), F.lit("</h"), level(b).cast("string"), F.lit(">"))
        math = b.startswith("$$") & b.endswith("$$")
        return F.when(math, escape_html(b)).when(b.rlike("^#+ "), heading).otherwise(F.concat(F.lit("<p>"), F.replace(escape_html(b), F.lit("\n"), F.lit("<br>")), F.lit("</p>")))

    return pages.select("document_id", "page_number", F.array_join(F.transform(blocks, shown), "\n").alias("html"))


def region(requests: DataFrame, blocks: DataFrame, margin: float = 8.0, least: float = 4.0) -> DataFrame:
    """What part of a page to show for ``requests(document_id, page_number, block, width, height, max_tokens)``.

    (…, x0, y0, x1, y1, scale, tokens, note, error). Without a block, a layout or a box it is the whole page; a block
    that isn't there is an error. Boxes get a margin within the page; tiny ones fall back to the page.
    """
    there = blocks.groupBy("document_id", "page_number").agg(F.max("ordinal").alias("last"))
    one = blocks.select("document_id", "page_number", F.col("ordinal").alias("block"), "bbox", F.lit(True).alias("known"))
    rows = requests.join(there, ["document_id", "page_number"], "left").join(one, ["document_id", "page_number", "block"], "left")
    error = F.when(F.col("block").isNotNull() & F.col("last").isNotNull() & F.col("known").isNull(), F.concat(F.lit("no such block; blocks are 0 to "), F.col("last").cast("string")))
    note = F.when(F.col("block").isNotNull() & F.col("last").isNull(), "no layout is known: whole page").when(F.col("known") & F.col("bbox").isNull(), "the block has no box: whole page")
    grown = [F.greatest(F.lit(0.0), F.col("bbox.x0") - margin), F.greatest(F.lit(0.0), F.col("bbox.y0") - margin), F.least("width", F.col("bbox.x1") + margin), F.least("height", F.col("bbox.y1") + margin)]
    small = F.col("bbox").isNull() | (grown[2] - grown[0] < least) | (grown[3] - grown[1] < least)
    page = [F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")]
    rows = rows.select("document_id", "page_number", "block", "max_tokens", *(F.when(small, p).otherwise(g).alias(n) for n, p, g in zip(("x0", "y0", "x1", "y1"), page, grown, strict=True)), note.alias("note"), error.alias("error"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = rows.withColumn("scale", T.render_scale(w, h, F.col("max_tokens")))
    return rows.withColumn("tokens", T.image_tokens(w * F.col("scale"), h * F.col("scale"))).drop("max_tokens")
