"""The calls that an assistant makes, each answered with a text within a budget."""

from __future__ import annotations

import json

from pagewright.functions.text import REPLY_TOKENS
from pagewright.plans.documents import upgrade_candidates
from pagewright.service import Library, LibraryError, reply

MAX_RESULTS, MIN_IMAGE_TOKENS, MAX_IMAGE_TOKENS = 10, 150, 1800


#: Lines of a listing in one reply.
MAX_LINES = 200


class Tools:
    """Fifteen tools over one library. Document text is marked as data; listings are short by themselves."""

    NAMES = (
        "import_pdf", "search_library", "get_pages", "get_chunk", "get_section", "get_page_image", "review_ocr_page", "ocr_review_queue",
        "correct_ocr_pages", "correct_ocr_page", "record_ocr_review", "list_documents", "document_status", "job_status", "reprocess",
    )

    def __init__(self, library: Library):
        self.library = library

    def call(self, name: str, **arguments) -> str:
        if name not in self.NAMES:
            return f"Error: no tool {name}"
        try:
            return getattr(self, name)(**arguments)
        except LibraryError as e:
            return f"Error: {e}"

    @staticmethod
    def _lines(df) -> str:
        """A line for each row; of a longer listing the first MAX_LINES, and how many more there are."""
        df = df.cache()
        more = max(0, df.count() - MAX_LINES)
        lines = [json.dumps(r.asDict(True), ensure_ascii=False, default=str) for r in df.limit(MAX_LINES).collect()]
        df.unpersist()
        return "\n".join([*lines, *([f"{more} more rows are not shown."] if more else [])])

    def import_pdf(self, path: str, force: bool = False) -> str:
        job = self.library.submit("import", lambda: self.library.import_pdf(path, force))
        return f"job {job}\n" + self._lines(self.library.job(job))

    def search_library(self, query: str, document: str | None = None, limit: int = MAX_RESULTS, chunk_type: str | None = None) -> str:
        found = self.library.search(query, document, None, chunk_type, max(1, min(MAX_RESULTS, limit))).collect()
        if not found:
            return "No passage matches."
        how = {"exact": "Passages with all words", "partial": "No passage has all words; passages with some", "approximate": "No passage has these words; passages that look alike"}[found[0].match]
        return how + ":\n" + "\n".join(f"{r.chunk_id} | {r.document} p.{r.page_start}-{r.page_end} | {r.heading or ''} | {r.chunk_type} | {r.score}\n  {r.snippet}" for r in found)

    def get_pages(self, document: str, pages: list[int]) -> str:
        rows = self.library.get_pages(document, pages).collect()
        parts = [f"--- page {r.page_number}{' (read by OCR)' if r.ocr_used else ''} ---\n{r.markdown}" if r.found else f"--- page {r.page_number}: missing ---" for r in rows]
        return reply("\n\n".join(parts), REPLY_TOKENS, True, "Ask for fewer pages.")

    def get_chunk(self, chunk_id: int) -> str:
        row = self.library.get_chunk(chunk_id).first()
        if row is None:
            raise LibraryError(f"no passage {chunk_id}")
        return reply(f"{row.document} p.{row.page_start}-{row.page_end} {row.heading or ''}\n\n{row.content}", REPLY_TOKENS, True)

    def get_section(self, document: str, section: str) -> str:
        row = self.library.get_section(document, section).first()
        if row is None:
            raise LibraryError(f"no section like {section}")
        return reply(f"{row.heading} (p.{row.page_start}-{row.page_end})\n\n{row.content}", REPLY_TOKENS, True)

    def get_page_image(self, document: str, page: int, block: int | None = None, max_tokens: int = 900) -> str:
        return self._lines(self.library.render_page_region(document, page, block, max(MIN_IMAGE_TOKENS, min(MAX_IMAGE_TOKENS, max_tokens))))

    def review_ocr_page(self, document: str, page: int) -> str:
        text = self.library.get_pages(document, [page]).first()
        if not text.found:
            raise LibraryError(f"no page {page}")
        history = self._lines(self.library.vision_correction_history(document, page))
        return reply(f"page {page}, {text.verification_state}\n{history}\n\n{text.markdown}", REPLY_TOKENS, True)

    def ocr_review_queue(self, document: str | None = None, limit: int = 20) -> str:
        return self._lines(self.library.ocr_review_queue(document, limit)) or "Nothing waits for review."

    def correct_ocr_pages(self, document: str, proposals: list[dict], apply: bool = True) -> str:
        ref = self.library.resolve(document)
        rows = [(ref, p["page"], p.get("markdown") or "", float(p.get("confidence") or 0), p.get("warnings") or [], p.get("model") or "") for p in proposals]
        frame = self.library.spark.createDataFrame(rows, "document_id string, page_number int, markdown string, confidence double, warnings array<string>, model string")
        return self._lines(self.library.correct_ocr_pages(frame, apply).select("page_number", "confidence", "warnings", "applied"))

    def correct_ocr_page(self, document: str, page: int, markdown: str, confidence: float, warnings: list[str] | None = None, apply: bool = True) -> str:
        return self.correct_ocr_pages(document, [{"page": page, "markdown": markdown, "confidence": confidence, "warnings": warnings}], apply)

    def record_ocr_review(self, document: str, page: int, verdict: str, note: str | None = None) -> str:
        self.library.record_ocr_review(document, page, verdict, note)
        return f"page {page}: {verdict}"

    def list_documents(self) -> str:
        return self._lines(self.library.stats()) + "\n" + self._lines(self.library.list_documents())

    def document_status(self, document: str) -> str:
        return self._lines(self.library.status(document))

    def job_status(self, job_id: str) -> str:
        return self._lines(self.library.job(job_id)) or f"Error: no job {job_id}"

    def reprocess(self, document: str) -> str:
        ref = self.library.resolve(document)
        pages = self.library.tables.read("pages")
        n = upgrade_candidates(pages).where(pages["document_id"] == ref).count()
        better = self.library.better
        if better is None or not better.available():
            return f"{n} page(s) would be read again; no better engine is available."
        path = self.library.document(ref).first().source_path
        contents = self.library.spark.read.format("binaryFile").load(path).selectExpr(f"'{ref}' AS document_id", "content")
        return f"job {self.library.submit('upgrade', lambda: self.library.upgrade_pages(contents), ref)}: {n} page(s)"
