"""Command line of a document library."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from pagewright.config import load
from pagewright.service import Library, LibraryError, reply
from pagewright.sources.engines import EngineUnavailable


def session() -> SparkSession:
    return SparkSession.builder.appName("pagewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(df) -> list[dict]:
    """All rows, a partition at a time."""
    return [r.asDict(True) for r in df.toLocalIterator()]


def _print(rows: list[dict]) -> int:
    for r in rows:
        print(json.dumps(r, ensure_ascii=False, default=str))
    return 0 if rows else 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the library")
    p.add_argument("--config", help="TOML file")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple[str, dict]):
        c = sub.add_parser(name)
        for flag, options in arguments:
            c.add_argument(flag, **options)

    ref, page = ("ref", {}), ("page", {"type": int})
    command("import", ("path", {}), ("--force", {"action": "store_true"}), ("--pattern", {"default": "*"}))
    command("list")
    command("search", ("query", {}), ("--document", {}), ("--pages", {"help": "first-last"}), ("--type", {}), ("--limit", {"type": int}))
    command("status", ("ref", {"nargs": "?"}))
    command("page", ref, ("pages", {"type": int, "nargs": "+"}))
    command("section", ref, ("section", {}))
    command("report", ref, ("--problems-only", {"action": "store_true"}))
    command("review-queue", ("ref", {"nargs": "?"}), ("--limit", {"type": int, "default": 20}))
    command("review-mark", ref, page, ("verdict", {}), ("--note", {}))
    command("reprocess", ref, ("--pages", {"type": int, "nargs": "*"}))
    command("image", ref, page, ("--block", {"type": int}), ("--tokens", {"type": int}))
    command("blocks", ref, page)
    command("repair", ("ref", {"nargs": "?"}))
    command("reindex", ("ref", {"nargs": "?"}), ("--all", {"action": "store_true"}))
    command("delete", ref, ("--yes", {"action": "store_true"}))
    command("doctor")
    command("config")
    return p


def run(library: Library, a: argparse.Namespace) -> int:
    spark = library.spark
    match a.command:
        case "import":
            rows = _rows(library.import_pdf(a.path, a.force, a.pattern))
            _print(rows)
            return int(any(r["status"] != "complete" for r in rows))
        case "list":
            _print(_rows(library.stats()))
            return _print([r | {"id": r["id"][:8]} for r in _rows(library.list_documents())])
        case "search":
            pages = tuple(map(int, a.pages.split("-"))) if a.pages else None
            return _print(_rows(library.search(a.query, a.document, pages, a.type, a.limit)))
        case "status":
            return _print(_rows(library.status(a.ref)))
        case "page":
            rows = _rows(library.get_pages(a.ref, a.pages))
            for r in rows:
                print(reply(r["markdown"] or "") if r["found"] else "", file=sys.stdout if r["found"] else sys.stderr)
                if not r["found"]:
                    print(f"no page {r['page_number']}", file=sys.stderr)
            return int(not any(r["found"] for r in rows))
        case "section":
            return _print(_rows(library.get_section(a.ref, a.section)))
        case "report":
            return _print(_rows(library.page_report(a.ref, a.problems_only)))
        case "review-queue":
            _print(_rows(library.ocr_review_queue(a.ref, a.limit)))
        case "review-mark":
            library.record_ocr_review(a.ref, a.page, a.verdict, a.note)
        case "reprocess":
            document = library.resolve(a.ref)
            path = library.document(document).first().source_path
            contents = spark.read.format("binaryFile").load(path).selectExpr(f"'{document}' AS document_id", "content")
            pages = spark.createDataFrame([(document, p) for p in a.pages], "document_id string, page_number int") if a.pages else None
            _print(_rows(library.upgrade_pages(contents, pages)))
        case "image":
            return _print(_rows(library.render_page_region(a.ref, a.page, a.block, a.tokens)))
        case "blocks":
            return _print(_rows(library.page_blocks(a.ref, a.page)))
        case "repair":
            _print(_rows(library.repair_document(a.ref)))
        case "reindex":
            library.reindex_all() if a.all or not a.ref else library.reindex_document(a.ref)
        case "delete":
            if not a.yes and input(f"delete {a.ref}? [y/N] ").strip().lower() != "y":
                return 1
            library.delete_document(a.ref)
        case "doctor":
            checks = library.doctor()
            for name, passed, detail in checks:
                print(f"{'ok ' if passed else '-- '} {name}: {detail}")
        case "config":
            print(json.dumps(library.settings(), indent=2))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        with Library(spark or session(), a.root, load(a.config, a.root)) as library:
            return run(library, a)
    except (LibraryError, EngineUnavailable) as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
