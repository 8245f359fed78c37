"""A library from import to deletion, by its calls, its command line and its tools."""

import json
import sys

import pytest
from pyspark import cloudpickle

from pagewright import cli
from pagewright.config import load
from pagewright.service import Library, LibraryError
from pagewright.sources import engines, files
from pagewright.tools import Tools

# engines of this file go to the workers with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ONE = "# Convergence\n\nTheorem 1. The dominated convergence theorem holds for every sequence of functions.\n\nProof. Apply the lemma of Fatou twice.\f# Series\n\nA series of positive terms with partial sums."
TWO = "# Groups\n\nDefinition. A group is a set with a product. Its matrix is $a$ and $$b$$."


class Better(engines.MarkdownEngine):
    name, quality_tier = "better", "high"

    def extract(self, content, pages=None):
        return [p | {"markdown": p["markdown"] + "\n\nRead better.", "ocr_used": True} for p in super().extract(content, pages)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "one.md").write_text(ONE)
    (root / "copy.md").write_text(ONE)
    (root / "two.md").write_text(TWO)
    return str(root)


@pytest.fixture(scope="module")
def library(spark, folder, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("library")), better=Better())
    assert {r.status for r in lib.import_pdf(folder).collect()} == {"complete"}
    return lib


def ref(library, name):
    return library.tables.read("documents").where(f"filename = '{name}'").first().id


def test_same_content_is_one_document(library, folder):
    assert library.stats().first().documents == 2
    before = library.tables.versions("documents")
    assert library.import_pdf(folder).count() == 3 and library.tables.read("runs").count() == 2
    assert library.tables.versions("documents")[-1] == before[-1] + 1


def test_search_and_retrieval(library):
    hit = library.search("dominated convergence").first()
    assert hit.match == "exact" and hit.document == "copy" and hit.page_start == 1
    assert library.search("convergense").first().match == "approximate"
    assert "dominated" in library.get_chunk(hit.chunk_id).first().content
    assert [r.found for r in library.get_pages("copy", [1, 2, 9]).collect()] == [True, True, False]
    assert library.get_section("copy", "series").first().page_start == 2
    assert not library.index_is_stale()
    with pytest.raises(LibraryError, match="no document"):
        library.resolve("nothing")
    with pytest.raises(LibraryError, match="ambiguous"):
        library.resolve(".md")


def test_review_correction_upgrade_repair(spark, library, folder):
    one = ref(library, "copy.md")
    contents = files.document_files(spark, folder, "one.md").selectExpr(f"'{one}' AS document_id", "content")
    pages = spark.createDataFrame([(one, 2)], "document_id string, page_number int")
    library.upgrade_pages(contents, pages)
    row = library.tables.read("pages").where(f"document_id = '{one}' AND page_number = 2").first()
    assert row.quality_tier == "high" and row.verification_state == "pending" and "Read better" in row.markdown
    assert library.document(one).first().quality_tier == "mixed"
    assert library.search("read better").first().document_id == one
    assert [r.page_number for r in library.ocr_review_queue(one).collect()] == [2]
    with pytest.raises(LibraryError, match="note"):
        library.record_ocr_review(one, 2, "needs_correction")
    with pytest.raises(LibraryError, match="page"):
        library.record_ocr_review(one, 77, "approved")
    library.record_ocr_review(one, 2, "needs_correction", "check the sums")
    proposals = spark.createDataFrame([(one, 2, row.markdown + "\n\nCorrected text.", 0.95, [], "m"), (one, 1, "", 0.9, [], "m")], "document_id string, page_number int, markdown string, confidence double, warnings array<string>, model string")
    assert sorted((r.page_number, r.applied) for r in library.correct_ocr_pages(proposals).collect()) == [(1, False), (2, True)]
    states = {r.page_number: r.verification_state for r in library.tables.read("pages").where(f"document_id = '{one}'").collect()}
    assert states == {1: "needs_correction", 2: "approved"}
    assert library.vision_correction_history(one).count() == 2 and library.search("corrected text").first().match == "exact"
    assert library.repair_document(one).count() == 0
    status = library.status(one).first()
    assert status.corrections_applied == 1 and status.approved_pages == [2] and status.chunks > 0


class Reader:
    name = "reader"

    def __init__(self, up=True):
        self.up = up

    def available(self):
        return self.up

    def correct(self, document_id, page_number, markdown, closer=False):
        if page_number == 1:
            raise ValueError("no image")
        return json.dumps({"markdown": markdown + (" Seen closely." if closer else ""), "confidence": 0.9, "warnings": [] if closer else ["blurred"]})


def test_pages_are_read_again(spark, library):
    one = ref(library, "copy.md")
    pages = spark.createDataFrame([(one, 1), (one, 2)], "document_id string, page_number int")
    audit = {r.page_number: r for r in library.read_again(Reader(), pages).collect()}
    assert audit[2].applied and audit[2].warnings == [] and not audit[1].applied and "ValueError: no image" in audit[1].warnings
    assert library.search("seen closely").first().document_id == one
    gone = library.read_again(Reader(False), pages.where("page_number = 2")).collect()
    assert [r.warnings for r in gone if r.page_number == 2 and not r.applied and r.confidence == 0]
    assert library.tables.read("pages").where(f"document_id = '{one}' AND page_number = 2").first().verification_state == "pending"


def test_command_line(spark, library, capsys):
    root = library.tables.root.removesuffix("/tables")
    for argv, code in ((["list"], 0), (["search", "group"], 0), (["search", "qqqqqq"], 1), (["status", "two"], 0), (["page", "two", "1"], 0), (["page", "two", "9"], 1), (["report", "two"], 0), (["section", "two", "groups"], 0), (["review-queue"], 0), (["blocks", "two", "1"], 1), (["image", "two", "1"], 0), (["reindex", "--all"], 0), (["repair", "two"], 0), (["doctor"], 0), (["config"], 0), (["status", "none"], 1), (["review-mark", "two", "1", "nonsense"], 1)):
        assert cli.main(["--root", root, *argv], spark) == code, argv
    assert "Groups" in capsys.readouterr().out


def test_tools(library):
    tools = Tools(library)
    assert len(tools.NAMES) == 15 and all(hasattr(tools, n) for n in tools.NAMES)
    found = tools.call("search_library", query="group product", limit=99)
    assert found.startswith("Passages with all words") and len(found) < 6000
    chunk = int(found.split("\n")[1].split(" |")[0])
    assert tools.call("get_chunk", chunk_id=chunk).startswith("[document text")
    assert "missing" in tools.call("get_pages", document="two", pages=[1, 50])
    assert tools.call("get_section", document="two", section="zzz").startswith("Error")
    assert tools.call("document_status", document="nope").startswith("Error") and tools.call("nope").startswith("Error")
    assert "Nothing" in tools.call("ocr_review_queue", document="two")
    assert json.loads(tools.call("get_page_image", document="two", page=1, max_tokens=5))["tokens"] <= 160
    assert "page(s)" in tools.call("reprocess", document="two")
    assert tools.call("record_ocr_review", document="two", page=1, verdict="approved") == "page 1: approved"


def test_jobs(library):
    ok, bad = library.submit("import", lambda: None), library.submit("import", lambda: 1 / 0)
    assert library.job(ok).first().state == "complete"
    row = library.job(bad).first()
    assert row.state == "failed" and "ZeroDivisionError" in row.error and row.started_at is not None


def test_deletion_takes_everything(library):
    two = ref(library, "two.md")
    library.delete_document("two")
    assert all(library.tables.read(n).where(f"document_id = '{two}'").count() == 0 for n in ("pages", "chunks", "runs"))
    assert library.stats().first().documents == 1 and all(r.document_id != two for r in library.search("group product").collect())


def test_engines_and_sources(spark, tmp_path):
    with pytest.raises(engines.EngineUnavailable):
        engines.extract(spark.createDataFrame([("d", b"")], "document_id string, content binary"), engines.get_engine("marker"))
    with pytest.raises(engines.EngineUnavailable):
        engines.get_engine("nothing")
    (tmp_path / "words.txt").write_text("# words\nέχει 12\n\nΈχει\nlatin\nγνωστή\n")
    assert sorted(r.word for r in files.lexicon(spark, str(tmp_path / "words.txt")).collect()) == ["έχει", "γνωστή"]
    pages = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "document_id string, page_number int, markdown string")
    files.write_page_files(pages, str(tmp_path / "pages"))
    files.write_page_files(pages.where("document_id = 'a'").selectExpr("document_id", "page_number", "'new' AS markdown"), str(tmp_path / "pages"))
    assert sorted((r.document_id, r.markdown) for r in files.read_page_files(spark, str(tmp_path / "pages")).collect()) == [("a", "new"), ("b", "y")]
    got = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "document_id string, page_number int, markdown string")
    wanted = spark.createDataFrame([("d", 7), ("d", 3)], "document_id string, page_number int")
    assert sorted((r.page_number, r.markdown) for r in engines.renumber(got, wanted).collect()) == [(3, "a"), (7, "b")]
    out = tmp_path / "out" / "doc1"
    out.mkdir(parents=True)
    (out / "x.json").write_text('{"children": []}')
    (out / "x_meta.json").write_text('{"page_stats": []}')
    assert files.engine_documents(spark, str(tmp_path / "out")).first().asDict() == {"document_id": "doc1", "json": '{"children": []}', "meta": '{"page_stats": []}'}


def test_a_failing_file_is_a_row(spark):
    class Broken(engines.MarkdownEngine):
        def extract(self, content, pages=None):
            raise ValueError("broken")

    rows = engines.extract(spark.createDataFrame([("d", b"x")], "document_id string, content binary"), Broken()).collect()
    assert rows[0].error == "ValueError: broken" and rows[0].page_number is None


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "config.toml").write_text('root = "/x"\n[import]\nmax_pages = 3\nnope = 1\n[search]\nmax_results = 4\n')
    c = load(str(tmp_path / "config.toml"))
    assert (c.root, c.imports.max_pages, c.search.max_results, c.chunking.target_chars) == ("/x", 3, 4, 1800)
    monkeypatch.setenv("PAGEWRIGHT_ROOT", "/y")
    assert load(str(tmp_path / "config.toml")).root == "/y"


def test_stream_of_documents(spark, tmp_path, sf_dir):
    from pagewright.streaming import landing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    stream = landing.landing(spark, str(tmp_path / "in"), docs._jdf.schema().toDDL())
    landing.process(landing.distinct_content(stream), landing.index_into(str(tmp_path / "chunks")), str(tmp_path / "check"), once=True).awaitTermination()
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert chunks.select("document_id").distinct().count() == docs.select("text").distinct().count()
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    n = chunks.count()
    landing.process(landing.distinct_content(stream), landing.index_into(str(tmp_path / "chunks")), str(tmp_path / "check"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == n


def test_limits_hold_for_every_engine(spark, folder, tmp_path):
    import dataclasses

    lib = Library(spark, str(tmp_path / "small"))
    lib.config = dataclasses.replace(lib.config, imports=dataclasses.replace(lib.config.imports, max_bytes=5))
    found = lib.import_pdf(folder).collect()
    assert found and all(r.status != "complete" and "larger than the limit" in r.error for r in found)
