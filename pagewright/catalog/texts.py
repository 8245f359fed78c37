"""Queries of text functions and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.catalog import query
from pagewright.catalog.tables import FOLD_SQL, longs, table
from pagewright.functions import text as T
from pagewright.operators import markup, repair, structure

UUID_SQL = "concat_ws('-', substr({0},1,8), substr({0},9,4), substr({0},13,4), substr({0},17,4), substr({0},21,12))".format("sha256(text)")


@query(f"SELECT doc_id, sha256(text) AS sha256, {UUID_SQL} AS document_id FROM documents")
def content_hash(spark, sf_dir):
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha256"), T.document_uuid(sha).alias("document_id"))


@query(f"SELECT doc_id, sha256({FOLD_SQL.format('text')}) AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace({FOLD_SQL.format(r"regexp_replace(replace(text, '$', ''), '(?m)^[#>\-*+ \t]+|[*_`]+', ' ', 'g')")},
  '[\\{{}}\[\]()^_&$~|]+', ' ', 'g'), '\s+', ' ', 'g')) AS index_text FROM documents""")
def index_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.index_text(F.replace("text", F.lit("$"), F.lit(""))).alias("index_text"))


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _literal(rows, names):
    def shown(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::{'BIGINT' if isinstance(x, int) else 'DOUBLE'}" if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(names)})"


STEMS = [("συνάρτησης", "συναρτησ"), ("ΣΥΝΆΡΤΗΣΗΣ", "συναρτησ"), ("μερικά", "μερικ"), ("μερικών", "μερικ"), ("κλάσματα", "κλασμ"), ("κλασμάτων", "κλασμ"), ("και", "και"), ("της", "τησ"), ("quicksort", "quicksort"), ("theorem", "theorem")]


@query(_literal(STEMS, ["word", "stem"]))
def stem_words(spark, sf_dir):
    rows = _values(spark, [(w,) for w, _ in STEMS], "word string")
    return rows.select("word", T.stem(T.fold(F.col("word"))).alias("stem"))


QUERY_TEXTS = [("(", ""), ("AND", "and"), ("a OR", "a or"), ('"unterminated', "unterminated"), ("NEAR(", "near"), ('"two words"', '"two words"'), ("Ολοκλήρωμα!", "ολοκληρωμ!")]


@query(_literal(QUERY_TEXTS, ["query", "normalized"]))
def query_texts(spark, sf_dir):
    return _values(spark, [(q,) for q, _ in QUERY_TEXTS], "query string").select("query", T.query_text(F.col("query")).alias("normalized"))


MATH_WORDS = [(r"Let $\int_{-\infty}^{\infty} f(x)dx$ converge.", "let int infty infty converge."), (r"$$\sum_k a_k$$ and $c$", "sum and"), ("no math here", "no math here"), (r"cost \$5 only", "cost 5 only")]


@query(_literal(MATH_WORDS, ["text", "words"]))
def math_command_words(spark, sf_dir):
    return _values(spark, [(t,) for t, _ in MATH_WORDS], "text string").select("text", T.index_text(F.col("text")).alias("words"))


@query(r"""SELECT doc_id, len(g)::BIGINT AS n_grams, sha256(array_to_string(g, ' ')) AS grams FROM (
  SELECT doc_id, flatten(list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 4),
    lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))) AS g FROM documents)""")
def trigrams_per_document(spark, sf_dir):
    g = T.trigrams(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", g.alias("g"))
    return longs(rows.select("doc_id", F.size("g").alias("n_grams"), F.sha2(F.array_join("g", " "), 256).alias("grams")))


ESTIMATE_SQL = r"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, trunc((length(text) - o) / 3.6::DOUBLE + o * 0.85::DOUBLE)::BIGINT) END"


@query(rf"SELECT doc_id, {ESTIMATE_SQL}::BIGINT AS tokens FROM (SELECT *, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS o FROM documents)")
def token_estimate(spark, sf_dir):
    return longs(table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens")))


@query(rf"SELECT lang, sum({ESTIMATE_SQL})::BIGINT AS tokens, count(*) AS documents FROM (SELECT *, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS o FROM documents) GROUP BY lang")
def token_estimate_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("documents"))


@query(r"""WITH c AS (SELECT item_id, text, unnest(range(0, length(text) + 1)) AS k FROM benchmark),
f AS (SELECT item_id, max(k) AS low FROM (SELECT item_id, k, k - length(regexp_replace(left(text, k), '[\x00-\x7F]', '', 'g')) AS a FROM c)
  WHERE k = 0 OR greatest(1, trunc(a / 3.6::DOUBLE + (k - a) * 0.85::DOUBLE)) <= 40 GROUP BY item_id),
h AS (SELECT b.item_id, text, low, left(text, low) AS head FROM benchmark b JOIN f USING (item_id)),
p AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN length(head) - strpos(reverse(head), chr(10)) ELSE -1 END AS nl,
  CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') ELSE -1 END AS sp FROM h)
SELECT item_id, low < length(text) AS cut, CASE WHEN low >= length(text) THEN text ELSE regexp_replace(CASE WHEN nl > low * 0.6 THEN left(head, nl) WHEN sp > low * 0.6 THEN left(head, sp) ELSE head END, '\s+$', '') END AS text FROM p""")
def truncate_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.truncate_to_tokens(F.col("text"), 40).alias("t"))
    return rows.select("item_id", "t.cut", "t.text")


@query(r"""SELECT doc_id, CASE WHEN length(f) > 320 THEN regexp_replace(left(f, 320), ' [^ ]*$', '') || ' ...' ELSE f END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)""")
def snippet_320(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 12000 THEN left(text, 12000) || chr(10) || '[page truncated]' ELSE text END AS page FROM documents")
def page_text_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.page_cut(F.col("text")).alias("page"))


@query("""SELECT p_partkey, floor(w * s * (h * s) / 750)::BIGINT AS tokens FROM (SELECT *, least(1.0::DOUBLE, 1568.0::DOUBLE / greatest(w, h, 1)) AS s
  FROM (SELECT p_partkey, (p_size * 50)::DOUBLE AS w, p_retailprice::DOUBLE AS h FROM part))""")
def image_token_budget(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 50).cast("double").alias("w"), F.col("p_retailprice").alias("h"))
    return longs(part.select("p_partkey", T.image_tokens(F.col("w"), F.col("h")).alias("tokens")))


@query("""SELECT p_partkey, round(greatest(0.2, least(sqrt(900.0::DOUBLE * 750 / (w * h)), 1568.0::DOUBLE / greatest(w, h), 4.0)), 9) AS scale
  FROM (SELECT p_partkey, greatest((p_size * 50)::DOUBLE, 1) AS w, greatest(p_retailprice::DOUBLE, 1) AS h FROM part)""")
def render_scale(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(T.render_scale(F.col("p_size") * 50, F.col("p_retailprice"), F.lit(900)), 9).alias("scale"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn AS z FROM conversations WHERE role = 'assistant'),
i AS (SELECT conv_id, z, z - row_number() OVER (PARTITION BY conv_id ORDER BY z) AS g FROM t),
r AS (SELECT conv_id, min(z) AS a, max(z) AS b FROM i GROUP BY conv_id, g)
SELECT conv_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM r GROUP BY conv_id""")
def page_range_compact(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    pages = c.groupBy("conv_id").agg(F.collect_list((F.col("turn") + 1).cast("int")).alias("p"))
    return pages.select("conv_id", T.engine_page_range(F.col("p")).alias("pages"))


# ---------------------------------------------------------------------------------------------- repairs


HYPHENS = [("we apply integra-\n\n-tion by parts", "we apply integration by parts", 1, 0), ("λέξη παραγο-\n\n  -ντική ολοκλήρωση.", "λέξη παραγοντική ολοκλήρωση.", 1, 0), ("το ολοκλήρωμα\n\n  - ρωμα και", "το ολοκλήρωμα\n\nκαι", 0, 1), ("- one\n- two", "- one\n- two", 0, 0), ("end-\n- Capital", "end-\n- Capital", 0, 0), ("a\n\n\n\nb", "a\n\nb", 0, 0)]


@query(_literal(HYPHENS, ["text", "repaired", "joined", "dropped"]).replace("\n", "' || chr(10) || '"))
def hyphen_rejoin(spark, sf_dir):
    rows = _values(spark, [(x[0],) for x in HYPHENS], "text string").withColumn("r", repair.rejoin_hyphenation(F.col("text")))
    n = lambda k: F.coalesce(F.try_element_at("r.counts", F.lit(k)), F.lit(0))
    return longs(rows.select("text", F.col("r.text").alias("repaired"), n("hyphen_rejoined").alias("joined"), n("hyphen_duplicate_dropped").alias("dropped")))


@query(r"""SELECT doc_id, regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents WHERE NOT regexp_matches(text, '(?m)^\s*[-‐‑–]')""")
def hyphen_rejoin_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(?m)^\s*[-‐‑–]"))
    return docs.select("doc_id", repair.rejoin_hyphenation(F.col("text"))["text"].alias("text"))


SCRIPTS = [("O(n<sup>2</sup>)", "O($n^{2}$)"), ("footnote<sup>a long explanatory sentence here</sup>", "footnote<sup>a long explanatory sentence here</sup>"), ("x<sup>2</sup><sub>i</sub>", "$x^{2}_{i}$"), ("note<sup>1</sup>", "note$^{1}$"), ("plain", "plain")]


@query(_literal(SCRIPTS, ["text", "repaired"]))
def html_scripts(spark, sf_dir):
    return _values(spark, [(t,) for t, _ in SCRIPTS], "text string").select("text", repair.html_scripts(F.col("text")).alias("repaired"))


GREEK = [("$60vx$", r"$\operatorname{συν}x$"), (r"$60\nu x$", r"$\operatorname{συν} x$"), ("$26vx$", r"$2\operatorname{συν}x$"), ("$6$ and $6th$ and $x = 60$", "$6$ and $6th$ and $x = 60$"), (r"$\eta \mu x$", r"$\operatorname{ημ}x$"), (r"$\alpha \beta \gamma$", r"$\alpha \beta \gamma$"), ("η δυσκολία: $h$ οποία έχει", "η δυσκολία: η οποία έχει"), ("$h(x)$ οποία", "$h(x)$ οποία"), (r"$\operatorname{ημ}x$", r"$\operatorname{ημ}x$"), ("Greek ημ prose", "Greek ημ prose")]


@query(_literal(GREEK, ["text", "repaired"]))
def greek_math_repair(spark, sf_dir):
    rows = _values(spark, [(t,) for t, _ in GREEK], "text string")
    return rows.select("text", repair.greek_formulas(F.col("text"), F.lit(True))["text"].alias("repaired"))


LEXICON = ["παραγοντική", "έχουμε", "συνάρτηση", "γνωστή"]
SPELLINGS = [("παραχουτική", "παραγοντική"), ("έκουμε", "έχουμε"), ("δυνάρτηση", "συνάρτηση"), ("χνωστή", "γνωστή"), ("άσχετη", None), ("παραγοντική", None), ("word", None)]


@query(_literal([r for r in SPELLINGS if r[1]], ["word", "replacement"]))
def spelling_candidates(spark, sf_dir):
    lines = _values(spark, list(enumerate(["# words", *LEXICON])), "position int, value string")
    return repair.spelling_candidates(_values(spark, [(w,) for w, _ in SPELLINGS], "word string"), repair.lexicon_table(lines))


@query("SELECT 'd' AS document_id, 1::BIGINT AS page_number, 'Η παραγοντική μέθοδος έχει $παραχουτική(x)$.' AS markdown, 'παραχουτική>παραγοντική' AS changes")
def spelling_repair(spark, sf_dir):
    lines = _values(spark, list(enumerate(LEXICON)), "position int, value string")
    pages = _values(spark, [("d", 1, "Η παραχουτική μέθοδος έχει $παραχουτική(x)$.")], "document_id string, page_number int, markdown string")
    rows = repair.repair_spelling(pages, repair.lexicon_table(lines), ["document_id", "page_number"])
    told = F.array_join(F.transform("changes", lambda c: F.concat_ws(">", c["original"], c["replacement"])), ",")
    return longs(rows.select("document_id", "page_number", "markdown", told.alias("changes")))


# ---------------------------------------------------------------------------------------------- markup


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.html_to_markdown(F.col("html")).alias("markdown"))


@query("""SELECT n_regionkey::BIGINT AS n_regionkey, chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) ||
  string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) AS markdown FROM nation GROUP BY n_regionkey""")
def table_to_markdown(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("cells"))))
    tables = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform(rows, lambda r: r["cells"])).alias("rows"))
    return longs(tables.select("n_regionkey", markup.table_to_markdown(F.col("rows")).alias("markdown")))


ENGINE_JSON = '{"children": [{"block_type": "Page", "id": "/page/119/Page/1", "bbox": [0, 0, 600, 800], "children": [{"block_type": "PageHeader", "html": "<p>skip</p>"}, {"block_type": "Text", "html": "<p>Let <math>f(x) = x</math></p>", "bbox": [10, 70, 500, 200]}, {"block_type": "Group", "children": [{"block_type": "Equation", "html": "<math display=\\"block\\">y</math>"}]}]}, {"block_type": "Page", "id": "/page/3/Page/1", "children": [{"html": "<h2>T</h2>"}]}]}'
ENGINE_META = '{"page_stats": [{"page_id": 119, "text_extraction_method": "surya"}, {"page_id": 3, "text_extraction_method": "pdftext"}]}'
ENGINE_PAGES = [("d", 4, "## T", False, 1), ("d", 120, "Let $f(x) = x$\n\n$$\ny\n$$", True, 2)]


@query(_literal(ENGINE_PAGES, ["document_id", "page_number", "markdown", "ocr_used", "n_blocks"]).replace("\n", "' || chr(10) || '"))
def engine_json_pages(spark, sf_dir):
    docs = _values(spark, [("d", ENGINE_JSON, ENGINE_META)], "document_id string, json string, meta string")
    return longs(markup.engine_pages(docs).select("document_id", "page_number", "markdown", "ocr_used", F.size("blocks").alias("n_blocks")))


ENGINE_BLOCKS = [("d", 4, 0, "Text", None, 4), ("d", 120, 0, "Text", 10.0, 14), ("d", 120, 1, "Equation", None, 7)]


@query(_literal(ENGINE_BLOCKS, ["document_id", "page_number", "ordinal", "block_type", "x0", "char_count"]))
def engine_layout_blocks(spark, sf_dir):
    docs = _values(spark, [("d", ENGINE_JSON, ENGINE_META)], "document_id string, json string, meta string")
    blocks = markup.layout_blocks(markup.engine_pages(docs))
    return longs(blocks.select("document_id", "page_number", "ordinal", "block_type", F.col("bbox.x0").alias("x0"), "char_count"))


FAILURES = [("Traceback:\nValueError: bad page range\n  see the docs for help", "ValueError: bad page range"), ("x\nllama-server binary not found\n", "the layout engine needs llama-server: install it, or choose another engine"), ("just\nlines\n", "lines")]


@query(_literal(FAILURES, ["output", "told"]).replace("\n", "' || chr(10) || '"))
def engine_failures(spark, sf_dir):
    return _values(spark, [(x,) for x, _ in FAILURES], "output string").select("output", markup.explain_failure(F.col("output")).alias("told"))


MARKERS = [("Περίπτωση 2: Αν έχουμε", "Περίπτωση 2"), ("Θεώρημα 2.5. Έστω", "Θεώρημα 2.5"), ("Λύση Έχουμε", "Λύση"), ("**Proof.** Apply", "Proof"), ("Λύψ x", "Λύψ"), ("Εφαρμόχή y", "Εφαρμόχή"), ("Παράδειχμα: z", "Παράδειχμα"), ("Περίπτωση I a", "Περίπτωση 1"), ("Εφαρμόζουμε το", None), ("Παρατηρούμε", None), ("εφαρμογή", None), ("", None)]


@query(_literal(MARKERS, ["line", "marker"]))
def section_markers(spark, sf_dir):
    return spark.createDataFrame([(x, structure.section_marker(x)) for x, _ in MARKERS], "line string, marker string")
