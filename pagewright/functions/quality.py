"""Scores of page text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import collapse, fold, trim

# What counts as a math span, in Java's pattern language.
DISPLAY = r"(?s)\$\$(.+?)\$\$"
INLINE = r"(?s)(?<!\\)(?<!\$)\$(?!\$)(.+?)(?<!\\)\$(?!\$)"
TABLE_ROW = r"(?m)^\s*\|.*\|\s*$"
LABEL = r"[a-zA-Zφψ]'?\(x\)"
LABEL_PRODUCT_BELOW = rf"\\frac\{{[^{{}}]*\}}\{{\s*{LABEL}(?:\s*\\cdot\s*{LABEL})+\s*\}}"
LABEL_BELOW = rf"\\frac\{{[^{{}}]*\}}\{{\s*{LABEL}\s*\}}"
CONTRADICTION = r"([A-Za-zα-ωΑ-Ω][A-Za-zα-ωΑ-Ω0-9_]*(?:\([^)]*\))?)\s*=\s*([^=]+?)\s*(?:\\to|\\rightarrow|→)\s*\1\s*=\s*([^=]+)"
GOOD, WARNING = 0.75, 0.45
MATH_SHARE = 0.004
MATH_CHARS = r"[\x{2200}-\x{22FF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{2A00}-\x{2AFF}\x{2100}-\x{214F}\x{2070}-\x{209F}\x{0370}-\x{03FF}]"
STRONG_MATH_CHARS = r"[\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{2070}-\x{209F}]"
GREEK_LETTER = r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]"
GREEK_SHARE = 0.3
INVENTORY = r"\\(?:frac|sqrt|int|ln|sin|cos|sinh|cosh|tanh|coth|sech|csch)|\$"
TRANSLITERATED = r"(?i)\b(?:h|eivar|autigropu|tus|unerbod)\b"
FLOWING_MATH = r"(?s)\$\$.*?\$\$|(?<!\\)\$.*?(?<!\\)\$"
ACCEPTED_CONFIDENCE = 0.80


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def occurrences(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def drop(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def math_count(markdown: Column) -> Column:
    """Math spans, display and inline."""
    return count(markdown, DISPLAY) + count(markdown, INLINE)


def unmatched_dollars(markdown: Column) -> Column:
    """Whether the math delimiters can't pair up; escaped ones don't count."""
    left = drop(F.replace(markdown, F.lit("\\$"), F.lit("")), DISPLAY)
    return (occurrences(left, "$$") % 2 != 0) | (occurrences(left, "$") % 2 != 0)


def math_density(text: Column, greek_document: Column | bool = False) -> Column:
    """Share of characters that look mathematical; in a Greek document Greek letters are prose."""
    greek = F.lit(greek_document) if isinstance(greek_document, bool) else greek_document
    found = F.when(greek, count(text, STRONG_MATH_CHARS)).otherwise(count(text, MATH_CHARS))
    return F.when(F.length(text) == 0, 0.0).otherwise(found / F.length(text))


def looks_mathematical(markdown: Column, greek_document: Column | bool = False) -> Column:
    return (math_count(markdown) > 0) | (math_density(markdown, greek_document) > MATH_SHARE)


def greek_share(text: Column) -> Column:
    """Greek letters by letters; zero without letters."""
    letters = count(text, r"\p{L}")
    return F.when(letters == 0, 0.0).otherwise(count(text, GREEK_LETTER.replace("[", r"[\p{L}&&[").replace("]", "]]")) / letters)


def language(text: Column) -> Column:
    """"ell" where Greek prevails outside of math, else "eng"."""
    return F.when(greek_share(drop(text, FLOWING_MATH, " ")) > GREEK_SHARE, "ell").otherwise("eng")


def _contradictions(markdown: Column) -> Column:
    """Definitions in math spans that say two things: X = A -> X = B."""
    spans = F.concat(F.regexp_extract_all(markdown, F.lit(DISPLAY), 1), F.regexp_extract_all(markdown, F.lit(INLINE), 1))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "[.,;]+$", "")
    said = lambda s: F.arrays_zip(F.regexp_extract_all(s, F.lit(CONTRADICTION), 2).alias("a"), F.regexp_extract_all(s, F.lit(CONTRADICTION), 3).alias("b"))
    pairs = F.flatten(F.transform(spans, said))
    return F.when(markdown.rlike(r"\\to|\\rightarrow|→"), F.size(F.filter(pairs, lambda p: bare(p["a"]) != bare(p["b"])))).otherwise(0)


def assess(markdown: Column) -> Column:
    """struct(score, state, issues, math_count, table_count, char_count, has_text, display_math_count) of a page.

    Penalties go off a score of one; the state is decided by the score before it is rounded to three places. Null counts
    as an empty page. ``table_count`` counts rows of tables.
    """
    markdown = F.coalesce(markdown, F.lit(""))
    has = lambda mark: F.contains(markdown, F.lit(mark))
    none = F.array().cast("array<string>")
    parts = {
        "n": F.length(trim(markdown)),
        "few": ~markdown.rlike(r"(?:\p{L}\P{L}*+){20}"),
        "odd": count(markdown, r"[\x{FFFD}\x{E000}-\x{F8FF}]"),
        "unmatched": F.when(has("$"), unmatched_dollars(markdown)).otherwise(False),
        "bodies": F.when(has("$"), F.regexp_extract_all(markdown, F.lit(DISPLAY), 1)).otherwise(none),
        "stray": F.when(has("\\"), count(drop(drop(markdown, DISPLAY, " "), INLINE, " "), r"\\[a-zA-Z]+")).otherwise(0),
        "products": F.when(has("\\frac"), count(markdown, LABEL_PRODUCT_BELOW)).otherwise(0),
        "below": F.when(has("\\frac"), count(markdown, LABEL_BELOW)).otherwise(0),
        "contradictory": F.when(has("$"), _contradictions(markdown)).otherwise(0),
        "inline": F.when(has("$"), count(markdown, INLINE)).otherwise(0),
        "rows": F.when(has("|"), count(markdown, TABLE_ROW)).otherwise(0),
    }
    # an array of one, so that its parts are worked out once, however often they are named
    return F.get(F.transform(F.array(F.struct(*(c.alias(name) for name, c in parts.items()))), _judged), F.lit(0))


def _judged(p: Column) -> Column:
    """What the parts of a page come to."""
    n, stray, products, contradictory = p["n"], p["stray"], p["products"], p["contradictory"]
    garbled = p["odd"] / F.greatest(n, F.lit(1))
    fractions = products + p["below"]
    unbalanced = F.exists(p["bodies"], lambda b: occurrences(b, "{") != occurrences(b, "}"))
    label = lambda name, value: F.concat(F.lit(f"{name}:"), value.cast("string"))
    rules = [
        (p["few"], F.lit("almost_no_text"), F.lit(0.5)),
        (garbled > 0.02, F.concat(F.lit("garbled_chars:"), F.format_string("%.2f", F.bround(garbled * 100, 2)), F.lit("%")), F.least(F.lit(0.6), garbled * 10)),
        (p["unmatched"], F.lit("unbalanced_math_delimiters"), F.lit(0.3)),
        (unbalanced, F.lit("unbalanced_braces_in_display_math"), F.lit(0.15)),
        (stray > 2, label("latex_outside_math", stray), F.least(F.lit(0.3), stray * 0.05)),
        (products > 0, label("underbrace_as_fraction", fractions), F.least(F.lit(0.45), fractions * 0.15)),
        (contradictory > 0, label("contradictory_definition", contradictory), F.least(F.lit(0.25), contradictory * 0.1)),
    ]
    empty = n == 0
    issues = F.filter(F.array(*(F.when(c, name) for c, name, _ in rules)), lambda x: x.isNotNull())
    score = F.lit(1.0)
    for c, _, penalty in rules:
        score = score - F.when(c, penalty).otherwise(0.0)
    score = F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    zero = lambda c: F.when(empty, 0).otherwise(c)
    return F.struct(
        F.bround(score, 3).alias("score"),
        state(score).alias("state"),
        F.when(empty, F.array(F.lit("empty_page"))).otherwise(issues).alias("issues"),
        zero(F.size(p["bodies"]) + p["inline"]).alias("math_count"),
        zero(p["rows"]).alias("table_count"),
        zero(n).alias("char_count"),
        (~empty & ~p["few"]).alias("has_text"),
        zero(F.size(p["bodies"])).alias("display_math_count"),
    )


def state(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= WARNING, "warning").otherwise("bad")


def missing_display_math(quality: Column, math_fonts: Column) -> Column:
    """The same struct where a page set in math fonts has no display math: that is bad whatever else it has."""
    missing = math_fonts & (quality["display_math_count"] == 0)
    worse = (
        quality.withField("issues", F.concat(quality["issues"], F.array(F.lit("display_math_missing"))))
        .withField("score", F.least(quality["score"], F.lit(0.4)))
        .withField("state", F.lit("bad"))
    )
    return F.when(missing, worse).otherwise(quality)


def needs_ocr(is_scanned: Column, has_text: Column, ocr_used: Column) -> Column:
    return is_scanned & ~has_text & ~ocr_used


def correction_warnings(original: Column, candidate: Column, confidence: Column, warnings: Column, greek_document: Column, least_greek: float = 0.35) -> Column:
    """Reasons, sorted, why a proposed page text must not be applied."""
    text, before = trim(candidate), trim(original)
    had, has = count(original, INVENTORY), count(text, INVENTORY)
    prose = drop(text, FLOWING_MATH, " ")
    checks = [
        (F.length(text) == 0, "empty_model_output"),
        (confidence <= 0, "missing_or_invalid_confidence"),
        (F.contains(F.lower(text), F.lit("[unreadable]")), "contains_unreadable_placeholder"),
        (text.rlike("(?U)" + TRANSLITERATED), "latin_transliteration_detected"),
        (occurrences(text, "{") != occurrences(text, "}"), "unbalanced_latex_braces"),
        ((occurrences(text, "$$") % 2 != 0) | (occurrences(text, "$") % 2 != 0), "unbalanced_math_delimiters"),
        ((F.length(before) >= 80) & (F.length(text) < F.floor(F.length(before) * 0.45)), "candidate_too_short"),
        (greek_document & (count(prose, r"\p{L}") > 0) & (greek_share(prose) < least_greek), "greek_prose_ratio_too_low"),
    ]
    dropped = F.when((had > 0) & (has < F.greatest(F.lit(1), F.floor(had * 0.7))), F.concat(F.lit("formula_inventory_dropped:"), had.cast("string"), F.lit("->"), has.cast("string")))
    found = F.filter(F.array(*(F.when(c, name) for c, name in checks), dropped), lambda x: x.isNotNull())
    own = F.coalesce(warnings, F.array().cast("array<string>"))
    return F.sort_array(F.array_distinct(F.concat(own, found)))


def accepted(warnings: Column, confidence: Column) -> Column:
    return (F.size(warnings) == 0) & (confidence >= ACCEPTED_CONFIDENCE)


def first_line(text: Column) -> Column:
    return collapse(F.substring_index(text, "\n", 1))


def folded_words(text: Column) -> Column:
    return F.split(fold(text), " ")
