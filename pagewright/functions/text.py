"""Text functions as Spark columns: folding, stemming, index text, token budgets.

All are built-in expressions, so they run inside the scan's generated code. Strings count in code points. Null gives null
unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greek inflectional endings, of which a word loses the longest that leaves three letters.
GREEK_ENDINGS = (
    "ατοσ ατων ατα ατι οντασ ωντασ ουμε ουσα ουσεσ ονται ονταν ετε ουν ει εισ"
    " εων εωσ ιων ιωσ ουσ ων ησ εσ οσ ου ασ οι α ε η ι ο υ ω σ"
).split()
#: Estimated tokens by character.
ASCII_CHARS_PER_TOKEN, TOKENS_PER_OTHER_CHAR = 3.6, 0.85
SNIPPET_CHARS, PAGE_CHARS, REPLY_TOKENS = 320, 12_000, 6_000
IMAGE_SIDE, PIXELS_PER_TOKEN, MAX_SCALE, MIN_SCALE = 1568, 750, 4.0, 0.2
#: Python's white space, as a character class of Java and of RE2.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Characters of words: letters, marks that Python counts in, numbers, the underscore.
WORD = r"[\p{L}\p{N}_]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def trim(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(text, F.lit(_SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, F.lit(f"{SPACE}+"), F.lit(" ")))


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Precomposed letters, and the letters that are left of them without combining marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x0590), *range(0x1E00, 0x2000), 0x212B]:
        c = chr(code)
        bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)))
        if bare != c and len(bare) == 1 and not unicodedata.combining(c):
            source.append(c)
            target.append(bare)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents; a final sigma is a sigma."""
    source, target = _accented()
    plain = F.regexp_replace(F.translate(text, source, target), F.lit(r"\p{Mn}+"), F.lit(""))
    bare = F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)
    return F.replace(F.lower(bare), F.lit("ς"), F.lit("σ"))


def stem(folded: Column) -> Column:
    """Each Greek word of a folded text without its inflectional ending; other words stay."""
    endings = "|".join(GREEK_ENDINGS)
    cut = F.regexp_replace(folded, F.lit(rf"(?<={WORD}{{3}})(?:{endings})(?!{WORD})"), F.lit(""))
    return F.when(folded.rlike("[α-ω]"), cut).otherwise(folded)


def strip_math(text: Column) -> Column:
    """Math spans replaced by the names of the commands in them."""

    def spans(t: Column, pattern: str) -> Column:
        parts = F.split(F.regexp_replace(t, F.lit(pattern), F.lit("\u0001$1\u0002")), "\u0001")
        names = lambda body: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(body, F.lit(r"\\([a-zA-Z]{2,})"), 1), " "), F.lit(" "))
        body = lambda p: F.substring_index(p, "\u0002", 1)
        rest = lambda p: F.substring(p, F.length(body(p)) + 2, F.length(p))
        each = F.transform(parts, lambda p: F.when(F.contains(p, F.lit("\u0002")), F.concat(F.when(body(p).rlike(r"\\[a-zA-Z]{2,}"), names(body(p))).otherwise(F.lit(" ")), rest(p))).otherwise(p))
        return F.array_join(each, "")

    clean = F.translate(text, "\u0001\u0002", "  ")
    done = spans(spans(clean, r"(?s)\$\$(.+?)\$\$"), r"(?s)(?<!\\)\$(.+?)(?<!\\)\$")
    return F.when(F.contains(text, F.lit("$")), done).otherwise(text)


def index_text(markdown: Column) -> Column:
    """What the index holds of a passage: no markup, math as command names, folded and stemmed words."""
    bare = F.regexp_replace(strip_math(markdown), F.lit(r"(?m)^[#>\-*+ \t]+|[*_`]+"), F.lit(" "))
    bare = F.regexp_replace(bare, F.lit(r"[\\{}\[\]()^_&$~|]+"), F.lit(" "))
    return collapse(stem(fold(bare)))


def query_text(query: Column) -> Column:
    """A query in the same form; with two quotes or more its punctuation stays, as syntax."""
    stemmed = stem(fold(query))
    plain = F.regexp_replace(stemmed, F.lit(r'[():"*^-]'), F.lit(" "))
    quotes = F.length(query) - F.length(F.replace(query, F.lit('"'), F.lit("")))
    return collapse(F.when(quotes >= 2, stemmed).otherwise(plain))


def words(text: Column) -> Column:
    """Runs of letters, numbers and underscores."""
    return F.filter(F.split(text, rf"[^\p{{L}}\p{{N}}_]+"), lambda w: w != "")


def tokens(folded: Column) -> Column:
    """Tokens of a folded text, cut at whatever is no letter or number."""
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def spaced_tokens(folded: Column) -> Column:
    """The tokens of a folded text, apart by one space."""
    return F.trim(F.regexp_replace(folded, F.lit(r"[^\p{L}\p{N}\p{Co}]+"), F.lit(" ")))


def index_tokens(text: Column) -> Column:
    """Tokens of a text as the index has them."""
    return tokens(fold(text))


def trigrams(text: Column) -> Column:
    """Three-letter windows of every word of four letters or more, in order, repeats included."""
    long = F.filter(words(text), lambda w: F.length(w) >= 4)
    return F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3))))


def gram_text(text: Column) -> tuple[Column, Column]:
    """(g, cut) from which a folded text's trigrams are cut: words apart by one space, null where they are the tokens; not ``cut``: the pieces."""
    scored = F.contains(text, F.lit("_"))
    apart = F.trim(F.regexp_replace(text, F.lit(r"[^\p{L}\p{N}_]+"), F.lit(" ")))
    return F.when(scored, F.array_join(tokens(F.array_join(trigrams(text), " ")), " ")).when(text.rlike(r"\p{Co}"), apart).alias("g"), (~scored).alias("cut")


def token_estimate(text: Column) -> Column:
    """Estimated number of tokens: none of an empty text, else one at least."""
    other = F.length(F.regexp_replace(text, F.lit(r"[\x00-\x7F]+"), F.lit("")))
    estimate = ((F.length(text) - other) / F.lit(ASCII_CHARS_PER_TOKEN) + other * F.lit(TOKENS_PER_OTHER_CHAR)).cast("int")
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), estimate))


def truncate_to_tokens(text: Column, most: int) -> Column:
    """struct(text, cut): the longest beginning within a budget, cut back to a paragraph, line or word end.

    The end must lie beyond six tenths of the beginning. How long a beginning is allowed follows from a running estimate
    over its characters, which the budget bounds.
    """
    # no beginning within the budget has more characters than this
    window = int((most + 1) * ASCII_CHARS_PER_TOKEN) + 2
    chars = F.split(F.substring(text, 1, window), "")
    price = F.transform(F.filter(chars, lambda c: c != ""), lambda c: c.rlike(r"^[\x00-\x7F]$"))
    state = F.struct(F.lit(0).alias("ascii"), F.lit(0).alias("other"), F.lit(0).alias("best"))

    def step(acc: Column, plain: Column) -> Column:
        ascii_, other = acc["ascii"] + plain.cast("int"), acc["other"] + (~plain).cast("int")
        estimate = F.greatest(F.lit(1), (ascii_ / F.lit(ASCII_CHARS_PER_TOKEN) + other * F.lit(TOKENS_PER_OTHER_CHAR)).cast("int"))
        return F.struct(ascii_.alias("ascii"), other.alias("other"), F.when(estimate <= most, ascii_ + other).otherwise(acc["best"]).alias("best"))

    low = F.aggregate(price, state, step, lambda acc: acc["best"])
    head = F.substring(text, F.lit(1), low)
    at = lambda end: F.length(head) - F.length(F.substring_index(head, end, -1)) - len(end)
    ends = F.array(*(at(F_end) for F_end in ("\n\n", "\n", " ")))
    chosen = F.get(F.filter(ends, lambda i: i > low * 0.6), F.lit(0))
    back = F.regexp_replace(F.when(chosen.isNotNull(), F.substring(head, F.lit(1), chosen)).otherwise(head), F.lit(f"{SPACE}+$"), F.lit(""))
    fits = token_estimate(text) <= most
    return F.struct(F.when(fits, text).otherwise(back).alias("text"), (~fits).alias("cut"))


def snippet(content: Column, most: int = SNIPPET_CHARS) -> Column:
    """One line of at most ``most`` characters; a longer one ends at a word and with dots."""
    flat = collapse(content)
    head = F.regexp_replace(F.substring(flat, 1, most), F.lit(" [^ ]*$"), F.lit(""))
    return F.when(F.length(flat) > most, F.concat(head, F.lit(" ..."))).otherwise(flat)


def page_cut(text: Column, most: int = PAGE_CHARS) -> Column:
    """A page's text for a reply, cut where it is too long."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n[page truncated]"))).otherwise(text)


def compact_ranges(numbers: Column, most: int = 200) -> Column:
    """Ascending runs of whole numbers as text: "1-3, 7"; "-" if there are none; cut when it gets long."""
    distinct = F.sort_array(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))
    starts = F.filter(distinct, lambda x: ~F.array_contains(distinct, x - 1))
    ends = F.filter(distinct, lambda x: ~F.array_contains(distinct, x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))
    joined = F.array_join(runs, ", ")
    cut = F.concat(F.substring(joined, 1, most), F.lit("... ("), F.size(distinct).cast("string"), F.lit(" total)"))
    return F.when(F.size(distinct) == 0, "-").when(F.length(joined) > most, cut).otherwise(joined)


def engine_page_range(pages: Column) -> Column:
    """Page numbers from 1 as an engine's range from 0: "0-2,8"; null if no page is left."""
    zero = F.transform(F.filter(pages, lambda p: p >= 1), lambda p: p - 1)
    return F.when(F.size(zero) > 0, F.replace(compact_ranges(zero, 1 << 30), F.lit(", "), F.lit(",")))


def image_tokens(width: Column, height: Column) -> Column:
    """Estimated tokens of an image, which is scaled down to the largest side allowed."""
    scale = F.least(F.lit(1.0), F.lit(float(IMAGE_SIDE)) / F.greatest(width, height, F.lit(1)))
    return F.floor((width * scale) * (height * scale) / PIXELS_PER_TOKEN).cast("int")


def render_scale(width: Column, height: Column, tokens: Column) -> Column:
    """The scale at which a region fits a token budget."""
    w, h = F.greatest(width.cast("double"), F.lit(1.0)), F.greatest(height.cast("double"), F.lit(1.0))
    fit = F.least(F.sqrt(tokens * PIXELS_PER_TOKEN / (w * h)), F.lit(float(IMAGE_SIDE)) / F.greatest(w, h), F.lit(MAX_SCALE))
    return F.greatest(F.lit(MIN_SCALE), fit)


def document_uuid(sha256: Column) -> Column:
    """A document's id: the first 32 digits of its hash, as a UUID."""
    return F.regexp_replace(F.substring(sha256, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
