"""Bottom-k sketches of shingle hashes.

A sketch is the ascending list of the k smallest distinct hashes of a text's shingles of five words; a text of fewer
words is one shingle, a text without words has an empty sketch. The sketch of a union is the k smallest of both
sketches, so sketches of parts merge into that of the whole. All is built-in functions over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.workspace import Workspace

K = 128
SHINGLE = 5
#: Hashes are below 2**HASH_BITS, so that a sketch's numbers are never negative; sixteen hexadecimal digits each.
HASH_BITS = 63
WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def _hash(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - HASH_BITS)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text, array<bigint>; null and empty texts give an empty array."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (shingle - 1))
        many = F.transform(starts, lambda i: _hash(*(F.get(w, i + (j - 1)) for j in range(shingle))))
        few = F.when(F.size(w) > 0, F.array(_hash(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= shingle, many).otherwise(few)

    # a one-element transform binds the words once
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.transform(F.array(words(text)), of)))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], column: str, k: int = K, fan: int = 64) -> DataFrame:
    """(keys, column): the sketches of each group merged, ``fan`` rows at a time before the group meets.

    Only the k smallest hashes of a group ever meet in one row: hashes are ranked within salted parts first, so a group
    that holds a third of all rows is no single task's work. Null sketches count as empty; a group of empty ones has an
    empty sketch. Null keys are a group; repeated rows change nothing; an empty table gives an empty table.
    """
    salted = df.select(*keys, F.coalesce(F.col(column), F.array().cast("array<bigint>")).alias("x"), F.pmod(F.monotonically_increasing_id(), F.lit(fan)).alias("salt"))
    hashes = salted.select(*keys, "salt", F.explode_outer("x").alias("v")).distinct()
    by = [F.asc_nulls_last("v")]
    first = hashes.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*by))).where(F.col("r") <= k)
    return first.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set("v")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1, of two texts by their sketches; two empty texts are alike.

    Exact where both sketches hold all hashes of their texts.
    """
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << HASH_BITS)) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty text is contained in all."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """A sketch as a string, sixteen hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, sketch) for each row of ``docs(doc_id, text)``."""
    return docs.select("doc_id", sketch(F.col("text"), k).alias("sketch"))


def neighbours(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, previous_id, previous_chars), a row for each distinct doc_id that isn't null.

    previous_chars is the length of the longest text of previous_id.

    next_id follows in ascending order, after the last comes the first. Only ids and lengths are sorted: in ranges, each
    with its own window, and the ends of the ranges are tied together.
    """
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    ids = ws.save(ids.repartitionByRange("doc_id").withColumn("pid", F.spark_partition_id()), "ids")
    ends = ids.groupBy("pid").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max_by("n", "doc_id").alias("last_n"))
    order, everything = Window.orderBy("pid"), Window.partitionBy()
    ends = ends.select(
        F.col("pid").alias("p"),
        F.coalesce(F.lead("first").over(order), F.min("first").over(everything)).alias("after"),
        F.coalesce(F.lag("last").over(order), F.max("last").over(everything)).alias("before"),
        F.coalesce(F.lag("last_n").over(order), F.max_by("last_n", "pid").over(everything)).alias("before_n"),
    )
    own = Window.partitionBy("pid").orderBy("doc_id")
    rows = ids.select("pid", "doc_id", F.lead("doc_id").over(own).alias("next"), F.lag("doc_id").over(own).alias("prev"), F.lag("n").over(own).alias("prev_n"))
    rows = rows.join(ends, F.col("pid") == F.col("p"))
    return ws.save(rows.select("doc_id", F.coalesce("next", "after").alias("next_id"), F.coalesce("prev", "before").alias("previous_id"), F.coalesce("prev_n", "before_n").alias("previous_chars")), "neighbours")


def edited_likeness(ws: Workspace, docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of ``docs(doc_id, text)``.

    The edited text has the last quarter of the code points (rounded down) replaced by as many from the beginning of the
    next document in ascending doc_id, after the last the first; all of it if it has fewer. Null texts are empty. A
    document alone is its own next. Rows with a null doc_id come before no other and have no next: they are edited with
    nothing. Of rows with one doc_id the next of all is the same; their beginning and sketch, as a next, are those of the
    smallest text. An empty table gives an empty table.
    """
    near = neighbours(ws, docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # all joins deal by the same two columns without nulls: the texts are shuffled once, what is lent once
    keys = lambda c, k: (F.coalesce(F.col(c), F.lit(0)).alias(f"k{k}"), F.col(c).isNull().alias(f"z{k}"))
    same = lambda a, b: (F.col(f"k{a}") == F.col(f"k{b}")) & (F.col(f"z{a}") == F.col(f"z{b}"))
    rows = rows.select("text", *keys("doc_id", 1))
    linked = rows.join(near.select("previous_id", "previous_chars", *keys("doc_id", 2)), same(1, 2))
    begin = F.substring(F.col("text"), F.lit(1), F.floor(F.col("previous_chars") / 4).cast("int"))
    lent = linked.select(*keys("previous_id", 3), F.struct(begin.alias("begin"), sketch(F.col("text"), k).alias("next_sketch")).alias("lent"))
    lent = lent.groupBy("k3", "z3").agg(F.min("lent").alias("lent"))
    rows = rows.join(lent, same(1, 3), "left").withColumn("doc_id", F.when(~F.col("z1"), F.col("k1")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.coalesce(F.substring(F.col("lent.begin"), F.lit(1), cut), F.lit("")))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("text"), k).alias("a"), sketch(edited, k).alias("b"), F.col("lent.next_sketch").alias("c"))
    empty = F.array().cast("array<bigint>")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.coalesce("c", empty), k).alias("near_next"))
