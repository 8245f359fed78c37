"""Mixing sources to target weights.

Each source is one stream of words in the order of its documents, cut into blocks of fixed length. The mix is a sequence
of slots, each as long as a block, in output shards. Each shard draws its counts of slots by source from a multinomial
distribution with the targets' shares: one seeded categorical draw for each of its slots, counted. The draws of all
shards together miss the targets by chance, by a share that falls with the size of the mix; where they miss by more than
``TOLERANCE``, or take more of a source than its cap, the source's counts are scaled in all shards alike. A source's
q-th slot, counted through the shards, takes the block that a pseudorandom permutation of its blocks, another one in
every pass, gives for q; blocks are joined by that index. Everything is arithmetic on indexes, so reruns agree and no
text moves until spans are cut from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.workspace import Workspace

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 4096
#: How far the slots drawn of a source may be from what its target asks for, as a share of that.
TOLERANCE = 0.005
#: Slots that one row of the plan expands to, at most, and shards whose counts one row of the ledger holds together.
CHUNK, LEDGER = 8192, 1024
WORD_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def permute(x: Column, n: Column, *key: Column, rounds: int = 12) -> Column:
    """A pseudorandom permutation of 0..n-1 at x: swap-or-not rounds (Hoang, Morris and Rogaway 2012).

    A round pairs x with (k - x) mod n and swaps the two or not by a bit that both give alike, so it is a bijection for
    every n.
    """

    def swap(at: Column, i: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit("k"), i, *key) - at, n)
        high = F.greatest(at, other)
        return F.when(F.xxhash64(F.lit("b"), i, high, *key) % 2 == 0, other).otherwise(at)

    return F.aggregate(F.array(*(F.lit(i) for i in range(rounds))), x.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, s, target) of ``sizes(source, source_size)``, a row for each source; s numbers the sources.

    Sources in code point order, null last, get the weights in turn. Targets share the sum of all sizes by weight; no
    target is above ``cap`` times its source, what is above goes to the others by weight until none is above. In closed
    form: in ascending order of size by weight the sources that are capped come first, the rest share what is left.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("s") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("s", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * cap)
    rising = Window.orderBy(F.col("cap") / F.col("w"), "s")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    used = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    rows = rows.withColumn("share", (F.sum("source_size").over(everything) - used("cap")) / (F.sum("w").over(everything) - used("w")))
    rows = rows.withColumn("capped", F.col("cap") <= F.col("share") * F.col("w"))
    rows = rows.withColumn("level", F.max(F.when(~F.col("capped"), F.col("share"))).over(everything))
    return rows.select("source", "source_size", "s", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


class Mix:
    """A plan for mixing ``docs(doc_id, text, source)``.

    Documents without words have size zero and are in no block. Null sources are one source, the last. Rows that repeat
    are documents of their own; rows that agree in all columns are copies of one another and follow each other in the
    stream. Null doc_ids come first in their source. An empty table gives empty tables. Other columns are carried along.
    """

    def __init__(self, ws: Workspace, docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shard_slots: int = SHARD_SLOTS):
        self.ws, self.block, self.shard_slots, self.cap = ws, block_words, shard_slots, cap
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_hash(docs).alias("h"), word_count(F.col("text")).alias("size"))
        order = [F.asc_nulls_last("source"), F.asc_nulls_first("doc_id"), F.asc("h")]
        sorted_rows = ws.save(rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "sizes")
        sums = sorted_rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        n_s = F.ceil(F.col("source_size") / self.block)
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        rest = F.least(n_s, F.round((F.col("target") - F.col("passes") * F.col("source_size")) / self.block).cast("long"))
        targets = source_targets(sums, weights, cap).withColumn("n_blocks", n_s).withColumn("passes", F.least(passes, F.lit(cap)).cast("long"))
        targets = targets.withColumn("asked", F.col("passes") * F.col("n_blocks") + F.when(F.col("passes") < cap, rest).otherwise(0))
        upto = F.sum("asked").over(Window.orderBy("s"))
        targets = targets.withColumn("upto", upto).withColumn("all_slots", F.sum("asked").over(Window.partitionBy())).drop("passes")
        targets = ws.save(targets, "targets")
        self.total, self.names = targets.agg(F.coalesce(F.max("all_slots"), F.lit(0)), F.count_if(F.col("asked") > 0)).first()
        self.draws = ws.save(self._draw(targets), "draws")
        # what the draws come to, held to the tolerance and the cap; a source never drawn has its slots in one shard
        seen = self.draws.groupBy("s").agg(F.sum("n").alias("drawn")).withColumnRenamed("s", "t")
        slack = F.floor(F.col("asked") * TOLERANCE)
        most = F.least(F.col("asked") + slack, F.col("n_blocks") * cap)
        targets = targets.join(seen, F.col("s") == F.col("t"), "left").drop("t").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
        targets = targets.withColumn("slots", F.greatest(F.col("asked") - slack, F.least(most, F.col("drawn"))))
        targets = targets.withColumn("passes", F.when(F.col("n_blocks") > 0, F.floor(F.col("slots") / F.col("n_blocks"))).otherwise(0))
        self.sources = ws.save(targets, "sources")
        self.ledger = ws.save(self._counts(), "counts")

        # where each document begins in its source's stream: within its part of the order, and what parts before hold
        own = Window.partitionBy("pid", "source").orderBy(F.asc_nulls_first("doc_id"), "h").rowsBetween(Window.unboundedPreceding, -1)
        held = sorted_rows.groupBy("pid", "source").agg(F.sum("size").alias("held"))
        earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
        held = held.select(F.col("pid").alias("p"), F.col("source").alias("o"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("earlier"))
        placed = sorted_rows.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
        placed = placed.join(held, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("o")))
        placed = placed.join(self.sources.select("s", F.col("source").alias("name"), "source_size", "target"), F.col("source").eqNullSafe(F.col("name")))
        # a document is known by its source and where it begins; one without words by nothing, and needs no name
        self.docs = ws.save(placed.select("doc_id", "h", "s", "size", "source_size", "target", (F.col("earlier") + F.col("within")).alias("begin")), "placed")

    def _draw(self, targets: DataFrame) -> DataFrame:
        """(shard, s, n): the counts that each shard draws, as many in all as the shard has slots."""
        shares = targets.where("asked > 0").agg(F.sort_array(F.collect_list(F.struct("upto", "s"))).alias("shares"))
        slot = self.ws.spark.range(0, self.total, 1, max(1, -(-self.total // (16 * CHUNK))))
        at = F.pmod(F.xxhash64(F.lit("draw"), F.col("id")), F.lit(self.total)).alias("at")
        rows = slot.select(F.floor(F.col("id") / self.shard_slots).alias("shard"), at).crossJoin(F.broadcast(shares))  # one row

        def step(low: Column, half: Column) -> Column:  # binary search: the first source whose end is above
            there = F.get("shares", low + half - 1)
            return F.when(there["upto"] <= F.col("at"), low + half).otherwise(low)

        halves = [F.lit(1 << k) for k in reversed(range(self.names.bit_length()))]
        found = F.aggregate(F.array(*halves), F.lit(0), step) if halves else F.lit(0)
        return rows.select("shard", F.get("shares", found)["s"].alias("s")).groupBy("shard", "s").agg(F.count("*").alias("n"))

    def _counts(self) -> DataFrame:
        """The draws, scaled to the slots that each source has."""
        never = self.sources.where("slots > 0 and drawn = 0")
        shards = max(1, -(-self.total // self.shard_slots))
        draws = self.draws.select("shard", "s", "n").union(never.select(F.pmod(F.xxhash64("s"), F.lit(shards)), "s", F.lit(1).cast("long")))
        # the running count of a source's draws, in two steps, so that no task has all shards of a source
        draws = draws.withColumn("page", F.floor(F.col("shard") / LEDGER))
        pages = draws.groupBy("s", "page").agg(F.sum("n").alias("held"))
        pages = pages.select("s", "page", (F.sum("held").over(Window.partitionBy("s").orderBy("page")) - F.col("held")).alias("earlier"))
        upto = F.sum("n").over(Window.partitionBy("s", "page").orderBy("shard"))
        draws = draws.withColumn("within", upto).join(pages, ["s", "page"]).withColumn("upto", F.col("earlier") + F.col("within"))
        draws = draws.join(self.sources.select(F.col("s").alias("t"), "slots", "drawn", "n_blocks"), F.col("s") == F.col("t"))
        drawn = F.greatest("drawn", F.lit(1))
        scaled = lambda c: F.when((F.col("slots") == F.col("drawn")) | (c == 0), c).when(c == drawn, F.col("slots")).otherwise(F.floor(c * (F.col("slots") / drawn)))
        first = scaled(F.col("upto") - F.col("n"))
        return draws.select("shard", "s", "n_blocks", first.alias("first"), (scaled(F.col("upto")) - first).cast("long").alias("n")).where("n > 0")

    def counts(self) -> DataFrame:
        """(shard, s, n, first): each output shard's slots by source, and the first's number, counted through the shards."""
        return self.ledger.select("shard", "s", "n", "first")

    def slots(self) -> DataFrame:
        """(s, q, pass, block, shard, position): every slot of the mix, and the block that it takes.

        A shard's slots have the positions from 0 on, in a pseudorandom order of its sources.
        """
        order = Window.partitionBy("shard").orderBy("s")
        rows = self.ledger.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("shard")))
        rows = rows.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
        # few small rows that become many: dealt out by number, or they would be put together by their size
        rows = rows.repartition(max(1, -(-self.total // (4 * CHUNK))), F.col("shard"), F.col("s"), F.col("lo"))
        rows = rows.withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("n"), F.col("lo") + CHUNK) - 1)))
        rows = rows.select("shard", "s", "n_blocks", (F.col("before") + F.col("i")).alias("place"), "all", (F.col("first") + F.col("i")).alias("q"))
        rows = rows.withColumn("pass", F.floor(F.col("q") / F.col("n_blocks")))
        block = permute(F.col("q") % F.col("n_blocks"), F.col("n_blocks"), F.col("s"), F.col("pass"))
        position = permute(F.col("place"), F.col("all"), F.lit("slots"), F.col("shard"))
        return rows.select("s", "q", "pass", block.alias("block"), "shard", position.alias("position"))

    def blocks(self) -> DataFrame:
        """(s, block, begin, first, n): which words of which documents a block holds; first from 0.

        A document is named by its source and the place in the source's stream where it begins.
        """
        last = F.floor((F.col("begin") + F.col("size") - 1) / self.block)
        rows = self.docs.where("size > 0").select("s", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / self.block), last)).alias("block"))
        lo = F.greatest(F.col("begin"), F.col("block") * self.block)
        hi = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * self.block)
        return rows.select("s", "block", "begin", (lo - F.col("begin")).alias("first"), (hi - lo).alias("n"))

    def spans(self) -> DataFrame:
        """(shard, position, s, pass, begin, first, n): the mix; each slot's words as spans of documents."""
        return self.slots().hint("merge").join(self.blocks(), ["s", "block"]).select("shard", "position", "s", "pass", "begin", "first", "n")

    def _with(self, found: DataFrame) -> DataFrame:
        """The documents, and what ``found(s, begin, ...)`` says of them."""
        worded = self.docs.where("size > 0")
        found = found.withColumnRenamed("s", "found_s").withColumnRenamed("begin", "found_begin").hint("merge")
        return worded.join(found, (F.col("s") == F.col("found_s")) & (F.col("begin") == F.col("found_begin")), "left").drop("found_s", "found_begin")

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) for each document; taken counts words as often as they are taken."""
        takes = self.slots().groupBy("s", "block").agg(F.count("*").alias("takes")).hint("merge")  # many more than Spark expects
        words = self.blocks().join(takes, ["s", "block"]).groupBy("s", "begin").agg(F.sum(F.col("takes") * F.col("n")).alias("taken"))
        out = lambda df, c: df.select("doc_id", "size", "source_size", "target", F.coalesce(c, F.lit(0)).cast("long").alias("taken"))
        return out(self._with(words), F.col("taken")).union(out(self.docs.where("size = 0"), F.lit(0)))

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mixed documents, with the columns of ``docs``: a row for each pass that takes any of a document's words.

        A pass that takes all words gives the text as it is, another the words taken, in order, joined by one space.
        ``docs`` are the documents of the plan. Of rows that agree in all columns one brings the text for all: the texts
        are dealt once, by id and hash, and both the search for such rows and the join with the plan are done there.
        """
        parts = self.slots().join(self.sources.select(F.col("s").alias("t"), "passes"), F.col("s") == F.col("t"))
        parts = parts.where(F.col("pass") >= F.col("passes")).select("s", "block").hint("merge")
        partial = self.blocks().join(parts, ["s", "block"]).groupBy("s", "begin").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"), F.sum("n").alias("m"))
        plan = self._with(partial).join(self.sources.select(F.col("s").alias("t"), "passes"), F.col("s") == F.col("t"))
        whole = F.col("passes") + F.when(F.col("m") == F.col("size"), 1).otherwise(0)
        plan = plan.select(*_key(F.col("doc_id"), F.col("h"), "k"), whole.alias("whole"), F.when(F.col("m") < F.col("size"), F.col("spans")).alias("spans"))
        plan = plan.where((F.col("whole") > 0) | F.col("spans").isNotNull())
        cols = docs.columns
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), *_key(F.col("doc_id").cast("long"), row_hash(docs), "r"))
        # the first of its equals; told by what is before, since a filter on a rank would sort the texts twice
        rows = rows.withColumn("before", F.lag("rh").over(Window.partitionBy("rd", "rh").orderBy("rh"))).where("before is null").drop("before")
        rows = rows.join(plan.hint("merge"), (F.col("rd") == F.col("kd")) & (F.col("rh") == F.col("kh")))
        words = F.filter(F.split(F.col("row.text"), WORD_GAP), lambda w: w != "")
        # a one-element transform splits the text once for all its spans
        taken = lambda w: F.array_join(F.flatten(F.transform(F.col("spans"), lambda x: F.slice(w, (x["first"] + 1).cast("int"), x["n"].cast("int")))), " ")
        cut = F.get(F.transform(F.array(words), taken), F.lit(0))
        copies = F.when(F.col("whole") > 0, F.sequence(F.lit(1).cast("long"), F.col("whole"))).otherwise(F.array().cast("array<bigint>"))
        each = F.concat(copies, F.when(F.col("spans").isNotNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")))
        rows = rows.select("row", "spans", F.explode(each).alias("pass"))
        out = rows.select("row", F.when(F.col("pass") == 0, cut).otherwise(F.col("row.text")).alias("new"))
        return out.select(*(F.col("new").alias(c) if c == "text" else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in cols))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, nulls told from other values."""
    cols = [F.map_entries(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*cols, *(c.isNull() for c in cols))


def _key(doc_id: Column, h: Column, name: str) -> tuple[Column, Column]:
    """A key without nulls, so that one dealing serves windows and joins; the hash tells a null id from zero."""
    return F.coalesce(doc_id, F.lit(0).cast("long")).alias(f"{name}d"), h.alias(f"{name}h")
