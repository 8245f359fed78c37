"""SimHash near-duplicates found with BK-trees.

A fingerprint is compared only with fingerprints of its own shard. Shards come from the pigeonhole principle: 64 bits in
``radius + 1`` blocks, so two fingerprints within the radius agree on a whole block. A shard whose block is common is
cut again by blocks of the bits that are left, until it is small enough for one tree; no pair within the radius is lost
on the way. Each shard of two or more becomes one BK-tree, built where its fingerprints meet. The trees are broadcast,
and every task looks its fingerprints up in their shards' trees, following only edges within the radius. Broadcasts have
a bound, ``BROADCAST_ENTRIES`` over all trees of a level; the trees of a corpus that needs more stay in their shards'
tasks, and the fingerprints, which are there too, are looked up in them there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.graph import connected_components, split_join
from pagewright.sieve import Sieve
from pagewright.workspace import Workspace, ship

BITS = 64
SHINGLE = 3
RADIUS = 2
TREE_SIZE = 1024
#: Nodes that all broadcast trees of a level have together, at most: at 28 bytes each about 30 MB.
BROADCAST_ENTRIES = 1 << 20


# ---------------------------------------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of the words' shingles; zero without words."""
    h = shingle_hashes(text, width, seed)
    return _bits_of(h) if len(h) else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
        fp = np.array(out, dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of ``docs(doc_id, text)``; fp is the fingerprint's bits as a signed long.

    Null and empty texts get fingerprint zero. Other columns are ignored; rows that repeat are kept.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_fingerprints, "doc_id long, fp long")


# ---------------------------------------------------------------------------------------------- BK-tree


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """BK-trees side by side in arrays: children keyed by their integer Hamming distance to the parent.

    ``edge`` holds, ascending, ``parent * (BITS + 1) + distance`` of each child, ``below`` the child. Items are inserted
    level by level: all items that stand at one node are dealt to its edges at once, the first of an edge becomes the
    child. ``roots`` are the first items of the trees; a tree's items follow one another.
    """

    def __init__(self, items: np.ndarray, roots: np.ndarray):
        self.items, self.roots = items, roots.astype(np.int64)
        rest = np.delete(np.arange(len(items)), self.roots)
        at = self.roots[np.searchsorted(self.roots, rest, side="right") - 1]
        edges, below = [], []
        while len(rest):
            edge = at * (BITS + 1) + _distance(items[rest], items[at])
            own, first, where = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(own), below.append(rest[first])
            at = rest[first][where]
            stay = at != rest
            rest, at = rest[stay], at[stay]
        edge = np.concatenate(edges or [np.zeros(0, np.int64)])
        order = np.argsort(edge, kind="stable")
        self.edge, self.below = edge[order], np.concatenate(below or [np.zeros(0, np.int64)])[order].astype(np.int32)

    def within(self, queries: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node) pairs at no more than the radius, each query from its tree's root in ``start``; only the
        edges d-radius..d+radius are followed."""
        found_q, found_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        q, node = np.arange(len(queries)), start.astype(np.int64)
        while len(q):
            d = _distance(queries[q], self.items[node])
            hit = d <= radius
            found_q.append(q[hit]), found_n.append(node[hit])
            next_q, next_n = [], []
            if len(self.edge):
                for step in range(-radius, radius + 1):
                    e = d + step
                    ok = (e >= 0) & (e <= BITS)
                    key = node[ok] * (BITS + 1) + e[ok]
                    at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                    there = self.edge[at] == key
                    next_q.append(q[ok][there]), next_n.append(self.below[at[there]].astype(np.int64))
            q = np.concatenate(next_q) if next_q else q[:0]
            node = np.concatenate(next_n) if next_n else node[:0]
        return np.concatenate(found_q), np.concatenate(found_n)


class BKTree(BKForest):
    """One tree."""

    def __init__(self, items: np.ndarray):
        super().__init__(items, np.zeros(min(1, len(items)), np.int64))

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node) pairs at no more than the radius."""
        return self.within(queries if len(self.items) else queries[:0], np.zeros(len(queries) * bool(len(self.items)), np.int64), radius)


def _forest(batch: pa.RecordBatch) -> tuple[np.ndarray, BKForest, np.ndarray]:
    """(shards, their trees, number of fingerprints in each) of rows (shard, fps)."""
    lists = batch.column(1)
    ends = lists.offsets.to_numpy().astype(np.int64)
    return batch.column(0).to_numpy(), BKForest(lists.flatten().to_numpy().view("<u8"), (ends - ends[0])[:-1]), np.diff(ends)


def _pairs(queries: np.ndarray, items: np.ndarray, q: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    a, b = queries[q].view("<i8"), items[n].view("<i8")
    keep = a < b  # each pair is found from either side
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _search_in_place(radius: int):
    """Pairs of rows (shard, fps), each shard searched by its own fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, forest, sizes = _forest(batch)
                yield _pairs(forest.items, forest.items, *forest.within(forest.items, np.repeat(forest.roots, sizes), radius))

    return run


TREES = "shards binary, roots binary, items binary, edge binary, below binary"


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trees of rows (shard, fps), a row for each batch."""
    for batch in batches:
        if batch.num_rows:
            shards, forest, _ = _forest(batch)
            arrays = (shards, forest.roots, forest.items, forest.edge, forest.below)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in arrays], names=[c.split(" ")[0] for c in TREES.split(", ")])


class _Trees(BKForest):
    """The forest of collected rows of :func:`_plant`; ``start(shards)`` gives each shard's root, -1 without a tree."""

    def __init__(self, rows: list):
        size = np.cumsum([0, *(len(r.items) // 8 for r in rows)])
        read = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.items = whole(read("items", "<u8"), "<u8")
        self.edge = whole([x + at * (BITS + 1) for x, at in zip(read("edge", "<i8"), size, strict=False)], "<i8")
        self.below = whole([(x + at).astype("<i4") for x, at in zip(read("below", "<i4"), size, strict=False)], "<i4")
        shards, roots = whole(read("shards", "<i8"), "<i8"), whole([x + at for x, at in zip(read("roots", "<i8"), size, strict=False)], "<i8")
        order = np.argsort(shards, kind="stable")
        self.shards, self.roots = shards[order], roots[order]

    def start(self, shards: np.ndarray) -> np.ndarray:
        if not len(self.shards):
            return np.full(len(shards), -1)
        at = np.minimum(np.searchsorted(self.shards, shards), len(self.shards) - 1)
        return np.where(self.shards[at] == shards, self.roots[at], -1)


def _look_up(trees, radius: int):
    """Pairs of rows (shard, fp) with what the broadcast trees hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = trees.value
        for batch in batches:
            start = forest.start(batch.column(0).to_numpy())
            there = start >= 0
            queries = batch.column(1).to_numpy()[there].view("<u8")
            if len(queries):
                yield _pairs(queries, forest.items, *forest.within(queries, start[there], radius))

    return run


# ---------------------------------------------------------------------------------------------- shards


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` runs of nearly equal length."""
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _keyed(fps: DataFrame, blocks: dict[str, list[int]]) -> DataFrame:
    """A row for each fingerprint and each block name: (shard, block, fp)."""
    at = F.col("fp")
    shards = [F.struct(F.lit(name).alias("block"), F.lit(name + ":").alias("p"), at.bitwiseAND(F.lit(_mask(bits))).alias("v")) for name, bits in blocks.items()]
    return fps.select("fp", F.explode(F.array(*shards)).alias("s")).select(F.xxhash64("s.p", "s.v").alias("shard"), F.col("s.block").alias("block"), "fp")


def links(ws: Workspace, fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fps(fp)`` at Hamming distance <= radius; a pair may come more than once.

    Level by level: shards that fit into a tree are searched, the others are cut by blocks of the bits that their
    members needn't share. The bits run out after a few levels, so every shard gets small in the end. A level's trees
    are broadcast if they have at most ``broadcast_entries`` nodes; else they are searched where they are built. Both
    ways give the same pairs.
    """
    parts = radius + 1
    runs = _cut(list(range(BITS)), parts)
    blocks = {str(i): run for i, run in enumerate(runs)}  # name: bits on which the shard agrees
    found, level = None, 0
    rows = _keyed(fps, blocks)
    while True:
        rows = ws.save(rows, f"shards-{level}")
        sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).where("n > 1")
        sizes = ws.save(sizes, f"sizes-{level}")
        final = all(BITS - len(b) <= 10 for b in blocks.values())
        small = sizes if final else sizes.where(F.col("n") <= tree_size)
        near = rows.join(small.select("shard", "block"), ["shard", "block"])
        trees = near.repartition("shard").groupBy("shard", "block").agg(F.collect_list("fp").alias("fps")).select("shard", "fps")
        entries = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if entries <= broadcast_entries:
            planted = trees.mapInArrow(_plant, TREES).collect()  # no more than broadcast_entries nodes
            sent = ws.spark.sparkContext.broadcast(_Trees(planted))
            new = rows.select("shard", "fp").mapInArrow(_look_up(sent, radius), "a long, b long")
        else:
            new = trees.mapInArrow(_search_in_place(radius), "a long, b long")
        new = ws.save(new, f"links-{level}")
        found = new if found is None else found.union(new)
        large = sizes.where(F.col("n") > tree_size)
        if final or large.isEmpty():
            return found
        hot = rows.join(large.select("shard", "block"), ["shard", "block"])
        finer: dict[str, list[int]] = {}
        under: dict[str, dict[str, list[int]]] = {}
        for name, bits in blocks.items():
            left = [b for b in range(BITS) if b not in bits]
            under[name] = {f"{name}.{i}": bits + run for i, run in enumerate(_cut(left, parts))}
            finer |= under[name]
        rows = None
        for name, own in under.items():
            part = _keyed(hot.where(F.col("block") == name).select("fp"), own)
            rows = part if rows is None else rows.union(part)
        rows = rows.distinct()
        blocks, level = finer, level + 1


def near_duplicates(ws: Workspace, docs: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs(doc_id, text)``.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id that
    links reach, the row's own included. Null and empty texts share fingerprint zero and link like any other. Rows with
    a null doc_id take part, but don't give a component its name (null if it has no other rows). Rows that repeat stay.
    An empty table gives an empty table.
    """
    prints = ws.save(fingerprints(docs), "fingerprints")
    classes = ws.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).withColumnRenamed("fp", "of"), "classes")
    roots = connected_components(ws, links(ws, classes.select(F.col("of").alias("fp")), radius, tree_size, broadcast_entries))
    named = _named(ws, classes, roots, "of")
    total = prints.count()
    return split_join(prints, named, ("fp", "of"), "copies", total).select("doc_id", "fp", "component_id")


def _named(ws: Workspace, classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``classes(key, first, ...)`` with component_id: the smallest ``first`` of all that have the same root."""
    of = classes.join(roots, F.col(key) == F.col("node"), "left").withColumn("root", F.coalesce("root", key)).drop("node")
    of = ws.save(of, "rooted")
    names = ws.save(of.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")).withColumnRenamed("root", "name"), "names")
    return ws.save(split_join(of, names, ("root", "name"), "members", of.count()).drop("root", "name", "members"), "named")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(ws: Workspace, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept: the one with the smallest doc_id.

    Rows with a null doc_id stay, as do rows that repeat a kept doc_id.
    """
    found = near_duplicates(ws, docs, radius)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


# ---------------------------------------------------------------------------------------------- similar texts

#: For texts that are similar in content rather than in a few bits: five-word shingles, and at least this share of them
#: in common. Fingerprints of such texts mostly differ in up to about 18 bits, of short texts in more; no block of bits
#: survives that, so shards are the texts whose smallest shingle hashes agree under each of BAND_ROWS permutations, for
#: one of BANDS such bands: of two texts with a similarity of 0.8 one in 10,000 pairs shares no shard, of 0.85 one in
#: 600,000. Of texts that share a fifth of their shingles, a passage say, one pair in ten meets in any.
TEXT_SHINGLE, SIMILARITY, WIDE_RADIUS = 5, 0.8, 20
BANDS, BAND_ROWS = 14, 3
#: Smallest hashes of the sketches that say which texts of a shard to compare, a byte of each; and how far below the bar
#: the likeness may be that they estimate: five times the estimate's standard deviation at the bar.
SKETCH, DOUBT = 256, 0.125
#: Pairs of texts of a shard that are looked at together: bounds the memory of a task.
PAIRS_AT_ONCE = 1 << 20
#: A larger shard is dealt in parts of about this many texts, and where whole texts meet of this many shingles.
PART, PART_SHINGLES = 512, 1 << 21
_rng = np.random.default_rng(5)
_FLIP, _TIMES = (_rng.integers(0, 1 << 63, BANDS * BAND_ROWS + SKETCH, dtype=np.uint64) for _ in range(2))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, width: int = TEXT_SHINGLE, seed: int = 42) -> np.ndarray:
    """Hashes of the words' shingles, repeats included; of fewer words the one of them all; none without words."""
    words = text.lower().split()  # of bytes: exactly the six ASCII spaces and A-Z
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")


def _bits_of(h: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(h), 65536):
        ones += np.unpackbits(h[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def smallest(distinct: np.ndarray, which: slice) -> np.ndarray:
    """The smallest hash under each of the permutations; ``distinct`` isn't empty."""
    flip, times = _FLIP[which], _TIMES[which]
    low = np.full(len(flip), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for start in range(0, len(distinct), 1024):
            np.minimum(low, ((distinct[start : start + 1024, None] ^ flip) * times).min(axis=0), out=low)
    return low


DESCRIBED = "node long, fp long, keys array<long>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, keys = [], []
        for t in batch.column(1):
            distinct = np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b""))
            if not len(distinct):
                fps.append(0), keys.append([])
                continue
            fps.append(_bits_of(distinct))  # a line that repeats outweighs nothing
            bands = smallest(distinct, slice(0, BANDS * BAND_ROWS)).reshape(BANDS, BAND_ROWS)
            keys.append([xxhash.xxh64_intdigest(bands[i].tobytes(), i) - (1 << 63) for i in range(BANDS)])
        fp = np.array(fps, dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], names=[c.split(" ")[0] for c in DESCRIBED.split(", ")])


def _sketches(packed: pa.BinaryArray) -> np.ndarray:
    """The sketches of a column without nulls, a row for each."""
    if not len(packed):
        return np.zeros((0, SKETCH), np.uint8)
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(packed), -1)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the sketches' rows; bytes agree by chance once in 256."""
    return ((a == b).mean(axis=1) - 1 / 256) / (255 / 256)


def spanning_pairs(n: int, a: np.ndarray, b: np.ndarray, likeness: np.ndarray) -> list[int]:
    """Indexes of pairs that connect all that the pairs connect, the likeliest first."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen, order = [], np.argsort(-likeness, kind="stable")
    levels = np.flatnonzero(np.append(True, np.diff(likeness[order]) != 0))
    for lo, hi in zip(levels, np.append(levels[1:], len(order)), strict=True):
        own = order[lo:hi]
        while True:  # parents of parents, until each points to its root
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        x, y = parent[a[own]], parent[b[own]]
        open_ = x != y
        if open_.any():
            _, first = np.unique(np.minimum(x, y)[open_] * n + np.maximum(x, y)[open_], return_index=True)
            for k in own[open_][first].tolist():
                i, j = root(a[k]), root(b[k])
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    chosen.append(k)
    return chosen


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole groups, where each group begins) of sorted rows; a group has the same first ``keys`` columns."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        if not table.num_rows:
            continue
        names = [table.column(k).to_numpy() for k in range(keys)]
        starts = np.append(0, np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1)
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def _candidates(radius: int, similarity: float):
    """Of each group of rows (key, part, node, fp, size, sketch): pairs that connect what is likely similar.

    A BK-tree gives the pairs whose fingerprints are within the radius, sketches and sizes say which of them may be
    similar. The likeliest that connect them all are chosen, and those of the text that is like most of the others.
    """

    def told(node: np.ndarray, fp: np.ndarray, size: np.ndarray, sketches: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.diff(np.append(starts, len(node)))
        b, a = BKForest(fp, starts).within(fp, np.repeat(starts, count), radius)
        a, b = a[a < b], b[a < b]
        fit = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
        a, b = a[fit], b[fit]
        near = np.concatenate([np.zeros(0), *(_likeness(sketches[a[k : k + 16384]], sketches[b[k : k + 16384]]) for k in range(0, len(a), 16384))])
        ok = near >= similarity - DOUBT
        a, b, near = a[ok], b[ok], near[ok]
        keep, middle = np.zeros(len(a), dtype=bool), np.zeros(len(node), dtype=bool)
        if len(a):
            keep[spanning_pairs(len(node), a, b, near)] = True
            total, group = np.bincount(a, near, len(node)) + np.bincount(b, near, len(node)), np.repeat(np.arange(len(starts)), count)
            at = np.flatnonzero(total == np.maximum.reduceat(total, starts)[group])
            middle[at[np.unique(group[at], return_index=True)[1]]] = True
            keep |= middle[a] | middle[b]
        return node[a[keep]], node[b[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, 2):
            node, fp, size = (table.column(k).to_numpy() for k in (2, 3, 4))
            fp, size, sketches = fp.view("<u8"), size.astype(float), _sketches(table.column(5).combine_chunks())
            ends = np.append(starts[1:], len(node))
            work = np.cumsum((ends - starts) ** 2) // PAIRS_AT_ONCE
            for k in np.unique(work):
                own = np.flatnonzero(work == k)
                lo, hi = starts[own[0]], ends[own[-1]]
                a, b = told(node[lo:hi], fp[lo:hi], size[lo:hi], sketches[lo:hi], starts[own] - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


SETS = "node long, size int, sketch binary, shingles array<long>"


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of texts that aren't empty, and sketches of them."""
    for whole in batches:
        for start in range(0, whole.num_rows, 512):  # what a worker once held it keeps
            batch = whole.slice(start, 512)
            sets = [np.unique(shingle_hashes(t.as_buffer().to_pybytes())) for t in batch.column(1)]
            size = np.array([len(x) for x in sets])
            sketches = [((smallest(x, slice(BANDS * BAND_ROWS, None)) >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes() for x in sets]
            ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view("<i8")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(sketches, pa.binary()), lists.cast(pa.list_(pa.int64()))], names=[c.split(" ")[0] for c in SETS.split(", ")])


def unlinked_pairs(sets: list[np.ndarray], label: np.ndarray, part: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Pairs of similar sets that connect what isn't connected yet, found by comparing all sets of different labels.

    Sets of one part aren't compared. No set is empty.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    at = np.append(0, np.cumsum(size))
    words, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ids = ids.astype(np.int32)
    label, part, held = np.unique(label[order], return_inverse=True)[1], part[order], np.zeros(len(words), dtype=np.int32)
    a, b = [], []
    for i in range(len(order) - 1):
        # the others are as large or larger: their likeness is at most the quotient of the sizes
        end = i + 1 + np.count_nonzero(size[i] / size[i + 1 :] >= similarity)
        others = np.arange(i + 1, end)[(label[i + 1 : end] != label[i]) & (part[i + 1 : end] != part[i])]
        if not len(others):
            continue
        held[ids[at[i] : at[i + 1]]] = 1
        theirs = np.concatenate([ids[at[j] : at[j + 1]] for j in others])
        shared = np.add.reduceat(held[theirs], np.append(0, np.cumsum(size[others])[:-1]))
        held[ids[at[i] : at[i + 1]]] = 0
        for j in others[shared / (size[i] + size[others] - shared) >= similarity]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(int(order[i])), b.append(int(order[j]))
    return a, b


SUSPECTS = "key long, p long, q long, node long, root long, side int, other long"
#: A group with at most so many suspected pairs names them one by one: texts share several shards, and a pair named in
#: each of them is compared once. A group with more is compared as a group.
FEW = 64


def _suspects(similarity: float):
    """Of rows (key, p, q, node, root, side, size, sketch): those that may be similar to one of the other side and
    another root, with no ``other``; or, of groups with few such pairs, the pairs (node, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SUSPECTS.split(", ")]
        for table, starts in _whole_groups(batches, 3):
            node, root, side, size = (table.column(k).to_numpy() for k in (3, 4, 5, 6))
            sketches = _sketches(table.column(7).combine_chunks())
            rows, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            alone = []
            for lo, hi in zip(starts, np.append(starts[1:], len(root)), strict=True):
                x, y = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
                found = []
                for i in y:
                    small, large = np.minimum(size[x], size[i]), np.maximum(size[x], size[i])
                    near = x[(root[x] != root[i]) & (small >= similarity * large)]
                    if len(near):
                        near = near[_likeness(sketches[near], sketches[i][None, :]) >= similarity - DOUBT]
                        found.append((i, near))
                if sum(len(near) for _, near in found) <= FEW:
                    for i, near in found:
                        rows.append(np.full(len(near), i)), other.append(node[near])
                else:
                    alone.append(np.unique(np.concatenate([np.append(near, i) for i, near in found if len(near)])))
            at, group = np.concatenate(rows), np.concatenate([np.zeros(0, np.int64), *alone])
            with_other = pa.concat_arrays([pa.array(np.concatenate(other), pa.int64()), pa.nulls(len(group), pa.int64())])
            told = table.select(range(6)).take(pa.array(np.concatenate([at, group]))).append_column("other", with_other)
            yield from told.rename_columns(names).combine_chunks().to_batches()

    return run


def _similar_in_full(similarity: float):
    """Links between the two sides of each group of rows (key, p, q, node, root, side, shingles); groups are together."""

    def told(group: list) -> pa.RecordBatch:
        node, root, side = (np.array([r[c] for r in group]) for c in range(3))
        a, b = unlinked_pairs([r[3] for r in group], root, side, similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []  # a group's rows follow each other, over batches too
        for batch in batches:
            key, p, q, node, root, side = (batch.column(c).to_numpy() for c in range(6))
            lists = batch.column(6)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k in range(batch.num_rows):
                name = (key[k], p[k], q[k])
                if name != last:
                    if len(group) > 1:
                        yield told(group)
                    last, group = name, []
                group.append((node[k], root[k], side[k], flat[ends[k] : ends[k + 1]].copy()))
        if len(group) > 1:
            yield told(group)

    return run


def _part(of: str) -> Column:
    """The part of its shard that a node is dealt to, of as many as ``of`` says."""
    return F.pmod(F.xxhash64("key", "node"), F.col(of))


def similar_groups(ws: Workspace, docs: DataFrame, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, part: int = PART, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(node, component_id): for each distinct text, by its xxhash64, the smallest doc_id of its group.

    Equal texts are one. Different texts link when at least ``similarity`` of their distinct five-word shingles are
    common to both. Shards hold the texts that agree in a band of smallest hashes (see BANDS). Links are found in three
    steps, and each pair that is taken for one has been compared in full:

    - In each part of a shard a BK-tree finds the fingerprints within the radius; of those that sketches don't rule out,
      pairs that connect them are compared.
    - Where a shard's texts aren't all connected, those outside its largest group are compared with the text of the
      shard that has most links.
    - What is still apart in a shard, and not ruled out by sketches, is compared pair by pair, whatever its fingerprints:
      each text outside the largest group with every text of another group.

    So groups of copies cost in proportion to their size; work in the square of a shard is left only for texts that
    look similar and aren't. Null texts are empty; texts without words link with nothing but their equals. Null doc_ids
    name no group. An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    classes = ws.save(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).withColumnRenamed("node", "of"), "texts")
    told = ws.save(rows.select("node", F.col("text").cast("binary")).mapInArrow(_describe, DESCRIBED), "described")
    # shards of two texts or more; copies of a text have the same keys
    keyed = told.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high").select("k", "n")
    shared = ws.save(shared, "shared-keys")
    keyed = ws.save(keyed.where(Sieve(shared, shared.count(), "k").may_hold(F.col("key"))), "keyed")
    members = split_join(keyed, shared, ("key", "k"), "n", told.count() * BANDS).select("key", "node").distinct()
    members = ws.save(members, "members")
    ends = ws.save(members.select(F.col("node").alias("end")).distinct(), "ends")
    # few texts are in a shard: only those are dealt out
    full = rows.select("node", "text").where(Sieve(ends, ends.count(), "end").may_hold(F.col("node"))).dropDuplicates(["node"])
    full = full.join(ends, F.col("node") == F.col("end"))
    full = ws.save(full.select("node", F.col("text").cast("binary")).mapInArrow(_shingle_sets, SETS), "shingles")
    payload = full.select(F.col("node").alias("of"), "size", "sketch")
    prints = ws.save(told.select("node", "fp").distinct().join(ends, F.col("node") == F.col("end")).select(F.col("node").alias("name"), "fp"), "prints")

    total = members.count()
    sizes = ws.save(members.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")), "shard-sizes")
    dealt = split_join(members, sizes, ("key", "k"), "n", total).withColumn("parts", F.ceil(F.col("n") / part)).withColumn("part", _part("parts"))
    dealt = dealt.join(payload, F.col("node") == F.col("of")).join(prints, F.col("node") == F.col("name"))
    groups = dealt.select("key", "part", "node", "fp", "size", "sketch").repartition("key", "part").sortWithinPartitions("key", "part")
    pairs = ws.save(groups.mapInArrow(_candidates(radius, similarity), "a long, b long").distinct(), "pairs")
    links = ws.save(_compared(pairs, full, similarity), "links")
    roots = connected_components(ws, links, "linked").select(F.col("node").alias("r"), "root")
    held = members.join(roots, F.col("node") == F.col("r"), "left").withColumn("root", F.coalesce("root", "node"))
    held = ws.save(held.join(payload.select("of", "size"), F.col("node") == F.col("of")).select("key", "node", "root", "size"), "held")

    # shards that aren't one group: the largest group, and the text with most links
    degree = links.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("degree"))
    weights = held.join(degree, F.col("node") == F.col("end"), "left").groupBy("key", "root")
    hub = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node", "root")
    weights = weights.agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.max(hub).alias("hub"))
    apart = weights.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "root")).alias("main"), F.max("hub").alias("hub")).where("roots > 1")
    parts = lambda n, w: F.ceil(F.greatest(n / part, w / part_shingles))
    apart = apart.select("k", "n", "hub", F.col("main.root").alias("main"), parts(F.col("n"), F.col("w")).alias("ps"), parts(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("qs"))
    apart = ws.save(apart, "apart")
    open_ = ws.save(split_join(held, apart, ("key", "k"), "n", total).drop("k", "n"), "open")
    stars = open_.where("root <> main and root <> hub.root and hub.degree > 0").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    stars = ws.save(_compared(ws.save(stars, "stars"), full, similarity), "star-links")
    # labels that the stars make equal; equal labels are connected, and that is all they have to tell
    where = roots.withColumnRenamed("root", "at")
    met = stars.join(where, F.col("a") == F.col("r"), "left").withColumn("x", F.coalesce("at", "a")).drop("r", "at")
    met = met.join(where, F.col("b") == F.col("r"), "left").withColumn("y", F.coalesce("at", "b")).select(F.greatest("x", "y").alias("from"), F.least("x", "y").alias("to")).where("from <> to")
    met = ws.save(met.groupBy("from").agg(F.min("to").alias("to")), "met")
    label = lambda df, c: df.join(met, F.col(c) == F.col("from"), "left").withColumn(c, F.coalesce("to", c)).drop("from", "to")
    open_ = ws.save(label(label(open_.drop("size", "hub"), "root"), "main"), "labelled")
    still = open_.where("root <> main").groupBy(F.col("key").alias("k")).agg(F.count("*").alias("lone"))
    both = open_.join(still, F.col("key") == F.col("k")).join(payload, F.col("node") == F.col("of")).select("key", "node", "root", "size", "sketch", "main", "ps", "qs")
    all_ = both.withColumn("side", F.lit(0)).withColumn("p", _part("ps")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)))
    lone = both.where("root <> main").withColumn("side", F.lit(1)).withColumn("q", _part("qs")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ps") - 1)))
    groups = all_.unionByName(lone).select("key", "p", "q", "node", "root", "side", "size", "sketch").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    found = ws.save(groups.mapInArrow(_suspects(similarity), SUSPECTS), "suspects")
    # pairs that were compared before aren't again
    one_by_one = found.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    one_by_one = ws.save(one_by_one, "one-by-one")
    more = ws.save(_compared(one_by_one, full, similarity), "pair-links")
    rest = found.where("other is null").drop("other")
    rest = rest.join(_sets_of(rest, rest.count(), "node", full), F.col("node") == F.col("of")).select("key", "p", "q", "node", "root", "side", "shingles")
    rest = rest.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    rest = ws.save(rest.mapInArrow(_similar_in_full(similarity), "a long, b long"), "group-links")
    roots = connected_components(ws, links.union(stars).union(more).union(rest), "similar")
    return _named(ws, classes, roots, "of").select(F.col("of").alias("node"), "component_id", "copies")


def _sets_of(rows: DataFrame, count: int, node: str, full: DataFrame) -> DataFrame:
    """(of, shingles) of the nodes of ``rows``, ``count`` rows, and of a few others: ``full`` without what a join drops."""
    return full.where(Sieve(rows, count, node).may_hold(F.col("node"))).select(F.col("node").alias("of"), "shingles")


def _compared(pairs: DataFrame, full: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), each of two nodes and named once, whose texts are similar.

    Only the sets of the pairs' ends travel, whatever the tables' sizes: once each, and once for each pair. ``pairs`` is
    read twice.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("end"))
    met = ends.join(_sets_of(ends, 2 * pairs.count(), "end", full), F.col("end") == F.col("of"))
    both = met.select("a", "b", "shingles").repartition("a", "b").groupBy("a", "b").agg(F.collect_list("shingles").alias("sets")).where(F.size("sets") == 2)
    x, y = F.col("sets")[0], F.col("sets")[1]
    shared = F.size(F.array_intersect(x, y))
    return both.where(shared / (F.size(x) + F.size(y) - shared) >= similarity).select("a", "b")


def keep_one_similar(ws: Workspace, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of similar texts is kept: the one with the smallest doc_id.

    Rows with a null doc_id stay, as do rows that repeat a kept doc_id with the same text. What goes are (doc_id, text)
    pairs, told by ids and hashes; columns keep their names, whatever those are. An empty table gives an empty table.
    Texts of which a filter tells that they stay aren't moved. Of the run's tables the one of rows that go is left.
    """
    groups = similar_groups(ws, docs, similarity)
    node = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), node.alias("node")).where("id is not null").distinct()
    ids = ws.save(ids, "ids")
    told = split_join(ids, groups.withColumnRenamed("node", "of"), ("node", "of"), "copies", ids.count())
    gone = ws.save(told.where("id <> component_id").select("id", "node"), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("row_id"), node.alias("row_node"))
    may_go = Sieve(gone, gone.count(), "id", "node").may_hold(F.col("row_id"), F.col("row_node"))
    ws.keep_only("gone")
    held = rows.where(may_go).join(gone, (F.col("row_id") == F.col("id")) & (F.col("row_node") == F.col("node")), "left_anti")
    kept = rows.where(~may_go).union(held)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
