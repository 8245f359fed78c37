"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points, the pivots, in order. Inverted lists hold for each label and pivot
the vectors that have the pivot among their nearest. Vectors of a list that share enough pivots are candidates; their
cosine decides. A pair is counted in the list of the smallest pivot it shares, so no pair is counted twice and none is
written out: a list returns how many links each vector has there, and one edge towards its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.graph import connected_components, min_labels
from pagewright.workspace import Workspace, ship

THRESHOLD = 0.93
#: Vectors, those with the smallest hashes, from which the pivots are chosen.
SAMPLE = 4096
PIVOTS, NEAREST, SHARED = 256, 10, 2
#: A longer list is dealt in parts of about this many rows; every two parts meet in one group.
PART_ROWS = 256
LINKS = "rep long, n long, root long"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def choose_pivots(vectors: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Unit pivots: random mixtures of pairs of sample vectors, which spread over the space that the vectors fill."""
    rng = np.random.default_rng(seed)
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    x = x - 0.5 * x.mean(axis=0)
    mixed = (x[rng.integers(0, len(x), (n, 3))] * rng.choice([-1.0, 1.0], (n, 3, 1))).sum(axis=1)
    mixed += 1e-6 * rng.standard_normal(mixed.shape)
    return mixed / np.linalg.norm(mixed, axis=1, keepdims=True)


def permutation_prefixes(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of each unit vector's nearest pivots, the nearest first."""
    likeness = x @ pivots.T
    top = np.argpartition(-likeness, min(nearest, len(pivots)) - 1, axis=1)[:, :nearest]
    order = np.argsort(-np.take_along_axis(likeness, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def _describe(pivots: np.ndarray, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            with np.errstate(over="ignore", invalid="ignore"):
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            top = permutation_prefixes(x, pivots, nearest).astype(np.int32)
            unit = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            prefix = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1]), pa.int32()), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unit, prefix], names=["rep", "label", "unit", "prefix"])

    return run


def _pairs(threshold: float, shared: int):
    """Links within one group of a list: of one part with itself, or of two parts with each other."""

    def run(table: pa.Table) -> pa.Table:
        rep, prefix, unit = table.column("rep").to_numpy(), _matrix(table.column("prefix")), _matrix(table.column("unit"))
        weight, part = table.column("copies").to_numpy(), table.column("part").to_numpy()
        pivot, one, two = (table.column(c)[0].as_py() for c in ("pivot", "one", "two"))
        order = np.argsort(rep, kind="stable")
        rep, prefix, unit, weight, part = rep[order], prefix[order], unit[order], weight[order], part[order]
        rows, cols = np.flatnonzero(part == one), np.flatnonzero(part == two)
        known, local = np.unique(prefix, return_inverse=True)
        has = np.zeros((len(rep), len(known)), dtype=np.float32)
        np.put_along_axis(has, local.reshape(prefix.shape), 1.0, axis=1)
        links, ends_a, ends_b = np.zeros(len(rep), dtype=np.int64), [], []
        for lo in range(0, len(rows), 128):
            own = rows[lo : lo + 128]
            candidate = has[own] @ has[cols].T >= shared
            if one == two:
                candidate &= own[:, None] < cols[None, :]
            if not candidate.any():
                continue
            a, b = np.nonzero(candidate)
            if len(a) > candidate.size // 8:
                ok = (unit[own] @ unit[cols].T)[a, b] >= threshold
            else:
                ok = np.einsum("ij,ij->i", unit[own[a]], unit[cols[b]]) >= threshold
            a, b = own[a[ok]], cols[b[ok]]
            if not len(a):
                continue
            common = (prefix[a][:, :, None] == prefix[b][:, None, :]).any(axis=2)
            smallest = np.where(common, prefix[a], np.iinfo(np.int32).max).min(axis=1)
            a, b = a[smallest == pivot], b[smallest == pivot]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            ends_a.append(a), ends_b.append(b)
        root = np.arange(len(rep))
        if ends_a:
            nodes, low = min_labels(np.concatenate(ends_a), np.concatenate(ends_b))
            root[nodes] = low
        there = links > 0
        return pa.table({"rep": pa.array(rep[there]), "n": pa.array(links[there]), "root": pa.array(rep[root[there]])})

    return run


def near_duplicates(ws: Workspace, vectors: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, part_rows: int = PART_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``.

    Vectors of one label link when their cosine is ``threshold`` or more. Null labels, null, empty and zero vectors and
    vectors with null or non-finite components link with nothing and are components of their own; so do vectors of
    different lengths. Equal vectors are looked up once and link with each other. Rows that repeat a vec_id and its
    vector count once as a link; a null vec_id links with nothing, in component null, not kept. Other columns are
    ignored; an empty table gives an empty table.
    """
    ship(vectors.sparkSession)
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("usable", usable)
    # vectors of another length are as another label
    sound = rows.where("usable").withColumn("group", F.concat_ws(":", F.size("x"), "label")).withColumn("h", F.xxhash64("x"))
    classes = sound.groupBy("group", "h", "x").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    classes = ws.save(classes, "classes")
    found = None
    lengths = [r[0] for r in classes.select(F.size("x")).distinct().collect()] if not classes.isEmpty() else []
    for length in sorted(lengths):
        own = classes.where(F.size("x") == length)
        sample = own.orderBy(F.xxhash64("h", "group"), "rep").limit(SAMPLE).select("x").toPandas()["x"]
        points = choose_pivots(np.stack([np.asarray(v, dtype=float) / np.abs(v).max() for v in sample]), pivots)
        found_here = _links(ws, own, points, threshold, nearest, shared, part_rows, f"{length}")
        found = found_here if found is None else found.union(found_here)
    if found is None:
        found = classes.select(F.col("rep"), F.lit(0).cast("long").alias("n"), F.col("rep").alias("root"))
    roots = connected_components(ws, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("group", "h", "x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    named = ws.save(named.select(F.col("group").alias("g"), F.col("h").alias("k"), F.col("x").alias("y"), "n_links", "component_id"), "named")
    linked = sound.join(named, (F.col("group") == F.col("g")) & (F.col("h") == F.col("k")) & (F.col("x") == F.col("y"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(ws: Workspace, classes: DataFrame, points: np.ndarray, threshold: float, nearest: int, shared: int, part_rows: int, name: str) -> DataFrame:
    described = classes.select("rep", "group", "x").mapInArrow(_describe(points, nearest), "rep long, label string, unit array<double>, prefix array<int>")
    described = described.join(classes.select(F.col("rep").alias("r"), "copies"), F.col("rep") == F.col("r")).select("rep", "label", "unit", "prefix", "copies")
    described = ws.save(described, f"described-{name}")
    lists = described.select("rep", "label", F.explode("prefix").alias("pivot"))
    parts = lists.groupBy("label", "pivot").agg(F.count("*").alias("size")).where("size > 1")
    parts = parts.select(F.col("label").alias("l"), F.col("pivot").alias("p"), F.ceil(F.col("size") / part_rows).alias("parts"))
    entries = described.withColumn("pivot", F.explode("prefix")).join(parts, (F.col("label") == F.col("l")) & (F.col("pivot") == F.col("p")))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    entries = entries.withColumn("other", other).withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other"))
    groups = entries.select("rep", "label", "unit", "prefix", "copies", "pivot", "part", "one", "two").groupBy("label", "pivot", "one", "two")
    return ws.save(groups.applyInArrow(_pairs(threshold, shared), LINKS), f"links-{name}")
