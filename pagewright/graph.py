"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.workspace import Workspace

EDGE = "a long, b long"
#: A key is hot if it has more than this share of all rows, and more than a few: there are fewer than HOT_SHARE such keys.
HOT_SHARE, HOT_LEAST = 4096, 64


def min_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and for each the smallest node it is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the smallest node of each local component, batch by batch."""
    for batch in batches:
        if batch.num_rows:
            nodes, root = min_labels(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            keep = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])


def split_join(left: DataFrame, right: DataFrame, on: tuple[str, str], count: str, total: int) -> DataFrame:
    """``left`` and ``right`` joined on the columns ``on``, no key's rows being one task's work; left rows without a
    partner go.

    ``right`` has a row for each key, and in ``count`` how many of the ``total`` rows of ``left`` have it, or more. Keys
    with more than a 4096th of all rows are fewer than 4096, so they are broadcast and their rows stay where they are;
    the others are dealt by key. Both frames are read more than once.
    """
    bar = max(HOT_LEAST, total // HOT_SHARE)
    hot, rest = right.where(F.col(count) > bar), right.where(F.col(count) <= bar)
    same = F.col(on[0]) == F.col(on[1])
    cool = left.join(F.broadcast(hot.select(F.col(on[1]).alias("__hot"))), F.col(on[0]) == F.col("__hot"), "left_anti")
    return left.join(F.broadcast(hot), same).union(cool.join(rest, same))


def _with_least(ws: Workspace, pairs: DataFrame, total: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(a, b, m): each pair, and the smallest b of its a; and (u, m, n): the same for each a, with its number of pairs."""
    low = ws.save(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "u"), name)
    return split_join(pairs, low, ("a", "u"), "n", total).select("a", "b", "m"), low


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the smallest node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al. 2014): neighbours are only ever aggregated to their
    minimum, which hubs get by a broadcast of bounded size (:func:`split_join`), and the number of edges never grows.
    Null ends and loops are left out; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b").mapInArrow(_contract, EDGE).distinct()
    edges = ws.save(edges, f"{name}-0")
    total, mark, step = edges.count(), None, 0
    if not total:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, _ = _with_least(ws, both, 2 * total, f"{name}-low-{step}")
        large = large.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = ws.save(large, f"{name}-large-{step}")
        tied, low = _with_least(ws, large, total, f"{name}-least-{step}")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.union(low.select("u", "m")).where("a <> b").distinct()
        new = ws.save(new, f"{name}-{step + 1}")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        for part in (f"{name}-low-{step}", f"{name}-large-{step}", f"{name}-least-{step}", f"{name}-{step}"):
            ws.drop(part)
        step += 1
        if tuple(seen) == mark:
            break
        mark, edges, total = tuple(seen), new, seen[0]
    roots = new.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
