"""Bloom filters: which rows can have a partner in another table, told before any row is moved for a join.

Rows are moved only when the filter of the other table's keys has theirs; the join itself then decides. A filter says
yes to every key it was built from, and to about one in 400 of the others, so a join loses nothing by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.udf import batch_udf
from pagewright.workspace import ship

#: Bits for a key, bits of a block as a power of two, and blocks at most (together 16 MB). A filter with more keys than
#: 16 MB hold well says yes to more of the others; their rows are moved for the join then, and dropped there.
KEY_BITS, BLOCK, MOST_BLOCKS = 16, 15, 1 << 12


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each hash, and its four places there."""
    h = h.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        more = h * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << BLOCK) - 1)
    parts = (h, h >> np.uint64(BLOCK), more >> np.uint64(64 - BLOCK), more >> np.uint64(64 - 2 * BLOCK))
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), [(x & low).astype(np.int64) for x in parts]


def _fill(blocks: int):
    """(block, bits) of the blocks that a task has; rows (block, h) of one block are in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, places = _places(batch.column(1).to_numpy(), blocks)
            order = np.argsort(block, kind="stable")
            names, first = np.unique(block[order], return_index=True)
            for name, own in zip(names.tolist(), np.split(order, first[1:]), strict=False):
                bits = held.setdefault(name, np.zeros(1 << BLOCK, dtype=bool))
                for at in places:
                    bits[at[own]] = True
        packed = [np.packbits(x).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], names=["block", "bits"])

    return run


def _hash(key: tuple[Column, ...]) -> Column:
    return F.xxhash64(F.lit("sieve"), *key)


class Sieve:
    """The filter of the keys ``key`` of ``rows``, at most ``count`` different ones."""

    def __init__(self, rows: DataFrame, count: int, *key: str):
        ship(rows.sparkSession)
        self.blocks = min(MOST_BLOCKS, max(1, -(-count * KEY_BITS >> BLOCK)))
        h = rows.select(_hash(tuple(F.col(k) for k in key)).alias("h"))
        dealt = h.select((F.shiftrightunsigned("h", 32) % self.blocks).alias("block"), "h").repartition("block")
        bits = np.zeros((self.blocks, (1 << BLOCK) // 8), dtype=np.uint8)
        for r in dealt.mapInArrow(_fill(self.blocks), "block long, bits binary").collect():  # the filter, no more
            bits[r.block] = np.frombuffer(r.bits, np.uint8)
        self.sent = rows.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def may_hold(self, *key: Column) -> Column:
        """False only for keys that aren't among the filter's."""
        sent, blocks = self.sent, self.blocks

        def found(h: pd.Series) -> pd.Series:
            block, places = _places(h.to_numpy(), blocks)
            yes = np.ones(len(block), dtype=bool)
            for at in places:
                at = (block << BLOCK) + at
                yes &= (sent.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            return pd.Series(yes)

        return batch_udf("boolean")(found)(_hash(key))
