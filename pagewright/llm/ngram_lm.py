"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of bigrams, unigrams and a uniform floor are mixed; how much each counts depends on how often
the context occurred, in buckets of powers of two. The mixture weights are learned by expectation-maximisation on a slice
of the training documents against the counts of the others; the scores then use the counts of all training documents.

N-grams are 64-bit hashes. Documents are dealt to blocks by a hash of id and text, so a block is the same documents
however often and wherever the table is read. A block asks for the counts of its own distinct n-grams: packed key arrays
go to the reducers by key range, summed counts come back in the same order. So a frequent n-gram is one entry a block,
nothing is broadcast but the totals, and no table of all n-grams is in one place. Counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.workspace import Workspace, ship

START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The remainder of crc32(doc_id) mod FOLDS that is held out, and the one that the weights are learned on.
FOLDS, HELD_OUT, SLICE = 10, 0, 1
SLICE_KIND = 1
BUCKETS = 32
#: Bytes of the table in a block, and in a key range of the reducers, about: bound the memory of a task.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 4 << 20
#: Steps of log10 probability to which the learning of weights rounds: bounds what the driver gathers.
GRID = 20
REQUEST = "block long, kind int, ord int, bucket int, keys binary, counts binary"
REPLY = "block long, ord int, bucket int, width int, total binary, part binary, v long, n long, n_part long"


# ---------------------------------------------------------------------------------------------- tokens of a block


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); A-Z lower-cased, words between ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.append(0, np.cumsum(full))
    count = np.diff(upto[offsets - offsets[0]])
    words = flat.filter(pa.array(full)).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer().to_pybytes(), 42) for w in words.dictionary), dtype=np.uint64, count=len(words.dictionary))
    return known[words.indices.to_numpy().astype(np.int64)] if len(words) else np.zeros(0, np.uint64), count


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0xBF58476D1CE4E5B9) + b
        x ^= x >> np.uint64(30)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


class Grams:
    """The token sequence of a block: for each token its key, its context's and its bigram's."""

    def __init__(self, texts: pa.Array):
        words, count = tokens(texts)
        self.length = count + 1
        ends = np.cumsum(self.length)
        n = int(ends[-1]) if len(ends) else 0
        self.first = ends - self.length
        last = np.zeros(n, dtype=bool)
        last[ends - 1] = True
        self.token = np.empty(n, dtype=np.uint64)
        self.token[~last], self.token[last] = words, END
        self.context = np.empty(n, dtype=np.uint64)
        self.context[1:] = self.token[:-1]
        self.context[self.first] = START
        self.opening = np.zeros(n, dtype=bool)
        self.opening[self.first] = True
        self.pair = _mix(self.context, self.token)


def _packed(block: int, kind: int, order: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
    cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
    for bucket, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if hi > lo:
            yield block, kind, order, bucket, keys[lo:hi].tobytes(), counts[lo:hi].astype("<u4").tobytes()


def _request(bits: int):
    """What a block, a group of rows (block, kind, text), asks for."""

    def run(table: pa.Table) -> pa.Table:
        block, kinds = table.column("block")[0].as_py(), table.column("kind").to_numpy()
        grams, rows = Grams(table.column("text").combine_chunks()), []
        counted = np.repeat(kinds != 0, grams.length)
        for order, keys in ((1, grams.token), (2, grams.pair)):
            at = np.argsort(keys, kind="stable")
            keys = keys[at]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.add.reduceat(counted[at].astype(np.uint32), first)
            rows += _packed(block, int(kinds[0] == 1), order, keys[first], counts, bits)
        return pa.Table.from_batches([_batch(rows, REQUEST)])

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _sum(table: pa.Table) -> pa.Table:
    """Totals of one order's key range, for each block that asks."""
    order, bucket = table.column("ord")[0].as_py(), table.column("bucket")[0].as_py()
    blocks, kinds = table.column("block").to_pylist(), table.column("kind").to_pylist()
    keys = [np.frombuffer(k.as_buffer(), "<u8") for k in table.column("keys")]
    counts = np.concatenate([np.frombuffer(c.as_buffer(), "<u4") for c in table.column("counts")])
    size = np.array([len(k) for k in keys])
    ends = np.cumsum(size)
    keys = np.concatenate(keys)
    at = np.argsort(keys, kind="stable")
    keys = keys[at]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    width = np.diff(np.append(first, len(keys)))

    def sums(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of each distinct key, the same at every entry)."""
        each = np.add.reduceat(counts[at], first, dtype=np.uint64)
        back = np.empty(len(at), dtype="<u4" if not len(each) or each.max() < 1 << 32 else "<u8")
        back[at] = np.repeat(each, width)
        return each, back

    total, totals = sums(counts)
    part, parts = sums(counts * np.repeat(np.array(kinds) == 1, size))
    rows = [(-1, order, bucket, 0, None, None, int((total > 0).sum()), int(total.sum(dtype=np.int64)), int(part.sum(dtype=np.int64)))]
    for block, kind, hi, n in zip(blocks, kinds, ends, size, strict=True):
        own = parts[hi - n : hi].astype(totals.dtype).tobytes() if kind else None
        rows.append((block, order, bucket, totals.itemsize, totals[hi - n : hi].tobytes(), own, 0, 0, 0))
    return pa.Table.from_batches([_batch(rows, REPLY)])


# ---------------------------------------------------------------------------------------------- probabilities


def _bucket(context: np.ndarray) -> np.ndarray:
    """By how often a context occurred: never, once, 2-3, 4-7 and so on."""
    return np.minimum(np.ceil(np.log2(np.maximum(context, 0) + 1.0)), BUCKETS - 1).astype(np.int64)


def _counts(grams: Grams, replies: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each token and of each bigram; replies are in key order."""
    out = []
    for order, keys in ((1, grams.token), (2, grams.pair)):
        own = replies.filter(pc.equal(replies.column("ord"), order)).sort_by("bucket")
        values = np.concatenate([np.frombuffer(x.as_buffer(), f"<u{w}") for x, w in zip(own.column(column), own.column("width").to_pylist(), strict=True)] or [np.zeros(0, "<u4")])
        out.append(values[np.unique(keys, return_inverse=True)[1]].astype(np.float64))
    return out[0], out[1]


def _context_counts(grams: Grams, c1: np.ndarray, starts: float) -> np.ndarray:
    context = np.empty(len(c1))
    context[1:] = c1[:-1]
    context[grams.opening] = starts
    return context


def _grid(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(GRID * np.log10(np.where(p > 0, p, 1.0))), 1).astype(np.int64)


def _evidence(n: int, starts: int):
    """Of a slice block: (bucket, p2, p1 on the grid, tokens), from the counts without the slice."""

    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["bucket", "p2", "p1", "n"]
        if not docs.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in names})
        grams = Grams(docs.column("text").combine_chunks())
        t1, t2 = _counts(grams, replies, "total")
        s1, s2 = _counts(grams, replies, "part")
        c1, c2 = t1 - s1, t2 - s2
        context = _context_counts(grams, c1, starts)
        rows = np.stack([_bucket(context), _grid(c2 / np.maximum(context, 1)), _grid(c1 / max(n, 1))], axis=1)
        rows, count = np.unique(rows, axis=0, return_counts=True)
        return pa.table(dict(zip(names, [*(pa.array(c) for c in rows.T), pa.array(count)], strict=True)))

    return run


def learn_weights(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Mixture weights [bucket, (bigram, unigram, floor)] by expectation-maximisation."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0, 0.8, 0.2]
    for _ in range(rounds):
        parts = weights[bucket] * np.stack([p2, p1, np.full(len(p1), p0)], axis=1)
        parts *= (n / np.maximum(parts.sum(axis=1), 1e-300))[:, None]
        seen = np.stack([np.bincount(bucket, c, BUCKETS) for c in parts.T], axis=1)
        # a token of each kind by default keeps every weight above zero where there is little evidence
        seen = seen + np.array([0.4, 0.5, 0.1])
        seen[0, 0] = 0
        weights = seen / seen.sum(axis=1, keepdims=True)
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(weights: np.ndarray, n: int, v: int, starts: int):
    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_batches([_batch([], SCORES)])
        grams = Grams(docs.column("text").combine_chunks())
        c1, c2 = _counts(grams, replies, "total")
        context = _context_counts(grams, c1, starts)
        w = weights[_bucket(context)]
        p = w[:, 0] * c2 / np.maximum(context, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
        total = lambda x: np.add.reduceat(x, grams.first)
        base = np.log10((c1 + 0.1) / (n + 0.1 * (v + 1)))
        kind = docs.column("kind").to_numpy()
        columns = [docs.column("doc_id").combine_chunks(), pa.array(kind == 0), pa.array(grams.length), pa.array(total((c1 > 0).astype(np.int64))), pa.array(np.full(len(kind), n, np.int64)), pa.array(total(base)), pa.array(total(np.log10(p)))]
        return pa.table(dict(zip([f.split(" ")[0] for f in SCORES.split(", ")], columns, strict=True)))

    return run


class Model:
    """A model of ``docs(doc_id, text)``, and the scores of the same documents.

    ``docs`` is read more than once and must give the same rows each time: a table, or what ``ws.save`` returns; how it
    is cut into partitions doesn't matter. A document's id as text (null: none) decides by its CRC-32 modulo ``FOLDS`` if it is held out.
    Null and empty texts are one end token. Rows that repeat are documents of their own; other columns are ignored; an
    empty table gives an empty table.
    """

    def __init__(self, ws: Workspace, docs: DataFrame):
        ship(docs.sparkSession)
        fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
        kind = F.when(fold == HELD_OUT, 0).when(fold == SLICE, SLICE_KIND).otherwise(2)
        # blocks of about BLOCK_BYTES; the slice's documents are blocks of their own. Scores don't depend on their number
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 50:  # no table: Spark knows no size
            size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        blocks = max(1, -(-size // BLOCK_BYTES))
        slice_blocks = max(1, -(-blocks // FOLDS))
        of = lambda n: F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
        block = F.when(kind == SLICE_KIND, of(slice_blocks) + blocks).otherwise(of(blocks)).cast("long")
        self.docs = docs.select(block.alias("block"), kind.alias("kind"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
        bits = max(5, (size // RANGE_BYTES).bit_length())
        requests = self.docs.select("block", "kind", "text").groupBy("block").applyInArrow(_request(bits), REQUEST)
        self.replies = ws.save(requests.groupBy("ord", "bucket").applyInArrow(_sum, REPLY), "counts")
        sums = self.replies.where("block = -1 and ord = 1").agg(F.sum("v"), F.sum("n"), F.sum("n_part")).first()
        self.v, self.n, n_part = (x or 0 for x in sums)
        starts = {r["kind"]: r["n"] for r in docs.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).collect()}
        self.starts = starts.get(1, 0) + starts.get(2, 0)
        evidence = self._blocks(True, _evidence(self.n - n_part, starts.get(2, 0)), "bucket long, p2 long, p1 long, n long")
        seen = evidence.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).toPandas().to_numpy(dtype=np.float64).reshape(-1, 4)
        value = lambda q: np.where(q > 0, 0.0, 10 ** (q / GRID))
        self.weights = learn_weights(seen[:, 0].astype(np.int64), value(seen[:, 1]), value(seen[:, 2]), 1 / (self.v + 1), seen[:, 3])

    def _blocks(self, em: bool | None, run, schema: str) -> DataFrame:
        docs, replies = self.docs, self.replies.where("block >= 0").select("block", "ord", "bucket", "width", "total", "part")
        if em:
            docs, replies = docs.where("kind = 1"), replies.where("part is not null")
        return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)

    def scores(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document."""
        return self._blocks(None, _score(self.weights, self.n, self.v, self.starts), SCORES)
