"""Token ids as Parquet list columns.

Documents are dealt by ranges of doc_id, and each range becomes one file whose rows ascend by doc_id: the files in name
order hold all ids in one sequence. Row groups are cut by a number of ids, ids are dictionary- or delta-encoded, and page
indexes let a reader of a few documents skip the pages of the others. Metadata (doc_id, n_tokens, where the ids start in
the file) stands in columns of its own, which can be read without the ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.bpe import Encoder, Vocabulary, runs
from pagewright.llm.files import Whole
from pagewright.workspace import Workspace, ship

END_ID = 0
#: Ids in a row group, about: bounds the memory of writers and readers.
GROUP_IDS = 4_000_000
SCHEMA = pa.schema([pa.field("doc_id", pa.int64()), pa.field("start_in_file", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.field("element", pa.int32(), nullable=False)))])
MANIFEST = "part int, path string, n_docs long, n_tokens long"


#: New words that the library is given at once.
WORDS_AT_ONCE = 50_000


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """Distinct words are encoded by the tokenizers library; byte-level BPE never merges across words."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def words(new: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        new, ids, count = new.cast(pa.string()), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for start in range(0, len(new), WORDS_AT_ONCE):
            some = new.slice(start, WORDS_AT_ONCE).to_pylist()
            found = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, dtype=np.int32))
            count.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(count)

    return Encoder(Vocabulary(path), encode_words=words)


def _with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents with ``end_id`` after each, and the numbers of ids with it."""
    count = count + 1
    ends = np.cumsum(count)
    out, inner = np.empty(len(ids) + len(count), np.int32), np.ones(len(ids) + len(count), dtype=bool)
    inner[ends - 1] = False
    out[inner], out[ends - 1] = ids, end_id
    return out, count


def _write(path: str, folder: str, encoding: str, group_ids: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.parquet"
        enc = library_encoder(path)
        options = {"use_dictionary": ["ids.list.element"]} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED"}}
        docs, total, held, size = 0, 0, [], 0
        with Whole(name) as out, pq.ParquetWriter(out, SCHEMA, compression="zstd", write_page_index=True, data_page_size=1 << 18, dictionary_pagesize_limit=1 << 20, **options) as writer:

            def flush():
                if held:
                    writer.write_table(pa.Table.from_batches(held, SCHEMA), row_group_size=1 << 40)
                    held.clear()

            for batch in batches:
                for lo, hi, texts in runs(batch):
                    ids, count = _with_end(*enc.batch(texts), end_id)
                    ends = np.cumsum(count)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids), type=SCHEMA.field("ids").type)
                    held.append(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total + ends - count), pa.array(count), lists], schema=SCHEMA))
                    docs, total, size = docs + hi - lo, total + len(ids), size + len(ids)
                    if size >= group_ids:
                        flush()
                        size = 0
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return run


def write_tokens(ws: Workspace, docs: DataFrame, path: str, partitions: int | None = None, encoding: str = "dictionary", group_ids: int = GROUP_IDS, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files ordered by doc_id; returns the manifest, a row for each file.

    Null and empty texts give the end id alone. Rows of one doc_id follow each other in the order of their texts; null
    doc_ids come first. Other columns are ignored. An empty table gives files without rows. ``encoding``: "dictionary"
    or "delta".
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = partitions or max(1, rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ws.save(dealt.mapInArrow(_write(path, ws.path("tokens"), encoding, group_ids, end_id), MANIFEST), "manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids) as the files hold them; start counts the ids of all documents before.

    Filters on doc_id and the choice of columns reach the files. The manifest is a row for each file; files that it
    doesn't name, which a lost executor may leave, are not read.
    """
    paths = [r["path"] for r in manifest.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "part int, doc_id long, start long, n_tokens long, ids array<int>")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = manifest.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = spark.read.parquet(*paths).select(part.alias("part"), "doc_id", "start_in_file", "n_tokens", "ids")
    return rows.join(offset, "part").select("part", "doc_id", (F.col("start_in_file") + F.col("offset")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what :func:`read_tokens` returns."""
    ship(tokens.sparkSession)
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
