"""WARC archives as seekable Zstandard bundles.

An archive is a run of independent Zstandard frames, each with as many whole records as fit into ``FRAME_BYTES``, and a
skippable frame with the seek table: compressed and raw size of every frame, as the seekable format lays it out. Any
Zstandard tool reads it from front to back; a reader with the index goes to a frame and to a record's place in it.
Records with equal payloads are stored once; the others are revisits that name the response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.files import Whole, filesystem
from pagewright.workspace import Workspace, ship

FRAME_BYTES = 1 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, archive string, frame int, frame_start long, offset long, length long, raw_size long"


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}/{key}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC header, HTTP header, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    header = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(header["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return header, http, payload


class Writer:
    """Appends records to a stream, frame by frame, and ends it with the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.position, self.frames = [], 0, 0, []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame's raw bytes, length) of the record."""
        if self.held and self.size + len(data) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> list[tuple[int, int]]:
        """Writes the footer; returns where each frame starts and its raw size."""
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        starts, at = [], 0
        for packed, raw in self.frames:
            starts.append((at, raw))
            at += packed
        return starts


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the footer."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the archive has no seek table")
    file.seek(size - 9 - 8 * count)
    entries = struct.unpack(f"<{2 * count}I", file.read(8 * count))
    frames, at = [], 0
    for packed, raw in zip(entries[::2], entries[1::2], strict=True):
        frames.append((at, packed, raw))
        at += packed
    return frames


def _write(folder: str, frame_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        rows = []
        with Whole(name) as out:
            writer = Writer(out, frame_bytes)
            for batch in batches:
                for page, url, html, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = html or b""
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    rows.append((page, *writer.add(record(page, url, payload, digest, first, page is not None and first is not None and page != first, date))))
            starts = writer.close()
        for lo in range(0, len(rows), 10_000):
            page, frame, offset, length = zip(*rows[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(page, pa.int64()), pa.array([name] * len(page)), pa.array(frame, pa.int32()), pa.array([starts[f][0] for f in frame], pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array([starts[f][1] for f in frame], pa.int64())],
                names=["page_id", "archive", "frame", "frame_start", "offset", "length", "raw_size"],
            )

    return run


def write_archives(ws: Workspace, pages: DataFrame, frame_bytes: int = FRAME_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; returns the index, a row for each record.

    Of equal payloads the one with the largest page_id is a response and the others are revisits of it; a null page is
    an empty payload, which counts like any other. Rows that repeat a response are responses. Rows with a null page_id
    are responses, and refer to none. Null urls have no target. An empty table gives archives without records.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.coalesce("html", F.lit(b""))))
    last = rows.groupBy("sha1").agg(F.max("page_id").alias("response_id"))
    last = ws.save(last, "responses")
    rows = rows.join(last.withColumnRenamed("sha1", "digest"), F.col("sha1") == F.col("digest")).select("page_id", "url", "html", "sha1", "response_id")
    return ws.save(rows.mapInArrow(_write(ws.path("archives"), frame_bytes, date), INDEX), "index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = filesystem(archive)
            out, held = [], 0
            with fs.open_input_file(path) as file:
                frames, at, raw = seek_table(file), -1, b""
                for e in sorted(entries, key=lambda e: (e["frame"], e["offset"])):
                    if e["frame"] != at:
                        at = e["frame"]
                        start, packed, size = frames[at]
                        file.seek(start)
                        raw = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
                    header, http, payload = parse_record(raw[e["offset"] : e["offset"] + e["length"]])
                    full = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                    if header["warc-type"] == "response" and (len(payload) != full or _digest(payload) != header["warc-payload-digest"]):
                        raise ValueError(f"{archive}: frame {at} at {e['offset']}: the payload isn't what its record says")
                    page, refers = header.get("warc-page-id"), header.get("warc-refers-to-page-id")
                    out.append((page and int(page), header.get("warc-target-uri"), header["warc-type"], header["warc-payload-digest"].removeprefix("sha1:"), full, refers and int(refers), payload if header["warc-type"] == "response" else None))
                    held += len(payload)
                    if held > FRAME_BYTES * 8:
                        yield _records(out)
                        out, held = [], 0
            if out:
                yield _records(out)


RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in RECORDS.split(", ")])


#: Bytes of records that a task reads at a time, about.
RUN_BYTES = 16 << 20


def read_records(index: DataFrame, run: int = RUN_BYTES) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of the index's records.

    Each archive's frames are found by its footer; only frames with wanted records are read, each once in a run of
    frames, and runs are dealt out by number: by the size of the index Spark would give them all to one task. A response
    whose payload hasn't the length and digest that its record tells is an error. Filter the index to read a few records;
    an empty index gives no rows. payload is null for revisits; payload_bytes is that of the full one.
    """
    ship(index.sparkSession)
    upto = F.sum("raw_size").over(Window.partitionBy("archive").orderBy("frame"))
    frames = index.groupBy("archive", "frame", "raw_size").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("own"))
    runs = frames.withColumn("run", F.floor((upto - 1) / run)).groupBy("archive", "run").agg(F.flatten(F.collect_list("own")).alias("entries"))
    n = index.select("archive", "frame", "raw_size").distinct().agg(F.coalesce(F.sum("raw_size"), F.lit(0))).first()[0] // run + 1
    return runs.repartition(n, "archive", "run").select("archive", "entries").mapInArrow(_read, RECORDS)


def read_pages(spark: SparkSession, index: DataFrame, page_ids: list[int]) -> DataFrame:
    """The records of a few pages."""
    return read_records(index.where(F.col("page_id").isin(page_ids)))
