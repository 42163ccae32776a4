"""WARC records in seekable Zstandard bundles.

Each task groups its records into independent Zstandard frames and closes a
bundle at a bounded size with a seek table, a skippable frame that lists every
frame's compressed and decompressed size (the seekable format of the Zstandard
project). A bundle is thus a plain .warc.zst file to any reader, and a reader
with the table can decompress one frame alone. The index, a table, maps each
record to its bundle, frame and place in the frame.

Bundles are written under their final name only once whole, through the file
system that the folder's URI names. The name holds the attempt of the task, so
that one that runs again, or late beside another, leaves the other's bundles as
they are: its rows may come in another order after a shuffle. The index lists
the bundles that count.

Of records with equal payloads of at least ``min_bytes`` bytes that with the
largest page_id is a response and the others are revisits that refer to it,
without a block of their own. Smaller ones are responses. Equal payloads are
those with the same SHA-1 and length. A null html is an empty payload. Rows that
repeat the largest page_id are each a response; a row without page_id refers to
the largest one, or is a response where no equal record has an id.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, hot_join, stored

#: Records are gathered until a frame, and frames until a bundle, has so many bytes.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
MIN_BYTES = 1000
#: Pages of one payload from which on they are dealt to several tasks.
COPIES = 1000
#: Bytes of records that a task reads back, about.
READ_BYTES = 32 << 20
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER_BYTES = 0x184D2A5E, 0x8F92EAB1, 9
RECORD_DATE = "2024-01-01T00:00:00Z"


def with_decisions(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to. Only groups of equal payloads are joined back."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_bytes", "payload_digest")
    key = ["payload_digest", "payload_bytes"]
    shared = stored(large.groupBy(*key).agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1"))
    # Only pages whose payload is repeated are shuffled, those of a very common one to many tasks.
    repeated = bit_filter(shared.select(*key))(*map(F.col, key)) & (F.col("payload_bytes") >= min_bytes)
    joined = hot_join(rows.where(repeated), shared.drop("n"), key, shared.where(F.col("n") >= COPIES).select(*key), ["page_id"], "left")
    rows = joined.unionByName(rows.where(~repeated).withColumn("response", F.lit(None).cast("long")))
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    revisit = refers_to is not None
    target = (url or "").replace("\r", "").replace("\n", "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = b"" if revisit else payload
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: memoryview) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at the start of ``data``."""
    raw = bytes(data)
    end = raw.index(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    size = int(headers["Content-Length"])
    block = raw[end + 4 : end + 4 + size]
    if not raw.startswith(b"WARC/1.1\r\n") or len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return headers, block


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_places(bundle: memoryview) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the table at the bundle's end."""
    count, _, magic = struct.unpack("<IBI", bundle[-FOOTER_BYTES:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    out, at = [], 0
    for compressed, size in struct.iter_unpack("<II", bundle[-FOOTER_BYTES - 8 * count : -FOOTER_BYTES]):
        out.append((at, compressed, size))
        at += compressed
    return out


class _Bundle:
    def __init__(self, folder: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.path = name, f"{base}/{name}"
        self.part = f"{self.path}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, place in the frame)."""
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.part, self.path)


def bundled(records: DataFrame, folder: str) -> DataFrame:
    """Rows of the index, page_id, bundle, frame, place and bytes; each time that they are computed, bundles are written to ``folder``/bundles."""
    bundles = f"{folder}/bundles"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, made, bundle = TaskContext.get(), 0, None
        task = f"part-{context.partitionId():05d}-{context.taskAttemptId():08d}"
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if bundle is None:
                    bundle = _Bundle(bundles, f"{task}-{made:05d}.warc.zst")
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                rows.append((page_id.as_py(), bundle.name, *bundle.add(data), len(data)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle, made = None, made + 1
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "bundle", "frame", "place", "bytes"])
        if bundle is not None:
            bundle.close()

    return records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "page_id long, bundle string, frame long, place long, bytes long")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write the bundles of rows as :func:`with_decisions` gives them, and the index, a table in ``folder``/index, which is returned: see :func:`bundled`."""
    bundled(records, folder).write.parquet(f"{folder}/index")
    return records.sparkSession.read.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, page_ids: DataFrame | None = None) -> DataFrame:
    """Every record that the index lists, or those of ``page_ids``, a table with page_id; read at its place, and no other frame: page_id, record_type, payload_bytes, payload_digest, refers_to and block. Digests of responses are computed from what is read, and held against the headers."""
    index = spark.read.parquet(f"{folder}/index")
    if page_ids is not None:
        index = index.join(page_ids.select(F.col("page_id").cast("long").alias("page_id")).distinct(), "page_id", "left_semi")
    tasks = (index.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES + 1
    wanted = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("place", "bytes"))).alias("records"))
    bundles = f"{folder}/bundles"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(bundles)
        decompress = zstandard.ZstdDecompressor().decompress
        name, file, places = None, None, []
        for batch in batches:
            for bundle, frame, records in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bundle != name:
                    if file is not None:
                        file.close()
                    name, file = bundle, fs.open_input_file(f"{base}/{bundle}")
                    places = _places(file)
                offset, compressed, size = places[frame]
                data = memoryview(decompress(file.read_at(compressed, offset), max_output_size=size))
                rows = [_row(*parse(data[r["place"] : r["place"] + r["bytes"]])) for r in records]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "block"])
        if file is not None:
            file.close()

    # The index is small and would be merged into a few tasks; what counts is what they read.
    wanted = wanted.repartition(max(tasks, spark.sparkContext.defaultParallelism), "bundle", F.floor(F.col("frame") / 16))
    return wanted.sortWithinPartitions("bundle", "frame").mapInArrow(run, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary")


def _places(file) -> list[tuple[int, int, int]]:
    """A bundle's frames; only its table is read."""
    size = file.size()
    count = struct.unpack("<IBI", file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))[0]
    tail = 8 * count + FOOTER_BYTES
    return frame_places(memoryview(file.read_at(tail, size - tail)))


def _page(identifier: str) -> int | None:
    value = identifier.rpartition(":")[2].rstrip(">")
    return None if value == "none" else int(value)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, size = headers["WARC-Type"], int(headers["X-Payload-Length"])
    if kind == "response" and (hashlib.sha1(block).hexdigest(), len(block)) != (digest, size):
        raise ValueError("payload and digest differ")
    return _page(headers["WARC-Record-ID"]), kind, size, digest, _page(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None, block
