"""WARC archives with a Zstandard dictionary of their own.

Each archive begins with a skippable frame that holds a dictionary built from its first records; each record is a
frame of its own, compressed with that dictionary, so it can be read alone. Payloads of at least ``MIN_REVISIT`` bytes
that occur more than once are stored once; the other pages are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import shared_dir, shipped, written

#: Magic number of the skippable frame that the WARC Zstandard convention uses for dictionaries.
DICTIONARY_FRAME = 0x184D2A5D
MIN_REVISIT = 1000
#: Bytes of records that a dictionary is trained on, the dictionary's size, and payload bytes of an archive file.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 2 << 20, 64 << 10, 256 << 20
READ_BYTES = 1 << 20
#: Revisits (some 100 bytes each, urls besides) up to which they are broadcast, and parts that the pages of one payload are dealt into.
BROADCAST_ROWS, SALTS = 200_000, 16
LEVEL = 6


def header(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda x: "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in x)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "replace")


def record(name: str, page_id, url: str | None, payload: bytes, sha1: str, kind: str, refers_to, refers_url: str | None) -> bytes:
    """One WARC record; ``name`` is its own in all archives, as page ids may repeat or lack.

    A revisit has the HTTP headers but no payload; both carry the digest and length of the full payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid5(NAMESPACE_URL, name)}>"), ("WARC-Target-URI", url or "urn:unknown"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", refers_url or "urn:unknown"), ("X-Refers-To-Page-ID", str(refers_to))]
    return header([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """(page_id, payload_bytes, sha1, type, refers_to, payload or None, record id) of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(fields[name]) if name in fields else None
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (sha1, length):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return number("X-Page-ID"), length, sha1, fields["WARC-Type"], number("X-Refers-To-Page-ID"), payload if fields["WARC-Type"] == "response" else None, fields["WARC-Record-ID"]


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary; the records' first bytes as they are where there are too few to train one."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 10)), records, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(x[:2048] for x in records[:8])[:DICTIONARY_BYTES] or b"WARC/1.1"


class ArchiveWriter:
    """Writes records to one archive under another name, which becomes the final one when the archive is complete."""

    def __init__(self, folder: str, name: str):
        self.files, base = fs.FileSystem.from_uri(folder)
        self.path, self.partial = f"{base}/{name}", f"{base}/_partial-{name}-{uuid4().hex}"
        self.out, self.waiting, self.held, self.frames, self.payload = None, [], 0, None, 0

    def add(self, raw: bytes) -> None:
        self.payload += len(raw)
        if self.frames:
            self.out.write(self.frames.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        content = dictionary_of(self.waiting)
        self.out = self.files.open_output_stream(self.partial, compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True)
        for raw in self.waiting:
            self.out.write(self.frames.compress(raw))
        self.waiting = []

    def close(self) -> str:
        if not self.frames:
            self._begin()
        self.out.close()
        self.files.move(self.partial, self.path)
        return self.path


def read_archive(folder: str, name: str) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/{name}", compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{name} does not begin with a dictionary frame")
        frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
        rest, more = b"", True
        while more or rest:
            frame, parts = frames.decompressobj(), []
            while not frame.eof:
                if not rest:
                    rest = source.read(READ_BYTES)
                    more = bool(rest)
                    if not more:
                        break
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            if frame.eof:
                yield b"".join(parts)
            elif parts and any(parts):
                raise ValueError(f"{name} ends inside a record")


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, html, ...) -> (page_id, url, payload, sha1, record_type, refers_to, refers_url).

    Of equal payloads of at least ``min_revisit`` bytes the page with the largest page_id is the response, once. Null html counts
    as empty. Pages without page_id are responses, and nothing refers to them; of rows that repeat page_id and payload each one is.
    Revisits are found by page_id and hash alone, salted, as one payload may be a third of all; payloads move only where there are more than
    ``broadcast_rows`` revisits, and those below ``min_revisit`` bytes never.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).alias("n"))
    keys = rows.where((F.col("n") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "sha256", "url")
    keys = written(keys, "payload-hashes")
    groups = keys.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("last_url"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    several = groups.where("copies > 1").select("sha256", "last", "last_url", salts)
    found = keys.select("page_id", "sha256", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt")).join(several, ["sha256", "salt"]).where("page_id < last")
    revisits = written(found.select(F.col("page_id").alias("page_"), F.col("sha256").alias("sha256_"), "last", "last_url").distinct(), "revisits")
    found = (F.col("page_id") == F.col("page_")) & (F.col("sha256") == F.col("sha256_")) & (F.col("n") >= min_revisit)
    if revisits.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(revisits), found, "left")
    else:
        small = rows.where(F.col("n") < min_revisit)
        missing = [F.lit(None).cast(field.dataType).alias(field.name) for field in revisits.schema]
        joined = rows.where(F.col("n") >= min_revisit).join(revisits, found, "left").unionByName(small.select("*", *missing))
    kind = F.when(F.col("last").isNotNull(), "revisit").otherwise("response")
    return joined.select("page_id", "url", "payload", F.sha1(F.col("payload").cast("binary")).alias("sha1"), kind.alias("record_type"), F.col("last").cast("long").alias("refers_to"), F.col("last_url").alias("refers_url"))


def write_warc(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page to archives in ``folder`` (a URI that all executors reach): (archive, records, payload_bytes).

    Tasks write archives of about ``archive_bytes`` under temporary names and rename them at their end, so an archive is complete or
    absent and a repeated task replaces its own. The returned table lists what succeeded tasks wrote; only that is read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, count, writer = TaskContext.get().partitionId(), 0, 0, None

        def done() -> pa.RecordBatch:
            name = writer.path.rpartition("/")[2]
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([writer.payload], pa.int64())], names=["archive", "records", "payload_bytes"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, sha1, kind, refers_to, refers_url = (batch.column(c)[k].as_py() for c in range(7))
                writer = writer or ArchiveWriter(folder, f"part-{part:06d}-{number:04d}-{uuid4().hex[:8]}.warc.zst")
                writer.add(record(f"{writer.path}/{count}", page_id, url, payload.encode("utf-8", "surrogatepass"), sha1, kind, refers_to, refers_url))
                count += 1
                if writer.payload >= archive_bytes:
                    yield done()
                    writer, number, count = None, number + 1, 0
        if writer:
            yield done()

    spark = pages.sparkSession
    spark.createDataFrame([], "x int").write.mode("append").parquet(f"{folder}/_made")  # makes the folder where Spark can
    return written(shipped(plan_records(pages, min_revisit)).mapInArrow(run, "archive string, records long, payload_bytes long"), "archives")


def read_warc(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the listed archives: (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload])."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for raw in read_archive(folder, name):
                    rows.append(parsed(raw)[: len(names)])
                    held += len(raw) * with_payload
                    if len(rows) >= 10_000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = max(1, archives.count())
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("archive").repartition(min(n, 10_000)).mapInArrow(run, schema)


def op4(pages: DataFrame) -> DataFrame:
    """The contract's columns, from the archives as they are read back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid4().hex}"
    return read_warc(write_warc(pages, folder), folder)
