"""WARC archives with a Zstandard dictionary: one leading skippable frame, then one frame a record."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import new_path, pieces, shared_dir, written

#: The frame that holds the dictionary.
SKIPPABLE = 0x184D2A5D
#: Records of an archive, and their bytes, that its dictionary is built from at most.
SAMPLES, SAMPLE_BYTES, DICTIONARY = 400, 2 << 20, 32 << 10
#: Compressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 32 << 20
#: Repeated payloads that are few enough to be sent to all executors (about 60 bytes each).
BROADCAST_ROWS = 100_000
LEVEL = 3


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, with an HTTP head; a revisit has the head alone, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; where they are too few to train, their joined heads."""
    try:
        return zstandard.train_dictionary(DICTIONARY, records, k=256, d=8)
    except zstandard.ZstdError:
        raw = b"".join(x[: DICTIONARY // max(1, len(records)) + 1] for x in records)[:DICTIONARY]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes one archive; records are held until the dictionary's sample is full."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.uri, self.held, self.size, self.out, self.bytes, self.n = uri, [], 0, None, 0, 0

    def add(self, data: bytes) -> None:
        self.n += 1
        if self.out is None:
            self.held.append(data)
            self.size += len(data)
            if len(self.held) >= SAMPLES or self.size >= SAMPLE_BYTES:
                self.begin()
        else:
            self.put(data)

    def put(self, data: bytes) -> None:
        frame = self.zip.compress(data)
        self.bytes += len(frame)
        self.out.write(frame)

    def begin(self) -> None:
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        own = dictionary(self.held)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        raw = own.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for data in self.held:
            self.put(data)
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self.begin()
        self.out.close()
        return self.uri, self.n, self.bytes


def read(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in constant memory beside one record."""
    own, path = fs.FileSystem.from_uri(uri)
    with own.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri}: no dictionary frame")
        raw = source.read(size)
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        with io.BufferedReader(context.stream_reader(source, read_across_frames=True), 1 << 20) as lines:
            while first := lines.readline():
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"{uri}: not a WARC record: {first[:40]!r}")
                headers = {}
                while (line := lines.readline()) not in (b"\r\n", b""):
                    k, _, v = line.decode().rstrip("\r\n").partition(": ")
                    headers[k] = v
                block = lines.read(int(headers["Content-Length"]))
                if lines.read(4) != b"\r\n\r\n":
                    raise ValueError(f"{uri}: a record doesn't end where its length says")
                yield headers, block


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes every row of ``pages`` (page_id, url, html) as a record; returns (uri, records, bytes) by archive.

    Of the records with equal payloads of at least ``least_bytes`` bytes, those of the largest page_id are
    responses, the others revisit it; where all page_ids of a payload are null, all are responses. A null html
    is an empty payload. A task that is run again writes under new names, and only the archives
    in the returned table count.
    """
    spark = pages.sparkSession
    shared_dir(spark)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha"))
    again = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    again = written(again.where("n > 1 and refers_to is not null").select("sha", "refers_to"), "warc-repeated")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = rows.join(again, "sha", "left").select("page_id", "url", "html", "sha", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")), F.col("refers_to")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for b in pieces(batches):
            for page_id, url, html, sha, to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = Writer(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                out.add(record(page_id, url, html, base64.b32encode(bytes.fromhex(sha)).decode(), to, to is not None))
                if out.bytes >= ARCHIVE_BYTES:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["uri", "records", "bytes"])

    return written(rows.mapInArrow(run, "uri string, records bigint, bytes bigint"), "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record of the
    archives named in column uri. The payload (null for revisits, and where ``payloads`` is false) is checked
    against its digest."""
    shared_dir(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        tail = (urn or "null").rstrip(">").rpartition(":")[2]
        return None if tail == "null" else int(tail)

    def rows(uri: str) -> Iterator[tuple]:
        for h, block in read(uri):
            head, _, payload = block.partition(b"\r\n\r\n")
            size = int(head.rpartition(b"Content-Length: ")[2])
            digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
            if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"{uri}: a payload doesn't match its digest")
            yield number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), payload if payloads and kind == "response" else None, size, digest, kind, number(h.get("WARC-Refers-To"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                held, size = [], 0
                for row in rows(uri):
                    held.append(row)
                    size += 200 + len(row[2] or b"")
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)

    ddl = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    spread = archives.select("uri").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4, "uri")
    return spread.mapInArrow(run, ddl)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB's sha1() is hexadecimal; base 32 is spelt out five bits at a time.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha, html FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS top FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(('0b' || substr(array_to_string(list_transform(range(1, 41), lambda j: lpad(bin(CAST('0x' || substr(sha, CAST(j AS INTEGER), 1) AS INTEGER)), 4, '0')), ''),
      CAST(1 + 5 * i AS INTEGER), 5)) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN top IS NOT NULL AND coalesce(page_id < top, true) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND coalesce(page_id < top, true) THEN top END AS refers_to
FROM w
"""
