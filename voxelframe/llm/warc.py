"""Dictionary-compressed WARC archives.

Every archive begins with a skippable frame that holds a Zstandard dictionary built from its own first records; each
record follows as a frame of its own, so any record can be read alone once the dictionary is known. A payload met before
is written as a revisit of the record that has it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import slices, staged

# fixed values of the formats
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


READ_BYTES = 64 << 20  # of archives for a task that reads them back


@dataclass(frozen=True)
class Settings:
    archive_bytes: int = 256 << 20   # of records before compression; a new archive begins beyond
    sample_bytes: int = 1 << 20      # records that an archive's dictionary is built from; one gives a 16th of it at most
    dictionary_bytes: int = 1 << 15
    level: int = 3


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head only, whose Content-Length still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url is not None else None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            *([f"WARC-Target-URI: {uri}"] if uri is not None else []), f"WARC-Payload-Digest: sha1:{digest(payload)}",
            *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"] if revisit else []),
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if len(rest) != len(block) + 4 or kind == "response" and (len(payload) != length or digest(payload) != told):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name][len(URN) + 1:-1]) if fields.get(name, f"<{URN}>") != f"<{URN}>" else None
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
            "payload_digest": told, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload}


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """None where the records are too few or too small for one."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """One archive. Records wait until there are enough for the dictionary; from then on they are written at once."""

    def __init__(self, folder: str, settings: Settings) -> None:
        self.path, self.settings = f"{folder}/{uuid.uuid4().hex}.warc.zst", settings
        self.waiting: list[bytes] = []
        self.tool: zstandard.ZstdCompressor | None = None
        self.raw = self.records = self.sampled = 0
        where, path = fs.FileSystem.from_uri(self.path)
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = where.open_output_stream(path, compression=None)  # else pyarrow compresses by the name

    def start(self) -> None:
        d = dictionary([x[:self.settings.sample_bytes // 16] for x in self.waiting], self.settings.dictionary_bytes)
        if d is not None:
            content = d.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
            d.precompute_compress(level=self.settings.level)
        self.tool = zstandard.ZstdCompressor(level=self.settings.level, dict_data=d, write_checksum=True)
        for data in self.waiting:
            self.out.write(self.tool.compress(data))
        self.waiting = []

    def add(self, data: bytes) -> None:
        self.raw += len(data)
        self.records += 1
        if self.tool:
            self.out.write(self.tool.compress(data))
            return
        self.waiting.append(data)
        self.sampled += min(len(data), self.settings.sample_bytes // 16)
        if self.sampled >= self.settings.sample_bytes or self.raw >= 16 * self.settings.sample_bytes:
            self.start()

    def close(self) -> tuple[str, int, int]:
        if not self.tool:
            self.start()
        self.out.close()
        where, path = fs.FileSystem.from_uri(self.path)
        return self.path, self.records, where.get_file_info(path).size


def read_archive(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive one by one."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_stream(name, compression=None) as f:
        head = f.read(8)
        d, left = None, head
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
            d, left = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", head[4:])[0])), b""
        tool = zstandard.ZstdDecompressor(dict_data=d)
        frame, parts = None, []
        while left or (left := f.read(chunk)):
            frame = frame or tool.decompressobj()
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
            if frame.eof:
                yield b"".join(parts)
                frame, parts = None, []
        if frame:
            raise ValueError(f"{path} ends within a record")


def first_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): revisits point to the smallest page_id that has the same payload.

    Only ids and digests meet by payload, so that a payload which a third of the pages have moves no text.
    """
    of = F.concat_ws(":", F.sha1("html"), F.octet_length("html"), F.xxhash64("html"))  # digests and length have to agree
    ids = pages.select("page_id", of.alias("sha"))
    # staged, so that the join can split a payload that very many pages have
    first = staged(ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "warc-first")
    links = ids.join(first, "sha").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))) \
        .select(F.col("page_id").alias("id"), "sha", "first").distinct()
    p = pages.withColumn("of", of)
    return p.join(links, p["page_id"].eqNullSafe(links["id"]) & (p["of"] == links["sha"]), "left") \
        .select("page_id", "url", "html", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          settings: Settings = Settings()) -> DataFrame:
    """Writes the archives under `folder` (any place that pyarrow's file systems reach) and returns their manifest.

    Null html is an empty payload; null urls have no target. Rows that repeat the smallest page_id of a payload are all
    responses. A null page_id is never referred to. A task that is run again writes new files, and only those of the run
    that succeeded are in the manifest.
    """
    rows = first_pages(pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                                    F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in slices(batches):
            for r in batch.to_pylist():
                writer = writer or Writer(folder, settings)
                writer.add(record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], r["revisit"]))
                if writer.raw >= settings.archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return staged(rows.mapInArrow(put, MANIFEST), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest, without payloads (each response's payload is checked)."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in read_archive(path):
                    rows.append({k: v for k, v in parse(data).items() if k != "payload"})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    size, count = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, size // READ_BYTES)
    # a stated number is kept: paths alone are so few bytes that adaptive execution would read all archives in one task
    return manifest.select("path").repartition(int(max(1, min(count, tasks)))).mapInArrow(get, RECORDS)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64())])
