"""WARC archives in seekable Zstandard bundles.

Writing: each task appends WARC/1.1 records to one bundle. Records are gathered into groups of about FRAME bytes, each
group is an independent frame, and a skippable frame at the end holds the seek table. An index table maps record
identifiers to frames and offsets inside them. Of records with equal payloads one is a response, the others are
revisits that refer to it. Reading: a frame is found by the bundle's own seek table; a single record costs one frame.

Cases: a null html is the empty payload; equal payloads shorter than least bytes are all responses; rows that repeat
the page_id which is the response of their payload are responses too; a null page_id is never chosen as a response
that others refer to; a null url is written as urn:page:<id>, and white space and control characters in a url are
percent-encoded; an empty table gives no bundle and an empty result. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, new_folder, park, shared_file, task_count

#: Bytes of records in a frame before compression, at least (but for a bundle's last).
FRAME = 256 << 10
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = "page_id long, record_id string, file string, frame long, offset long, length long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:quillmine:page:{page_id}"


def _page(identifier: str | None) -> int | None:
    tail = (identifier or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _address(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit of the response of refers_to."""
    digest, head = base32_sha1(payload), [b"WARC/1.1"]
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id(page_id)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _address(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    block = _HEAD + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head += [f"{k}: {v}".encode() for k, v in fields]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of the records in data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(header["content-length"])
        yield header, data[end + 4 : end + 4 + size]
        at = end + 8 + size


class Bundle:
    """Writes a seekable bundle to a binary stream."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.compressor, self.frames = out, zstandard.ZstdCompressor(level=level), []

    def add(self, group: bytes) -> int:
        """One more frame; its number."""
        packed = self.compressor.compress(group)
        self.out.write(packed)
        self.frames.append((len(packed), len(group)))
        return len(self.frames) - 1

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Reads frames of the bundle at a shared address."""

    def __init__(self, file: str):
        system, path = shared_file(file)
        self.source = system.open_input_file(path)
        size = self.source.size()
        count, flags, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        table = self.source.read_at(entry * count, size - 9 - entry * count)
        self.places, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, entry * k)
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.places[number]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=plain)


def write_archives(pages: DataFrame, least: int = 0, frame: int = FRAME) -> DataFrame:
    """Write bundles of pages (page_id, url, html); returns the index (page_id, record_id, file, frame, offset, length), written.

    The response of each payload is picked by a pre-aggregated maximum; only payloads that several records share
    travel back. A task that is run again writes a bundle of its own, and the index has only those of tasks that
    ended well.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    shared = source.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    shared = park(shared.where("n > 1 AND keeper IS NOT NULL").select(F.col("digest").alias("same"), "keeper"), "shared")
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    rows = source.join(checked_broadcast(shared), F.col("digest") == F.col("same"), "left").select("page_id", "url", "html", refers.alias("refers_to"))
    folder = new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = shared_file(file)
        bundle, group, size, held = None, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal group, size, held
            number = bundle.add(b"".join(group))
            ids, offsets, lengths = zip(*held)
            n = len(held)
            out = pa.record_batch([pa.array(ids, pa.int64()), pa.array([record_id(i) for i in ids]), pa.array([file] * n), pa.array([number] * n, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "record_id", "file", "frame", "offset", "length"])
            group, size, held = [], 0, []
            return out

        for batch in batches:
            bundle = bundle or Bundle(system.open_output_stream(path, compression=None))
            for page_id, url, text, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                page_id = page_id.as_py()
                body = record(page_id, url.as_py(), text.as_py().encode(), refers_to.as_py())
                held.append((page_id, size, len(body)))
                group.append(body)
                size += len(body)
                if size >= frame:
                    yield flush()
        if bundle:
            if held:
                yield flush()
            bundle.close()

    return park(rows.mapInArrow(run, _INDEX), "index")


def read_record(index: DataFrame, page_id: int) -> tuple[dict[str, str], bytes] | None:
    """Header and payload of one page by the index and one frame; a revisit's payload is that of its response."""
    row = index.where(F.col("page_id") == page_id).first()
    if row is None:
        return None
    header, block = next(records(Reader(row["file"]).frame(row["frame"])[row["offset"] : row["offset"] + row["length"]]))
    if header["warc-type"] == "revisit":
        return header, read_record(index, _page(header["warc-refers-to"]))[1]
    return header, block[block.index(b"\r\n\r\n") + 4 :]


def read_archives(index: DataFrame) -> DataFrame:
    """Read every frame of the index's bundles back: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads of responses are digested anew and held against their headers."""
    frames = park(index.groupBy("file", "frame").agg(F.sum("length").alias("size")), "frames")
    total = frames.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("frames")).first()
    tasks = task_count(index.sparkSession, total["size"], total["frames"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, reader = None, None
        for batch in batches:
            for file, number in zip(batch.column("file").to_pylist(), batch.column("frame").to_pylist()):
                if file != open_file:
                    open_file, reader = file, Reader(file)
                rows = []
                for header, block in records(reader.frame(number)):
                    digest, size = header["warc-payload-digest"].removeprefix("sha1:"), int(header["x-payload-length"])
                    if header["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != size or base32_sha1(payload) != digest:
                            raise ValueError(f"{header['warc-record-id']} in {file} is damaged")
                    rows.append((_page(header["warc-record-id"]), size, digest, header["warc-type"], _page(header.get("warc-refers-to"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return frames.select("file", "frame").repartition(tasks, "file", "frame").sortWithinPartitions("file", "frame").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
