"""Media columns: AVI files of motion JPEG in a binary column.

Writing: a text's bytes become samples, 64 to a row. A sample is one 8x8 block of constant luma in a baseline JPEG
frame, so its quantised DC coefficient (table entry 8) is the sample less 128, and any decoder gives the sample back.
The DC code of category s is 8 - s ones and a zero, which with s further bits and the end-of-block bit makes ten bits
for every block: packing and unpacking work on whole arrays. The stream is framed as RIFF with an idx1 index.

Reading: the index gives the frames (without one, the movi list is walked); their DC images are decoded, this writer's
by arrays, other baseline frames block by block. A cut is a step of the luma histogram above an adaptive threshold:
the mean and deviation of the steps before it in the same shot. Clips are timed rows between cuts.

Cases: null and empty texts are 64 zero bytes; equal texts give equal files; an empty table gives an empty result;
bytes that are no AVI file raise ValueError in decode() and give no clip rows in clips(). Further columns pass by.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

ROW = 64
#: Rows of samples in a frame at most.
ROWS = 64
RATE = 25
#: Bytes of files in one batch that goes back to Spark.
BATCH_BYTES = 4 << 20

BINS = 32
#: A cut needs a step above the mean of the last WINDOW steps by SIGMAS deviations, and above FLOOR.
WINDOW, SIGMAS, FLOOR = 12, 3.0, 0.3


def _codes() -> np.ndarray:
    """The ten bits of each DC difference from -255 to 255."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        out[d + 255] = ((prefix << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
    return out


_CODES = _codes()
_DIFFS = np.full(1024, 9999, np.int32)
_DIFFS[_CODES.astype(int)] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, b"\0\x08" + b"\1" * 63)
    + _segment(0xC4, b"\0" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
)
_SCAN = _segment(0xDA, b"\1\1\0\0\x3f\0")


def encode_frame(samples: np.ndarray) -> bytes:
    """A baseline JPEG of samples (height, width; their number a multiple of 4), one 8x8 block each."""
    height, width = samples.shape
    value = samples.ravel().astype(np.int32) - 128
    code = _CODES[np.diff(value, prepend=np.int32(0)) + 255].reshape(-1, 4)
    packed = (code[:, 0] << np.uint64(30)) | (code[:, 1] << np.uint64(20)) | (code[:, 2] << np.uint64(10)) | code[:, 3]
    data = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes().replace(b"\xff", b"\xff\0")
    head = _segment(0xC0, struct.pack(">BHHB", 8, height * 8, width * 8, 1) + b"\1\x11\0")
    return b"\xff\xd8" + _TABLES + head + _SCAN + data + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def encode(payload: bytes) -> bytes:
    """An AVI file of the payload, whose length is a positive multiple of 64."""
    rows = len(payload) // ROW
    height = min(ROWS, rows)
    frames = -(-rows // height)
    samples = np.zeros((frames * height, ROW), np.uint8)
    samples[:rows] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    images = [encode_frame(x) for x in samples.reshape(frames, height, ROW)]
    largest = max(map(len, images))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, frames, 0, 1, largest, ROW * 8, height * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, ROW * 8, height * 8)
    form = struct.pack("<IiiHH4sIiiII", 40, ROW * 8, height * 8, 1, 24, b"MJPG", ROW * 8 * height * 8 * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _list(b"INFO", _chunk(b"ISBJ", b"payload_bytes=%d\0" % len(payload)))
    body, index = [], []
    at = 4
    for image in images:
        piece = _chunk(b"00dc", image)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        body.append(piece)
        at += len(piece)
    return _chunk(b"RIFF", b"AVI " + head + info + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks; a list is named by its kind, its start is behind that."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        stop = min(at + 8 + size, end)
        if name in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 12, stop
        else:
            yield name, at + 8, stop
        at += 8 + size + (size & 1)


def parse(data: bytes) -> dict:
    """rate (frames a second), payload_bytes (None if unknown) and frames: (start, end) of every JPEG image, by the index where there is one."""
    kind, start, end = next(_chunks(data, 0, len(data)), (b"", 0, 0))
    if kind != b"AVI ":
        raise ValueError("no RIFF AVI file")
    out: dict = {"rate": float(RATE), "payload_bytes": None, "frames": []}
    movi, index = (0, 0), b""
    for name, a, b in _chunks(data, start, end):
        if name == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = data[a:b]
        elif name == b"INFO":
            for inner, c, d in _chunks(data, a, b):
                if inner == b"ISBJ" and data[c:d].startswith(b"payload_bytes="):
                    out["payload_bytes"] = int(data[c + 14 : d].rstrip(b"\0"))
        elif name == b"hdrl":
            for inner, c, _ in _chunks(data, a, b):
                if inner == b"avih" and (step := int.from_bytes(data[c : c + 4], "little")):
                    out["rate"] = 1e6 / step
    if index:
        entries = [struct.unpack_from("<4sIII", index, k) for k in range(0, len(index) - 15, 16)]
        entries = [e for e in entries if e[0][2:] == b"dc"]
        # offsets count from the list's name, or from the start of the file
        base = movi[0] - 4 if entries and data[movi[0] - 4 + entries[0][2] :][:4] == entries[0][0] else 0
        out["frames"] = [(base + at + 8, base + at + 8 + size) for _, _, at, size in entries]
    else:
        out["frames"] = [(a, b) for name, a, b in _chunks(data, *movi) if name[2:] == b"dc"]
    return out


def dc_image(image: bytes) -> np.ndarray:
    """Luma at an eighth of the size, from the DC coefficients of a baseline JPEG."""
    at, tables, quant, parts, restart = 2, {}, {}, [], 0
    known = image.startswith(_TABLES, 2)
    while image[at + 1] != 0xDA:
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        if marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDB and not known:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 3], "big") if wide else body[k + 1]
                k += 129 if wide else 65
        elif marker == 0xC4 and not known:
            k = 0
            while k < len(body):
                counts, code, table = body[k + 1 : k + 17], 0, {}
                values = iter(body[k + 17 : k + 17 + sum(counts)])
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = next(values)
                        code += 1
                    code <<= 1
                tables[body[k]] = table
                k += 17 + sum(counts)
        at += 2 + size
    scan = image[at + 4 : at + 2 + int.from_bytes(image[at + 2 : at + 4], "big")]
    data = image[at + 2 + int.from_bytes(image[at + 2 : at + 4], "big") :]
    data = data[: data.rfind(b"\xff\xd9")]
    if known and len(parts) == 1:
        raw = np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 3:] = raw
        word = wide.view(">u8").ravel().astype(np.uint64)
        code = np.stack([(word >> np.uint64(k)) & np.uint64(1023) for k in (30, 20, 10, 0)], 1).ravel()
        return (np.cumsum(_DIFFS[code.astype(np.int32)]) + 128).reshape(height // 8, width // 8)
    return _plain_dc(data, scan, tables, quant, parts, height, width, restart)


def _plain_dc(data: bytes, scan: bytes, tables: dict, quant: dict, parts: list, height: int, width: int, restart: int) -> np.ndarray:
    selector = {scan[1 + 2 * k]: (scan[2 + 2 * k] >> 4, scan[2 + 2 * k] & 15) for k in range(scan[0])}
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        across = down = 1
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    out = np.zeros((rows * parts[0][2], columns * parts[0][1]), np.int32)
    segments, k, last = [], 0, 0
    while (k := data.find(b"\xff", k)) >= 0:
        if 0xD0 <= data[k + 1] <= 0xD7:
            segments.append(data[last:k])
            last = k + 2
        k += 2
    segments.append(data[last:])
    unit, total = 0, rows * columns
    for segment in segments:
        bits = np.unpackbits(np.frombuffer(segment.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        at, before = 0, dict.fromkeys((p[0] for p in parts), 0)

        def symbol(table: dict) -> int:
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (found := table.get((length, code))) is not None:
                    return found
            raise ValueError("broken Huffman code")

        for _ in range(min(restart or total, total - unit)):
            for number, h, v, q in parts:
                dc, ac = tables[selector[number][0]], tables[16 + selector[number][1]]
                for block in range(h * v):
                    size = symbol(dc)
                    value = int("".join(map(str, bits[at : at + size])) or "0", 2)
                    at += size
                    before[number] += value if not size or value >> (size - 1) else value - (1 << size) + 1
                    place = 1
                    while place < 64:
                        rs = symbol(ac)
                        if rs & 15 == 0 and rs != 0xF0:
                            break
                        at += rs & 15
                        place += (rs >> 4) + 1
                    if number == parts[0][0]:
                        out[unit // columns * v + block // h, unit % columns * h + block % h] = before[number] * quant[q] / 8 + 128.5
            unit += 1
    return np.clip(out[: -(-height // 8), : -(-width // 8)], 0, 255)


def decode(data: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """The payload, the frames' DC images and the frame rate."""
    found = parse(data)
    images = [dc_image(data[a:b]) for a, b in found["frames"]]
    payload = b"".join(x.astype(np.uint8).tobytes() for x in images)
    return payload[: found["payload_bytes"]], images, found["rate"]


def cuts(images: list[np.ndarray]) -> list[int]:
    """Frames at which a new shot begins, the first not counted."""
    histograms = [np.bincount(x.ravel() * BINS >> 8, minlength=BINS) / x.size for x in images]
    steps = [0.5 * float(np.abs(a - b).sum()) for a, b in zip(histograms, histograms[1:])]
    found = []
    for k, step in enumerate(steps):
        shot = found[-1] if found else 0  # steps of this shot only
        before = np.asarray(steps[max(shot, k - WINDOW) : k] or [0.0])
        if step > FLOOR and step > before.mean() + SIGMAS * before.std():
            found.append(k + 1)
    return found


def feature(images: list[np.ndarray], rate: float) -> str:
    edges = [0, *cuts(images), len(images)]
    return f"frames={len(images)};shots={len(edges) - 1};ends=" + ",".join(f"{b / rate:.2f}" for b in edges[1:])


def _out(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES by the column weigh."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh] or b"")
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row: the text as an AVI file."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            flat, offsets = texts(batch.column("text"))
            raw = flat.tobytes()
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("media", pa.binary())])

            def rows():
                for key, a, b in zip(batch.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    yield key, b - a, encode(raw[a:b].ljust(max(ROW, -(-(b - a) // ROW) * ROW), b"\0"))

            yield from _out(rows(), schema, 2)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """For store_texts()'s rows: digests of the payload as read back, and the shot feature."""
    kind = stored.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

            def rows():
                for key, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                    payload, images, rate = decode(data)
                    yield key, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), sha256(data).hexdigest(), feature(images, rate)

            yield from _out(rows(), schema, 3)

    return stored.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clips(stored: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, last_frame, start_s, end_s) of a table (doc_id, media)."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                try:
                    _, images, rate = decode(data or b"")
                except (ValueError, IndexError, KeyError, struct.error):
                    continue
                edges = [0, *cuts(images), len(images)]
                rows += [(key, i, a, b - 1, a / rate, b / rate) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double")
