"""Media columns: signature sniffing, validation, correction of declared types, carving of embedded media.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. At each hit the format's
validator walks the structure and gives the length that it proves; only proven media count. What starts at the first
byte and proves itself is the detected type, the others are carved as embedded media.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import slices

BLOCK = 192


def _png(b: bytes, at: int) -> int:
    """Length of a PNG: header chunk first, checksums right, up to its end chunk; 0 if not one."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[p : p + 8])
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack(">I", b[p + 8 + n : p + 12 + n])[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _riff(form: bytes, need: bytes) -> Callable[[bytes, int], int]:
    def check(b: bytes, at: int) -> int:
        if b[at + 8 : at + 12] != form or at + 12 > len(b):
            return 0
        end = at + 8 + struct.unpack("<I", b[at + 4 : at + 8])[0]
        p, seen = at + 12, False
        if end > len(b):
            return 0
        while p + 8 <= end:
            n = struct.unpack("<I", b[p + 4 : p + 8])[0]
            seen |= b[p : p + 4].startswith(need)
            p += 8 + n + n % 2
        return end - at if seen and p in (end, end + 1) else 0

    return check


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, start, head, w, h, planes, bits, packed = struct.unpack("<IIIIiiHHI", b[at + 2 : at + 34])
    row = (w * bits + 31) // 32 * 4
    ok = zero == 0 and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and w > 0 and h and start >= 14 + head
    return size if ok and size <= len(b) - at and (packed or start + row * abs(h) == size) else 0


def _gif(b: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at if frame else 0
        n = struct.unpack(">H", b[p + 2 : p + 4])[0]
        if n < 2:
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:  # coded data up to a marker that is neither stuffing nor a restart
            while p + 1 < len(b) and not (b[p] == 0xFF and b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7):
                p = b.find(b"\xff", p + 1)
                if p < 0:
                    return 0
    return p + 2 - at if frame and b[p : p + 2] == b"\xff\xd9" else 0


def _pdf(b: bytes, at: int, seen: dict) -> int:
    """Up to the first end mark after a reference to the cross table; marks are looked up once for each value."""
    ends = seen.setdefault("%%EOF", [m.start() for m in re.finditer(b"%%EOF", b)] if "%%EOF" not in seen else None)
    refs = seen.setdefault("startxref", [m.start() for m in re.finditer(b"startxref", b)] if "startxref" not in seen else None)
    i, j = bisect_left(ends, at), bisect_left(refs, at)
    return ends[i] + 5 - at if i < len(ends) and j < len(refs) and refs[j] < ends[i] else 0


def _gzip(b: bytes, at: int, seen: dict) -> int:
    """Length of a gzip member that opens and whose checksum is right; pieces grow, so a false start costs little."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    p = at + 10 + (2 + struct.unpack("<H", b[at + 10 : at + 12])[0] if b[at + 3] & 4 else 0)
    for flag in (8, 16):  # a name and a comment end at the next zero, which is looked up once for all hits before it
        if b[at + 3] & flag:
            if not seen.get("from", 0) <= p <= seen.get("zero", -1):
                seen["from"], found = p, b.find(b"\0", p)
                seen["zero"] = found if found >= 0 else len(b)
            p = seen["zero"] + 1
    if p >= len(b):
        return 0
    d, i, step = zlib.decompressobj(31), at, p - at + 256
    try:
        while i < len(b):
            rest = b[i : i + step]
            while rest and not d.eof:
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
            if d.eof:
                return i + min(step, len(b) - i) - len(d.unused_data) - at
            i, step = i + step, min(2 * step, 1 << 20)
    except zlib.error:
        pass
    return 0


def _zip(b: bytes, at: int, seen: dict) -> int:
    """Up to the end record whose directory begins where it says; end records are listed once, by the start they imply."""
    if "zip" not in seen:
        seen["zip"] = {}
        for m in re.finditer(b"PK\x05\x06", b):
            if (end := m.start()) <= len(b) - 22:
                size, start, note = struct.unpack("<IIH", b[end + 12 : end + 22])
                first = end - size - start
                if first >= 0 and b[first + start : first + start + 4] == b"PK\x01\x02":
                    seen["zip"].setdefault(first, end + 22 + note)
    return seen["zip"][at] - at if seen["zip"].get(at, 0) <= len(b) and at in seen["zip"] else 0


def _ogg(b: bytes, at: int, seen: dict) -> int:
    """Pages of one stream up to its last one; pages of a walk that came to nothing are not walked again."""
    failed, walked = seen.setdefault("ogg", set()), []
    p, serial = at, b[at + 14 : at + 18]
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b) and b[p + 14 : p + 18] == serial and p not in failed:
        walked.append(p)
        n = b[p + 26]
        last, p = b[p + 5] & 4, p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if last and p <= len(b):
            return p - at
        if last:
            break
    failed.update(walked)
    return 0


def _au(b: bytes, at: int) -> int:
    if at + 24 > len(b):
        return 0
    start, size, code, rate, channels = struct.unpack(">IIIII", b[at + 4 : at + 24])
    ok = 24 <= start < 1 << 16 and 1 <= code <= 27 and 0 < rate <= 1 << 20 and 0 < channels < 33 and size != 0xFFFFFFFF
    return start + size if ok and at + start + size <= len(b) else 0


#: Magic bytes, media type and validator.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png), (b"GIF87a", "image/gif", _gif), (b"GIF89a", "image/gif", _gif), (b"\xff\xd8\xff", "image/jpeg", _jpeg), (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff(b"WAVE", b"data")), (b"RIFF", "image/webp", _riff(b"WEBP", b"VP8")), (b"RIFF", "video/avi", _riff(b"AVI ", b"LIST")), (b".snd", "audio/basic", _au), (b"OggS", "audio/ogg", _ogg),
    (b"%PDF-", "application/pdf", _pdf), (b"\x1f\x8b\x08", "application/gzip", _gzip), (b"PK\x03\x04", "application/zip", _zip),
]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in {m for m, _, _ in FORMATS}:
        a.add_word(magic.decode("latin-1"), (len(magic), [(kind, check) for m, kind, check in FORMATS if m == magic]))
    a.make_automaton()
    return a


def media_in(value: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all media that prove themselves, outermost only."""
    out, free, seen = [], 0, {}
    hits = [(end + 1 - n, kinds) for end, (n, kinds) in automaton().iter(value.decode("latin-1"))]
    for at, kinds in sorted(hits, key=lambda h: h[0]):
        if at >= free:
            for kind, check in kinds:
                if n := check(value, at, seen) if check in (_pdf, _zip, _gzip, _ogg) else check(value, at):
                    out.append((at, n, kind))
                    free = at + n
                    break
    return out


SNIFFED = [
    StructField("detected_type", StringType()), StructField("corrected", BooleanType()),
    StructField("embedded", ArrayType(StructType([StructField("offset", LongType()), StructField("length", LongType()), StructField("type", StringType()), StructField("sha256", StringType())]))),
]


def sniff(rows: DataFrame, value: str, declared: str | None = None) -> DataFrame:
    """Add detected_type, corrected (differs from the declared type) and embedded (carved media) to every row.

    A value that proves no format at its first byte keeps its declared type (null without one). A null value has null
    type, is not corrected and holds nothing. New columns replace old ones of their names.
    """
    rows = rows.drop(*(f.name for f in SNIFFED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("d", pa.string()), ("c", pa.bool_()), ("e", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())])))])
        for batch in slices(batches, value):
            values = batch.column(value).to_pylist()
            said = batch.column(declared).to_pylist() if declared else [None] * len(values)
            found, changed, carved = [], [], []
            for v, d in zip(values, said, strict=True):
                media = media_in(v) if v else []
                kind = media[0][2] if media and media[0][0] == 0 else d if v is not None else None
                found.append(kind)
                changed.append(v is not None and kind != d)
                carved.append([{"offset": a, "length": n, "type": k, "sha256": hashlib.sha256(v[a : a + n]).hexdigest()} for a, n, k in media if a])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kinds.field(0).type), pa.array(changed, kinds.field(1).type), pa.array(carved, kinds.field(2).type)], [*batch.schema.names, *(f.name for f in SNIFFED)])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *SNIFFED]))


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples in a RIFF container."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(payload) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)


def wav_samples(value: bytes, at: int, length: int) -> bytes:
    """The data chunk of a proven WAV."""
    p = at + 12
    while value[p : p + 4] != b"data":
        n = struct.unpack("<I", value[p + 4 : p + 8])[0]
        p += 8 + n + n % 2
    return value[p + 8 : p + 8 + struct.unpack("<I", value[p + 4 : p + 8])[0]]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every whole text as 8-bit samples (a WAV declared as raw bytes), sniff it, and read the samples back.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, detected_type,
    corrected. A null text counts as empty. Equal texts give equal values. The feature holds the type, the number of
    media carved inside, and sums of the samples: mean, deviation, zero crossings about the mean, and peak.
    """
    kind = docs.schema[key].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected_type", "corrected"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for t in batch.column("text").to_pylist():
                n, payload = payload_of(t)
                value = wav(payload)
                media = media_in(value)
                at, length, found = media[0] if media else (1, 0, "application/octet-stream")
                if at:
                    raise ValueError("a stored value doesn't prove its format")
                back = wav_samples(value, at, length)
                inside = media_in(back)
                x = np.frombuffer(back, np.uint8).astype(np.int64)
                mean = x.sum() / len(x)
                above = x > mean
                feature = f"{found};inside={len(inside)};mean={mean:.4f};dev={np.sqrt(max(0.0, (x * x).sum() / len(x) - mean * mean)):.4f};cross={np.count_nonzero(above[1:] != above[:-1])};peak={x.max()}"
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(value), hashlib.sha256(value).hexdigest(), feature, found, found != "application/octet-stream"))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected_type string, corrected boolean"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(store, schema).withColumnRenamed("key", key)
