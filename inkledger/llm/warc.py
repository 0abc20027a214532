"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Records are rows (RECORD below). ``read_records`` parses WARC files (plain or gzip members) from any store Spark reads,
``responses`` makes response records of a page table, ``derive`` gives two records for each response that refer to its
identifier, and ``serialized`` adds the bytes of a record as they stand in a file.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

RECORD = "record_id string, record_type string, refers_to string, target_uri string, record_date string, content_type string, block binary, block_digest string, payload_digest string, headers map<string,string>"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:derivatives")
EPOCH = "1970-01-01T00:00:00Z"
OPENS = re.compile(r"<!--|<(script|style|template|noscript)(?=[\s/>])", re.I)
CLOSES = {k: re.compile(rf"</{k}(?=[\s/>])", re.I) for k in ("script", "style", "template", "noscript")}
BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|nav|header|footer|main|blockquote|pre|title|head|body|html|hr|dd|dt|dl|form|figure|aside)\b[^>]*>", re.I)
TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
TITLE, TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title", re.I)
ANCHOR, HREF = re.compile(r"<a\b[^>]*>", re.I), re.compile(r"\bhref\s*=\s*[\"']?[^\"'\s>]", re.I)
HTML, LANG = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")
CHUNK_SIZE = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;|$)")


def digest(value: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(value).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def visible(page: str) -> str:
    """The page with a blank for each comment and hidden element; one that is not closed hides all that follows.

    One pass: the text is read on from where an element ends, and a kind of element whose end was once not found hides
    the rest, so no part of a page is searched twice.
    """
    out, at = [], 0
    while (m := OPENS.search(page, at)) is not None:
        out.append(page[at : m.start()])
        if m[1] is None:
            end = page.find("-->", m.end())
            end = end + 3 if end >= 0 else -1
        else:
            closing = CLOSES[m[1].lower()].search(page, m.end())
            end = page.find(">", closing.end()) + 1 if closing else 0
            end = end or -1
        if end < 0:
            return " ".join(out)
        at = end
    return " ".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """Visible text: hidden elements and tags go, block elements break lines, entities are read, blanks are joined."""
    x, rest = closed(visible(page).replace("\n", " "))
    x = TAG.sub("", BREAK.sub("\n", x)) + rest
    x = html.unescape(x) if "&" in x else x
    return LINES.sub("\n", BLANKS.sub(" ", x)).strip()


def closed(page: str) -> tuple[str, str]:
    """The page up to its last tag end, and the rest: in the first part every tag ends, so patterns of tags read it once."""
    at = page.rfind(">") + 1
    return page[:at], page[at:]


def outlinks(page: str) -> int:
    return sum(HREF.search(tag) is not None for tag in ANCHOR.findall(closed(page)[0]))


def language_of(page: str) -> str:
    tag = HTML.search(closed(page)[0])
    lang = LANG.search(tag[0]) if tag else None
    return lang[1] if lang else ""


def title_of(page: str) -> str:
    """Text of the first title, in one line; one that is not closed is none."""
    m = TITLE.search(closed(page)[0])
    end = TITLE_END.search(page, m.end()) if m else None
    return BLANKS.sub(" ", html.unescape(page[m.end() : end.start()]).replace("\n", " ")).strip() if end else ""


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; what is no chunk ends it, and a body without any chunk stays as it is.

    The line of a chunk's size may be of any length; its extensions are not read.
    """
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = CHUNK_SIZE.match(body, at, end)
        if not size:
            break
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else body


def opened(body: bytes, headers: dict[str, str]) -> tuple[bytes, str]:
    """The payload without its transfer and content encodings, and the coding that could not be opened, if any.

    A body that begins like a page despite its coding is taken as sent plain.
    """
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for coding in reversed([c.strip().lower() for c in headers.get("content-encoding", "").split(",")]):
        if coding in ("", "identity"):
            continue
        plain = None
        if coding in ("gzip", "x-gzip", "deflate"):
            plain = inflated(body, 47) if coding != "deflate" or body[:1] == b"\x78" else inflated(body, -15)
        if plain is None:
            return body, "" if body.lstrip()[:1] == b"<" else coding
        body = plain
    return body, ""


def decoded(body: bytes, headers: dict[str, str]) -> bytes:
    """The payload without its encodings; what cannot be opened stays as far as it was."""
    return opened(body, headers)[0]


def inflated(body: bytes, bits: int) -> bytes | None:
    """All members of a compressed body; a cut one gives what it holds, None if nothing can be read."""
    out, data = [], memoryview(body)
    try:
        while data:
            d = zlib.decompressobj(bits)
            out.append(d.decompress(data))
            data = data[len(data) - len(d.unused_data) :] if d.eof else data[:0]
    except zlib.error:
        return b"".join(out) if out else None
    return b"".join(out)


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (lower-case names, repeats joined by a comma) and payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        return "", {}, block
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return lines[0], headers, body


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A response record for each page row, with the key first.

    The identifier is made of key, address and payload digest, so repeated rows give equal records and runs agree.
    A null address stays null, a null page is an empty payload.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "page"):
            rows = []
            for k, u, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = (h or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                rows.append((k, urn("response", str(k), str(u), digest(body)), "response", None, u, EPOCH, "application/http; msgtype=response", block, digest(block), digest(body), {}))
            yield batch_of(rows, batch.schema.field(0).type, key)

    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page")).mapInArrow(run, f"`{key}` {kind}, {RECORD}")


def batch_of(rows: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    s, b = pa.string(), pa.binary()
    kinds = [kind, s, s, s, s, s, s, b, s, s, pa.map_(s, s)]
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if i == 10 else c, k) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))], [key, *(f.split()[0] for f in RECORD.split(", ") if " " in f)])


def derive(records: DataFrame, key: str) -> DataFrame:
    """Two records for each response: ``metadata`` (warc-fields) and ``conversion`` (text/plain).

    Both refer to the response's identifier and keep its address and date. The metadata record lists the source headers,
    source digests, title, language, number of links and the identifier of the conversion record; digests are of the
    source as it was sent, its text is read after chunked, gzip and deflate codings are undone, and a body under another
    coding gives empty text and a field ``source-coding-left``; the conversion record holds the plain text, with digests of
    its own and the source payload's digest among its headers. A response that is not HTML gives empty text. Records of other types give nothing; null blocks count as empty, and a missing identifier
    is made anew from the block.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block"):
            rows = []
            for r in batch.to_pylist():
                block = r["block"] or b""
                status, headers, body = split_http(block)
                source = r["record_id"] or urn("response", str(r["target_uri"]), digest(block))
                block_digest, payload_digest = r["block_digest"] or digest(block), r["payload_digest"] or digest(body)
                kind_of = headers.get("content-type", "text/html")
                charset = re.search(r"charset=\"?([\w-]+)", kind_of, re.I)
                payload, left = opened(body, headers)
                try:
                    page = payload.decode(charset[1] if charset else "utf-8", "replace")
                except LookupError:
                    page = payload.decode("utf-8", "replace")
                is_html = "html" in kind_of.lower() and not left
                text = plain_text(page).encode() if is_html else b""
                title, lang, links = (title_of(page), language_of(page), outlinks(page)) if is_html else ("", "", 0)
                own, meta = urn("conversion", source, digest(text)), urn("metadata", source)
                date, uri = r["record_date"] or EPOCH, r["target_uri"]
                lines = [("source-record-id", source), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-status", status)]
                lines += [(f"source-header-{n}", v) for n, v in sorted(headers.items())]
                lines += [("source-coding-left", left)] if left else []
                lines += [("title", title), ("language", lang), ("outlinks", str(links)), ("conversion-record-id", own)]
                fields = "".join(f"{n}: {v}\r\n" for n, v in lines).encode()
                rows.append((r[key], meta, "metadata", source, uri, date, "application/warc-fields", fields, digest(fields), payload_digest, {"WARC-Concurrent-To": own}))
                rows.append((r[key], own, "conversion", source, uri, date, "text/plain; charset=utf-8", text, digest(text), digest(text), {"WARC-Source-Payload-Digest": payload_digest, "WARC-Concurrent-To": meta}))
            yield batch_of(rows, batch.schema.field(key).type, key)

    return records.where(F.col("record_type") == "response").select(key, *(f.split()[0] for f in RECORD.split(", ") if " " in f)).mapInArrow(run, f"`{key}` {kind}, {RECORD}")


def record_bytes(r: dict) -> bytes:
    """A record in WARC 1.1 form."""
    block = r["block"] or b""
    head = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["record_date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Payload-Digest", r["payload_digest"]), *sorted(dict(r["headers"] or {}).items()), ("Content-Type", r["content_type"]), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def serialized(records: DataFrame) -> DataFrame:
    """Add ``warc_record``, the record's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([record_bytes(r) for r in batch.to_pylist()], pa.binary())], [*batch.schema.names, "warc_record"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return records.mapInArrow(run, StructType([*records.schema.fields, StructField("warc_record", BinaryType())]))


OWN = ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-refers-to", "warc-block-digest", "warc-payload-digest", "content-type", "content-length")


def parse(data: bytes) -> Iterator[dict]:
    """Records of plain bytes, one after another."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        named = {}
        for line in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
            n, _, v = line.partition(":")
            named[n.strip()] = v.strip()
        low = {k.lower(): v for k, v in named.items()}
        size = int(low["content-length"]) if low.get("content-length", "").isdigit() else 0
        block = data[head_end + 4 : head_end + 4 + size]
        yield {"record_id": low.get("warc-record-id"), "record_type": low.get("warc-type"), "refers_to": low.get("warc-refers-to"), "target_uri": low.get("warc-target-uri"), "record_date": low.get("warc-date"), "content_type": low.get("content-type"), "block": block, "block_digest": low.get("warc-block-digest"), "payload_digest": low.get("warc-payload-digest"), "headers": {k: v for k, v in named.items() if k.lower() not in OWN}}
        at = head_end + 4 + size


def members(data: bytes) -> Iterator[bytes]:
    """A gzip file's members one by one, each opened alone and read without a copy of the rest; plain bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while data[at : at + 2] == b"\x1f\x8b":
        d, out, p = zlib.decompressobj(31), [], at
        while not d.eof and p < len(data):
            piece = view[p : p + (1 << 18)]
            out.append(d.decompress(piece))
            p += len(piece)
        if not d.eof:
            return  # a cut member
        at = p - len(d.unused_data)
        yield b"".join(out)


def read_records(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of all WARC files under a path, with the file as key; one file is read by one task.

    A gzip file is opened member by member and records go on in batches of about ``batch_bytes``, so the task holds the
    file as it is stored (at most 2 GB, Spark's limit of a binary value; larger crawl files must be cut where they are
    written) and one member, not the opened file.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for part in members(value.as_py()):
                    for r in parse(part):
                        rows.append((name, *r.values()))
                        held += len(r["block"])
                        if held > batch_bytes:
                            yield batch_of(rows, pa.string(), "file")
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows, pa.string(), "file")

    return files.mapInArrow(run, f"file string, {RECORD}")


def page_derivatives(pages: DataFrame) -> DataFrame:
    """The corpus query: both derivative records of every page, their text as columns."""
    out = derive(responses(pages), "page_id")
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "record_date", "content_type", F.octet_length("block").cast("long").alias("content_length"), "block_digest", "payload_digest", F.col("headers")["WARC-Concurrent-To"].alias("concurrent_to"), F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"), F.decode("block", "UTF-8").alias("block_text"))
