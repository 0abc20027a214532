"""Scanned PDFs: from files to the images on their pages, and from images to rows of pixels.

``page_images`` reads the structure of a file (cross tables and streams, object streams, the tree of pages) and hands on
each page's images as they are stored; ``pixel_rows`` opens them, each image in a task of its own. Flate with predictors
and plain data are read; other codings, encrypted and broken files are told by ``ingest_status``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "path string, page int, number int, width int, height int, bits int, colours int, inverted boolean, filter string, predictor int, columns int, samples int, palette binary, data binary, ingest_status string"
TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\r\n]*[\0\t\n\f\r ]*)*(<<|>>|\[|\]|\(|<|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+|[{})>])")
REFERENCE = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
OBJECT = re.compile(rb"(?:^|[\0\t\n\f\r ])(\d{1,9})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![a-z])")
MOST_DEPTH, MOST_BYTES = 60, 1 << 30


class Broken(ValueError):
    """What makes a file unreadable."""


class Ref(int):
    """The number of an object."""


def value_at(data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
    """The value that begins at a place, and where it ends. Names are strings with a slash, texts are bytes."""
    m = TOKEN.match(data, at)
    if not m or depth > MOST_DEPTH:
        raise Broken("value")
    t, at = m[1], m.end()
    if t == b"<<":
        out = {}
        while True:
            key, at = value_at(data, at, depth + 1)
            if key == ">>":
                return out, at
            out[key], at = value_at(data, at, depth + 1)
    if t == b"[":
        items = []
        while True:
            item, at = value_at(data, at, depth + 1)
            if item == "]":
                return items, at
            items.append(item)
    if t in (b">>", b"]"):
        return t.decode(), at
    if t == b"(":
        return text_at(data, at)
    if t == b"<":
        end = data.find(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end] if end >= 0 else data[at:])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), (end + 1 if end >= 0 else len(data))
    if t[:1] == b"/":
        return "/" + re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]).decode("latin-1"), at
    if re.fullmatch(rb"[+-]?\d+", t):
        if t.isdigit() and (r := REFERENCE.match(data, at)):
            return Ref(t), r.end()
        return int(t), at
    if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", t):
        return float(t), at
    return {b"true": True, b"false": False, b"null": None}.get(t, t.decode("latin-1")), at


def text_at(data: bytes, at: int) -> tuple[bytes, int]:
    """A text in parentheses, with its escapes as they are: they matter to nothing here."""
    start, open_ = at, 1
    for m in re.compile(rb"\\.|[()]", re.S).finditer(data, at):
        open_ += (m[0] == b"(") - (m[0] == b")")
        if not open_:
            return data[start : m.start()], m.end()
    raise Broken("text")


def inflated(data: bytes) -> bytes:
    """Flate data as far as it can be read."""
    d, out = zlib.decompressobj(), b""
    try:
        out = d.decompress(data, MOST_BYTES)
    except zlib.error:
        for i in range(0, len(data), 1024):  # a damaged end: what comes before it
            try:
                part = zlib.decompressobj() if not i else part
                out = (out if i else b"") + part.decompress(data[i : i + 1024])
            except zlib.error:
                break
    if not out and data:
        raise Broken("flate")
    return out


def unpredicted(data: bytes, predictor: int, columns: int, samples: int, bits: int) -> bytes:
    """Bytes without the differences to their left or upper neighbours."""
    if predictor < 2:
        return data
    step, line = max(1, samples * bits // 8), (columns * samples * bits + 7) // 8
    if predictor == 2:
        if bits != 8:
            raise Broken("predictor")
        rows = np.frombuffer(data[: len(data) // line * line], np.uint8).reshape(-1, columns, samples)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    rows = np.frombuffer(data[: len(data) // (line + 1) * (line + 1)], np.uint8).reshape(-1, line + 1)
    out = np.zeros((len(rows) + 1, line), np.uint8)
    for n, (kind, row) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:], strict=True), 1):
        up = out[n - 1]
        if kind == 0:
            out[n] = row
        elif kind == 1:
            out[n] = np.cumsum(np.pad(row, (0, -line % step)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:line]
        elif kind == 2:
            out[n] = row + up
        elif kind in (3, 4):
            own, above = [0] * step + row.tolist(), [0] * step + up.tolist()
            for i in range(step, line + step):
                a, b, c = own[i - step], above[i], above[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[i] = (own[i] + guess) & 255
            out[n] = own[step:]
        else:
            raise Broken("predictor")
    return out[1:].tobytes()


class File:
    """The objects of a file, found through its cross tables; where these are broken, by looking for all objects."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer, self.packed = data, {}, {}, {}
        if b"%PDF-" not in data[:1024]:
            raise Broken("no header")
        try:
            self._tables()
            if not isinstance(self.get(self.trailer.get("/Root")), dict):
                raise Broken("root")
        except (Broken, ValueError, TypeError, KeyError, IndexError, AttributeError):
            self._search()
        if "/Encrypt" in self.trailer:
            raise Broken("encrypted")

    def _tables(self) -> None:
        at = [m.start() for m in re.finditer(rb"startxref", self.data[-2048:])]
        if not at:
            raise Broken("startxref")
        todo, seen = [int(re.match(rb"\s*(\d+)", self.data[max(0, len(self.data) - 2048) + at[-1] + 9 :])[1])], set()
        while todo:
            start = todo.pop(0)
            if start in seen:
                continue
            seen.add(start)
            m = re.compile(rb"\s*xref\s+").match(self.data, start)
            own = self._plain(m.end()) if m else self._stream(start)
            self.trailer = own | self.trailer
            todo += [own[k] for k in ("/XRefStm", "/Prev") if isinstance(own.get(k), int)]

    def _plain(self, at: int) -> dict:
        head = re.compile(rb"\s*(\d+)\s+(\d+)\s*")
        while m := head.match(self.data, at):
            first, n, at = int(m[1]), int(m[2]), m.end()
            for k in range(n):
                entry = re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])").match(self.data, at)
                if not entry:
                    raise Broken("cross table")
                at = entry.end()
                if entry[3] == b"n":
                    self.places.setdefault(first + k, (int(entry[1]), -1))
        m = re.compile(rb"\s*trailer").match(self.data, at)
        if not m:
            raise Broken("trailer")
        return value_at(self.data, m.end())[0]

    def _stream(self, at: int) -> dict:
        head, data = self._object(at)
        if head.get("/Type") != "/XRef":
            raise Broken("cross stream")
        widths, raw = [int(w) for w in head["/W"]], self.opened(head, data)
        index, p = head.get("/Index") or [0, head["/Size"]], 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for k in range(n):
                cells, step = [], p
                for w in widths:
                    cells.append(int.from_bytes(raw[step : step + w], "big") if w else None)
                    step += w
                p = step
                kind = 1 if cells[0] is None else cells[0]
                if kind == 1:
                    self.places.setdefault(first + k, (cells[1], -1))
                elif kind == 2:
                    self.places.setdefault(first + k, (cells[1], cells[2] or 0))
        return head

    def _search(self) -> None:
        """All objects in the order of the file, later ones of a number replacing earlier ones."""
        self.places, self.packed, trailer = {}, {}, {}
        for m in OBJECT.finditer(self.data):
            self.places[int(m[1])] = (m.start(1), -1)
        for m in re.finditer(rb"trailer", self.data):
            try:
                own = value_at(self.data, m.end())[0]
                trailer |= own if isinstance(own, dict) else {}
            except Broken:
                continue
        for n in list(self.places):
            try:
                head, data = self._object(self.places[n][0])
            except Broken:
                continue
            if isinstance(head, dict) and head.get("/Type") == "/ObjStm":
                for k, inner in enumerate(self._inner(n)):
                    self.places.setdefault(inner, (n, k))
            if isinstance(head, dict) and head.get("/Type") == "/XRef":
                trailer = head | trailer
        if not isinstance(self.get(trailer.get("/Root")), dict):
            roots = [n for n in self.places if isinstance(x := self._quiet(n), dict) and x.get("/Type") == "/Catalog"]
            if not roots:
                raise Broken("no root")
            trailer["/Root"] = Ref(roots[-1])
        self.trailer = trailer

    def _quiet(self, n: int) -> Any:
        try:
            return self.get(Ref(n))
        except Broken:
            return None

    def _object(self, at: int) -> tuple[Any, tuple[int, int] | None]:
        """The value of the object at a place and the byte range of its stream."""
        m = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj").match(self.data, at)
        if not m:
            raise Broken("object")
        value, end = value_at(self.data, m.end())
        s = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, end)
        if not s or not isinstance(value, dict):
            return value, None
        size = self.get(value.get("/Length"))
        start = s.end()
        if not isinstance(size, int) or not re.compile(rb"\s*endstream").match(self.data, start + max(0, size)):
            found = self.data.find(b"endstream", start)
            size = (found if found >= 0 else len(self.data)) - start
        return value, (start, start + size)

    def _inner(self, n: int) -> dict[int, Any]:
        """The objects of an object stream."""
        if n not in self.packed:
            head, data = self._object(self.places[n][0])
            raw = self.opened(head, data)
            first = self.get(head["/First"])
            numbers = [int(x) for x in raw[:first].split()]
            self.packed[n] = {k: value_at(raw, first + at)[0] for k, at in zip(numbers[::2], numbers[1::2], strict=True)}
        return self.packed[n]

    def get(self, value: Any, depth: int = 0) -> Any:
        """A value, or what it refers to."""
        if not isinstance(value, Ref):
            return value
        if depth > MOST_DEPTH:
            raise Broken("references")
        at, k = self.places.get(int(value), (None, None))
        if at is None:
            return None
        return self.get(self._inner(at).get(int(value)) if k >= 0 else self._object(at)[0], depth + 1)

    def stream(self, ref: Any) -> tuple[dict, tuple[int, int]] | None:
        at, k = self.places.get(int(ref), (None, None)) if isinstance(ref, Ref) else (None, None)
        if at is None or k >= 0:
            return None
        head, data = self._object(at)
        return (head, data) if data else None

    def coding(self, head: dict) -> tuple[list[str], dict]:
        """Names of the filters and the parameters of the last one."""
        names, more = self.get(head.get("/Filter")), self.get(head.get("/DecodeParms"))
        names = names if isinstance(names, list) else [names] if names else []
        more = [self.get(m) for m in more] if isinstance(more, list) else [more]
        last = more[-1] if more and isinstance(more[-1], dict) else {}
        return [self.get(n) for n in names], {k: self.get(v) for k, v in last.items()}

    def opened(self, head: dict, data: tuple[int, int] | None) -> bytes:
        """A stream of the file's structure."""
        names, more = self.coding(head)
        if data is None or any(n not in ("/FlateDecode", "/Fl") for n in names):
            raise Broken("coding")
        raw = self.data[data[0] : data[1]]
        for _ in names:
            raw = inflated(raw)
        return unpredicted(raw, more.get("/Predictor", 1), more.get("/Columns", 1), more.get("/Colors", 1), more.get("/BitsPerComponent", 8)) if names else raw

    def pages(self) -> Iterator[dict]:
        """Pages in order, with the resources that they inherit."""
        root = self.get(self.trailer["/Root"])
        todo, seen = [(root.get("/Pages"), {})], set()
        while todo:
            ref, given = todo.pop(0)
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            given = self.get(node["/Resources"]) if "/Resources" in node else given
            kids = self.get(node.get("/Kids"))
            if isinstance(kids, list):
                todo = [(k, given) for k in kids] + todo
            else:
                yield given if isinstance(given, dict) else {}


def colours_of(file: File, space: Any) -> tuple[int, bytes | None]:
    """Samples of a pixel and the palette of a colour space, as three bytes a colour."""
    space = file.get(space)
    name = file.get(space[0]) if isinstance(space, list) and space else space
    if name in ("/DeviceGray", "/G", "/CalGray"):
        return 1, None
    if name in ("/DeviceRGB", "/RGB", "/CalRGB"):
        return 3, None
    if name == "/ICCBased":
        found = file.stream(space[1])
        n = file.get(found[0].get("/N")) if found else None
        if n in (1, 3):
            return n, None
    if name in ("/Indexed", "/I"):
        n, _ = colours_of(file, space[1])
        table = file.get(space[3])
        if isinstance(space[3], Ref) and not isinstance(table, bytes):
            table = file.opened(*file.stream(space[3]))
        rows = np.frombuffer(bytes(table), np.uint8)
        rows = rows[: len(rows) // n * n].reshape(-1, n)
        return 1, np.repeat(rows, 3 // n, axis=1).tobytes()
    raise Broken(f"colours {name}")


def images_of(path: str, data: bytes) -> list[tuple]:
    """Rows IMAGE of a file; a file without any gives one row that tells why."""
    none = (None,) * 12
    try:
        file, out, pages = File(data), [], 0
        for pages, given in enumerate(file.pages(), 1):
            objects = file.get(given.get("/XObject")) or {}
            for number, ref in enumerate(objects.values(), 1):
                found = file.stream(ref)
                if not found or found[0].get("/Subtype") != "/Image":
                    continue
                head, place = found
                try:
                    width, height = (int(file.get(head[k])) for k in ("/Width", "/Height"))
                    mask = file.get(head.get("/ImageMask")) is True
                    names, more = file.coding(head)
                    other = [n for n in names if n not in ("/FlateDecode", "/Fl")]
                    if other or len(names) > 1:
                        raise Broken(f"coding {(other or names)[0]}")
                    bits = 1 if mask else int(file.get(head["/BitsPerComponent"]))
                    n, palette = (1, None) if mask else colours_of(file, head["/ColorSpace"])
                    decode = file.get(head.get("/Decode"))
                    turned = isinstance(decode, list) and file.get(decode[0]) == 1 and palette is None
                    out.append((path, pages, number, width, height, bits, n, turned, "flate" if names else "none", more.get("/Predictor", 1), more.get("/Columns", 1), more.get("/Colors", 1), palette, data[place[0] : place[1]], "ok"))
                except (Broken, ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
                    out.append((path, pages, number, *none[1:], f"unreadable image: {e}"))
        return out or [(path, None, None, *none[1:], f"no images on {pages} pages")]
    except (Broken, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as e:
        return [(path, None, None, *none[1:], f"broken: {e}")]


def page_images(files: DataFrame) -> DataFrame:
    """IMAGE rows of files (path, content), one for each image of a page; null contents are told as such."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in IMAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = images_of(path, content.as_py()) if content.is_valid else [(path, *(None,) * 13, "no content")]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(row, fields, strict=True)], [n for n, _ in fields])

    return files.select("path", "content").mapInArrow(run, IMAGE)


def pixels_of(r: dict) -> np.ndarray:
    """Grey pixels of an image row."""
    raw = inflated(r["data"]) if r["filter"] == "flate" else r["data"]
    if r["filter"] == "flate":
        raw = unpredicted(raw, r["predictor"], r["columns"], r["samples"], r["bits"])
    width, height, bits, n = r["width"], r["height"], r["bits"], r["colours"]
    if bits not in (1, 2, 4, 8) or width < 1 or height < 1:
        raise Broken("size")
    line = (width * n * bits + 7) // 8
    if len(raw) < line * height:
        raise Broken("cut")
    rows = np.frombuffer(raw[: line * height], np.uint8).reshape(height, line)
    if bits < 8:
        parts = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        rows = parts @ (1 << np.arange(bits - 1, -1, -1))
    rows = rows[:, : width * n].astype(np.int64)
    if r["palette"] is not None:
        table = np.frombuffer(r["palette"], np.uint8).reshape(-1, 3).astype(np.int64)
        if not len(table):
            raise Broken("palette")
        three = table[np.minimum(rows, len(table) - 1)]
    else:
        rows = rows * 255 // ((1 << bits) - 1)
        rows = 255 - rows if r["inverted"] else rows
        if n == 1:
            return rows
        three = rows.reshape(height, width, 3)
    return (three[..., 0] * 4899 + three[..., 1] * 9617 + three[..., 2] * 1868 + 8192) >> 14


ROWS = "path string, page int, number int, y int, grey array<int>, ingest_status string"


def pixel_rows(images: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, page, number, y, grey, ingest_status) of the images; one that can't be read gives one row without pixels."""
    n = tasks or int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def told(r: dict, status: str) -> pa.RecordBatch:
        cells = [pa.array([r["path"]], pa.string()), *(pa.array([r[c]], pa.int32()) for c in ("page", "number")), pa.array([None], pa.int32()), pa.array([None], pa.list_(pa.int32())), pa.array([status], pa.string())]
        return pa.RecordBatch.from_arrays(cells, ["path", "page", "number", "y", "grey", "ingest_status"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["ingest_status"] != "ok":
                    yield told(r, r["ingest_status"])
                    continue
                try:
                    pixels = pixels_of(r)
                except (Broken, ValueError) as e:
                    yield told(r, f"unreadable image: {e}")
                    continue
                for s in range(0, len(pixels), 512):
                    part = pixels[s : s + 512].astype(np.int32)
                    k = len(part)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                    cells = [pa.array([r["path"]] * k, pa.string()), *(pa.array([r[c]] * k, pa.int32()) for c in ("page", "number")), pa.array(np.arange(s, s + k), pa.int32()), lists, pa.array(["ok"] * k, pa.string())]
                    yield pa.RecordBatch.from_arrays(cells, ["path", "page", "number", "y", "grey", "ingest_status"])

    dealt = images.repartition(n, F.col("path"), F.col("page"), F.col("number"))
    return dealt.mapInArrow(run, ROWS)


def scanned_pages(rows: DataFrame) -> DataFrame:
    """(page, y, grey) of the largest image of each page of each file, ``page`` being ``path#page``: what ``scans`` and ``contours`` take."""
    ok = rows.where("ingest_status = 'ok'")
    sizes = ok.groupBy("path", "page", "number").agg(F.sum(F.size("grey")).alias("pixels"))
    best = sizes.groupBy("path", "page").agg(F.max(F.struct("pixels", -F.col("number"))).alias("m")).select("path", "page", (-F.col("m.col2")).alias("number"))
    return ok.join(best, ["path", "page", "number"]).select(F.concat("path", F.lit("#"), F.col("page").cast("string")).alias("page"), "y", "grey")
