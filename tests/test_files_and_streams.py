"""Scanned PDFs to pixels, pages to PNG, and states of assignments on a stream."""

import random
import re
import struct
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkledger import sources
from inkledger.sources import pdf, png
from inkledger.streaming import states


def pdf_of(objects, cross="table", trailer=b"", packed=()):
    """A file of objects (number: bytes); ``packed`` numbers go to an object stream."""
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\n"), {}
    objects = dict(objects)
    if packed:
        bodies, head, at = b"", b"", 0
        for n in packed:
            body = objects.pop(n) + b" "
            head += b"%d %d " % (n, at)
            bodies, at = bodies + body, at + len(body)
        raw = zlib.compress(head + bodies)
        objects[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(packed), len(head), len(raw)) + raw + b"\nendstream"
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    if cross == "table":
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in places.items())
        out += b"trailer\n<< /Root 1 0 R /Size 99 %s >>\n" % trailer
    elif cross == "stream":
        rows = [(0, 0, 0)] * 100
        for n, at in places.items():
            rows[n] = (1, at, 0)
        for k, n in enumerate(packed):
            rows[n] = (2, 90, k)
        rows[99] = (1, start, 0)
        table = np.array([[kind, *at.to_bytes(3, "big"), k] for kind, at, k in rows], np.uint8)
        up = np.vstack([table[:1], table[1:] - table[:-1]]).astype(np.uint8)
        raw = zlib.compress(np.hstack([np.full((100, 1), 2, np.uint8), up]).tobytes())
        out += b"99 0 obj\n<< /Type /XRef /Size 100 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d %s >>\nstream\r\n" % (len(raw), trailer) + raw + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def image(width, height, raw, space=b"/DeviceGray", bits=8, more=b"", coding=b"/Filter /FlateDecode"):
    data = zlib.compress(raw) if b"Flate" in coding else raw
    return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent %d %s %s /Length %d >>\nstream\n" % (width, height, space, bits, coding, more, len(data)) + data + b"\nendstream"


def one_page(x, **options):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /XObject << /Im#31 4 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Note (a \\) [ << text) >>", 4: x}
    return pdf_of(objects | options.pop("extra", {}), **options)


def png_rows(pixels, step, kinds):
    """Bytes with PNG's filters, one kind a row."""
    out, up = b"", [0] * len(pixels[0])
    for kind, row in zip(kinds, pixels, strict=False):
        line = []
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
            line.append((x - guess) % 256)
        out += bytes([kind, *line])
        up = row
    return out


def pixels_in(spark, files):
    rows = spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b in files.items()], "path string, content binary")
    out, status = {}, {}
    for r in pdf.pixel_rows(pdf.page_images(rows)).collect():
        status[r.path] = r.ingest_status
        if r.grey is not None:
            out.setdefault((r.path, r.page, r.number), {})[r.y] = r.grey
    return {k: [v[y] for y in range(len(v))] for k, v in out.items()}, status


def test_images_of_pdfs(spark):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (9, 7))
    rgb = rng.integers(0, 256, (5, 4, 3))
    mixed = ((rgb * [4899, 9617, 1868]).sum(2) + 8192) >> 14
    ones = rng.integers(0, 2, (6, 11))
    fours = rng.integers(0, 16, (4, 5))
    packed4 = b"".join(bytes(int(a) << 4 | int(b) for a, b in zip(r[::2], [*r[1::2], 0], strict=True)) for r in fours)
    table = rng.integers(0, 256, (16, 3))
    kinds = [0, 1, 2, 3, 4, 4, 3, 2, 1]
    left = np.diff(rgb.reshape(5, 4, 3), axis=1, prepend=0).astype(np.uint8)
    files = {
        "plain": one_page(image(7, 9, grey.astype(np.uint8).tobytes(), coding=b"")),
        "flate": one_page(image(7, 9, grey.astype(np.uint8).tobytes())),
        "stream": one_page(image(7, 9, grey.astype(np.uint8).tobytes()), cross="stream"),
        "packed": one_page(image(7, 9, grey.astype(np.uint8).tobytes()), cross="stream", packed=(1, 2, 3)),
        "png": one_page(image(7, 9, png_rows(grey.tolist(), 1, kinds), more=b"/DecodeParms << /Predictor 15 /Columns 7 >>")),
        "png rgb": one_page(image(4, 5, png_rows(rgb.reshape(5, 12).tolist(), 3, [4, 3, 1, 2, 4]), b"/DeviceRGB", more=b"/DecodeParms << /Predictor 15 /Columns 4 /Colors 3 >>")),
        "tiff": one_page(image(4, 5, left.tobytes(), b"/DeviceRGB", more=b"/DecodeParms [<< /Predictor 2 /Columns 4 /Colors 3 >>]")),
        "icc": one_page(image(4, 5, rgb.astype(np.uint8).tobytes(), b"[/ICCBased 5 0 R]"), extra={5: b"<< /N 3 /Length 1 >>\nstream\nx\nendstream"}),
        "bits": one_page(image(11, 6, np.packbits(ones, axis=1).tobytes(), bits=1)),
        "mask": one_page(image(11, 6, np.packbits(ones, axis=1).tobytes(), bits=1, more=b"/ImageMask true /Decode [1 0]")),
        "indexed": one_page(image(5, 4, packed4, b"[/Indexed /DeviceRGB 15 5 0 R]", bits=4), extra={5: b"<" + bytes(table.astype(np.uint8)).hex().encode() + b">"}),
        "length elsewhere": one_page(image(7, 9, grey.astype(np.uint8).tobytes()).replace(b"/Length ", b"/Length 5 0 R /Was "), extra={5: b"%d" % len(zlib.compress(grey.astype(np.uint8).tobytes()))}),
        "no cross table": one_page(image(7, 9, grey.astype(np.uint8).tobytes()), cross="none"),
        "bad places": re.sub(rb"\d{10} 00000 n", b"0000000007 00000 n", one_page(image(7, 9, grey.astype(np.uint8).tobytes()))),
        "cut": one_page(image(7, 9, grey.astype(np.uint8).tobytes()))[:-60],
    }
    got, status = pixels_in(spark, files)
    three = ((table * [4899, 9617, 1868]).sum(1) + 8192) >> 14
    want = dict.fromkeys(("plain", "flate", "stream", "packed", "png", "length elsewhere", "no cross table", "bad places", "cut"), grey) | dict.fromkeys(("png rgb", "tiff", "icc"), mixed) | {"bits": ones * 255, "mask": 255 - ones * 255, "indexed": three[fours]}
    assert {k: set(v.split(":")[0] for v in status.values()) for k in ("x",)} == {"x": {"ok"}}, status
    for name, pixels in want.items():
        assert got[name, 1, 1] == pixels.tolist(), name
    rows = spark.createDataFrame([("a", bytearray(files["png rgb"])), ("b", bytearray(files["bits"]))], "path string, content binary")
    sizes = {r.page: (r["count(1)"], r.w) for r in pdf.scanned_pages(pdf.pixel_rows(pdf.page_images(rows))).groupBy("page").agg(F.count("*"), F.max(F.size("grey")).alias("w")).collect()}
    assert sizes == {"a#1": (5, 4), "b#1": (6, 11)}


def test_pages_and_their_images_in_order(spark):
    small, large = image(1, 1, b"\x07"), image(2, 2, b"\x01\x02\x03\x04")
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 6 0 R 2 0 R] /Count 3 /Resources << /XObject << /A 4 0 R /B 5 0 R >> >> >>", 3: b"<< /Type /Page >>", 4: small, 5: large,
        6: b"<< /Type /Pages /Kids [7 0 R 8 0 R] >>", 7: b"<< /Type /Page /Resources << /XObject << /C 4 0 R >> >> >>", 8: b"<< /Type /Page /Resources << >> >>",
    }
    got, status = pixels_in(spark, {"f": pdf_of(objects)})
    assert got == {("f", 1, 1): [[7]], ("f", 1, 2): [[1, 2], [3, 4]], ("f", 2, 1): [[7]]} and status == {"f": "ok"}
    rows = spark.createDataFrame([("f", bytearray(pdf_of(objects)))], "path string, content binary")
    assert sorted((r.page, r.y, tuple(r.grey)) for r in pdf.scanned_pages(pdf.pixel_rows(pdf.page_images(rows))).collect()) == [("f#1", 0, (1, 2)), ("f#1", 1, (3, 4)), ("f#2", 0, (7,))]


def test_broken_files_are_told(spark):
    good = one_page(image(7, 9, bytes(63)))
    loop = pdf_of({1: b"1 0 R"})
    files = {
        "empty": b"", "null": None, "text": b"no pdf", "header": b"%PDF-1.4\n", "root": pdf_of({1: b"<< /Pages 2 0 R >>"}), "loop": loop, "encrypted": one_page(image(1, 1, b"x"), trailer=b"/Encrypt 9 0 R"), "jpeg": one_page(image(1, 1, b"x", coding=b"/Filter /DCTDecode")),
        "colours": one_page(image(1, 1, b"x", b"/DeviceCMYK")), "short": one_page(image(70, 90, b"x")), "junk": good.replace(b"/FlateDecode", b"/FlateDecode /Width (") if b"/FlateDecode" in good else good, "nested": b"%PDF-1.4\n1 0 obj " + b"[" * 5000, "flate": one_page(image(7, 9, b"").replace(zlib.compress(b""), b"notflate")),
    }
    got, status = pixels_in(spark, files)
    assert got == {} and set(status) == set(files) and "ok" not in status.values(), status
    assert status["null"] == "no content" and "encrypted" in status["encrypted"] and "DCTDecode" in status["jpeg"] and "no images" in status["root"] and "broken" in status["text"] and "CMYK" in status["colours"]
    rng = random.Random(5)
    for _ in range(300):  # damaged bytes never stop a job
        bad = bytearray(one_page(image(7, 9, bytes(63)), cross=rng.choice(["table", "stream", "none"])))
        for _ in range(rng.randint(1, 12)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        for row in pdf.images_of("f", bytes(bad[: rng.randint(0, len(bad))] if rng.random() < 0.3 else bad)):
            assert len(row) == 15 and row[-1]


def plain_png(data):
    assert data[:8] == png.SIGNATURE
    at, body = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", part)
            assert rest == [8, 0, 0, 0, 0]
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(pdf.unpredicted(zlib.decompress(body), 15, width, 1, 8), np.uint8).reshape(height, width).tolist()


def test_pngs_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    pages = {0: rng.integers(0, 256, (5, 7)), 1: np.tile(np.arange(40), (30, 1)), 2: np.repeat(np.arange(9), 4).reshape(9, 4), 3: np.array([[9]]), 4: np.cumsum(rng.integers(-2, 3, (20, 30)), axis=1) + 100}
    rows = spark.createDataFrame([(k, y, r.tolist()) for k, p in pages.items() for y, r in enumerate(p)] + [(7, 0, []), (8, 1, None)], "page long, y int, grey array<int>")
    files = png.page_pngs(rows)
    png.write_pngs(files, str(tmp_path / "out"))
    assert {p.name: plain_png(p.read_bytes()) for p in (tmp_path / "out").iterdir()} == {f"page_{k}.png": p.tolist() for k, p in pages.items()}
    png.write_pngs(files.where("page = 1"), str(tmp_path / "out"), "append")
    png.write_pngs(files.where("page = 3"), str(tmp_path / "out"), "overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["page_3.png"]


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select("id", F.lit(b"x").alias("png")).repartition(4)
    bad = rows.select(F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("page"), "png")
    with pytest.raises(Exception, match="stop"):
        png.write_pngs(bad, str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*")] == []


def events_of(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(12):
        at = start + timedelta(hours=i)
        rows.append((i, at, "submitted", None, at))
        for _ in range(rng.randint(0, 2)):
            at += timedelta(hours=rng.choice([0, 1, 5]))
            rows.append((i, at, "reviewing", None, None))
            if rng.random() < 0.6:
                at += timedelta(hours=rng.choice([0, 2]))
                rows.append((i, at, "scored", float(rng.randint(0, 10)), None))
                if rng.random() < 0.4:
                    at += timedelta(hours=1)
                    rows.append((i, at, "submitted", None, at))
    rows = list(dict.fromkeys(rows))
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "id long, at timestamp, status string, score double, submitted_at timestamp")
    have = {f.name for f in events.schema.fields}
    return events.select("id", "at", *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in sources.STATE.split(", "))])


def told_by(spark, tmp_path, batches, late, patience):
    """All updates of a stream whose batches are one file each, in turn."""
    import os

    (tmp_path / "all").mkdir()
    for n, part in enumerate(batches):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        (file,) = (tmp_path / "in" / f"{n}").glob("*.parquet")
        target = tmp_path / "all" / f"{n}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    told = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.PROVIDER)
    try:
        stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
        query = states.assignment_states(stream, late, patience).writeStream.outputMode("update").foreachBatch(lambda df, n: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return told


def later(spark, day):
    return spark.range(1).select(F.lit(99).cast("long").alias("id"), F.lit(day).cast("timestamp").alias("at"), *[F.lit("submitted" if n == "status" else None).cast(t).alias(n) for n, t in (f.split() for f in sources.STATE.split(", "))])


def test_states_on_a_stream(spark, tmp_path):
    """Events in any order over three batches give the states of all events at once."""
    events = events_of(spark, 3).coalesce(1)
    told = told_by(spark, tmp_path, [*events.randomSplit([1.0, 1.0, 1.0], 7), later(spark, "2024-06-01")], "400 days", 3_600_000)
    fields = ("at", "status", "score", "flags", "submitted_at")
    last = {r.id: r for r in told if r.kind == "state" and r.id != 99}
    want = {r.id: r for r in sources.current(events).collect()}
    assert {k: tuple(r[f] for f in fields) for k, r in last.items()} == {k: tuple(r[f] for f in fields) for k, r in want.items()}
    assert len(told) > len(want) + 1 and all(r.kind == "state" for r in told)


def test_reviews_that_never_end_are_told(spark, tmp_path):
    events = events_of(spark, 3)
    stuck = {r.id for r in sources.current(events).where("status = 'reviewing'").collect()}
    batches = [events.where("at < '2024-01-01 06:00:00'"), events.where("at >= '2024-01-01 06:00:00'"), later(spark, "2024-06-01"), later(spark, "2024-06-02")]
    told = told_by(spark, tmp_path, batches, "1 day", 30 * 86_400_000)
    alarms = [r.id for r in told if r.kind == "alarm"]
    assert stuck and sorted(alarms) == sorted(stuck) and all(r.status == "reviewing" for r in told if r.kind == "alarm")
