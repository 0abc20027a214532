"""Page images as PNG: encoding of grey rows, and a sink that either writes all pages of a job or none."""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(pixels: np.ndarray) -> np.ndarray:
    """Rows of bytes with their filter in front: of the five that with the least sum of differences, the first of equals."""
    x = pixels.astype(np.int64)
    left, up = np.pad(x, ((0, 0), (1, 0)))[:, :-1], np.pad(x, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(x, ((1, 0), (1, 0)))[:-1, :-1]
    p = left + up - corner
    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    each = np.stack([x, x - left, x - up, x - (left + up) // 2, x - nearest]) % 256
    best = np.where(each < 128, each, 256 - each).sum(2).argmin(0)
    return np.concatenate([best[:, None], each[best, np.arange(len(x))]], axis=1).astype(np.uint8)


def encoded(pixels: np.ndarray) -> bytes:
    """An 8-bit grey image."""
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered(pixels).tobytes(), 6)) + chunk(b"IEND", b"")


def page_pngs(rows: DataFrame) -> DataFrame:
    """(page, png) of grey rows (page, y, grey); one task encodes one page. Short rows go on with white; rows without pixels are left out."""
    kind = rows.schema["page"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        values = [v.values.to_numpy() for v in table.column("grey")]
        page = np.full((len(values), max(map(len, values))), 255, np.uint8)
        for row, v in zip(page, values, strict=True):
            row[: len(v)] = v
        return pa.table({"page": table.column("page").slice(0, 1), "png": pa.array([encoded(page)], pa.binary())})

    return rows.where("size(grey) > 0 AND y IS NOT NULL").select("page", "y", "grey").groupBy("page").applyInArrow(run, f"page {kind}, png binary")


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its files, by their final names."""

    files: list[tuple[str, str]]


class PngWriter(DataSourceWriter):
    """Files are written to a folder of the job and get their names when all tasks are done; an aborted job's folder goes.

    The driver makes the folder, and tasks write nowhere else: one that still runs when the job is aborted finds it gone.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.folder = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"
        store, root = self._store()
        store.create_dir(f"{root}/{self.folder}", recursive=True)

    def _store(self):
        from pyarrow.fs import FileSystem, LocalFileSystem

        return FileSystem.from_uri(self.path) if "://" in self.path else (LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Written:
        store, root = self._store()
        own = f"{root}/{self.folder}/{uuid.uuid4().hex}"  # an attempt that is run again writes elsewhere
        store.create_dir(own, recursive=False)
        files = []
        for n, row in enumerate(iterator):
            with store.open_output_stream(f"{own}/{n}.png") as out:
                out.write(bytes(row.png))
            files.append((f"{own}/{n}.png", f"{root}/page_{row.page}.png"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        store, root = self._store()
        if self.overwrite:
            for old in store.get_file_info(FileSelector(root)):
                if old.base_name.startswith("page_") and old.base_name.endswith(".png"):
                    store.delete_file(old.path)
        for message in messages:
            for there, name in message.files if message else []:
                store.move(there, name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        store, root = self._store()
        for last in (False, False, False, False, True):  # a task may be writing its last file
            try:
                if store.get_file_info(f"{root}/{self.folder}").type != FileType.Directory:
                    return
                store.delete_dir(f"{root}/{self.folder}")
            except OSError:
                if last:
                    raise
            time.sleep(0.5)


class PngPages(DataSource):
    """Format ``png_pages``: rows (page, png) to ``page_<page>.png`` under a path that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "png_pages"

    def schema(self) -> str:
        return "page string, png binary"

    def writer(self, schema: StructType, overwrite: bool) -> PngWriter:
        return PngWriter(self.options["path"], overwrite)


def write_pngs(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Write (page, png), a file for each page, all or none; ``overwrite`` removes the pages that are there."""
    spark: SparkSession = pages.sparkSession
    spark.dataSource.register(PngPages)
    pages.select(F.col("page").cast("string").alias("page"), "png").write.format("png_pages").mode(mode).option("path", path).save()
