"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import durable

__all__ = ["BLANK", "by_language", "cut_words", "durable", "fold", "slices", "table", "tokens"]

#: The token separators of the corpus contracts are the ASCII blanks, as ``bytes.split()`` has them.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id is in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % k, F.lit(0)).cast("int")


def tokens(text: str | None) -> list[bytes]:
    """Blank-separated words with only A-Z lowered: bytes methods touch ASCII alone."""
    return text.encode().lower().split() if text else []


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``most`` bytes of text, or a single longer row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(sizes):
            yield batch.slice(start)


def by_language(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, pa.Table]]:
    """Rows (lang, text, ...) without nulls, about ``size`` bytes of text at once, those of each language for themselves."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
        rows = pa.Table.from_batches(held)
        for lang in pc.unique(rows.column("lang")).to_pylist():
            yield lang, rows.filter(pc.equal(rows.column("lang"), lang)).combine_chunks()

    held, n = [], 0
    for batch in slices(batches, "text"):
        held.append(batch)
        n += batch.column("text").nbytes
        if n > size:
            yield from cut(held)
            held, n = [], 0
    if held:
        yield from cut(held)


def cut_words(texts: pa.ChunkedArray, alike: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: the distinct ones, and for each word in turn its number, its text and its piece.

    ``alike`` says as what each byte counts: a blank ends a word, a line feed a piece as well; a piece has a number of
    its own among all pieces of all texts. Texts are handled as one run of bytes, with arrays of a few times its size.
    """
    text = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = memoryview(text.buffers()[2])[ends[0] : ends[-1]] if len(text) and text.buffers()[2] is not None else b""
    data = np.frombuffer(bytes(raw).translate(alike), np.uint8)
    ends = ends - ends[0]
    breaks, gap = np.flatnonzero(data == 10), (data == 32) | (data == 10)
    begins = np.zeros(len(data) + 1, bool)
    begins[ends] = True
    first = np.flatnonzero(~gap & (np.r_[True, gap[:-1]][: len(gap)] | begins[:-1]))
    last = np.flatnonzero(~gap & (np.r_[gap[1:], True][: len(gap)] | begins[1:]))
    cuts = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first + 1, out=cuts[1:])
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data[~gap])]).dictionary_encode()
    row = np.searchsorted(ends[1:], first, "right")
    return words.dictionary, words.indices.to_numpy(), row, row + np.searchsorted(breaks, first)
