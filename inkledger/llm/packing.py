"""Variable-capacity best-fit packing of token sequences.

Texts are cut into pieces no longer than the largest permitted length. Pieces are dealt to shards by a hash of the row's
number, about ``rows_per_shard`` to each whatever the input or its ids, and a shard is packed longest first: a piece goes to the open bin with
the least room that still takes it. If none does, a bin is opened, of the permitted length whose cost for each token is
least once filled greedily with what is left in the shard. At the end every bin shrinks to the smallest permitted
length that holds its contents. No token is dropped, whatever its text's length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import BLANK, durable


@dataclass(frozen=True)
class Settings:
    lengths: tuple[int, ...] = (256, 512, 1024, 2048, 4096)
    overhead: int = 16  # cost of a bin besides its length, in tokens
    attention: int = 16_384  # the length at which attention costs as much as all else
    rows_per_shard: int = 50_000

    def cost(self, length: int) -> float:
        return length * (1 + length / self.attention) + self.overhead


class Left:
    """The pieces not yet packed, as counts by length, with a greedy look-ahead."""

    def __init__(self, sizes: np.ndarray):
        values, counts = np.unique(sizes, return_counts=True)
        self.values, self.counts = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            del self.counts[size]
            del self.values[bisect_left(self.values, size)]

    def fill(self, room: int) -> int:
        """Tokens that would go into a room, longest first."""
        start, i = room, len(self.values)
        while room > 0 and (i := bisect_left(self.values, room + 1, 0, i) - 1) >= 0:
            v = self.values[i]
            room -= v * min(self.counts[v], room // v)
        return start - room


def pack(sizes: np.ndarray, z: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, in the given order (longest first), and each bin's final length."""
    lengths = sorted(z.lengths)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (room, bin) of open bins
    capacity: list[int] = []
    left, smallest = Left(sizes), int(sizes[-1]) if len(sizes) else 0
    for i, size in enumerate(sizes.tolist()):
        left.take(size)
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(capacity)
            free = min((x for x in lengths if x >= size), key=lambda x: (z.cost(x) / (size + left.fill(x - size)), x))
            capacity.append(free)
        bins[i], offsets[i] = b, capacity[b] - free
        if free - size >= max(smallest, 1):
            insort(room, (free - size, b))
    used = np.zeros(len(capacity), np.int64)
    np.maximum.at(used, bins, offsets + sizes)
    return bins, offsets, np.array(lengths)[np.searchsorted(lengths, used)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK.replace("[", "[^", 1) + "+")), F.lit(0))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number of their own, written once, so that a lost task finds the same numbers again."""
    return durable(rows.withColumn("row", F.monotonically_increasing_id()))


def placed(sized: DataFrame, key: str, z: Settings) -> DataFrame:
    """(row, key, piece, token_start, n_tokens, bin columns) from written rows (row, key, n)."""
    most = max(z.lengths)
    count = sized.agg(F.sum(F.ceil(F.greatest(F.col("n"), F.lit(1)) / most)).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(count) // z.rows_per_shard))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1)), lambda i: F.struct(i.alias("piece"), (i.cast("long") * most).alias("token_start")))
    pieces = sized.select("row", "key", "n", F.explode(cut).alias("p")).select("row", "key", "p.piece", "p.token_start", F.least(F.lit(most).cast("long"), F.col("n") - F.col("p.token_start")).alias("n_tokens"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))
    schema = StructType([StructField("row", LongType()), StructField(key, sized.schema["key"].dataType), StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in ("token_start", "n_tokens", "bin_id", "bin_offset", "bin_tokens", "bin_length"))])

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("n_tokens", "descending"), ("key", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        table = table.take(order)
        sizes = table.column("n_tokens").to_numpy()
        some = sizes > 0
        bins, offsets, lengths = pack(sizes[some], z)
        fill = np.bincount(bins, sizes[some], len(lengths)).astype(np.int64)
        shard = table.column("shard")[0].as_py()

        def column(x: np.ndarray) -> pa.Array:
            out = np.zeros(len(sizes), np.int64)
            out[some] = x
            return pa.array(out, mask=~some)

        cols = [*(table.column(c) for c in ("row", "key", "piece", "token_start", "n_tokens")), column(bins + (shard << 32)), column(offsets), column(fill[bins]), column(lengths[bins])]
        return pa.Table.from_arrays(cols, schema.names)

    return dealt.groupBy("shard").applyInArrow(run, schema)


def pack_sequences(docs: DataFrame, key: str = "doc_id", n_tokens: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row for each piece: key, piece, token_start, n_tokens, bin_id, bin_offset, bin_tokens, bin_length.

    ``n_tokens`` gives a text's length (default: blank-separated words of ``text``). Null, empty and blank texts have no
    piece, so they give a row with piece 0, no tokens and null bin columns. Repeated rows are packed each for itself, and
    rows without a key or with one key are spread like any others. Ties between equal pieces go by key, null keys first.
    """
    n = (word_count(F.col("text")) if n_tokens is None else n_tokens).cast("long")
    return placed(numbered(docs.select(F.col(key).alias("key"), F.coalesce(n, F.lit(0)).alias("n"))), key, settings).drop("row")


def pack_token_ids(docs: DataFrame, ids: str, key: str = "doc_id", pad: int = 0, settings: Settings = Settings()) -> DataFrame:
    """The packed sequences themselves: one row for each bin of ``docs``' token ids (an array of integers).

    Columns: bin_id, bin_length, bin_tokens, input_ids (``bin_length`` ids, padded at the end), segments (array of key,
    piece, token_start, bin_offset, n_tokens in order). Rows without ids are in no bin. A bin holds at most the largest
    permitted length, so what meets in a group is bounded.
    """
    z = settings
    rows = numbered(docs.select(F.col(key).alias("key"), F.col(ids).alias("ids"), F.greatest(F.size(F.coalesce(ids, F.array())), F.lit(0)).cast("long").alias("n")))
    at = placed(rows.select("row", "key", "n"), "key", z).where(F.col("bin_id").isNotNull())
    mine = at.join(rows.select("row", "ids"), "row").select("bin_id", "bin_length", "bin_tokens", F.struct("bin_offset", "key", "piece", "token_start", "n_tokens", F.slice("ids", (F.col("token_start") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("ids")).alias("x"))
    whole = mine.groupBy("bin_id", "bin_length", "bin_tokens").agg(F.sort_array(F.collect_list("x")).alias("x"))
    filled = F.concat(F.flatten(F.transform("x", lambda x: x["ids"])), F.array_repeat(F.lit(pad), (F.col("bin_length") - F.col("bin_tokens")).cast("int")))
    segments = F.transform("x", lambda x: F.struct(x["key"].alias("key"), x["piece"].alias("piece"), x["token_start"].alias("token_start"), x["bin_offset"].alias("bin_offset"), x["n_tokens"].alias("n_tokens")))
    return whole.select("bin_id", "bin_length", "bin_tokens", filled.alias("input_ids"), segments.alias("segments"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The corpus query."""
    return pack_sequences(docs)
