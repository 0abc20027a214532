"""All pairs of a block without a list of them: rows are dealt to tiles and each pair of tiles is a key of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, IntegralType, StructType

from ..sources import durable

TILE, PIECE = 8192, 1024  # rows of a tile (the unit of a task), of the matrices within it
ITEMS = 2_000_000  # items of a tile's rows on average; a block of long texts gets more tiles
DENSE = 1200  # items met by more pairs of a piece go through a matrix product, others are listed
SHIPPED = 2  # tiles that a row goes to at once; the other tiles of its block follow in later rounds
CHEST = 8  # tiles of a chest, which are shipped as one where results are listed and not written
HEAD = 1 << 18  # frequent items of a set that travel as short codes
BITS, RANGES = 28, 256  # a bitmap of 2^BITS bits (32 MB) tells items of one row alone; ranges that it is made in


def numbers_of(rows: DataFrame) -> DataFrame:
    """(id, number): numbers of the ids in their order, written once, so they stay the same."""
    ids = durable(rows.select("id").where("id IS NOT NULL").distinct())
    return durable(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("number")))


def to_numbers(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names, "id").withColumn("id", F.col("number")).drop("number")


def from_numbers(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Numbers back to ids; one that stands for nothing is null."""
    out = rows
    for c in columns:
        out = out.join(names.select(F.col("id").alias("_id"), F.col("number").alias(c)), c, "left").withColumn(c, F.col("_id")).drop("_id")
    return out.select(*rows.columns)


def short(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Numbers of n rows (in order of rows) as bytes of each: seven bits a byte, the last one without the eighth."""
    size = 1 + sum(((values >> (7 * k)) > 0).astype(np.int64) for k in range(1, 10))
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        m = size > k
        out[first[m] + k] = ((values[m] >> (7 * k)) & 127) | np.where(size[m] > k + 1, 128, 0)
    return binaries(out, np.bincount(rows, size, n))


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of values of these sizes, cut from the bytes."""
    cuts = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row begins (and the last ends)."""
    column = column.cast(pa.binary())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[cuts[0] : cuts[-1]], cuts - cuts[0]


def numbers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``short``, and the row of each."""
    data, cuts = bytes_of(column)
    last = np.flatnonzero(data < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    size, out = last - first + 1, np.zeros(len(last), np.int64)
    held = np.diff(np.searchsorted(last, cuts))
    for k in range(int(size.max(initial=0))):
        m = size > k
        out[m] |= (data[first[m] + k].astype(np.int64) & 127) << (7 * k)
    return out, np.repeat(np.arange(len(held)), held)


def steps(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rising numbers of each row as the first and what each adds to the one before."""
    out = values.copy()
    out[1:] -= np.where(rows[1:] == rows[:-1], values[:-1], 0)
    return out


def sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers of ``steps``."""
    total = np.cumsum(values)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return total - np.repeat(total[first] - values[first], np.diff(first, append=len(rows)))


def hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of a binary column, and the row of each."""
    data, cuts = bytes_of(column)
    return np.frombuffer(data.tobytes(), np.int64), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts) // 8)


def runs(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of n values of each row, and the row of each."""
    if n == 1:
        return values, rows
    size = max(len(values) - n + 1, 0)
    out, parts = np.zeros(size, np.uint64), values.view(np.uint64)
    for k in range(n):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25) + parts[k : k + size]
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    out, whole = (out ^ out >> np.uint64(32)).view(np.int64), rows[:size] == rows[n - 1 :][:size]
    return out[whole], rows[:size][whole]


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each row (rows in order), the row of each, and how often it occurs there."""
    values = values.copy()
    for part in np.split(values, np.flatnonzero(np.diff(rows)) + 1):
        part.sort()
    first = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])]) if len(values) else np.zeros(0, int)
    return values[first], rows[first], np.diff(first, append=len(values))


def bits_of(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The bit that an item of a block has in the bitmap."""
    return ((values.view(np.uint64) ^ block.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def packed(rows: DataFrame, block: tuple[str, ...], *sets: str, weighted: tuple[str, ...] = (), words: str | None = None, grams: dict[str, int] | None = None, skipped: tuple[int, ...] = ()) -> DataFrame:
    """``rows`` written once with their list columns ``sets`` (64-bit hashes) packed for ``by_tiles``.

    A set keeps the number of its distinct items (column ``<set>_n``) and, of its items, those that may be in another
    row of the block as well; no other item can be common to a pair, so what is computed from common items and whole
    sizes stays exact. The ``HEAD`` most frequent items of a set are short codes, others travel whole. ``weighted``
    sets may repeat items: how often each occurs is kept, and the sum of its squares over all items (``<set>_q``).
    ``grams`` are sets made of another column: runs of so many items of ``words`` without those ``skipped``.
    Which items are frequent and which bits of the bitmap two rows share is gathered by ranges; only these tables of
    fixed size pass through the driver.
    """
    rows = rows.where("id IS NOT NULL").withColumn("_b", F.xxhash64(*block))
    width, grams, skip = 1 << BITS - 8, grams or {}, np.sort(np.array(skipped, np.int64))
    given = [x for x in dict.fromkeys((*sets, words)) if x and x not in grams]
    sets = tuple(dict.fromkeys((*sets, *grams)))

    def items(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """``distinct`` of each set."""
        if grams:
            every, of = flat(batch, words)
            if len(skip):
                kept = skip[np.minimum(np.searchsorted(skip, every), len(skip) - 1)] != every
                every, of = every[kept], of[kept]
        for name in sets:
            yield name, *distinct(*(runs(every, of, grams[name]) if name in grams else flat(batch, name)))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out, met = batch.column("_b").to_numpy(zero_copy_only=False), {"range": pa.array(range(RANGES), pa.int32()), "bits": None}, []
            for name, values, at, _ in items(batch):
                met.append(bits_of(values, own[at]))
                values, times = np.unique(values, return_counts=True)
                values, times = values[times > 1], times[times > 1]
                part = (values.view(np.uint64) >> np.uint64(56)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                out |= {f"{name}_v": binaries(values[order].view(np.uint8), 8 * np.bincount(part, minlength=RANGES)), f"{name}_c": short(times[order], part[order], RANGES)}
            bits, times = np.unique(np.concatenate(met), return_counts=True)
            part = bits // width
            out["bits"] = short(steps(bits % width * 2 + (times > 1), part), part, RANGES)
            made = pa.table(out)
            yield from made.take(pa.array(np.flatnonzero(sum(np.diff(bytes_of(made.column(c))[1]) for c in made.column_names[1:])))).to_batches()

    def merged(table: pa.Table) -> pa.Table:
        values, at = numbers(table.column("bits"))
        values = sums(values, at)
        places, times = np.unique(values >> 1, return_counts=True)
        twice = np.zeros(width, bool)
        twice[places[times > 1]] = twice[values[values & 1 > 0] >> 1] = True
        out = {"range": table.column("range").slice(0, 1), "bits": pa.array([np.packbits(twice).tobytes() if twice.any() else b""], pa.binary())}
        for name in sets:
            values, place = np.unique(hashes(table.column(f"{name}_v"))[0], return_inverse=True)
            times = np.bincount(place, numbers(table.column(f"{name}_c"))[0], len(values)).astype(np.int64)
            best = np.argsort(-times, kind="stable")[: HEAD // RANGES]
            out |= {f"{name}_v": binaries(values[best].view(np.uint8), np.array([8 * len(best)])), f"{name}_c": short(times[best], np.zeros(len(best), int), 1)}
        return pa.table(out)

    told_as = "range int, bits binary, " + ", ".join(f"{n}_v binary, {n}_c binary" for n in sets)
    told = durable(rows.select("_b", *given).mapInArrow(seen, told_as).groupBy("range").applyInArrow(merged, told_as)).toArrow().sort_by("range")
    slots, bits = np.zeros(RANGES, np.int64), [np.zeros(width // 8, np.uint8)]  # ranges without a bit share the first
    for k, data in zip(told.column("range").to_pylist(), told.column("bits"), strict=True):
        if len(data.as_py()):
            slots[k] = len(bits)
            bits.append(np.frombuffer(data.as_py(), np.uint8))
    heads = {}
    for name in sets:
        values, times = hashes(told.column(f"{name}_v"))[0], numbers(told.column(f"{name}_c"))[0]
        values = values[np.argsort(-times, kind="stable")]
        order = np.argsort(values)
        heads[name] = values[order], order
    known = rows.sparkSession.sparkContext.broadcast((slots, np.stack(bits), heads))
    others = [c for c in rows.columns if c not in (*given, "_b")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, bits, heads = known.value
        for batch in batches:
            n, own = batch.num_rows, batch.column("_b").to_numpy(zero_copy_only=False)
            out = {c: batch.column(c) for c in others}
            for name, values, at, times in items(batch):
                frequent, codes = heads[name]
                place = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
                head = frequent[place] == values if len(frequent) else np.zeros(len(values), bool)
                bit = bits_of(values, own[at])
                tail = np.flatnonzero(~head & ((bits[slots[bit // width], bit % width >> 3] >> (7 - (bit & 7)) & 1) > 0))
                head = np.flatnonzero(head)
                head = head[np.lexsort((codes[place[head]], at[head]))]
                out |= {f"{name}_h": short(steps(codes[place[head]], at[head]), at[head], n), f"{name}_t": binaries(values[tail].view(np.uint8), 8 * np.bincount(at[tail], minlength=n)), f"{name}_n": pa.array(np.bincount(at, minlength=n), pa.int32())}
                if name in weighted:
                    out |= {f"{name}_hw": short(times[head], at[head], n), f"{name}_tw": short(times[tail], at[tail], n), f"{name}_q": np.bincount(at, times.astype(float) ** 2, n).astype(float)}
            yield pa.RecordBatch.from_pydict(out)

    schema = StructType([rows.schema[c] for c in others])
    for name in sets:
        schema = schema.add(f"{name}_h", BinaryType()).add(f"{name}_t", BinaryType()).add(f"{name}_n", IntegerType())
        if name in weighted:
            schema = schema.add(f"{name}_hw", BinaryType()).add(f"{name}_tw", BinaryType()).add(f"{name}_q", DoubleType())
    out = durable(rows.mapInArrow(pack, schema))
    known.unpersist()
    return out


def unpacked(table: pa.Table, name: str) -> pa.Table:
    """Adds the kept items of a packed set as a list column, and of a weighted one how often each occurs (``<set>_w``)."""
    code, at = numbers(table.column(f"{name}_h"))
    tail, end = hashes(table.column(f"{name}_t"))
    row = np.concatenate([at, end])
    order, cuts = np.argsort(row, kind="stable"), pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=table.num_rows))], pa.int32())
    lists = {name: np.concatenate([sums(code, at), tail])}
    if f"{name}_hw" in table.column_names:
        lists[f"{name}_w"] = np.concatenate([numbers(table.column(f"{name}_{k}w"))[0] for k in "ht"])
    for k, values in lists.items():
        table = table.append_column(k, pa.ListArray.from_arrays(cuts, pa.array(values[order], pa.int64())))
    return table


def by_tiles(
    rows: DataFrame, vectors: DataFrame, block: tuple[str, ...], run: Callable[[pa.Table, pa.Table | None], Iterator[pa.Table]], schema: str, tile: int = TILE, ids: tuple[str, ...] = ("id_a", "id_b"), items: int | None = None, sets: tuple[str, ...] = (), fold: Callable[[DataFrame], DataFrame] | None = None, listed: bool = False, few: tuple[str, ...] = ()
) -> DataFrame:
    """``run(a, b)`` for each pair of tiles of a block, ``run(a, None)`` for a tile with itself; rows come in order of ``id``.

    ``vectors`` (id, block columns, v) travel as rows of their own and are column ``v`` of the tables. Null blocks are
    blocks as well; rows without an id take no part. Ids of other types than numbers are numbered in their order for the
    tiles; ``ids`` names the columns of the result that hold ids. ``sets`` are those of ``rows`` that ``packed`` packed;
    those of ``few`` stay packed, since only ``Few`` reads them, and do not count for the size of a tile.
    A block has so many tiles that one has about ``tile`` rows and ``items`` items in its sets, and meets them in rounds:
    in each a row goes to ``SHIPPED`` tiles at most, and the results of a round (after ``fold``, which may be applied to
    the whole once more) are written before the next, whose shuffle takes the place of the one before. So disk grows
    with the rows and not with the tiles of a block. Only the sizes of the blocks are broadcast.

    ``listed`` is for results that are as many as the pairs themselves: none is written, they go to the caller as a task
    finds them. All meet in one round, and what is shipped at once is a chest of up to ``CHEST`` tiles, whose tiles a task
    unpacks in turn; the largest block is cut into four chests at least.
    """
    sets = tuple(x for x in sets if x not in few)
    rows, vectors, names = rows.where("id IS NOT NULL"), vectors.where("id IS NOT NULL"), None
    if not isinstance(rows.schema["id"].dataType, IntegralType):
        names = numbers_of(rows)
        rows, vectors = durable(to_numbers(rows, names)), to_numbers(vectors, names)
    held = rows.groupBy(*block).agg(F.count("*").alias("rows"), F.sum(sum((F.col(f"{x}_n") for x in sets), F.lit(0)).cast("long")).alias("items"))
    tiles = F.greatest(F.col("rows") / F.lit(float(tile)), F.col("items") / F.lit(float(items or ITEMS)))
    sizes = durable(held.select(*[F.col(c).alias(f"_{c}") for c in block], tiles.alias("_tiles")))
    held_by = min(max((sizes.agg(F.max("_tiles")).head()[0] or 0) / 4, 1), CHEST) if listed else 1  # tiles of a chest
    sizes = sizes.select(*[f"_{c}" for c in block], F.ceil(F.col("_tiles") / held_by).cast("int").alias("_k"))
    most = sizes.agg(F.max("_k")).head()[0] or 0
    shipped = most if listed else SHIPPED
    if most > SHIPPED:
        vectors = durable(vectors.select("id", *block, "v"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in block]
    every = rows.withColumn("id", F.col("id").cast("long")).withColumn("_text", F.lit(True)).unionByName(vectors.select(F.col("id").cast("long").alias("id"), *block, "v", F.lit(False).alias("_text")), allowMissingColumns=True)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        p, q = table.column("_p")[0].as_py(), table.column("_q")[0].as_py()
        at, is_text = table.column("_t").to_numpy(), table.column("_text").to_numpy()

        def pick(k: int) -> list[pa.Table]:
            texts, given = (table.take(pa.array(np.flatnonzero((at == k) & m))).sort_by("id") for m in (is_text, ~is_text))
            ids, have = texts.column("id").to_numpy(), given.column("id").to_numpy()
            place = np.searchsorted(have, ids)
            ok = np.isin(ids, have)
            texts = texts.drop_columns("v").append_column("v", given.column("v").take(pa.array(np.where(ok, place, 0), mask=~ok)))
            if not listed:
                return [texts]
            held = np.cumsum(sum((texts.column(f"{name}_n").to_numpy() for name in sets), np.zeros(texts.num_rows)))
            cuts = np.flatnonzero(np.diff(np.maximum(held / (items or ITEMS), np.arange(texts.num_rows) / tile).astype(int), prepend=-1, append=-1))
            return [texts.slice(s, e - s) for s, e in zip(cuts, cuts[1:], strict=False)]

        def opened(table: pa.Table) -> pa.Table:
            for name in sets:
                table = unpacked(table, name)
            return table

        sides = [pick(k) for k in dict.fromkeys((p, q))]
        for n, a in enumerate(sides[0]):
            a = opened(a)
            others = sides[1] if p != q else [None, *sides[0][n + 1 :]]
            for b in others:
                for out in run(a, None if b is None else opened(b)):
                    yield from out.to_batches(max_chunksize=100_000)

    parts = []
    for first in range(0, max(most, 1), max(shipped, 1)):
        last = F.least(F.col("_k"), F.lit(first + shipped))
        tasks = sizes.where(F.col("_k") > first).agg(F.sum(F.ceil(F.col("_k") * (last - first) / 2))).head()[0] or 1
        dealt = every.join(F.broadcast(sizes.where(F.col("_k") > first)), same).withColumn("_t", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(first), last - 1)))
        dealt = dealt.withColumn("_o", F.pmod(F.col("_o") - F.col("_t"), F.col("_k")).cast("int"))  # tiles whose numbers add up to one remainder meet in one round
        dealt = dealt.withColumns({"_p": F.least("_t", "_o"), "_q": F.greatest("_t", "_o")}).drop("_k", "_o", *[f"_{c}" for c in block])
        part = dealt.repartition(min(int(tasks), max(64, 4 * rows.sparkSession.sparkContext.defaultParallelism)), *block, "_p", "_q").groupBy(*block, "_p", "_q").applyInArrow(one, schema)
        part = part if fold is None else fold(part)
        parts.append(durable(part) if most > shipped else part)
    out = reduce(DataFrame.unionAll, parts)
    return out if names is None else from_numbers(out, names, *ids)


def flat(table: pa.Table | pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row number of each."""
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column), dtype=np.int32), sizes)


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs that begin at ``first``, and the number of the run of each."""
    run = np.repeat(np.arange(len(size)), size)
    return np.arange(len(run)) + (first - np.cumsum(size) + size)[run], run


class Items:
    """Items of two tiles under common numbers, cut into pieces of ``PIECE`` rows; ``weights`` name a column beside them.

    Numbers rise with how often an item occurs in the tiles; items that no pair can have in common have none.
    """

    def __init__(self, a: pa.Table, b: pa.Table | None, name: str, weights: str | None = None):
        tables = [t for t in (a, b) if t is not None]
        parts = [(*flat(t, name), flat(t, weights)[0].astype(float) if weights else None) for t in tables]
        self.sizes = [t.column(f"{name}_n").to_numpy() if f"{name}_n" in t.column_names else np.bincount(p[1], minlength=t.num_rows) for p, t in zip(parts, tables, strict=True)]
        if b is not None:  # most items that only one tile holds are seen by their bits
            bits = [(p[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int32) for p in parts]
            for mine, other in ((0, 1), (1, 0)):
                there = np.zeros(1 << 24, bool)
                there[bits[other]] = True
                kept = np.flatnonzero(there[bits[mine]])
                parts[mine], bits[mine] = tuple(z if z is None else z[kept] for z in parts[mine]), bits[mine][kept]
        each = pc.dictionary_encode(pa.chunked_array([pa.array(p[0], pa.int64()) for p in parts]))
        codes = [c.indices.to_numpy(zero_copy_only=False) for c in each.chunks if len(c)] if len(each) else []
        codes = [codes.pop(0) if len(p[0]) else np.zeros(0, np.int32) for p in parts]
        n = 1 + max((int(c.max()) for c in codes if len(c)), default=-1)
        times = [np.bincount(c, minlength=n) for c in codes]
        total = np.where((times[0] > 0) & (times[-1] > 0), sum(times), 0)
        order = np.argsort(np.minimum(total, 65535).astype(np.uint16), kind="stable")
        order = order[np.searchsorted(total[order] > 0, True) :]
        number = np.full(n, -1, np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        self.times = total[order]
        self.kept = []  # numbers, rows and weights of each side, in order of rows
        for c, (_, rows, w) in zip(codes, parts, strict=True):
            c = number[c]
            at = np.flatnonzero(c >= 0)
            self.kept.append((c[at], rows[at], None if w is None else w[at]))
        self.sides = [self.pieces(*k, t.num_rows) for k, t in zip(self.kept, tables, strict=True)]

    @staticmethod
    def pieces(codes, rows, weights, n) -> list[tuple]:
        """(codes, first place and number of each, rows in the piece, weights, size) of each piece, in order of codes."""
        out = []
        for s in range(0, n, PIECE):
            lo, hi = np.searchsorted(rows, [s, s + PIECE])
            key = codes[lo:hi].astype(np.int64) * PIECE + (rows[lo:hi] - s)
            order = None if weights is None else np.argsort(key)
            key = np.sort(key) if order is None else key[order]
            code = (key // PIECE).astype(np.int32)
            first = np.flatnonzero(np.diff(code, prepend=-1)).astype(np.int32)
            out.append((code[first], first, np.diff(first, append=len(code)), (key % PIECE).astype(np.int32), None if order is None else weights[lo:hi][order], min(PIECE, n - s)))
        return out

    def products(self, i: int, j: int, single: bool = False) -> np.ndarray:
        """Common items (or sums of products of weights) of piece i of the first and piece j of the last side; ``single``: counts in single precision."""
        ca, sa, fa, ra, wa, na = self.sides[0][i]
        cb, sb, fb, rb, wb, nb = self.sides[-1][j]
        out = np.zeros((na, nb), np.float32 if single else np.float64)
        if not len(ca) or not len(cb):
            return out
        q = np.minimum(np.searchsorted(cb, ca), len(cb) - 1)
        p = np.flatnonzero(cb[q] == ca)
        q = q[p]
        heavy = fa[p] * fb[q] > DENSE
        kind = np.float32 if wa is None else np.float64  # counts below 2^24 are exact
        for s in range(0, int(heavy.sum()), 8192):
            u, v = (z[heavy][s : s + 8192] for z in (p, q))
            x, y = np.zeros((na, len(u)), kind), np.zeros((nb, len(u)), kind)
            for m, first, size, r, w in ((x, sa[u], fa[u], ra, wa), (y, sb[v], fb[v], rb, wb)):
                at, column = spread(first, size)
                m[r[at], column] = 1 if w is None else w[at]
            out += x @ y.T
        u, v = p[~heavy], q[~heavy]
        each, column = spread(sa[u], fa[u])
        first, times = sb[v][column], fb[v][column]
        ends = np.cumsum(times)
        s = 0
        while s < len(each):  # about a million meetings at once
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 1_000_000, "right")))
            at, one = spread(first[s:e], times[s:e])
            one = each[s:e][one]
            cell = ra[one] * nb + rb[at]
            np.add(out, np.bincount(cell, None if wa is None else wa[one] * wb[at], na * nb).reshape(na, nb), out=out, casting="unsafe")
            s = e
        return out


#: Shares of the rows up to which an item counts as rare, and from which on as frequent.
RARE, FREQUENT = (0.0025, 0.005, 0.01, 0.02, 0.04), (0.08, 0.15, 0.3, 0.5)


class Near:
    """Pairs of rows of two tiles that may have enough items in common, without counting all they have.

    Rare items cost few meetings, frequent ones few columns of a matrix product; only these are counted. Of all others no more
    can be common than the row with fewer of them holds. Which items are counted goes by what the pieces cost; where no
    choice leaves few pairs, ``pairs`` gives None and all items have to be counted.
    """

    def __init__(self, items: Items, share: float):
        """A pair needs ``share`` of the sum of its sizes in common."""
        self.items, self.share = items, share
        rows = sum(len(x) for x in items.sizes)
        self.cuts = [int(np.searchsorted(items.times, r * rows, "right")) for r in (*RARE, *FREQUENT, 2)]
        kind, k = np.searchsorted(self.cuts, np.arange(len(items.times)), "right"), len(self.cuts) + 1
        held = [np.bincount(r.astype(np.int64) * k + kind[c], minlength=len(n) * k).reshape(-1, k) for (c, r, _), n in zip(items.kept, items.sizes, strict=True)]
        self.rest = [np.cumsum(h[:, :0:-1], 1)[:, ::-1].T.astype(np.float32) for h in held]  # items of a row from each cut on
        self.place, self.placed = np.full(len(items.times), -1, np.int32), np.zeros(0, np.int32)

    def pairs(self, i: int, j: int, at: slice, to: slice) -> tuple[np.ndarray, np.ndarray] | None:
        (ca, sa, fa, ra, _, na), (cb, sb, fb, rb, _, nb) = self.items.sides[0][i], self.items.sides[-1][j]
        own, other = ((n[k] * self.share).astype(np.float32) for n, k in ((self.items.sizes[0], at), (self.items.sizes[-1], to)))
        u, v = self.rest[0][:, at], self.rest[-1][:, to]
        self.place[self.placed] = -1
        self.place[cb], self.placed = np.arange(len(cb), dtype=np.int32), cb
        q = self.place[ca]
        p = np.flatnonzero(q >= 0)
        q = q[p]
        met = fa[p].astype(np.int64) * fb[q]
        ends = np.searchsorted(ca[p], self.cuts)
        upto = np.r_[0, np.cumsum(met)][ends]
        x, y = slice(None, None, max(1, na // 48)), slice(None, None, max(1, nb // 48))
        need, best = own[x][:, None] + other[y], (np.inf, 0, 0)
        for r in range(len(RARE)):
            for f in range(len(RARE), len(self.cuts)):
                by_chance = (upto[r] + upto[-1] - upto[f]) / (na * nb)
                cost = upto[r] * 20.0 + (ends[-1] - ends[f]) * na * nb * 0.025
                if cost < best[0] and np.mean(need - np.minimum((u[r] - u[f])[x][:, None], (v[r] - v[f])[y]) <= by_chance + 4 * np.sqrt(by_chance) + 0.5) < 0.001:
                    best = cost, r, f
        cost, r, f = best
        if cost > 20 * met[met <= DENSE].sum() + 0.025 * na * nb * (met > DENSE).sum():
            return None
        sides = []
        for first, size, row, n, k, less in ((sa[p], fa[p], ra, na, slice(ends[f], None), own), (sb[q], fb[q], rb, nb, slice(ends[f], None), other)):
            places, column = spread(first[k], size[k])
            m = np.zeros((n, len(size[k]) + 2), np.float32)
            m[row[places], column] = 1
            m[:, -1 if less is own else -2], m[:, -2 if less is own else -1] = -less, 1
            sides.append(m)
        bound = sides[0] @ sides[1].T
        bound += np.minimum((u[r] - u[f])[:, None], v[r] - v[f])
        p, q, met = p[: ends[r]], q[: ends[r]], met[: ends[r]]
        for s, e in ranges(met, 1_000_000):
            each, column = spread(sa[p[s:e]], fa[p[s:e]])
            places, one = spread(sb[q[s:e]][column], fb[q[s:e]][column])
            np.add.at(bound.reshape(-1), ra[each[one]] * np.int32(nb) + rb[places], np.float32(1))
        found = np.flatnonzero(bound > -0.02)  # sums of small numbers, so single precision is near enough
        return found // nb, found % nb


def ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of these with about ``most`` in sum."""
    ends, s = np.cumsum(sizes), 0
    while s < len(sizes):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield s, e
        s = e


class Few:
    """Common items (or sums of products of weights) of some pairs of rows of two tiles: only those rows are read, and unpacked if they are not yet."""

    def __init__(self, a: pa.Table, b: pa.Table | None, name: str, weights: str | None = None):
        self.tables, self.name, self.weights = [t for t in (a, b) if t is not None], name, weights

    def side(self, table: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
        """Items in order within each of these rows, where each begins, weights, and the place of each given row."""
        own, place = np.unique(rows, return_inverse=True)
        table = table.select([c for c in table.column_names if c == self.name or c.startswith(f"{self.name}_")]).take(pa.array(own))
        table = table if self.name in table.column_names else unpacked(table, self.name)
        items, at = flat(table, self.name)
        weights = flat(table, self.weights)[0].astype(float) if self.weights else None
        if weights is None:
            items = items.copy()
            for part in np.split(items, np.flatnonzero(np.diff(at)) + 1):
                part.sort()
        else:
            order = np.lexsort((items, at))
            items, weights = items[order], weights[order]
        return items, np.searchsorted(at, np.arange(len(own) + 1)), weights, place

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for s in range(0, len(x), 20_000):
            out[s : s + 20_000] = self.of(x[s : s + 20_000], y[s : s + 20_000])
        return out

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (ia, fa, wa, x), (ib, fb, wb, y) = self.side(self.tables[0], x), self.side(self.tables[-1], y)
        known = np.unique(np.concatenate([ia, ib]))
        ca, cb = np.searchsorted(known, ia), np.searchsorted(known, ib)
        out, na, nb = np.zeros(len(x)), fa[x + 1] - fa[x], fb[y + 1] - fb[y]
        ends, s = np.cumsum(na + nb), 0
        while s < len(x):  # about a million items at once
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 1_000_000, "right")))
            (at, p), (to, q) = spread(fa[x[s:e]], na[s:e]), spread(fb[y[s:e]], nb[s:e])
            one, other = p << 32 | ca[at], q << 32 | cb[to]
            if len(one) and len(other):
                place = np.minimum(np.searchsorted(other, one), len(other) - 1)
                hit = np.flatnonzero(other[place] == one)
                out[s:e] = np.bincount(p[hit], None if wa is None else wa[at[hit]] * wb[to[place[hit]]], e - s)
            s = e
        return out


class Vectors:
    """Unit-free cosine of two tiles' vectors; 0 if one is missing, lengths differ, or a norm is zero."""

    def __init__(self, a: pa.Table, b: pa.Table | None, name: str = "v"):
        self.sides = [self.read(t, name) for t in (a, b) if t is not None]

    @staticmethod
    def read(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        values, rows = flat(table, name)
        sizes = np.bincount(rows, minlength=table.num_rows)
        return {int(n): (np.flatnonzero(sizes == n), values[sizes[rows] == n].astype(float).reshape(-1, n)) for n in np.unique(sizes[sizes > 0])}

    def cosines(self, i: int, j: int, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape)
        for n in self.sides[0].keys() & self.sides[-1].keys():
            x, y = ((r[k] - p * PIECE, v[k]) for (r, v), p in ((self.sides[0][n], i), (self.sides[-1][n], j)) for k in [(r >= p * PIECE) & (r < (p + 1) * PIECE)])
            norms = np.outer(np.sqrt((x[1] ** 2).sum(1)), np.sqrt((y[1] ** 2).sum(1)))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[np.ix_(x[0], y[0])] = np.where(norms > 0, x[1] @ y[1].T / norms, 0.0)
        return out


class Units:
    """Cosines as of ``Vectors``, all in single precision (within 1e-5) or some exactly."""

    def __init__(self, a: pa.Table, b: pa.Table | None, name: str = "v"):
        self.sides = [self.read(t, name) for t in (a, b) if t is not None]

    @staticmethod
    def read(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Vectors of each length, their norms, and vectors of norm one; zeros for the rows of other lengths."""
        out = {}
        for n, (rows, values) in Vectors.read(table, name).items():
            whole, norms = np.zeros((table.num_rows, n)), np.zeros(table.num_rows)
            whole[rows] = values
            norms[rows] = np.sqrt((values**2).sum(1))
            unit = np.divide(whole, norms[:, None], out=np.zeros_like(whole), where=(norms > 0)[:, None])
            out[n] = whole, norms, unit.astype(np.float32)
        return out

    def near(self, at: slice, to: slice) -> np.ndarray:
        out = np.zeros((at.stop - at.start, to.stop - to.start), np.float32)
        for n in self.sides[0].keys() & self.sides[-1].keys():
            out += self.sides[0][n][2][at] @ self.sides[-1][n][2][to].T
        return out

    def cosines(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for n in self.sides[0].keys() & self.sides[-1].keys():
            (a, p, _), (b, q, _) = self.sides[0][n], self.sides[-1][n]
            norms = p[x] * q[y]
            out += np.divide(np.einsum("ij,ij->i", a[x], b[y]), norms, out=np.zeros(len(x)), where=norms > 0)
        return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As ``text.half_up``."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def jaccard(common: np.ndarray, a: np.ndarray, b: np.ndarray, digits: int) -> np.ndarray:
    both = a[:, None] + b[None, :] - common
    return half_up(np.divide(common, both, out=np.zeros_like(common), where=both > 0), digits)


def places(a: pa.Table, b: pa.Table | None) -> Iterator[tuple[int, int, slice, slice]]:
    """Pieces of a pair of tiles and their rows; of a tile with itself the upper half."""
    na, nb = a.num_rows, (a if b is None else b).num_rows
    for i in range(-(-na // PIECE)):
        for j in range(i if b is None else 0, -(-nb // PIECE)):
            yield i, j, slice(i * PIECE, min(na, (i + 1) * PIECE)), slice(j * PIECE, min(nb, (j + 1) * PIECE))
