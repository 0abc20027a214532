"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that are equal collapse first. A few tables then hold every distinct fingerprint under some of its bits:
for an exact radius the bits are unions of blocks, chosen so that any two fingerprints within the radius share one whole
union (pigeonhole); for wide radii they are drawn bits. Rows are ranged by (table, key, Gray rank) over the tasks, so
a large group is cut between tasks instead of meeting in one. In a task the rows of a group lie in Gray order, runs of
them form leaves and runs of nodes form upper nodes, and each node keeps the bits that all below it share. A self-join
walks down pairs of nodes and drops a pair, with all below it, once the shared bits that differ exceed the radius.
Groups cut between tasks hand on pages with such bits, which are joined and pruned in the same way. A task keeps a
spanning forest of its links, so copies never expand into all pairs.

For near-copies (``Settings.least``) fingerprints carry further words that no table reads, and a link is no more than a
candidate: a task hands on the spanning forest whose links have the fewest differing bits, so that the likeliest of
each cut between its rows is among them, and a candidate joins two texts only if their whole sets of shingles are as
similar as ``least``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices, tokens
from .components import HOT, SHARES, components

FAN, PAGE, CHUNK, TILE = 16, 512, 4096, 16


@dataclass(frozen=True)
class Settings:
    """``exact``: the radius is searched exactly with unions of ``match`` of ``blocks`` blocks; else ``tables`` draws of ``bits``."""

    shingle: int = 4
    words: int = 1  # 64-bit words that the tables and the hierarchy read
    radius: int = 4  # differing bits in those words
    more_words: int = 0  # further words of a fingerprint
    whole_radius: int = 0  # differing bits in all words, where there are further ones
    least: float | None = None  # similarity of the shingle sets that a link must have; fingerprints alone decide without it
    exact: bool = True
    blocks: int = 6
    match: int = 2
    tables: int = 48
    bits: int = 18
    rows_per_task: int = 1_000_000

    def names(self) -> list[str]:
        return [f"f{w}" for w in range(self.words + self.more_words)]

    def same(self) -> list[str]:
        """What texts of one node have in common: the fingerprint and, where sets decide, a hash of the set."""
        return self.names() + ["set_hash"] * (self.least is not None)

    def keys(self) -> list[np.ndarray]:
        """The bit positions of each table."""
        if self.exact:
            if self.blocks - self.radius < self.match:
                raise ValueError("these blocks don't cover the radius")
            cut = np.array_split(np.arange(64 * self.words), self.blocks)
            return [np.concatenate(c) for c in itertools.combinations(cut, self.match)]
        draw = np.random.default_rng(2024)
        return [np.sort(draw.choice(64 * self.words, self.bits, replace=False)) for _ in range(self.tables)]


def mixed(h: np.ndarray, w: int) -> np.ndarray:
    """Another 64-bit hash of what ``h`` stands for."""
    x = h + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> list[bytes]:
    """Runs of ``width`` words joined by a blank, repeats included; the whole sequence if it has fewer, none without words."""
    ws = tokens(text)
    n = len(ws)
    line = b" ".join(ws)
    if n <= width:
        return [line] if n else []
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1)
    starts = np.r_[0, ends[:-1]][: n - width + 1].tolist()
    return [line[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def hashes(pieces: list[bytes], seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(p, seed) for p in pieces], np.uint64, len(pieces))


def fingerprint(text: str | None, z: Settings) -> list[int]:
    """Signed 64-bit words; a bit is set if over half of the shingle hashes (repeats included) have it. No word: zeros.

    The words of the tables take XXH64 with a seed each; further words take the first hash, mixed anew for each. With
    ``least`` a hash of the set of the first hashes follows.
    """
    pieces = shingles(text, z.shingle)
    if not pieces:
        return [0] * len(z.same())
    out, first = [], hashes(pieces)
    for w in range(z.words + z.more_words):
        h = mixed(first, w) if w >= z.words else hashes(pieces, 42 + w) if w else first
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 65536):
            ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0]))
    if z.least is not None:
        out.append(int(np.uint64(xxhash.xxh64_intdigest(np.unique(first).tobytes())).view(np.int64)))
    return out


def fingerprints(docs: DataFrame, z: Settings, key: str, text: str) -> DataFrame:
    """(key, f0, f1, ...) for every row."""
    names = z.same()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([fingerprint(t, z) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], ["key", *names])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} long" for n in names))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gather_bits(fps: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for i, b in enumerate(at):
        out |= ((fps[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << i
    return out


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        parent[x] = parent[up]
        x = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook larger roots to smaller ones until no link joins two trees."""
    while len(a):
        ra, rb = roots(parent, a), roots(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def forest(parent: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links from representatives to the smallest one of their tree: the same in each table that finds the tree."""
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    least = rep.copy()
    np.minimum.at(least, parent, rep)
    links = np.unique(np.stack([rep, least[parent]], 1), axis=0)
    links = links[links[:, 0] != links[:, 1]]
    return np.ascontiguousarray(links[:, 0]), np.ascontiguousarray(links[:, 1])


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make up a spanning forest of least differing bits: shorter ones first, as Kruskal has it."""
    parent, taken = np.arange(n), []
    order = np.argsort(far, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(far[order]) > 0, True]) if len(order) else np.zeros(1, int)
    for s, e in zip(cuts, cuts[1:]):
        at = order[s:e]
        while len(at):
            ra, rb = roots(parent, a[at]), roots(parent, b[at])
            apart = ra != rb
            at, high, low = at[apart], np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            hooks, one = np.unique(high, return_index=True)  # a root hooks to a smaller one by one link
            parent[hooks] = low[one]
            taken.append(at[one])
    return np.concatenate(taken) if taken else np.zeros(0, int)


class Links:
    """What a task keeps of its links: a spanning forest, whatever their number."""

    def __init__(self, n: int, z: Settings, most: int = 300_000):
        self.n, self.z, self.most, self.parent = n, z, most, np.arange(n)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Pairs of rows within the radius, and their whole fingerprints."""
        if self.z.least is None:
            self.held.append((a, b))
        else:
            far = np.bitwise_count(one ^ two).sum(1, dtype=np.int32)
            near = far <= self.z.whole_radius
            self.held.append((a[near], b[near], far[near]))
        self.size += len(self.held[-1][0])
        if self.size > self.most:
            self.reduce()

    def reduce(self) -> None:
        if not self.held:
            return
        cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        if self.z.least is None:
            unite(self.parent, *cols)
            self.held, self.size = [], 0
        else:
            keep = nearest_forest(self.n, *cols)
            self.held, self.size = [tuple(c[keep] for c in cols)], 0  # what stays is less than one for each row

    def links(self, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.reduce()
        if self.z.least is None:
            return forest(self.parent, rep)
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (rep[x] for x in self.held[0][:2])
        return np.maximum(a, b), np.minimum(a, b)


class GrayIndex:
    """The hierarchy over fingerprints of shape (n, words), sorted by group and Gray rank."""

    def __init__(self, fps: np.ndarray, starts: np.ndarray):
        self.ands, self.ors, self.first, self.count = [fps], [fps], [None], [None]
        sizes = np.diff(np.r_[starts, len(fps)])
        while True:
            nodes = -(-sizes // FAN)
            base = np.cumsum(nodes) - nodes
            within = np.arange(nodes.sum()) - np.repeat(base, nodes)
            first = np.repeat(starts, nodes) + within * FAN
            count = np.minimum(FAN, np.repeat(sizes, nodes) - within * FAN)
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], first, axis=0))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], first, axis=0))
            self.first.append(first)
            self.count.append(count)
            starts, sizes = base, nodes
            if (nodes == 1).all():
                break

    def apart(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that all below a and all below b share and that differ."""
        x = (self.ands[level][a] & ~self.ors[level][b]) | (self.ands[level][b] & ~self.ors[level][a])
        return np.bitwise_count(x).sum(1, dtype=np.int32)

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one group within the radius, in pieces."""
        top = len(self.first) - 1
        roots = np.arange(len(self.first[top]))
        roots = roots[self.count[1][roots] > 1] if top == 1 else roots
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > CHUNK:
                stack.append((level, a[CHUNK:], b[CHUNK:]))
                a, b = a[:CHUNK], b[:CHUNK]
            na, nb = self.count[level][a], self.count[level][b]
            each = na * nb
            pair = np.repeat(np.arange(len(a)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = k // nb[pair], k % nb[pair]
            ca, cb = self.first[level][a][pair] + i, self.first[level][b][pair] + j
            keep = ca < cb if level == 1 else ca <= cb
            ca, cb = ca[keep], cb[keep]
            near = self.apart(level - 1, ca, cb) <= radius
            ca, cb = ca[near], cb[near]
            if level == 1:
                if len(ca):
                    yield ca, cb
            elif len(ca):
                stack.append((level - 1, ca, cb))


EDGE = "a long, b long, key long, part int, page int, ones array<long>, zeros array<long>, items binary"


def _rows(a, b, pages: list[tuple]) -> pa.RecordBatch:
    n, m = len(a), len(pages)
    none = [None] * n
    col = lambda i, t: pa.array(none + [p[i] for p in pages], t)
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([*a, *[None] * m], pa.int64()), pa.array([*b, *[None] * m], pa.int64()), col(0, pa.int64()), col(1, pa.int32()), col(2, pa.int32()), col(3, longs), col(4, longs), col(5, pa.binary())], ["a", "b", "key", "part", "page", "ones", "zeros", "items"])


def link_nodes(nodes: DataFrame, z: Settings) -> DataFrame:
    """Edges (a, b) between representatives of distinct fingerprints within the radius: enough to connect them all."""
    names = z.names()
    keys = z.keys()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([batch.column(n).to_numpy() for n in names], 1).view(np.uint64)
            gray = (gray_rank(fps[:, 0]) ^ np.uint64(1 << 63)).view(np.int64)
            for t, at in enumerate(keys):
                yield pa.RecordBatch.from_arrays([pa.array(gather_bits(fps, at) | (t << 40)), pa.array(gray), *(batch.column(n) for n in [*names, "rep"])], ["key", "gray", *names, "rep"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in ("key", "gray", *names, "rep")] for b in batches if b.num_rows]
        if not held:
            return
        key, gray, *fps, rep = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((gray, key))
        key, rep, fps = key[order], rep[order], np.stack([f[order] for f in fps], 1).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        part, pages = TaskContext.get().partitionId(), []
        for s, e in {(starts[0], ends[0]), (starts[-1], ends[-1])}:  # groups that may go on in another task
            for i in range(s, e, PAGE):
                x = fps[i : min(e, i + PAGE)]
                ones, zeros = np.bitwise_and.reduce(x[:, : z.words], 0), ~np.bitwise_or.reduce(x[:, : z.words], 0)
                pages.append((int(key[s]), part, len(pages), ones.view(np.int64).tolist(), zeros.view(np.int64).tolist(), x.tobytes() + rep[i : min(e, i + PAGE)].tobytes()))
        more = np.repeat(ends - starts > 1, ends - starts)
        key, rep, fps = key[more], rep[more], fps[more]
        a = b = np.zeros(0, np.int64)
        if len(key):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            links = Links(len(key), z)
            for x, y in GrayIndex(np.ascontiguousarray(fps[:, : z.words]), starts).links(z.radius):
                links.add(x, y, fps[x], fps[y])
            a, b = links.links(rep)
        yield _rows(a, b, pages)

    def link_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                sides = [np.frombuffer(x, np.uint64).reshape(-1) for x in (one, two)]
                n = [len(s) // (len(names) + 1) for s in sides]
                f = [s[: k * len(names)].reshape(k, len(names)) for s, k in zip(sides, n, strict=True)]
                r = [s[k * len(names) :].view(np.int64) for s, k in zip(sides, n, strict=True)]
                far = sum(np.bitwise_count(f[0][:, None, w] ^ f[1][None, :, w]).astype(np.int32) for w in range(z.words))
                i, j = np.nonzero(far <= z.radius)
                if len(i):
                    links = Links(n[0] + n[1], z)
                    links.add(i, j + n[0], f[0][i], f[1][j])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in links.links(np.concatenate(r))], ["a", "b"])

    spark = nodes.sparkSession
    n = nodes.count() * len(keys)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // z.rows_per_task))
    rows = nodes.mapInArrow(deal, "key long, gray long, " + ", ".join(f"{x} long" for x in names) + ", rep long")
    found = durable(rows.repartitionByRange(tasks, "key", "gray").mapInArrow(link, EDGE))
    return found.where(F.col("a").isNotNull()).select("a", "b").unionAll(cut_links(found.where(F.col("key").isNotNull()), z).mapInArrow(link_pages, "a long, b long"))


def cut_links(pages: DataFrame, z: Settings) -> DataFrame:
    """(one, two): pages of a group that lie in different tasks and whose shared bits leave the radius possible.

    A key's pages are dealt to tiles of about ``TILE`` and each pair of tiles is a key of its own, so that a hot key is
    compared in many tasks; only the shared bits travel there, the fingerprints follow for the pairs that are left. At
    most two keys are cut at the end of each task, so the broadcast sizes are bounded by the number of tasks.
    """
    pages = pages.select("key", "part", "page", "ones", "zeros", "items")
    sizes = F.broadcast(pages.groupBy("key").agg(F.ceil(F.count("*") / F.lit(float(TILE))).cast("int").alias("k"), F.min("part").alias("first"), F.max("part").alias("last")).where("first < last").select("key", "k"))
    bits = pages.drop("items").join(sizes, "key").withColumn("t", F.pmod(F.xxhash64("part", "page"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    p, q = bits.alias("p"), bits.alias("q")
    apart = sum((F.bit_count((F.col("p.ones")[w].bitwiseAND(F.col("q.zeros")[w])).bitwiseOR(F.col("q.ones")[w].bitwiseAND(F.col("p.zeros")[w]))) for w in range(z.words)), F.lit(0))
    met = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.t") == F.col("q.o")) & (F.col("p.o") == F.col("q.t")) & (F.col("p.part") < F.col("q.part")) & (apart <= z.radius))
    place = lambda x: [F.col(f"{x}.{c}").alias(f"{x}_{c}") for c in ("part", "page")]
    met = met.select(*place("p"), *place("q"))
    for x, name in (("p", "one"), ("q", "two")):
        met = met.join(pages.select(F.col("part").alias(f"{x}_part"), F.col("page").alias(f"{x}_page"), F.col("items").alias(name)), [f"{x}_part", f"{x}_page"])
    return met.select("one", "two")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(key, items): the sorted distinct 64-bit hashes of each text's shingles; ``docs`` has key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(hashes(shingles(t, width))).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "items"])

    return docs.select("key", "text").mapInArrow(run, "key long, items array<long>")


def checked_links(edges: DataFrame, texts: DataFrame, z: Settings) -> DataFrame:
    """Those edges (a, b) whose texts' shingle sets are as similar as ``z.least``; ``texts`` has key and text.

    Only texts of an edge are cut into shingles. Two different shingles of a pair count as one if their 64-bit hashes are
    equal: odds of about 1e-12 for texts of a few thousand words. A node of very many edges is dealt to several keys.
    """
    edges = durable(edges.where("a <> b").distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    # No more than 40,000 nodes can have more than one in 20,000 of all ends: a bounded table of numbers.
    hot = F.broadcast(ends.where(F.col("n") > F.lit(max(HOT, 2 * edges.count() // SHARES))).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("k")))
    sets = shingle_sets(texts.join(ends.select("key"), "key", "left_semi"), z.shingle)
    sets = durable(sets.groupBy("key").agg(F.min("items").alias("items")))
    spread = sets.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    rows = edges
    for x, other in (("a", "b"), ("b", "a")):
        salted = rows.join(hot.withColumnRenamed("key", x), x, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
        rows = salted.join(spread.select(F.col("key").alias(x), "salt", F.col("items").alias(f"set_{x}")), [x, "salt"]).drop("salt")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return rows.select("a", "b", common.alias("c"), (F.size("set_a") + F.size("set_b")).alias("n")).where(F.col("c") >= F.lit(z.least) * (F.col("n") - F.col("c")) - 1e-9).select("a", "b")


def node_texts(docs: DataFrame, nodes: DataFrame, z: Settings, key: str, text: str) -> DataFrame:
    """(key, text): texts of the numbered nodes (least, node, fingerprint), under their numbers.

    A node is found by its smallest key; those that only rows without a key have are found by the fingerprints of such
    rows, whose texts are written once under marks of their own.
    """
    keyed = docs.select(F.col(key).alias("least"), F.col(text).alias("text")).join(nodes.select("least", "node"), "least").select(F.col("node").alias("key"), "text")
    lost = durable(docs.where(F.col(key).isNull()).select(F.col(text).alias("text")).withColumn("mark", F.monotonically_increasing_id()))
    marks = fingerprints(lost, z, "mark", "text").join(nodes.where("least IS NULL"), z.same()).groupBy("node").agg(F.min("key").alias("mark"))
    return keyed.unionByName(lost.join(marks, "mark").select(F.col("node").alias("key"), "text"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, fingerprint words, component_id) for every row; the component is the smallest key reachable over links.

    Keys are of any type that has an order. Null, empty and blank texts have fingerprint zero and link like any other. A
    row with a null key links its neighbours like any other and never names a component; if no row of a component has a
    key, component_id is null. Repeated rows repeat in the result. Distinct fingerprints are numbered in order of their
    smallest key, those of rows without keys last, and two that have one smallest key are linked. Where sets decide
    (``Settings.least``), texts of equal sets are one node, and rows of one key are one document, compared by one of
    their texts.
    """
    z = settings
    names, same = z.names(), z.same()
    rows = durable(fingerprints(docs, z, key, text))
    nodes = rows.groupBy(*same).agg(F.min("key").alias("least"))
    nodes = durable(durable(nodes).orderBy(F.asc_nulls_last("least")).withColumn("node", F.monotonically_increasing_id()))
    edges = link_nodes(nodes.select(*same, F.col("node").alias("rep")), z)
    if z.least is not None:
        edges = checked_links(edges, node_texts(docs, nodes, z, key, text), z)
    first = nodes.where("least IS NOT NULL").groupBy("least").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    found = components(edges.unionAll(nodes.join(first, "least").select(F.col("node").alias("a"), "b")))
    heads = nodes.select(F.col("node").alias("component"), F.col("least").alias("component_id"))
    named = nodes.join(found.join(heads, "component").select("node", "component_id"), "node", "left").select(*same, F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, same).select(F.col("key").alias(key), *names, "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Keep the row of each component's smallest key, once; rows without a key stay as they are."""
    found = near_duplicates(docs, key, text, settings)
    keep = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(keep, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))


def linked_documents(docs: DataFrame) -> DataFrame:
    """The corpus query."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-copies for filtering: five words, similarity 0.8. Two texts of that similarity differ in 15 % of the bits: about 19
#: of the 128 that are searched, give or take 4, and 58 of all 384, give or take 7.
NEAR_COPIES = Settings(shingle=5, words=2, radius=30, more_words=4, whole_radius=76, least=0.8, exact=False, tables=64, bits=17)
