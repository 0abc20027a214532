"""Exact inner-product top-k by best-first search in M-trees.

Vectors become points of a metric space: one more coordinate, the root of (largest squared norm less own), makes the
Euclidean distance to a query fall as the inner product grows. Rows are dealt to blocks by a hash; for each block an
M-tree of pages is built once and written, whose routing entries hold a covering radius and the distance to their
parent. Queries meet the written trees in bounded groups. A search opens pages by their least possible distance; within a page the stored parent
distances and the distance to the parent, already known, spare computations by the triangle inequality. Scores are exact
integers; bounds carry a slack for rounding, so ties at the k-th score are all seen.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable


@dataclass(frozen=True)
class Settings:
    k: int = 10
    page: int = 128  # entries of a node
    rows_per_block: int = 8192
    queries_per_group: int = 4096
    seed: int = 5


class MTree:
    """Nodes in arrays: leaf entries are rows, inner entries are nodes; each entry keeps its distance to the parent."""

    def __init__(self, points: np.ndarray, z: Settings):
        self.points, self.z, self.rng = points, z, np.random.default_rng(z.seed)
        self.nodes: list[dict] = []
        self.root = self._build(np.arange(len(points)), None)

    def _distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        x = self.points[rows] - to
        return np.sqrt(np.einsum("ij,ij->i", x, x))

    def _build(self, rows: np.ndarray, pivot: np.ndarray | None) -> int:
        """Bulk loading: a page of rows is a leaf, more rows are split about pivots drawn from them."""
        if pivot is None:
            pivot = self.points[rows[self.rng.integers(len(rows))]]
        from_pivot = self._distances(rows, pivot)
        me = len(self.nodes)
        self.nodes.append({"pivot": pivot})
        if len(rows) <= self.z.page or not from_pivot.max():
            self.nodes[me].update(leaf=True, entries=rows, parent=from_pivot, radius=float(from_pivot.max(initial=0.0)))
            return me
        fan = min(self.z.page, max(2, -(-len(rows) // (self.z.page // 2))))
        seeds = self.points[self.rng.choice(rows, fan, replace=False)]
        norms = np.einsum("ij,ij->i", seeds, seeds)
        near = np.concatenate([(norms - 2 * self.points[rows[i : i + 4096]] @ seeds.T).argmin(1) for i in range(0, len(rows), 4096)])
        groups = [(s, rows[near == i]) for i, s in enumerate(seeds)]
        groups = [(s, g) for s, g in groups if len(g)]
        if len(groups) == 1:  # all nearest to one seed: halves by distance from the pivot
            order = rows[np.argsort(from_pivot, kind="stable")]
            groups = [(self.points[h[0]], h) for h in np.array_split(order, 2)]
        children = [self._build(g, s) for s, g in groups]
        away = np.array([np.linalg.norm(s - pivot) for s, _ in groups])
        self.nodes[me].update(leaf=False, entries=np.array(children), parent=away, pivots=np.stack([s for s, _ in groups]), radii=np.array([self.nodes[c]["radius"] for c in children]), radius=float(from_pivot.max()))
        return me

    def search(self, query: np.ndarray, score, k: int, skip: int) -> tuple[list[int], int]:
        """Rows that may be among the k best, ``score(rows)`` giving exact scores; and the number of distances computed.

        ``skip`` is a row id-mask already applied by score (returns None for rows left out).
        """
        root = self.nodes[self.root]
        start = float(np.linalg.norm(root["pivot"] - query))
        heap = [(max(0.0, start - root["radius"]), self.root, start)]
        best: list[float] = []  # negated distances of the k nearest so far
        found, computed, reach = [], 1, np.inf
        slack = 1e-7 * (1.0 + start)
        while heap:
            least, at, to_pivot = heapq.heappop(heap)
            if least > reach + slack:
                break
            node = self.nodes[at]
            gap = np.abs(to_pivot - node["parent"])
            if node["leaf"]:
                rows = node["entries"][gap <= reach + slack]
                if not len(rows):
                    continue
                d, rows = self._distances(rows, query), rows
                computed += len(rows)
                ok = score(rows)
                close = ok & (d <= reach + slack)
                found.append((rows[close], d[close]))
                for x in np.sort(d[close])[:k].tolist():
                    if len(best) < k:
                        heapq.heappush(best, -x)
                    elif x < -best[0]:
                        heapq.heapreplace(best, -x)
                if len(best) == k:
                    reach = -best[0]
            else:
                may = np.flatnonzero(gap - node["radii"] <= reach + slack)
                if not len(may):
                    continue
                x = node["pivots"][may] - query
                d = np.sqrt(np.einsum("ij,ij->i", x, x))
                computed += len(may)
                low = np.maximum(0.0, d - node["radii"][may])
                for i in np.flatnonzero(low <= reach + slack).tolist():
                    heapq.heappush(heap, (float(low[i]), int(node["entries"][may[i]]), float(d[i])))
        out = [r[d <= reach + slack] for r, d in found]
        return (np.concatenate(out) if out else np.zeros(0, int)), computed


def fixed_point(vector: Column, unit: int = 1024) -> Column:
    """Components as floor(unit * x); null where the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * unit))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), x)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; Python integers where 64 bits could overflow."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    if top < 2**53:
        return (rows.astype(float) @ query.astype(float)).astype(np.int64)
    if top < 2**62:
        return rows @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in rows], dtype=object)


def top_inner_products(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows by integer inner product.

    Ties go to the smaller id. Rows with a null id, or a vector that is null or holds a null or non-finite component, take
    no part. Rows that share the query's id count as the query's own; a repeated query row asks once, repeated candidates
    are dropped if id and vector are the same. Only vectors of equal size meet. Fewer than k others: all of them.
    """
    z = settings
    rows = vectors.select(F.col(key).alias("id"), fixed_point(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("ask")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.withColumn("size", F.size("v")).distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = {r["size"]: r for r in rows.groupBy("size").agg(F.max(norm).alias("norm"), F.count("*").alias("n"), F.count_if("ask").alias("q")).collect()}  # a row for each vector size
    if not facts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per = lambda what, by: F.create_map(*[F.lit(x) for s, r in facts.items() for x in (s, -(-max(1, r[what]) // by))]).cast("map<int,long>")[F.col("size")]
    hashed = F.xxhash64(F.col("id").cast("string"))
    norms = {s: float(r["norm"] or 0.0) for s, r in facts.items()}

    def read(x: pa.Scalar, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of a list of (id, v), by id."""
        ids, ints = x.values.field("id").to_numpy(zero_copy_only=False), x.values.field("v").flatten().to_numpy(zero_copy_only=False)
        ints = ints.reshape(len(ids), size) if size else np.zeros((len(ids), 0), np.int64)
        order = np.argsort(ids, kind="stable")
        return ids[order], ints[order]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].as_py()
                ids, ints = read(batch.column("rows")[i], size)
                f = ints.astype(float)
                extra = np.sqrt(np.maximum(0.0, norms[size] - np.einsum("ij,ij->i", f, f)))
                tree = MTree(np.column_stack([f, extra]), z)
                yield pa.RecordBatch.from_arrays([batch.column("size").slice(i, 1), batch.column("block").slice(i, 1), pa.array([pickle.dumps((ids, ints, tree))], pa.binary())], ["size", "block", "tree"])

    member = F.collect_list(F.struct("id", "v"))
    blocks = rows.groupBy("size", F.pmod(hashed, per("n", z.rows_per_block)).alias("block")).agg(member.alias("rows"))
    trees = durable(blocks.mapInArrow(grow, "size int, block long, tree binary"))
    groups = rows.where("ask").groupBy("size", F.pmod(hashed, per("q", z.queries_per_group)).alias("part")).agg(member.alias("asked"))
    # A stated query set against all rows, in blocks of bounded size: each pair of a tree and a group is a key of its own.
    keys, tasks = ["size", "block", "part"], int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = lambda what, by: F.sequence(F.lit(0).cast("long"), per(what, by) - 1)
    left = trees.withColumn("part", F.explode(upto("q", z.queries_per_group))).repartition(tasks, *keys)
    right = groups.withColumn("block", F.explode(upto("n", z.rows_per_block))).repartition(tasks, *keys)
    meets = left.join(right, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].as_py()
                ids, ints, tree = pickle.loads(batch.column("tree")[i].as_py())
                out: list[tuple] = []
                for q, x in zip(*read(batch.column("asked")[i], size), strict=True):
                    near, _ = tree.search(np.r_[x.astype(float), 0.0], lambda r, q=q: ids[r] != q, z.k, q)
                    if len(near):
                        s = exact_scores(ints[near], x)
                        best = sorted(zip((-s).tolist(), ids[near].tolist(), strict=True))[: z.k]
                        out += [(q, b, -a) for a, b in best]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    found = meets.mapInArrow(run, "query_id long, vec_id long, score long")
    # Each block hands on at most k rows for a query.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= z.k)


def nearest_vectors(embeddings: DataFrame) -> DataFrame:
    """The corpus query: rows whose id is divisible by 100 against all rows."""
    return top_inner_products(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""
