"""Scanned pages made straight and clear: edges, lines, rotation, denoising and local contrast over rows of pixels.

Rows are (page, y, grey) with an array of 0 to 255 each, y without gaps; a shorter row goes on with its last pixel. Work is
done on strips of rows that see as many rows beside themselves as a pixel's result can depend on, so no task needs a whole
page; what belongs to a page (joined edges, votes for lines, tables of contrast) is added up from what strips hand on. All
results are in integers but the tables of contrast, which are in doubles. A page whose id is null is a page for edges and
denoising and is left out where results of a page are joined to it (turning, contrast).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from ..sources import durable
from . import contours, images
from .contours import labelled, matrix, strips, united

#: Gradients from which an edge goes on, and from which it starts.
WEAK, STRONG = 50, 150
#: Fixed value: the tangent of 22.5 degrees in 32768ths.
TANGENT = 13573
#: Votes that a line needs, and how many lines of a page count, for the angle of the page and for that of the strokes.
PAGE_LINES, STROKE_LINES = (100, 20), (30, 50)
#: Pixels of a tile's side when a page is turned.
TILE = 256
#: Denoising: strength, half a patch and half the neighbourhood searched, weights under a thousandth don't count.
STRENGTH, PATCH, SEARCH, FAINT = 12.0, 3, 10, 0.001
#: Contrast: how far a level may exceed its even share, tiles along a side.
CLIP, TILES = 3.0, 8


def _type(rows: DataFrame) -> DataType:
    return rows.schema["page"].dataType


def _view(table: pa.Table, column: str, top: int, size: int, above: int, below: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Pixels of a strip with the rows beside it, which rows are there, and the first and last of them by number in the view."""
    pixels, there = matrix(table, column, top - above, above + size + below)
    lengths = np.zeros(len(there), np.int64)
    at = table.column("y").to_numpy().astype(np.int64) - top + above
    ok = (at >= 0) & (at < len(there))
    values = table.column(column).combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    lengths[at[ok]] = values.value_lengths().to_numpy(zero_copy_only=False)[ok]
    for i in np.flatnonzero((lengths < pixels.shape[1]) & (lengths > 0)):
        pixels[i, lengths[i] :] = pixels[i, lengths[i] - 1]
    known = np.flatnonzero(there)
    return pixels, there, int(known[0]), int(known[-1])


def _rows(page: object, kind: pa.DataType, y: np.ndarray, pixels: np.ndarray, name: str) -> pa.Table:
    cuts = pa.array(np.arange(len(y) + 1) * pixels.shape[1], pa.int32())
    return pa.table({"page": pa.array([page] * len(y), kind), "y": pa.array(y, pa.int64()), name: pa.ListArray.from_arrays(cuts, pa.array(pixels.ravel().astype(np.int32)))})


def _key(table: pa.Table) -> tuple[object, pa.DataType]:
    return table.column("page")[0].as_py(), table.schema.field("page").type


# Edges


def edge_strength(pixels: np.ndarray, there: np.ndarray, first: int, last: int) -> np.ndarray:
    """2 for pixels of a strong ridge of the gradient, 1 for those of a weak one, else 0; the outer two rows of the view are not told."""
    p = pixels[np.clip(np.arange(len(pixels)), first, last)]
    p = np.pad(p, 1, mode="edge")
    dx = (p[:-2, 2:] - p[:-2, :-2]) + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + (p[2:, 2:] - p[2:, :-2])
    dy = (p[2:, :-2] - p[:-2, :-2]) + 2 * (p[2:, 1:-1] - p[:-2, 1:-1]) + (p[2:, 2:] - p[:-2, 2:])
    size = np.where(there[:, None], np.abs(dx) + np.abs(dy), 0)  # nothing beyond the page
    m = np.pad(size, 1)
    here, left, right, up, down = m[1:-1, 1:-1], m[1:-1, :-2], m[1:-1, 2:], m[:-2, 1:-1], m[2:, 1:-1]
    x, y = np.abs(dx).astype(np.int64), np.abs(dy).astype(np.int64) << 15
    flat = y < x * TANGENT
    steep = ~flat & (y > x * TANGENT + (x << 16))
    turned = (dx ^ dy) < 0
    over, under = np.where(turned, m[:-2, 2:], m[:-2, :-2]), np.where(turned, m[2:, :-2], m[2:, 2:])
    ridge = np.where(flat, (here > left) & (here >= right), np.where(steep, (here > up) & (here >= down), (here > over) & (here > under)))
    return np.where(ridge & (here > WEAK), 1 + (here > STRONG), 0)


def edge_runs(rows: DataFrame, size: int | None = None) -> DataFrame:
    """(page, y, x0, x1): the runs of edge pixels of grey rows.

    An edge pixel's gradient (three by three, sum of both sides) is over 50 and largest across its direction, and the pixel
    is joined over eight neighbours of that kind to one whose gradient is over 150.
    """
    height, kind = size or contours.STRIP, _type(rows).simpleString()

    def strength(table: pa.Table) -> pa.Table:
        top = table.column("strip")[0].as_py() * height
        pixels, there, first, last = _view(table, "grey", top, height, 2, 2)
        own = np.flatnonzero(there[2 : 2 + height])
        return _rows(*_key(table), own + top, edge_strength(pixels, there, first, last)[2 + own] if len(own) else np.zeros((0, 0), np.int32), "edge")

    def runs(table: pa.Table) -> pa.Table:
        strip = table.column("strip")[0].as_py()
        top = strip * height
        edge, _ = matrix(table, "edge", top, height + 1, np.int8, right=1)
        labels, number = labelled(edge > 0)
        flat = number.ravel()
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        ends = np.r_[first[1:], edge.size]
        on = edge.ravel()[first] > 0
        strong = np.maximum.reduceat(edge.ravel(), first) == 2
        y, x0 = first // edge.shape[1], first % edge.shape[1]
        cells = {"y": top + y, "x0": x0, "x1": x0 + ends - first - 1, "label": (np.int64(strip) << 32) + labels.ravel()[first], "strong": strong.astype(np.int64), "shared": (y == height).astype(np.int64)}
        page, t = _key(table)
        return pa.table({"page": pa.array([page] * int(on.sum()), t), **{c: pa.array(v[on].astype(np.int64)) for c, v in cells.items()}})

    def joined(table: pa.Table) -> pa.Table:
        y, x0, label, shared = (table.column(c).to_numpy() for c in ("y", "x0", "label", "shared"))
        names, code = np.unique(label, return_inverse=True)
        order = np.lexsort((shared, x0, y))
        twin = np.flatnonzero((y[order][1:] == y[order][:-1]) & (x0[order][1:] == x0[order][:-1]))
        root = united(len(names), code[order][twin], code[order][twin + 1])[code]
        good = np.zeros(len(names), bool)
        good[root[table.column("strong").to_numpy() > 0]] = True
        return table.filter(pa.array(good[root] & (shared == 0))).select(["page", "y", "x0", "x1"])

    own = rows.where("y IS NOT NULL AND size(grey) > 0").select("page", "y", "grey")
    edge = strips(own, 2, 2, height).groupBy("page", "strip").applyInArrow(strength, f"page {kind}, y long, edge array<int>")
    parts = strips(edge, 0, 1, height).groupBy("page", "strip").applyInArrow(runs, f"page {kind}, y long, x0 long, x1 long, label long, strong long, shared long")
    return parts.groupBy("page").applyInArrow(joined, f"page {kind}, y long, x0 long, x1 long")


def edges(rows: DataFrame, size: int | None = None) -> DataFrame:
    """(page, y, edge): 255 for each edge pixel, 0 for the others."""
    found = edge_runs(rows, size).groupBy("page", "y").agg(F.collect_list(F.struct("x0", "x1")).alias("runs")).withColumnsRenamed({"page": "_page", "y": "_y"})
    own = rows.select("page", F.col("y").cast("long").alias("y"), F.size("grey").alias("n")).join(found, F.col("page").eqNullSafe(F.col("_page")) & (F.col("y") == F.col("_y")), "left")
    inside = lambda i: F.exists("runs", lambda r: (r["x0"] <= i) & (r["x1"] >= i))
    return own.select("page", "y", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(inside(i), 255).otherwise(0)).alias("edge"))


# Lines


def ink_runs(rows: DataFrame, column: str = "ink") -> DataFrame:
    """(page, y, x0, x1) of the pixels over 0 in an array column."""
    on = lambda c, i: F.coalesce(F.try_element_at(c, (i + 1).cast("int")) > 0, F.lit(False))
    at = F.sequence(F.lit(0), F.size(column))
    starts = F.filter(at, lambda i: on(F.col(column), i) & ~F.when(i > 0, on(F.col(column), i - 1)).otherwise(False))
    ends = F.filter(at, lambda i: ~on(F.col(column), i) & F.when(i > 0, on(F.col(column), i - 1)).otherwise(False))
    cuts = rows.where(F.size(column) > 0).select("page", F.col("y").cast("long").alias("y"), F.explode(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("r"))
    return cuts.select("page", "y", F.col("r.a").cast("long").alias("x0"), (F.col("r.b") - 1).cast("long").alias("x1"))


def thinned(rows: DataFrame) -> DataFrame:
    """(page, y, ink): ink pixels whose upper neighbour is ink as well; the first row of a page stays."""
    up = F.lag("ink").over(Window.partitionBy("page").orderBy("y"))
    return rows.withColumn("up", up).select("page", "y", F.when(F.col("up").isNull(), F.col("ink")).otherwise(F.zip_with("ink", "up", lambda a, b: F.when((a > 0) & (b > 0), 1).otherwise(0).cast("tinyint"))).alias("ink"))


_ANGLES = np.arange(180) * math.pi / 180
COS, SIN = np.cos(_ANGLES).astype(np.float32), np.sin(_ANGLES).astype(np.float32)


def line_votes(runs: DataFrame) -> DataFrame:
    """(page, theta, rho, votes): how many pixels of the runs lie on the line with this normal angle in degrees and distance.

    Each task counts its pixels; the counts are added up.
    """
    kind = _type(runs).simpleString()

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            pages = rows.column("page").combine_chunks().dictionary_encode(null_encoding="encode")
            pages = pages if isinstance(pages, pa.DictionaryArray) else pa.concat_arrays(pages.chunks)
            code = pages.indices.to_numpy()
            y, x0, x1 = (rows.column(c).to_numpy() for c in ("y", "x0", "x1"))
            for k in range(len(pages.dictionary)):
                own = np.flatnonzero(code == k)
                n = (x1 - x0 + 1)[own]
                row = np.repeat(y[own], n).astype(np.float32)
                col = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x0[own], n)).astype(np.float32)
                far = int(np.hypot(col.max(), row.max())) + 2
                votes = np.zeros(180 * (2 * far + 1), np.int64)
                for s in range(0, len(row), 1 << 14):
                    rho = np.rint(col[s : s + (1 << 14), None] * COS + row[s : s + (1 << 14), None] * SIN).astype(np.int64)
                    votes += np.bincount((rho + far + np.arange(180) * (2 * far + 1)).ravel(), minlength=len(votes))
                found = np.flatnonzero(votes)
                yield from pa.table({"page": pages.dictionary.take(pa.array([k] * len(found), pa.int32())), "theta": pa.array(found // (2 * far + 1)), "rho": pa.array(found % (2 * far + 1) - far), "votes": pa.array(votes[found])}).to_batches(100_000)

    parts = runs.select("page", "y", "x0", "x1").mapInArrow(run, f"page {kind}, theta long, rho long, votes long")
    return parts.groupBy("page", "theta", "rho").agg(F.sum("votes").alias("votes"))


def lines(runs: DataFrame, least: int, first: int) -> DataFrame:
    """(page, rank, angle, rho, votes): the ``first`` lines of each page with over ``least`` votes, most votes first.

    A line has more votes than its neighbours in angle and distance (as many on their far sides); its angle is that of
    its normal less 90 degrees, so 0 is along the rows. Ties go by angle, then distance.
    """
    by_rho, by_theta = Window.partitionBy("page", "theta").orderBy("rho"), Window.partitionBy("page", "rho").orderBy("theta")
    near = lambda c, move, w: F.coalesce(F.when(F.lag(c, move).over(w) == F.col(c) - move, F.lag("votes", move).over(w)), F.lit(0))
    rows = line_votes(runs).select("*", near("rho", 1, by_rho).alias("r1"), near("rho", -1, by_rho).alias("r2"))
    rows = rows.select("*", near("theta", 1, by_theta).alias("t1"), near("theta", -1, by_theta).alias("t2"))
    peaks = rows.where((F.col("votes") > least) & (F.col("votes") > F.col("r1")) & (F.col("votes") >= F.col("r2")) & (F.col("votes") > F.col("t1")) & (F.col("votes") >= F.col("t2")))
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("votes"), "theta", "rho"))
    return peaks.withColumn("rank", rank).where(F.col("rank") <= first).select("page", "rank", (F.col("theta") - 90).cast("double").alias("angle"), "rho", "votes")


def page_angles(rows: DataFrame) -> DataFrame:
    """(page, angle): what grey pages are to be turned by; pages that stand straight, or without lines, have no row."""
    found = images.median_angle(lines(edge_runs(rows), *PAGE_LINES), PAGE_LINES[1])
    return found.select("page", images.skew(F.col("angle")).alias("angle")).where("angle <> 0")


def slants(inked: DataFrame) -> DataFrame:
    """(page, slant) of pages (page, y, ink), from the lines of their thinned strokes; pages without lines have no row."""
    found = images.median_angle(lines(ink_runs(thinned(inked)), *STROKE_LINES), STROKE_LINES[1])
    return found.select("page", images.slant(F.col("angle")).alias("slant"))


# Rotation


def back_map(width: int, height: int, angle: float) -> tuple[float, float, float, float, float, float]:
    """(a, b, c, d, e, f): the point (a x + b y + c, d x + e y + f) of a page comes to (x, y) when it is turned about its middle."""
    cos, sin, cx, cy = math.cos(math.radians(angle)), math.sin(math.radians(angle)), width // 2, height // 2
    return cos, -sin, cx - cos * cx + sin * cy, sin, cos, cy - sin * cx - cos * cy


def sources_of(m: tuple[float, ...], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pixels come from, in 32nds of a pixel."""
    whole = lambda v: np.rint(v * 1024).astype(np.int64)
    return (whole(m[0] * x) + whole(m[1] * y + m[2]) + 16) >> 5, (whole(m[3] * x) + whole(m[4] * y + m[5]) + 16) >> 5


def turned(rows: DataFrame, angles: DataFrame, tile: int | None = None) -> DataFrame:
    """Grey rows of the pages in ``angles`` (page, angle in degrees, counter-clockwise), turned about their middle.

    Pixels are mixed of the four around their source in 1024ths; what comes from beyond the page repeats its border. A
    page is cut into tiles, and each tile of the result gets the tiles of the page that its pixels come from.
    """
    side, kind = tile or TILE, _type(rows).simpleString()
    own = rows.select("page", F.col("y").cast("long").alias("y"), "grey").where(F.size("grey") > 0)
    sizes = own.groupBy("page").agg(F.max(F.size("grey")).cast("long").alias("width"), F.min("y").alias("top"), (F.max("y") - F.min("y") + 1).alias("height")).join(angles.select("page", "angle"), "page")
    sizes = durable(sizes)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("width") - 1) / side)), lambda k: F.struct(k.alias("sx"), F.slice("grey", (k * side + 1).cast("int"), F.lit(side)).alias("part")))
    wide = own.join(sizes, "page")
    full = F.when(F.size("grey") < F.col("width"), F.concat("grey", F.array_repeat(F.element_at("grey", -1), (F.col("width") - F.size("grey")).cast("int")))).otherwise(F.col("grey"))
    cut = wide.withColumn("grey", full).select("page", (F.col("y") - F.col("top")).alias("y"), F.floor((F.col("y") - F.col("top")) / side).alias("sy"), F.explode(parts).alias("p")).select("page", "y", "sy", "p.sx", "p.part")

    def wanted(table: pa.Table) -> pa.Table:
        """For each tile of the result the tiles that its pixels come from."""
        page, width, height, angle = (table.column(c)[0].as_py() for c in ("page", "width", "height", "angle"))
        m, found = back_map(width, height, angle), []
        for oy in range(-(-height // side)):
            for ox in range(-(-width // side)):
                x, y = np.array([ox * side, min(width, (ox + 1) * side) - 1] * 2), np.repeat([oy * side, min(height, (oy + 1) * side) - 1], 2)
                at = [np.clip(np.r_[s.min() // 32 - 1, s.max() // 32 + 2], 0, n - 1) // side for s, n in zip(sources_of(m, x, y), (width, height), strict=True)]
                found += [(oy, ox, sy, sx) for sy in range(at[1][0], at[1][1] + 1) for sx in range(at[0][0], at[0][1] + 1)]
        cells = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
        return pa.table([pa.array([page] * len(found), table.schema.field("page").type), *cells], ["page", "oy", "ox", "sy", "sx"])

    def turn(key: tuple, source: pa.Table, size: pa.Table) -> pa.Table:
        page, oy, ox = (k.as_py() for k in key)
        t = source.schema.field("page").type
        width, height, angle, top = (size.column(c)[0].as_py() for c in ("width", "height", "angle", "top"))
        y, sx = source.column("y").to_numpy(), source.column("sx").to_numpy()
        left, first = int(sx.min()) * side, int(y.min())
        pixels = np.zeros((int(y.max()) - first + 1, (int(sx.max()) - int(sx.min()) + 1) * side), np.int64)
        for row, k, part in zip(y.tolist(), sx.tolist(), source.column("part"), strict=True):
            values = part.values.to_numpy()
            pixels[row - first, k * side - left : k * side - left + len(values)] = values
        gy, gx = np.mgrid[oy * side : min(height, (oy + 1) * side), ox * side : min(width, (ox + 1) * side)]
        u, v = sources_of(back_map(width, height, angle), gx, gy)
        fx, fy, px, py = u & 31, v & 31, u >> 5, v >> 5
        at = lambda dy, dx: pixels[np.clip(py + dy, 0, height - 1) - first, np.clip(px + dx, 0, width - 1) - left]
        mixed = (at(0, 0) * (32 - fx) + at(0, 1) * fx) * (32 - fy) + (at(1, 0) * (32 - fx) + at(1, 1) * fx) * fy
        out = _rows(page, t, gy[:, 0] + top, (mixed + 512) >> 10, "part")
        return out.append_column("ox", pa.array([ox] * out.num_rows, pa.int64()))

    needs = sizes.groupBy("page").applyInArrow(wanted, f"page {kind}, oy long, ox long, sy long, sx long")
    needs = durable(needs)
    got = cut.join(needs, ["page", "sy", "sx"]).select("page", "oy", "ox", "y", "sx", "part").groupBy("page", "oy", "ox")
    every = needs.select("page", "oy", "ox").distinct().join(sizes, "page").withColumnsRenamed({"page": "of", "oy": "ty", "ox": "tx"}).groupBy("of", "ty", "tx")
    tiles = got.cogroup(every).applyInArrow(turn, f"page {kind}, y long, part array<int>, ox long")
    return tiles.groupBy("page", "y").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ox", "part"))), lambda s: s["part"])).alias("grey"))


def deskewed(rows: DataFrame) -> DataFrame:
    """Grey rows with pages turned by the median angle of their first lines, if that is half a degree or more."""
    rows = durable(rows.select("page", F.col("y").cast("long").alias("y"), "grey"))
    angles = durable(page_angles(rows))
    return rows.join(angles, "page", "left_anti").unionByName(turned(rows, angles))


# Denoising


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the ends of n pixels, mirrored at the end pixels."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.minimum(i, 2 * n - 2 - i)


#: Weights are in these parts, so that the sum over the neighbourhood stays within 31 bits.
WHOLE = (2**31 - 1) // ((2 * SEARCH + 1) ** 2 * 255)
#: Sums over a patch are counted in steps of this power of two of their pixels.
SHIFT = ((2 * PATCH + 1) ** 2 - 1).bit_length()


def weight_table(strength: float = STRENGTH) -> np.ndarray:
    """The weight for each step of the mean squared difference of two patches."""
    mean = np.arange((255**2 * (2 * PATCH + 1) ** 2 >> SHIFT) + 1) * (2.0**SHIFT / (2 * PATCH + 1) ** 2)
    w = np.rint(WHOLE * np.exp(-mean / strength**2)).astype(np.int64)
    return np.where(w < FAINT * WHOLE, 0, w)


def denoised_pixels(pixels: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The inner pixels of a view with ``SEARCH + PATCH`` more on each side: means of the neighbourhood by likeness of patches.

    For each offset the squared differences are summed along both sides by running sums, so a patch costs four lookups.
    """
    reach, n = SEARCH + PATCH, 2 * PATCH + 1
    h, w = pixels.shape[0] - 2 * reach, pixels.shape[1] - 2 * reach
    p = pixels.astype(np.int64)
    centre = p[SEARCH : SEARCH + h + 2 * PATCH, SEARCH : SEARCH + w + 2 * PATCH]
    total, weights = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    area = np.zeros((h + 2 * PATCH + 1, w + 2 * PATCH + 1), np.int64)
    for dy in range(2 * SEARCH + 1):
        for dx in range(2 * SEARCH + 1):
            other = p[dy : dy + h + 2 * PATCH, dx : dx + w + 2 * PATCH]
            np.cumsum(np.cumsum((centre - other) ** 2, axis=0), axis=1, out=area[1:, 1:])
            apart = area[n:, n:] - area[:-n, n:] - area[n:, :-n] + area[:-n, :-n]
            k = table[apart >> SHIFT]
            weights += k
            total += k * other[PATCH : PATCH + h, PATCH : PATCH + w]
    return (total + weights // 2) // weights


def denoised(rows: DataFrame, size: int | None = None, strength: float = STRENGTH) -> DataFrame:
    """Grey rows, each pixel the mean of those within 10 pixels whose 7 x 7 patches are like its own; borders are mirrored."""
    height, kind, reach = size or contours.STRIP, _type(rows).simpleString(), SEARCH + PATCH
    table_ = weight_table(strength)

    def run(table: pa.Table) -> pa.Table:
        top = table.column("strip")[0].as_py() * height
        pixels, there, first, last = _view(table, "grey", top, height, reach, reach)
        own = np.flatnonzero(there[reach : reach + height])
        if not len(own):
            return _rows(*_key(table), own, np.zeros((0, 0), np.int32), "grey")
        y = np.arange(own[0], own[-1] + 1 + 2 * reach)
        rows_at = first + mirrored(y - first, last - first + 1)
        cols_at = mirrored(np.arange(-reach, pixels.shape[1] + reach), pixels.shape[1])
        return _rows(*_key(table), own + top, denoised_pixels(pixels[rows_at][:, cols_at], table_)[own - own[0]], "grey")

    own = rows.where("y IS NOT NULL AND size(grey) > 0").select("page", "y", "grey")
    return strips(own, reach, reach, height).groupBy("page", "strip").applyInArrow(run, f"page {kind}, y long, grey array<int>")


# Local contrast


def page_sizes(rows: DataFrame) -> DataFrame:
    """(page, width, height, top) of grey rows."""
    return rows.where(F.size("grey") > 0).groupBy("page").agg(F.max(F.size("grey")).cast("long").alias("width"), (F.max("y") - F.min("y") + 1).cast("long").alias("height"), F.min("y").cast("long").alias("top"))


def tile_levels(rows: DataFrame) -> DataFrame:
    """(page, tile, level, n, area): how many pixels of each tile have a level.

    A page has 8 x 8 tiles, numbered by rows; it is filled up on the right and below with mirrored pixels to a multiple of 8.
    """
    kind = _type(rows).simpleString()
    sized = rows.select("page", F.col("y").cast("long").alias("y"), "grey").where(F.size("grey") > 0).join(page_sizes(rows), "page")

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            pages = t.column("page").combine_chunks().dictionary_encode(null_encoding="encode")
            pages = pages if isinstance(pages, pa.DictionaryArray) else pa.concat_arrays(pages.chunks)
            code = pages.indices.to_numpy()
            for k in range(len(pages.dictionary)):
                own = np.flatnonzero(code == k)
                width, height, top = (t.column(c)[int(own[0])].as_py() for c in ("width", "height", "top"))
                tw, th = -(-width // TILES), -(-height // TILES)
                at = mirrored(np.arange(tw * TILES), width)
                below = mirrored(np.arange(th * TILES), height)
                counts = np.zeros((TILES * TILES, 256), np.int64)
                column = np.arange(tw * TILES) // tw
                for i in own.tolist():
                    values = t.column("grey")[i].values.to_numpy()
                    values = np.r_[values, np.full(width - len(values), values[-1])][at]
                    levels = np.bincount(column * 256 + values, minlength=TILES * 256).reshape(TILES, 256)
                    for y in np.flatnonzero(below == t.column("y")[i].as_py() - top).tolist():
                        counts[y // th * TILES : (y // th + 1) * TILES] += levels
                tile, level = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pages.dictionary.take(pa.array([k] * len(tile), pa.int32())), pa.array(tile), pa.array(level), pa.array(counts[tile, level]), pa.array([tw * th] * len(tile), pa.int64())], ["page", "tile", "level", "n", "area"])

    parts = sized.mapInArrow(run, f"page {kind}, tile long, level long, n long, area long")
    return parts.groupBy("page", "tile", "level").agg(F.sum("n").alias("n"), F.max("area").alias("area"))


def contrast_tables(levels: DataFrame, clip: float = CLIP) -> DataFrame:
    """(page, tile, level, out): the new level of all 256 in each tile.

    Counts over ``clip`` times the even share are cut; what is cut goes to all levels alike and what is left of it, one
    each, to levels at even steps. The new level is the share of pixels up to it.
    """
    tiles = levels.groupBy("page", "tile").agg(F.max("area").alias("area"))
    every = tiles.select("page", "tile", "area", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("level"))
    most = F.greatest(F.floor(F.lit(clip) * F.col("area") / 256), F.lit(1))
    rows = every.join(levels.select("page", "tile", "level", "n"), ["page", "tile", "level"], "left").withColumn("most", most).withColumn("n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy("page", "tile")
    rows = rows.withColumn("cut", F.sum(F.greatest(F.col("n") - F.col("most"), F.lit(0))).over(whole))
    left = F.col("cut") % 256
    step = F.greatest(F.floor(F.lit(256) / F.greatest(left, F.lit(1))), F.lit(1))
    extra = ((F.col("level") % step == 0) & (F.floor(F.col("level") / step) < left)).cast("long")
    rows = rows.withColumn("n", F.least("n", "most") + F.floor(F.col("cut") / 256) + extra)
    up_to = F.sum("n").over(whole.orderBy("level"))
    return rows.select("page", "tile", "level", F.least(F.rint(up_to * 255.0 / F.col("area")), F.lit(255.0)).cast("long").alias("out"))


def blended(pixels: np.ndarray, y: np.ndarray, width: int, height: int, tables: np.ndarray) -> np.ndarray:
    """Each pixel by the tables (tile, level) of the four tiles whose middles surround it, by nearness."""
    tw, th = -(-width // TILES), -(-height // TILES)
    fx, fy = np.arange(pixels.shape[1]) / tw - 0.5, y / th - 0.5
    x1, y1 = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
    wx, wy = (fx - x1)[None, :], (fy - y1)[:, None]
    x1, x2, y1, y2 = np.clip(x1, 0, None)[None, :], np.clip(x1 + 1, None, TILES - 1)[None, :], np.clip(y1, 0, None)[:, None], np.clip(y1 + 1, None, TILES - 1)[:, None]
    at = lambda j, i: tables[j * TILES + i, pixels]
    return np.rint((at(y1, x1) * (1 - wx) + at(y1, x2) * wx) * (1 - wy) + (at(y2, x1) * (1 - wx) + at(y2, x2) * wx) * wy).astype(np.int64)


def local_contrast(rows: DataFrame, clip: float = CLIP, size: int | None = None) -> DataFrame:
    """Grey rows whose levels are spread out within 8 x 8 tiles of their page."""
    height, kind = size or contours.STRIP, _type(rows).simpleString()
    rows = durable(rows.select("page", F.col("y").cast("long").alias("y"), "grey").where(F.size("grey") > 0))
    tables = contrast_tables(tile_levels(rows), clip).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "level", "out"))), lambda s: s["out"]).alias("table"))
    sizes = page_sizes(rows).join(tables, "page")
    place = lambda c: F.floor(c / height)
    given = sizes.select(F.col("page").alias("of"), "width", "height", "top", "table", F.explode(F.sequence(place(F.col("top")), place(F.col("top") + F.col("height") - 1))).alias("part"))

    def run(table: pa.Table, page: pa.Table) -> pa.Table:
        if not table.num_rows or not page.num_rows:  # a strip without rows, a page without an id
            return _rows(None, table.schema.field("page").type, np.zeros(0, np.int64), np.zeros((0, 0), np.int32), "grey")
        strip, width, tall, top = (page.column(c)[0].as_py() for c in ("part", "width", "height", "top"))
        pixels, there, _, _ = _view(table, "grey", strip * height, height, 0, 0)
        y = np.flatnonzero(there)
        pixels = pixels[y]
        pixels = np.pad(pixels, ((0, 0), (0, width - pixels.shape[1])), mode="edge")
        out = blended(pixels, y + strip * height - top, width, tall, page.column("table")[0].values.to_numpy().reshape(TILES * TILES, 256))
        return _rows(*_key(table), y + strip * height, out, "grey")

    own = rows.withColumn("strip", place(F.col("y"))).groupBy("page", "strip")
    return own.cogroup(given.groupBy("of", "part")).applyInArrow(run, f"page {kind}, y long, grey array<int>")


# Pages from scan to hand


def enhanced(rows: DataFrame) -> DataFrame:
    """Grey rows without noise, turned straight, denoised and with local contrast, as they go to recognition."""
    return local_contrast(denoised(deskewed(images.without_noise(rows))))


def preprocessed(rows: DataFrame) -> DataFrame:
    """(page, y, grey, binary) of scanned grey rows: enhanced and binarized."""
    return images.binarized(durable(enhanced(rows)))


def page_metrics(rows: DataFrame) -> DataFrame:
    """``images.page_metrics`` of binarized rows, with the number of outermost borders of black pixels."""
    rows = durable(rows)
    counts = contours.outer_count(rows, contours.contours(contours.black(rows)))
    return images.page_metrics(images.ink_rows(rows)).join(counts, "page")


def hand_pages(rows: DataFrame) -> DataFrame:
    """All values of a page's hand and its fingerprint, from binarized rows (page, y, grey, binary)."""
    rows = durable(rows)
    inked = durable(contours.ink(rows))
    strokes = durable(contours.as_strokes(contours.contours(inked)))
    profile = durable(images.ink_rows(rows))
    metrics = images.page_metrics(profile).select("page", "height", "width", "pressure")
    found = images.stroke_features(strokes, metrics).join(images.line_features(profile), "page").join(metrics.select("page", "pressure"), "page")
    found = found.join(images.stroke_shape(strokes), "page", "left").join(slants(inked), "page", "left").fillna({"loop_density": 0.0, "baseline_deviation": 0.5, "slant": 0.0})
    return images.fingerprint(found)


def identity_features(rows: DataFrame) -> DataFrame:
    """The five features of the alternative detector from binarized rows."""
    rows = durable(rows)
    inked = durable(contours.ink(rows))
    sheets = inked.groupBy("page").agg(F.count("*").alias("height"), F.max(F.size("ink")).alias("width"), F.sum(F.aggregate("ink", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ink"))
    return images.identity_features(contours.as_strokes(contours.contours(inked), open_ends=False), sheets)
