"""Contours of page images: the borders of strokes and of the holes in them, with polygon area, length and box.

Pixels of ink are connected over eight neighbours, the background over four. A border lies between one stroke and one
piece of background; its polygon runs through the centres of the stroke's pixels. What a border is made of can be read
from squares of four pixels: every side of the polygon lies in one of them, so lengths and areas (by cross products of the
sides' ends) are sums over such squares and need no walk along the border.

A page is cut into strips of rows. Each strip is labelled by runs that are united where they touch, and hands on its parts,
the sums of its borders and the labels along its seams, no pixels. A page's task unites the labels at the seams and adds
up: it holds as many rows as the page has parts of strokes. Missing rows and the ends of short ones are background.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a strip.
STRIP = 256
#: Rows that a strip sees below itself.
BELOW = 2

PART, GROUND, SIDE, SEAM, CHAIN, FRAME = range(6)
CELLS = ("a", "b", "p", "q", "r", "s", "t", "u", "v", "w")
#: Directions of the last straight part of a border before its first pixel: along the row, or up from below.
ALONG, FROM_RIGHT, FROM_BELOW, FROM_LEFT = range(4)
STEP = {FROM_RIGHT: 1, FROM_BELOW: 0, FROM_LEFT: -1}

CONTOURS = "x long, y long, w long, h long, area double, perimeter double, open_length double, hole boolean, inner boolean"


def strips(rows: DataFrame, above: int, below: int, size: int) -> DataFrame:
    """Rows of pages with ``strip``, each in every strip that it lies in or within ``above`` rows over or ``below`` rows under."""
    y = F.col("y").cast("long")
    first, last = F.floor((y - below) / size), F.floor((y + above) / size)
    return rows.withColumn("strip", F.explode(F.sequence(first, last)))


def matrix(table: pa.Table, column: str, first: int, height: int, kind: type = np.int32, fill: int = 0, left: int = 0, right: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of ``height`` rows from ``first`` on, with columns of ``fill`` beside them, and which rows are there."""
    values = table.column(column).combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    at = table.column("y").to_numpy().astype(np.int64) - first
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(kind)
    out = np.full((height, left + (int(sizes.max()) if len(sizes) else 0) + right), fill, kind)
    cuts, there = np.r_[0, np.cumsum(sizes)], np.zeros(height, bool)
    for i in np.flatnonzero((at >= 0) & (at < height)):
        out[at[i], left : left + sizes[i]] = flat[cuts[i] : cuts[i + 1]]
        there[at[i]] = True
    return out, there


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the smallest one that the links lead to."""
    parent = np.arange(n)
    while len(a):
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def labelled(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels of all pixels, the run of each pixel): ink joined over eight, ground over four neighbours, a label is its first run."""
    new = np.ones(on.shape, bool)
    new[:, 1:] = on[:, 1:] != on[:, :-1]
    runs = (np.cumsum(new) - 1).reshape(on.shape)
    up, down = on[:-1], on[1:]
    met = (up == down) & (new[:-1] | new[1:])
    links = [(runs[:-1][met], runs[1:][met])]
    for x, z in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):  # only over a corner
        corner = up[:, x] & down[:, z] & ~up[:, z] & ~down[:, x]
        links.append((runs[:-1][:, x][corner], runs[1:][:, z][corner]))
    parent = united(int(runs[-1, -1]) + 1, *(np.concatenate(c) for c in zip(*links, strict=True)))
    return parent[runs], runs


def _sides() -> dict[int, list[tuple]]:
    """For each pattern of four pixels (bits of left and right above, left and right below) the sides in it: (from, to,
    pixel of ink, pixel of ground), the ground always on the same hand; a pixel alone meets its ground without a side."""
    corners, out = [(0, 0), (1, 0), (0, 1), (1, 1)], {}
    for pattern in range(1, 15):
        ink = [c for i, c in enumerate(corners) if pattern >> i & 1]
        ground = [c for c in corners if c not in ink]
        if len(ink) == 1:
            out[pattern] = [(ink[0], ink[0], ink[0], ground[0])]
            continue
        if len(ink) == 3:
            ink = [c for c in ink if (c[0] == ground[0][0]) != (c[1] == ground[0][1])]
        corner = len(ink) == 2 and ink[0][0] != ink[1][0] and ink[0][1] != ink[1][1]
        out[pattern] = []
        for g in ground if corner else ground[:1]:
            p, q = ink
            turn = (q[0] - p[0]) * (g[1] - p[1]) - (q[1] - p[1]) * (g[0] - p[0])
            out[pattern].append((p, q, p, g) if turn < 0 else (q, p, p, g))
    return out


SIDES = _sides()


def border_sums(on: np.ndarray, labels: np.ndarray, left: int, top: int) -> np.ndarray:
    """Rows (ink, ground, straight sides, slanting sides, sum of cross products) of the squares of four pixels."""
    pattern = on[:-1, :-1] + 2 * on[:-1, 1:] + 4 * on[1:, :-1] + 8 * on[1:, 1:].astype(np.int8)
    found = []
    for k, sides in SIDES.items():
        y, x = np.nonzero(pattern == k)
        for p, q, ink, ground in sides:
            if len(x):
                px, py, qx, qy = x + (left + p[0]), y + (top + p[1]), x + (left + q[0]), y + (top + q[1])
                straight, slanting = int((p[0] == q[0]) != (p[1] == q[1])), int(p[0] != q[0] and p[1] != q[1])
                ends = [labels[y + c[1], x + c[0]] for c in (ink, ground)]
                found.append(np.stack([*ends, np.full(len(x), straight), np.full(len(x), slanting), px * qy - qx * py]))
    if not found:
        return np.zeros((5, 0), np.int64)
    rows = np.concatenate(found, axis=1).astype(np.int64)
    key, at = np.unique(rows[0] << 32 | rows[1], return_inverse=True)
    sums = np.zeros((3, len(key)), np.int64)
    for s, r in zip(sums, rows[2:], strict=True):
        np.add.at(s, at, r)
    return np.stack([key >> 32, key & 0xFFFFFFFF, *sums])


def chains(on: np.ndarray, height: int) -> dict[int, np.ndarray]:
    """For each direction and pixel of rows 1 to ``height`` how many pixels on a border that goes up from the pixel's lower
    neighbour straight through it, counted downwards from it; ``on`` has a column of ground on each side."""
    near = np.zeros((3, 3, height + 2, on.shape[1]), bool)  # of each pixel by rows and columns beside it
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            part = np.zeros((height + 2, on.shape[1]), bool)
            rows = on[1 + dy : height + 1 + dy]
            part[1 : height + 1, max(0, -dx) : on.shape[1] - max(0, dx)] = rows[:, max(0, dx) : on.shape[1] + min(0, dx)]
            near[dy + 1, dx + 1] = part
    n, ne, e, se, s, sw = near[0, 1], near[0, 2], near[1, 2], near[2, 2], near[2, 1], near[2, 0]
    through = {FROM_RIGHT: ~n & ~ne & ~e & se, FROM_BELOW: ~ne & ~e & ~se & s, FROM_LEFT: ~e & ~se & ~s & sw}
    out = {}
    for way, ok in through.items():
        ok &= near[1, 1]
        length = np.zeros((height + 2, on.shape[1]), np.int64)
        for r in range(height, 0, -1):
            below = np.roll(length[r + 1], -STEP[way])
            length[r] = np.where(ok[r], 1 + below, 0)
        out[way] = length
    return out


def strip_parts(table: pa.Table, size: int) -> dict[str, np.ndarray]:
    """What a strip hands on: see ``page_contours``."""
    strip = table.column("strip")[0].as_py()
    top = strip * size
    pixels, _ = matrix(table, "ink", top, size + BELOW, np.int8, left=1, right=1)
    on = pixels > 0
    own = on[: size + 1]
    labels, runs = labelled(own)
    base = np.int64(strip) << 32
    flat = runs.ravel()
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])  # where each run begins
    width = own.shape[1]
    y, x0 = first // width, first % width - 1
    x1 = np.r_[first[1:], own.size] - first + x0 - 1
    label, ink = labels.ravel()[first], own.ravel()[first]
    out: dict[str, list] = {c: [] for c in ("kind", *CELLS)}

    def add(kind: int, n: int, **cells: np.ndarray | int) -> None:
        out["kind"].append(np.full(n, kind, np.int64))
        for c in CELLS:
            v = cells.get(c, 0)
            out[c].append(np.full(n, v, np.int64) if np.isscalar(v) else np.asarray(v, np.int64))

    mine = y < size
    for kind, which in ((PART, mine & ink), (GROUND, mine & ~ink)):
        names, at = np.unique(label[which], return_inverse=True)
        if not len(names):
            continue
        box = [np.full(len(names), 1 << 40), np.full(len(names), -(1 << 40)), np.full(len(names), 1 << 40), np.full(len(names), -(1 << 40))]
        for cell, pick, value in zip(box, (np.minimum, np.maximum) * 2, (x0, x1, y, y), strict=True):
            pick.at(cell, at, value[which])
        more = {}
        if kind == PART:  # a label is the number of its first run, which holds the first pixel
            sx, sy, ex = x0[names], y[names], x1[names]
            below = [own[sy + 1, np.clip(sx + 1 + dx, 0, width - 1)] for dx in (1, 0, -1)]
            way = np.select([ex > sx, *below], [ALONG, FROM_RIGHT, FROM_BELOW, FROM_LEFT], -1)
            length, leaves = np.where(way == ALONG, ex - sx, np.where(way < 0, 0, 1)), np.full(len(names), -2)
            straight = chains(on, size)
            for k, step in STEP.items():
                i = np.flatnonzero(way == k)
                n = straight[k][sy[i] + 1, sx[i] + 1 + step]
                length[i] += n
                leaves[i] = np.where((n > 0) & (sy[i] + n == size), sx[i] + step * (1 + n), -2)
            more = {"b": base + labels[sy, sx], "t": sx, "u": length, "v": way, "w": leaves}
            for k, step in STEP.items():
                at_top = np.flatnonzero(straight[k][1])
                n = straight[k][1][at_top]
                add(CHAIN, len(at_top), p=top + 1, q=at_top - 1, r=k, u=n, w=np.where(n == size, at_top - 1 + step * n, -2))
        add(kind, len(names), a=base + names, p=box[0], q=box[1], r=top + box[2], s=top + box[3], **more)
    ends = border_sums(own, labels, -1, top)
    add(SIDE, ends.shape[1], a=base + ends[0], b=base + ends[1], p=ends[2], q=ends[3], r=ends[4])
    for row in (0, size):
        i = np.flatnonzero(y == row)
        add(SEAM, len(i), a=base + label[i], p=top + row, q=x0[i], r=int(row > 0))
    add(FRAME, 1, a=base + labels[0, 0])
    return {c: np.concatenate(v) for c, v in out.items()}


def page_contours(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The contours of a page from the parts of its strips.

    Parts: label, ground to its left, box, first column, last straight part of its border (length, direction, where it
    leaves the strip). Ground: label, box. Sides: ink, ground and the sums between them. Seams: labels of the runs of a
    shared row. Chains: straight parts that enter a strip. Frame: the label of what surrounds the page.
    """
    of = {k: {c: v[cells["kind"] == k] for c, v in cells.items()} for k in range(6)}
    part, ground, side, seam, chain = (of[k] for k in (PART, GROUND, SIDE, SEAM, CHAIN))
    names = np.unique(np.concatenate([part["a"], ground["a"], side["a"], side["b"], seam["a"], of[FRAME]["a"], part["b"]]))
    code = lambda x: np.searchsorted(names, x)
    order = np.lexsort((seam["r"], seam["q"], seam["p"]))
    y, x, a = (seam[c][order] for c in ("p", "q", "a"))
    twin = np.flatnonzero((y[1:] == y[:-1]) & (x[1:] == x[:-1]))
    frame = code(of[FRAME]["a"])
    root = united(len(names), np.r_[code(a[twin]), frame[1:]], np.r_[code(a[twin + 1]), frame[:-1]])
    outside = root[frame[0]]

    def boxes(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        kinds, at = np.unique(root[code(rows["a"])], return_inverse=True)
        box = [np.full(len(kinds), v) for v in (1 << 60, -(1 << 60)) * 2]
        for cell, pick, c in zip(box, (np.minimum, np.maximum) * 2, "pqrs", strict=True):
            pick.at(cell, at, rows[c])
        return kinds, box

    strokes, stroke_box = boxes(part)
    fields, field_box = boxes(ground)
    # The first pixel of a stroke is that of its first part in reading order; the ground to its left surrounds the stroke.
    order = np.lexsort((part["t"], part["r"], root[code(part["a"])]))
    head = order[np.r_[True, np.diff(root[code(part["a"])][order]) > 0]] if len(order) else order
    around = root[code(part["b"][head] - 0)] if len(head) else head
    entering = {(r, x, d): (n, w) for r, x, d, n, w in zip(*(chain[c].tolist() for c in "pqruw"), strict=True)}
    last = np.zeros(len(head))
    for i, h in enumerate(head.tolist()):
        n, way, at, row = int(part["u"][h]), int(part["v"][h]), int(part["w"][h]), int(part["r"][h])
        while at >= -1:  # the straight part goes on in the next strip
            more, at = entering.get((row + n, at, way), (0, -2))
            n += more
        last[i] = n * (math.sqrt(2) if way in (FROM_RIGHT, FROM_LEFT) else 1.0)

    key = root[code(side["a"])] * len(names) + root[code(side["b"])]
    pairs, at = np.unique(key, return_inverse=True)
    straight, slanting, cross = (np.zeros(len(pairs), np.int64) for _ in range(3))
    for sums, c in zip((straight, slanting, cross), "pqr", strict=True):
        np.add.at(sums, at, side[c])
    own, other = np.searchsorted(strokes, pairs // max(1, len(names))), pairs % max(1, len(names))
    inner = around[own] != other
    hole = inner | (other != outside)
    perimeter = straight + slanting * math.sqrt(2)
    field = np.minimum(np.searchsorted(fields, other), max(0, len(fields) - 1))
    box = [np.where(inner, f[field] + d, s[own]) if len(pairs) else np.zeros(0, np.int64) for f, s, d in zip(field_box, stroke_box, (-1, 1, -1, 1), strict=True)]
    return {
        "x": box[0], "y": box[2], "w": box[1] - box[0] + 1, "h": box[3] - box[2] + 1, "area": np.abs(cross) / 2.0, "perimeter": perimeter,
        "open_length": np.where(inner, perimeter, perimeter - last[own]) if len(pairs) else perimeter, "hole": hole, "inner": inner,
    }


def contours(rows: DataFrame, size: int | None = None) -> DataFrame:
    """(page, x, y, w, h, area, perimeter, open_length, hole, inner) of every border on the pages ``rows`` (page, y, ink).

    ``ink`` is an array with a number over 0 for each pixel of ink. A border is an outer one of a stroke or one around a
    hole in it (``inner``); ``hole`` is true for all that lie within another border: those around holes, and strokes
    inside holes. Box, area and lengths are those of the polygon through the centres of the stroke's pixels, so a single
    pixel has area and length 0 and a hole is measured by the pixels around it; ``open_length`` leaves out the last
    straight part of an outer border, back to the first pixel. A page without ink has no rows; null arrays are empty.
    """
    height = size or STRIP
    page = next(f for f in rows.schema.fields if f.name == "page")
    cells = ", ".join(f"{c} long" for c in ("kind", *CELLS))

    def cut(table: pa.Table) -> pa.Table:
        found = strip_parts(table, height)
        return pa.table({"page": pa.array([table.column("page")[0].as_py()] * len(found["kind"]), table.schema.field("page").type), **found})

    def join(table: pa.Table) -> pa.Table:
        found = page_contours({c: table.column(c).to_numpy() for c in ("kind", *CELLS)})
        return pa.table({"page": pa.array([table.column("page")[0].as_py()] * len(found["x"]), table.schema.field("page").type), **found})

    kind = page.dataType.simpleString()
    parts = strips(rows.where("y IS NOT NULL").select("page", "y", "ink"), 0, BELOW, height).groupBy("page", "strip").applyInArrow(cut, f"page {kind}, {cells}")
    return parts.groupBy("page").applyInArrow(join, f"page {kind}, {CONTOURS}")


def ink(rows: DataFrame) -> DataFrame:
    """(page, y, ink) of binary rows (0 and 255): ink is the rarer kind of pixel, as in ``images.ink_rows``."""
    light = rows.groupBy("page").agg((F.sum(F.aggregate("binary", F.lit(0).cast("long"), lambda a, x: a + x)) / F.sum(F.size("binary")) > 127).alias("white"))
    on = F.transform("binary", lambda b: F.when(F.col("white"), b == 0).otherwise(b == 255).cast("tinyint"))
    return rows.select("page", "y", "binary").join(light.withColumnRenamed("page", "_page"), F.col("page").eqNullSafe(F.col("_page"))).select("page", "y", on.alias("ink"))


def black(rows: DataFrame) -> DataFrame:
    """(page, y, ink) of binary rows: every black pixel."""
    return rows.select("page", "y", F.transform("binary", lambda b: (b == 0).cast("tinyint")).alias("ink"))


def outer_count(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page, char_count) of ``pages``: outermost borders, 0 where there are none."""
    counts = found.where("NOT hole").groupBy("page").agg(F.count("*").alias("char_count"))
    return pages.select("page").distinct().join(counts, "page", "left").fillna(0, ["char_count"])


def as_strokes(found: DataFrame, open_ends: bool = True) -> DataFrame:
    """Contours as the strokes that ``images`` measures; with ``open_ends`` lengths don't come back to the first pixel."""
    length = F.col("open_length") if open_ends else F.col("perimeter")
    return found.select("page", "x", "y", "w", "h", "area", length.alias("perimeter"), "hole")
