"""Contours, edges, lines, turned pages, denoising and local contrast against plain loops on random pages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkledger.operators import contours, images, scans

WAYS = [(1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)]


def followed(page, start, inner):
    """A border's pixels in turn, and those where its direction changes, found by walking along it."""
    at = lambda p: 0 <= p[1] < len(page) and 0 <= p[0] < len(page[0]) and page[p[1]][p[0]]
    go = lambda p, s: (p[0] + WAYS[s % 8][0], p[1] + WAYS[s % 8][1])
    first = 0 if inner else 4
    around = [s % 8 for s in range(first - 1, first - 9, -1)]
    back = next((s for s in around if at(go(start, s))), None)
    if back is None:
        return [start], [start]
    before, here, s, came, every, kept = go(start, back), start, back, (back + 4) % 8, [], []
    while True:
        s = next(k % 8 for k in range(s + 1, s + 9) if at(go(here, k)))
        every.append(here)
        if s != came:
            kept.append(here)
            came = s
        there = go(here, s)
        if there == start and here == before:
            return every, kept
        here, s = there, (s + 4) % 8


def plain_contours(page):
    h, w = len(page), len(page[0])
    on = lambda p: bool(0 <= p[0] < w and 0 <= p[1] < h and page[p[1]][p[0]])
    label, rows, n = {}, [], 0
    for start in ((x, y) for y in range(-1, h + 1) for x in range(-1, w + 1)):
        if start in label:
            continue
        label[start], todo = n, [start]
        while todo:
            x, y = todo.pop()
            for dx, dy in WAYS if on(start) else WAYS[::2]:
                q = x + dx, y + dy
                if -1 <= q[0] <= w and -1 <= q[1] <= h and q not in label and on(q) == on(start):
                    label[q] = n
                    todo.append(q)
        x, y = start
        if n:
            inner = not on(start)
            every, kept = followed(page, (x - 1, y) if inner else start, inner)
            way = lambda ps: sum(math.dist(a, b) for a, b in zip(ps, ps[1:], strict=False))
            closed = way(every + every[:1])
            area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(kept, kept[1:] + kept[:1], strict=True))) / 2
            xs, ys = [p[0] for p in every], [p[1] for p in every]
            rows.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, area, round(closed, 6), round(closed if inner else way(kept), 6), inner or label[x - 1, y] != 0, inner))
        n += 1
    return sorted(rows)


def pages_of(seed, n, shares=(0.2, 0.4, 0.5, 0.6, 0.8)):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        h, w, d = rng.randint(1, 14), rng.randint(1, 14), rng.choice(shares)
        out.append([[int(rng.random() < d) for _ in range(w)] for _ in range(h)])
    rings = np.add.outer(np.abs(np.arange(11) - 5), np.zeros(11, int))
    out.append((np.maximum(rings, rings.T) % 2).tolist())  # strokes in the holes of strokes
    return out


def rows_of(spark, pages, name, kind="tinyint", starts=None):
    data = [(k, y + (starts[k] if starts else 0), row) for k, page in enumerate(pages) for y, row in enumerate(page)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, f"page long, y int, {name} array<{kind}>")


def by_page(rows, name):
    out = {}
    for r in rows.collect():
        out.setdefault(r.page, {})[r.y] = r[name]
    return {k: [v[y] for y in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("size", [1, 3, 256])
def test_contours_against_a_walk_along_the_borders(spark, size):
    pages = pages_of(size, 120)
    starts = [k % 7 - 3 for k in range(len(pages))]
    got = {}
    for r in contours.contours(rows_of(spark, pages, "ink", starts=starts), size).collect():
        got.setdefault(r.page, []).append((r.x, r.y - starts[r.page], r.w, r.h, r.area, round(r.perimeter, 6), round(r.open_length, 6), r.hole, r.inner))
    for k, page in enumerate(pages):
        assert sorted(got.get(k, [])) == plain_contours(page), page
    assert any(r[-1] for rows in got.values() for r in rows) and any(r[-2] and not r[-1] for rows in got.values() for r in rows)


def test_contours_edges(spark):
    rows = spark.createDataFrame([("a", 0, [1, 1, 1]), ("a", 1, [1]), ("a", 5, [0, 1]), ("a", 3, None), ("b", 0, []), (None, 2, [1]), ("c", 0, [0, 0])], "page string, y int, ink array<int>")
    got = sorted((str(r.page), r.x, r.y, r.w, r.h, r.area, r.hole) for r in contours.contours(rows, 2).collect())
    assert got == [("None", 0, 2, 1, 1, 0.0, False), ("a", 0, 0, 3, 2, 0.5, False), ("a", 1, 5, 1, 1, 0.0, False)]
    assert contours.contours(rows.limit(0)).count() == 0
    counts = {r.page: r.char_count for r in contours.outer_count(rows.where("page IS NOT NULL"), contours.contours(rows)).collect()}
    assert counts == {"a": 2, "b": 0, "c": 0}


def grey_pages(seed, n=6, least=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        h, w = rng.integers(least, 24, 2)
        page = rng.integers(0, 256, (h, w)) if k % 2 else np.where(rng.random((h, w)) < 0.02, 0, 220) + rng.integers(0, 20, (h, w))
        if k % 2 == 0:
            page[h // 3 : h // 2 + 1, w // 4 : w // 2 + 1] = rng.integers(0, 60)
        out.append(page.tolist())
    return out


def plain_edges(page):
    h, w = len(page), len(page[0])
    p = lambda x, y: page[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    dx, dy, size = {}, {}, {}
    for y in range(h):
        for x in range(w):
            dx[x, y] = sum(k * (p(x + 1, y + j) - p(x - 1, y + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            dy[x, y] = sum(k * (p(x + j, y + 1) - p(x + j, y - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            size[x, y] = abs(dx[x, y]) + abs(dy[x, y])
    m = lambda x, y: size.get((x, y), 0)
    ridge = {}
    for (x, y), s in size.items():
        a, b = abs(dx[x, y]), abs(dy[x, y]) * 32768
        if b < a * 13573:
            top = s > m(x - 1, y) and s >= m(x + 1, y)
        elif b > a * 13573 + a * 65536:
            top = s > m(x, y - 1) and s >= m(x, y + 1)
        else:
            k = -1 if dx[x, y] * dy[x, y] < 0 else 1
            top = s > m(x - k, y - 1) and s > m(x + k, y + 1)
        if top and s > 50:
            ridge[x, y] = s > 150
    found, todo = set(), [q for q, strong in ridge.items() if strong]
    while todo:
        x, y = todo.pop()
        if (x, y) in ridge and (x, y) not in found:
            found.add((x, y))
            todo += [(x + i, y + j) for i, j in WAYS]
    return [[255 * ((x, y) in found) for x in range(w)] for y in range(h)]


@pytest.mark.parametrize("size", [1, 4, 256])
def test_edges_against_plain_loops(spark, size):
    pages = grey_pages(7, 10)
    got = by_page(scans.edges(rows_of(spark, pages, "grey", "int", starts=[k - 2 for k in range(10)]), size), "edge")
    assert got == {k: plain_edges(p) for k, p in enumerate(pages)} and any(255 in row for p in got.values() for row in p)


def test_votes_and_lines_against_plain_loops(spark):
    pages = [[[int((x + k * y) % 5 == 0 or y == 4 * k) for x in range(16)] for y in range(12)] for k in range(3)]
    runs = scans.ink_runs(rows_of(spark, pages, "ink"))
    votes = {}
    for k, page in enumerate(pages):
        for y, row in enumerate(page):
            for x, on in enumerate(row):
                for t in range(180 if on else 0):
                    rho = int(np.rint(np.float32(x) * scans.COS[t] + np.float32(y) * scans.SIN[t]))
                    votes[k, t, rho] = votes.get((k, t, rho), 0) + 1
    assert {(r.page, r.theta, r.rho): r.votes for r in scans.line_votes(runs).collect()} == votes
    want = []
    v = lambda *q: votes.get(q, 0)
    for k in range(3):
        peaks = [(-n, t, rho) for (p, t, rho), n in votes.items() if p == k and n > 5 and n > v(k, t, rho - 1) and n >= v(k, t, rho + 1) and n > v(k, t - 1, rho) and n >= v(k, t + 1, rho)]
        want += [(k, i, t - 90.0, rho, -n) for i, (n, t, rho) in enumerate(sorted(peaks)[:7], 1)]
    assert sorted(map(tuple, scans.lines(runs, 5, 7).collect())) == want


def drawn(angle, n=160):
    """A page with lines at an angle to its rows."""
    y, x = np.mgrid[0:n, 0:n]
    along = (y - n / 2) * math.cos(math.radians(angle)) - (x - n / 2) * math.sin(math.radians(angle))
    return np.where(np.abs((along + 500) % 25 - 12) < 2, 20, 230).tolist()


def test_angles_of_drawn_lines(spark):
    angles = [0, 3, -7, 12]
    rows = rows_of(spark, [drawn(a) for a in angles], "grey", "int")
    got = {r.page: r.angle for r in scans.page_angles(rows).collect()}
    assert 0 not in got and all(abs(got[k] - a) <= 1 for k, a in enumerate(angles) if k)
    inked = rows.select("page", "y", F.transform("grey", lambda g: (g < 128).cast("tinyint")).alias("ink"))
    slant = {r.page: r.slant * 30 for r in scans.slants(inked).collect()}
    assert all(abs(slant.get(k, 0) - a) <= 1 for k, a in enumerate(angles))
    straight = {r.page: r.angle for r in scans.page_angles(scans.deskewed(rows)).collect()}
    assert all(abs(straight.get(k, 0)) <= 1 for k in range(4))


def plain_turn(page, angle):
    h, w = len(page), len(page[0])
    c, s, cx, cy = math.cos(math.radians(angle)), math.sin(math.radians(angle)), w // 2, h // 2
    out = []
    for y in range(h):
        row = []
        for x in range(w):
            u = (round(c * x * 1024) + round((-s * y + cx - c * cx + s * cy) * 1024) + 16) >> 5
            v = (round(s * x * 1024) + round((c * y + cy - s * cx - c * cy) * 1024) + 16) >> 5
            p = lambda i, j: page[min(max(j, 0), h - 1)][min(max(i, 0), w - 1)]
            i, j, a, b = u >> 5, v >> 5, u & 31, v & 31
            row.append((p(i, j) * (32 - a) * (32 - b) + p(i + 1, j) * a * (32 - b) + p(i, j + 1) * (32 - a) * b + p(i + 1, j + 1) * a * b + 512) >> 10)
        out.append(row)
    return out


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_turned_pages_against_plain_loops(spark, tile):
    pages, angles = grey_pages(3, 8), [3.0, -44.0, 12.5, 30.0, -2.0, 44.9, 0.5, 90.0]
    starts = [k * 5 - 7 for k in range(8)]
    turn = spark.createDataFrame(list(enumerate(angles)) + [(99, 4.0)], "page long, angle double")
    got = by_page(scans.turned(rows_of(spark, pages, "grey", "int", starts=starts), turn, tile), "grey")
    assert got == {k: plain_turn(p, a) for k, (p, a) in enumerate(zip(pages, angles, strict=True))}


def test_a_page_turned_and_turned_back(spark):
    page = drawn(0, 96)
    rows = rows_of(spark, [page], "grey", "int")
    angle = lambda a: spark.createDataFrame([(0, a)], "page long, angle double")
    back = np.array(by_page(scans.turned(scans.turned(rows, angle(9.0), 32), angle(-9.0), 32), "grey")[0])
    assert np.abs(back - np.array(page))[30:66, 30:66].mean() < 25


def plain_denoised(page, strength):
    h, w = len(page), len(page[0])

    def p(x, y):
        for n, k in ((w, "x"), (h, "y")):
            i = abs(x if k == "x" else y) % max(1, 2 * n - 2)
            i = 0 if n == 1 else min(i, 2 * n - 2 - i)
            x, y = (i, y) if k == "x" else (x, i)
        return page[y][x]

    mirrored = {(x, y): p(x, y) for y in range(-13, h + 13) for x in range(-13, w + 13)}
    out = []
    for y in range(h):
        row = []
        for x in range(w):
            top = bottom = 0
            for dy in range(-10, 11):
                for dx in range(-10, 11):
                    d = sum((mirrored[x + i, y + j] - mirrored[x + dx + i, y + dy + j]) ** 2 for j in range(-3, 4) for i in range(-3, 4))
                    k = round(19096 * math.exp(-((d >> 6) * 64 / 49) / strength**2))
                    k = 0 if k < 19.096 else k
                    bottom += k
                    top += k * mirrored[x + dx, y + dy]
            row.append((top + bottom // 2) // bottom)
        out.append(row)
    return out


@pytest.mark.parametrize("size", [3, 256])
def test_denoising_against_the_direct_sum(spark, size):
    rng = np.random.default_rng(4)
    pages = [(100 + 40 * (np.arange(9) > 4)[None, :] + rng.integers(-9, 9, (7, 9))).tolist(), rng.integers(0, 256, (1, 5)).tolist(), rng.integers(90, 130, (11, 1)).tolist()]
    got = by_page(scans.denoised(rows_of(spark, pages, "grey", "int", starts=[4, 0, -3]), size), "grey")
    assert got == {k: plain_denoised(p, 12.0) for k, p in enumerate(pages)} and got[0] != pages[0]
    assert scans.WHOLE == 19096 and scans.SHIFT == 6


def plain_contrast(page, clip):
    h, w = len(page), len(page[0])
    tw, th = -(-w // 8), -(-h // 8)
    fold = lambda i, n: 0 if n == 1 else min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))
    tables = {}
    for j in range(8):
        for i in range(8):
            n = [0] * 256
            for y in range(j * th, (j + 1) * th):
                for x in range(i * tw, (i + 1) * tw):
                    n[page[fold(y, h)][fold(x, w)]] += 1
            most = max(1, int(clip * tw * th / 256))
            over = sum(max(0, c - most) for c in n)
            n = [min(c, most) + over // 256 for c in n]
            left = over % 256
            for k in range(left):
                n[k * max(1, 256 // left)] += 1
            tables[j, i] = [min(255, round(sum(n[: v + 1]) * 255.0 / (tw * th))) for v in range(256)]
    out = []
    for y in range(h):
        row = []
        for x in range(w):
            fx, fy = x / tw - 0.5, y / th - 0.5
            i, j = math.floor(fx), math.floor(fy)
            a, b, v = fx - i, fy - j, page[y][x]
            t = lambda jj, ii: tables[min(max(jj, 0), 7), min(max(ii, 0), 7)][v]
            row.append(round((t(j, i) * (1 - a) + t(j, i + 1) * a) * (1 - b) + (t(j + 1, i) * (1 - a) + t(j + 1, i + 1) * a) * b))
        out.append(row)
    return out


@pytest.mark.parametrize("size", [5, 256])
def test_local_contrast_against_plain_loops(spark, size):
    pages = grey_pages(5, 6) + [[[7]], (np.arange(40 * 33).reshape(40, 33) % 90 + 100).tolist()]
    got = by_page(scans.local_contrast(rows_of(spark, pages, "grey", "int", starts=[k - 3 for k in range(8)]), size=size), "grey")
    assert got == {k: plain_contrast(p, 3.0) for k, p in enumerate(pages)}


def test_scan_to_hand(spark):
    """From a turned scan to a fingerprint; the strokes are those of the binarized page."""
    rng = np.random.default_rng(2)
    pages = []
    for k in range(2):
        page = np.full((120, 140), 235) + rng.integers(-6, 6, (120, 140))
        for y in range(12, 108, 24):
            for x in range(8, 128, 12 + 2 * k):
                page[y : y + 10, x : x + 2] = 30
                page[y : y + 2, x : x + 7] = 40
                page[y + 8 : y + 10, x : x + 7] = 40
                page[y : y + 10, x + 6 : x + 8] = 35
        pages.append(np.array(plain_turn(page.tolist(), 3.0 * k)).tolist())
    rows = scans.preprocessed(rows_of(spark, pages, "grey", "int"))
    binary = by_page(rows.select("page", "y", "binary"), "binary")
    assert {len(p) for p in binary.values()} == {120} and {len(r) for p in binary.values() for r in p} == {140}
    hands = {r.page: r for r in scans.hand_pages(rows).collect()}
    for k, page in binary.items():
        ink = (np.array(page) == 0).astype(int)
        found = plain_contours(ink.tolist())
        strokes = [r for r in found if not r[7] and r[4] >= 4]
        assert hands[k].stroke_count == len(strokes) and hands[k].area_mean == math.floor(np.mean([r[4] for r in strokes]) * 100 + 0.5) / 100
        assert abs(hands[k].mean_height - np.mean([r[3] for r in strokes])) < 0.01 and len(hands[k].fingerprint) == 18
        assert abs(sum(x * x for x in hands[k].fingerprint) - 1) < 1e-9
    metrics = {r.page: r for r in scans.page_metrics(rows).collect()}
    assert all(metrics[k].char_count == sum(not r[7] for r in plain_contours((np.array(p) == 0).astype(int).tolist())) for k, p in binary.items())
    kept = images.identity_fingerprint(scans.identity_features(rows), "page").collect()
    assert len(kept) == 2 and all(0 <= r.f0 <= 1 for r in kept)
