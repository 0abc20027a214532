"""Page images as rows (page, y, grey: array of one row's pixels) and strokes as rows (page, x, y, w, h, area, perimeter, hole).

Neighbouring rows meet by windows over a page, neighbouring pixels by array functions, all in integers. Strokes, line
angles and page sizes come from a tracer that a user plugs in; what is made of them is here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from .pages import consistency, line_runs

#: Weights of the 15 x 15 window in 256ths, from a Gaussian of deviation 0.3 * ((15 - 1) / 2 - 1) + 0.8.
REACH = 7
_BELL = [math.exp(-(k * k) / (2 * 2.6**2)) for k in range(-REACH, REACH + 1)]
WEIGHTS = [round(256 * b / sum(_BELL)) for b in _BELL]
WEIGHTS[REACH] += 256 - sum(WEIGHTS)


def grey_of(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of three equally long arrays of 0 to 255, in 16384ths."""
    at = lambda c, i: F.element_at(c, i + 1)
    return F.transform(red, lambda r, i: F.shiftright(r * 4899 + at(green, i) * 9617 + at(blue, i) * 1868 + 8192, 14).cast("int"))


def _page() -> Window:
    return Window.partitionBy("page").orderBy("y")


def _shifted(row: Column, by: int, border: Column) -> Column:
    """Each pixel's neighbour; past the ends what ``border`` (an index from 1) says."""
    return F.transform(row, lambda _, i: F.element_at(row, F.when((i + by >= 0) & (i + by < F.size(row)), i + by + 1).otherwise(border).cast("int")))


def without_noise(rows: DataFrame) -> DataFrame:
    """A 3 x 3 Gaussian (mirrored at the borders), then an opening by 2 x 2."""
    w, g = _page(), F.col("grey")
    near, n = lambda c: F.least(F.lit(2), F.size(c)), lambda c: F.greatest(F.size(c) - 1, F.lit(1))
    across = F.transform(F.arrays_zip(g, _shifted(g, -1, near(g)).alias("a"), _shifted(g, 1, n(g)).alias("b")), lambda p: p["grey"] * 2 + p["a"] + p["b"])
    rows = rows.select("page", "y", across.alias("h")).select("page", "y", "h", F.lag("h").over(w).alias("up"), F.lead("h").over(w).alias("down"))
    three = F.arrays_zip("h", F.coalesce("up", "down", "h").alias("u"), F.coalesce("down", "up", "h").alias("d"))
    rows = rows.select("page", "y", F.transform(three, lambda p: F.shiftright(p["h"] * 2 + p["u"] + p["d"] + 8, 4)).alias("s"))
    return _with_corner(_with_corner(rows, F.least), F.greatest).withColumnRenamed("s", "grey")


def _with_corner(rows: DataFrame, pick: Callable[..., Column]) -> DataFrame:
    """The least or greatest of each pixel and its neighbours left, above and above left, as far as there are any."""
    left = F.transform("s", lambda x, i: pick(x, F.element_at("s", F.greatest(i, F.lit(1)).cast("int"))))
    rows = rows.select("page", "y", left.alias("s")).select("page", "y", "s", F.lag("s").over(_page()).alias("up"))
    return rows.select("page", "y", F.zip_with("s", F.coalesce("up", "s"), lambda a, b: pick(a, b)).alias("s"))


def binarized(rows: DataFrame, less: int = 4) -> DataFrame:
    """Adds ``binary``: 255 where a pixel is over the weighted mean of its 15 x 15 window less ``less``, else 0; borders repeat.

    A row that is shorter than others of its page goes on with its last pixel; null and empty rows are left out.
    """
    w, g = _page(), F.col("grey")
    rows = rows.where(F.size("grey") > 0).withColumn("_w", F.max(F.size("grey")).over(Window.partitionBy("page")))
    rows = rows.withColumn("grey", F.concat("grey", F.array_repeat(F.element_at("grey", -1), F.col("_w") - F.size("grey")))).drop("_w")
    last = F.size(g) - 1
    across = F.transform(g, lambda _, i: sum((F.element_at(g, F.least(F.greatest(i + k, F.lit(0)), last).cast("int") + 1) * WEIGHTS[k + REACH] for k in range(-REACH, REACH + 1)), F.lit(0)))
    rows = rows.select("page", "y", "grey", across.alias("h"))
    ends = {"first": F.first("h").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "last": F.last("h").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    rows = rows.withColumns(ends).withColumns({f"r{k}": F.coalesce(F.lag("h", -k).over(w), F.col("first" if k < 0 else "last")) for k in range(-REACH, REACH + 1)})
    at = lambda k, i: F.element_at(F.col(f"r{k}"), i + 1)
    mean = lambda i: F.shiftright(sum((at(k, i) * WEIGHTS[k + REACH] for k in range(-REACH, REACH + 1)), F.lit(0)) + 32768, 16)
    return rows.select("page", "y", "grey", F.transform("grey", lambda x, i: F.when(x > mean(i) - less, 255).otherwise(0)).alias("binary"))


def ink_rows(rows: DataFrame) -> DataFrame:
    """(page, y, ink, width, dark): inked pixels of each row and the sum of their grey; ink is the rarer kind of pixel."""
    light = F.aggregate("binary", F.lit(0).cast("long"), lambda a, x: a + x)
    every = Window.partitionBy("page")
    rows = rows.select("page", "y", "grey", "binary", F.size("binary").alias("width"), light.alias("light"))
    rows = rows.withColumn("white", F.sum("light").over(every) / F.sum("width").over(every) > 127)
    inked = lambda b: F.when(F.col("white"), b == 0).otherwise(b == 255)
    some = F.filter(F.arrays_zip("grey", "binary"), lambda p: inked(p["binary"]))
    return rows.select("page", "y", F.size(some).alias("ink"), "width", F.aggregate(some, F.lit(0).cast("long"), lambda a, p: a + p["grey"]).alias("dark"), F.size(F.filter("binary", lambda b: b == 0)).alias("black"))


def page_metrics(inked: DataFrame) -> DataFrame:
    """Size, ink ratio, rows whose ink (255 a pixel) is over 2 % of the width, and pressure: darkness of the ink."""
    pressure = F.when(F.sum("ink") > 0, X.half_up(X.clip(1.0 - F.sum("dark") / F.sum("ink") / 255.0, 0.0, 1.0), 3)).otherwise(F.lit(0.5))
    return inked.groupBy("page").agg(F.max("width").alias("width"), F.count("*").alias("height"), X.half_up(F.sum("black") / F.sum("width"), 4).alias("ink_ratio"), F.count_if(F.col("black") * 255 > F.col("width") * 0.02).alias("text_lines"), pressure.alias("pressure"))


def _cv(x: str) -> Column:
    """Deviation over mean, 1 where the mean is not positive or there is nothing."""
    return F.coalesce(F.when(F.avg(x) > 0, F.stddev_pop(x) / F.avg(x)), F.lit(1.0))


def line_features(inked: DataFrame) -> DataFrame:
    """Text lines of each page: number, mean height and its variation, mean density, variation of height changes."""
    pages = inked.groupBy("page").agg(F.max("width").alias("width"))
    runs = line_runs(inked.select("page", "y", "ink", "width"), F.col("width"))
    runs = runs.withColumn("change", F.abs(F.col("height") - F.lag("height").over(Window.partitionBy("page").orderBy("start")))).join(pages, "page")
    runs = runs.withColumn("density", F.col("ink") / (F.col("height") * F.col("width")))
    found = runs.groupBy("page").agg(F.count("*").alias("line_count"), X.half_up(F.avg("height"), 2).alias("line_height_mean"), X.half_up(_cv("height"), 3).alias("line_height_cv"), X.half_up(F.avg("density"), 4).alias("line_density_mean"), X.half_up(_cv("change"), 3).alias("line_spacing_cv"))
    return pages.select("page").join(found, "page", "left").select("page", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("line_count", 0), ("line_height_mean", 0.0), ("line_height_cv", 1.0), ("line_density_mean", 0.0), ("line_spacing_cv", 1.0))])


#: What a page without strokes gets.
NO_STROKES = {"stroke_count": 0, "stroke_density": 0.0, "mean_height": 0.0, "height_cv": 1.0, "mean_width": 0.0, "width_cv": 1.0, "mean_aspect": 1.0, "mean_gap": 0.0, "gap_cv": 1.0, "gap_to_width_ratio": 0.5, "compactness": 0.0, "thinness": 0.0, "area_mean": 0.0, "area_std": 0.0}


def stroke_features(strokes: DataFrame, pages: DataFrame) -> DataFrame:
    """Fourteen values of each page's outer strokes of area 4 or more; ``pages`` has page, height, width."""
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(Window.partitionBy("page").orderBy("x", "w"))
    rows = strokes.where(~F.col("hole") & (F.col("area") >= 4)).withColumn("d", gap).withColumn("gap", F.when((F.col("d") > 0) & (F.col("d") < 200), F.col("d")))
    roundness = F.avg(F.when(F.col("perimeter") > 0, 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))))
    sums = rows.groupBy("page").agg(
        F.count("*").alias("stroke_count"), F.sum("area").alias("all"), F.avg("h").alias("mh"), _cv("h").alias("ch"), F.avg("w").alias("mw"), _cv("w").alias("cw"), F.avg(F.when(F.col("h") > 0, F.col("w") / F.col("h"))).alias("aspect"),
        F.avg("gap").alias("mg"), _cv("gap").alias("cg"), roundness.alias("round"), F.avg(F.col("perimeter") / F.col("area")).alias("thin"), F.avg("area").alias("ma"), F.stddev_pop("area").alias("sa"),
    )
    gaps = F.coalesce("mg", F.lit(0.0))
    out = {
        "stroke_count": F.col("stroke_count"), "stroke_density": X.half_up(F.col("all") / (F.col("height") * F.col("width")), 4), "mean_height": X.half_up(F.col("mh"), 2), "height_cv": X.half_up(F.col("ch"), 3), "mean_width": X.half_up(F.col("mw"), 2), "width_cv": X.half_up(F.col("cw"), 3),
        "mean_aspect": X.half_up(F.coalesce("aspect", F.lit(1.0)), 3), "mean_gap": X.half_up(gaps, 2), "gap_cv": X.half_up(F.col("cg"), 3), "gap_to_width_ratio": X.half_up(F.when(F.col("mw") > 0, F.least(gaps / F.col("mw"), F.lit(2.0)) / 2.0).otherwise(F.lit(0.25)), 3),
        "compactness": X.half_up(F.coalesce("round", F.lit(0.0)), 4), "thinness": X.half_up(F.least(F.col("thin") / 10.0, F.lit(1.0)), 4), "area_mean": X.half_up(F.col("ma"), 2), "area_std": X.half_up(F.col("sa"), 2),
    }
    return pages.join(sums, "page", "left").select("page", *[F.when(F.col("all").isNotNull(), v).otherwise(F.lit(NO_STROKES[k])).alias(k) for k, v in out.items()])


def stroke_shape(strokes: DataFrame) -> DataFrame:
    """(page, loop_density, baseline_deviation): holes to outer strokes over area 4, and how the feet of strokes from area 10 on vary."""
    area, outer = F.col("area"), ~F.col("hole")
    n_all, n_out = F.count_if(area > 4), F.count_if((area > 4) & outer)
    foot = F.when((area >= 10) & outer, F.col("y") + F.col("h"))
    mean, dev = F.avg(foot), F.stddev_pop(foot)
    base = F.when(F.count(foot) < 5, F.lit(0.5)).otherwise(X.half_up(F.least(F.when(mean > 0, dev / mean).otherwise(F.lit(1.0)) / 0.15, F.lit(1.0)), 3))
    return strokes.groupBy("page").agg(F.when(n_out == 0, F.lit(0.0)).otherwise(X.half_up(F.least((n_all - n_out) / n_out, F.lit(1.0)), 3)).alias("loop_density"), base.alias("baseline_deviation"))


def median_angle(angles: DataFrame, first: int) -> DataFrame:
    """(page, angle): median of those under 45 degrees among a page's first lines (page, rank, angle); pages without are left out."""
    return angles.where((F.col("rank") <= first) & (F.abs("angle") < 45)).groupBy("page").agg(F.median("angle").alias("angle"))


def slant(angle: Column) -> Column:
    return F.coalesce(X.half_up(X.clip(angle / 30.0, -1.0, 1.0), 3), F.lit(0.0))


def skew(angle: Column) -> Column:
    """What a page is to be turned by: nothing under half a degree."""
    return F.when(F.abs(angle) >= 0.5, angle).otherwise(F.lit(0.0))


IDENTITY = ("slant", "mean_aspect", "thinness", "compactness", "loop_density", "gap_to_width_ratio", "baseline_deviation", "line_spacing_cv")
MANNER = ("stroke_density", "height_cv", "width_cv", "gap_cv", "line_height_cv", "line_density_mean", "pressure")


def unit(values: Column) -> Column:
    size = V.norm(values)
    return F.when(size > 0, F.transform(values, lambda x: x / size)).otherwise(values)


def fingerprint(rows: DataFrame) -> DataFrame:
    """Adds ``fingerprint``: eight features of identity times 1.5 and ten of manner, scaled to length 1."""
    scaled = [F.least(F.col(c) / s, F.lit(1.0)) for c, s in (("area_mean", 500.0), ("area_std", 500.0), ("stroke_count", 200.0))]
    return rows.withColumn("fingerprint", unit(F.array(*[F.col(c) * 1.5 for c in IDENTITY], *[F.col(c).cast("double") for c in MANNER], *scaled)))


def hand_of_pages(pages: DataFrame, key: str) -> DataFrame:
    """Values of a submission from its pages: means with four digits, slant and loops with three, consistency, mean fingerprint."""
    names = ("height_cv", "width_cv", "gap_cv", "line_height_cv", "stroke_count", "line_count", "stroke_density", "compactness")
    place = pages.select(key, F.posexplode("fingerprint").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("m")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    means = pages.groupBy(key).agg(*[X.half_up(F.avg(c), 4).alias(c) for c in names], *[X.half_up(F.avg(c), 3).alias(c) for c in ("pressure", "slant", "loop_density")]).join(place, key)
    even = X.half_up(consistency(*(F.col(c) for c in ("height_cv", "width_cv", "gap_cv", "line_height_cv", "stroke_count"))), 3)
    return means.withColumn("consistency", even).withColumn("fingerprint", F.transform("mean", lambda x: x / (V.norm(F.col("mean")) + 1e-8))).drop("mean")


#: What a submission without pages gets.
NO_PAGES = {"consistency": 0.5, "pressure": 0.5, "stroke_density": 0.0, "stroke_count": 0.0, "line_count": 0.0, "height_cv": 1.0, "width_cv": 1.0, "gap_cv": 1.0, "line_height_cv": 1.0, "compactness": 0.0, "slant": 0.0, "loop_density": 0.0}


def hand_of_all(ids: DataFrame, hands: DataFrame, key: str) -> DataFrame:
    """``hand_of_pages`` for all of ``ids`` (key): one without pages has the fixed values, and eighteen zeros for a fingerprint."""
    rows = ids.select(key).distinct().join(hands, key, "left").fillna({k: v for k, v in NO_PAGES.items() if k in hands.columns})
    return rows.withColumn("fingerprint", F.coalesce("fingerprint", F.array_repeat(F.lit(0.0), 18)))


def identity_features(strokes: DataFrame, pages: DataFrame) -> DataFrame:
    """The five features of the alternative detector, of strokes over area 10, and their number; ``pages`` has page, height, width, ink."""
    big = F.col("area") > 10
    sums = strokes.groupBy("page").agg(F.count_if(big).alias("stroke_count"), F.count_if("hole").alias("loops"), F.avg(F.when(big, F.col("area"))).alias("mean_area"), F.avg(F.when(big & (F.col("h") > 0), F.col("w") / F.col("h"))).alias("mean_aspect"), F.avg(F.when(big & (F.col("perimeter") > 0), 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")))).alias("compactness"))
    some = F.coalesce("stroke_count", F.lit(0)) > 0
    out = {"loop_ratio": (F.col("loops") / F.col("stroke_count"), 0.0), "mean_area": (F.col("mean_area"), 0.0), "ink_density": (F.col("ink") / (F.col("height") * F.col("width")), 0.0), "mean_aspect": (F.coalesce("mean_aspect", F.lit(1.0)), 1.0), "compactness": (F.coalesce("compactness", F.lit(0.0)), 0.0)}
    return pages.join(sums, "page", "left").select("page", *[F.when(some, v).otherwise(F.lit(d)).alias(k) for k, (v, d) in out.items()], F.coalesce("stroke_count", F.lit(0)).cast("long").alias("stroke_count"))


def identity_fingerprint(features: DataFrame, key: str) -> DataFrame:
    """(key, f0 to f4, consistency) from the means over a submission's pages."""
    names = ("loop_ratio", "mean_area", "ink_density", "mean_aspect", "compactness")
    rows = features.groupBy(key).agg(*[F.avg(c).alias(c) for c in names])
    f = [V.log_norm(F.col("loop_ratio"), 15.0), V.log_norm(F.col("mean_area"), 6000.0), F.least(F.col("ink_density") * 3.0, F.lit(1.0)), F.least(F.col("mean_aspect") / 2.0, F.lit(1.0)), F.least(F.col("compactness") * 3.0, F.lit(1.0))]
    even = F.greatest(F.lit(0.4), 1.0 - F.least(F.col("loop_ratio") / 20.0, F.lit(1.0)) * 0.2)
    return rows.select(key, *[X.half_up(x, 4).alias(f"f{i}") for i, x in enumerate(f)], X.half_up(even, 3).alias("consistency"))
