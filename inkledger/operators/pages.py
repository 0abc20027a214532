"""Page rows: merging recognised pages, averaging page features, and ink profiles of scanned rows.

Recognition itself is a provider that a user plugs in; ``recognise`` shows the interface. Features of page images that
need contour tracing are not here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import half_up


def recognise(images: DataFrame, provider: Callable[[bytes], tuple[str, float]], key: str = "path") -> DataFrame:
    """Run a provider from image bytes to (text, confidence) over a binary column ``content``; failures are told, not hidden."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    rows.append((*provider(bytes(content)), "ok"))
                except Exception as e:  # a provider's own failure on one page
                    rows.append(("", 0.0, f"failed: {type(e).__name__}"))
            pdf = pdf[[key]].copy()
            pdf["text"], pdf["confidence"], pdf["ingest_status"] = zip(*rows, strict=True) if rows else ([], [], [])
            yield pdf

    return images.select(key, "content").mapInPandas(run, f"`{key}` string, text string, confidence double, ingest_status string")


def merge_pages(pages: DataFrame) -> DataFrame:
    """(id, text, avg_confidence, page_count) from (id, page, text, confidence): empty pages don't count but in page_count."""
    some = F.col("text").isNotNull() & (F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("page", "text")))), lambda x: x["text"]), "\n")
    return pages.groupBy("id").agg(joined.alias("text"), F.coalesce(half_up(F.avg(F.when(some, F.col("confidence"))), 3), F.lit(0.0)).alias("avg_confidence"), F.count("*").alias("page_count"))


def page_means(rows: DataFrame, key: str, *features: str, digits: int = 4) -> DataFrame:
    return rows.groupBy(key).agg(*[half_up(F.avg(f), digits).alias(f) for f in features])


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Component-wise mean of each key's vectors, scaled to length 1."""
    means = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    size = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)) + 1e-8
    return whole.select(key, F.transform("mean", lambda x: x / size).alias("centroid"))


def line_runs(rows: DataFrame, width: Column, least_height: int = 3, share: float = 0.02) -> DataFrame:
    """Text lines of pages from row profiles (page, y, ink): runs of rows inked over a share of the width.

    Runs of at most ``least_height`` rows are noise; a run that touches the last row is never closed and doesn't count.
    """
    order = Window.partitionBy("page").orderBy("y")
    marked = rows.withColumn("on", (F.col("ink") > width * share).cast("int"))
    marked = marked.withColumn("last", F.max("y").over(Window.partitionBy("page"))).withColumn("begins", (F.col("on") != F.coalesce(F.lag("on").over(order), F.lit(0))).cast("int"))
    runs = marked.withColumn("run", F.sum("begins").over(order)).where("on = 1").groupBy("page", "run", "last").agg(F.min("y").alias("start"), F.max("y").alias("stop"), F.sum("ink").alias("ink"))
    height = F.col("stop") - F.col("start") + 1
    return runs.where((height > least_height) & (F.col("stop") < F.col("last"))).select("page", "start", height.alias("height"), "ink")


def stroke_gaps(boxes: DataFrame) -> DataFrame:
    """Gaps between neighbouring boxes (page, x, w) by x, and how they vary."""
    order = Window.partitionBy("page").orderBy("x", "w")
    gaps = boxes.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)).where(F.col("gap") > 0)
    return gaps.groupBy("page").agg(F.count("*").alias("gaps"), half_up(F.avg("gap"), 3).alias("mean_gap"))


def consistency(height_cv: Column, width_cv: Column, gap_cv: Column, line_cv: Column, strokes: Column) -> Column:
    """Weighted evenness of a hand, less sure under 20 strokes; 0.1 to 1."""
    even = lambda cv: F.greatest(F.lit(0.4), 1.0 - F.least(cv, F.lit(1.0)) * 0.6)
    x = even(height_cv) * 0.35 + even(width_cv) * 0.25 + even(gap_cv) * 0.25 + even(line_cv) * 0.15
    return F.least(F.greatest(x * F.when(strokes < 20, 0.7).otherwise(1.0), F.lit(0.1)), F.lit(1.0))
