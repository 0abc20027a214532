"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: lexicon densities (a short fixed list, and word and stem units learned from labelled rows by Spark counts),
nearness of lexicon words to a second person, capitals, punctuation and obfuscation rates. The trees and the calibration
are fitted on a bounded sample of labelled rows (``Settings.sample_rows``), trees on one part and calibration on another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import durable, fold, slices

#: Insults and second-person forms of four languages.
INSULTS = "asshole bastard bitch clown crap cretin damn disgusting dumb fool freak garbage idiot imbecile jerk liar loser moron pathetic pig scum stupid trash ugly vermin worthless arschloch blöd dumm dreck idiotisch abschaum versager widerlich connard crétin débile imbécile nul ordure stupide basura estúpido idiota imbécil inútil maldito patético".split()
SECOND = "you your yours yourself du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti usted ustedes vosotros".split()
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
WORD = re.compile(r"[^\W\d_]+")
FEATURES = ["fixed_density", "fixed_count", "learned_density", "learned_count", "weight_density", "weight_total", "weight_max", "near_second", "second_density", "capital_words", "capital_letters", "exclamations", "questions", "punctuation", "obfuscated", "repeats", "distinct_share", "log_words"]


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000  # labelled rows for lexicon, trees and calibration
    lexicon: int = 2000  # learned units
    least: int = 4  # toxic documents that a unit needs
    trees: int = 24
    depth: int = 4
    seed: int = 7
    keep: int = 300_000


def units(word: str) -> list[str]:
    """A word and its stems of five to seven letters, told apart by a mark."""
    return [word, *(word[:n] + "~" for n in (5, 6, 7) if len(word) >= n)]


def learn_lexicon(texts: DataFrame, z: Settings) -> dict[str, float]:
    """Log-odds of units by documents of either label; ``texts`` (text, toxic) is the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            unit, label = [], []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {u for w in set(WORD.findall((t or "").lower())) for u in units(w)}
                unit += found
                label += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(label, pa.int32())], ["unit", "toxic"])

    n = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counts = texts.select("text", "toxic").mapInArrow(run, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).where(F.col("bad") >= z.least)
    bad, good = F.col("bad"), F.col("all") - F.col("bad")
    odds = F.log((bad + 0.5) / (n[1] + 1.0)) - F.log((good + 0.5) / (n[0] + 1.0))
    # The evidence of a unit: its odds by the root of the documents that have it.
    rows = counts.select("unit", odds.alias("odds"), (odds * F.sqrt("bad")).alias("rank")).where(F.col("odds") > 1.0).orderBy(F.desc("rank"), "unit").limit(z.lexicon).collect()
    return {r["unit"]: float(r["odds"]) for r in rows}


class Reader(dict):
    """Blank-separated token to its row of attributes, over all letter runs in it: fixed hits, learned hits, sum and
    maximum of weights, second-person words, capitals, obfuscated, odd."""

    WIDTH = 8

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.fixed, self.second = lexicon, set(INSULTS), set(SECOND)
        self.rows: list[tuple] = []

    def __missing__(self, token: str) -> int:
        low = token.lower()
        words = WORD.findall(low)
        stripped = low.strip(".,;:!?\"'()[]")
        odd = len(words) > 1 or bool(words) and stripped != words[0] and len(stripped) > 2
        masked = 0.0
        if odd and not any(w in self.fixed for w in words) and (clean := stripped.translate(LEET)) in self.fixed:
            words, masked = [clean], 1.0
        weights = [max((self.lexicon.get(u, 0.0) for u in units(w)), default=0.0) for w in words]
        caps = float(any(len(w) > 2 for w in words) and token.isupper())
        self[token] = i = len(self.rows)
        self.rows.append((float(sum(w in self.fixed for w in words)), float(sum(x > 0 for x in weights)), sum(weights), max(weights, default=0.0), float(sum(w in self.second for w in words)), caps, masked, float(odd)))
        return i

    def trim(self, keep: int) -> None:
        if len(self.rows) > keep:
            self.clear()
            self.rows.clear()
            self.filled = 0

    filled = 0

    def table(self) -> np.ndarray:
        if not self.filled:
            self.data = np.zeros((1 << 15, self.WIDTH), np.float32)
        if self.filled < (n := len(self.rows)):
            if n > len(self.data):
                self.data = np.concatenate([self.data, np.zeros((2 * n - len(self.data), self.WIDTH), np.float32)])
            self.data[self.filled : n] = self.rows[self.filled :]
            self.filled = n
        return self.data


def features(text: str | None, reader: Reader) -> list[float]:
    """The row of FEATURES; an empty or null text has zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    ids = np.fromiter(map(reader.__getitem__, words), np.int64, n)
    fixed, learned, weight, heaviest, second, caps, masked, odd = reader.table()[ids].T
    raw = text.encode()
    size = len(raw)
    hits, you = np.flatnonzero((fixed > 0) | (learned > 0)), np.flatnonzero(second)
    near = 0.0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
        near = float((1.0 / (1.0 + gap)).sum() / len(hits))
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = size - len(raw.translate(None, b".,;:!?-()\"'"))
    total = float(weight.sum(dtype=float))
    return [
        float(fixed.sum()) / n, float(fixed.sum()), float(learned.sum()) / n, float(learned.sum()), total / n, total, float(heaviest.max()), near, float(second.sum()) / n,
        float(caps.sum()) / n, upper / size, raw.count(b"!") / size, raw.count(b"?") / size, marks / size, float(masked.sum() + odd.sum() * 0.01) / n, float((ids[1:] == ids[:-1]).sum()) / n, len(np.unique(ids)) / n, float(np.log1p(n)),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str, z: Settings) -> DataFrame:
    """Add the column ``features`` (array of doubles)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most z.lexicon units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in slices(batches, text):
            reader.trim(z.keep)
            rows = [features(t, reader) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, "features"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("features", ArrayType(DoubleType()))]))


@dataclass
class Model:
    """Lexicon, trees and calibration; without both labels to learn from, a constant."""

    settings: Settings
    lexicon: dict[str, float]
    trees: object = None
    isotonic: object = None
    prior: float = 0.0

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``score`` (0 to 1, finite for every row) to all rows.

        All other columns stay, whatever their names: they travel under names of their own past the columns that the
        trees and the calibration add. A column ``score`` of the input is replaced. A null text scores as an empty one.
        """
        if self.trees is None:
            return docs.withColumn("score", F.lit(self.prior))
        names = {f"in_{i}": c for i, c in enumerate(docs.columns)}
        rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()])
        rows = with_features(rows, self.lexicon, next(k for k, c in names.items() if c == text), self.settings).withColumn("features", array_to_vector("features"))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
        return self.isotonic.transform(self.margins(rows)).select(*[F.col(k).alias(c) for k, c in names.items() if c != "score"], score.alias("score"))

    def margins(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.trees.transform(rows)
        return out.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Fit on at most ``settings.sample_rows`` labelled rows, those with the smallest hash of the id.

    Rows whose label or id is null teach nothing; an id labelled twice counts once, as toxic if any label says so.
    """
    z = settings
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(z.sample_rows)
    picked = durable(picked)  # a bounded number of ids
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(picked), key)
    part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(z.seed)), F.lit(4))
    rows = durable(rows.select("text", "toxic", part.alias("part")).coalesce(12))
    lexicon = learn_lexicon(rows.where(F.col("part") < 2), z)  # half for the lexicon, a quarter each for trees and calibration
    dense = with_features(rows.where(F.col("part") >= 2), lexicon, "text", z)
    dense = durable(dense.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), "part").coalesce(4))
    grow, rest = dense.where(F.col("part") == 2), dense.where(F.col("part") == 3)
    sums = {r["part"]: r for r in dense.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).collect()}
    n, bad = sum(r["n"] for r in sums.values()), sum(r["bad"] for r in sums.values())
    if not all(p in sums and 0 < sums[p]["bad"] < sums[p]["n"] for p in (2, 3)):
        return Model(z, lexicon, prior=float(bad / n) if n else 0.0)
    trees = GBTClassifier(maxIter=z.trees, maxDepth=z.depth, stepSize=0.2, seed=z.seed, minInstancesPerNode=3, maxBins=48, featureSubsetStrategy="all").fit(grow)
    model = Model(z, lexicon, trees)
    steps = model.margins(rest).groupBy(F.round("margin", 2).alias("margin")).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    model.isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(steps.coalesce(1))
    return model


def held_out_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The corpus query: learn from labels whose fold of 5 is not 0, score every row by its whole text."""
    part: Column = fold("doc_id", 5)
    model = fit(docs, labels.where(part != 0), settings=settings)
    out = model.score(docs.select("doc_id", (part == 0).alias("held_out"), "text"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
