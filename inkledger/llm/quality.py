"""Quality: supervised subword embeddings, averaged for a document, with a softmax on top.

A blank-separated token has a vector for itself and for each of its character n-grams, all in hashed rows of one table;
the vector of a document is the mean over all its tokens' features. Vectors and output weights are learned from a bounded
sample of labelled rows (``Settings.sample_rows``) by stochastic gradient descent in numpy: in each round every task runs
over its part of the sample from common weights, and the tasks' weights are averaged. To score, the output weights are
applied to the table first: the mean of these products is the product of the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut_words, durable, fold, slices


@dataclass(frozen=True)
class Settings:
    """Sizes fixed before any data is seen."""

    sample_rows: int = 4_000  # labelled rows that are learned from
    rows: int = 1 << 16  # hashed vectors
    dims: int = 8
    shortest: int = 2  # characters of an n-gram; a mark stands before and behind a token
    longest: int = 4
    rounds: int = 5
    tasks: int = 4
    batch: int = 16  # documents of an update
    batch_bytes: int = 4 << 20  # or fewer, if they are long
    rate: float = 0.2
    seed: int = 5


#: ASCII blanks part tokens.
BLANKS = bytes(32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed(sums: np.ndarray, kind: int, rows: int) -> np.ndarray:
    """Table rows of polynomial sums; ``kind`` tells n-grams of different lengths apart."""
    h = (sums + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.int64) % rows


def features(words: list[str], z: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, how many belong to each word): the row of each word and those of its n-grams, all words at once."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(start, size)
    power = np.ones(max(int(size.max(initial=1)), z.longest) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, STEP), out=power[1:])
    whole = np.add.reduceat(chars * power[place], start) if len(words) else np.zeros(0, np.uint64)
    found, owner = [hashed(whole, 0, z.rows)], [np.arange(len(words))]
    word = np.repeat(np.arange(len(words)), size)
    for n in range(z.shortest, z.longest + 1):
        at = np.flatnonzero(place + n <= np.repeat(size, size))
        sums = np.zeros(len(at), np.uint64)
        for k in range(n):
            sums += chars[at + k] * power[k]
        found.append(hashed(sums, n, z.rows))
        owner.append(word[at])
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(found)[order], np.bincount(np.concatenate(owner), minlength=len(words))


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of some texts, the number of each token in turn, and its text."""
    words, ids, row, _ = cut_words(pa.chunked_array([pc.fill_null(texts, "")]), BLANKS)
    return words.cast(pa.string()).to_pylist(), ids.astype(np.int64), row


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Weights:
    vectors: np.ndarray  # rows x dims
    output: np.ndarray  # (dims + 1) x classes, the last row is a bias

    @staticmethod
    def fresh(classes: int, z: Settings) -> Weights:
        rng = np.random.default_rng(z.seed)
        return Weights(rng.uniform(-1 / z.dims, 1 / z.dims, (z.rows, z.dims)).astype(np.float32), np.zeros((z.dims + 1, classes), np.float32))

    def products(self) -> np.ndarray:
        """The table's rows times the output weights, without the bias."""
        return self.vectors.astype(np.float64) @ self.output[:-1].astype(np.float64)


class Trainer:
    """Updates of one task in one round; steps of each row shrink with the gradients that it has had."""

    def __init__(self, w: Weights, z: Settings, rate: float):
        self.z, self.rate = z, rate
        self.vectors, self.output = w.vectors.copy(), w.output.copy()
        self.seen, self.out_seen = np.full(z.rows, 1e-8, np.float32), np.full(w.output.shape, 1e-8, np.float32)

    def gradients(self, texts: list[str | None], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(features met, their summed gradients, gradient of the output, loss) of a batch."""
        words, ids, doc = tokens_of(pa.array(texts, pa.string()))
        own, size = features(words, self.z)
        token = np.add.reduceat(self.vectors[own], np.cumsum(size) - size) if len(own) else np.zeros((0, self.z.dims), self.vectors.dtype)
        total = np.maximum(np.bincount(doc, size[ids], len(texts)), 1)
        key, times = np.unique(doc * max(1, len(words)) + ids, return_counts=True)
        doc, at = key // max(1, len(words)), key % max(1, len(words))
        weight = times / total[doc]
        mean = np.zeros((len(texts), self.z.dims))
        np.add.at(mean, doc, token[at] * weight[:, None])
        hidden = np.hstack([mean, np.ones((len(texts), 1))])
        p = softmax(hidden @ self.output)
        error = p.copy()
        error[np.arange(len(texts)), labels] -= 1
        back = error @ self.output[:-1].T  # of each document's mean
        of_token = np.zeros((len(words), self.z.dims), self.vectors.dtype)
        np.add.at(of_token, at, back[doc] * weight[:, None])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]]) if len(own) else order
        grad = np.add.reduceat(np.repeat(of_token, size, axis=0)[order], first) if len(own) else np.zeros((0, self.z.dims))
        return own[order][first], grad, hidden.T @ error, float(-np.log(p[np.arange(len(texts)), labels] + 1e-30).sum())

    def update(self, texts: list[str | None], labels: np.ndarray) -> float:
        rows, grad, out, loss = self.gradients(texts, labels)
        self.seen[rows] += (grad**2).mean(1)
        self.vectors[rows] -= (self.rate * grad / np.sqrt(self.seen[rows])[:, None]).astype(np.float32)
        self.out_seen += out**2
        self.output -= (self.rate * out / np.sqrt(self.out_seen)).astype(np.float32)
        return loss


def _round(sample: DataFrame, w: Weights, z: Settings, rate: float) -> Weights:
    """Each task's updates from common weights over its part of the sample; the mean of what they end with."""
    shared = sample.sparkSession.sparkContext.broadcast(w)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Trainer(shared.value, z, rate), 0
        texts, labels, size = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                texts.append(text)
                labels.append(label)
                size += len(text or "")
                if len(texts) == z.batch or size > z.batch_bytes:
                    own.update(texts, np.array(labels))
                    n, texts, labels, size = n + len(texts), [], [], 0
        if texts:
            own.update(texts, np.array(labels))
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([own.vectors.tobytes()], pa.binary()), pa.array([own.output.tobytes()], pa.binary())], ["vectors", "output"])

    found = sample.mapInArrow(run, "vectors binary, output binary").collect()  # at most z.tasks tables of fixed size
    mean = lambda name, like: np.mean([np.frombuffer(bytes(r[name]), np.float32).reshape(like.shape) for r in found], axis=0, dtype=np.float64).astype(np.float32)
    shared.unpersist()
    return Weights(mean("vectors", w.vectors), mean("output", w.output))


@dataclass
class Model:
    """Labels in order and the weights; without two labels to learn from, a constant."""

    settings: Settings
    labels: list[int]
    weights: Weights | None = None
    prior: float = 0.0

    def _shared(self, docs: DataFrame) -> Broadcast:
        return docs.sparkSession.sparkContext.broadcast(self.weights)

    def score(self, docs: DataFrame, text: str = "text", label: int = 1) -> DataFrame:
        """Add ``score``, the probability of ``label``, to all rows; a column of that name is replaced, all others stay.

        Whole texts are read; equal texts have equal scores, whatever is scored beside them. A null or empty text has the
        score of the bias alone.
        """
        if self.weights is None or label not in self.labels:
            return docs.withColumn("score", F.lit(self.prior if label in (0, 1) else 0.0))
        shared, z, at = self._shared(docs), self.settings, self.labels.index(label)
        keep = [f for f in docs.schema.fields if f.name != "score"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value.products()
            for batch in slices(batches, text, z.batch_bytes):
                score = probabilities(batch.column(text), table, shared.value, z)[:, at]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(score, pa.float64())], [*(f.name for f in keep), "score"])

        return docs.mapInArrow(run, StructType([*keep, StructField("score", DoubleType())]))


def probabilities(texts: pa.Array, table: np.ndarray, w: Weights, z: Settings) -> np.ndarray:
    """Texts by classes; ``table`` has the products of ``w``. Sums run within a text, whatever stands beside it."""
    words, ids, row = tokens_of(texts)
    sums = np.zeros((len(words), table.shape[1] + 1))
    for s in range(0, len(words), 1 << 16):
        own, size = features(words[s : s + (1 << 16)], z)
        sums[s : s + len(size), :-1] = np.add.reduceat(table[own], np.cumsum(size) - size)
        sums[s : s + len(size), -1] = size
    total = np.zeros((len(texts), sums.shape[1]))
    if len(ids):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for k in range(sums.shape[1]):
            total[row[first], k] = np.add.reduceat(sums[ids, k], first)
    return softmax(total[:, :-1] / np.maximum(total[:, -1:], 1.0) + w.output[-1].astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", settings: Settings = Settings()) -> Model:
    """Learn from at most ``settings.sample_rows`` labelled rows, those with the smallest hash of the id.

    Rows whose label or id is null teach nothing; an id labelled twice counts once, with its smallest label.
    """
    z = settings
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    mark = F.xxhash64(F.col("key").cast("string"))
    picked = durable(known.orderBy(mark, "key").limit(z.sample_rows))  # a bounded number of ids
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "key")
    part = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(z.seed)), F.lit(z.tasks)).cast("int")
    sample = durable(rows.repartitionById(z.tasks, part).sortWithinPartitions(mark, F.xxhash64("text")).select("text", "label"))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(z, sorted(counts), prior=float(next(iter(counts), 0)))
    order = sorted(counts)
    number = F.array_position(F.array(*map(F.lit, order)), F.col("label")) - 1
    sample, w = sample.select("text", number.alias("label")), Weights.fresh(len(order), z)
    for k in range(z.rounds):
        w = _round(sample, w, z, z.rate * (1 - k / z.rounds))
    return Model(z, order, w)


def held_out_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The corpus query: learn from labels whose fold of 3 is not 1, score every row by its whole text."""
    part = fold("doc_id", 3)
    model = fit(docs, labels.where(part != 1), settings=settings)
    out = model.score(docs.select("doc_id", (part == 1).alias("held_out"), "text"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
