"""Hashed maximum-entropy language model with a class-factored softmax.

``P(word | history) = P(class | history) * P(word | class, history)``. The most frequent training words form the head
classes, all others fall into tail classes by a hash of their ending. Class scores sum hashed features of the history:
a bias, the preceding word (n-gram), the word before it (skip) and both (n-gram of three). Head words have a bias and a
hashed feature of the preceding word. Every other word of the corpus has weights of its own as well: a bias and one for
each group of preceding words; they are as many as the corpus has words, stay in a table over the tasks, and one share of
each class is kept for words never seen, so the model is a distribution.

Training is by distributed gradient updates. For classes and head words every training token is counted into a fixed
number of (history, class) and (history, head word) cells, and gradients over their blocks equal those over all tokens:
each update sends the weights to the tasks, sums expected counts and moves every weight by observed less expected count
over its curvature. For the other words a task holds rows of the word table: it sums the unnormalised probabilities of
its words for each (class, group), the driver gets those sums alone, and from them each task finds its own words' next
weights. Words beyond ``ModelSize.lookup`` are scored by a join with the word table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, slices, tokens

END = b"\n"  # no word holds a line feed
SLICE = 1 << 20  # bytes of text coded at once where every token takes some ten arrays


@dataclass(frozen=True)
class ModelSize:
    """Sizes fixed before any data is seen."""

    head: int = 1024  # words with scores of their own
    head_classes: int = 32
    tail_classes: int = 32
    near: int = 256  # buckets of the preceding word
    far: int = 128  # buckets of the word before it
    pair_rows: int = 8192  # hashed rows of both
    word_slots: int = 1 << 16  # hashed (preceding bucket, head word) features
    lookup: int = 1 << 18  # words (of at most ``longest`` bytes) whose counts and weights are sent to every worker; all others are joined
    longest: int = 64
    groups: int = 8  # of preceding words, for the weights of words outside the head
    updates: int = 12
    word_updates: int = 3
    train_tasks: int = 8

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail_classes


def ending(word: bytes) -> int:
    """A hash of the last three code points."""
    return zlib.crc32(word[-3:] if word.isascii() else word.decode("utf-8", "replace")[-3:].encode())


class Codes(dict):
    """Word to (near bucket, far bucket, class, head index or -1, place in the lookup or -1, group) by a row number, filled as words come."""

    def __init__(self, size: ModelSize, head: dict[bytes, int], classes: np.ndarray, places: dict[bytes, int] | None = None, keep: int = 200_000):
        super().__init__()
        self.size, self.head, self.classes, self.places, self.keep = size, head, classes, places or {}, keep
        self.rows: list[tuple[int, ...]] = []
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        z, h, e = self.size, self.head.get(word, -1), ending(word)
        near = h + 1 if 0 <= h < z.near // 2 - 1 else z.near // 2 + e % (z.near // 2)
        far = h + 1 if 0 <= h < z.far // 2 - 1 else z.far // 2 + e % (z.far // 2)
        cls = int(self.classes[h]) if h >= 0 else z.head_classes + e % z.tail_classes
        self[word] = i = len(self.rows)
        self.rows.append((near, far, cls, h, self.places.get(word, -1), 1 + e % (z.groups - 1)))
        self.words.append(word)
        return i

    def trim(self) -> None:
        """Between slices: start afresh when the table is full."""
        if len(self.rows) > self.keep:
            self.clear()
            self.rows.clear()
            self.words.clear()

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Coded tokens of all texts in a row, each text's end token included, and the texts' sizes."""
        words: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = tokens(t)
            words += own
            words.append(END)
            sizes[i] = len(own) + 1
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)), sizes


def preceding(x: np.ndarray, sizes: np.ndarray, back: int = 1) -> np.ndarray:
    """What each token's first (or second) preceding token has within its own text; 0 stands for the text's start."""
    out = np.zeros_like(x)
    out[back:] = x[:-back]
    starts = np.cumsum(sizes) - sizes
    for k in range(back):
        out[starts[sizes > k] + k] = 0
    return out


def count_words(train: DataFrame, text: str, size: ModelSize) -> DataFrame:
    """(word, tail class, g0, g1, ..., c): every training word's counts by the group of the word before it, and their sum."""
    names = [f"g{g}" for g in range(size.groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = Codes(size, {}, np.zeros(0, np.int64), keep=300_000), np.zeros((1 << 16, size.groups), np.int64)

        def flush() -> pa.RecordBatch:
            n = len(codes.rows)
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in codes.words]), pa.array(_table(codes)[:n, 2] - size.head_classes, pa.int32()), *(pa.array(held[:n, g].copy()) for g in range(size.groups))], ["word", "tail", *names])
            held[:n] = 0
            return out

        for batch in slices(batches, "text"):
            ids, sizes = codes.of(batch.column("text").to_pylist())
            n = len(codes.rows)
            if n > len(held):
                held = np.concatenate([held, np.zeros((2 * n - len(held), size.groups), np.int64)])
            before = preceding(_table(codes)[:, 5][ids], sizes)
            held[:n] += np.bincount(ids * size.groups + before, minlength=n * size.groups).reshape(n, size.groups)
            if n > codes.keep:
                yield flush()
                codes.trim()
        if codes.rows:
            yield flush()

    rows = train.select(F.col(text).alias("text")).mapInArrow(run, "word string, tail int, " + ", ".join(f"{g} long" for g in names))
    return rows.groupBy("word", "tail").agg(*[F.sum(g).alias(g) for g in names]).withColumn("c", sum((F.col(g) for g in names[1:]), F.col(names[0])))


def class_of_head(counts: np.ndarray, size: ModelSize) -> np.ndarray:
    """Classes of about equal root-frequency mass, in order of rank."""
    if not len(counts):
        return np.zeros(0, np.int64)
    mass = np.cumsum(np.sqrt(counts))
    return np.minimum((mass - np.sqrt(counts) / 2) / mass[-1] * size.head_classes, size.head_classes - 1).astype(np.int64)


def count_cells(train: DataFrame, text: str, size: ModelSize, shared) -> DataFrame:
    """(cell, n): cells of (near, far, class), then cells of (near, head word); rows of at most that many cells."""
    base = size.near * size.far * size.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes = shared.value
        codes, held = Codes(size, head, classes), np.zeros(base + size.near * size.head, np.int32)
        for batch in slices(batches, "text", SLICE):
            codes.trim()
            ids, sizes = codes.of(batch.column("text").to_pylist())
            near, far, cls, h = (_table(codes)[:, k][ids] for k in range(4))
            one = preceding(near, sizes)
            known = h >= 0
            for found in ((one * size.far + preceding(far, sizes, 2)) * size.classes + cls, base + one[known] * size.head + h[known]):
                at, n = np.unique(found, return_counts=True)
                held[at] += n.astype(np.int32)
        at = np.flatnonzero(held)
        for i in range(0, len(at), 200_000):
            part = at[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part].astype(np.int64))], ["cell", "n"])

    return train.select(F.col(text).alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _table(codes: Codes) -> np.ndarray:
    """Attributes of coded words; the growing list is copied to an array only where it has grown."""
    have = getattr(codes, "table", None)
    if have is None or codes.filled > len(codes.rows):
        codes.table, codes.filled = np.zeros((1 << 16, 6), np.int64, order="F"), 0
    if codes.filled < (n := len(codes.rows)):
        if n > len(codes.table):
            codes.table = np.asfortranarray(np.concatenate([codes.table[: codes.filled], np.zeros((2 * n - codes.filled, 6), np.int64)]))
        codes.table[codes.filled : n] = codes.rows[codes.filled :]
        codes.filled = n
    return codes.table


def pack(cells: DataFrame, size: ModelSize) -> DataFrame:
    """One row for each near bucket with its dense blocks of counts: ``size.near`` rows whatever the input."""
    base = size.near * size.far * size.classes
    per, wide = size.far * size.classes, size.head

    def one(pdf):
        import pandas as pd

        cell = pdf["cell"].to_numpy(np.int64)
        is_class = cell < base
        a, b = np.zeros(per, np.float32), np.zeros(wide, np.float32)
        a[cell[is_class] % per] = pdf["n"].to_numpy()[is_class]
        b[(cell[~is_class] - base) % wide] = pdf["n"].to_numpy()[~is_class]
        near = cell[0] // per if is_class[0] else (cell[0] - base) // wide
        return pd.DataFrame({"near": [near], "by_class": [a.tobytes()], "by_word": [b.tobytes()]})

    near = F.when(F.col("cell") < base, F.floor(F.col("cell") / per)).otherwise(F.floor((F.col("cell") - base) / wide))
    return cells.groupBy(near.alias("k")).applyInPandas(one, "near int, by_class binary, by_word binary")


class Model:
    """Weights of both softmaxes and how to score with them."""

    def __init__(self, size: ModelSize, classes: np.ndarray):
        z = size
        self.size, self.classes = z, classes
        self.w = {"bias": np.zeros(z.classes), "near": np.zeros((z.near, z.classes)), "far": np.zeros((z.far, z.classes)), "pair": np.zeros((z.pair_rows, z.classes)), "word": np.zeros(z.head), "slot": np.zeros(z.word_slots)}
        self.starts = np.searchsorted(classes, np.arange(z.head_classes)) if len(classes) else np.zeros(0, int)

    def pair_rows(self, near: int) -> np.ndarray:
        """Hashed rows of both buckets; each near bucket has a range of its own, so a task's sums stay small."""
        k = self.size.pair_rows // self.size.near
        return near * k + (np.arange(self.size.far) * 0x85EBCA6B + near * 0x9E3779B1 >> 7) % k

    def slots(self, near: int) -> np.ndarray:
        k = self.size.word_slots // self.size.near
        return near * k + (np.arange(len(self.classes)) * 0x27D4EB2F + near * 0xC2B2AE35 >> 5) % k

    def class_log(self, near: int) -> np.ndarray:
        """log P(class | near, each far), of shape (far, class)."""
        x = self.w["bias"] + self.w["near"][near] + self.w["far"] + self.w["pair"][self.pair_rows(near)]
        x -= x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def word_log(self, near: int) -> np.ndarray:
        """log P(head word | its class, near)."""
        n = len(self.classes)
        if not n:
            return np.zeros(0)
        x = self.w["word"][:n] + self.w["slot"][self.slots(near)]
        used = np.unique(self.classes)
        first = np.searchsorted(self.classes, used)
        x = x - np.repeat(np.maximum.reduceat(x, first), np.diff([*first, n]))
        return x - np.repeat(np.log(np.add.reduceat(np.exp(x), first)), np.diff([*first, n]))

    def own(self, near: int) -> dict[str, slice]:
        """The weights that only one near bucket has."""
        p, q = self.size.pair_rows // self.size.near, self.size.word_slots // self.size.near
        return {"near": slice(near, near + 1), "pair": slice(near * p, near * p + p), "slot": slice(near * q, near * q + q)}

    def sums(self, rows, observed: bool) -> Iterator[tuple[str, int, bytes]]:
        """Expected (or observed) counts of the weights over rows of packed counts: (name, near or -1, float32 bytes)."""
        z, n = self.size, len(self.classes)
        to = {k: np.zeros_like(v) for k, v in self.w.items()}
        for near, by_class, by_word in rows:
            a = np.frombuffer(by_class, np.float32).reshape(z.far, z.classes).astype(float)
            b = np.frombuffer(by_word, np.float32)[:n].astype(float)
            if not observed:
                a = np.exp(self.class_log(near)) * a.sum(1, keepdims=True)
                b = np.exp(self.word_log(near)) * np.bincount(self.classes, b, z.head_classes)[self.classes] if n else b
            to["bias"] += a.sum(0)
            to["near"][near] += a.sum(0)
            to["far"] += a
            np.add.at(to["pair"], self.pair_rows(near), a)
            to["word"][:n] += b
            np.add.at(to["slot"], self.slots(near), b)
            for k, at in self.own(near).items():
                yield k, near, to[k][at].astype(np.float32).tobytes()
        for k in ("bias", "far", "word"):
            yield k, -1, to[k].astype(np.float32).tobytes()

    def update(self, seen: dict, want: dict) -> None:
        """One gradient step, scaled by counts; the four (two) active features share it."""
        for k, prior, share in (("bias", 0.1, 4), ("near", 1.0, 4), ("far", 1.0, 4), ("pair", 2.0, 4), ("word", 0.1, 2), ("slot", 1.0, 2)):
            gradient = seen[k] - want[k] - prior * 0.05 * self.w[k]
            self.w[k] += 1.6 / share * gradient / (np.maximum(seen[k], want[k]) + prior)


def train_model(packed: DataFrame, size: ModelSize, classes: np.ndarray) -> Model:
    """Distributed updates: the tasks hold blocks of counts, the driver only weights and their sums, all of fixed size."""
    model, sc = Model(size, classes), packed.sparkSession.sparkContext

    def summed(observed: bool) -> dict[str, np.ndarray]:
        weights = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("near", "by_class", "by_word")), strict=True)]
            if rows:
                k, near, counts = zip(*weights.value.sums(rows, observed), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(near, pa.int32()), pa.array(counts)], ["k", "near", "counts"])

        total = {k: np.zeros_like(v) for k, v in model.w.items()}
        for p in packed.mapInArrow(run, "k string, near int, counts binary").toArrow().to_pylist():  # fixed size
            to = total[p["k"]] if p["near"] < 0 else total[p["k"]][model.own(p["near"])[p["k"]]]
            to += np.frombuffer(p["counts"], np.float32).reshape(to.shape)
        weights.unpersist()
        return total

    seen = summed(True)
    for _ in range(size.updates):
        model.update(seen, summed(False))
    return model


class WordModel:
    """Weights of the words outside the head, from their counts and what the driver keeps of each update.

    A word has a bias and a weight for each group of preceding words; within its class and a group its probability is
    exp(bias + weight) over the sum of all of them and of one half, which words never seen share. ``sums`` has that sum
    for (update, class, group); a word's weights after any update follow from its own counts and those sums, so nothing
    but counts needs keeping.
    """

    def __init__(self, size: ModelSize, seen: np.ndarray):
        self.size, self.seen, self.sums = size, seen, []  # seen: training tokens by (class, group)

    def weights(self, counts: np.ndarray, tail: np.ndarray, updates: int | None = None) -> np.ndarray:
        """bias + weight by group, of rows of counts (word, group), after so many updates (all that there are sums for)."""
        counts = counts.astype(float)
        c = counts.sum(1)
        bias, own = np.log(c + 0.5), np.zeros_like(counts)
        share = self.seen / np.maximum(self.seen.sum(1, keepdims=True), 1)
        bias = bias[:, None] + np.zeros(counts.shape[1])
        for total in self.sums[:updates]:
            want = np.exp(bias + own) / total[tail] * self.seen[tail]
            own += 0.7 * (counts - want - 1.0 * own) / (np.maximum(counts, want) + 1.0)
            all_want, some = want.sum(1), share[tail].sum(1) > 0
            bias += np.where(some, 0.3 * (c - all_want) / (np.maximum(c, all_want) + 0.5), 0.0)[:, None]
        return bias + own

    def log10(self, counts: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """log10 P(word | its class, group), of shape (word, group); the last sums are of the weights before a further update."""
        return (self.weights(counts, tail, len(self.sums) - 1) - np.log(self.sums[-1][tail])) / np.log(10)

    def unseen(self) -> np.ndarray:
        """log10 of what a class keeps for words never seen, by (class, group)."""
        return np.log10(0.5 / self.sums[-1])


def columns_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy() for n in names], 1)


def train_words(counts: DataFrame, size: ModelSize) -> WordModel:
    """Distributed updates over the word table; the driver gets (class, group) sums, a number fixed by the sizes."""
    z, names, sc = size, [f"g{g}" for g in range(size.groups)], counts.sparkSession.sparkContext
    seen = np.zeros((z.tail_classes, z.groups))
    for r in counts.groupBy("tail").agg(*[F.sum(g).alias(g) for g in names]).collect():
        seen[r["tail"]] = [r[g] for g in names]
    model = WordModel(z, seen)
    for _ in range(z.word_updates + 1):
        given = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            total = np.zeros((z.tail_classes, z.groups))
            for batch in batches:
                tail = batch.column("tail").to_numpy()
                np.add.at(total, tail, np.exp(given.value.weights(columns_of(batch, names), tail)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(z.tail_classes, dtype=np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in total.T)], ["tail", *names])

        parts = counts.mapInArrow(run, "tail int, " + ", ".join(f"{g} double" for g in names)).groupBy("tail").agg(*[F.sum(g).alias(g) for g in names])
        total = np.full((z.tail_classes, z.groups), 0.5)
        for r in parts.collect():
            total[r["tail"]] += [r[g] for g in names]
        model.sums = [*model.sums, total]
        given.unpersist()
    return model


def score_texts(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", extra: dict | None = None, size: ModelSize = ModelSize()) -> DataFrame:
    """Score every whole text of ``docs`` with a model of ``train``'s texts.

    Columns: key, those of ``extra`` (name to expression), n_tokens, n_known, train_tokens, base_score, score; one row for
    each input row, repeated rows included. A null or empty text is its end token alone. With nothing to learn from, all
    words are unknown, the base score is 0 and the model is uniform over its classes.
    """
    spark, z = docs.sparkSession, size
    sc = spark.sparkContext
    names = [f"g{g}" for g in range(z.groups)]
    counts = durable(count_words(train, text, z))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    # The lookup: words from a count on, of which a histogram of bounded size tells that they are few enough.
    step, short = F.floor(F.log2("c") * 64).cast("int"), F.octet_length("word") <= z.longest
    bars = sorted(((r["step"], r["n"]) for r in counts.where(short).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    sizes = np.cumsum([n for _, n in bars])
    fit = int(np.searchsorted(sizes, z.lookup, "right"))
    if not fit and bars:  # so small a lookup that the first bar is too long
        top = counts.where(short & (step >= bars[0][0])).orderBy(F.desc("c"), "word").limit(z.lookup).toArrow()
    else:
        top = counts.where(short & (step >= (bars[fit - 1][0] if bars else 0))).toArrow()
    top = top.sort_by([("c", "descending"), ("word", "ascending")])
    words = [w.encode() for w in top.column("word").to_pylist()]
    freq = top.column("c").to_numpy()
    head = {w: i for i, w in enumerate(words[: z.head])}
    classes = class_of_head(freq[: z.head], z)
    is_head = F.broadcast(spark.createDataFrame(pa.table({"word": pa.array([w.decode() for w in head], pa.string())})))
    tails = counts.join(is_head, "word", "left_anti")
    word_model = train_words(tails, z)
    held = np.stack([top.column(g).to_numpy() for g in names], 1) if len(words) else np.zeros((0, z.groups), np.int64)
    tail_log = word_model.log10(held, top.column("tail").to_numpy()).astype(np.float32)  # a head word's row is not used
    unseen = word_model.unseen()

    shared = sc.broadcast((head, classes))
    packed = durable(pack(count_cells(train, text, z, shared), z).coalesce(z.train_tasks))
    model = train_model(packed, z, classes)
    by_class = np.stack([model.class_log(i) for i in range(z.near)]).astype(np.float32) / np.float32(np.log(10))
    by_word = np.stack([model.word_log(i) for i in range(z.near)]).astype(np.float32) / np.float32(np.log(10))
    given = sc.broadcast((head, classes, {w: i for i, w in enumerate(words)}, np.log10(freq + 0.5), tail_log, unseen, by_class, by_word))
    base_log = float(np.log10(n_all + 0.5 * (v_all + 1)))
    extra = extra or {}
    kept = docs.select(F.col(key).alias("key"), *[e.alias(n) for n, e in extra.items()], F.col(text).alias("text"))
    plain = [f for f in kept.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes, places, logs, tail_log, unseen, by_class, by_word = given.value
        codes = Codes(z, head, classes, places)
        for batch in slices(batches, "text", SLICE):
            codes.trim()
            ids, sizes = codes.of(batch.column("text").to_pylist())
            near, far, cls, h, place, group = (_table(codes)[:, k][ids] for k in range(6))
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            one, before = preceding(near, sizes), preceding(group, sizes)
            log_p = by_class[one, preceding(far, sizes, 2), cls].astype(float)
            in_head, sure = h >= 0, place >= 0
            log_p[in_head] += by_word[one[in_head], h[in_head]]
            tail = sure & ~in_head
            log_p[tail] += tail_log[place[tail], before[tail]]
            base = np.bincount(text_of[sure], logs[place[sure]], len(sizes)) - sizes * base_log
            # What the lookup lacks: (text, word, group) with its number of times, for the join.
            lost = ~sure
            keys, times = np.unique((text_of[lost] * len(codes.rows) + ids[lost]) * z.groups + before[lost], return_counts=True)
            who, at = keys // z.groups, keys % z.groups
            who, word = who // len(codes.rows), who % len(codes.rows)
            kept_share = unseen[_table(codes)[:, 2][word] - z.head_classes, at]
            rare = pa.StructArray.from_arrays([pa.array([codes.words[i] for i in word.tolist()], pa.binary()).cast(pa.string()), pa.array(at), pa.array(times), pa.array(kept_share, pa.float64())], ["word", "group", "times", "unseen"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(sizes) + 1)), pa.int32()), rare)
            cols = [pa.array(sizes), pa.array(np.bincount(text_of[sure], minlength=len(sizes))), pa.array(base), pa.array(np.bincount(text_of, log_p, len(sizes))), lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in plain), *cols], [*(f.name for f in plain), "n_tokens", "n_known", "base_score", "score", "rare"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    scored = kept.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,group:long,times:long,unseen:double>>")
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()))

    def logs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = word_model.log10(columns_of(batch, names), batch.column("tail").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(list(x), pa.list_(pa.float64()))], ["word", "c", "log_p"])

    # Words beyond the lookup: their counts and weights come from the whole table, and sums go back to the rows.
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.*")
    table = counts.mapInArrow(logs_of, "word string, c long, log_p array<double>")
    rare = rare.join(table, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))).alias("log_c"),
        F.sum(F.col("times") * F.coalesce(F.get("log_p", F.col("group").cast("int")), F.col("unseen"))).alias("log_p"),
    )
    return scored.join(rare, "row", "left").select(
        F.col("key").alias(key), *extra, "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("log_c", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("log_p", F.lit(0.0))).alias("score"),
    )


def held_out_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus query: learn from the ids whose fold of 5 is not 1, score all."""
    held = fold(key, 5) == 1
    return score_texts(docs, docs.where(~held), key, text, {"held_out": held})
