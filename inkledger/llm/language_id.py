"""Language identification with spans: script ranges narrow the candidates of each word, hashed character n-grams score
it, and a Viterbi pass with a switching penalty labels the words of a text, so mixed texts come out as spans.

The classifier may be fitted on a bounded sample: about ``Settings.rows_per_language`` labelled rows of each language,
picked by a hash of the id, whole texts. Prediction reads whole texts and nothing but the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import fold, slices

LETTERS = re.compile(r"[^\W\d_]+")
#: First and last code points of scripts (fixed values of the Unicode block chart); anything else is script 0.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul_jamo", 0x1100, 0x11FF),
    ("latin_more", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
FIRST = np.array([a for _, a, _ in SCRIPTS])
LAST = np.array([b for _, _, b in SCRIPTS])
ROOT = 1024  # the unit of root counts, kept as integers


@dataclass(frozen=True)
class Settings:
    rows_per_language: int = 4000
    slots: int = 1 << 15  # hashed n-grams of one to four letters
    smoothing: float = 0.5
    switch: float = 8.0  # nats lost by a change of language
    script_share: float = 0.02  # of a language's letters, for a script to be one of its own
    keep: int = 300_000  # distinct words kept by a worker


def script_of(points: np.ndarray) -> np.ndarray:
    at = np.searchsorted(FIRST, points, side="right") - 1
    return np.where((at >= 0) & (points <= LAST[at]), at + 1, 0)


def word_grams(words: list[str], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams with word edges: slot of each, the word it belongs to, and the script of each word's letters."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes]) if len(words) < 64 else np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    slot, own, h = [], [], np.zeros(len(text), np.uint64)
    for n in range(1, 5):
        h = h[: len(text) - n + 1] * np.uint64(0x100000001B3) + text[n - 1 :] + np.uint64(n) if n > 1 else text * np.uint64(0x9E3779B97F4A7C15)
        ok = left[: len(h)] >= n
        if n == 1:
            ok &= text > 3  # an edge alone says nothing
        x = h[ok]
        slot.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % slots)
        own.append(owner[: len(h)][ok])
    starts = np.cumsum(sizes) - sizes
    return np.concatenate(slot), np.concatenate(own), script_of(text[starts + 1].astype(np.int64))


class LanguageModel:
    """Log-probabilities of n-grams by language, and the languages that each script leaves."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray, settings: Settings):
        self.languages, self.settings = languages, settings
        p = grams + settings.smoothing
        self.log = np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32)  # (slot, language)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.allowed = (share >= settings.script_share).T  # (script, language)
        self.allowed[~self.allowed.any(1)] = True
        self.reset()

    def reset(self) -> None:
        self.index, self.rows, self.weight, self.filled = {}, np.zeros((1024, len(self.languages)), np.float32), np.zeros(1024, np.int32), 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "rows", "weight", "filled")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def learn(self, words: list[str]) -> None:
        """Score words not met before; those without a letter weigh nothing."""
        slot, own, script = word_grams(words, self.settings.slots)
        n = len(words)
        score = np.zeros((n, len(self.languages)), np.float32)
        order = np.argsort(own, kind="stable")
        slot, own = slot[order], own[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        score[own[first]] = np.add.reduceat(self.log[slot], first) / 2.5  # orders overlap
        score -= score.max(1, keepdims=True)
        score[~self.allowed[script]] = -60.0
        weight = np.array([len(w) if any(map(str.isalpha, w)) else 0 for w in words], np.int32)
        score[weight == 0] = 0
        need = self.filled + n
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.filled], np.zeros((2 * need - self.filled, score.shape[1]), np.float32)])
            self.weight = np.concatenate([self.weight[: self.filled], np.zeros(2 * need - self.filled, np.int32)])
        self.rows[self.filled : need], self.weight[self.filled : need] = score, weight
        self.index.update(zip(words, range(self.filled, need), strict=True))
        self.filled = need

    def codes(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.filled > self.settings.keep:
            self.reset()
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if new := list({w for ws in split for w in ws if w not in self.index}):
            self.learn(new)
        return [np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws)) for ws in split]

    def viterbi(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each text's words; all texts of a slice step forward together, the longest first."""
        order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        sizes = np.array([len(codes[i]) for i in order])
        n, k, steps = len(order), len(self.languages), int(sizes[0]) if len(order) else 0
        kind = np.int8 if k <= 127 else np.int16
        paths = [np.zeros(len(c), kind) for c in codes]
        if not steps:
            return paths
        offset = np.cumsum(sizes) - sizes
        flat = np.concatenate([codes[i] for i in order])
        back = np.zeros((len(flat), k), kind)
        active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # texts that have a word at each step
        v, own = np.zeros((n, k), np.float32), np.arange(k, dtype=kind)
        for t in range(steps):
            m = active[t]
            x = v[:m]
            if t:
                best = x.argmax(1)
                top = x[np.arange(m), best][:, None] - self.settings.switch
                stay = x >= top
                back[offset[:m] + t] = np.where(stay, own, best[:, None])
                x = np.where(stay, x, top)
            v[:m] = x + self.rows[flat[offset[:m] + t]]
        label = np.zeros(len(flat), kind)
        at = v.argmax(1).astype(kind)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            where = offset[:m] + t
            label[where] = at[:m]
            if t:
                at[:m] = back[where, at[:m]]
        for j, i in enumerate(order):
            paths[i] = label[offset[j] : offset[j] + sizes[j]]
        return paths

    def summary(self, codes: np.ndarray, path: np.ndarray) -> tuple[str, float, int]:
        """Language of most letters, its share of the letters, number of spans; ties go to the first language."""
        w = self.weight[codes]
        if not w.sum():
            return "und", 0.0, 0
        share = np.bincount(path, w, len(self.languages))
        real = path[w > 0]
        return self.languages[int(share.argmax())], float(share.max() / w.sum()), int(1 + np.count_nonzero(real[1:] != real[:-1]))


def fit(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> LanguageModel | None:
    """Count hashed n-grams by language over the bounded sample; None if there is no labelled row with a text."""
    z = settings
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row for each language
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    quota = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, z.rows_per_language / n))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            by: dict[str, Counter] = {}
            for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(LETTERS.findall(t.lower()))
            for lang, words in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, "word"):
            langs, words, counts = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
            for lang in set(langs):
                own = [i for i, x in enumerate(langs) if x == lang]
                mine, n = [words[i] for i in own], np.array([counts[i] for i in own])
                slot, owner, script = word_grams(mine, z.slots)
                to = held.setdefault(lang, np.zeros(z.slots + len(SCRIPTS) + 1, np.int64))
                np.add.at(to, slot, np.floor(np.sqrt(n) * ROOT).astype(np.int64)[owner])
                np.add.at(to, z.slots + script, n * np.array([len(w) for w in mine]))
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "slot", "n"])

    # Words are counted over the whole sample before the root, and sums are of integers: batches and splits don't matter.
    picked = rows.where(draw < quota[F.col(label)]).select(F.col(label).alias("lang"), F.col(text).alias("text"))
    words = picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    cells = words.mapInArrow(cut, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    table = np.zeros((len(languages), z.slots + len(SCRIPTS) + 1))
    at = {k: i for i, k in enumerate(languages)}
    table[[at[x] for x in cells.column("lang").to_pylist()], cells.column("slot").to_numpy()] = cells.column("n").to_numpy()
    return LanguageModel(languages, table[:, : z.slots] / ROOT, table[:, z.slots :], z)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", spans: bool = False) -> DataFrame:
    """Add lang_pred, score (share of letters in that language) and n_spans to every row, by its whole text alone.

    A null text or one without a letter gives ``und``, score 0 and no span, as does a missing model. With ``spans`` an
    array of (language, first character, end character) follows. All columns of ``docs`` stay; if one has the name of a
    new column, the new one replaces it.
    """
    new = ["lang_pred", "score", "n_spans"] + ["spans"] * spans
    kept = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            if m is None:
                found, cut = [("und", 0.0, 0)] * len(texts), [[]] * len(texts)
            else:
                codes = m.codes(texts)
                paths = m.viterbi(codes)
                found = [m.summary(c, p) for c, p in zip(codes, paths, strict=True)]
                cut = [span_list(t, m, c, p) for t, c, p in zip(texts, codes, paths, strict=True)] if spans else []
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())]
            if spans:
                cols.append(pa.array(cut, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *new])

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_spans", LongType())])
    if spans:
        schema.add("spans", ArrayType(StructType([StructField("lang", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))
    return kept.mapInArrow(run, schema)


def span_list(text: str | None, model: LanguageModel, codes: np.ndarray, path: np.ndarray) -> list[dict]:
    """Runs of words with one label, by character positions in the text."""
    out: list[dict] = []
    if not text or not len(codes):
        return out
    lowered = text.lower()
    if len(lowered) != len(text):  # a few letters lower to two code points: find words in the text as lowered singly
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for word, code, label in zip(LETTERS.finditer(lowered), codes, path, strict=False):
        if model.weight[code]:
            lang = model.languages[label]
            if out and out[-1]["lang"] == lang:
                out[-1]["end"] = word.end()
            else:
                out.append({"lang": lang, "start": word.start(), "end": word.end()})
    return out


def held_out_languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The corpus query: learn from ids whose fold of 3 is not 1, predict all."""
    part: Column = fold("doc_id", 3)
    model = fit(docs.where(part != 1), settings=settings)
    return identify(docs.select("doc_id", (part == 1).alias("held_out"), "text"), model).drop("text")
