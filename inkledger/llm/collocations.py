"""Phrase collocations: words that stand together far more often than their parts suggest, for each language.

Dictionary-encode, pack, sort, count. Words of each language are counted first; each (language, word) has a 64-bit code, and
the whole dictionary is checked for codes that two words share (then another seed is taken), so a code stands for one
word, and tasks need not hold the dictionary: which codes are frequent comes to them as a bitmap of fixed size. A code that
the bitmap lets through by chance only costs its n-grams' rows, which then fall under the least count.

Pieces are broken at rare words. The n-grams of a task are sorted and counted there, travel as fixed-width keys of two or
three codes, are dealt by ranges of the mixed key (uniform, so ranges need no sampling), sorted by it (one long: Spark's
radix sort) and counted by run lengths. Phrases of three words are looked for only where both their pairs are frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_language, cut_words, durable

LEAST, TOP, COVERED = 10, 2000, 50  # occurrences of a candidate, phrases of a language, per cent of them inside a longer one
SALTS = 8  # parts of a language that are ranked for themselves
BITS = 27  # bitmaps of 16 MB, whatever the input
CHUNK = 12 << 20  # bytes of text that a task sorts at once

#: A-Z lowered, piece separators as line feeds, a tab as a blank.
PIECE_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def code_of(lang: str, word: bytes, seed: int) -> int:
    """No word holds a line feed, so language and word are told apart."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\n" + word, seed)


def codes_of(lang: str, words: pa.Array, seed: int, code: Callable[[str, bytes, int], int]) -> np.ndarray:
    return np.array([code(lang, w, seed) for w in words.to_pylist()], np.uint64)


def signed(codes: np.ndarray) -> pa.Array:
    return pa.array(codes.view(np.int64))


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys and how often each occurs."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def count_words(docs: DataFrame, seed: int, code: Callable = code_of) -> DataFrame:
    """(code, lang, word, n) of every word, rare ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, rows in by_language(batches, CHUNK):
            words, ids, _, _ = cut_words(rows.column("text"), PIECE_BYTES)
            cells = [signed(codes_of(lang, words, seed, code)), pa.array([lang] * len(words), pa.string()), words.cast(pa.string()), pa.array(np.bincount(ids, minlength=len(words)))]
            yield from pa.table(cells, ["code", "lang", "word", "n"]).to_batches(100_000)

    parts = docs.mapInArrow(run, "code long, lang string, word string, n long")
    return parts.groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, code: Callable = code_of, seeds: int = 20) -> tuple[DataFrame, int]:
    """The words of all languages under codes that differ, and the seed that gives these codes."""
    for seed in range(seeds):
        words = durable(count_words(docs, seed, code))
        if words.groupBy("code").count().where("count > 1").isEmpty():
            return words, seed
    raise ValueError("no seed tells all words apart")


def mixed(*codes: Column) -> Column:
    """One long of a sequence of codes: each is turned by 21 bits before the next one comes in."""
    h = codes[0]
    for c in codes[1:]:
        h = F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43)).bitwiseXOR(c)
    return h


def mixed_codes(*codes: np.ndarray) -> np.ndarray:
    """``mixed`` of unsigned arrays."""
    h = codes[0]
    for c in codes[1:]:
        h = (h << np.uint64(21) | h >> np.uint64(43)) ^ c
    return h


def bitmap(rows: DataFrame, h: Column, bits: int = BITS) -> np.ndarray:
    """Which leading ``bits`` of ``h`` occur: 2^bits bits, however many rows there are."""
    place = F.shiftrightunsigned(h, 64 - bits) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")).collect()
    out = np.zeros(max(1 << bits - 3, 4096), np.uint8)
    for r in parts:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["b"]), np.uint8)
    return out


def holds(map_: np.ndarray, h: np.ndarray, bits: int = BITS) -> np.ndarray:
    place = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (map_[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def task_ngrams(docs: DataFrame, n: int, seed: int, words: np.ndarray, pairs: np.ndarray | None = None, code: Callable = code_of) -> DataFrame:
    """(w1, ..., wn, n): counts of the n-grams of frequent words in each task; of three words only where both pairs are in ``pairs``."""
    spark = docs.sparkSession.sparkContext
    shared = spark.broadcast((words, pairs))  # bitmaps of fixed size
    names = [f"w{k + 1}" for k in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, follow = shared.value
        for lang, rows in by_language(batches, CHUNK):
            known, ids, _, piece = cut_words(rows.column("text"), PIECE_BYTES)
            codes = codes_of(lang, known, seed, code)
            ok = holds(frequent, codes)
            x = np.where(ok[ids], (np.cumsum(ok) - 1)[ids], -1)
            codes = codes[ok]
            m = np.int64(len(codes))
            at = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0) & (piece[1:] == piece[:-1]))
            keys = x[at] * m + x[at + 1]
            if n == 3:
                found, number = np.unique(keys, return_inverse=True)
                good = holds(follow, mixed_codes(codes[found // max(m, 1)], codes[found % max(m, 1)]))
                pair = np.full(len(x), -1)
                pair[at] = np.where(good[number], number, -1)
                at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
                keys = pair[at] * m + x[at + 2]
            keys.sort()
            keys, times = run_lengths(keys)
            if not len(keys):
                continue
            parts = [keys // m, keys % m]
            if n == 3:
                parts = [found[parts[0]] // m, found[parts[0]] % m, parts[1]]
            yield from pa.table([*(signed(codes[p]) for p in parts), pa.array(times)], [*names, "n"]).to_batches(100_000)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))


def sorted_counts(parts: DataFrame, n: int, least: int) -> DataFrame:
    """(w1, ..., wn, a) of the n-grams that occur ``least`` times or more."""
    names = [f"w{k + 1}" for k in range(n)]
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = mixed(*map(F.col, names))
    place = F.shiftright(F.shiftrightunsigned(h, 33) * F.lit(tasks), 31).cast("int")

    def count(rows: list[np.ndarray]) -> pa.RecordBatch:
        h, *w, times = rows
        other = np.logical_or.reduce([c[1:] != c[:-1] for c in w])
        if (other & (h[1:] == h[:-1])).any():  # two n-grams under one mixed key may alternate
            order = np.lexsort((*w, h))
            h, *w, times = (c[order] for c in rows)
            other = np.logical_or.reduce([c[1:] != c[:-1] for c in w])
        first = np.flatnonzero(np.r_[True, other | (h[1:] != h[:-1])])
        a = np.add.reduceat(times, first)
        keep = a >= least
        return pa.RecordBatch.from_arrays([*(pa.array(c[first][keep]) for c in w), pa.array(a[keep])], [*names, "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("h", *names, "n")]
            rows = rows if held is None else [np.concatenate(c) for c in zip(held, rows, strict=True)]
            if len(rows[0]):
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                held = [c[last:] for c in rows]
                if last:
                    yield count([c[:last] for c in rows])
        if held is not None:
            yield count(held)

    dealt = parts.repartitionById(tasks, place).select(h.alias("h"), *names, "n").sortWithinPartitions("h")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "a"]))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)); products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, covered: int = COVERED, code: Callable = code_of) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r, score) of all candidates that no longer candidate covers, and (lang, n), all words of a language.

    A null language is ``und``, null and empty texts have no words, an empty table gives no rows, repeated rows count
    again. Other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words, seed = dictionary(docs, code)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = durable(words.where(F.col("n") >= least).select("code", "lang", "word", F.col("n").alias("f")))
    one = bitmap(often, F.col("code"))
    two = durable(sorted_counts(task_ngrams(docs, 2, seed, one, code=code), 2, least))
    three = durable(sorted_counts(task_ngrams(docs, 3, seed, one, bitmap(two, mixed(F.col("w1"), F.col("w2"))), code), 3, least))

    def word(k: int) -> DataFrame:
        return often.select(F.col("code").alias(f"w{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"))

    def pair(i: int, k: int) -> DataFrame:
        return two.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{k}"), F.col("a").alias(f"f{i}{k}"))

    inside = three.select("w1", "w2", "a").unionAll(three.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    open_pairs = two.join(inside, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longest") < covered * F.col("a"), F.lit(True)))
    short = open_pairs.join(word(1), "w1").join(word(2), "w2")
    short = short.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score_of(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    long = three.join(pair(1, 2), ["w1", "w2"]).join(pair(2, 3), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    a = F.col("a")
    cuts = [F.struct(score_of(a, F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "f1", "f23"), (2, "f12", "f3"))]
    long = long.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.least(*cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return short.unionAll(long), totals


def top_phrases(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The corpus query: the first ``top`` phrases of each language by score, count and phrase.

    Parts of a language are ranked first, so what meets in one task is ``SALTS`` times ``top`` phrases at most.
    """
    order = (F.desc("score"), F.desc("a"), "phrase")
    found, totals = phrases(docs, **options)
    rows = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
u AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f1 AS (SELECT lang, w[i] AS x, count(*)::HUGEINT AS f FROM u GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i+1] AS y, count(*)::HUGEINT AS f FROM u WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i+1] AS y, w[i+2] AS z, count(*)::HUGEINT AS f FROM u WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
short AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, p.f AS l, q.f AS r, 1000000 * f2.f * f2.f // (p.f * q.f) AS score
  FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
  LEFT JOIN inside i ON i.lang = f2.lang AND i.x = f2.x AND i.y = f2.y WHERE i.f IS NULL OR 100 * i.f < 50 * f2.f
), cuts AS (
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, a.f AS l1, bc.f AS r1, ab.f AS l2, c.f AS r2,
    1000000 * f3.f * f3.f // (a.f * bc.f) AS s1, 1000000 * f3.f * f3.f // (ab.f * c.f) AS s2
  FROM f3 JOIN f1 a ON a.lang = f3.lang AND a.x = f3.x JOIN f1 c ON c.lang = f3.lang AND c.x = f3.z
  JOIN f2 ab ON ab.lang = f3.lang AND ab.x = f3.x AND ab.y = f3.y JOIN f2 bc ON bc.lang = f3.lang AND bc.x = f3.y AND bc.y = f3.z
), found AS (
  SELECT * FROM short UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
