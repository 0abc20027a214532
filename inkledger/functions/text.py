"""Cleaning, tokenising and counting as Column functions. All expect cleaned text unless they say otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import COPY_STOPWORDS, PUNCTUATION, STYLE_STOPWORDS


def half_up(x: Column, digits: int) -> Column:
    """Round to digits, ties away from zero for positive numbers; same arithmetic in every engine."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / F.lit(k)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def words_in(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_text(text: Column) -> Column:
    """Printable ASCII only, blanks joined, lines stripped, blank lines dropped; null stays null."""
    x = F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E\n]", " "), r"[ \t]+", " ")
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda line: F.trim(line)), lambda line: line != ""), "\n")


def clean_text_keep_paragraphs(text: Column) -> Column:
    """The same without dropping blank lines: three or more line ends become two, the whole is stripped."""
    x = F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E\n]", " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def blank_words(text: Column) -> Column:
    """Whitespace words."""
    return F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many whitespace words."""
    return F.regexp_count(text, F.lit(r"[^ \n]+"))


def style_words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(r"\b[a-z']+\b"), F.lit(0))


def plain_words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(r"\b[a-z]+\b"), F.lit(0))


def long_words(lowered: Column) -> Column:
    """Words of two letters or more."""
    return F.regexp_extract_all(lowered, F.lit(r"\b[a-z]{2,}\b"), F.lit(0))


def copy_words(lowered: Column) -> Column:
    """Words of two letters or more without stop words."""
    return F.filter(long_words(lowered), lambda w: ~F.array_contains(words_in(COPY_STOPWORDS), w))


def letter_runs(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(r"[a-z]+"), F.lit(0))


def content_words(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(words_in(STYLE_STOPWORDS), w))


def sentences(text: Column, longer_than: int) -> Column:
    """Split after . ! ? and blanks; keep those longer than so many characters."""
    return F.filter(F.split(text, r"(?<=[.!?])[ \n]+"), lambda s: F.length(F.trim(s)) > longer_than)


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words, joined by a blank; none if there are fewer words."""
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))


def lexical_richness(content: Column, window: int = 50) -> Column:
    """Type-token ratio, from ``window`` words on as a moving average; 3 digits, 0 without words.

    A word at place j is new in the frames that start after its last place and hold j; summed over the words sorted by
    (word, place) this is the sum of distinct words over all frames, without looking at any frame.
    """
    n = F.size(content)
    places = F.sort_array(F.transform(content, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    start = F.struct(F.lit(0).cast("long").alias("frames"), F.lit(0).alias("words"), F.lit(None).cast("long").alias("w"), F.lit(-1).alias("i"))

    def step(state: Column, x: Column) -> Column:
        again = state["w"] == x["w"]
        last = F.when(again, state["i"]).otherwise(-1)
        frames = F.least(x["i"], n - window) - F.greatest(F.lit(0), x["i"] - (window - 1), last + 1) + 1
        return F.struct((state["frames"] + F.greatest(F.lit(0), frames)).alias("frames"), (state["words"] + F.when(again, 0).otherwise(1)).alias("words"), x["w"].alias("w"), x["i"].alias("i"))

    sums = F.aggregate(places, start, step, lambda s: F.when(n < window, s["words"] / n).otherwise(s["frames"] / (F.lit(float(window)) * (n - (window - 1)))))
    return F.when(n == 0, F.lit(0.0)).otherwise(half_up(sums, 3))


#: Lower-case characters of a cleaned text, the frequent ones first.
CLEAN_CHARACTERS = " etaoinshrdlucmfwypvbgk" + "".join(c for c in map(chr, [10, *range(0x20, 0x7F)]) if not c.isupper() and c not in " etaoinshrdlucmfwypvbgk")


def character_entropy(lowered: Column) -> Column:
    """Bits per character of a cleaned text: each character in turn is taken out and the bytes that go are counted."""
    start = F.struct(lowered.alias("rest"), F.octet_length(lowered).alias("before"), F.lit(0.0).alias("s"))

    def counted(state: Column) -> Column:
        n = (state["before"] - F.octet_length(state["rest"])).cast("double")
        return state["s"] + F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(state: Column, c: Column) -> Column:
        return F.struct(F.replace(state["rest"], c, F.lit("")).alias("rest"), F.octet_length(state["rest"]).alias("before"), counted(state).alias("s"))

    size = F.octet_length(lowered)
    return F.log2(size) - F.aggregate(words_in(list(CLEAN_CHARACTERS)), start, step, counted) / size


def frequent_words(words: Column, most: int, chunk: int) -> Column:
    """The most frequent words, ties by first position: array of (count, first, word, squares).

    Counts are negative, so that the order of the structs is that of the words; ``squares`` sums the squared counts over
    chunks of so many words. Words sorted by (word, place) make runs; a run that ends meets the best so far.
    """
    run = "struct<count:int,first:int,word:string,squares:bigint>"
    places = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    start = F.struct(F.array().cast(f"array<{run}>").alias("top"), F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("squares"), F.lit(0).alias("here"), F.lit(-1).alias("chunk"))

    def best(state: Column) -> Column:
        ended = F.struct((-state["n"]).alias("count"), state["first"].alias("first"), state["w"].alias("word"), (state["squares"] + state["here"].cast("long") * state["here"]).alias("squares"))
        full = F.size(state["top"]) >= most
        worse = full & (F.struct(ended["count"], ended["first"]) > F.struct(F.element_at(state["top"], -1)["count"], F.element_at(state["top"], -1)["first"]))
        return F.when(state["w"].isNull() | F.coalesce(worse, F.lit(False)), state["top"]).otherwise(F.slice(F.sort_array(F.array_append(state["top"], ended)), 1, most))

    def step(state: Column, x: Column) -> Column:
        again = F.coalesce(state["w"] == x["w"], F.lit(False))
        at = F.floor(x["i"] / chunk).cast("int")
        same = again & (state["chunk"] == at)
        done = F.when(again, state["squares"] + F.when(same, 0).otherwise(state["here"].cast("long") * state["here"])).otherwise(F.lit(0).cast("long"))
        return F.struct(
            F.when(again, state["top"]).otherwise(best(state)).alias("top"), x["w"].alias("w"), F.when(again, state["n"] + 1).otherwise(1).alias("n"), F.when(again, state["first"]).otherwise(x["i"]).alias("first"),
            done.alias("squares"), F.when(same, state["here"] + 1).otherwise(1).alias("here"), at.alias("chunk"),
        )

    return F.aggregate(places, start, step, best)


def total(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + of(x))


def length_moments(lengths: Column) -> tuple[Column, Column, Column]:
    """Mean, population variance and deviation of an integer array, from exact integer sums; null if empty."""
    n, s, q = F.size(lengths).cast("double"), total(lengths).cast("double"), total(lengths, lambda x: x.cast("long") * x).cast("double")
    some = F.size(lengths) > 0
    var = F.when(some, (n * q - s * s) / (n * n))
    return F.when(some, s / n), var, F.sqrt(var)


def markers_found(lowered: Column, markers: list[str]) -> Column:
    """Markers contained anywhere, in list order."""
    return F.filter(words_in(markers), lambda m: F.contains(lowered, m))


def needed_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern holds."""
    plain = re.sub(r"\((?:[^()]*)\)\??", "\0", pattern)  # groups
    plain = re.sub(r"\[[^\]]*\]\??|\\[a-zA-Z][+*?]?|.\?", "\0", plain)  # classes, escapes, optional characters
    return max(plain.split("\0"), key=len)


def pattern_hits(lowered: Column, patterns: list[str]) -> Column:
    """How many patterns match at least once; a substring test spares most regular expressions."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.when(F.contains(lowered, F.lit(needed_literal(p))) & lowered.rlike(p), 1).otherwise(0)
    return out


def punctuation_density(text: Column) -> Column:
    marks = F.length(text) - F.length(F.translate(text, "".join(PUNCTUATION), ""))
    return F.when(F.length(text) > 0, half_up(marks / F.length(text), 4)).otherwise(F.lit(0.0))


def punctuation_counts(text: Column, most: int = 8) -> Column:
    """``mark:count`` of the most frequent marks, ties by first position."""
    each = F.transform(words_in(PUNCTUATION), lambda c: F.struct((F.length(F.replace(text, c, F.lit(""))) - F.length(text)).alias("n"), F.call_function("instr", text, c).alias("p"), c.alias("c")))
    return F.array_join(F.transform(F.slice(F.array_sort(F.filter(each, lambda s: s["n"] < 0)), 1, most), lambda s: F.concat(s["c"], F.lit(":"), (-s["n"]).cast("string"))), " ")
