"""Stylometry and machine-text likelihood of submissions (columns id, text, low)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X


def text_stats(subs: DataFrame) -> DataFrame:
    words = subs.select("id", F.length("text").alias("char_count"), X.blank_words(F.col("text")).alias("w"), F.size(F.filter(F.split("text", r"[.!?]+"), lambda s: F.regexp_replace(s, r"[ \n]", "") != "")).alias("sentence_count"), F.when(F.col("text") == "", 0).otherwise(1).alias("paragraph_count"))
    n, letters = F.size("w"), X.total(F.col("w"), F.length)
    ratio = lambda a, b, k: F.when(b > 0, X.half_up(a / b, k)).otherwise(F.lit(0.0))
    return words.select("id", "char_count", n.alias("word_count"), "sentence_count", "paragraph_count", ratio(letters, n, 2).alias("avg_word_length"), ratio(n, F.col("sentence_count"), 2).alias("avg_sentence_length"), ratio(F.size(F.array_distinct(F.transform("w", F.lower))), n, 3).alias("unique_word_ratio"))


def sentence_lengths(text: Column, longer_than: int) -> Column:
    return F.transform(X.sentences(text, longer_than), X.count_words)


# Each signal is a pair of projections over the same rows: arrays of a text first, then the values made of them. All
# signals of a text thus come from one scan, without a shuffle.

Step = tuple[dict[str, Column], dict[str, Column]]


def of_sentences(longer_than: int = 5) -> Step:
    lengths = F.col("lengths")
    mean, var, std = X.length_moments(lengths)
    out = lambda c, k: F.coalesce(X.half_up(c, k), F.lit(0.0))
    values = {"sentences": F.size(lengths), "mean": out(mean, 2), "variance": out(var, 2), "std": out(std, 2), "cv": F.when(mean > 0, X.half_up(std / mean, 3)).otherwise(F.lit(0.0))}
    return {"lengths": sentence_lengths(F.col("text"), longer_than)}, values


def of_words() -> Step:
    w = F.col("style_w")
    content = F.transform(X.content_words(w), lambda x: F.xxhash64(x))
    return {"style_w": X.style_words(F.col("low"))}, {"word_count": F.size(w), "letters": X.total(w, F.length), "content": content}


def of_markers() -> Step:
    a, h = F.col("ai_m"), F.col("human_m")
    found = {"ai_m": X.markers_found(F.col("low"), L.AI_MARKERS), "human_m": X.markers_found(F.col("low"), L.HUMAN_MARKERS)}
    ratio = lambda x, of: X.half_up(F.size(x) / F.lit(float(len(of))), 3)
    return found, {"ai_marker_count": F.size(a), "ai_marker_ratio": ratio(a, L.AI_MARKERS), "human_marker_count": F.size(h), "human_marker_ratio": ratio(h, L.HUMAN_MARKERS), "ai_markers_found": F.array_join(F.slice(a, 1, 10), "; ")}


def burst_counts(lowered: Column, most: int = 10, chunk: int = 20) -> Column:
    """Of a cleaned lower-case text the number of plain words (n) and, over the ``most`` frequent ones without stop words, their number (words) and the sum of k * squares - count * count (total)."""

    @F.arrow_udf("n int, words int, total double")
    def counted(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(BYTES, ends[-1] if len(ends) else 0, BYTES), "right"), len(texts)])
        parts = [bursts_of(texts.slice(s, e - s), most, chunk) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        n, words, total = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0), np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(total.astype(float))], ["n", "words", "total"])

    return counted(lowered)


BYTES = 1 << 21  # of the texts counted at once


def bursts_of(texts: pa.Array, most: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``burst_counts`` of some texts: words sorted by text and word make runs, ties of counts go by first place."""
    raw = [t.encode() for t in pc.fill_null(texts, "").to_pylist()]
    begins = np.cumsum([0, *(len(t) + 1 for t in raw[:-1])])
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    letter = (data >= 97) & (data <= 122)
    inside = letter | (data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data == 95)
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    first, size = edges[::2], edges[1::2] - edges[::2]
    plain = np.add.reduceat(letter, first, dtype=np.int64) == np.add.reduceat(inside, first, dtype=np.int64) if len(first) else np.zeros(0, bool)
    kept, first = data[inside][np.repeat(plain, size)], first[plain]
    of = np.searchsorted(begins, first, "right") - 1
    n = np.bincount(of, minlength=len(texts))
    place = np.arange(len(first)) - (np.cumsum(n) - n)[of]
    offsets = np.r_[0, np.cumsum(size[plain])].astype(np.int32)
    codes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    stop = pc.is_in(codes.dictionary, pa.array([w.encode() for w in L.BURST_STOPWORDS])).to_numpy(zero_copy_only=False)
    code = codes.indices.to_numpy()
    order = np.argsort(of * (len(codes.dictionary) + 1) + code, kind="stable")
    of, code, place = of[order], code[order], place[order]
    new = (np.diff(of, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0)
    run = np.flatnonzero(new)
    part = np.flatnonzero(new | (np.diff(place // chunk, prepend=-1) != 0))
    times, count = np.diff(part, append=len(of)), np.diff(run, append=len(of))
    squares = np.bincount(np.searchsorted(run, part, "right") - 1, times.astype(float) ** 2, len(run))
    best = np.lexsort((place[run], -count, of[run]))
    who = of[run][best]
    best = best[(np.arange(len(best)) - np.searchsorted(who, who) < most) & ~stop[code[run][best]]]
    who = of[run][best]
    value = np.ceil(n / chunk)[who] * squares[best] - count[best].astype(float) ** 2
    return n, np.bincount(who, minlength=len(texts)), np.bincount(who, value, len(texts))


def of_bursts(chunk: int = 20) -> Step:
    """Mean variance over chunks of the counts of the ten top words, stop words left out, halved, at most 1."""
    n, words = F.col("bursts.n"), F.col("bursts.words")
    k = F.ceil(n / chunk).cast("double")
    # Exact: the sum over the words of k * squares - count * count, over k * k and the number of words.
    ok = (n >= 20) & (F.ceil(n / chunk) >= 2) & (words > 0)
    value = F.when(ok, X.half_up(F.least(F.col("bursts.total") / (k * k) / words / 2.0, F.lit(1.0)), 3)).otherwise(F.lit(0.5))
    return {"bursts": burst_counts(F.col("low"), 10, chunk)}, {"burstiness": value}


def of_characters() -> Step:
    """Entropy of lower-case characters over 5, at most 1; 0.5 under 50 characters."""
    value = F.when(F.length("text") < 50, F.lit(0.5)).otherwise(X.half_up(F.least(X.character_entropy(F.col("low")) / 5.0, F.lit(1.0)), 3))
    return {}, {"entropy": value}


def of_phrases() -> Step:
    return {}, {"ai_hits": X.pattern_hits(F.col("low"), L.AI_PATTERNS), "human_hits": X.pattern_hits(F.col("low"), L.STUDENT_PATTERNS)}


def of_punctuation() -> Step:
    return {}, {"density": X.punctuation_density(F.col("text")), "counts": X.punctuation_counts(F.col("text"))}


def signals(subs: DataFrame, steps: list[Step], *keep: str) -> DataFrame:
    """The values of some steps and the columns ``keep``."""
    arrays = {k: v for first, _ in steps for k, v in first.items()}
    values = {k: v for _, second in steps for k, v in second.items()}
    rows = subs.select("id", "text", "low", *[v.alias(k) for k, v in arrays.items()])
    return rows.select("id", *keep, *[v.alias(k) for k, v in values.items()])


def sentence_stats(subs: DataFrame, longer_than: int = 5) -> DataFrame:
    return signals(subs, [of_sentences(longer_than)])


def mattr(subs: DataFrame) -> DataFrame:
    return signals(subs, [of_words()]).select("id", "word_count", "letters", F.size("content").alias("content_words"), X.lexical_richness(F.col("content")).alias("lexical_richness"))


def markers(subs: DataFrame) -> DataFrame:
    return signals(subs, [of_markers()])


def punctuation(subs: DataFrame) -> DataFrame:
    return signals(subs, [of_punctuation()])


def paragraphs(rows: DataFrame) -> DataFrame:
    """Paragraphs of texts that keep blank lines (columns id, text); an empty text is one empty paragraph."""
    paras = F.filter(F.split("text", "\n\n"), lambda p: F.regexp_replace(p, r"[ \n]", "") != "")
    cut = rows.select("id", F.when(F.size(paras) > 0, paras).otherwise(F.array("text")).alias("p"))
    lengths = F.transform("p", X.count_words)
    return cut.select("id", F.size("p").alias("count"), X.half_up(X.total(lengths) / F.size("p"), 1).alias("avg_length"), F.array_join(F.transform(lengths, lambda n: n.cast("string")), ",").alias("lengths"))


def char_entropy(subs: DataFrame) -> DataFrame:
    return signals(subs, [of_characters()])


def top_words(subs: DataFrame, most: int = 10, chunk: int = 20) -> DataFrame:
    """(id, rank, word, count, first, squares) of the most frequent words, ties by first position."""
    rows = subs.select("id", F.posexplode(X.frequent_words(X.plain_words(F.col("low")), most, chunk)).alias("at", "x"))
    return rows.select("id", (F.col("at") + 1).alias("rank"), "x.word", (-F.col("x.count")).cast("long").alias("count"), "x.first", "x.squares")


def burstiness(subs: DataFrame, chunk: int = 20) -> DataFrame:
    return signals(subs, [of_bursts(chunk)])


def phrase_hits(subs: DataFrame) -> DataFrame:
    return signals(subs, [of_phrases()])


def _style_values(rows: DataFrame) -> DataFrame:
    """Adds style_score, lexical_richness and avg_word_length to the values of words, sentences, markers, punctuation."""
    rows = rows.withColumn("lexical_richness", X.lexical_richness(F.col("content"))).drop("content")
    clipped = F.least(F.greatest(1.0 - F.col("ai_marker_ratio") * 2 + F.col("human_marker_ratio") * 0.5, F.lit(0.0)), F.lit(1.0))
    punct = F.when(F.col("density").between(0.01, 0.06), F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), 1 - F.abs(F.col("density") - 0.035) * 20))
    score = F.least(F.col("lexical_richness") / 0.5, F.lit(1.0)) * 0.3 + F.least(F.col("cv") / 0.5, F.lit(1.0)) * 0.3 + clipped * 0.3 + punct * 0.1
    style = F.when(F.length("text") < 20, F.lit(0.5)).otherwise(X.half_up(X.clip(score, 0.05, 1.0), 3))
    awl = F.when(F.col("word_count") > 0, F.col("letters") / F.col("word_count")).otherwise(F.lit(0.0))
    return rows.withColumns({"style_score": style, "avg_word_length": awl})


STYLE_COLUMNS = ("style_score", "lexical_richness", "cv", "ai_marker_ratio", "human_marker_ratio", "density", "avg_word_length", "word_count", "sentences")


def stylometry(subs: DataFrame) -> DataFrame:
    """All style features and their score; texts under 20 characters get the defaults."""
    rows = _style_values(signals(subs, [of_words(), of_sentences(), of_markers(), of_punctuation()], "text"))
    return rows.select("id", *STYLE_COLUMNS)


def _ai_values(rows: DataFrame) -> DataFrame:
    """Adds ai_probability, confidence and the five signals to the values they are made of."""
    mean, _, std = X.length_moments(F.col("short_lengths"))
    n_sent, length = F.size("short_lengths"), F.length("text")
    ai, human = F.least(F.col("ai_hits") / (len(L.AI_PATTERNS) * 0.3), F.lit(1.0)), F.least(F.col("human_hits") / (len(L.STUDENT_PATTERNS) * 0.3), F.lit(1.0))
    cv = F.when(mean > 0, std / mean).otherwise(F.lit(1.0))
    parts = {
        "phrase": F.greatest(F.lit(0.0), ai - human * 0.5), "uniform": F.when(n_sent >= 3, F.greatest(F.lit(0.0), 1.0 - cv)).otherwise(F.lit(0.2)), "perplexity": F.greatest(F.lit(0.0), 1.0 - F.col("entropy")),
        "burst": F.greatest(F.lit(0.0), 1.0 - F.col("burstiness") * 1.2), "style": F.when(length < 20, F.lit(0.0)).otherwise(F.col("ai_marker_ratio")),
    }
    rows = rows.withColumns(parts)
    p = F.col("phrase") * 0.55 + F.col("uniform") * 0.10 + F.col("perplexity") * 0.10 + F.col("burst") * 0.10 + F.col("style") * 0.15
    short = length < 30
    sure = F.when(short, "low").when(n_sent >= 5, "high").when(n_sent >= 2, "medium").otherwise("low")
    return rows.withColumns({"ai_probability": F.when(short, F.lit(0.1)).otherwise(X.half_up(X.clip(p, 0.02, 0.98), 3)), "confidence": sure, **{f"{c}_signal": X.half_up(F.col(c), 3) for c in parts}})


AI_COLUMNS = ("ai_probability", "confidence", *(f"{c}_signal" for c in ("phrase", "uniform", "perplexity", "burst", "style")))
AI_STEPS = (of_phrases, of_characters, of_bursts)


def _short_sentences() -> Step:
    return {"short_lengths": sentence_lengths(F.col("text"), 3)}, {}


def ai_probability(subs: DataFrame) -> DataFrame:
    """Likelihood of machine text from phrases, sentence uniformity, entropy, burstiness and markers."""
    steps = [_short_sentences(), of_markers(), *(s() for s in AI_STEPS)]
    return _ai_values(signals(subs, steps, "text", "short_lengths")).select("id", *AI_COLUMNS)


def text_signals(subs: DataFrame) -> DataFrame:
    """One row of style and machine-text values for each submission, from one scan: STYLE_COLUMNS and AI_COLUMNS."""
    steps = [_short_sentences(), of_words(), of_sentences(), of_markers(), of_punctuation(), *(s() for s in AI_STEPS)]
    return _ai_values(_style_values(signals(subs, steps, "text", "short_lengths"))).select("id", *STYLE_COLUMNS, *AI_COLUMNS)


def ai_probability_alt(subs: DataFrame) -> DataFrame:
    """The stricter word-list score; 0 under 15 words or without a sentence of over two words."""
    sents = F.filter(F.transform(F.split("text", r"[.!?]+"), X.count_words), lambda n: n > 2)
    rows = subs.select("id", X.blank_words(F.col("low")).alias("w"), sents.alias("sents"))
    count = lambda words: F.size(F.filter("w", lambda x: F.array_contains(X.words_in(words), x)))
    rows = rows.select("id", F.size("w").alias("n"), "sents", count(L.FORMAL_WORDS).alias("formal"), count(L.INFORMAL_WORDS).alias("informal"), F.arrays_overlap("w", X.words_in(L.COLLOQUIAL_WORDS)).alias("colloquial"))
    avg = X.total(F.col("sents")) / F.size("sents")
    raw = F.least(avg / 25.0, F.lit(1.0)) * 0.25 + F.least(F.col("formal") / F.col("n") * 12.0, F.lit(1.0)) * 0.40 + F.greatest(F.lit(0.0), 1.0 - F.col("informal") / F.col("n") * 8.0) * 0.35
    raw = raw * F.when(F.col("colloquial"), 0.5).otherwise(F.lit(1.0))
    return rows.select("id", F.when((F.col("n") < 15) | (F.size("sents") == 0), F.lit(0.0)).otherwise(X.half_up(X.clip(raw, 0.0, 1.0), 3)).alias("ai_probability"))


def style_distance(a: str, b: str) -> Column:
    """1 - mean relative difference of the five style features of aliases a and b."""
    parts = []
    for c in ("lexical_richness", "cv", "ai_marker_ratio", "density", "avg_word_length"):
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        parts.append(F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(0.001)))
    return X.half_up(1.0 - F.least((parts[0] + parts[1] + parts[2] + parts[3] + parts[4]) / 5, F.lit(1.0)), 3)
