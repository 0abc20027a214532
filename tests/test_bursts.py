"""Bursts counted over batches equal the fold over the words of each row."""

import random

from pyspark.sql import functions as F

from inkledger.functions import lexicons as L
from inkledger.functions import text as X
from inkledger.operators import style


def test_bursts_equal_the_fold(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "is", "ab", "abc", "b", "it's", "x1", "a_b", "9", "zeta.", "it"]
    texts = [" ".join(rng.choices(words, k=rng.choice((0, 1, 19, 20, 21, 90)))) for _ in range(60)] + ["", None, "  ", "a" * 50, "1 2 3"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, low string").coalesce(2)
    monkeypatch.setattr(style, "BYTES", 300)
    got = {r.id: tuple(r.b) for r in rows.select("id", style.burst_counts(F.col("low"), 4, 20).alias("b")).collect()}
    old = rows.where("low is not null").select("id", X.frequent_words(X.plain_words(F.col("low")), 4, 20).alias("top"), F.regexp_count("low", F.lit(r"\b[a-z]+\b")).alias("n")).collect()
    for r in old:
        top = [x for x in r.top if x.word not in L.BURST_STOPWORDS]
        assert got[r.id] == (r.n, len(top), sum(-(-r.n // 20) * x.squares - x["count"] ** 2 for x in top))
    assert got[61] == (0, 0, 0.0) and len(got) == len(texts)


def test_signals_fold_no_words_for_bursts(spark):
    """ai_probability: a fold over structs of all words took half its time."""
    rows = spark.createDataFrame([(1, "a b", "a b")], "id long, text string, low string")
    plan = style.ai_probability(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "squares" not in plan and "Exchange" not in plan
