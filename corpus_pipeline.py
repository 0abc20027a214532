"""A training corpus from ``documents``: language ID, toxicity, SimHash near-duplicates, best-fit packing.

Each stage takes all rows that its predecessor kept; every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.llm import language_id, packing, simhash, toxicity
from inkledger.llm.common import durable, fold, table

#: A text goes if it has no letter, or if no language holds this share of its letters.
LEAST_LANGUAGE_SHARE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters (null and empty ones too) and those without a leading language."""
    columns = docs.columns
    model = language_id.fit(docs.where(fold("doc_id", 3) != 1))
    names = {c: f"kept_{i}" for i, c in enumerate(columns)}  # the input may have columns of the operator's names
    found = language_id.identify(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), model, text=names["text"])
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts scored 0.5 or more; the model learns from the labelled rows among ``docs``."""
    columns = docs.columns
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = {c: f"kept_{i}" for i, c in enumerate(columns)}
    scored = model.score(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), text=names["text"])
    return scored.where(F.col("score") < 0.5).select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-copies: that with the smallest id."""
    return simhash.one_of_each(docs, settings=simhash.NEAR_COPIES).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return packing.pack_sequences(docs)


STAGES = [("language_id", keep_known_languages), ("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("packing", pack)]
#: Trained classifiers, components and greedy packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    return reduce(lambda docs, stage: durable(stage[1](spark, docs, sf_dir)), STAGES[:-1], table(spark, sf_dir, "documents")).transform(lambda docs: STAGES[-1][1](spark, docs, sf_dir))
