"""The corpus queries, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, language_id, maxent_lm, media, mtree, packing, piece_codec, quality, simhash, source_audit, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def public_model() -> str:
    """Where a machine's public vocabulary lies; each worker asks for itself."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), model or public_model)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.held_out_scores(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(table(spark, sf_dir, "conversations"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked_documents(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_warc, op2_pieces, op3_language_model, op4_chat, op5_language, op6_nearest, op7_simhash, op8_packing, op9_toxicity, op10_media, op11_quality, op12_source_divergence, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    """The other operators have no SQL: digests of library encodings, trained models, components, greedy packing."""
    return {"op4_chat": chat.ORACLE, "op6_nearest": mtree.ORACLE, "op12_source_divergence": source_audit.ORACLE, "op13_collocations": collocations.ORACLE}
