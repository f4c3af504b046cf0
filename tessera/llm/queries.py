"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    conversations,
    decontamination,
    hard_negatives,
    html_text,
    language_id,
    language_model,
    near_duplicates,
    neighbours,
    packing,
    personal_data,
    quality,
    quality_rules,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public vocabulary lies on this machine; tasks get it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op2_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.joined(_table(spark, sf_dir, "documents"))


def op3_language_model_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.spans(_table(spark, sf_dir, "documents")))


def op10_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identified(language_id.of_documents(_table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"), label=hard_negatives.shifted_label())


def llm_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identified(language_id.of_pages(_table(spark, sf_dir, "pages")))
    return found.withColumnRenamed("id", "page_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_block_matrix_neighbours": op1_block_matrix_neighbours,
        "op2_signature_tree_join": op2_signature_tree_join,
        "op3_language_model_scoring": op3_language_model_scoring,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_toxicity": op5_toxicity,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_quality": op7_quality,
        "op8_html_main_text": op8_html_main_text,
        "op9_personal_data": op9_personal_data,
        "op10_language_identification": op10_language_identification,
        "op11_quality_rules": op11_quality_rules,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_hard_negatives": op13_hard_negatives,
        "llm_page_language": llm_page_language,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_block_matrix_neighbours": neighbours.SQL,
        "op2_signature_tree_join": near_duplicates.SQL,
        "op6_benchmark_decontamination": decontamination.SQL,
        "op12_conversation_repair": conversations.SQL,
        "op13_hard_negatives": hard_negatives.SQL,
    }
