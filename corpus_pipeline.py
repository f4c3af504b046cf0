"""A corpus, from raw documents to packed sequences, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, language_id, near_duplicates, packing, personal_data
from tessera.llm.queries import tokenizer_path
from tessera.llm.text import bounded
from tessera.staging import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told, wordless, empty and null texts among them.

    A row is judged by its own columns, whatever its id: ids may be null or repeated, and equal rows share their fate.
    """
    bounded(spark)
    return language_id.identified_rows(docs)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the least id, a null id last; ties between rows of one id go by a hash of the row.

    Rows equal in every column count as one document.
    """
    bounded(spark)
    return near_duplicates.kept_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark window; a null id or a repeated one changes nothing."""
    bounded(spark)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of their kinds, and n_chars to match; null texts stay null."""
    bounded(spark)
    return personal_data.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row in sequences of 4096 tokens: repeated ids as often as they come, a null or empty text as its end alone."""
    bounded(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", duplicates),
    ("benchmark_decontamination", benchmark),
    ("personal_data", personal),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again. An empty table gives an empty one; more columns are carried along to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification and the skip-chain field can't be written in SQL.
ORACLE_SQL = None
