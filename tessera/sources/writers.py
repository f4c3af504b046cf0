"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relations import append_aligned


def dataset(df: DataFrame, csv_path: str, fasta_path: str, header: Column, seq: str) -> None:
    """A table as CSV without its sequences, and as FASTA with new headers."""
    df.drop(seq).write.mode("overwrite").csv(csv_path, header=True)
    fasta(df.where(F.col(seq).rlike("^[AUGC]+$")), fasta_path, header, seq)


def fasta(df: DataFrame, path: str, header: Column, seq: str) -> None:
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def ranked_fasta(df: DataFrame, path: str, order: list[Column], header: Column, seq: str, most: int) -> None:
    """The first rows of a ranking, in its order; rows without a sequence over the four letters don't count."""
    fasta(df.where(F.col(seq).rlike("^[AUGC]+$")).orderBy(*order).limit(most), path, header, seq)


def append(target: DataFrame, rows: DataFrame, path: str) -> None:
    """Append in the columns and order of what is there."""
    append_aligned(target, rows).write.mode("append").parquet(path)


def selected(df: DataFrame, columns: list[str], path: str) -> None:
    """Overwrite with some columns, each once."""
    df.select(*dict.fromkeys(columns)).write.mode("overwrite").parquet(path)


def report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)
