"""Writers: tables, FASTA, supermatrix, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.sequence import wrap


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Report tables as CSV with a header; NULL is an empty cell."""
    df.write.mode("overwrite").option("emptyValue", "").csv(path, header=True, sep=sep)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Working tables as Parquet, one folder per ``by`` value."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def fasta_text(header: Column, seq: Column, width: int | None = None) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), wrap(seq, width) if width else seq)


def write_fasta(df: DataFrame, path: str, header: Column, seq: str = "seq", by: str | None = None,
                width: int | None = None) -> None:
    """FASTA text; with ``by`` one folder per value."""
    out = df.select(*([by] if by else []), fasta_text(header, F.col(seq), width).alias("value"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def write_supermatrix(lines: DataFrame, path: str) -> None:
    """Wrapped alignment lines under one header per taxon, range-partitioned so files keep line order."""
    text = F.when(F.col("line") == 0, F.concat(F.lit(">"), "taxon", F.lit("\n"), "text")).otherwise(F.col("text"))
    ordered = lines.repartitionByRange("taxon", "line").sortWithinPartitions("taxon", "line")
    ordered.select(text.alias("value")).write.mode("overwrite").text(path)
