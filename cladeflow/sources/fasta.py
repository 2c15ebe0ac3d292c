"""FASTA files, archives of FASTA files, and genome folders."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _number(records: DataFrame) -> DataFrame:
    """Dense record numbers per file, in file order.

    Records are numbered inside their input split; only one count per split meets to give
    the splits their offsets.  A large file is therefore never sorted in one task.
    """
    split = ["path", "block"]
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("row")) - 1
    sizes = records.groupBy(*split).agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (records.withColumn("inside", inside).join(offsets, split)
            .withColumn("ord", F.col("offset") + F.col("inside")).drop("block", "row", "inside", "offset"))


def _clean(body: Column) -> Column:
    """Join sequence lines, stripping blanks at line ends, in upper case."""
    return F.upper(F.regexp_replace(body, r"[ \t\r\f]*\n[ \t\r\f]*|^[ \t\r\f]+|[ \t\r\f]+$", ""))


def _records(text: DataFrame) -> DataFrame:
    """Split numbered raw records into header and sequence; text before the first header is dropped."""
    starts = F.startswith("value", F.lit(">"))
    kept = text.filter((F.col("ord") > 0) | starts)
    raw = F.when((F.col("ord") == 0) & starts, F.substring(F.col("value"), F.lit(2), F.length("value"))).otherwise(F.col("value"))
    cut = F.instr(raw, "\n")
    header = F.when(cut > 0, F.substring(raw, F.lit(1), cut - 1)).otherwise(raw)
    body = F.when(cut > 0, F.substring(raw, cut + 1, F.length(raw))).otherwise("")
    return kept.select("path", "ord", F.regexp_replace(header, r"^\s+|\s+$", "").alias("header"), _clean(body).alias("seq"))


def _joined(text: DataFrame) -> DataFrame:
    """Numbered raw records whose text may go on in the files that follow, each joined to the whole.

    Text before the first header of a file belongs to the last record of the files before it, in the order of their names.
    Of every file one row meets the others, to find that record.
    """
    headed = (F.col("ord") > 0) | F.startswith("value", F.lit(">"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = text.groupBy("path").agg(F.max(F.when(headed, F.col("ord"))).alias("last"))
    owners = files.select("path", F.last(F.when(F.col("last").isNotNull(), F.struct("path", "last")), ignorenulls=True).over(before).alias("owner"))
    parts = text.join(F.broadcast(owners), "path").select(
        F.when(headed, F.col("path")).otherwise(F.col("owner.path")).alias("whole"),
        F.when(headed, F.col("ord")).otherwise(F.col("owner.last")).alias("ord"), "path", "value").filter("whole IS NOT NULL")
    pieces = F.sort_array(F.collect_list(F.struct("path", "value")))
    return parts.groupBy(F.col("whole").alias("path"), "ord").agg(F.array_join(pieces["value"], "\n").alias("value"))


def read_fasta(spark: SparkSession, path: str, pattern: str = "*", keep_empty: bool = False, in_parts: bool = False) -> DataFrame:
    """``(path, ord, header, seq)``: one row per record, read in parallel inside large files.

    Sequences are upper-cased, records without sequence are dropped unless ``keep_empty``.
    Gzipped files are read as they are.  With ``in_parts`` the files are parts of one text, in the order of their names,
    and a record may go on in the next ones.
    """
    lines = spark.read.option("lineSep", "\n>").option("pathGlobFilter", pattern).text(path)
    raw = lines.select("value", F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("row"))
    numbered = _number(raw)
    out = _records(_joined(numbered) if in_parts else numbered)
    return out if keep_empty else out.filter("seq != ''")


def file_stem(path: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_genomes(spark: SparkSession, folder: str, pattern: str = "*.fna") -> DataFrame:
    """``contig(strain, contig, contig_ord, seq)``: strain from the file name, contig from the header's first word."""
    records = read_fasta(spark, folder, pattern, keep_empty=True)
    return records.select(file_stem(F.col("path")).alias("strain"),
                          F.regexp_extract("header", r"^(\S*)", 1).alias("contig"),
                          F.col("ord").alias("contig_ord"), "seq")


def read_proteins(spark: SparkSession, folder: str, pattern: str = "*.faa") -> DataFrame:
    """``(gene_key, strain, ord, seq)`` of every protein file except representative sets."""
    records = read_fasta(spark, folder, pattern).filter(~F.contains(file_stem(F.col("path")), F.lit("representative")))
    return records.select(F.col("header").alias("gene_key"), F.substring_index("header", "|", 1).alias("strain"), "ord", "seq")


def read_references(spark: SparkSession, path: str, database: str, label: Column | None = None) -> DataFrame:
    """``(db, ref_id, label, seq)``; ``ref_id`` keeps file and record order."""
    records = read_fasta(spark, path)
    name = F.col("header") if label is None else label
    return records.select(F.lit(database).alias("db"),
                          F.concat_ws("#", "path", F.lpad(F.col("ord").cast("string"), 12, "0")).alias("ref_id"),
                          name.alias("label"), "seq")


def _members(suffix: str, first_only: bool):
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                blob = io.BytesIO(content)
                if zipfile.is_zipfile(blob):
                    with zipfile.ZipFile(blob) as z:
                        found = [(n, z.read(n)) for n in z.namelist() if n.endswith(suffix)]
                else:
                    blob.seek(0)
                    with tarfile.open(fileobj=blob) as t:
                        found = [(m.name, t.extractfile(m).read()) for m in t if m.isfile() and m.name.endswith(suffix)]
                found = found[:1] if first_only else found
                yield pd.DataFrame({"path": [f"{path}!{n}" for n, _ in found],
                                    "text": [b.decode("utf-8", "replace") for _, b in found]})
    return unpack


def read_archive(spark: SparkSession, path: str, suffix: str, first_only: bool = False) -> DataFrame:
    """FASTA records of the members of tar or zip archives, one task per archive file."""
    blobs = spark.read.format("binaryFile").load(path).select("path", "content")
    members = blobs.mapInPandas(_members(suffix, first_only), "path string, text string")
    raw = members.select("path", F.posexplode(F.split("text", "\n>")).alias("ord", "value"))
    return _records(raw.select("path", F.col("ord").cast("bigint").alias("ord"), "value")).filter("seq != ''")
