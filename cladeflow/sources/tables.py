"""CSV and TSV inputs: metadata, annotations, stage tables, fetch reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.labels import ACCESSION_PATTERN

# Column names the pipeline recognises, in order of preference.
ACCESSION_COLUMNS = ("asm_acc", "assembly_accession", "assembly", "accession", "asm_accn", "gca", "Assembly Accession")
HOST_COLUMNS = ("host_group", "Host_Group", "hostgroup", "group")
COUNTRY_COLUMNS = ("geo_loc_name", "country")
TEXT_COLUMNS = ("text", "seq", "html")
ARO_COLUMNS = ("ARO Accession", "Drug Class", "Resistance Mechanism", "AMR Gene Family")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table.  One that comes in fewer splits than there are cores is spread out.

    Operators expand a row of text into thousands of k-mers, so the few splits of a small
    file would keep most cores idle.  A large table has more splits and is read as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    wide = any(f.name in TEXT_COLUMNS for f in df.schema)
    return df.repartition(cores) if wide and df.rdd.getNumPartitions() < cores else df


def read_csv(spark: SparkSession, path: str, sep: str = ",", null: str = "NULL") -> DataFrame:
    """All columns as text; the token ``NULL`` and empty cells are NULL."""
    df = spark.read.csv(path, header=True, sep=sep, nullValue=null)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def pick_column(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def accession_column(df: DataFrame) -> str:
    """Known name, else the leftmost column that holds an assembly accession anywhere."""
    named = pick_column(df, ACCESSION_COLUMNS)
    if named:
        return named
    if df.columns:
        holds = df.agg(*[F.bool_or(F.col(f"`{c}`").cast("string").rlike(ACCESSION_PATTERN)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
        for i, c in enumerate(df.columns):
            if holds[i]:
                return c
    raise ValueError(f"no accession column among {df.columns}")


def accessions(df: DataFrame) -> DataFrame:
    """Non-null, trimmed accessions."""
    return df.select(F.trim(F.col(f"`{accession_column(df)}`").cast("string")).alias("accession")).filter("accession IS NOT NULL")


def isolate_metadata(df: DataFrame) -> DataFrame:
    """``(strain, host_group, serovar, country, collection_date, year, date_precision)``; absent columns are NULL."""
    def col(name: str | None):
        return F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")

    date = col(pick_column(df, ("collection_date",)))
    parts = F.size(F.split(date, "-"))
    return df.select(
        F.trim(col(accession_column(df))).alias("strain"), F.trim(col(pick_column(df, HOST_COLUMNS))).alias("host_group"),
        col(pick_column(df, ("serovar",))).alias("serovar"), col(pick_column(df, COUNTRY_COLUMNS)).alias("country"),
        date.alias("collection_date"), F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")).cast("int").alias("year"),
        F.when(date.isNull(), None).when(parts == 1, "year").when(parts == 2, "month").otherwise("day").alias("date_precision"))


def read_aro(spark: SparkSession, path: str) -> DataFrame:
    """``(aro, drug, mech, family)`` of a tab-separated index.

    Empty when the file or a column is missing.  Rows too short to hold all four are skipped,
    which a CSV reader could not tell from empty cells.  Of an accession listed twice the last
    line counts, by its place in the file.
    """
    none = spark.createDataFrame([], "aro string, drug string, mech string, family string")
    if not path:
        return none
    try:
        lines = spark.read.text(path).withColumn("at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    first = lines.select("value").first()
    header = first.value.split("\t") if first else []
    if not all(c in header for c in ARO_COLUMNS):
        return none
    at = [header.index(c) for c in ARO_COLUMNS]
    cells = F.split("value", "\t")
    rows = lines.filter((F.col("value") != first.value) & (F.size(cells) > max(at))).select(
        "at", *[F.trim(F.get(cells, i)).alias(n) for i, n in zip(at, ("aro", "drug", "mech", "family"))])
    return rows.groupBy("aro").agg(F.max_by(F.struct("drug", "mech", "family"), "at").alias("m")).select("aro", "m.*")


def complete(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Exactly ``columns`` in order; missing ones are NULL."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns])


def fetch_report(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Per accession what is on disk: ``files(accession, size_bytes, n_contigs)``."""
    return wanted.join(files, "accession", "left").select(
        "accession", F.concat("accession", F.lit(".fna")).alias("file"), "size_bytes", "n_contigs",
        F.when(F.col("size_bytes").isNotNull(), "cached").otherwise("missing").alias("status"))


def fetch_totals(report: DataFrame) -> DataFrame:
    """Genomes available, their total size, and whether any is missing."""
    ok = F.col("status").isin("ok", "cached")
    return report.agg(F.count("*").alias("n_genomes"), F.count_if(ok).alias("n_available"),
                      F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes"),
                      F.sum(F.coalesce("n_contigs", F.lit(0))).alias("n_contigs"))


def genome_files(spark: SparkSession, folder: str, pattern: str = "*.fna") -> DataFrame:
    """``(accession, size_bytes, n_contigs)`` of the FASTA files in a folder."""
    from cladeflow.sources.fasta import file_stem, read_fasta

    sizes = (spark.read.option("pathGlobFilter", pattern).format("binaryFile").load(folder)
             .select(file_stem(F.col("path")).alias("accession"), F.col("length").alias("size_bytes")))
    counts = read_fasta(spark, folder, pattern, keep_empty=True).groupBy(
        file_stem(F.col("path")).alias("accession")).agg(F.count("*").alias("n_contigs"))
    return sizes.join(counts, "accession", "left")
