"""Genomes against reference databases: hit tables per isolate, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import labels as L
from cladeflow.operators.homology import screen, screen_genomes
from cladeflow.params import MIN_PROTEIN_AA, PROTEIN_SCREEN, REPLICON_SCREEN
from cladeflow.streaming.resume import run_incremental

HIT_COLUMNS = ("strain", "query", "database", "gene", "identity_pct", "coverage_pct", "category", "product", "drug", "mech", "family")


def protein_hits(proteins: DataFrame, refs: DataFrame) -> DataFrame:
    """``proteins(gene_key, strain, seq)`` against ``refs(ref_id, label, seq)``: all passing hits."""
    queries = proteins.filter(F.length("seq") >= MIN_PROTEIN_AA).select(F.col("gene_key").alias("query_id"), "seq")
    hits = screen(queries, refs.select("ref_id", "seq"), PROTEIN_SCREEN).join(refs.select("ref_id", "label"), "ref_id")
    return hits.select(L.strain_of(F.col("query_id")).alias("strain"), F.col("label").alias("query"), "identity_pct", "coverage_pct")


def card_hits(proteins: DataFrame, refs: DataFrame, aro: DataFrame) -> DataFrame:
    """Resistance hits with drug class, mechanism and family by ARO accession."""
    hits = protein_hits(proteins, refs).withColumn("aro", L.aro_accession(F.col("query"))).join(aro, "aro", "left")
    return hits.select("strain", "query", F.lit("CARD").alias("database"), L.card_gene(F.col("query")).alias("gene"),
                       "identity_pct", "coverage_pct", F.lit("").alias("category"), F.lit("").alias("product"),
                       *[F.coalesce(c, F.lit("")).alias(c) for c in ("drug", "mech", "family")]).withColumn(
        "acquired", L.is_acquired(F.col("gene")))


def virulence_hits(proteins: DataFrame, refs: DataFrame) -> DataFrame:
    """Virulence hits; gene, product and category come from the reference header."""
    q, none = F.col("query"), F.lit("")
    return protein_hits(proteins, refs).select(
        "strain", "query", F.lit("VFDB").alias("database"), L.vfdb_gene(q).alias("gene"), "identity_pct", "coverage_pct",
        L.vfdb_category(q).alias("category"), L.vfdb_product(q).alias("product"), none.alias("drug"), none.alias("mech"),
        none.alias("family"))


def replicon_hits(contigs: DataFrame, refs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Replicon hits on the nucleotide genome, named by replicon type."""
    hits = screen_genomes(contigs, refs.select("ref_id", "seq"), REPLICON_SCREEN).join(refs.select("ref_id", "label"), "ref_id")
    return hits.withColumnRenamed("query_id", "strain").join(hosts, "strain", "left").select(
        "strain", F.coalesce("host_group", F.lit("")).alias("host_group"), L.replicon_name(F.col("label")).alias("replicon"),
        "identity_pct", "coverage_pct")


def resumable(table: DataFrame, work, root: str, *params: object) -> DataFrame:
    """Run one of the screens above isolate by isolate; finished isolates are read back."""
    return run_incremental(table, "strain", work, root, PROTEIN_SCREEN, REPLICON_SCREEN, *params)
