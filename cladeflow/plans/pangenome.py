"""Proteins to gene families, presence/absence, classes and domain enrichment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators import families as FM
from cladeflow.operators import stats as S
from cladeflow.operators.common import checkpoint
from cladeflow.params import DOMAIN_MAX_EVALUE, FamilyParams


@dataclass(frozen=True)
class PanGenome:
    membership: DataFrame          # gene_key, family, strain
    families: DataFrame            # family, n_genomes, n_proteins, class
    partition: DataFrame           # class, n_families, share
    representatives: DataFrame     # family, gene_key, seq


def build(proteins: DataFrame, params: FamilyParams = FamilyParams()) -> PanGenome:
    """``proteins(gene_key, strain, ord, seq)`` clustered; one representative per family."""
    assigned = checkpoint(FM.cluster(proteins.select("gene_key", "seq"), params).select("gene_key", "family"))
    members = proteins.join(assigned, "gene_key")
    families = FM.family_stats(members)
    longest = FM.representatives(members.withColumn("ord", F.struct("strain", "ord"))).select("family", "gene_key")
    reps = longest.join(proteins.select("gene_key", "seq"), "gene_key").select("family", "gene_key", "seq")
    return PanGenome(members.select("gene_key", "family", "strain"), families, FM.class_partition(families), reps)


def annotate(families: DataFrame, domain_hits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Domains of each family with its class, annotation rate per class, enrichment by domain."""
    domains = FM.best_domain(domain_hits, DOMAIN_MAX_EVALUE)
    annotation = domains.join(families.select("family", "class"), "family", "left")
    return annotation, FM.annotation_rate(families, domains), S.domain_enrichment(domains, families).orderBy("q_value", "pfam")
