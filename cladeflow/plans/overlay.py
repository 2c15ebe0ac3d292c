"""Relatedness, sharing between hosts, and the inherited-or-acquired test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.labels import canonical_key
from cladeflow.operators import distance as D
from cladeflow.operators import presence as P
from cladeflow.operators import tree as T
from cladeflow.operators.common import checkpoint
from cladeflow.params import PERMUTATIONS, SEED

# Host groups reported when the metadata names none.
DEFAULT_GROUPS = ("Human", "Poultry", "Cattle")


@dataclass(frozen=True)
class Overlay:
    sharing: DataFrame             # gene, host_group, n, n_hosts, acquired
    matrix: DataFrame | None       # the same with a column for each group, if these are few enough
    patterns: DataFrame
    summary: DataFrame


def relatedness(contigs: DataFrame) -> DataFrame:
    """ANI of every two isolates that share a sketch hash, contigs taken as concatenated."""
    sketches = D.sketch(contigs, join_contigs=True)
    return D.ani_pairs(sketches, contigs.select("strain"))


def build(hits: DataFrame, edges: DataFrame, metadata: DataFrame, replicons: DataFrame,
          n_perms: int = PERMUTATIONS, seed: int = SEED) -> Overlay:
    """``hits(strain, database, gene)``, tree ``edges``, isolate ``metadata``, ``replicons(strain, replicon)``.

    Every resistance gene is tested, acquired or not; the flag is carried along.
    """
    presence = checkpoint(P.carriers(hits.filter(F.col("database") == "CARD")))
    tree = T.shape(edges.select(canonical_key(F.col("node")).alias("node"), canonical_key(F.col("parent")).alias("parent"), "length"))
    on_tips = presence.select("gene", canonical_key(F.col("strain")).alias("tip"))
    T.check_overlap(tree, hits.select(canonical_key(F.col("strain")).alias("strain")))
    hosts = metadata.select("strain", "host_group")
    groups = D.wide_names(hosts.select("host_group"))
    matrix = None if groups is None else P.sharing_matrix(presence, hosts, groups or list(DEFAULT_GROUPS))
    tests = T.clumping_test(tree, on_tips, n_perms, seed)
    patterns = P.call_patterns(tests, P.gene_totals(presence, hosts)).orderBy(F.asc_nulls_last("p_clumped"), "gene")
    return Overlay(P.sharing(presence, hosts), matrix, patterns, P.isolate_summary(presence, metadata, replicons))
