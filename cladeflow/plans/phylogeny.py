"""Single-copy core families to a supermatrix, distances and a neighbour-joining tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators import distance as D
from cladeflow.operators import families as FM
from cladeflow.operators.common import checkpoint
from cladeflow.operators.msa import star_alignment
from cladeflow.operators.tree import neighbor_joining


@dataclass(frozen=True)
class Phylogeny:
    lines: DataFrame               # taxon, line, text
    distances: DataFrame           # a, b, compared, equal, distance
    tree: DataFrame                # node, parent, length
    stats: DataFrame               # one row


def build(proteins: DataFrame, membership: DataFrame, families: DataFrame, aligner=star_alignment) -> Phylogeny:
    """``proteins(gene_key, strain, ord, seq)``, ``membership(gene_key, family, strain)``.

    ``aligner`` maps (family, strain, seq) to (family, strain, aligned) and may be replaced
    by rows of a dedicated program.
    """
    n = membership.select("strain").distinct().count()
    core = checkpoint(FM.core_families(families, n))
    members = membership.select("gene_key", "family").join(core.filter("single_copy").select("family"), "family")
    sequences = FM.complete_families(FM.family_sequences(members.join(proteins, "gene_key")), n)
    blocks = checkpoint(aligner(sequences))
    alignment, layout = D.place_blocks(blocks)
    alignment = checkpoint(alignment)
    shared = checkpoint(D.p_distance(alignment, membership.select("strain")))
    distances = all_pairs(shared, alignment.select(F.col("taxon").alias("name")).distinct())
    positive = F.when(F.col("distance") > 0, F.col("distance"))
    stats = distances.agg(F.round(F.min(positive), 5).alias("min_p_distance"), F.round(F.max("distance"), 5).alias("max_p_distance"))
    stats = stats.select(
        F.lit(n).alias("n_genomes"), core.agg(F.count("*")).scalar().alias("core_families"),
        core.agg(F.count_if("single_copy")).scalar().alias("single_copy_core_families"),
        layout.agg(F.count("*")).scalar().alias("families_used_in_tree"),
        layout.agg(F.sum("width")).scalar().alias("supermatrix_columns"), "min_p_distance", "max_p_distance")
    return Phylogeny(D.supermatrix_lines(alignment), distances, neighbor_joining(distances), stats)


def all_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Add the pairs without a common column at distance 1: a tree needs the full matrix, and its
    size is the matrix itself.  Names meet in blocks, so no row holds more than one block of them."""
    n = names.count()
    if pairs.count() == n * (n - 1) // 2:
        return pairs
    blocks = max(1, -(-n // D.TAXA_PER_BLOCK))
    block = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")
    lists = names.groupBy(block.alias("block")).agg(F.collect_list("name").alias("others"))
    full = (names.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(lists, "block")
            .select(F.col("name").alias("a"), F.explode(F.filter("others", lambda b: b > F.col("name"))).alias("b")))
    return full.join(pairs, ["a", "b"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
