"""Gene presence over isolates: sharing between host groups, summaries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.labels import classify_pattern, is_acquired
from cladeflow.operators.distance import cross_counts


def carriers(hits: DataFrame) -> DataFrame:
    """Distinct (gene, strain) of a hit table."""
    return hits.select("gene", "strain").distinct()


def host_counts(presence: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct carriers per (gene, host group); carriers without a known group are not counted."""
    known = hosts.filter("host_group IS NOT NULL")
    return presence.join(known, "strain").groupBy("gene", "host_group").agg(F.count("*").alias("n"))


def gene_totals(presence: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(gene, n_isolates, n_hosts, acquired)``; isolates count even without a host group."""
    isolates = presence.groupBy("gene").agg(F.count("*").alias("n_isolates"))
    spread = host_counts(presence, hosts).groupBy("gene").agg(F.count("*").alias("n_hosts"))
    return (isolates.join(spread, "gene", "left").withColumn("n_hosts", F.coalesce("n_hosts", F.lit(0)))
            .withColumn("acquired", is_acquired(F.col("gene"))))


def sharing(presence: DataFrame, hosts: DataFrame) -> DataFrame:
    """Long form of the sharing matrix: ``(gene, host_group, n, n_hosts, acquired)``, one row per pair that occurs."""
    totals = gene_totals(presence, hosts).select("gene", "n_hosts", "acquired")
    return totals.join(host_counts(presence, hosts), "gene", "left").select("gene", "host_group", F.coalesce("n", F.lit(0)).alias("n"), "n_hosts", "acquired")


def sharing_matrix(presence: DataFrame, hosts: DataFrame, groups: list[str]) -> DataFrame:
    """Gene x host-group carrier counts, ``n_hosts`` and the acquired flag."""
    wide = (host_counts(presence, hosts).groupBy("gene").pivot("host_group", groups).agg(F.first("n"))
            .fillna(0, subset=groups))
    totals = gene_totals(presence, hosts).select("gene", "n_hosts", "acquired")
    return totals.join(wide, "gene", "left").fillna(0, subset=groups).select("gene", *groups, "n_hosts", "acquired")


def call_patterns(tests: DataFrame, totals: DataFrame) -> DataFrame:
    """Clumping test plus carrier totals, with the verdict on the unrounded p-value."""
    joined = totals.join(tests, "gene")
    return joined.withColumn("pattern", classify_pattern(F.col("n_isolates"), F.col("p_clumped"))).select(
        "gene", "acquired", "n_isolates", "n_hosts", "changes_observed", "changes_expected", "p_clumped", "pattern")


def isolate_summary(presence: DataFrame, metadata: DataFrame, replicons: DataFrame) -> DataFrame:
    """One row per isolate that has a hit, with its genes and replicons as sorted lists.

    ``metadata(strain, host_group, serovar, country)``, ``replicons(strain, replicon)``.
    Isolates without a hit do not appear; missing metadata stays NULL.
    """
    genes = presence.withColumn("acquired", is_acquired(F.col("gene"))).groupBy("strain").agg(
        F.count("*").alias("n_amr"), F.count_if("acquired").alias("n_acquired"),
        F.array_join(F.sort_array(F.collect_list("gene")), ", ").alias("genes"))
    plasmids = replicons.select("strain", "replicon").distinct().groupBy("strain").agg(
        F.array_join(F.sort_array(F.collect_list("replicon")), ", ").alias("replicons"))
    return (genes.join(metadata, "strain", "left").join(plasmids, "strain", "left")
            .withColumn("replicons", F.coalesce("replicons", F.lit("")))
            .select("strain", "host_group", "serovar", "country", "n_amr", "n_acquired", "genes", "replicons"))


def hit_report(hits: DataFrame) -> DataFrame:
    """Per database: rows, distinct genes by flag and distinct isolates."""
    flagged = hits.withColumn("acquired", is_acquired(F.col("gene")))
    per_gene = flagged.groupBy("database", "gene", "acquired").agg(F.count("*").alias("n"))
    genes = per_gene.groupBy("database").agg(
        F.sum("n").alias("n_hits"), F.count("*").alias("n_genes"), F.count_if("acquired").alias("n_acquired"),
        F.count_if(~F.col("acquired")).alias("n_intrinsic"))
    isolates = hits.select("database", "strain").distinct().groupBy("database").agg(F.count("*").alias("n_isolates"))
    return genes.join(isolates, "database")


def widespread(presence: DataFrame, top: int = 5) -> DataFrame:
    """The genes found in the most isolates; ties by name."""
    return (presence.groupBy("gene").agg(F.count("*").alias("n_isolates"))
            .orderBy(F.desc("n_isolates"), "gene").limit(top))


def cooccurrence(presence: DataFrame, replicons: DataFrame) -> DataFrame:
    """Isolates in which a gene and a replicon are both found: ``(gene, replicon, n_isolates)``.

    Shared-item counts over isolates: an isolate rich in both never emits their product.
    """
    counts = cross_counts(presence.select("gene", "strain"), replicons.select("replicon", "strain"), "strain")
    return counts.select(F.col("a").alias("gene"), F.col("b").alias("replicon"), F.col("n").alias("n_isolates"))


def means_by_host(pairs: DataFrame, hosts: DataFrame, value: str) -> DataFrame:
    """Mean of a pairwise value within one host group and between groups."""
    a = hosts.select(F.col("strain").alias("a"), F.col("host_group").alias("ha"))
    b = hosts.select(F.col("strain").alias("b"), F.col("host_group").alias("hb"))
    return (pairs.join(a, "a").join(b, "b")
            .groupBy(F.when(F.col("ha") == F.col("hb"), "same").otherwise("different").alias("host"))
            .agg(F.count("*").alias("n_pairs"), F.avg(value).alias("mean"), F.min(value).alias("low"),
                 F.max(value).alias("high")))
