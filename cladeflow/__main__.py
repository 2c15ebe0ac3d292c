"""Command line: ``spark-submit -m cladeflow <stage> ...``; one stage per run, tables in between."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cladeflow.operators import genomes as G
from cladeflow.operators.distance import to_wide, wide_names
from cladeflow.operators.families import presence_matrix
from cladeflow.operators.presence import hit_report
from cladeflow.operators.tree import shape
from cladeflow.plans import overlay, pangenome, phylogeny, screening
from cladeflow.sources import fasta, newick, sinks, tables
from cladeflow.streaming.resume import content


def fetch(spark, a):
    wanted = tables.accessions(tables.read_csv(spark, a.metadata))
    report = tables.fetch_report(wanted, tables.genome_files(spark, a.genomes))
    sinks.write_csv(report, f"{a.out}/fetch_report")
    totals = tables.fetch_totals(report).first()
    return 0 if totals.n_available == totals.n_genomes else 2


def genes(spark, a):
    contigs = fasta.read_genomes(spark, a.genomes)
    called = G.call_orfs(contigs, 1)
    number = F.concat_ws("_", "contig", F.col("begin").cast("string"), "strand")
    called = called.withColumn("gene_id", number)
    for kind, column in (("faa", "protein"), ("ffn", "cds")):
        sinks.write_fasta(called, f"{a.out}/{kind}", G.gene_header(), column, by="strain" if kind == "ffn" else None)
    sinks.write_csv(G.genome_stats(contigs, called), f"{a.out}/gene_stats")
    return 0


def screen(spark, a):
    contigs = fasta.read_genomes(spark, a.genomes)
    proteins = fasta.read_proteins(spark, a.proteins, a.pattern)
    meta = tables.isolate_metadata(tables.read_csv(spark, a.metadata))
    work = f"{a.out}/checkpoints"
    if not a.skip_card:
        card, aro = fasta.read_references(spark, a.card, "CARD"), tables.read_aro(spark, a.aro)
        hits = screening.resumable(proteins, lambda p: screening.card_hits(p, card, aro), work, "card", content(card), content(aro))
        sinks.write_csv(hits, f"{a.out}/amr_genes")
        hit_report(hits).show(truncate=False)
    vfdb = fasta.read_references(spark, a.vfdb, "VFDB")
    hits = screening.resumable(proteins, lambda p: screening.virulence_hits(p, vfdb), work, "vfdb", content(vfdb))
    sinks.write_csv(hits, f"{a.out}/virulence_genes")
    hit_report(hits).show(truncate=False)
    replicons = fasta.read_archive(spark, a.replicons, ".fsa").select(
        F.concat_ws("#", "path", F.lpad(F.col("ord").cast("string"), 12, "0")).alias("ref_id"), F.col("header").alias("label"), "seq")
    hits = screening.resumable(contigs, lambda c: screening.replicon_hits(c, replicons, meta.select("strain", "host_group")),
                               work, "replicons", content(replicons))
    sinks.write_csv(hits, f"{a.out}/plasmid_replicons_all")
    hits.groupBy("replicon").agg(F.count_distinct("strain").alias("n_isolates")).orderBy(F.desc("n_isolates"), "replicon").show(truncate=False)
    return 0


def pan(spark, a):
    out = pangenome.build(fasta.read_proteins(spark, a.proteins, a.pattern))
    sinks.write_table(out.membership, f"{a.out}/gene_to_family")
    sinks.write_csv(out.families, f"{a.out}/gene_families")
    sinks.write_fasta(out.representatives, f"{a.out}/family_representatives", F.concat(F.lit("fam"), F.col("family")))
    strains = wide_names(out.membership.select("strain"))      # gene_to_family is the long form
    if strains is not None:
        sinks.write_csv(presence_matrix(out.membership, strains), f"{a.out}/pan_genome_matrix")
    out.partition.orderBy("rank").show()
    if a.domains:
        annotation, rates, enriched = pangenome.annotate(out.families, spark.read.parquet(a.domains))
        sinks.write_csv(annotation, f"{a.out}/functional_annotation")
        sinks.write_csv(enriched, f"{a.out}/functional_enrichment")
        rates.show()
    return 0


def tree(spark, a):
    families = tables.read_csv(spark, f"{a.out}/gene_families").select(
        "family", F.col("n_genomes").cast("bigint"), F.col("n_proteins").cast("bigint"), "class")
    out = phylogeny.build(fasta.read_proteins(spark, a.proteins, a.pattern), spark.read.parquet(f"{a.out}/gene_to_family"), families)
    sinks.write_supermatrix(out.lines, f"{a.out}/core_supermatrix")
    sinks.write_csv(out.distances, f"{a.out}/core_genome_distance")
    newick.to_newick(shape(out.tree)).write.mode("overwrite").text(f"{a.out}/core_genome_nwk")
    sinks.write_csv(out.stats, f"{a.out}/core_gene_stats")
    return 0


def overlay_stage(spark, a):
    ani = overlay.relatedness(fasta.read_genomes(spark, a.genomes))
    sinks.write_csv(ani, f"{a.out}/ani_pairs")
    names = wide_names(fasta.read_genomes(spark, a.genomes).select("strain"))
    if names is not None:
        sinks.write_csv(to_wide(ani, "ani", 100.0, 0.0, names), f"{a.out}/ani_matrix")
    text = spark.read.text(f"{a.out}/core_genome_nwk", wholetext=True).select(F.lit("core").alias("tree"), F.col("value").alias("newick"))
    result = overlay.build(tables.read_csv(spark, f"{a.out}/amr_genes"), newick.parse_newick(text),
                           tables.isolate_metadata(tables.read_csv(spark, a.metadata)),
                           tables.read_csv(spark, f"{a.out}/plasmid_replicons_all"), a.perms, a.seed)
    sinks.write_csv(result.sharing, f"{a.out}/amr_sharing")
    if result.matrix is not None:
        sinks.write_csv(result.matrix, f"{a.out}/amr_sharing_matrix")
    rounded = result.patterns.withColumns({"changes_expected": F.round("changes_expected", 2), "p_clumped": F.round("p_clumped", 4)})
    sinks.write_csv(rounded, f"{a.out}/amr_inherited_vs_acquired")
    sinks.write_csv(rounded.drop("pattern").orderBy("gene"), f"{a.out}/amr_phylogenetic_signal")
    sinks.write_csv(result.summary, f"{a.out}/onehealth_summary")
    rounded.groupBy("pattern").count().orderBy("pattern").show(truncate=False)
    result.sharing.filter("n_hosts > 1").select("gene", "n_hosts", "acquired").distinct().orderBy(F.desc("n_hosts"), "gene").show(truncate=False)
    return 0


STAGES = {"fetch-report": fetch, "genes": genes, "screen": screen, "pangenome": pan, "phylogeny": tree, "overlay": overlay_stage}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="cladeflow", description=__doc__)
    ap.add_argument("stage", choices=STAGES)
    for name in ("genomes", "proteins", "metadata", "card", "aro", "vfdb", "replicons", "domains"):
        ap.add_argument(f"--{name}")
    ap.add_argument("--pattern", default="*", help="file name pattern of protein files")
    ap.add_argument("--out", default="results")
    ap.add_argument("--skip-card", action="store_true")
    ap.add_argument("--perms", type=int, default=1000)
    ap.add_argument("--seed", type=int, default=42)
    args = ap.parse_args(argv)
    return STAGES[args.stage](SparkSession.builder.appName(f"cladeflow {args.stage}").getOrCreate(), args)


if __name__ == "__main__":
    raise SystemExit(main())
