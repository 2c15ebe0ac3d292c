"""Named queries: each operator of the pipeline on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.functions import labels as L
from cladeflow.functions.sequence import portable_hash, wrap
from cladeflow.operators import distance as D
from cladeflow.operators import families as FM
from cladeflow.operators import genomes as G
from cladeflow.operators import homology as H
from cladeflow.operators import presence as P
from cladeflow.operators import stats as S
from cladeflow.operators import tree as T
from cladeflow.operators.common import checkpoint, shared_folder
from cladeflow.operators.msa import profile_alignment
from cladeflow.params import DOMAIN_MAX_EVALUE, MIN_PROTEIN_AA, REPLICON_SCREEN, SKETCH_K
from cladeflow.plans import pangenome
from cladeflow.plans.phylogeny import all_pairs
from cladeflow.sources import fasta, newick, sinks, tables
from cladeflow.streaming import resume
from cladeflow.views import Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SCALED = 100


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# ---- homology ------------------------------------------------------------------------------

@query
def benchmark_containment(v: Views) -> DataFrame:
    pairs = H.containment_pairs(v.queries(), v.references(), 12, 0.30)
    return pairs.select("query_id", "ref_id", "shared", "n_ref", r6("containment"))


@query
def kmer_prefilter(v: Views) -> DataFrame:
    pairs = H.containment_pairs(v.queries(), v.references(), 10, 0.20, hot_references=20)
    return pairs.select("query_id", "ref_id", "shared", "n_ref", r6("containment"))


@query
def topk_candidates(v: Views) -> DataFrame:
    pairs = H.seed_pairs(v.queries(), v.references(), 12, 0.0)
    return H.top_candidates(pairs).select("query_id", "ref_id", "shared", "rank")


@query
def best_hit(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("replicon"))
    hits = (v.table("lineitem").select(
        "l_partkey", v._strain().alias("strain"), (F.col("l_quantity") / 50).alias("identity"),
        (1 - F.col("l_discount")).alias("coverage"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ref_id"))
        .filter("identity >= 0.90 AND coverage >= 0.60").join(part, "l_partkey").drop("l_partkey"))
    return H.best_hit(hits, ["strain", "replicon"], "ref_id").select(
        "strain", "replicon", "ref_id", r6("identity"), r6("coverage"))


@query
def screen_hits(v: Views) -> DataFrame:
    return H.screen(v.queries(), v.references(), REPLICON_SCREEN)


@query
def genome_screen(v: Views) -> DataFrame:
    """Genomes (the documents of a language and source, in order of id) against the references, both as nucleotides."""
    order = Window.partitionBy("strain").orderBy(F.col("contig").cast("bigint"))
    contigs = v.contigs().withColumn("contig_ord", F.row_number().over(order).cast("bigint"))
    hits = H.screen_genomes(contigs, v.nucleotides(v.references()), REPLICON_SCREEN)
    return hits.select(F.col("query_id").alias("strain"), "ref_id", "shared", "score", "identity_pct", "coverage_pct")


@query
def family_alignment(v: Views) -> DataFrame:
    """Names and types of the parts of a brand, aligned: each row without its gaps, and whether all is as it must be."""
    names = v.table("part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("strain"), F.regexp_replace(F.concat_ws(" ", "p_name", "p_type"), "-", "").alias("seq"))
    rows = profile_alignment(names)
    width = Window.partitionBy("family")
    n = F.length("aligned")
    return rows.select("family", "strain", F.regexp_replace("aligned", "-", "").alias("residues"),
                       (F.min(n).over(width) == F.max(n).over(width)).alias("equal_width"), (F.col("score") >= F.col("star_score")).alias("not_under_star"))


@query
def clusters(v: Views) -> DataFrame:
    proteins = v.turns().select(F.col("query_id").alias("gene_key"), "seq")
    return FM.cluster(proteins).select("gene_key", "family")


# ---- genomes and genes ---------------------------------------------------------------------

@query
def orf_calls(v: Views) -> DataFrame:
    genes = G.call_orfs(v.contigs())
    return genes.select("strain", "contig", F.col("begin").cast("bigint").alias("begin"), F.col("end").cast("bigint").alias("end_pos"),
                        "strand", F.col("length_nt").cast("bigint").alias("length_nt"),
                        F.col("length_aa").cast("bigint").alias("length_aa"), F.md5("protein").alias("protein"),
                        F.md5("cds").alias("cds"))


@query
def genome_stats(v: Views) -> DataFrame:
    contigs = v.contigs("source")
    return G.genome_stats(contigs, G.call_orfs(contigs, texts=False))


@query
def cohort_stats(v: Views) -> DataFrame:
    contigs = v.contigs("source")
    out = G.cohort_stats(G.genome_stats(contigs, G.call_orfs(contigs, texts=False)))
    return out.select("n_genomes", r6("mean_genes"), r6("mean_coding_density"), "total_genes")


@query
def gene_summary(v: Views) -> DataFrame:
    contigs = v.contigs("source")
    genes = checkpoint(G.call_orfs(contigs, texts=False).select("strain", "length_nt", "length_aa"))    # read by both tables
    return G.gene_summary(G.genome_stats(contigs, genes), genes)


@query
def gene_fasta(v: Views) -> DataFrame:
    text = wrap(F.col("text"), 60)
    return v.table("documents").select(
        F.concat_ws("|", "source", F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("header"),
        F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"), F.md5(text).alias("body"))


# ---- distances -----------------------------------------------------------------------------

def _sketch(v: Views, strain: str | None = None) -> tuple[DataFrame, DataFrame]:
    contigs = v.contigs(strain) if strain else v.contigs()
    return D.sketch(contigs, SKETCH_K, SCALED, portable=True), contigs.select("strain")


@query
def minhash_sketch(v: Views) -> DataFrame:
    return _sketch(v)[0].groupBy("strain").agg(F.count("*").alias("n_hashes"), F.min("hash").alias("low"), F.max("hash").alias("high"))


@query
def whole_genome_sketch(v: Views) -> DataFrame:
    """Contigs taken as concatenated, at the default scale."""
    contigs = v.contigs("source").withColumn("contig_ord", F.col("contig").cast("bigint"))
    return D.sketch(contigs, join_contigs=True, portable=True).groupBy("strain").agg(
        F.count("*").alias("n_hashes"), F.min("hash").alias("low"), F.max("hash").alias("high"))


@query
def minhash_ani(v: Views) -> DataFrame:
    return D.ani_pairs(*_sketch(v)).select("a", "b", "shared", "n_a", "n_b", r6("jaccard"), r6("ani"))


@query
def ani_by_host(v: Views) -> DataFrame:
    out = P.means_by_host(D.ani_pairs(*_sketch(v)), v.contig_hosts(), "ani")
    return out.select("host", "n_pairs", r6("mean"), r6("low"), r6("high"))


@query
def ani_range(v: Views) -> DataFrame:
    return D.ani_pairs(*_sketch(v)).agg(
        F.count("*").alias("n_pairs"), F.round(F.min("ani"), 6).alias("low"), F.round(F.max("ani"), 6).alias("high"),
        F.count_if(F.col("ani") >= 95).alias("n_same_species"))


@query
def ani_matrix(v: Views) -> DataFrame:
    sketches, strains = _sketch(v, "source")
    pairs = D.ani_pairs(sketches, strains)
    both = pairs.select("a", "b", "ani").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "ani"))
    same = v.contigs("source").select(F.col("strain").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(100.0).alias("ani"))
    return both.unionByName(same).select("a", "b", F.round("ani", 4).alias("ani"))


@query
def pairwise_jaccard(v: Views) -> DataFrame:
    docs = v.table("documents").select("source", F.col("text").alias("seq"))
    pairs = D.pair_sets(D.shared_kmers(docs, "source", 12, docs.select("source")))
    return pairs.select("a", "b", "shared", "n_a", "n_b", r6("jaccard"))


@query
def site_patterns(v: Views) -> DataFrame:
    return D.site_patterns(v.sites("r_name"))


@query
def supermatrix(v: Views) -> DataFrame:
    blocks = v.blocks()
    full = FM.complete_families(blocks, v.table("region").count())
    alignment, _ = D.place_blocks(full)
    return D.supermatrix_lines(alignment).select("taxon", "line", "text")


def _nation_distances(v: Views) -> DataFrame:
    return D.p_distance(v.sites(), v.table("nation").select("n_name"))


def _nation_matrix(v: Views) -> DataFrame:
    """The full matrix a tree needs: nations without a common site are at distance 1."""
    shared = checkpoint(_nation_distances(v))
    return all_pairs(shared, v.sites().select(F.col("taxon").alias("name")).distinct())


@query
def p_distance(v: Views) -> DataFrame:
    return _nation_distances(v).select("a", "b", "compared", "equal", r6("distance"))


@query
def nj_edges(v: Views) -> DataFrame:
    return T.neighbor_joining(_nation_matrix(v)).select("node", "parent", r6("length"))


# ---- families ------------------------------------------------------------------------------

@query
def family_stats(v: Views) -> DataFrame:
    return FM.family_stats(v.tokens())


@query
def class_partition(v: Views) -> DataFrame:
    return FM.class_partition(FM.family_stats(v.tokens())).select(
        F.col("rank").cast("bigint").alias("rank"), "class", "n_families", r6("share"))


@query
def presence_matrix(v: Views) -> DataFrame:
    """Every cell of the matrix of families and sources: the text ``source=1`` where the family occurs, ``source=0`` where not.

    Sources without any family count too. The last letter is the cell; of a source that is NULL it is the whole text.
    """
    cells = FM.presence_cells(v.tokens(), v.table("documents").select(F.col("source").alias("strain")))
    return cells.select("family", F.concat_ws("=", "strain", F.col("present").cast("string")).alias("strain"))


@query
def presence_cells(v: Views) -> DataFrame:
    """The cells as numbers: a row for every family and every strain that has one."""
    return FM.presence_cells(v.tokens())


@query
def family_representative(v: Views) -> DataFrame:
    members = v.table("documents").select(F.col("source").alias("family"), F.col("doc_id").alias("gene_key"),
                                          F.col("doc_id").alias("ord"), F.col("text").alias("seq"))
    return FM.representatives(members).select("family", "gene_key", F.col("length_aa").cast("bigint").alias("length_aa"))


@query
def single_copy_core(v: Views) -> DataFrame:
    n = v.event_genes().agg(F.count_distinct("strain")).scalar()
    return FM.core_families(FM.family_stats(v.event_genes()), n).select("family", "n_genomes", "n_proteins", "single_copy")


@query
def core_gene_stats(v: Views) -> DataFrame:
    return FM.family_stats(v.event_genes()).agg(
        F.count("*").alias("n_families"), F.max("n_genomes").alias("n_genomes"),
        F.count_if(F.col("class") == "core").alias("core_families"),
        F.count_if((F.col("class") == "core") & (F.col("n_proteins") == F.col("n_genomes"))).alias("single_copy_families"))


@query
def core_sequences(v: Views) -> DataFrame:
    members = v.table("lineitem").select(
        F.col("l_partkey").alias("family"), F.col("l_returnflag").alias("strain"),
        F.col("l_suppkey").cast("string").alias("seq"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    n = v.table("lineitem").select("l_returnflag").distinct().count()
    return FM.complete_families(FM.family_sequences(members), n).select("family", "strain", "seq")


@query
def annotation_rate(v: Views) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    domains = v.table("benchmark").select(F.explode(words).alias("family"))
    return FM.annotation_rate(FM.family_stats(v.tokens()), domains).select("class", "n_families", "n_annotated", r6("rate"))


@query
def functional_annotation(v: Views) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    hits = v.table("benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("pfam"), F.posexplode(words).alias("ord", "family"))
    hits = hits.select("family", "pfam", F.upper("family").alias("description"), "ord", (F.col("ord") * 1e-7).alias("i_evalue"),
                       F.length("family").alias("score"), F.lit(True).alias("included"))
    annotation, _, _ = pangenome.annotate(FM.family_stats(v.tokens()), hits)
    return annotation.select("family", "pfam", "description", F.round("i_evalue", 8).alias("i_evalue"), F.col("score").cast("bigint").alias("score"), "class")


@query
def best_domain(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("pfam"), F.col("p_name").alias("description"))
    hits = v.table("lineitem").join(part, "l_partkey").select(
        F.col("l_suppkey").alias("family"), "pfam", "description", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        (F.col("l_tax") / 4000).alias("i_evalue"), F.col("l_quantity").alias("score"), (F.col("l_linestatus") == "O").alias("included"))
    return FM.best_domain(hits, DOMAIN_MAX_EVALUE).select("family", "pfam", "description", F.round("i_evalue", 8).alias("i_evalue"), "score")


# ---- statistics ----------------------------------------------------------------------------

@query
def enrichment_counts(v: Views) -> DataFrame:
    return S.domain_counts(*v.labelled()).select("pfam", "description", "n_accessory", "b", "n_core", "d")


@query
def fisher_enrichment(v: Views) -> DataFrame:
    return S.domain_enrichment(*v.labelled()).select(
        "pfam", "description", "n_accessory", "n_core", r6("odds_ratio"), r6("p_value"), r6("q_value"))


@query
def fisher_quality(v: Views) -> DataFrame:
    """The same with good documents as the variable class: words of the others are depleted."""
    return S.domain_enrichment(*v.labelled("quality")).select(
        "pfam", "description", "n_accessory", "n_core", r6("odds_ratio"), r6("p_value"), r6("q_value"))


@query
def bh_fdr(v: Views) -> DataFrame:
    p = F.round(F.pow(portable_hash(F.col("o_orderkey").cast("string")) / F.lit(2.0 ** 60), F.lit(3)), 5)
    tests = v.table("orders").select("o_orderkey", p.alias("p_value"))
    return S.benjamini_hochberg(tests).select("o_orderkey", "p_value", r6("q_value"), (F.col("q_value") < 0.05).alias("significant"))


# ---- presence over isolates ----------------------------------------------------------------

@query
def gene_carriers(v: Views) -> DataFrame:
    return P.gene_totals(v.presence(), v.hosts()).select("gene", "n_isolates", "n_hosts", "acquired")


@query
def sharing_matrix(v: Views) -> DataFrame:
    groups = [r.r_name for r in v.table("region").select("r_name").distinct().orderBy("r_name").collect()]
    return P.sharing_matrix(v.presence(), v.hosts(), groups)


@query
def isolate_summary(v: Views) -> DataFrame:
    return P.isolate_summary(v.presence(), v.metadata(), v.replicons())


@query
def hit_report(v: Views) -> DataFrame:
    genes = v._lines("true").select(
        F.col("p_type").alias("database"), F.col("p_brand").alias("gene"), v._strain().alias("strain"))
    return P.hit_report(genes)


@query
def top_genes(v: Views) -> DataFrame:
    return P.widespread(v.presence())


@query
def cooccurrence(v: Views) -> DataFrame:
    return P.cooccurrence(v.presence(), v.replicons())


# ---- tree ----------------------------------------------------------------------------------

def _tips(v: Views) -> DataFrame:
    return v.presence().select("gene", F.col("strain").alias("tip"))


@query
def tree_shape(v: Views) -> DataFrame:
    return T.shape(v.tree_edges()).nodes.select("node", "parent", F.col("n_children").cast("bigint").alias("n_children"),
                                                F.col("depth").cast("bigint").alias("depth"), "is_tip")


@query
def fitch_score(v: Views) -> DataFrame:
    scores = T.fitch_changes(T.shape(v.tree_edges()), _tips(v), ["gene"])
    return scores.select("gene", F.col("changes").cast("bigint").alias("changes"))


@query
def permutation_null(v: Views) -> DataFrame:
    tests = T.clumping_test(T.shape(v.tree_edges()), _tips(v))
    return tests.select("gene", "n_tips", F.col("changes_observed").cast("bigint").alias("changes_observed"),
                        F.round("changes_expected", 4).alias("changes_expected"), r6("p_clumped"))


@query
def exact_null(v: Views) -> DataFrame:
    return T.exact_null(T.shape(v.tree_edges())).select(
        F.col("k").cast("bigint").alias("k"), F.col("changes").cast("bigint").alias("changes"), r6("log_share"))


@query
def exact_test(v: Views) -> DataFrame:
    tests = T.exact_test(T.shape(v.tree_edges()), _tips(v))
    return tests.select("gene", "n_tips", F.col("changes_observed").cast("bigint").alias("changes_observed"), r6("changes_expected"), r6("p_clumped"))


def patterns(v: Views) -> DataFrame:
    tree = T.shape(v.tree_edges())
    T.check_overlap(tree, v.presence())
    return P.call_patterns(T.clumping_test(tree, _tips(v)), P.gene_totals(v.presence(), v.hosts()))


@query
def pattern_call(v: Views) -> DataFrame:
    return patterns(v).select(
        "gene", "acquired", "n_isolates", "n_hosts", F.col("changes_observed").cast("bigint").alias("changes_observed"),
        F.round("changes_expected", 2).alias("changes_expected"), F.round("p_clumped", 4).alias("p_clumped"), "pattern"
    ).orderBy(F.asc_nulls_last("p_clumped"), "gene")


@query
def pattern_counts(v: Views) -> DataFrame:
    return patterns(v).groupBy("pattern").agg(F.count("*").alias("n_genes"))


@query
def newick_roundtrip(v: Views) -> DataFrame:
    text = newick.to_newick(T.shape(v.tree_edges()))
    nodes = newick.parse_newick(text.select(F.lit("t").alias("tree"), "newick"))
    tree = T.shape(nodes.select("node", "parent", "length"))
    return T.clades(tree).select("n_tips", "clade").distinct()


@query
def midpoint_rooted(v: Views) -> DataFrame:
    nj = T.shape(T.neighbor_joining(_nation_matrix(v)))
    return T.midpoint_root(nj).select("node", "parent", r6("length"))


# ---- identifiers, inputs, incremental runs -------------------------------------------------

@query
def parse_identifiers(v: Views) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    part = v.table("part").select(
        "p_partkey",
        F.concat("p_type", F.lit("("), "p_brand", F.lit(")_"), size, F.lit("__AC"), key).alias("replicon_header"),
        F.concat(F.lit("gb|AC"), key, F.lit("|ARO:3"), key, F.lit("|"), "p_name", F.lit(" [x]")).alias("card_header"),
        F.concat(F.lit("VFG"), key, F.lit("(gb|WP_"), key, F.lit(") ("), "p_name", F.lit(") "), "p_type", F.lit(" ["), "p_brand",
                 F.lit(" (VF"), size, F.lit(") - "), "p_type", F.lit(" (VFC"), size, F.lit(")] [y]")).alias("vfdb_header"))
    c = F.col
    return part.select(
        "p_partkey", L.replicon_name(c("replicon_header")).alias("replicon"), L.card_gene(c("card_header")).alias("gene"),
        L.aro_accession(c("card_header")).alias("aro"), L.vfdb_gene(c("vfdb_header")).alias("vf_gene"),
        L.vfdb_product(c("vfdb_header")).alias("product"), L.vfdb_category(c("vfdb_header")).alias("category"),
        L.strain_of(c("card_header")).alias("strain"), L.canonical_key(c("vfdb_header")).alias("canonical"))


@query
def marker_flag(v: Views) -> DataFrame:
    return v.tokens().select(F.col("family").alias("gene")).distinct().withColumn("acquired", L.is_acquired(F.col("gene")))


@query
def isolate_metadata(v: Views) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (F.when(F.col("o_orderstatus") == "F", F.substring(day, 1, 4)).when(F.col("o_orderstatus") == "P", F.substring(day, 1, 7))
            .when(F.col("o_totalprice") > 1000, day))
    raw = v.table("orders").select(F.col("o_orderkey").cast("string").alias("asm_acc"), F.col("o_orderpriority").alias("host_group"),
                                   text.alias("collection_date"))
    return tables.isolate_metadata(raw).select("strain", "host_group", "collection_date", F.col("year").cast("bigint").alias("year"), "date_precision")


def _files(v: Views) -> tuple[DataFrame, DataFrame]:
    wanted = v.table("part").select(F.col("p_partkey").cast("string").alias("accession"))
    files = v.table("lineitem").groupBy(F.col("l_partkey").cast("string").alias("accession")).agg(
        F.sum("l_quantity").cast("bigint").alias("size_bytes"), F.count("*").alias("n_contigs"))
    return wanted, files


@query
def fetch_report(v: Views) -> DataFrame:
    return tables.fetch_report(*_files(v))


@query
def fetch_totals(v: Views) -> DataFrame:
    return tables.fetch_totals(tables.fetch_report(*_files(v)))


def _written_to(v: Views, name: str) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@query
def proteins_roundtrip(v: Views) -> DataFrame:
    """Documents as proteins, written as wrapped FASTA by language and read back; the shortest are left out."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
    genes = v.table("documents").select("lang", F.concat_ws("|", "lang", F.concat(F.lit("gene"), F.col("doc_id").cast("string"))).alias("key"), letters.alias("seq"))
    path = _written_to(v, "proteins")
    sinks.write_fasta(genes, path, F.col("key"), by="lang", width=60)
    back = fasta.read_proteins(v.spark, path, "part-*").filter(F.length("seq") >= MIN_PROTEIN_AA)
    return back.select("gene_key", "strain", F.length("seq").cast("bigint").alias("length_aa"), F.md5("seq").alias("protein"))


@query
def metadata_roundtrip(v: Views) -> DataFrame:
    """Isolate metadata written as CSV with NULL tokens and an accession column of an unknown name, and read back."""
    accession = F.concat(F.lit(" GCA_"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(".1 "))
    rows = v.table("customer").select(
        F.col("c_name").alias("label"), accession.alias("where_from"),
        F.when(F.col("c_acctbal") < 0, "NULL").otherwise(F.col("c_mktsegment")).alias("host_group"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).alias("country"))
    path = _written_to(v, "metadata")
    sinks.write_csv(rows, path)
    raw = tables.read_csv(v.spark, path)
    known = tables.accessions(raw)
    return tables.isolate_metadata(raw).join(known, F.col("strain") == F.col("accession"), "left_semi").select("strain", "host_group", "country", "year")


@query
def aro_annotation(v: Views) -> DataFrame:
    """Resistance hits annotated by accession from a tab-separated index of every second one; the others stay empty."""
    key = F.col("p_partkey").cast("string")
    index = v.table("part").filter("p_size % 2 = 0").select(
        F.concat(F.lit("ARO:3"), key).alias("ARO Accession"), F.col("p_brand").alias("Drug Class"),
        F.col("p_type").alias("Resistance Mechanism"), F.col("p_name").alias("AMR Gene Family"))
    path = _written_to(v, "aro")
    sinks.write_csv(index, path, sep="\t")
    header = F.concat(F.lit("gb|AC"), key, F.lit("|ARO:3"), key, F.lit("|"), "p_name", F.lit(" [x]"))
    hits = v.table("part").select("p_partkey", header.alias("query")).withColumn("aro", L.aro_accession(F.col("query")))
    return hits.join(tables.read_aro(v.spark, path), "aro", "left").select(
        "p_partkey", "aro", L.card_gene(F.col("query")).alias("gene"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("drug", "mech", "family")])


@query
def supermatrix_roundtrip(v: Views) -> DataFrame:
    """The concatenated alignment written line by line and read back, one sequence for each taxon."""
    alignment, _ = D.place_blocks(FM.complete_families(v.blocks(), v.table("region").count()))
    path = _written_to(v, "supermatrix")
    sinks.write_supermatrix(D.supermatrix_lines(alignment), path)
    return fasta.read_fasta(v.spark, path, in_parts=True).select(F.col("header").alias("taxon"), F.length("seq").cast("bigint").alias("width"), F.md5("seq").alias("residues"))


@query
def resume_todo(v: Views) -> DataFrame:
    done = v.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return resume.todo(v.table("customer").select("c_custkey", "c_name"), done, "c_custkey")


@query
def resume_reused(v: Views) -> DataFrame:
    done = v.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return resume.reused(v.table("customer").select("c_custkey", "c_name"), done, "c_custkey")
