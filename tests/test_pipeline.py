"""All stages on a small simulated cohort, through files, as a user runs them."""

import random

import pytest

from cladeflow.__main__ import main
from cladeflow.functions.sequence import codon_table
from cladeflow.sources import tables

CODONS = {a: c for c, a in codon_table().items()}


def dna(protein):
    return "".join(CODONS[a] for a in protein) + "TAA"


@pytest.fixture(scope="module")
def cohort(tmp_path_factory):
    """Five strains share six core genes with drift along a ladder; a resistance gene sits in two sister strains."""
    rng = random.Random(21)
    root = tmp_path_factory.mktemp("cohort")
    for d in ("raw", "db"):
        (root / d).mkdir()
    acids = [a for a in "ACDEFGHIKLNPQRSTVWY"]
    core = ["M" + "".join(rng.choice(acids) for _ in range(60)) for _ in range(6)]
    amr = "M" + "".join(rng.choice(acids) for _ in range(80))
    replicon = "".join(rng.choice("ACGT") for _ in range(300))
    genes = core
    for i, s in enumerate("ABCDE"):
        genes = [g[:1] + "".join(rng.choice(acids) if rng.random() < 0.03 else a for a in g[1:]) for g in genes]
        contig = "".join("TAATTAATTAA" + dna(g) for g in genes + ([amr] if s in "AB" else []))
        half = contig + (replicon if s in "AC" else "") + "TTAATTAA"
        (root / "raw" / f"GCA_{s}.fna").write_text(f">c1 {s}\n{half[:700]}\n>c2\n{half[700:]}\n")
    (root / "db" / "card.fasta").write_text(f">gb|X|ARO:3000001|sul1 [x]\n{amr}\n>gb|Y|ARO:3000002|acrB [x]\n{'M' + 'W' * 50}\n")
    (root / "db" / "aro.tsv").write_text("ARO Accession\tDrug Class\tResistance Mechanism\tAMR Gene Family\nARO:3000001\tsulfonamide\tm\tsul\n")
    (root / "db" / "vfdb.fasta").write_text(f">VFG1(gb|WP_1) (v) toxin [T (VF1) - Exotoxin (VFC1)] [o]\n{core[0]}\n")
    import io
    import tarfile
    with tarfile.open(root / "db" / "rep.tar.gz", "w:gz") as t:
        text = f">IncX1_1__A\n{replicon}\n".encode()
        info = tarfile.TarInfo("d/e.fsa")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text))
    (root / "meta.csv").write_text("host_group,geo_loc_name,serovar,asm_acc\n" + "".join(
        f"{'Human' if s in 'AB' else 'Cattle'},USA,NULL,GCA_{s}\n" for s in "ABCDE") + "Human,USA,X,GCA_Z\n")
    return root


def test_stages(spark, cohort):
    out = str(cohort / "results")
    common = ["--genomes", str(cohort / "raw"), "--metadata", str(cohort / "meta.csv"), "--out", out]
    assert main(["fetch-report", *common]) == 2                 # one accession has no file
    assert main(["genes", *common]) == 0
    proteins = ["--proteins", f"{out}/faa", "--pattern", "part-*"]
    db = cohort / "db"
    refs = ["--card", str(db / "card.fasta"), "--aro", str(db / "aro.tsv"), "--vfdb", str(db / "vfdb.fasta"), "--replicons", str(db / "rep.tar.gz")]
    assert main(["screen", *common, *proteins, *refs]) == 0
    hits = {(r.strain, r.gene, r.drug, r.acquired) for r in tables.read_csv(spark, f"{out}/amr_genes").collect()}
    assert hits == {("GCA_A", "sul1", "sulfonamide", "true"), ("GCA_B", "sul1", "sulfonamide", "true")}
    assert {r.category for r in tables.read_csv(spark, f"{out}/virulence_genes").collect()} == {"Exotoxin"}
    reps = {(r.strain, r.replicon, r.host_group) for r in tables.read_csv(spark, f"{out}/plasmid_replicons_all").collect()}
    assert reps == {("GCA_A", "IncX1", "Human"), ("GCA_C", "IncX1", "Cattle")}
    assert main(["pangenome", *common, *proteins]) == 0
    assert main(["phylogeny", *common, *proteins]) == 0
    stats = tables.read_csv(spark, f"{out}/core_gene_stats").first()
    assert int(stats.n_genomes) == 5 and int(stats.families_used_in_tree) >= 5
    assert main(["overlay", *common, "--perms", "50"]) == 0
    pattern = tables.read_csv(spark, f"{out}/amr_inherited_vs_acquired").first()
    assert (pattern.gene, pattern.n_isolates, pattern.n_hosts, pattern.changes_observed) == ("sul1", "2", "1", "1")
    summary = {r.strain: r for r in tables.read_csv(spark, f"{out}/onehealth_summary").collect()}
    assert set(summary) == {"GCA_A", "GCA_B"} and summary["GCA_A"].replicons == "IncX1"
    ani = tables.read_csv(spark, f"{out}/ani_matrix")
    assert len(ani.columns) == ani.count() + 1
