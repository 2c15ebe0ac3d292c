"""Labels, statistics, family tables, summaries, readers, writers, incremental runs."""

import gzip
import io
import math
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cladeflow.functions import labels as L
from cladeflow.operators import families as FM
from cladeflow.operators import presence as P
from cladeflow.operators import stats as S
from cladeflow.sources import fasta, sinks, tables
from cladeflow.streaming import resume


def test_labels(spark):
    def one(col):
        return spark.range(1).select(col.alias("x")).first().x

    assert one(L.replicon_name(F.lit("IncC_1__JN157804"))) == "IncC"
    assert one(L.replicon_name(F.lit("ColpEC648__CP008718"))) == "ColpEC648__CP008718"
    card = "gb|ACT97415.1|ARO:3002999|CblA-1 [mixed culture]"
    assert one(L.card_gene(F.lit(card))) == "CblA-1" and one(L.aro_accession(F.lit(card))) == "ARO:3002999"
    assert one(L.card_gene(F.lit("plain header"))) == "plain" and one(L.aro_accession(F.lit("x"))) is None
    vf = "VFG037176(gb|WP_001081735) (plc1) phospholipase C [Phospholipase C (VF0470) - Exotoxin (VFC0235)] [organism]"
    assert one(L.vfdb_gene(F.lit(vf))) == "gb|WP_001081735"
    assert one(L.vfdb_product(F.lit(vf))) == "(plc1) phospholipase C" and one(L.vfdb_category(F.lit(vf))) == "Exotoxin"
    assert one(L.vfdb_gene(F.lit("VFG1 x [y]"))) == "VFG1" and one(L.vfdb_product(F.lit("VFG1 x [y]"))) == ""
    assert one(L.vfdb_category(F.lit("VFG1 x [y]"))) == ""
    for gene, acquired in (("Ecol_acrA", False), ("CRP", False), ("MCR-9.1", False), ("AAC(6')-Iaa", False), ("FosA7", True)):
        assert one(L.is_acquired(F.lit(gene))) is acquired
    for n, present, cls in ((18, 16, "accessory"), (18, 17, "accessory"), (18, 18, "core"), (20, 19, "soft-core"), (1, 1, "core"), (9, 1, "unique")):
        assert one(L.classify_family(F.lit(n), F.lit(present))) == cls
    assert one(L.classify_pattern(F.lit(3), F.lit(0.05))) == L.PATTERN_SCATTER
    assert one(L.strain_of(F.lit("s|c|1-2|+|g1"))) == "s" and one(L.canonical_key(F.lit("GCA 1"))) == "GCA_1"


def test_fisher_and_bh(spark):
    rng = random.Random(2)
    rows = [(i, *(rng.randint(0, 40) for _ in range(4))) for i in range(60)] + [(60, 3, 0, 0, 5), (61, 0, 0, 0, 0), (62, 0, 5, 4, 2), (63, 4000, 1000, 3000, 9000)]
    df = spark.createDataFrame(rows, "id int, a bigint, b bigint, c bigint, d bigint")
    got = S.fisher_greater(df, "a", "b", "c", "d").withColumn("o", S.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()
    for r in got:
        n = r.a + r.b + r.c + r.d
        whole = math.comb(n, r.a + r.b)
        p = sum(math.comb(r.a + r.c, i) * math.comb(r.b + r.d, r.a + r.b - i) for i in range(r.a, min(r.a + r.b, r.a + r.c) + 1)) / whole
        assert r.p_value == pytest.approx(p, rel=1e-9, abs=1e-300)
        want = None if r.b * r.c == 0 and r.a * r.d == 0 else 1e9 if r.b * r.c == 0 else r.a * r.d / (r.b * r.c)
        assert r.o == want or r.o == pytest.approx(want)
    ps = [round(rng.random() ** 3, 2) for _ in range(200)]
    tests = spark.createDataFrame(list(enumerate(ps)), "id int, p_value double")
    q = {r.id: r.q_value for r in S.benjamini_hochberg(tests).collect()}
    order = sorted(range(200), key=lambda i: ps[i])
    least, want = 1.0, {}
    for rank in range(200, 0, -1):
        i = order[rank - 1]
        least = min(least, ps[i] * 200 / rank)
        want[i] = least
    assert all(q[i] == pytest.approx(want[i]) for i in want)
    assert S.significant(S.benjamini_hochberg(tests)).count() == sum(v < 0.05 for v in want.values())


def test_enrichment(spark):
    fams = spark.createDataFrame([(i, "accessory" if i < 6 else "core") for i in range(12)], "family int, class string")
    doms = spark.createDataFrame([(i, "P1", "b") for i in range(6)] + [(0, "P1", "a"), (0, "P2", "c"), (7, "P2", "c"), (99, "P3", "d")],
                                 "family int, pfam string, description string")
    got = {r.pfam: r for r in S.domain_enrichment(doms, fams).collect()}
    assert set(got) == {"P1", "P2"} and got["P1"].odds_ratio == 1e9 and got["P1"].n_accessory == 6
    assert got["P1"].description == "a" and got["P1"].p_value == pytest.approx(1 / math.comb(12, 6))


def test_families(spark):
    rows = [("f1", "s1"), ("f1", "s1"), ("f1", "s2"), ("f2", "s1"), ("f3", "s1"), ("f3", "s2")]
    fam = FM.family_stats(spark.createDataFrame(rows, "family string, strain string"))
    assert {(r.family, r.n_genomes, r.n_proteins, r["class"]) for r in fam.collect()} == {
        ("f1", 2, 3, "core"), ("f2", 1, 1, "unique"), ("f3", 2, 2, "core")}
    parts = {r["class"]: (r.n_families, r.share) for r in FM.class_partition(fam).collect()}
    assert parts["soft-core"] == (0, 0.0) and parts["core"][0] == 2 and sum(n for n, _ in parts.values()) == 3
    assert {r.family: r.single_copy for r in FM.core_families(fam, 2).collect()} == {"f1": False, "f3": True}
    members = spark.createDataFrame([("f", "a", "MKK", 2), ("f", "b", "MKA", 1), ("f", "c", "M", 0)], "family string, gene_key string, seq string, ord int")
    assert FM.representatives(members).first().gene_key == "b"
    seqs = FM.family_sequences(spark.createDataFrame([("f", "s", "A", 1), ("f", "s", "B", 2)], "family string, strain string, seq string, ord int"))
    assert seqs.first().seq == "B" and FM.complete_families(seqs, 2).count() == 0


def test_summary_keeps_only_isolates_with_hits(spark):
    presence = spark.createDataFrame([("acrB", "x"), ("CRP", "x"), ("sul1", "x"), ("sul1", "y")], "gene string, strain string")
    meta = spark.createDataFrame([("x", "Human", None, "USA"), ("z", "Cattle", "A", "B")], "strain string, host_group string, serovar string, country string")
    reps = spark.createDataFrame([("x", "IncX1"), ("x", "IncC"), ("x", "IncX1")], "strain string, replicon string")
    got = {r.strain: r for r in P.isolate_summary(presence, meta, reps).collect()}
    assert set(got) == {"x", "y"} and got["x"].genes == "CRP, acrB, sul1" and got["x"].replicons == "IncC, IncX1"
    assert (got["x"].n_amr, got["x"].n_acquired, got["x"].serovar, got["y"].host_group) == (3, 1, None, None)
    totals = {r.gene: r for r in P.gene_totals(presence, meta.select("strain", "host_group")).collect()}
    assert (totals["sul1"].n_isolates, totals["sul1"].n_hosts) == (2, 1)
    assert [r.gene for r in P.widespread(presence, 1).collect()] == ["sul1"]


FASTA = "junk line\n>s1 first -> arrow\nacgt\n  ACG \r\n>empty\n>s2\nNNAA\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "g.1.fna").write_text(FASTA)
    (tmp_path / "h.fna").write_text(">c1 x\nAC\n\n>c2\nGT")
    rows = {(r.strain, r.contig): (r.contig_ord, r.seq) for r in fasta.read_genomes(spark, str(tmp_path)).collect()}
    assert rows == {("g.1", "s1"): (1, "ACGTACG"), ("g.1", "empty"): (2, ""), ("g.1", "s2"): (3, "NNAA"), ("h", "c1"): (0, "AC"), ("h", "c2"): (1, "GT")}
    assert {r.header for r in fasta.read_fasta(spark, str(tmp_path)).collect()} == {"s1 first -> arrow", "s2", "c1 x", "c2"}
    refs = fasta.read_references(spark, str(tmp_path / "h.fna"), "VFDB").orderBy("ref_id").collect()
    assert [r.label for r in refs] == ["c1 x", "c2"] and refs[0].db == "VFDB"
    with gzip.open(tmp_path / "z.fas.gz", "wt") as f:
        f.write(">p\nMK\n")
    assert fasta.read_fasta(spark, str(tmp_path / "z.fas.gz")).first().seq == "MK"


def test_large_fasta_is_numbered_across_splits(spark, tmp_path):
    with open(tmp_path / "big.fna", "w") as f:
        for i in range(3000):
            f.write(f">r{i}\n{'ACGT' * 30}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = fasta.read_fasta(spark, str(tmp_path), "big.fna").select("ord", "header").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.ord: r.header for r in got} == {i: f"r{i}" for i in range(3000)}


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "db.tar.gz", "w:gz") as t:
        for name, text in (("a/x.fsa", ">IncC_1__A\nAC\n"), ("a/readme.txt", ">no\nAA\n"), ("a/y.fsa", "note\n>Col__B\nGG\n>C\n\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    got = fasta.read_archive(spark, str(tmp_path / "db.tar.gz"), ".fsa").select(L.replicon_name(F.col("header")).alias("n"), "seq").collect()
    assert {(r.n, r.seq) for r in got} == {("IncC", "AC"), ("Col__B", "GG")}
    with zipfile.ZipFile(tmp_path / "asm.zip", "w") as z:
        z.writestr("d/1.fna", ">a\nA\n")
        z.writestr("d/2.fna", ">b\nC\n")
    assert [r.header for r in fasta.read_archive(spark, str(tmp_path / "asm.zip"), ".fna", True).collect()] == ["a"]


def test_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("host_group,geo_loc_name,collection_date,serovar,asm_acc\nHuman,NULL,1988,Agona,GCA_1.1\n"
                                    "Cattle,USA,2010-10,NULL, GCA_2.1\nPoultry,USA,NULL,X,\nPoultry,USA,2003-07-25,X,GCA_4.1\n")
    raw = tables.read_csv(spark, str(tmp_path / "m.csv"))
    got = {r.strain: r for r in tables.isolate_metadata(raw).collect()}
    assert (got["GCA_1.1"].country, got["GCA_1.1"].year, got["GCA_1.1"].date_precision) == (None, 1988, "year")
    assert (got["GCA_2.1"].serovar, got["GCA_2.1"].date_precision, got["GCA_4.1"].date_precision) == (None, "month", "day")
    assert tables.accessions(raw).count() == 3
    other = spark.createDataFrame([("x", None), ("y", "GCF_000001.2")], "k string, v string")
    assert tables.accession_column(other) == "v"
    with pytest.raises(ValueError):
        tables.accession_column(other.select("k"))
    (tmp_path / "aro.tsv").write_text("ARO Accession\tDrug Class\tResistance Mechanism\tAMR Gene Family\nARO:1\td\tm\tf\nARO:2\td\n")
    aro = {r.aro: r for r in tables.read_aro(spark, str(tmp_path / "aro.tsv")).collect()}
    assert aro["ARO:1"].family == "f" and aro.get("ARO:2") is None
    (tmp_path / "bad.tsv").write_text("ARO Accession\tx\nARO:1\ty\n")
    assert tables.read_aro(spark, str(tmp_path / "bad.tsv")).count() == 0
    assert tables.complete(other, ("v", "new")).columns == ["v", "new"]


def test_reports_and_sinks(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    (src / "GCA_1.1.fna").write_text(">a\nAC\n>b\nGT\n")
    wanted = spark.createDataFrame([("GCA_1.1",), ("GCA_2.1",)], "accession string")
    report = tables.fetch_report(wanted, tables.genome_files(spark, str(src)))
    got = {r.accession: (r.status, r.n_contigs) for r in report.collect()}
    assert got == {"GCA_1.1": ("cached", 2), "GCA_2.1": ("missing", None)}
    totals = tables.fetch_totals(report).first()
    assert (totals.n_available, totals.total_bytes) == (1, 12)
    df = spark.createDataFrame([("s", "g1", "M" * 70)], "strain string, gene string, seq string")
    sinks.write_fasta(df, str(tmp_path / "faa"), F.concat_ws("|", "strain", "gene"), width=60)
    back = fasta.read_fasta(spark, str(tmp_path / "faa"), "*.txt").first()
    assert (back.header, back.seq) == ("s|g1", "M" * 70)
    sinks.write_csv(report, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).count() == 2
    lines = spark.createDataFrame([("a", 0, "AC"), ("a", 1, "G"), ("b", 0, "AA"), ("b", 1, "C")], "taxon string, line bigint, text string")
    sinks.write_supermatrix(lines, str(tmp_path / "sm"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "sm").glob("part-*")))
    assert text == ">a\nAC\nG\n>b\nAA\nC\n"
    sinks.write_table(df, str(tmp_path / "t"), by="strain")
    assert (tmp_path / "t" / "strain=s").exists()


def test_incremental_run_reuses_finished_isolates(spark, tmp_path):
    seen = []

    def work(df):
        seen.append(sorted(r.strain for r in df.collect()))
        return df.filter("v > 0").select("strain", (F.col("v") * 2).alias("w"))

    first = spark.createDataFrame([("a", 1), ("b", 0)], "strain string, v int")
    more = first.union(spark.createDataFrame([("c", 3)], "strain string, v int"))
    root = str(tmp_path / "run")
    assert resume.run_incremental(first, "strain", work, root, 0.9).count() == 1
    assert {(r.strain, r.w) for r in resume.run_incremental(more, "strain", work, root, 0.9).collect()} == {("a", 2), ("c", 6)}
    assert seen == [["a", "b"], ["c"]]
    resume.run_incremental(first, "strain", work, root, 0.8)     # other thresholds start afresh
    assert seen[-1] == ["a", "b"]


def test_fisher_of_depleted_and_large_tables(spark):
    rng = random.Random(5)
    rows = [(0, 600, 600, 0), (50, 4000, 4000, 50), (200, 3000, 3000, 2000), (10, 2000, 1500, 100), (0, 0, 7, 9), (5, 0, 0, 0)]
    rows += [tuple(rng.randint(0, 10 ** rng.randint(1, 4)) for _ in range(4)) for _ in range(30)]
    got = S.fisher_greater(spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint"), "a", "b", "c", "d").collect()
    for r in got:
        n, row, col = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        term = tail = math.comb(col, r.a) * math.comb(n - col, row - r.a)
        for i in range(r.a, min(row, col)):
            term = term * (col - i) * (row - i) // ((i + 1) * (n - row - col + i + 1))
            tail += term
        whole = math.comb(n, row)
        p = (tail << 2000) // whole
        assert r.p_value == pytest.approx(p / (1 << 2000) if p.bit_length() < 3000 else 1.0, rel=1e-8, abs=1e-290)
    big = S.fisher_greater(spark.createDataFrame([(10**6, 10**6, 10**6, 10**6), (10**5, 10**6, 10**6, 10**5)], "a bigint, b bigint, c bigint, d bigint"), "a", "b", "c", "d")
    assert [round(r.p_value, 3) for r in big.collect()] == [0.5, 1.0]


def test_incremental_run_keeps_key_types_and_empty_results(spark, tmp_path):
    inputs = spark.createDataFrame([("007", 1), ("008", 2)], "strain string, v int")
    work = lambda df: df.select("strain", (F.col("v") * 2).alias("w"))
    for _ in range(2):
        got = resume.run_incremental(inputs, "strain", work, str(tmp_path / "a"), 1)
        assert {(r.strain, r.w) for r in got.collect()} == {("007", 2), ("008", 4)}
    none = lambda df: work(df).filter("w > 100")
    for _ in range(2):
        got = resume.run_incremental(inputs, "strain", none, str(tmp_path / "b"), 1)
        assert got.count() == 0 and dict(got.dtypes) == {"strain": "string", "w": "int"}
    refs = spark.createDataFrame([("r1", "ACGT")], "ref_id string, seq string")
    changed = spark.createDataFrame([("r1", "ACGA")], "ref_id string, seq string")
    assert resume.content(refs) == resume.content(refs) != resume.content(changed)


def test_accession_column_reads_every_value(spark):
    rows = [(f"x{i}", f"note {i}") for i in range(60)] + [("GCA_000812595.1", "GCA_000812595.1")]
    assert tables.accession_column(spark.createDataFrame(rows, "first string, second string")) == "first"
    rows = [(f"x{i}", f"note {i}") for i in range(60)] + [("y", "GCA_000812595.1")]
    assert tables.accession_column(spark.createDataFrame(rows, "first string, second string")) == "second"


def test_aro_keeps_the_last_line_and_a_missing_file_is_empty(spark, tmp_path):
    path = tmp_path / "aro.tsv"
    path.write_text("\t".join(tables.ARO_COLUMNS) + "\nARO:1\tz\tz\tz\nARO:1\ta\tb\tc\n")
    assert [tuple(r) for r in tables.read_aro(spark, str(path)).collect()] == [("ARO:1", "a", "b", "c")]
    assert tables.read_aro(spark, str(tmp_path / "none.tsv")).count() == 0


def test_a_record_goes_on_in_the_next_files(spark, tmp_path):
    for name, text in (("part-0", "lost\n>a\nAC\nGT\n"), ("part-1", "TT\n"), ("part-2", "GG\n>b\nAA\n>c\nC\n"), ("part-3", ">d\nG\n"), ("part-4", "A")):
        (tmp_path / name).write_text(text)
    got = fasta.read_fasta(spark, str(tmp_path), in_parts=True).collect()
    assert sorted((r.header, r.seq) for r in got) == [("a", "ACGTTTGG"), ("b", "AA"), ("c", "C"), ("d", "GA")]


def test_a_supermatrix_of_many_files_is_read_back_whole(spark, tmp_path):
    lines = spark.range(400).selectExpr("concat('t', id % 2) AS taxon", "id div 2 AS line", "lpad(translate(cast(id AS string), '0123456789', 'ACGTACGTAC'), 5, 'T') AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_supermatrix(lines, str(tmp_path / "sm"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "sm").glob("part-*"))) > 2
    want = {f"t{t}": "".join(r.text for r in sorted(lines.collect(), key=lambda r: r.line) if r.taxon == f"t{t}") for t in (0, 1)}
    assert {r.header: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "sm"), in_parts=True).collect()} == want


def test_presence_cells_hold_the_absent_ones_too(spark):
    rows = [("f", "a"), ("f", "a"), ("f", "b"), ("g", "c"), ("h", None)]
    got = FM.presence_cells(spark.createDataFrame(rows, "family string, strain string")).collect()
    assert len(got) == 12 and {(r.family, r.strain) for r in got if r.present} == set(rows)
    assert {r.present for r in got} == {0, 1}


def test_presence_matrix_has_every_cell(spark, tmp_path):
    import duckdb

    from cladeflow.catalog import QUERIES
    from cladeflow.oracle import ORACLE

    rows = [(1, "a b", "x"), (2, "B c", "y"), (3, "1 2", "z"), (4, "a", None), (5, None, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.family, r.strain) for r in QUERIES["presence_matrix"](spark, str(tmp_path)).collect()}
    held = {"a": {"x", None}, "b": {"x", "y"}, "c": {"y"}}
    assert got == {(f, ("" if s is None else f"{s}=") + str(int(s in held[f]))) for f in held for s in ("x", "y", "z", None, "")}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(con.execute(ORACLE["presence_matrix"]).fetchall()) == got
