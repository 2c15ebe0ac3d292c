"""Sketches, shared counts, distances and layout against brute force."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeflow.catalog import QUERIES
from cladeflow.functions.sequence import canonical, distinct_kmers, kmers, translate_codons, wrap
from cladeflow.operators import distance as D
from cladeflow.operators import genomes as G
from cladeflow.operators.ordering import reverse_running_min, running_total


def kset(s, k):
    return {s[i:i + k] for i in range(len(s) - k + 1)}


def test_kmers_cross_piece_borders_and_respect_short_sequences(spark):
    rng = random.Random(1)
    texts = ["", "ab", "abc", "été\nà", "".join(rng.choice("abé\n") for _ in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    got = {}
    for r in kmers(df, ["id"], 3).collect():
        got.setdefault(r.id, []).append(r.kmer)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(t[j:j + 3] for j in range(len(t) - 2))
    assert distinct_kmers(df, ["id"], 3).filter("id = 4").count() == len(kset(texts[4], 3))


def test_canonical_translation_and_wrap(spark):
    row = spark.range(1).select(
        canonical(F.lit("TTT")).alias("c"), translate_codons(F.lit("ATGGCCNNATAAT")).alias("p"),
        wrap(F.lit("a" * 125)).alias("w"), wrap(F.lit("")).alias("e")).first()
    assert row.c == "AAA" and row.p == "MAX*" and [len(x) for x in row.w.split("\n")] == [60, 60, 5] and row.e == ""


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("join", [False, True])
def test_sketch_with_and_without_contig_borders(spark, join):
    rng = random.Random(2)
    strains = {s: ["".join(rng.choice("ACGTN" if rng.random() < .1 else "ACGT") for _ in range(rng.choice([1, 2, 3, 9, 40]))) for _ in range(25)]
               for s in "xy"}
    rows = [(s, i, c.lower()) for s, cs in strains.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "strain string, contig_ord int, seq string")
    got = {}
    for r in D.sketch(df, 7, 1, join_contigs=join).collect():
        got.setdefault(r.strain, set()).add(r.hash)
    for s, cs in strains.items():
        words = kset("".join(cs), 7) if join else set().union(*(kset(c, 7) for c in cs))
        assert len(got[s]) == len({min(w, revcomp(w)) for w in words if "N" not in w})


@pytest.mark.parametrize("masks,per_block", [(62, 2000), (0, 2000), (0, 3)])
def test_shared_counts_and_jaccard(spark, masks, per_block, monkeypatch):
    monkeypatch.setattr(D, "MASK_TAXA", masks)
    monkeypatch.setattr(D, "TAXA_PER_BLOCK", per_block)
    rng = random.Random(4)
    sets = {f"t{i:02d}": {rng.randrange(60) for _ in range(rng.randint(1, 30))} for i in range(11)}
    for s in list(sets)[:6]:
        sets[s].add(1000)                      # an item most taxa carry
    df = spark.createDataFrame([(t, x) for t, xs in sets.items() for x in xs for _ in range(2)], "taxon string, item int")
    counts = {(r.a, r.b): r.n for r in D.shared_counts(df, "taxon", "item", df.select("taxon")).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a <= b and sets[a] & sets[b]}
    assert counts == want
    pairs = D.pair_sets(D.shared_counts(df, "taxon", "item", df.select("taxon"))).collect()
    assert all(r.jaccard == len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b]) for r in pairs)


def test_mash_ani_edges(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "j double").select(D.mash_ani(F.col("j"), 31).alias("a")).collect()
    assert rows[0].a == 0 and rows[1].a == 100 and rows[2].a == pytest.approx(100 * (1 + math.log(2 / 3) / 31))


def test_p_distance_gaps_and_layout(spark):
    blocks = [("f1", "a", "ACGT"), ("f1", "b", "ACG"), ("f1", "c", "----"), ("f2", "a", "TT"), ("f2", "b", "TA"), ("f2", "c", "--")]
    df = spark.createDataFrame(blocks, "family string, strain string, aligned string")
    alignment, layout = D.place_blocks(df)
    assert {r.family: r.start for r in layout.collect()} == {"f1": 0, "f2": 4}
    lines = {(r.taxon, r.line): r.text for r in D.supermatrix_lines(alignment, 4).collect()}
    assert lines[("b", 0)] == "ACG-" and lines[("a", 1)] == "TT" and lines[("c", 0)] == "----"
    pairs = {(r.a, r.b): (r.compared, r.distance) for r in D.p_distance(alignment, alignment.select("taxon")).collect()}
    assert pairs == {("a", "b"): (5, 0.2)}      # c has only gaps: absent, distance 1
    wide = {r.taxon_name: r for r in D.to_wide(D.p_distance(alignment, alignment.select("taxon")), "distance", 0.0, 1.0, ["a", "b", "c"]).collect()}
    assert wide["a"]["a"] == 0.0 and wide["a"]["b"] == 0.2 and wide["b"]["a"] == 0.2 and wide["c"]["a"] == 1.0
    assert sum(r.n_sites for r in D.site_patterns(alignment).collect()) == 6


def test_running_totals(spark):
    rng = random.Random(9)
    values = [(i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rng.sample(values, 500), "k int, v int")
    total, low, want = 0, {}, {}
    for k, v in values:
        total += v
        want[k] = total
    least = 10
    for k, v in reversed(values):
        least = min(least, v)
        low[k] = least
    assert {r.k: r.t for r in running_total(df, "k", "v", "t").collect()} == want
    assert {r.k: r.m for r in reverse_running_min(df, "k", "v", "m").collect()} == low


def test_orfs_and_genome_stats(spark):
    gene = "ATG" + "GCC" * 34 + "TAA"
    seq = "CC" + gene + "TTNN"
    df = spark.createDataFrame([("s", "c1", seq), ("s", "c2", revcomp(seq)), ("e", "c", "")], "strain string, contig string, seq string")
    genes = {(g.contig, g.strand): g for g in G.call_orfs(df).collect() if g.protein.startswith("MAAA")}
    plus, minus = genes["c1", "+"], genes["c2", "-"]
    assert (plus.begin, plus.end, plus.length_nt, plus.length_aa) == (3, 2 + len(gene), len(gene), 35)
    assert plus.cds == gene == minus.cds and seq[plus.begin - 1:plus.end] == gene
    assert revcomp(revcomp(seq)[minus.begin - 1:minus.end]) == gene
    assert set(genes) == {("c1", "+"), ("c2", "-")}
    called = G.call_orfs(df)
    stats = {r.strain: r for r in G.genome_stats(df, called).collect()}
    assert stats["s"].genome_size == 2 * len(seq) and stats["e"].gc_percent == 0 and stats["e"].n_genes == 0
    gc = 100 * sum(c in "GC" for c in seq) / len(seq)
    assert stats["s"].gc_percent == pytest.approx(gc, abs=0.01)
    assert G.cohort_stats(G.genome_stats(df, called)).first().n_genomes == 2
    summary = {r.strain: r for r in G.gene_summary(G.genome_stats(df, called), called).collect()}
    assert summary["s"].genes == stats["s"].n_genes


def test_star_alignment(spark):
    from cladeflow.functions.star import align_to_centre
    from cladeflow.operators.msa import star_alignment
    from cladeflow.params import PROTEIN_SCORES

    assert align_to_centre("ACT", "ACGT", PROTEIN_SCORES) == ("AC-T", [""] * 5)
    rng = random.Random(12)
    base = "".join(rng.choice("ACDEFGHIKL") for _ in range(30))
    rows = [("f", f"s{i}", "".join(c for c in base if rng.random() > .1)) for i in range(8)] + [("f", "long", base + "MM"), ("g", "s0", "AC")]
    df = spark.createDataFrame(rows, "family string, strain string, seq string")
    got = {(r.family, r.strain): r.aligned for r in star_alignment(df).collect()}
    assert {k: v.replace("-", "") for k, v in got.items()} == {(f, s): q for f, s, q in rows}
    assert len({len(v) for (f, _), v in got.items() if f == "f"}) == 1 and got["g", "s0"] == "AC"


def _brute_shared(rows, listed):
    sets = {}
    for name, item in rows:
        if name in listed:
            sets.setdefault(name, set()).add(item)
    return {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a <= b and sets[a] & sets[b]}


@pytest.mark.parametrize("taxa,block", [(5, 2000), (70, 2000), (70, 20)])
def test_shared_counts_leave_unlisted_rows_out_at_every_size(spark, monkeypatch, taxa, block):
    monkeypatch.setattr(D, "TAXA_PER_BLOCK", block)
    draw = random.Random(taxa)
    rows = [(f"t{draw.randrange(taxa)}", draw.randrange(40)) for _ in range(taxa * 12)]
    listed = {f"t{i}" for i in range(taxa) if i not in (1, 3)}
    got = D.shared_counts(spark.createDataFrame(rows, "row string, item int"), "row", "item",
                          spark.createDataFrame([(x,) for x in listed], "row string"))
    assert {tuple(r) for r in got.collect()} == _brute_shared(rows, listed)


def test_a_batch_of_many_block_pairs_multiplies_each_apart(monkeypatch):
    sizes, add = [], D._BlockPair.add

    def spy(self, lists, weight):
        add(self, lists, weight)
        sizes.append(self.total.shape)

    monkeypatch.setattr(D._BlockPair, "add", spy)
    names = [[f"b{b}_{i}" for i in range(10)] for b in range(3)]
    pairs = [(x, y) for x in range(3) for y in range(x, 3)]
    batch = pd.DataFrame([{"bx": x, "by": y, "left": names[x], "right": names[y], "weight": 2} for x, y in pairs for _ in range(4)])
    out = pd.concat(D._products(True)(iter([batch.iloc[:13], batch.iloc[13:]])))
    assert max(max(s) for s in sizes) == 10
    assert len(out) == 30 * 31 // 2 and set(out["n"]) == {8}


@pytest.mark.parametrize("block", [2000, 3])
def test_cross_counts_meet_only_across_the_sides(spark, monkeypatch, block):
    monkeypatch.setattr(D, "TAXA_PER_BLOCK", block)
    draw = random.Random(3)
    left = {(f"g{draw.randrange(9)}", draw.randrange(12)) for _ in range(60)}
    right = {(f"r{draw.randrange(5)}", draw.randrange(12)) for _ in range(30)}
    got = D.cross_counts(spark.createDataFrame(sorted(left), "gene string, strain int"), spark.createDataFrame(sorted(right), "replicon string, strain int"), "strain")
    want = Counter((g, r) for g, s in left for r, t in right if s == t)
    assert {(r.a, r.b): r.n for r in got.collect()} == dict(want)


def test_too_many_names_for_columns_leave_the_long_form(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(7)] + [(None,)], "strain string")
    assert D.wide_names(names, 7) == sorted(f"n{i}" for i in range(7)) and D.wide_names(names, 6) is None


@pytest.mark.parametrize("block", [2000, 2])
def test_all_pairs_fill_the_matrix(spark, monkeypatch, block):
    from cladeflow.plans.phylogeny import all_pairs

    monkeypatch.setattr(D, "TAXA_PER_BLOCK", block)
    pairs = spark.createDataFrame([("a", "b", 0.5), ("b", "d", 0.1)], "a string, b string, distance double")
    got = all_pairs(pairs, spark.createDataFrame([(x,) for x in "abcde"], "name string")).collect()
    assert len(got) == 10 and sorted(r.distance for r in got) == [0.1, 0.5] + [1.0] * 8


@pytest.mark.parametrize("name,columns", [("ani_matrix", ["a", "b", "ani"]), ("presence_matrix", ["family", "strain"])])
def test_matrix_queries_have_one_schema(spark, name, columns):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns == columns and df.count() > 0


def plain_pair_score(rows, scores):
    total = 0
    for i, a in enumerate(rows):
        for b in rows[:i]:
            for x, y in zip(a, b, strict=True):
                if x != "-" and y != "-":
                    total += scores.match if x == y else scores.mismatch
                elif x != y:
                    total += scores.gap
    return total


def test_profile_alignment_keeps_residues_and_never_falls_under_the_star(spark):
    from cladeflow.operators.msa import profile_alignment
    from cladeflow.params import PROTEIN_SCORES

    rng = random.Random(8)
    rows = []
    for f in range(4):
        parent = "".join(rng.choice("ACDEFGHIKL") for _ in range(30))
        for s in range(9):
            own = "".join(rng.choice("ACDEFGHIKL") if rng.random() < 0.2 else c for c in parent if rng.random() > 0.15)
            rows.append((f, f"s{s}", own[:rng.randrange(1, 40)] + rng.choice(["", "WW", "WYW"]) + own[20:]))
    rows += [(9, "a", ""), (9, "b", "MK"), (10, "one", "ACD"), (11, "x", ""), (11, "y", "")]
    got = {}
    for r in profile_alignment(spark.createDataFrame(rows, "family int, strain string, seq string")).collect():
        got.setdefault(r.family, []).append(r)
    assert sorted((f, r.strain, r.aligned.replace("-", "")) for f, own in got.items() for r in own) == sorted(rows)
    for own in got.values():
        assert len({len(r.aligned) for r in own}) == 1
        assert own[0].score == plain_pair_score([r.aligned for r in own], PROTEIN_SCORES) >= own[0].star_score
        assert all(any(c != "-" for c in column) for column in zip(*[r.aligned for r in own]))
    assert any(own[0].score > own[0].star_score for own in got.values())


def test_alignment_to_a_profile_is_the_best_of_all(spark):
    from cladeflow.functions.star import align_to_profile
    from cladeflow.params import PROTEIN_SCORES as S

    rng = random.Random(3)
    for _ in range(60):
        others = ["".join(rng.choice("AB-") for _ in range(4)) for _ in range(3)]
        member = "".join(rng.choice("AB") for _ in range(rng.randrange(5)))
        profile = [{x: column.count(x) for x in set(column)} for column in zip(*others)]

        def best(i, j):
            if i == 0 and j == 0:
                return 0
            out = []
            if j:
                column = [o[j - 1] for o in others]
                out.append(best(i, j - 1) + S.gap * sum(c != "-" for c in column))
                if i:
                    out.append(best(i - 1, j - 1) + sum(S.gap if c == "-" else S.match if c == member[i - 1] else S.mismatch for c in column))
            if i:
                out.append(best(i - 1, j) + S.gap * len(others))
            return max(out)

        under, before = align_to_profile(member, profile, S)
        score = sum(S.gap * len(others) * len(x) for x in before)
        for x, column in zip(under, zip(*others)):
            score += sum((S.gap if c != "-" else 0) if x == "-" else S.gap if c == "-" else S.match if c == x else S.mismatch for c in column)
        assert score == best(len(member), 4) and "".join(b + u for b, u in zip(before, [*under, ""])).replace("-", "") == member


@pytest.mark.parametrize("join", [False, True])
def test_portable_sketch_is_that_of_each_kmer_alone(spark, monkeypatch, join):
    import hashlib

    monkeypatch.setattr(D, "SKETCH_LETTERS", 50)
    rng = random.Random(8)
    strains = {s: ["".join(rng.choice("acgtACGTN") if rng.random() < .2 else rng.choice("ACGT") for _ in range(rng.choice([0, 1, 2, 9, 40, 190]))) for _ in range(30)] for s in "xy"}
    df = spark.createDataFrame([(s, 3 * i, c) for s, cs in strains.items() for i, c in enumerate(cs)], "strain string, contig_ord int, seq string")
    for k in (4, 7, 31):
        got = {}
        for r in D.sketch(df, k, 3, join_contigs=join, portable=True).collect():
            got.setdefault(r.strain, []).append(r.hash)
        for s, cs in strains.items():
            words = kset("".join(cs).upper(), k) if join else set().union(*(kset(c.upper(), k) for c in cs))
            hashes = {int(hashlib.md5(min(w, revcomp(w)).encode()).hexdigest()[:15], 16) for w in words if not set(w) - set("ACGT")}
            assert sorted(got.get(s, [])) == sorted(h for h in hashes if h <= D.HASH_SPACE // 3)


def test_joined_contigs_move_no_text(spark):
    df = spark.createDataFrame([("s", 0, "ACGT" * 30)], "strain string, contig_ord int, seq string")
    assert {len(r.seq) for r in D.junctions(df, 31).collect()} == {30}


def test_genes_without_texts_are_the_same_genes(spark):
    rng = random.Random(4)
    rows = [("s", str(i), "".join(rng.choice("ACGTacgN") for _ in range(3000)).replace("TAG", "CAG")) for i in range(4)] + [("e", "none", None), ("e", "\u00e9", "ATG\u00e9" * 9)]
    df = spark.createDataFrame(rows, "strain string, contig string, seq string")
    whole, plain = G.call_orfs(df, 5).collect(), G.call_orfs(df, 5, texts=False)
    assert plain.columns == ["strain", "contig", "begin", "end", "strand", "length_nt", "length_aa"]
    assert sorted(tuple(r) for r in plain.collect()) == sorted(tuple(r)[:7] for r in whole) and len(whole) > 20
    text = {r[1]: r[2] for r in rows}
    for g in whole:
        cut = text[g.contig][g.begin - 1:g.end].upper()
        cut = cut if g.strand == "+" else revcomp(cut)
        assert g.cds == cut and cut.startswith("ATG") and cut[-3:] in ("TAA", "TAG", "TGA") and g.protein.startswith("M") and len(cut) == 3 * (g.length_aa + 1)
        assert len(g.protein) == g.length_aa and "*" not in g.protein


def test_shared_kmers_of_any_letters_match_plain_sets(spark, monkeypatch):
    rng = random.Random(4)
    letters = ["abc ", "aé漢😀", "a"]
    rows = [(rng.choice(["x", "y", "z", None]), "".join(rng.choices(rng.choice(letters), k=rng.choice([0, 3, 11, 12, 13, 40, 700])))) for _ in range(120)]
    rows += [("x", None), ("other", "abc abc abc abc"), ("x", "same line " * 90), ("z", "same line " * 90)]
    plain = {}
    for name, text in rows:
        if name in ("x", "y", "z") and text:
            plain.setdefault(name, set()).update(text[i:i + 12] for i in range(len(text) - 11))
    want = {(a, b): len(plain[a] & plain[b]) for a in plain for b in plain if a <= b and plain[a] & plain[b]}
    names = spark.createDataFrame([(x,) for x in "xyz"], "name string")
    texts = spark.createDataFrame(rows, "name string, seq string").repartition(3)
    assert {(r.a, r.b): r.n for r in D.shared_kmers(texts, "name", 12, names).collect()} == want
    texts = texts.filter(~F.contains("seq", F.lit("😀")) | F.col("seq").isNull())
    found = {(r.a, r.b): r.n for r in D.shared_kmers(texts, "name", 12, names).collect()}
    monkeypatch.setattr(D, "MASK_TAXA", 2)
    assert {(r.a, r.b): r.n for r in D.shared_kmers(texts, "name", 12, names).collect()} == found


def test_neighbouring_kmers_travel_together_and_hash_twins_are_told_apart(monkeypatch):
    import numpy as np

    from cladeflow.functions import superkmers as S

    rng = random.Random(9)
    texts = [(i % 5, "".join(rng.choices("etaoin shrdlu,é", k=3000))) for i in range(20)]
    plain = {}
    for number, text in texts:
        for i in range(len(text) - 29):
            plain[text[i:i + 30]] = plain.get(text[i:i + 30], 0) | 1 << number
    for factor in (S._FACTOR, np.uint64(0)):          # with 0, all k-mers that end alike have one hash
        found, moved, kmers = {}, 0, 0
        ranks = np.random.default_rng(1).permutation(S.SLOTS).astype(np.uint16)
        parts = [p for c in S.chunks(texts, 30, 7000) for low, own, start, size in [S.pieces(*c, 30, ranks)]
                 for p in S.packed(c[2], low % np.uint16(3), own, start, size)]
        monkeypatch.setattr(S, "_FACTOR", factor)
        for bucket in range(3):
            held = [p[1:] for p in parts if p[0] == bucket]
            moved += sum(len(x) for p in held for x in p)
            for mask, n in zip(*S.carriers(*(b"".join(x) for x in zip(*held)), 30)):
                found[int(mask)] = found.get(int(mask), 0) + int(n)
        monkeypatch.undo()
        want = {}
        for mask in plain.values():
            want[mask] = want.get(mask, 0) + 1
        assert found == want and moved < 8 * sum(len(t) - 29 for _, t in texts)


def test_equal_rows_are_aligned_to_a_profile_once_and_as_each_alone(monkeypatch):
    from cladeflow.functions import star
    from cladeflow.params import PROTEIN_SCORES as S

    rng = random.Random(6)
    rows = [(f, "".join(rng.choices("ab1-", k=9))) for f in "xy" for _ in range(3)]
    texts = {f: ["".join(f"{c}{n};" for c, n in sorted(Counter(a[i] for g, a in rows if g == f).items())) for i in range(9)] for f in "xy"}
    many = [(f, i, a, texts[f], i != 1) for i in range(4) for f, a in rows]
    calls, real = [], star.align_to_counts
    monkeypatch.setattr(star, "align_to_counts", lambda *x: calls.append(1) or real(*x))
    frame = pd.DataFrame(many, columns=["family", "strain", "aligned", "profile", "anew"])
    got = pd.concat(star.profile_rows(S)([frame[:7], frame[7:]]))
    assert len(calls) == len(set(rows)) and len(got) == len(many)
    for (f, _, a, _, anew), under, before in zip(many, got["under"], got["before"]):
        rest = [Counter(b[i] for g, b in rows if g == f) - Counter(a[i]) for i in range(9)]
        assert (under, before) == (star.align_to_profile(a.replace("-", ""), rest, S) if anew else (a, [""] * 10))
