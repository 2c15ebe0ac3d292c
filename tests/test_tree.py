"""Parsimony, permutation null, neighbour joining, rooting and Newick."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions.labels import PATTERN_CLUMPED, PATTERN_NO_TEST, PATTERN_SCATTER, PATTERN_SINGLE
from cladeflow.functions import polynomials as poly
from cladeflow.operators import presence as P
from cladeflow.operators import tree as T
from cladeflow.sources.newick import parse_newick, to_newick

# A midpoint-rooted tree of eighteen isolates, carriers of four genes, and for each
# the parsimony score with the exact null (share of placements at or below it, mean score).
NEWICK = (
    "((GCA_000812595.1:0.0022495469,(GCA_006862905.1:0.0025723233,(GCA_011457165.1:0.0034468319,(GCA_010716035.1:0.0021165465,"
    "(GCA_000330625.1:4.7824403e-05,GCA_005675415.1:1.7345369e-05):0.0021352373):0.00015419821):0.00023614286):0.00014272018)"
    ":0.00014254083,((GCA_010123345.1:0.0020465724,(GCA_000258365.1:0.00034443855,GCA_010714675.1:3.2339827e-05):0.0018896636)"
    ":8.1559184e-05,((GCA_008032345.1:0.0019575591,(GCA_010715595.1:0.0011258262,(GCA_000474395.1:0.00010471527,"
    "GCA_010123015.1:9.2710417e-05):0.0010795852):0.00073242846):1.3179496e-05,(GCA_001448615.1:0.0015204135,"
    "(GCA_000192125.1:0.0019339281,(GCA_008005965.1:0.00038394763,(GCA_000329025.1:8.8034224e-05,GCA_011454775.1:1.1338365e-05)"
    ":0.00016224599):0.00014183757):0.00071744315):0.001238376):7.188673e-05):6.601833e-06):0;")
GENES = {
    "AAC(6')-Iaa": (["GCA_000474395.1", "GCA_010123015.1"], 1, 0.0261, 1.974, PATTERN_CLUMPED),
    "FosA7": (["GCA_000258365.1", "GCA_000330625.1", "GCA_005675415.1", "GCA_010714675.1"], 2, 0.0239, 3.778, PATTERN_CLUMPED),
    "emrA": (["GCA_000330625.1", "GCA_005675415.1", "GCA_006862905.1", "GCA_010123345.1", "GCA_010716035.1"], 3, 0.0718, 4.571,
             PATTERN_SCATTER),
    "qacEdelta1": (["GCA_000330625.1", "GCA_000812595.1", "GCA_005675415.1", "GCA_010715595.1"], 3, 0.1971, 3.778, PATTERN_SCATTER),
}


def nodes(spark, newick):
    return parse_newick(spark.createDataFrame([("t", newick)], "tree string, newick string")).drop("tree")


def random_edges(rng, n_tips):
    """A random tree with polytomies and tips on many levels."""
    live, edges, made = [f"t{i}" for i in range(n_tips)], [], 0
    while len(live) > 1:
        kids = [live.pop(rng.randrange(len(live))) for _ in range(min(len(live), rng.choice([2, 2, 3, 5])))]
        edges += [(k, f"i{made}", rng.randint(1, 9) / 10) for k in kids]
        live.append(f"i{made}")
        made += 1
    return edges + [(live[0], None, 0.0)]


def cheapest(edges, carriers):
    """Fewest changes from a table of costs: what each node costs in each state, deepest nodes first.

    A node keeps a state for free if every child takes it, and else pays one change, however many
    children differ; children are then as cheap as they can be.
    """
    parent = {n: p for n, p, _ in edges}
    cost = {}
    for n in sorted(parent, key=lambda n: -sum(1 for _ in _ancestors(parent, n))):
        kids = [cost[k] for k, p in parent.items() if p == n]
        own = (n in carriers, n not in carriers)
        cost[n] = [min(sum(k[s] for k in kids), 1 + sum(map(min, kids))) if kids else 1e9 * own[s] for s in (0, 1)]
    return min(cost[next(n for n, p in parent.items() if p is None)])


def _ancestors(parent, n):
    while (n := parent[n]) is not None:
        yield n


def brute_labellings(edges, carriers):
    """Fewest edges with different ends over all labellings of the inner nodes (binary trees)."""
    tips = {n for n, _, _ in edges} - {p for _, p, _ in edges}
    inner = sorted({n for n, _, _ in edges} - tips)
    links = [(n, p) for n, p, _ in edges if p is not None]
    fixed = {t: int(t in carriers) for t in tips}
    return min(sum(state[n] != state[p] for n, p in links)
               for labels in itertools.product((0, 1), repeat=len(inner)) for state in [fixed | dict(zip(inner, labels))])


def test_fitch_is_the_minimum_over_all_labellings_of_binary_trees(spark):
    rng = random.Random(8)
    for n in (2, 5, 9):
        live, edges = [f"t{i}" for i in range(n)], []
        while len(live) > 1:
            kids = [live.pop(rng.randrange(len(live))) for _ in range(2)]
            edges += [(k, f"i{len(edges)}", 1.0) for k in kids]
            live.append(edges[-1][1])
            edges[-2] = (edges[-2][0], live[-1], 1.0)
        edges.append((live[0], None, 0.0))
        genes = {f"g{i}": rng.sample([f"t{i}" for i in range(n)], rng.randint(1, n)) for i in range(8)}
        tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
        carried = spark.createDataFrame([(g, t) for g, ts in genes.items() for t in ts], "gene string, tip string")
        got = {r.gene: r.changes for r in T.fitch_changes(tree, carried, ["gene"]).collect()}
        assert got == {g: brute_labellings(edges, ts) for g, ts in genes.items()} == {g: cheapest(edges, ts) for g, ts in genes.items()}


def test_fitch_on_random_trees(spark):
    rng = random.Random(6)
    for n in (2, 13, 40):
        edges = random_edges(rng, n)
        tips = [f"t{i}" for i in range(n)]
        genes = {f"g{i}": rng.sample(tips, rng.randint(1, n)) for i in range(12)}
        tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
        rows = [(g, t) for g, ts in genes.items() for t in ts] + [("g0", "not a tip")]
        got = T.fitch_changes(tree, spark.createDataFrame(rows, "gene string, tip string"), ["gene"])
        assert {r.gene: r.changes for r in got.collect()} == {g: cheapest(edges, set(ts)) for g, ts in genes.items()}


def test_polytomy_costs_one_change(spark):
    tree = T.shape(spark.createDataFrame([(x, "r", 1.0) for x in "abcd"] + [("r", None, 0.0)], "node string, parent string, length double"))
    carriers = spark.createDataFrame([("g", "a"), ("g", "b")], "gene string, tip string")
    assert T.fitch_changes(tree, carriers, ["gene"]).first().changes == 1


def test_known_genes_on_the_known_tree(spark):
    tree = T.shape(nodes(spark, NEWICK))
    assert (tree.n_tips, tree.n_nodes) == (18, 35)
    all_tips = [r.tip for r in tree.tips.collect()]
    rows = [(g, t) for g, v in GENES.items() for t in v[0]]
    rows += [("everywhere", t) for t in all_tips] + [("once", all_tips[0]), ("elsewhere", "GCA_9"), ("elsewhere", "GCA_8")]
    presence = spark.createDataFrame(rows, "gene string, tip string")
    strains = presence.withColumnRenamed("tip", "strain")
    hosts = spark.createDataFrame([(t, "Cattle" if i % 2 else None) for i, t in enumerate(all_tips)], "strain string, host_group string")
    tests = T.clumping_test(tree, presence)
    called = {r.gene: r for r in P.call_patterns(tests, P.gene_totals(strains, hosts)).collect()}
    for gene, (tips, changes, p, mean, pattern) in GENES.items():
        r = called[gene]
        assert r.changes_observed == changes and r.n_isolates == len(tips) and r.pattern == pattern
        assert r.p_clumped == pytest.approx(p, abs=0.04) and r.changes_expected == pytest.approx(mean, abs=0.12)
    assert called["everywhere"].pattern == PATTERN_NO_TEST and called["everywhere"].p_clumped is None
    assert called["once"].pattern == PATTERN_SINGLE and called["once"].changes_observed == 1
    assert called["elsewhere"].pattern == PATTERN_NO_TEST and called["elsewhere"].n_isolates == 2
    assert T.check_overlap(tree, strains) == 18
    with pytest.raises(ValueError):
        T.check_overlap(tree, spark.createDataFrame([("x",)], "strain string"))


def test_null_matches_all_placements(spark):
    rng = random.Random(8)
    edges = random_edges(rng, 8)
    tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
    null = {(r.k, r.changes): r.n for r in T.null_scores(tree, [2, 3], 2000).collect()}
    for k in (2, 3):
        scores = [cheapest(edges, set(c)) for c in itertools.combinations([f"t{i}" for i in range(8)], k)]
        for s in set(scores):
            assert null.get((k, s), 0) / 2000 == pytest.approx(scores.count(s) / len(scores), abs=0.05)


def patristic(rows):
    up = {r.node: (r.parent, r.length) for r in rows}
    parents = {r.parent for r in rows}
    def path(n):
        out, d = {}, 0.0
        while n is not None:
            out[n] = d
            n, d = up[n][0], d + up[n][1]
        return out
    tips = sorted(n for n in up if n not in parents)
    paths = {t: path(t) for t in tips}
    return {(a, b): min(paths[a][n] + paths[b][n] for n in paths[a] if n in paths[b]) for a in tips for b in tips if a < b}


def test_neighbor_joining_recovers_an_additive_tree(spark):
    want = patristic(nodes(spark, NEWICK).collect())
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in want.items()], "a string, b string, distance double")
    nj = T.neighbor_joining(pairs)
    got = patristic(nj.collect())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    rooted = T.midpoint_root(T.shape(nj))
    again = patristic(rooted.collect())
    assert all(again[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    tree = T.shape(rooted)
    def keys(t):
        return {(r.n_tips, r.clade) for r in T.clades(t).collect()}

    assert keys(tree) == keys(T.shape(nodes(spark, NEWICK)))        # same root, same clades


def test_small_neighbor_joining(spark):
    two = T.neighbor_joining(spark.createDataFrame([("a", "b", 1.0)], "a string, b string, distance double")).collect()
    assert patristic(two) == {("a", "b"): 1.0}


def test_newick_roundtrip(spark):
    tree = T.shape(nodes(spark, "((a_b:1,c:2)0.9:3,(d:1,e:1,f:0.5)0.9:2)root;"))
    text = to_newick(tree).first().newick
    assert text == "((a_b:1.0,c:2.0):3.0,(d:1.0,e:1.0,f:0.5):2.0);"
    assert patristic(nodes(spark, text).collect()) == patristic(tree.nodes.collect())


def test_exact_null_counts_all_placements(spark):
    rng = random.Random(12)
    for n in (1, 2, 7, 9):
        edges = random_edges(rng, n)
        tips = [f"t{i}" for i in range(n)]
        tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
        got = {(r.k, r.changes): r.share for r in T.exact_null(tree).collect()}
        want = {}
        for k in range(n + 1):
            scores = [cheapest(edges, set(c)) for c in itertools.combinations(tips, k)]
            want |= {(k, s): scores.count(s) / len(scores) for s in set(scores)}
        assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)


def counted_placements(children, node):
    """(k, score, mask) -> number of placements, by plain sums over all splits."""
    if node not in children:
        return {(0, 0, 1): 1, (1, 0, 2): 1}
    met = {(0, 0, 3, 0): 1}
    for child in children[node]:
        own, new = counted_placements(children, child), {}
        for (k, s, cap, cup), n in met.items():
            for (j, c, mask), m in own.items():
                key = (k + j, s + c, cap & mask, cup | mask)
                new[key] = new.get(key, 0) + n * m
        met = new
    out = {}
    for (k, s, cap, cup), n in met.items():
        key = (k, s + (cap == 0), cap or cup)
        out[key] = out.get(key, 0) + n
    return out


@pytest.mark.parametrize("tips, most", [(14, 3), (60, 30)])
def test_exact_null_by_blocks_equals_plain_sums(spark, tips, most):
    rng = random.Random(tips)
    children, free, n = {}, [f"t{i}" for i in range(tips)], 0
    while len(free) > 1:
        rng.shuffle(free)
        take = free[:rng.randint(2, most)]
        free = free[len(take):] + [f"n{n}"]
        children[f"n{n}"], n = take, n + 1
    root = free[0]
    edges = [(root, None, 0.0)] + [(c, p, 1.0) for p, own in children.items() for c in own]
    tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
    want, sums = {}, {}
    for (k, s, _), count in counted_placements(children, root).items():
        want[k, s] = want.get((k, s), 0) + count
        sums[k] = sums.get(k, 0) + count
    got = {(r.k, r.changes): r.log_share for r in T.exact_null(tree).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k, s] - math.log(want[k, s] / sums[k])) < 1e-9 for k, s in want)


def test_exact_null_keeps_shares_below_the_smallest_double(spark):
    edges = [("root", None, 0.0)] + [(f"p{i}", "root", 1.0) for i in range(3)] + [(f"t{i}", f"p{i % 3}", 1.0) for i in range(1302)]
    rows = T.exact_null(T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))).collect()
    got = {(r.k, r.changes): r.log_share for r in rows}
    # 434 carriers need one change only as all the tips of one parent
    choose = math.lgamma(1303) - math.lgamma(435) - math.lgamma(869)
    assert abs(got[434, 1] - (math.log(3) - choose)) < 1e-7 and got[434, 1] < -745
    for k in (1, 433, 434, 650, 1301):
        assert abs(sum(r.share for r in rows if r.k == k) - 1) < 1e-9
    assert {k for k, _ in got} == set(range(1303))


def test_exact_test_gives_the_share_at_or_below(spark):
    edges = random_edges(random.Random(3), 8)
    tips = [f"t{i}" for i in range(8)]
    genes = {"a": tips[:3], "b": tips[2:7], "all": tips, "one": tips[4:5], "none": ["elsewhere"]}
    tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
    got = {r.gene: r for r in T.exact_test(tree, spark.createDataFrame([(g, t) for g, ts in genes.items() for t in ts], "gene string, tip string")).collect()}
    assert got["all"].p_clumped is None and got["none"].p_clumped is None and got["none"].n_tips == 0
    for g in ("a", "b", "one"):
        own = cheapest(edges, set(genes[g]))
        scores = [cheapest(edges, set(c)) for c in itertools.combinations(tips, len(genes[g]))]
        assert got[g].p_clumped == pytest.approx(sum(s <= own for s in scores) / len(scores))
        assert got[g].changes_expected == pytest.approx(sum(scores) / len(scores))


def test_placements_are_the_tips_of_least_hash(spark):
    import hashlib

    names = [f"t{i}" for i in range(40)] + ["x" * n for n in (46, 47, 48, 60, 130)] + ["é"]
    edges = [("root", None, 0.0)] + [(name, "root", 1.0) for name in names]
    tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
    for sizes in ([1, 3], [len(names)], []):
        got = {}
        for r in T.random_placements(tree, sizes, 101, 7).collect():
            got.setdefault((r.k, r.perm), set()).add(r.tip)
        for k in sizes:
            for perm in range(101):
                ranked = sorted(names, key=lambda name: (hashlib.md5(f"7|{perm}|{name}".encode()).hexdigest(), name))
                assert got[k, perm] == set(ranked[:k])
        assert len(got) == 101 * len(sizes)
    assert T._first_tips.__doc__ and max(len(p) for p in T._first_tips(3, 5, 7)(iter([tree.tips.toPandas()]))) == 15


def test_exact_null_up_to_a_number_of_carriers(spark):
    rng = random.Random(3)
    edges = [("root", None, 0.0)] + [(f"n{i}", "root", 1.0) for i in range(5)] + [(f"t{i}", f"n{rng.randrange(5)}", 1.0) for i in range(140)]
    tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
    whole = {(r.k, r.changes): r.log_share for r in T.exact_null(tree).collect()}
    for most in (0, 1, 31, 32, 70):
        got = {(r.k, r.changes): r.log_share for r in T.exact_null(tree, most).collect()}
        assert set(got) == {x for x in whole if x[0] <= most} and all(got[x] == pytest.approx(whole[x], abs=1e-9) for x in got)
    # nearly all tips: the test is that of the few without
    carriers = [("few", f"t{i}") for i in range(3)] + [("most", f"t{i}") for i in range(3, 140)]
    rows = {r.gene: r for r in T.exact_test(tree, spark.createDataFrame(carriers, "gene string, tip string")).collect()}
    assert rows["few"].p_clumped == rows["most"].p_clumped and rows["few"].changes_expected == rows["most"].changes_expected


def test_exact_null_in_tiles_equals_that_at_once(spark, monkeypatch):
    """Seventy tips under one parent and a hundred under others: blocks, tiles and both ways to multiply."""
    edges = [("root", None, 0.0)] + [(f"p{i}", "root", 1.0) for i in range(5)] + [(f"t{i}", f"p{i % 4 if i < 100 else 4}", 1.0) for i in range(170)]
    tree = T.shape(spark.createDataFrame(edges, "node string, parent string, length double"))
    whole = {(r.k, r.changes): r.log_share for r in T.exact_null(tree).collect()}
    monkeypatch.setattr(T, "AT_ONCE", 0)
    monkeypatch.setattr(T, "TILE", 2)
    got = {(r.k, r.changes): r.log_share for r in T.exact_null(tree).collect()}
    assert set(got) == set(whole) and all(abs(got[x] - whole[x]) < 1e-9 for x in whole)
    assert {k for k, _ in whole} == set(range(171))


def test_products_keep_parts_of_very_different_scales():
    rng = random.Random(5)
    a, b = (np.array([[-math.inf if rng.random() < 0.3 else rng.uniform(-200, 0) - 400 * s * way for _ in range(poly.BLOCK)] for s in range(n)])
            for n, way in ((6, 1), (4, -1)))
    got = poly.product(a, b)
    want = np.full(got.shape, -math.inf)
    for s, t, i, j in itertools.product(range(6), range(4), range(poly.BLOCK), range(poly.BLOCK)):
        want[s + t, i + j] = np.logaddexp(want[s + t, i + j], a[s, i] + b[t, j])
    assert np.array_equal(np.isfinite(got), np.isfinite(want))
    assert np.allclose(got[np.isfinite(got)], want[np.isfinite(want)], rtol=0, atol=1e-9)
