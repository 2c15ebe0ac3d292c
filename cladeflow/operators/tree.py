"""Trees as DataFrames: shape, Fitch parsimony, permutation null, neighbour joining, rooting.

A tree is ``(node, parent, length)`` with string ids; the root's parent is NULL.  Tips are
nodes without children.  ``shape`` adds child counts and depths, which the level loops need:
all children of a node lie on one level, so a level is one aggregation.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions import digest
from cladeflow.functions import polynomials as poly
from cladeflow.functions.sequence import portable_hash
from cladeflow.operators.common import checkpoint, sized_join, task_count
from cladeflow.operators.stats import log_gamma
from cladeflow.params import PERMUTATIONS, SEED

LEVELS_PER_CHECKPOINT = 8
NODE_BYTES = 160
TILE = 8                  # blocks of a table that meet others in one group
AT_ONCE = 1 << 32         # (carriers times scores) squared, up to which a node's children are multiplied in one task


@dataclass(frozen=True)
class Tree:
    """``nodes(node, parent, length, n_children, is_tip, depth)`` with its size in numbers."""

    nodes: DataFrame
    n_nodes: int
    n_tips: int
    max_depth: int
    tip_depths: tuple[int, ...]

    @property
    def tips(self) -> DataFrame:
        return self.nodes.filter("is_tip").select(F.col("node").alias("tip"))

    @property
    def bytes(self) -> int:
        return self.n_nodes * NODE_BYTES

    def level(self, depth: int) -> DataFrame:
        return self.nodes.filter(F.col("depth") == depth)


def shape(edges: DataFrame) -> Tree:
    """Count children and find depths by pointer jumping: one join per doubling of the depth."""
    edges = checkpoint(edges)
    kids = edges.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").cast("int").alias("n_children"))
    jump = edges.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    while True:
        jump = checkpoint(jump)
        if jump.filter("up IS NOT NULL").isEmpty():
            break
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("over"), F.col("depth").alias("more"))
        jump = jump.join(far, "up", "left").select(
            "node", F.col("over").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    nodes = checkpoint(edges.join(jump.select("node", "depth"), "node").join(kids, "node", "left")
                       .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                       .withColumn("is_tip", F.col("n_children") == 0))
    size = nodes.agg(F.count("*").alias("n"), F.count_if("is_tip").alias("tips"), F.max("depth").alias("deep"),
                     F.collect_set(F.when(F.col("is_tip"), F.col("depth"))).alias("at")).first()
    return Tree(nodes, size.n, size.tips, size.deep or 0, tuple(sorted(size["at"])))


def fitch_changes(tree: Tree, carriers: DataFrame, by: list[str]) -> DataFrame:
    """Fewest state changes of each binary character: ``(*by, changes)``.

    ``carriers(*by, tip)`` lists only the tips in state 1.  A node whose subtree has no
    carrier is {0} without changes, so only ancestors of carriers are ever rows: a node
    compares its listed children with its number of children to see whether {0} siblings
    exist.  Sets are bit masks (1 = {0}, 2 = {1}, 3 = both); a polytomy costs at most one
    change.  One aggregation per level, from the deepest up, lineage cut every few levels.
    """
    leaves = tree.nodes.filter("is_tip").select(F.col("node").alias("tip"), "depth")
    state = sized_join(carriers.select(*by, "tip").distinct(), leaves, ["tip"], tree.bytes).select(
        *by, F.col("tip").alias("node"), F.lit(2).alias("mask"), F.lit(0).alias("changes"), "depth")
    if len(tree.tip_depths) > 1:
        state = checkpoint(state)          # read once per level that has tips
    columns = [*by, "node", "mask", "changes"]
    risen = None
    for depth in range(tree.max_depth, 0, -1):
        here = risen
        if depth in tree.tip_depths:
            tips_here = state.filter(F.col("depth") == depth).select(*columns)
            here = tips_here if here is None else here.unionByName(tips_here)
        up = tree.level(depth).select("node", "parent").join(
            tree.level(depth - 1).select(F.col("node").alias("parent"), "n_children"), "parent")
        met = sized_join(here, up, ["node"], tree.bytes).groupBy(*by, "parent").agg(
            F.first("n_children").alias("kids"), F.count("*").alias("n"),
            F.bit_and("mask").alias("cap"), F.bit_or("mask").alias("cup"), F.sum("changes").alias("changes"))
        absent = F.col("kids") > F.col("n")
        cap = F.when(absent, F.col("cap").bitwiseAND(F.lit(1))).otherwise(F.col("cap"))
        cup = F.when(absent, F.col("cup").bitwiseOR(F.lit(1))).otherwise(F.col("cup"))
        risen = met.withColumn("common", cap).select(
            *by, F.col("parent").alias("node"),
            F.when(F.col("common") != 0, F.col("common")).otherwise(cup).cast("int").alias("mask"),
            (F.col("changes") + F.when(F.col("common") == 0, 1).otherwise(0)).cast("int").alias("changes"))
        if (tree.max_depth - depth + 1) % LEVELS_PER_CHECKPOINT == 0:
            risen = checkpoint(risen)
    return (state if risen is None else risen).select(*by, "changes")


def _first_tips(most: int, n_perms: int, seed: int):
    """Of each batch of tips and each permutation the ``most`` tips of least hash, with all that tie in its first 64 bits."""
    def run(batches):
        for batch in batches:
            names = batch["tip"].to_numpy(dtype=object)
            texts = [name.encode() for name in names]
            sizes, laid = np.array([len(t) for t in texts]), {}
            held, count = [], 0
            for perm in range(n_perms if most and len(names) else 0):
                prefix = f"{seed}|{perm}|".encode()
                if len(prefix) not in laid:      # the words of a message but for the number of the permutation
                    room = digest.LONGEST - len(prefix)
                    groups = [np.flatnonzero(sizes == size) for size in np.unique(sizes[sizes <= room])]
                    laid[len(prefix)] = [(at, digest.padded([texts[i] for i in at], len(prefix), int(sizes[at[0]]))) for at in groups], np.flatnonzero(sizes > room)
                groups, long = laid[len(prefix)]
                front = np.frombuffer(prefix.ljust(64, b"\0"), dtype="<u4")
                lead = np.zeros(len(names), dtype=np.uint64)
                full = np.zeros((len(names), 4), dtype="<u4")
                for at, words in groups:
                    words = [word | part if part else word for word, part in zip(words, front)]
                    for lo in range(0, len(at), digest.STEP):
                        made = digest.md5_block([word[lo:lo + digest.STEP] for word in words])
                        lead[at[lo:lo + digest.STEP]] = digest.leading(made)
                        full[at[lo:lo + digest.STEP]] = np.stack(made, axis=1)
                for i in long.tolist():
                    full[i] = np.frombuffer(hashlib.md5(prefix + texts[i]).digest(), dtype="<u4")
                    lead[i] = digest.leading([full[i, :1], full[i, 1:2]])[0]
                first = np.flatnonzero(lead <= np.partition(lead, most - 1)[most - 1]) if most < len(lead) else np.arange(len(lead))
                held.append(pd.DataFrame({"perm": perm, "tip": names[first], "h": [row.tobytes().hex() for row in full[first]]}))
                count += len(first)
                if count > 1 << 16:
                    yield pd.concat(held)
                    held, count = [], 0
            if held:
                yield pd.concat(held)

    return run


def random_placements(tree: Tree, sizes: list[int], n_perms: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """For each permutation and each size, that many random tips: ``(k, perm, tip)``.

    Tips are ranked by a hash of (seed, permutation, tip): reproducible, independent of the
    cluster and the same in any SQL engine.  A task hashes its tips permutation by permutation and
    hands on those that may be among the first, as many as the largest size; the shuffle ranks them.
    """
    most = max(sizes, default=0)
    tips = tree.tips.repartition(task_count(tree.nodes.sparkSession))
    drawn = tips.mapInPandas(_first_tips(most, n_perms, seed), "perm int, tip string, h string")
    w = Window.partitionBy("perm").orderBy("h", "tip")
    ranked = drawn.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    wanted = F.array(*[F.lit(k) for k in sorted(sizes)]) if sizes else F.array().cast("array<int>")
    return ranked.withColumn("k", F.explode(F.filter(wanted, lambda k: k >= F.col("rank")))).select("k", "perm", "tip")


def null_scores(tree: Tree, sizes: list[int], n_perms: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """Histogram of parsimony scores under random placement: ``(k, changes, n)``."""
    placed = random_placements(tree, sizes, n_perms, seed)
    return fitch_changes(tree, placed, ["k", "perm"]).groupBy("k", "changes").agg(F.count("*").alias("n"))


def clumping_test(tree: Tree, presence: DataFrame, n_perms: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """Parsimony against the permutation null: ``(gene, n_tips, changes_observed, changes_expected, p_clumped)``.

    The null of a gene depends only on how many tips carry it, so it is drawn once per
    number of carriers instead of once per gene; swapping presence and absence does not
    change a score, so only the smaller side is placed.  Genes on no tip or on all tips get
    NULLs.  ``presence(gene, tip)``; carriers outside the tree are ignored here.
    """
    present = checkpoint(presence.select("gene", "tip").distinct())
    scores = fitch_changes(tree, present, ["gene"])
    counts = sized_join(present, tree.tips, ["tip"], tree.bytes).groupBy("gene").agg(F.count("*").alias("n_tips"))
    genes = (present.select("gene").distinct().join(counts, "gene", "left").join(scores, "gene", "left")
             .select("gene", F.coalesce("n_tips", F.lit(0)).alias("n_tips"),
                     F.coalesce("changes", F.lit(0)).alias("changes_observed")))
    tested = (F.col("n_tips") > 0) & (F.col("n_tips") < tree.n_tips)
    genes = checkpoint(genes.withColumn(
        "k", F.when(tested, F.least(F.col("n_tips"), tree.n_tips - F.col("n_tips")).cast("int"))))
    # one integer per distinct carrier count, never one per gene
    sizes = [r.k for r in genes.select("k").distinct().filter("k IS NOT NULL").collect()]
    null = null_scores(tree, sizes, n_perms, seed)
    asked = genes.filter("k IS NOT NULL").select("k", "changes_observed").distinct()
    tally = (asked.join(null, "k").groupBy("k", "changes_observed").agg(
        F.sum(F.when(F.col("changes") <= F.col("changes_observed"), F.col("n")).otherwise(0)).alias("low"),
        (F.sum(F.col("changes") * F.col("n")) / F.lit(n_perms)).alias("changes_expected")))
    tally = tally.withColumn("p_clumped", (F.col("low") + 1) / F.lit(n_perms + 1)).drop("low")
    return genes.join(tally, ["k", "changes_observed"], "left").select(
        "gene", "n_tips", "changes_observed", "changes_expected", "p_clumped")


_COEFFICIENTS = "parent string, child string, t int, cap int, block int, low int, logs array<double>"


def _bundles(tips: DataFrame, last: int | None = None) -> DataFrame:
    """Tips under one parent as one table up to block ``last``: n over k placements, no change, and the states they share."""
    def make(parts):
        for part in parts:
            rows = []
            for parent, t, block in zip(part["parent"], part["t"], part["block"]):
                ks = np.arange(block * poly.BLOCK, (block + 1) * poly.BLOCK)
                logs = np.full(poly.BLOCK, -np.inf)
                logs[ks <= t] = poly.log_binomials(t, ks[ks <= t])
                for cap, here in ((1, ks == 0), (2, ks == t), (0, (ks > 0) & (ks < t))):
                    if here.any():
                        rows.append((parent, "", t, cap, block, 0, np.where(here, logs, -np.inf)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _COEFFICIENTS.split(", ")])

    end = F.floor(F.col("t") / poly.BLOCK).cast("int")
    cut = tips.withColumn("block", F.explode(F.sequence(F.lit(0), end if last is None else F.least(end, F.lit(last)))))
    return cut.select("parent", "t", "block").mapInPandas(make, _COEFFICIENTS)


def _gathered(part: pd.DataFrame) -> poly.Tables:
    return poly.gathered(zip(part["cap"], part["block"], part["low"], part["logs"]))


def _at_once(rows: DataFrame, last: int | None = None) -> DataFrame:
    """All children of each parent together in one task, those of fewest tips first: for parents of little work."""
    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        heap = [(int(own["t"].iloc[0]), at, _gathered(own)) for at, (_, own) in enumerate(part.groupby("child", sort=True))]
        heapq.heapify(heap)
        while len(heap) > 1:
            (t, _, x), (u, at, y) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (t + u, at, poly.combined(x, y, last)))
        t, _, tables = heap[0]
        return pd.DataFrame([(*key, t, cap, block, low, table.ravel()) for (cap, block), (low, table) in tables.items()],
                            columns=["parent", "t", "cap", "block", "low", "logs"])

    return rows.repartition(task_count(rows.sparkSession), "parent").groupBy("parent").applyInPandas(merge, "parent string, t int, cap int, block int, low int, logs array<double>")


def _products(rows: DataFrame, pairs: DataFrame, last: int | None = None) -> DataFrame:
    """Products of the two tables of each pair of siblings, as parts of the result's blocks up to ``last``.

    ``TILE`` neighbouring blocks of one sibling are sent to as many of the other, under the key of both, so that no task holds a
    whole table and a heavy pair is as many groups as it has pairs of tiles.
    """
    end = F.floor(F.col("t_other") / (poly.BLOCK * TILE)).cast("int")
    tile = F.floor(F.col("block") / TILE).cast("int")
    other = F.sequence(F.lit(0), end if last is None else F.least(end, last // TILE - F.col("tile")))
    met = (rows.join(pairs, ["parent", "half"]).withColumn("side", F.col("place") % 2).withColumn("tile", tile)
           .withColumn("t_other", F.when(F.col("side") == 0, F.col("t1")).otherwise(F.col("t0")))
           .withColumn("beside", F.explode(other)))
    met = met.select("parent", "half", "t0", "t1", "side", "cap", "block", "low", "logs", *[
        F.when(F.col("side") == side, F.col("tile")).otherwise(F.col("beside")).alias(f"b{side}") for side in (0, 1)])

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        tables = poly.combined(*[_gathered(part[part["side"] == side]) for side in (0, 1)], last)
        return pd.DataFrame([(first["parent"], int(first["half"]), int(first["t0"] + first["t1"]), cap, block, low, table.ravel())
                             for (cap, block), (low, table) in tables.items()], columns=["parent", "place", "t", "cap", "block", "low", "logs"])

    tasks, keys = 4 * task_count(rows.sparkSession), ["parent", "half", "b0", "b1"]
    return met.repartition(tasks, *keys).groupBy(*keys).applyInPandas(
        multiply, "parent string, place int, t int, cap int, block int, low int, logs array<double>")


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the tables with one key and block."""
    keys = [*by, "block"]
    kind = ", ".join(f"{rows.schema[c].name} {rows.schema[c].dataType.simpleString()}" for c in keys) + ", low int, logs array<double>"

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        low, table = poly.total([(low, np.asarray(x, dtype=float).reshape(-1, poly.BLOCK)) for low, x in zip(part["low"], part["logs"])])
        return pd.DataFrame([(*key, int(low), table.ravel())], columns=[*keys, "low", "logs"])

    return rows.repartition(task_count(rows.sparkSession), *keys).groupBy(*keys).applyInPandas(add, kind)


def _by_halves(rows: DataFrame, last: int | None = None) -> DataFrame:
    """All children of each parent together, two and two: the longest chain is the logarithm of their number."""
    order = Window.partitionBy("parent").orderBy("child")
    places = checkpoint(rows.groupBy("parent", "child").agg(F.first("t").alias("t")).withColumn("place", F.row_number().over(order) - 1))
    rows = checkpoint(rows.join(places.select("parent", "child", "place"), ["parent", "child"]).drop("child"))
    sizes = places.select("parent", "place", "t")
    while (sizes.agg(F.max("place")).first()[0] or 0) > 0:
        half = F.floor(F.col("place") / 2).cast("int")
        halves = checkpoint(sizes.groupBy("parent", half.alias("half")).agg(
            F.sum("t").cast("int").alias("t"), F.min_by("t", "place").alias("t0"), F.max_by("t", "place").alias("t1"), F.count("*").alias("n")))
        halved = rows.withColumn("half", half)
        met = _summed(_products(halved.drop("t"), halves.filter("n = 2").drop("t", "n"), last), ["parent", "place", "t", "cap"])
        alone = halved.join(halves.filter("n = 1").select("parent", "half"), ["parent", "half"]).withColumn("place", F.col("half")).drop("half")
        rows = checkpoint(met.unionByName(alone.select(*met.columns)))
        sizes = halves.select("parent", F.col("half").alias("place"), "t")
    return rows.drop("place")


def exact_null(tree: Tree, most: int | None = None) -> DataFrame:
    """Exact distribution of the parsimony score over all placements: ``(k, changes, share, log_share)``.

    For every number k of carriers, the share of the placements of k carriers on the tips that need that many changes;
    ``log_share`` is its logarithm and holds where the share is too small for a double.  A subtree is a generating
    polynomial: coefficients by carriers and score for each set of states its children share.  The children of a node are
    multiplied in one task where that is little work, else two and two in tiles of blocks of k.
    Tips under one parent are one polynomial.  Rows grow with tips times scores, not with placements.  With ``most`` only
    k up to that number are returned; coefficients beyond its block never enter those below and are left out all along.
    Without it the larger half of the numbers is that of the smaller one: swapping presence and absence changes no score.
    """
    spark, risen = tree.nodes.sparkSession, None
    if tree.n_nodes == 1:        # a single tip
        return tree.nodes.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.lit(0).alias("changes"), F.lit(1.0).alias("share"), F.lit(0.0).alias("log_share"))
    last = (tree.n_tips // 2 if most is None else most) // poly.BLOCK
    for depth in range(tree.max_depth - 1, -1, -1):
        tips = tree.level(depth + 1).filter("is_tip").groupBy("parent").agg(F.count("*").cast("int").alias("t"))
        rows = _bundles(tips.repartition(task_count(spark), "parent"), last)
        if risen is not None:
            up = tree.level(depth + 1).select(F.col("node").alias("child"), "parent")
            rows = rows.unionByName(risen.join(up, "child").select(
                "parent", "child", "t", F.col("mask").alias("cap"), "block", "low", "logs"))
        rows = checkpoint(rows)
        held = F.least(F.sum("t"), F.lit((last + 1) * poly.BLOCK)).cast("double")
        works = rows.groupBy("parent", "child").agg(F.first("t").alias("t"), F.max(F.col("low") + F.size("logs") / poly.BLOCK).alias("high")).groupBy("parent").agg(
            (held * held * F.sum("high") * F.sum("high")).alias("work"))
        heavy = checkpoint(works.filter(F.col("work") > AT_ONCE).select("parent"))
        if heavy.isEmpty():
            rows = _at_once(rows, last)
        else:
            rows = _at_once(rows.join(heavy, "parent", "left_anti"), last).unionByName(_by_halves(rows.join(heavy, "parent", "left_semi"), last).select(
                "parent", "t", "cap", "block", "low", "logs"))
        mask = F.when(F.col("cap") != 0, F.col("cap")).otherwise(3)
        low = F.col("low") + F.when(F.col("cap") == 0, 1).otherwise(0)
        risen = checkpoint(_summed(rows.select(F.col("parent").alias("child"), "t", mask.alias("mask"), "block", low.cast("int").alias("low"), "logs"), ["child", "t", "mask"]))
    whole = _summed(risen.select("t", "block", "low", "logs"), ["t"])
    cells = whole.select("t", "block", "low", F.posexplode("logs").alias("at", "log")).filter(F.col("log") > float("-inf"))
    k, n = F.col("block") * poly.BLOCK + F.col("at") % poly.BLOCK, F.col("t").cast("double")
    cells = cells.filter(k <= F.lit(most) if most is not None else 2 * k <= F.col("t"))
    chance = F.col("log") - (log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0))
    ks = F.array(k) if most is not None else F.when(2 * k == F.col("t"), F.array(k)).otherwise(F.array(k, F.col("t") - k))
    return cells.select(F.explode(ks).alias("k"), (F.col("low") + F.floor(F.col("at") / poly.BLOCK)).cast("int").alias("changes"),
                        F.least(chance, F.lit(0.0)).alias("log_share")).withColumn("share", F.exp("log_share"))


def exact_test(tree: Tree, presence: DataFrame) -> DataFrame:
    """Parsimony against the exact null: ``(gene, n_tips, changes_observed, changes_expected, p_clumped)``.

    Genes on no tip or on all tips get NULLs.  ``presence(gene, tip)``; carriers outside the tree are ignored.
    """
    present = checkpoint(presence.select("gene", "tip").distinct())
    on_tree = present.join(tree.tips, "tip", "left_semi").groupBy("gene").agg(F.count("*").alias("n_tips"))
    genes = (present.select("gene").distinct().join(on_tree, "gene", "left").join(fitch_changes(tree, present, ["gene"]), "gene", "left")
             .select("gene", F.coalesce("n_tips", F.lit(0)).alias("n_tips"), F.coalesce("changes", F.lit(0)).alias("changes_observed")))
    # presence and absence can be swapped without a change of score, so only the smaller side is placed
    tested = checkpoint(genes.filter((F.col("n_tips") > 0) & (F.col("n_tips") < tree.n_tips)).withColumn("k", F.least("n_tips", tree.n_tips - F.col("n_tips"))))
    null = checkpoint(exact_null(tree, tested.agg(F.max("k")).first()[0] or 0))
    at_most = Window.partitionBy("k").orderBy("changes")
    known = null.select("k", F.col("changes").alias("changes_observed"), F.sum("share").over(at_most).alias("p_clumped"))
    mean = null.groupBy("k").agg(F.sum(F.col("changes") * F.col("share")).alias("changes_expected"))
    tested = tested.join(known, ["k", "changes_observed"]).join(mean, "k")
    return genes.join(tested.select("gene", "changes_expected", "p_clumped"), "gene", "left").select(
        "gene", "n_tips", "changes_observed", "changes_expected", "p_clumped")


def check_overlap(tree: Tree, strains: DataFrame) -> int:
    """Tips that match a strain label; no match at all is an error, not an empty result."""
    matched = tree.tips.join(strains.select(F.col("strain").alias("tip")).distinct(), "tip", "left_semi").count()
    if matched == 0:
        raise ValueError("no tree tip matches a strain label; every gene would look untestable")
    return matched


def neighbor_joining(distances: DataFrame) -> DataFrame:
    """Neighbour-joining tree of ``(a, b, distance)``, one row per unordered pair.

    The matrix stays distributed in both orders.  Each join takes one aggregation for the
    smallest corrected distance, ties by name, and one narrow update; only the joined pair
    and its two row sums reach the driver.  Returns ``(node, parent, length)`` with an
    unrooted centre of degree three as root.
    """
    spark = distances.sparkSession
    both = distances.select("a", "b", F.col("distance").cast("double").alias("d"))
    d = checkpoint(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")))
    left = d.select("a").distinct().count()
    rows: list[tuple[str, str | None, float]] = []
    made = 0
    while left > 3:
        sums = d.groupBy("a").agg(F.sum("d").alias("r"))
        q = (d.filter("a < b").join(sums.withColumnRenamed("r", "ra"), "a")
             .join(sums.select(F.col("a").alias("b"), F.col("r").alias("rb")), "b")
             .withColumn("q", F.round((left - 2) * F.col("d") - F.col("ra") - F.col("rb"), 12)))
        best = q.agg(F.min(F.struct("q", "a", "b", "d", "ra", "rb")).alias("m")).first().m
        node = f"inner_{made}"
        made += 1
        to_a = best.d / 2 + (best.ra - best.rb) / (2 * (left - 2))
        rows += [(best.a, node, to_a), (best.b, node, best.d - to_a)]
        near = d.filter(F.col("a").isin(best.a, best.b) & ~F.col("b").isin(best.a, best.b))
        fresh = near.groupBy("b").agg(((F.sum("d") - F.lit(best.d)) / 2).alias("d")).select(F.lit(node).alias("a"), "b", "d")
        rest = d.filter(~F.col("a").isin(best.a, best.b) & ~F.col("b").isin(best.a, best.b))
        d = checkpoint(rest.unionByName(fresh).unionByName(
            fresh.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).coalesce(max(1, left // 1000)))
        left -= 1
    last = {(r.a, r.b): r.d for r in d.collect()}      # at most three taxa
    names = sorted({a for a, _ in last})
    if len(names) == 3:
        root = f"inner_{made}"
        for x in names:
            y, z = (n for n in names if n != x)
            rows.append((x, root, (last[x, y] + last[x, z] - last[y, z]) / 2))
        rows.append((root, None, 0.0))
    elif len(names) == 2:
        rows += [(names[0], "inner_0", last[tuple(names)] / 2), (names[1], "inner_0", last[tuple(names)] / 2),
                 ("inner_0", None, 0.0)]
    return spark.createDataFrame(rows, "node string, parent string, length double")


def clades(tree: Tree) -> DataFrame:
    """Each node's tips as a count and an order-free key: ``(node, n_tips, clade)``.

    Keys of children combine by XOR, so no node ever gathers the names below it.
    """
    done, risen = None, None
    for depth in range(tree.max_depth, -1, -1):
        here = tree.level(depth).filter("is_tip").select(
            "node", F.lit(1).cast("bigint").alias("n_tips"), portable_hash(F.col("node")).alias("clade"))
        here = here if risen is None else here.unionByName(risen)
        done = here if done is None else done.unionByName(here)
        met = here.join(tree.level(depth).select("node", "parent"), "node").groupBy(F.col("parent").alias("node"))
        risen = checkpoint(met.agg(F.sum("n_tips").alias("n_tips"), F.bit_xor("clade").alias("clade")))
    return done


def _way_down(tree: Tree) -> DataFrame:
    """Deepest tip of every node: ``(node, deep, deep_tip)``, level by level."""
    done, risen = None, None
    for depth in range(tree.max_depth, -1, -1):
        here = tree.level(depth).filter("is_tip").select("node", F.lit(0.0).alias("deep"), F.col("node").alias("deep_tip"))
        here = here if risen is None else here.unionByName(risen)
        done = here if done is None else done.unionByName(here)
        best = here.join(tree.level(depth).select("node", "parent", "length"), "node").groupBy("parent").agg(
            F.max(F.struct((F.col("deep") + F.col("length")).alias("deep"), "deep_tip")).alias("m"))
        risen = checkpoint(best.select(F.col("parent").alias("node"), "m.deep", "m.deep_tip"))
    return done


def _way_up(tree: DataFrame, tip: str) -> dict:
    """Rows of the nodes from a tip to the root: the known part of the way doubles with each step."""
    jump = checkpoint(tree.select("node", F.col("parent").alias("up")))
    way = tree.filter(F.col("node") == tip).select("node")
    while True:
        more = jump.filter("up IS NOT NULL").join(way, "node").select(F.col("up").alias("node"))
        if more.isEmpty():
            break
        way = checkpoint(way.unionByName(more).distinct())
        jump = checkpoint(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("over")), "up", "left").select("node", F.col("over").alias("up")))
    return {r.node: r for r in tree.join(way, "node").select("node", "parent", "length").collect()}     # one row for each level


def midpoint_root(shaped: Tree) -> DataFrame:
    """Reroot halfway along the longest tip-to-tip path; returns ``(node, parent, length)``.

    The path's top is the node with the largest sum of its two deepest branches.  Only the
    nodes on that path change parent.
    """
    tree = shaped.nodes
    deep = _way_down(shaped)
    branch = deep.join(tree.select("node", "parent", "length"), "node").filter("parent IS NOT NULL").select(
        "parent", "node", (F.col("deep") + F.col("length")).alias("reach"), "deep_tip")
    branch = checkpoint(branch)
    first = branch.groupBy("parent").agg(F.max(F.struct("reach", "deep_tip", "node")).alias("one"))
    second = (branch.join(first, "parent").filter(F.col("node") != F.col("one.node"))
              .groupBy("parent").agg(F.max("reach").alias("two")))
    widest = (first.join(second, "parent").select("parent", (F.col("one.reach") + F.col("two")).alias("span"), "one.deep_tip")
              .orderBy(F.desc("span"), "parent").first())
    half, tip = widest.span / 2, widest.deep_tip
    above = _way_up(tree, tip)
    node, climbed = tip, 0.0
    while above[node].parent is not None and climbed + above[node].length < half:
        climbed += above[node].length
        node = above[node].parent
    low, high, into = node, above[node].parent, half - climbed
    if high is None:
        return tree.select("node", "parent", "length")
    flipped, length, at = [], above[node].length - into, high
    changed = [(low, "midpoint", into)]
    while at is not None:
        flipped.append((at, flipped[-1][0] if flipped else "midpoint", length))
        length, at = above[at].length, above[at].parent
    changed += flipped + [("midpoint", None, 0.0)]
    spark = tree.sparkSession
    moved = spark.createDataFrame(changed, "node string, parent string, length double")
    kept = tree.select("node", "parent", "length").join(moved.select("node"), "node", "left_anti")
    merged = kept.unionByName(moved)
    # an old root left with one child is a joint in an edge: drop it
    kids = merged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n"), F.first("node").alias("only"))
    joint = kids.filter("n = 1").select("node", "only")
    inner = merged.join(joint, "node").select("only", F.col("node").alias("joint"), F.col("parent").alias("above"),
                                              F.col("length").alias("extra"))
    return (merged.join(joint, "node", "left_anti").join(inner, merged["node"] == inner["only"], "left")
            .select("node", F.coalesce("above", "parent").alias("parent"),
                    (F.col("length") + F.coalesce("extra", F.lit(0.0))).alias("length")))
