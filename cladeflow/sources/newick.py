"""Newick text to tree tables and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.common import checkpoint
from cladeflow.operators.tree import Tree

_TOKENS = re.compile(r"[(),;]|[^(),;]+")


def _nodes(text: str) -> list[tuple[str, str | None, float]]:
    """Node, parent, length.  Tip names keep their underscores; inner nodes are numbered."""
    rows: list[list] = [["", None, 0.0]]
    at, made = 0, 0
    for token in _TOKENS.findall(text.strip()):
        if token == "(":
            rows.append(["", at, 0.0])
            at = len(rows) - 1
        elif token == ",":
            rows.append(["", rows[at][1], 0.0])
            at = len(rows) - 1
        elif token == ")":
            at = rows[at][1]
        elif token == ";":
            break
        elif token.strip():
            name, _, length = token.strip().partition(":")
            rows[at][0] = name.strip().strip("'")
            rows[at][2] = float(length) if length else 0.0
    parents = {r[1] for r in rows}
    for i, r in enumerate(rows):
        if i in parents:                # inner labels are support values or repeat: number the nodes
            r[0] = f"inner_{made}"
            made += 1
    return [(n, None if p is None else rows[p][0], d) for n, p, d in rows]


def parse_newick(trees: DataFrame) -> DataFrame:
    """``trees(tree, newick)`` -> ``(tree, node, parent, length)``, one small parse per tree."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, text in zip(pdf["tree"], pdf["newick"]):
                out = pd.DataFrame(_nodes(text), columns=["node", "parent", "length"])
                yield out.assign(tree=tree)[["tree", "node", "parent", "length"]]

    return trees.select("tree", "newick").mapInPandas(parse, "tree string, node string, parent string, length double")


def to_newick(tree: Tree) -> DataFrame:
    """One row ``(newick)``: subtrees are written level by level, children in name order."""
    branch = F.concat(F.col("text"), F.lit(":"), F.col("length").cast("string"))
    risen = None
    for depth in range(tree.max_depth, 0, -1):
        here = tree.level(depth).filter("is_tip").select("node", F.col("node").alias("text"))
        here = here if risen is None else here.unionByName(risen)
        kids = F.sort_array(F.collect_list(F.struct("node", branch.alias("b"))))
        joined = here.join(tree.level(depth).select("node", "parent", "length"), "node").groupBy("parent").agg(
            F.concat(F.lit("("), F.array_join(F.transform(kids, lambda x: x["b"]), ","), F.lit(")")).alias("text"))
        risen = checkpoint(joined.select(F.col("parent").alias("node"), "text"))
    root = tree.level(0).select(F.col("node").alias("text")) if risen is None else risen
    return root.select(F.concat("text", F.lit(";")).alias("newick"))
