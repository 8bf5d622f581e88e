"""Connected components of a table of links, by repeated contraction.

Every round hooks each node to its smallest neighbour, flattens the resulting trees by pointer doubling, and
replaces links by links between trees.  A star, however large, contracts in one round.  Each step is a grouped
minimum or a join on a node that is unique on one side, and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; ``root`` is the smallest node it can reach.

    Links are undirected; loops and repeats do no harm; an empty table gives an empty table; links with a NULL
    end are left out.
    """
    edges = store(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(),
        "links",
    )
    nodes = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        roots = _flatten(store(hooked, "hooked"))
        nodes = roots if nodes is None else store(_through(nodes, roots), "nodes")
        if edges.isEmpty():
            return nodes
        left, right = (
            roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("a", "b")
        )
        edges = store(
            edges.join(left, "a").join(right, "b").where("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(),
            "links",
        )
        if edges.isEmpty():
            return nodes


def _through(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Send every root on to where it went itself."""
    further = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
    return nodes.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))


def _flatten(hooked: DataFrame) -> DataFrame:
    """Follow parents to the top; the length of every path halves with each join."""
    while True:
        parents = hooked.where("node <> root")
        if hooked.join(parents.select(F.col("node").alias("root")), "root", "left_semi").isEmpty():
            return hooked
        hooked = store(_through(hooked, parents), "hooked")
