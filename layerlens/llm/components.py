"""Connected components of a table of links, by alternating stars.

The links stay a table throughout. Every round replaces them with links to smaller ids: the
large star hangs the greater neighbours of a node on its least neighbour, the small star the
lesser ones. The rounds end when all nodes hang directly on the least node of their component,
after about log(n) rounds. Minima are partial aggregates and the joins are plain equi-joins,
so that a hub's links can be split by adaptive execution; each round is stored in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from layerlens.session import Scratch


def _smaller_first(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one itself."""
    parents = links.groupBy("a").agg(F.count("*").alias("n"))
    twice = parents.where("n > 1").select("a")
    inner = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi")
    return twice.unionAll(inner).isEmpty()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """From links (a long, b long) to (node, root): the least node reachable from each node.

    Nodes that are their own root have no row. Null ids are not allowed; repeated links, links
    in both directions, links of a node to itself and an empty table are. Each round's table is
    deleted after the next one; the result is a table of `scratch`.
    """
    scratch = scratch or Scratch(links.sparkSession)
    links = scratch.written(_smaller_first(links).withColumnsRenamed({"a": "node", "b": "root"}), "links")
    stored, links = links, links.withColumnsRenamed({"node": "a", "root": "b"})
    while not _is_forest_of_stars(links):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = lower.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        last, stored = stored, scratch.written(small.withColumnsRenamed({"a": "node", "b": "root"}), "links")
        scratch.drop(last)
        links = stored.withColumnsRenamed({"node": "a", "root": "b"})
    return stored
