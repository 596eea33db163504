"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(a, b); root is one node for each component.

    Each round hooks every node to its smallest neighbour, follows two more
    hooks, and joins the links to what is left. A node that isn't the smallest
    around it vanishes, so the rounds are at most the logarithm of the nodes.
    Nothing but counts reaches the driver; what a round makes is written to the
    shared folder, so lineage stays short. A node with very many links is
    aggregated before the shuffle, and its joins are left to AQE's splitting.
    Loops, links with a null end and repeated links are ignored; other columns
    are, too; an empty table gives an empty result.
    """
    spark = links.sparkSession
    edges, old = C.cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots, roots_path = None, None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "next")
        hooks, p1 = C.cut(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("up")), "hooks")
        far = hooks
        for _ in range(2):
            up = hooks.select(F.col("node").alias("up"), F.col("up").alias("above"))
            far = far.join(up, "up").select("node", F.col("above").alias("up"))
        far, p2 = C.cut(far, "hooks")
        a, b = far.toDF("a", "ua"), far.toDF("b", "ub")
        moved = edges.join(a, "a").join(b, "b").where("ua <> ub")
        edges, new = C.cut(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
        if roots is None:
            roots, p3 = far.toDF("node", "root"), p2
        else:
            step = far.toDF("root", "above")
            roots, p3 = C.cut(roots.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
            C.drop(spark, p2, roots_path)
        C.drop(spark, p1, old)
        roots_path, old = p3, new
    return roots if roots is not None else edges.toDF("node", "root")
