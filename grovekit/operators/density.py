"""Clusters by density from a table of distances: mutual reachability, its spanning tree, and the clusters of a cut.

The distances may be of near pairs only (a kNN graph); pairs that aren't there are far. The spanning tree grows by contraction (Boruvka): each component takes its shortest
edge out, components that are joined become one by pointer doubling, and of parallel edges the shortest stays. Components at least halve, so there are as many rounds as the
logarithm of the trees, and no task sees more than the edges that leave one component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.sources.storage import checkpointed


def core_distances(distances: DataFrame, k: int = 5) -> DataFrame:
    """(tree_id, core): the distance to the k-th nearest tree of ``distances(g, h, distance)``; trees with fewer have none."""
    both = distances.select(F.col("g").alias("tree_id"), F.col("h").alias("other"), "distance").unionByName(distances.select(F.col("h").alias("tree_id"), F.col("g").alias("other"), "distance"))
    place = F.row_number().over(W.partitionBy("tree_id").orderBy("distance", "other"))
    return both.withColumn("place", place).where(F.col("place") == k).select("tree_id", F.col("distance").alias("core"))


def mutual_reachability(distances: DataFrame, k: int = 5) -> DataFrame:
    """(g, h, w), g < h: the largest of the distance and both core distances; a tree without a core distance has no row."""
    core = core_distances(distances, k)
    near = distances.join(core.select(F.col("tree_id").alias("g"), F.col("core").alias("a")), "g").join(core.select(F.col("tree_id").alias("h"), F.col("core").alias("b")), "h")
    ordered = near.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), F.greatest("distance", "a", "b").alias("w")).where("g <> h")
    return ordered.groupBy("g", "h").agg(F.min("w").alias("w"))


def _roots(parents: DataFrame) -> DataFrame:
    """(c, root) of ``parents(c, p)``, a forest in which roots are their own parents."""
    now = checkpointed(parents)
    while True:
        up = now.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        after = checkpointed(now.join(up, "p").select("c", "p", "pp"))
        if after.where("p <> pp").isEmpty():
            return after.select("c", F.col("p").alias("root"))
        now = after.select("c", F.col("pp").alias("p"))


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (g, h, w) of the minimum spanning forest of ``edges(g, h, w)``, ties by (g, h), and (tree_id, root): which of its trees a node is in."""
    live = checkpointed(edges.where("g <> h").select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), "w").groupBy("g", "h").agg(F.min("w").alias("w")).withColumn("a", F.col("g")).withColumn("b", F.col("h")))
    ends = live.select(F.col("g").alias("tree_id")).unionByName(live.select(F.col("h").alias("tree_id"))).distinct()
    labels, chosen = checkpointed(ends.withColumn("root", F.col("tree_id"))), live.select("g", "h", "w").limit(0)
    while not live.isEmpty():
        out = live.select(F.col("a").alias("c"), F.col("b").alias("p"), "w", "g", "h").unionByName(live.select(F.col("b").alias("c"), F.col("a").alias("p"), "w", "g", "h"))
        best = checkpointed(out.groupBy("c").agg(F.min(F.struct("w", "g", "h", "p")).alias("x")).select("c", "x.*"))
        chosen = chosen.unionByName(best.select("g", "h", "w").distinct())
        back = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        # two components that chose the same edge point at each other: the smaller one is a root
        roots = _roots(best.join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        names = roots.select(F.col("c").alias("root"), F.col("root").alias("new"))
        labels = checkpointed(labels.join(names, "root", "left").select("tree_id", F.coalesce("new", "root").alias("root")))
        moved = live.join(roots.select(F.col("c").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("c").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        parallel = moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct("w", "g", "h")).alias("x"))
        live = checkpointed(parallel.select("x.g", "x.h", "x.w", "a", "b"))
    return chosen, labels


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(g, h, w) of the minimum spanning forest of ``edges(g, h, w)``."""
    return contracted(edges)[0]


def density_clusters(trees: DataFrame, tree_edges: DataFrame, at: float, least: int = 5) -> DataFrame:
    """(tree_id, cluster): the spanning tree's components when edges longer than ``at`` are cut, named by their smallest tree; null (noise) for fewer than ``least`` trees.

    ``tree_edges`` is the result of spanning_tree on the mutual reachability, so one tree serves all cuts; every row of ``trees(tree_id)`` has one here.
    """
    labels = contracted(tree_edges.where(F.col("w") <= at))[1]
    named = trees.select("tree_id").distinct().join(labels, "tree_id", "left").withColumn("root", F.coalesce("root", "tree_id"))
    sized = named.groupBy("root").agg(F.count("*").alias("n"), F.min("tree_id").alias("name"))
    return named.join(sized, "root").select("tree_id", F.when(F.col("n") >= least, F.col("name")).alias("cluster"))
