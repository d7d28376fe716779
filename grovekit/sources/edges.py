"""Trees from edge lists: what is wrong with them, and the nodes renumbered so that parents come first, with their own ids kept.

``nodes(tree_id, id, ...)`` are the nodes of all trees and ``edges(tree_id, src, dst)`` go from parent to child. Depths come from pointer doubling: in each round a node
learns its ancestor twice as far up, so there are as many rounds as the logarithm of the depth, and nodes that never get to a root lie on a cycle or below one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.operators.trees import timestamp_order
from grovekit.sources.storage import checkpointed

ISSUES = ("unknown_nodes", "self_loops", "many_parents", "roots", "unreachable")


def _parents(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree_id, id, parent, n_parents) of all nodes, by edges between two different known nodes (the smallest parent, if there are more); and the counts of the other edges."""
    known = nodes.select("tree_id", "id").distinct()
    own = edges.select("tree_id", "src", "dst")
    ends = own.join(known.select("tree_id", F.col("id").alias("src"), F.lit(1).alias("a")), ["tree_id", "src"], "left").join(known.select("tree_id", F.col("id").alias("dst"), F.lit(1).alias("b")), ["tree_id", "dst"], "left")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    odd = ends.groupBy("tree_id").agg(F.sum((~both).cast("long")).alias("unknown_nodes"), F.sum((both & (F.col("src") == F.col("dst"))).cast("long")).alias("self_loops"))
    up = ends.where(both & (F.col("src") != F.col("dst"))).groupBy("tree_id", F.col("dst").alias("id")).agg(F.min("src").alias("parent"), F.countDistinct("src").alias("n_parents"))
    return known.join(up, ["tree_id", "id"], "left").fillna(0, ["n_parents"]), odd


def node_depths(parents: DataFrame) -> DataFrame:
    """``parents(tree_id, id, parent)`` (null: a root) with ``depth``, null for nodes that no root is above of."""
    now = checkpointed(parents.select("tree_id", "id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps")))
    largest = parents.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 0
    for _ in range(int(largest).bit_length()):
        if now.where("up IS NOT NULL").isEmpty():
            break
        above = now.select("tree_id", F.col("id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        # a node whose ancestor is a root has got there: its steps count up to it
        now = checkpointed(now.join(above, ["tree_id", "up"], "left").select("tree_id", "id", F.col("further").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return parents.join(now.select("tree_id", "id", F.when(F.col("up").isNull(), F.col("steps")).alias("depth")), ["tree_id", "id"])


def edge_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per tree: n, unknown_nodes (edges with an end that isn't a node), self_loops, many_parents (nodes with more than one parent), roots, unreachable (nodes on or below a cycle).

    A tree is sound with one root and nothing else. Unknown ends and self-loops don't count as parents.
    """
    parents, odd = _parents(nodes, edges)
    depths = node_depths(parents)
    counts = depths.groupBy("tree_id").agg(
        F.count("*").alias("n"), F.sum((F.col("n_parents") > 1).cast("long")).alias("many_parents"), F.sum(F.col("parent").isNull().cast("long")).alias("roots"), F.sum(F.col("depth").isNull().cast("long")).alias("unreachable")
    )
    return counts.join(odd, "tree_id", "left").fillna(0, ["unknown_nodes", "self_loops"]).select("tree_id", "n", *ISSUES)


def sound() -> str:
    return "unknown_nodes = 0 AND self_loops = 0 AND many_parents = 0 AND roots = 1 AND unreachable = 0"


def _paths(parents: DataFrame) -> DataFrame:
    """(tree_id, id, path): the ids from the root down to the node, by doubling."""
    now = checkpointed(parents.select("tree_id", "id", F.col("parent").alias("up"), F.array("id").alias("path")))
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select("tree_id", F.col("id").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        now = checkpointed(now.join(above, ["tree_id", "up"], "left").select("tree_id", "id", F.col("further").alias("up"), F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path")))
    return now.select("tree_id", "id", "path")


def trees_from_edges(nodes: DataFrame, edges: DataFrame, order: str = "auto", strict: bool = True) -> DataFrame:
    """(tree_id, u, parent, label, orig, ...): ``nodes(tree_id, id, label, ...)`` numbered from 0 with parents first (-1: the root); ``orig`` is the node's id.

    ``preorder``: children by their ids. ``time``: always the earliest (ts, id) whose parent is taken. ``given``: the ids as they are, an error where they don't put parents first. ``auto``: the ids
    where they are 0 to n - 1 with the root 0 and parents before children, else preorder. ``strict`` raises if a tree isn't sound; without it such trees are left out.
    A repeated id in a tree is one node by its first row.
    """
    if order not in ("auto", "given", "preorder", "time"):
        raise ValueError(f"order is auto, given, preorder or time, not {order}")
    issues = checkpointed(edge_issues(nodes, edges))
    bad = issues.where(f"NOT ({sound()})")
    if strict and not bad.isEmpty():
        raise ValueError(f"not a rooted tree: {bad.limit(5).collect()}")
    parents = _parents(nodes, edges)[0].join(issues.where(sound()).select("tree_id", "n"), "tree_id")
    tidy = ((F.col("id") == 0) & F.col("parent").isNull()) | ((F.col("id") > 0) & (F.col("id") < F.col("n")) & (F.col("parent") < F.col("id")))
    kept = F.min(F.coalesce(tidy, F.lit(False))).over(W.partitionBy("tree_id"))
    marked = checkpointed(parents.withColumn("kept", kept if order in ("auto", "given") else F.lit(False)))
    if order == "given" and not marked.where("NOT kept").isEmpty():
        raise ValueError("the given order does not put parents first")
    if order == "time":
        numbered = _by_time(marked, nodes)
    else:
        walked = _paths(marked.where("NOT kept"))
        number = F.row_number().over(W.partitionBy("tree_id").orderBy("path")) - 1
        numbered = marked.where("kept").select("tree_id", "id", F.col("id").cast("int").alias("u")).unionByName(walked.select("tree_id", "id", number.cast("int").alias("u")))
    placed = marked.join(numbered, ["tree_id", "id"]).select("tree_id", "id", "parent", "u")
    ups = numbered.select("tree_id", F.col("id").alias("parent"), F.col("u").alias("up"))
    out = placed.join(ups, ["tree_id", "parent"], "left").select("tree_id", F.col("id"), "u", F.coalesce("up", F.lit(-1)).alias("parent"))
    return out.join(nodes.dropDuplicates(["tree_id", "id"]), ["tree_id", "id"]).withColumnRenamed("id", "orig")


def _by_time(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = parents.join(nodes.dropDuplicates(["tree_id", "id"]).select("tree_id", "id", F.col("ts").cast("double").alias("ts")), ["tree_id", "id"])
    trees = rows.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("id", "parent", "ts"))).alias("r")).select("tree_id", "r.id", "r.parent", "r.ts")
    kind = dict(nodes.dtypes)

    def run(batches):
        for batch in batches:
            ids, us, trees_of = [], [], []
            for at, (own, up, ts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "parent", "ts")), strict=True)):
                place = {x: i for i, x in enumerate(own)}
                found = timestamp_order([-1 if p is None else place[p] for p in up], [float("-inf") if t is None else t for t in ts])
                ids += [own[i] for i in found]
                us += range(len(found))
                trees_of += [at] * len(found)
            tree = batch.column("tree_id").take(pa.array(trees_of, pa.int64()))
            yield pa.RecordBatch.from_arrays([tree, pa.array(ids, batch.column("id").type.value_type), pa.array(np.array(us, np.int32))], names=["tree_id", "id", "u"])

    return trees.mapInArrow(run, f"tree_id {kind['tree_id']}, id {kind['id']}, u int")


def timed_trees(trees: DataFrame, timestamps: DataFrame) -> DataFrame:
    """``trees(tree_id, u, parent, ...)`` renumbered by ``timestamps(tree_id, orig, ts)`` of their original ids (``orig``, else u); a node without one comes first."""
    own = trees if "orig" in trees.columns else trees.withColumn("orig", F.col("u"))
    ups = own.select("tree_id", F.col("u").alias("parent"), F.col("orig").alias("src"))
    edges = own.where("parent >= 0").join(ups, ["tree_id", "parent"]).select("tree_id", "src", F.col("orig").alias("dst"))
    timed = own.drop("ts", "u", "parent").join(timestamps.select("tree_id", "orig", "ts"), ["tree_id", "orig"], "left").withColumnRenamed("orig", "id")
    return trees_from_edges(timed, edges, "time")
