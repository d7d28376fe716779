"""Checks, ordering and indexes of trees given as rows (tree_id, u, parent, label)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions import kernels

INDEX = "tree_id string, u int, parent int, depth int, height int, size int, tin int, tout int"


def validate(nodes: DataFrame) -> DataFrame:
    """Per tree, how often it breaks a rule: more than one root, a parent not before its child or not there, repeated numbers."""
    # a node and its mention as a parent meet in one sum, so nothing is joined and no set of numbers is held
    own = F.struct(F.col("u"), F.lit(1).alias("rows"), (F.col("parent") == -1).cast("int").alias("root"), (F.col("parent") >= F.col("u")).cast("int").alias("late"), F.lit(0).alias("asked"))
    nothing = F.lit(0)
    up = F.struct(F.when(F.col("parent") >= 0, F.col("parent")).alias("u"), nothing.alias("rows"), nothing.alias("root"), nothing.alias("late"), F.lit(1).alias("asked"))
    both = nodes.select("tree_id", F.explode(F.array(own, up)).alias("x")).select("tree_id", "x.*").where("rows = 1 OR u IS NOT NULL")
    numbers = both.groupBy("tree_id", "u").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("rows", "root", "late", "asked")])
    return numbers.groupBy("tree_id").agg(
        F.sum("rows").alias("n"),
        F.sum("root").alias("roots"),
        F.sum("late").alias("late_parents"),
        F.sum(F.when((F.col("rows") == 0) | F.col("tree_id").isNull(), F.col("asked")).otherwise(0)).alias("lost_parents"),
        F.sum(F.when(F.col("u").isNotNull() & (F.col("rows") > 1), F.col("rows") - 1).otherwise(0)).alias("repeated"),
    )


def packed(nodes: DataFrame, *extra: str) -> DataFrame:
    """One row per tree: tree_id, parent, label and the extra columns as arrays in order of u."""
    columns = ["parent", "label", *extra]
    rows = nodes.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("u", *columns))).alias("r"))
    return rows.select(F.col("tree_id").cast("string").alias("tree_id"), *[F.col(f"r.{c}").alias(c) for c in columns])


def index_arrays(parent: np.ndarray) -> dict[str, np.ndarray]:
    """depth, height, size, tin and tout (preorder, children by number; from 0 in each tree) of a tree or forest whose parents come first."""
    n, rows = len(parent), kernels.levels(parent)
    depth, height, size, tin = (np.full(n, x, np.int32) for x in (0, 0, 1, 0))
    for d, level in enumerate(rows):
        depth[level] = d
    for level in reversed(rows[1:]):
        up = parent[level]
        np.add.at(size, up, size[level])
        np.maximum.at(height, up, height[level] + 1)
    for level in rows[1:]:
        order = level[np.argsort(parent[level], kind="stable")]  # siblings side by side, by number
        up, before = parent[order], np.cumsum(size[order]) - size[order]
        first = np.concatenate(([True], up[1:] != up[:-1]))
        tin[order] = tin[up] + 1 + before - before[first][np.cumsum(first) - 1]
    return {"depth": depth, "height": height, "size": size, "tin": tin, "tout": tin + size}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All trees of a batch are indexed as one forest."""
    for batch in batches:
        parents = batch.column("parent")
        sizes = np.asarray(parents.value_lengths(), np.int64)
        own = np.asarray(parents.flatten(), np.int64)
        tree = np.repeat(np.arange(len(sizes)), sizes)
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        got = index_arrays(np.where(own >= 0, own + start, -1))
        yield pa.RecordBatch.from_pydict({"tree_id": batch.column("tree_id").take(pa.array(tree)), "u": pa.array((np.arange(len(own)) - start).astype(np.int32)), "parent": pa.array(own.astype(np.int32)), **got})


def tree_index(nodes: DataFrame) -> DataFrame:
    """One row per node: depth, height, size, tin, tout; parents have to come before their children."""
    return packed(nodes).select("tree_id", "parent").mapInArrow(_index, INDEX)


def ancestors(index: DataFrame) -> DataFrame:
    """(tree_id, anc, u, dist) of all strict ancestors, by the intervals of a tree_index."""
    up = index.select("tree_id", F.col("u").alias("anc"), F.col("tin").alias("a_in"), F.col("tout").alias("a_out"), F.col("depth").alias("a_depth"))
    return index.join(up, "tree_id").where("tin > a_in AND tin < a_out").select("tree_id", "anc", "u", (F.col("depth") - F.col("a_depth")).alias("dist"))


def exponential_count(nodes: DataFrame, base: int = 2) -> DataFrame:
    """Per node and label: the sum of base^distance over the nodes of its subtree with that label; base over 1.

    Built from the lowest depth up: a node's rows are its own label and its children's rows times ``base``. So there is as much work as there are rows in the result.
    """
    if base <= 1:
        raise ValueError("base must be over 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("parent").value_lengths(), np.int64)
            own, labels = np.asarray(batch.column("parent").flatten(), np.int64), batch.column("label").flatten()
            if not len(own):
                continue
            tree, start = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
            parent, coded = np.where(own >= 0, own + start, -1), labels.dictionary_encode(null_encoding="encode")
            code, kinds = np.asarray(coded.indices, np.int64), np.int64(len(coded.dictionary))
            found, keys, mass = [], np.empty(0, np.int64), np.empty(0)
            for level in reversed(kernels.levels(parent)):
                up = parent[keys // kinds] * kinds + keys % kinds  # what the level below hands up
                keys, group = np.unique(np.concatenate((level * kinds + code[level], up)), return_inverse=True)
                mass = np.bincount(group, weights=np.concatenate((np.ones(len(level)), base * mass)))
                found.append((keys, mass))
            keys, mass = (np.concatenate(x) for x in zip(*found, strict=True))
            node = keys // kinds
            columns = [batch.column("tree_id").take(pa.array(tree[node])), pa.array((node - start[node]).astype(np.int32)), coded.dictionary.take(pa.array(keys % kinds)), pa.array(mass)]
            yield pa.RecordBatch.from_arrays(columns, names=["tree_id", "u", "label", "mass"])

    return packed(nodes).mapInArrow(run, f"tree_id string, u int, label {dict(nodes.dtypes)['label']}, mass double")


def timestamp_order(parent: list[int], ts: list) -> list[int]:
    """The nodes in the order of a frontier that always takes the earliest (ts, number) node whose parent is taken."""
    children: list[list[int]] = [[] for _ in parent]
    for u, p in enumerate(parent):
        if p >= 0:
            children[p].append(u)
    frontier, out = [(ts[u], u) for u, p in enumerate(parent) if p < 0], []
    heapq.heapify(frontier)
    while frontier:
        _, u = heapq.heappop(frontier)
        out.append(u)
        for c in children[u]:
            heapq.heappush(frontier, (ts[c], c))
    return out


def timestamps_consistent(nodes: DataFrame) -> DataFrame:
    """Per tree: is no child earlier than its parent? A missing timestamp is inconsistent."""
    up = nodes.select("tree_id", F.col("u").alias("parent"), F.col("ts").alias("parent_ts"))
    edge = nodes.where("parent >= 0").join(up, ["tree_id", "parent"])
    bad = edge.groupBy("tree_id").agg(F.sum((~F.coalesce(F.col("parent_ts") <= F.col("ts"), F.lit(False))).cast("long")).alias("bad"))
    return nodes.select("tree_id").distinct().join(bad, "tree_id", "left").select("tree_id", (F.coalesce("bad", F.lit(0)) == 0).alias("consistent"))
