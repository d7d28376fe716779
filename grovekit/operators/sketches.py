"""Look-ahead sketches: what a subtree holds below a node, by label or by downward runs of labels, discounted by depth and bounded in size.

A node's own tokens count 1 for its parent, ``discount`` for its grandparent, and so on. A tree is one row, as in the tree index, and the trees of a part of a batch are one forest. Its sketches
are built by depth, the lowest nodes first: what the nodes of a depth hand up is summed by (parent, token), and the heaviest ``size`` tokens are kept. So
nodes are shuffled once and sketches never, and the bound holds at each node on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions import kernels
from grovekit.operators.trees import packed

#: Trees of a batch are sketched together up to so many nodes.
FOREST_NODES = 200_000


def labelled_index(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """The tree index with each node's label."""
    return index.join(nodes.select(F.col("tree_id").cast("string").alias("tree_id"), "u", "label"), ["tree_id", "u"])


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _summed(node: np.ndarray, token: np.ndarray, mass: np.ndarray, kinds: int, size: int | None) -> Rows:
    """The masses by (node, token), and of each node the ``size`` tokens (None: all) of the largest mass; ties to the greater token."""
    keys, group = np.unique(node * np.int64(kinds) + token, return_inverse=True)
    mass = np.bincount(group, weights=mass, minlength=len(keys))
    keys, mass = keys[mass > 0], mass[mass > 0]
    node, token = np.divmod(keys, np.int64(kinds))
    if size is not None and len(node):
        order = np.lexsort((-token, -mass, node))
        new = np.concatenate(([True], node[order][1:] != node[order][:-1]))
        place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        kept = order[place < size]
        node, token, mass = node[kept], token[kept], mass[kept]
    return node, token, mass


def _runs(parent: np.ndarray, label: np.ndarray, kinds: np.ndarray, length: int, size: int | None) -> tuple[Rows, np.ndarray]:
    """(node, token, mass) of the downward runs of ``length`` labels that begin at a node, and each token's labels, in the order of the tokens. A label below 0 is in no run."""
    node = np.flatnonzero(label >= 0)
    token, mass = label[node], np.ones(len(node))
    for _ in range(length - 1):
        up = parent[node]
        there = (up >= 0) & (label[up] >= 0)
        node, token, mass = up[there], token[there], mass[there]
        both, token = np.unique(label[node] * np.int64(len(kinds)) + token, return_inverse=True)
        kinds = np.column_stack((both // max(len(kinds), 1), kinds[both % max(len(kinds), 1)]))
        node, token, mass = _summed(node, token, mass, max(len(kinds), 1), size)
    return (node, token, mass), kinds


def forest_sketches(parent: np.ndarray, tree: np.ndarray, label: np.ndarray, words: int, size: int | None, discount: float, length: int) -> tuple[Rows, np.ndarray]:
    """The sketches of all nodes of a forest, its deepest level first: (node, token, mass), and each token's labels.

    ``tree`` has the number of each node's tree; the whole tree t is node len(parent) + t. Labels are numbers below ``words`` in the labels' order, or below 0: none.
    """
    (node, token, mass), kinds = _runs(parent, label, np.arange(words)[:, None], length, size)
    levels, n = kernels.levels(parent), len(parent)
    depth = np.empty(n, np.int64)
    for d, level in enumerate(levels):
        depth[level] = d
    order = np.argsort(depth[node], kind="stable")
    node, token, mass = node[order], token[order], mass[order]
    edges = np.searchsorted(depth[node], np.arange(len(levels) + 1))
    found, held = [], (node[:0], token[:0], mass[:0])
    for d in reversed(range(len(levels))):  # what the nodes of this depth hand to their parents: their own tokens and what they hold
        own = slice(edges[d], edges[d + 1])
        below, tokens = np.concatenate((node[own], held[0])), np.concatenate((token[own], held[1]))
        up = np.where(parent[below] >= 0, parent[below], n + tree[below])
        held = _summed(up, tokens, np.concatenate((mass[own], discount * held[2])), max(len(kinds), 1), size)
        found.append(held)
    node, token, mass = (np.concatenate(x) for x in zip(*found, strict=True))
    return (node, token, mass), kinds


def lookahead_sketches(nodes: DataFrame, size: int | None = 32, discount: float = 0.85, run_length: int | None = None) -> DataFrame:
    """(tree_id, u, token, mass) of the strict descendants of each node of ``nodes(tree_id, u, parent, label)``, and of the whole tree as node -1.

    Tokens are arrays of labels: single ones, or runs of ``run_length``. A null label is no token. The root adds 1 to node -1, and all below it ``discount`` times their mass.
    """

    def sketched(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.asarray(part.column("parent").value_lengths(), np.int64)
        own, labels = np.asarray(part.column("parent").flatten(), np.int64), part.column("label").flatten().dictionary_encode()
        tree, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        order = np.asarray(pc.sort_indices(labels.dictionary), np.int64)  # by bytes, as Spark orders texts
        rank = np.empty(len(order) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(order)), -1
        label = rank[np.asarray(labels.indices.fill_null(-1), np.int64)]
        (node, token, mass), kinds = forest_sketches(np.where(own >= 0, own + start[tree], -1), tree, label, len(order), size, discount, run_length or 1)
        whole = node >= len(own)
        at = np.where(whole, node - len(own), tree[np.where(whole, 0, node)])
        words = labels.dictionary.take(pa.array(order[kinds[token].ravel()]))
        tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(token) + 1) * kinds.shape[1], pa.int32()), words)
        u = np.where(whole, -1, node - start[at])
        return pa.RecordBatch.from_arrays([part.column("tree_id").take(pa.array(at)), pa.array(u, pa.int32()), tokens, pa.array(mass, pa.float64())], names=["tree_id", "u", "token", "mass"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(np.asarray(batch.column("parent").value_lengths(), np.int64)), 0
            while at < len(ends):  # whole trees, as many as fit
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FOREST_NODES, side="right")))
                yield sketched(batch.slice(at, to - at))
                at = to

    plain = nodes.select("tree_id", "u", "parent", F.col("label").cast("string").alias("label"))
    return packed(plain).mapInArrow(run, "tree_id string, u int, token array<string>, mass double")


def sketch_overlap(pairs: DataFrame, sketches: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(g, h, u, v, look): the smaller mass of each token that both nodes' sketches have, times what its labels weigh, summed; ``pairs(g, h, u, v)``.

    ``weights(key, value)`` weighs equal labels, 1 without it; a run weighs the sum of its labels, and nothing if one of them weighs nothing. Pairs without a common token have no row.
    """
    left = sketches.select(F.col("tree_id").alias("g"), "u", "token", F.col("mass").alias("a"))
    right = sketches.select(F.col("tree_id").alias("h"), F.col("u").alias("v"), "token", F.col("mass").alias("b"))
    both = pairs.select("g", "h", "u", "v").join(left, ["g", "u"]).join(right, ["h", "v", "token"])
    if weights is None:
        return both.groupBy("g", "h", "u", "v").agg(F.sum(F.least("a", "b") * F.size("token")).alias("look"))
    distinct = sketches.select("token").distinct()
    parts = distinct.select("token", F.posexplode("token").alias("n", "key")).join(weights, "key", "left").groupBy("token")
    worth = parts.agg(F.sum("value").alias("worth"), F.min(F.coalesce("value", F.lit(0.0))).alias("least")).where("least > 0").drop("least")
    return both.join(worth, "token").groupBy("g", "h", "u", "v").agg(F.sum(F.least("a", "b") * F.col("worth")).alias("look"))
