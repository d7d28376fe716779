"""Subtree matches: the best common embedding of two subtrees, children in order or not, with its pairs, for all requested roots of a pair of trees at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions import kernels
from grovekit.operators.matching import label_weights, scored_pairs, shared_nodes
from grovekit.operators.paths import PAIR_TYPE, PAIRS, keyed_weights
from grovekit.operators.trees import packed
from grovekit.operators.weights import KeyedWeight
from grovekit.sources.storage import checkpointed

SUBTREES = f"g string, h string, root_u int, root_v int, score double, pairs {PAIRS}"


def subtree_matches(pairs: DataFrame, nodes: DataFrame, ordered: bool = True, weight: KeyedWeight | None = None, by_time: bool = False) -> DataFrame:
    """(g, h, root_u, root_v, score, pairs) of ``pairs(g, h[, root_u, root_v])``; without roots, of the whole trees.

    Children are in the order of their numbers, or with ``by_time`` of their ``ts`` (a missing one first, ties by number); then the pairs come in the order of g's timestamps, else by u. A
    pair is in the result even if it weighs nothing, where its children's pairs need it. Rows that ask for one pair of trees share its table. A root that a tree
    doesn't have is an error.
    """
    trees = packed((weight or KeyedWeight()).keyed_nodes(nodes), *(["ts"] if by_time else []))
    columns = ["parent", "label", *(["ts"] if by_time else [])]
    # trees that are equal in all nodes are one kind; kinds are matched, and their pairs get the result
    hashed = checkpointed(trees.withColumn("kind", F.sha2(F.to_json(F.struct(*columns)), 256)))
    trees = hashed.groupBy(F.col("kind").alias("tree_id")).agg(*[F.min_by(c, "tree_id").alias(c) for c in columns])
    left = trees.select(F.col("tree_id").alias("g"), F.struct(*columns).alias("tree_g"))
    right = trees.select(F.col("tree_id").alias("h"), F.struct(*columns).alias("tree_h"))
    root = lambda c: F.col(c).cast("int") if c in pairs.columns else F.lit(0)
    asked = pairs.select(F.col("g").cast("string").alias("g"), F.col("h").cast("string").alias("h"), root("root_u").alias("u"), root("root_v").alias("v"))
    wanted = asked.groupBy("g", "h").agg(F.array_sort(F.collect_set(F.struct("u", "v"))).alias("roots"))

    def places(times: list) -> np.ndarray:
        order = sorted(range(len(times)), key=lambda u: (times[u] is not None, times[u] or 0, u))
        rank = np.empty(len(times), np.int64)
        for place, u in enumerate(order):
            rank[u] = rank[order[place - 1]] if place and times[u] == times[order[place - 1]] else place
        return rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                g, h = r["tree_g"], r["tree_h"]
                ranks = (places(g["ts"]), places(h["ts"])) if by_time else (None, None)
                roots = [(x["u"], x["v"]) for x in r["roots"]]
                for u, v in roots:
                    if not (0 <= u < len(g["parent"]) and 0 <= v < len(h["parent"])):
                        raise ValueError(f"a root lies outside tree bounds: {r['g']}, {r['h']}: {u}, {v}")
                if ordered or roots != [(0, 0)]:
                    found = kernels.subtree_matches(np.array(g["parent"]), np.array(h["parent"]), keyed_weights(g["label"], h["label"]), roots, ordered, ranks)
                else:  # without order, nodes that have nothing in common at or below them are in no match
                    keys = ([[k["key"] for k in t or ()] for t in side["label"]] for side in (g, h))
                    (p, us), (q, vs) = shared_nodes(g["parent"], h["parent"], *keys, closed=True)
                    some = kernels.subtree_matches(p, q, keyed_weights([g["label"][u] for u in us], [h["label"][v] for v in vs]), roots, ordered)
                    found = [(score, [(int(us[a]), int(vs[b])) for a, b in matched]) for score, matched in some]
                for (u, v), (score, matched) in zip(roots, found, strict=True):
                    if by_time:
                        matched = sorted(matched, key=lambda p, at=ranks[0]: (at[p[0]], p[0]))
                    out.append((r["g"], r["h"], u, v, score, [{"u": a, "v": b} for a, b in matched]))
            if out:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), PAIR_TYPE]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["g", "h", "root_u", "root_v", "score", "pairs"])

    g, h = (hashed.select(F.col("tree_id").alias(f"t_{c}"), F.col("kind").alias(c)) for c in ("g", "h"))
    named = wanted.select(F.col("g").alias("t_g"), F.col("h").alias("t_h"), "roots").join(g, "t_g").join(h, "t_h")
    found = named.select("g", "h", "roots").distinct().join(left, "g").join(right, "h").mapInArrow(run, SUBTREES)
    asked = named.select("g", "h", "t_g", "t_h", F.explode("roots").alias("r")).select("g", "h", "t_g", "t_h", F.col("r.u").alias("root_u"), F.col("r.v").alias("root_v"))
    return asked.join(found, ["g", "h", "root_u", "root_v"]).select(F.col("t_g").alias("g"), F.col("t_h").alias("h"), "root_u", "root_v", "score", "pairs")


def shared_subtrees(left: list[dict], right: list[dict], ordered: bool = True, cells: int = 2_000_000) -> np.ndarray:
    """Subtree scores of the whole packed trees ``left`` with each of ``right``, where equal labels weigh 1: (trees, trees). Some trees of both are two forests with one table of at most ``cells`` cells, or a single pair of trees."""
    scores, sides = np.zeros((len(left), len(right))), []
    for trees in (left, right):
        cuts, size = [0], 0
        for i, r in enumerate(trees):
            if size and size + len(r["parent"]) > cells**0.5:
                cuts.append(i)
                size = 0
            size += len(r["parent"])
        some = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(trees)], strict=True)]
        sides.append([(s, *kernels.forest([np.array(r["parent"]) for r in trees[s]]), [t for r in trees[s] for t in r["label"]]) for s in some])
    for at, g, starts_g, labels_g in sides[0]:
        for to, h, starts_h, labels_h in sides[1]:
            scores[at, to] = kernels.subtree_table(g, h, label_weights(labels_g, labels_h, None), ordered)[np.ix_(starts_g, starts_h)]
    return scores


def all_pair_subtrees(nodes: DataFrame, ordered: bool = True, **planned) -> DataFrame:
    """(g, h, score), g < h as text, of the whole trees of all pairs, where equal labels weigh 1. ``planned`` as in ``scored_pairs``."""
    return scored_pairs(packed(nodes), lambda left, right: shared_subtrees(left, right, ordered), **{"block_trees": 64, **planned})


def annotated(matches: DataFrame, nodes: DataFrame, side: str = "g") -> DataFrame:
    """(g, h, place, u, v, label): the pairs of matches numbered from 1, with the label of one side's node."""
    steps = matches.select("g", "h", F.posexplode("pairs").alias("place", "p")).select("g", "h", (F.col("place") + 1).alias("place"), F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    node = "u" if side == "g" else "v"
    return steps.join(nodes.select(F.col("tree_id").cast("string").alias(side), F.col("u").alias(node), "label"), [side, node]).select("g", "h", "place", "u", "v", "label")
