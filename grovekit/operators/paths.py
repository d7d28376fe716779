"""Path matches with their pairs: dense, over candidate pairs only, and by a beam.

A path match of two trees is a chain of node pairs, each strictly below the one before on both sides; it is worth the sum of the pairs' weights.
Results are rows (g, h, score, pairs), pairs an array of structs (u, v) from the top down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.functions import kernels
from grovekit.operators.matching import best_path, keyed_weigher
from grovekit.operators.sketches import sketch_overlap
from grovekit.operators.trees import packed
from grovekit.operators.weights import KeyedWeight
from grovekit.sources.storage import checkpointed

PAIRS = "array<struct<u: int, v: int>>"
MATCHES = f"g string, h string, score double, pairs {PAIRS}"
PAIR_TYPE = pa.list_(pa.struct([("u", pa.int32()), ("v", pa.int32())]))


def keyed_weights(g: list, h: list) -> np.ndarray:
    """Largest value of a key that both nodes have; labels are lists of (key, value) or null."""
    return keyed_weigher(h)(g)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    g, h, score, pairs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(h), pa.array(score, pa.float64()), pa.array([[{"u": u, "v": v} for u, v in p] for p in pairs], PAIR_TYPE)], names=["g", "h", "score", "pairs"])


def path_matches(pairs: DataFrame, nodes: DataFrame, weight: KeyedWeight | None = None, prefer_match: bool = True, only_positive: bool = True, cells: int = 4_000_000) -> DataFrame:
    """(g, h, score, pairs) of the tree ``pairs(g, h)``, exact, by the table of the nodes that share a key; without ``only_positive`` by the whole one, a batch's partners of one g as one forest of at most ``cells`` table cells."""
    trees = packed((weight or KeyedWeight()).keyed_nodes(nodes))
    left = trees.select(F.col("tree_id").alias("g"), F.struct("parent", "label").alias("tree_g"))
    right = trees.select(F.col("tree_id").alias("h"), F.struct("parent", "label").alias("tree_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_g: dict[str, list[dict]] = {}
            for r in batch.to_pylist():
                by_g.setdefault(r["g"], []).append(r)
            out = []
            for g, rows in by_g.items() if only_positive else ():
                labels = rows[0]["tree_g"]["label"]
                keys = [[k["key"] for k in t or ()] for t in labels]
                for r in rows:
                    other = r["tree_h"]["label"]
                    weigh = lambda us, vs, b=other, a=labels: keyed_weights([a[u] for u in us], [b[v] for v in vs])
                    out.append((g, r["h"], *best_path(rows[0]["tree_g"]["parent"], r["tree_h"]["parent"], keys, [[k["key"] for k in t or ()] for t in other], weigh, prefer_match)))
            for g, rows in by_g.items() if not only_positive else ():
                own, labels = np.array(rows[0]["tree_g"]["parent"]), rows[0]["tree_g"]["label"]
                while rows:
                    size, take = 0, 0
                    while take < len(rows) and (not take or size * len(own) <= cells):
                        size += len(rows[take]["tree_h"]["parent"])
                        take += 1
                    some, rows = rows[:take], rows[take:]
                    forest, starts = kernels.forest([np.array(r["tree_h"]["parent"]) for r in some])
                    w = keyed_weights(labels, [t for r in some for t in r["tree_h"]["label"]])
                    scores, found = kernels.path_matches(own, forest, starts, w, prefer_match, only_positive)
                    out += [(g, r["h"], s, [(u, v - int(a)) for u, v in p]) for r, s, p, a in zip(some, scores, found, starts, strict=True)]
            if out:
                yield _rows(out)

    wanted = pairs.select(F.col("g").cast("string").alias("g"), F.col("h").cast("string").alias("h"))
    return wanted.join(left, "g").join(right, "h").mapInArrow(run, MATCHES)


def template_matches(nodes: DataFrame, template: list, penalty: float = 0.0, mismatch: float = -100.0) -> DataFrame:
    """(tree_id, score, pairs) of every tree against one path of labels whose places may be used again in order, each further use for ``penalty``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.arange(-1, len(template) - 1)
        for batch in batches:
            ids, parents, labels = (batch.column(c).to_pylist() for c in ("tree_id", "parent", "label"))
            found = [kernels.template_matches(np.array(p), h, np.array([[1.0 if a == b else mismatch for b in template] for a in own]).reshape(len(own), -1), penalty) for p, own in zip(parents, labels, strict=True)]
            pairs = pa.array([[{"u": u, "v": v} for u, v in f[1]] for f in found], PAIR_TYPE)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([f[0] for f in found], pa.float64()), pairs], names=["tree_id", "score", "pairs"])

    return packed(nodes).mapInArrow(run, f"tree_id string, score double, pairs {PAIRS}")


def reference_matches(nodes: DataFrame, reference: list, weights: list[float], combine="add", rule=None, every_place: bool = False) -> DataFrame:
    """(tree_id, score, pairs) of every tree's best path from its root against a weighted list of symbols; a pair is a node and a place of the list.

    A label that is a struct of (symbol, weight) rows, or an array of them, offers each; a plain label offers itself. ``combine`` and ``rule`` as in the kernel.
    """

    def offers(label) -> list[tuple]:
        if isinstance(label, list):
            return [tuple(x.values()) if isinstance(x, dict) else (x, None) for x in label]
        return [tuple(label.values())] if isinstance(label, dict) else [(label, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parents, labels = (batch.column(c).to_pylist() for c in ("tree_id", "parent", "label"))
            found = [kernels.reference_matches(np.array(p), [offers(t) for t in own], reference, weights, combine, rule, every_place) for p, own in zip(parents, labels, strict=True)]
            pairs = pa.array([[{"u": u, "v": place} for u, place, _ in f[1]] for f in found], PAIR_TYPE)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([f[0] for f in found], pa.float64()), pairs], names=["tree_id", "score", "pairs"])

    return packed(nodes).mapInArrow(run, f"tree_id string, score double, pairs {PAIRS}")


def placed(matches: DataFrame, index: DataFrame, *extra: str) -> DataFrame:
    """``matches(g, h, u, v, w)`` with both nodes' tin and tout, and the ``extra`` columns of ``index``, as tin_u, tin_v and so on."""
    columns = ["tin", "tout", *extra]
    left = index.select(F.col("tree_id").alias("g"), "u", *[F.col(c).alias(f"{c}_u") for c in columns])
    right = index.select(F.col("tree_id").alias("h"), F.col("u").alias("v"), *[F.col(c).alias(f"{c}_v") for c in columns])
    return matches.join(left, ["g", "u"]).join(right, ["h", "v"])


def select_subset(rows: DataFrame, by: list[str], order: str, most: int, mode: str = "first") -> DataFrame:
    """At most ``most`` rows of each group ``by``, in ``order``: the first, the last, or a spread from the first to the last one."""
    n, place = F.count("*").over(W.partitionBy(*by)), F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    ranked = rows.withColumn("_n", n).withColumn("_place", place)
    if mode == "spread":  # the places nearest to even steps
        step = (F.col("_n") - 1) / F.lit(max(most - 1, 1))
        k = F.round(F.col("_place") / F.greatest(step, F.lit(1e-9)))
        keep = (F.col("_n") <= most) | (F.round(k * step) == F.col("_place"))
    else:
        keep = {"first": F.col("_place") < most, "last": F.col("_place") >= F.col("_n") - most}[mode]
    return ranked.where(keep).drop("_n", "_place")


def sparse_matches(candidates: DataFrame, index: DataFrame, most_per_u: int | None = None, mode: str = "first") -> DataFrame:
    """(g, h, score, pairs): the best chain over ``candidates(g, h, u, v, w)`` alone; pairs of trees without one that weighs anything have no row.

    All candidates count, and a task holds those of one pair of trees. Only if ``most_per_u`` is given, so many a node of g are kept (``mode``: first, last or spread by v).
    The score is that of the dense match if all pairs of nodes that weigh anything are candidates.
    """
    some = candidates.where("w > 0")
    if most_per_u is not None:
        some = select_subset(some, ["g", "h", "u"], "v", most_per_u, mode)
    columns = ["tin_u", "tout_u", "tin_v", "tout_v", "w", "u", "v"]
    rows = placed(some, index).groupBy("g", "h").agg(*[F.collect_list(c).alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = zip(batch.column("g").to_pylist(), batch.column("h").to_pylist(), strict=True)
            for i, (g, h) in enumerate(ids):
                tin_u, tout_u, tin_v, tout_v, w, u, v = (np.asarray(batch.column(c)[i].values) for c in columns)
                score, chain = kernels.chain_over(tin_u, tout_u, tin_v, tout_v, w)
                out.append((g, h, score, [(int(u[k]), int(v[k])) for k in chain]))
            if out:
                yield _rows(out)

    return rows.mapInArrow(run, MATCHES)


def checked(matches: DataFrame, nodes: DataFrame, index: DataFrame, weight: KeyedWeight | None = None) -> DataFrame:
    """(g, h, score, nested): each match's score as the sum of its pairs' weights, from the weight's table, and whether each pair lies strictly below the one before."""
    keys = (weight or KeyedWeight()).keys(nodes)
    steps = matches.select("g", "h", F.posexplode("pairs").alias("place", "p")).select("g", "h", "place", F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    both = steps.join(keys.select(F.col("tree_id").alias("g"), "u", "key", "value"), ["g", "u"], "left").join(keys.select(F.col("tree_id").alias("h"), F.col("u").alias("v"), F.col("key").alias("other")), ["h", "v"], "left")
    worth = both.groupBy("g", "h", "place", "u", "v").agg(F.coalesce(F.max(F.when(F.col("key") == F.col("other"), F.col("value"))), F.lit(0.0)).alias("w"))
    last = W.partitionBy("g", "h").orderBy("place")
    below = lambda s: (F.lag(f"tin_{s}").over(last) < F.col(f"tin_{s}")) & (F.col(f"tin_{s}") < F.lag(f"tout_{s}").over(last))
    nested = placed(worth, index).withColumn("ok", F.coalesce(below("u") & below("v"), F.lit(True)))
    sums = nested.groupBy("g", "h").agg(F.sum("w").alias("score"), F.min("ok").alias("nested"))
    return matches.select("g", "h").join(sums, ["g", "h"], "left").select("g", "h", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("nested", F.lit(True)).alias("nested"))


Hook = Callable[[Column], Column]


@dataclass(frozen=True)
class Beam:
    """How a beam goes on. ``width`` states a pair of trees and layer, ``expansion`` continuations a state (None: all).

    A candidate's priority is its weight + rarity * how rare its labels are + future * what may follow - gap * levels left out - balance * difference of the steps,
    + look * its look-ahead; a state's is its score + state_future * what may follow + look * its look-ahead + length * its pairs. ``candidate_priority`` and ``state_priority``
    get that column and give the one that counts; they may use the other columns of the rows (u, v, w, rarity, gap, balance, future, lookahead, score, layer).
    ``expand`` gives the continuations of the frontier itself: it gets rows (g, h, state, u, v, score) and returns rows (g, h, state, u, v, w).
    """

    width: int = 200
    expansion: int | None = 64
    least: float = 0.0
    rarity: float = 0.25
    future: float = 0.03
    state_future: float = 0.20
    gap: float = 0.03
    balance: float = 0.01
    look: float = 0.35
    length: float = 0.0
    layers: int | None = None
    bounded: bool = True
    candidate_priority: Hook | None = None
    state_priority: Hook | None = None
    expand: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        if self.width < 1 or (self.expansion is not None and self.expansion < 1):
            raise ValueError("a beam needs room for a state and a continuation")
        if self.layers is not None and self.layers < 0:
            raise ValueError("layers can't be negative")


def _described(matches: DataFrame, labelled: DataFrame, sketches: list[tuple[DataFrame, float]], weights: DataFrame | None) -> DataFrame:
    """``matches(g, h, u, v, w)`` with places and depths, rarity, future (what may follow at most) and lookahead."""
    size = labelled.groupBy("tree_id").agg(F.count("*").cast("double").alias("n"))
    held = labelled.groupBy("tree_id", "label").agg(F.count("*").alias("f"))
    rows = placed(matches, labelled, "depth", "height", "label")
    for tree, side in (("g", "u"), ("h", "v")):
        rows = rows.join(size.select(F.col("tree_id").alias(tree), F.col("n").alias(f"n_{side}")), tree)
        counts = held.select(F.col("tree_id").alias(tree), F.col("label").alias(f"l_{side}"), F.col("f").alias(f"f_{side}"))
        rows = rows.join(counts, (rows[tree] == counts[tree]) & rows[f"label_{side}"].eqNullSafe(counts[f"l_{side}"])).drop(counts[tree], f"l_{side}")
    nodes = F.col("n_u") * F.col("n_v")
    rarity = F.greatest(F.lit(0.0), F.log(F.greatest(F.lit(1.0), nodes / (F.col("f_u") * F.col("f_v")))) / F.log(F.greatest(F.lit(2.0), nodes)))
    most = F.max("w").over(W.partitionBy("g", "h"))
    rows = rows.withColumn("rarity", rarity).withColumn("future", F.least("height_u", "height_v") * most)
    look = F.lit(0.0)
    for number, (sketch, share) in enumerate(sketches):
        found = sketch_overlap(rows, sketch, weights).withColumnRenamed("look", f"look_{number}")
        rows = rows.join(found, ["g", "h", "u", "v"], "left")
        look = look + share * F.coalesce(f"look_{number}", F.lit(0.0))
    return rows.withColumn("lookahead", F.least(look, F.col("future"))).select(
        "g", "h", "u", "v", "w", "tin_u", "tout_u", "tin_v", "tout_v", "depth_u", "depth_v", "rarity", "future", "lookahead"
    )


def _kept(column: Column) -> Column:
    """A priority that is not a finite number takes its row out."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def beam_matches(matches: DataFrame, labelled: DataFrame, beam: Beam | None = None, sketches: list[tuple[DataFrame, float]] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(g, h, score, pairs): the best chain that a beam finds among ``matches(g, h, u, v, w)``, layer by layer for all pairs of trees at once.

    ``labelled`` is the tree index with labels; ``sketches`` are look-ahead sketches and their shares. A layer joins the frontier with the matches strictly below its states,
    keeps the best continuations of a state, the best state of a pair of end nodes, and the best states of a pair of trees; with ``bounded`` also only states that may still
    beat the best score so far, by what may follow at most (the lower node's height times the largest weight), which never loses a better chain that would be kept. With enough width the score
    is that of the exact match. Pairs of trees without a match have no row. Ties: the higher score, then the earlier continuation by priority, weight, u and v.
    """
    beam = beam or Beam()
    some = checkpointed(_described(matches.where(F.col("w") > beam.least), labelled, (sketches or []) if beam.look else [], weights))
    heights = labelled.groupBy("tree_id").agg((F.max("height") + 1).alias("levels"))
    pair = some.select("g", "h").distinct().join(heights.withColumnRenamed("tree_id", "g").withColumnRenamed("levels", "a"), "g").join(heights.withColumnRenamed("tree_id", "h").withColumnRenamed("levels", "b"), "h")
    most = pair.agg(F.max(F.least("a", "b"))).collect()[0][0] or 0
    layers = most if beam.layers is None else beam.layers
    nothing = F.lit(None).cast("int")
    frontier = some.select("g", "h").distinct().select(
        "g", "h", F.lit(1).alias("state"), nothing.alias("u"), nothing.alias("v"), F.lit(-1).alias("tin_u"), F.lit(1 << 30).alias("tout_u"), F.lit(-1).alias("tin_v"),
        F.lit(1 << 30).alias("tout_v"), F.lit(-1).alias("depth_u"), F.lit(-1).alias("depth_v"), F.lit(0.0).alias("score"), F.lit(0.0).alias("best"), F.array().cast(PAIRS).alias("pairs"),
    )
    found = frontier.select("g", "h", "score", "pairs", F.lit(0).alias("layer"), "state")
    for layer in range(layers):
        now = frontier.select(*[F.col(c).alias(f"p_{c}" if c not in ("g", "h", "state", "best", "pairs") else c) for c in frontier.columns])
        if beam.expand is None:
            inside = (F.col("tin_u") > F.col("p_tin_u")) & (F.col("tin_u") < F.col("p_tout_u")) & (F.col("tin_v") > F.col("p_tin_v")) & (F.col("tin_v") < F.col("p_tout_v"))
            reached = now.join(some, ["g", "h"]).where(inside)
        else:
            reached = _expanded(beam, frontier, now, some, labelled)
        gap = (F.col("depth_u") - F.col("p_depth_u") - 1) + (F.col("depth_v") - F.col("p_depth_v") - 1)
        balance = F.abs((F.col("depth_u") - F.col("p_depth_u")) - (F.col("depth_v") - F.col("p_depth_v")))
        reached = reached.withColumn("gap", gap).withColumn("balance", balance).withColumn("score", F.col("p_score") + F.col("w")).withColumn("layer", F.lit(layer + 1))
        priority = F.col("w") + beam.rarity * F.col("rarity") + beam.future * F.col("future") + beam.look * F.col("lookahead") - beam.gap * F.col("gap") - beam.balance * F.col("balance")
        reached = reached.withColumn("priority", (beam.candidate_priority or (lambda c: c))(priority)).where(_kept(F.col("priority")))
        order = [F.desc("priority"), F.desc("w"), F.col("u"), F.col("v")]
        reached = reached.withColumn("place", F.row_number().over(W.partitionBy("g", "h", "state").orderBy(*order)))
        if beam.expansion is not None:
            reached = reached.where(F.col("place") <= beam.expansion)
        ahead = F.row_number().over(W.partitionBy("g", "h", "u", "v").orderBy(F.desc("score"), "state", "place"))
        states = reached.withColumn("ahead", ahead).where("ahead = 1").withColumn("best", F.greatest("best", F.max("score").over(W.partitionBy("g", "h"))))
        value = F.col("score") + beam.state_future * F.col("future") + beam.look * F.col("lookahead") + beam.length * F.col("layer")
        states = states.withColumn("value", (beam.state_priority or (lambda c: c))(value)).withColumn("pairs", F.concat("pairs", F.array(F.struct(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v")))))
        states = checkpointed(states.withColumn("earlier", F.struct("state", "place")))
        found = found.unionByName(states.select("g", "h", "score", "pairs", "layer", "state"))
        going = states.where(_kept(F.col("value")))
        if beam.bounded and beam.expand is None:
            going = going.where(F.col("score") + F.col("future") > F.col("best"))
        rank = F.row_number().over(W.partitionBy("g", "h").orderBy(F.desc("value"), F.desc("score"), "earlier"))
        frontier = checkpointed(going.withColumn("state", rank).where(F.col("state") <= beam.width).select(*frontier.columns))
        if frontier.isEmpty():
            break
    best = found.where("layer > 0").groupBy("g", "h").agg(F.min(F.struct((-F.col("score")).alias("s"), "layer", "state", "pairs")).alias("x"))
    return best.select("g", "h", (-F.col("x.s")).alias("score"), F.col("x.pairs").alias("pairs"))


def _expanded(beam: Beam, frontier: DataFrame, now: DataFrame, some: DataFrame, labelled: DataFrame) -> DataFrame:
    """The continuations that ``beam.expand`` names; nodes that a tree doesn't have are an error, pairs that don't lie below their state are left out."""
    named = checkpointed(beam.expand(frontier.select("g", "h", "state", "u", "v", "score")).select("g", "h", "state", "u", "v", F.col("w").cast("double").alias("w")))
    kept = placed(named, labelled, "depth")
    if named.count() != kept.count():
        raise ValueError("a continuation lies outside tree bounds")
    known = some.select("g", "h", "u", "v", "rarity", "future", "lookahead")
    joined = now.join(kept.where(F.col("w") > beam.least), ["g", "h", "state"]).join(known, ["g", "h", "u", "v"], "left").fillna(0.0, ["rarity", "future", "lookahead"])
    return joined.where("tin_u > p_tin_u AND tin_u < p_tout_u AND tin_v > p_tin_v AND tin_v < p_tout_v")


def beam_matches_symmetric(matches: DataFrame, labelled: DataFrame, beam: Beam | None = None, sketches: list[tuple[DataFrame, float]] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """The better of the beam on (g, h) and on (h, g); the reverse one only if it is strictly better. With ``expand`` only the first, as that names nodes by side."""
    forward = beam_matches(matches, labelled, beam, sketches, weights)
    if beam is not None and beam.expand is not None:
        return forward
    turned = matches.select(F.col("h").alias("g"), F.col("g").alias("h"), F.col("v").alias("u"), F.col("u").alias("v"), "w")
    back = beam_matches(turned, labelled, beam, sketches, weights)
    back = back.select(F.col("h").alias("g"), F.col("g").alias("h"), "score", F.transform("pairs", lambda p: F.struct(p["v"].alias("u"), p["u"].alias("v"))).cast(PAIRS).alias("pairs"))
    both = forward.withColumn("way", F.lit(0)).unionByName(back.withColumn("way", F.lit(1)))
    best = both.groupBy("g", "h").agg(F.min(F.struct((-F.col("score")).alias("s"), "way", "pairs")).alias("x"))
    return best.select("g", "h", (-F.col("x.s")).alias("score"), F.col("x.pairs").alias("pairs"))
