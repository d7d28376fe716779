"""Scores of tree pairs.

Trees are packed to one row each, and those that are equal in all nodes are one kind. All pairs of kinds are planned by blocks: kinds are hashed into B blocks, each goes
to the B block pairs that it is in, and a kernel scores one block pair, a tree against a forest at a time. A
block pair's trees are all that a task holds; B grows with the collection, so that it stays within ``block_trees`` trees and ``block_nodes`` nodes
(or a single tree), and the kernel's table holds only nodes whose keys occur on both sides. The pairs of trees are then listed from the names of two kinds where
these are, so they are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions import kernels
from grovekit.operators.collections import dealt_blocks, normalised
from grovekit.operators.trees import packed
from grovekit.operators.weights import KeyedWeight
from grovekit.sources.storage import checkpointed

PAIRS = "g string, h string, score double"
#: Nodes that are indexed or weighed as one forest.
FOREST_NODES = 1 << 20


def label_weights(a: list, b: list, weights: dict | None) -> np.ndarray:
    """1 (or the label's weight, 0 if it has none) where labels are equal; a null label equals nothing."""
    codes: dict = {}
    x, y = (np.array([-1 if t is None else codes.setdefault(t, len(codes)) for t in side]) for side in (a, b))
    worth = np.array([1.0 if weights is None else weights.get(t, 0.0) for t in codes] or [0.0])
    return np.where((x[:, None] == y[None, :]) & (x[:, None] >= 0), worth[x][:, None], 0.0)


def token_weights(a: list, b: list, weights: dict | None) -> np.ndarray:
    """The largest weight of a token that both nodes have, else 0."""
    out = np.zeros((len(a), len(b)))
    sides = [{t: [] for t in ()} for _ in range(2)]
    for held, side in zip(sides, (a, b), strict=True):
        for i, tokens in enumerate(side):
            for t in tokens or ():
                held.setdefault(t, []).append(i)
    for t in sides[0].keys() & sides[1].keys():
        at = np.ix_(sorted(set(sides[0][t])), sorted(set(sides[1][t])))
        out[at] = np.maximum(out[at], 1.0 if weights is None else weights.get(t, 0.0))
    return out


def weigher(labels: list, weights: dict | None, overlap: bool = False):
    """A function from a tree's labels to its weights with ``labels``, whose codes are made once."""
    if overlap:
        return lambda own: token_weights(own, labels, weights)
    codes: dict = {}
    y = np.array([-1 if t is None else codes.setdefault(t, len(codes)) for t in labels])
    worth = np.array([*(1.0 if weights is None else weights.get(t, 0.0) for t in codes), 0.0])

    def weigh(own: list) -> np.ndarray:
        x = np.array([codes.get(t, -2) if t is not None else -2 for t in own])
        return np.where(x[:, None] == y[None, :], worth[x][:, None], 0.0)

    return weigh


def keyed_weigher(labels: list):
    """A function from a tree's labels to its weights with ``labels``; labels are lists of (key, value), or null. The largest value of a common key counts."""
    places: dict[str, list[int]] = {}
    for v, keys in enumerate(labels):
        for k in keys or ():
            places.setdefault(k["key"], []).append(v)
    at = {key: np.array(vs) for key, vs in places.items()}

    def weigh(own: list) -> np.ndarray:
        out = np.zeros((len(own), len(labels)))
        for u, keys in enumerate(own):
            for k in keys or ():
                if k["key"] in at:
                    out[u, at[k["key"]]] = np.maximum(out[u, at[k["key"]]], k["value"])
        return out

    return weigh


def unpacked(batch: pa.RecordBatch) -> list[dict]:
    """``to_pylist`` of packed trees, with the nodes' values of all rows turned into objects at once."""
    out = {c: batch.column(c).to_pylist() for c in batch.schema.names if c not in ("parent", "label")}
    for c in ("parent", "label"):
        column = batch.column(c)
        flat, ends = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = flat.to_numpy(zero_copy_only=False) if c == "parent" else flat.to_pylist()
        out[c] = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]
    return [dict(zip(out, row, strict=True)) for row in zip(*out.values(), strict=True)]


def _keys_of(label, overlap: bool, keyed: bool) -> tuple:
    if label is None:
        return ()
    return tuple(k["key"] for k in label) if keyed else tuple(label) if overlap else (label,)


class _Forest:
    """Some packed trees as one forest with the numbers of their nodes' sets of keys; ``sets`` numbers these and ``names`` keys, for both sides."""

    def __init__(self, trees: list[dict], sets: dict, names: dict, overlap: bool):
        sizes = [len(r["parent"]) for r in trees]
        self.parent, _ = kernels.forest([np.asarray(r["parent"], np.int64) for r in trees]) if trees else (np.empty(0, np.int64), None)
        self.tree = np.repeat(np.arange(len(trees)), sizes)
        self.code = np.array([sets.setdefault(_keys_of(t, overlap, False), len(sets)) for r in trees for t in r["label"]], np.int64)
        for s in sets:
            for k in s:
                names.setdefault(k, len(names))

    def held(self, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, keys), one row for each key of a node."""
        sizes = np.array([len(s) for s in own], np.int64)
        count, first, flat = sizes[self.code], np.cumsum(sizes) - sizes, np.concatenate([np.empty(0, np.int64), *own])
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[self.code], count)
        return np.repeat(np.arange(len(self.code)), count), flat[place]

    def kept(self, some: np.ndarray) -> None:
        """Leaves out the nodes whose set of keys is not one of ``some``."""
        keep = some[self.code]
        if not keep.all():
            self.parent, nodes = kernels.contracted(self.parent, keep)
            self.tree, self.code = self.tree[nodes], self.code[nodes]


def _unit_scores(left: list[dict], right: list[dict], overlap: bool) -> np.ndarray:
    """``shared_scores`` where every key weighs 1: by words of bits for the trees of ``right`` whose paths have at most 64 nodes in common with the left, by tables for others."""
    same, sets, names = left is right, {}, {}
    g = _Forest(left, sets, names, overlap)
    h = g if same else _Forest(right, sets, names, overlap)
    own = [np.array(sorted({names[k] for k in s}), np.int64) for s in sets]
    seen = []
    for side in (g,) if same else (g, h):
        node, key = side.held(own)
        seen.append(np.bincount(np.unique(key * (len(left) + len(right)) + side.tree[node]) // (len(left) + len(right)), minlength=len(names)))
    common = seen[0] > 1 if same else (seen[0] > 0) & (seen[1] > 0)
    number = np.cumsum(common) - 1
    own = [number[s[common[s]]] for s in own]
    some = np.array([len(s) > 0 for s in own], bool)
    for side in (g,) if same else (g, h):
        side.kept(some)
    depth = np.zeros(len(right), np.int64)
    np.maximum.at(depth, h.tree, kernels.depths(h.parent) + 1)
    deep = np.flatnonzero(depth > kernels.WORDS[-1][0])
    parent, tree, code = h.parent, h.tree, h.code
    if len(deep):
        parent, nodes = kernels.contracted(parent, ~np.isin(tree, deep))
        tree, code = tree[nodes], code[nodes]
    shallow = object.__new__(_Forest)
    shallow.code = code
    scores = kernels.unit_scores(g.parent, g.tree, g.code, own, parent, tree, *shallow.held(own), int(common.sum()), (len(left), len(right)))
    if len(deep):
        scores[:, deep] = _table_scores(left, [right[i] for i in deep], None, overlap, False)
    return scores


def shared_scores(left: list[dict], right: list[dict], weights: dict | None = None, overlap: bool = False, keyed: bool = False) -> np.ndarray:
    """Path scores of the packed trees ``left`` with each of ``right``: (trees, trees).

    Nodes without a key in common with the other side weigh nothing with it, so they are left out first, and their children hang on what is above
    them; what is left grows with what the trees have in common, not with their sizes. If both are one list, a tree's score with itself is its heaviest path.
    """
    scores = _unit_scores(left, right, overlap) if weights is None and not keyed else _table_scores(left, right, weights, overlap, keyed)
    for i, r in enumerate(left if left is right else ()):
        value = lambda k: k["value"] if keyed else 1.0 if weights is None else weights.get(k, 0.0)
        worth = [max(map(value, t if keyed or overlap else (t,)), default=0.0) if t is not None else 0.0 for t in r["label"]]
        scores[i, i] = kernels.heaviest_path(np.array(r["parent"]), np.array(worth, float))
    return scores


def _table_scores(left: list[dict], right: list[dict], weights: dict | None, overlap: bool, keyed: bool) -> np.ndarray:
    same = left is right
    keys = [[[_keys_of(t, overlap, keyed) for t in r["label"]] for r in side] for side in (left, right)]
    held = [Counter(k for tree in side for k in {k for node in tree for k in node}) for side in keys]
    common, sides = {k for k, n in held[0].items() if n > 1} if same else held[0].keys() & held[1].keys(), []
    for side, own in zip((left, right), keys, strict=True):
        some = []
        for i, (r, nodes) in enumerate(zip(side, own, strict=True)):
            keep = np.array([any(k in common for k in node) for node in nodes], bool)
            if keep.any():
                parent, kept = kernels.contracted(np.array(r["parent"]), keep)
                some.append((i, parent, [r["label"][u] for u in kept]))
        sides.append(some)
    scores = np.zeros((len(left), len(right)))
    if sides[0] and sides[1]:
        columns = kernels.Columns([p for _, p, _ in sides[1]])
        labels = [t for _, _, own in sides[1] for t in own]
        ordered = [labels[i] for i in columns.order]
        weigh = keyed_weigher(ordered) if keyed else weigher(ordered, weights, overlap)
        scores[np.ix_(*([i for i, _, _ in side] for side in sides))] = kernels.forest_scores([(p, own) for _, p, own in sides[0]], columns, weigh)
    return scores


def shared_nodes(g: list, h: list, keys_g: list, keys_h: list, closed: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Parents and numbers of the nodes of two trees that have a key in common with the other one; ``closed``: with all nodes above them, and the roots."""
    out = []
    common = {k for node in keys_g for k in node} & {k for node in keys_h for k in node}
    for parent, keys in ((np.array(g), keys_g), (np.array(h), keys_h)):
        keep = np.array([any(k in common for k in node) for node in keys], bool)
        if closed:
            keep |= parent < 0
            for level in reversed(kernels.levels(parent)[1:]):
                keep[parent[level][keep[level]]] = True
        out.append(kernels.contracted(parent, keep))
    return out


def best_path(g: list, h: list, keys_g: list, keys_h: list, weigh, prefer_match: bool = True) -> tuple[float, list[tuple[int, int]]]:
    """Score and pairs of the best chain, pairs that weigh nothing left out: its end from the table of shared nodes, the rest from the two paths to the roots.

    ``weigh(us, vs)`` gives the weights of some nodes of both. Scores, pairs and ties are those of the whole table.
    """
    (p, us), (q, vs) = shared_nodes(g, h, keys_g, keys_h)
    if not len(us):
        return 0.0, []
    table = kernels.path_table(p, q, weigh(us, vs))[1:, 1:]
    u = int(table.max(axis=1).argmax())
    ends, paths = (int(us[u]), int(vs[table[u].argmax()])), []
    for at, parent in zip(ends, (g, h), strict=True):
        path = []
        while at >= 0:
            path.append(at)
            at = int(parent[at])
        paths.append(path[::-1])
    score, pairs = kernels.path_pairs(*(np.arange(-1, len(x) - 1) for x in paths), weigh(*(np.array(x) for x in paths)), prefer_match, only_positive=True)
    return score, [(paths[0][a], paths[1][b]) for a, b in pairs]


def _block_pairs(score):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in unpacked(b)]
        x, y = key[0].as_py(), key[1].as_py()
        left = [r for r in rows if r["block"] == x]
        right = left if x == y else [r for r in rows if r["block"] == y]
        if not left or not right:
            return
        scores = score(left, right)
        a, b = (np.array([r["kind"] for r in side]) for side in (left, right))
        i, j = np.nonzero(a[:, None] <= b[None, :] if x == y else np.ones(scores.shape, bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(scores[i, j])], names=["a", "b", "score"])

    return run


def _named(scores: DataFrame, members: DataFrame, kinds: int, block_members: int, spread_rows: int) -> DataFrame:
    """(g, h, score) of all pairs of ``members(tree_id, kind)`` from the ``scores(a, b, score)`` of kinds, a <= b.

    A kind's names are held as parts of about ``block_members``; they are sent to all tasks (some bytes a tree), and each pair of parts is multiplied out where its score is. Few scores that
    make many pairs are dealt evenly first. Spark holds the rows that one pair of parts makes, so parts are small.
    """
    parts = members.groupBy("kind").agg(F.ceil(F.count("*") / block_members).cast("int").alias("n"))
    part = F.pmod(F.xxhash64("tree_id"), F.col("n")).cast("int").alias("part")
    named = checkpointed(members.join(parts, "kind").select("kind", "tree_id", part).groupBy("kind", "part").agg(F.collect_list("tree_id").alias("ids")))
    side = lambda c, *more: F.broadcast(named.select(F.col("kind").alias(c), F.col("part").alias(f"part_{c}"), *[F.col(m).alias(f"{m}_{c}") for m in more]))
    if kinds * (kinds + 1) // 2 <= spread_rows:
        tasks = 16 * scores.sparkSession.sparkContext.defaultParallelism
        dealt = scores.join(side("a"), "a").join(side("b"), "b").where("a <> b OR part_a <= part_b").repartition(tasks)
        pairs = dealt.join(side("a", "ids"), ["a", "part_a"]).join(side("b", "ids"), ["b", "part_b"])
    else:
        pairs = scores.join(side("a", "ids"), "a").join(side("b", "ids"), "b").where("a <> b OR part_a <= part_b")
    one = pairs.select(((F.col("a") == F.col("b")) & (F.col("part_a") == F.col("part_b"))).alias("same"), F.explode("ids_a").alias("t_a"), "ids_b", "score")
    both = one.select("same", "t_a", F.explode("ids_b").alias("t_b"), "score").where("NOT same OR t_a < t_b")
    return both.select(F.least("t_a", "t_b").alias("g"), F.greatest("t_a", "t_b").alias("h"), "score")


def scored_pairs(whole: DataFrame, score, block_trees: int = 512, block_nodes: int = 32768, block_members: int = 128, spread_rows: int = 5_000_000) -> DataFrame:
    """(g, h, score), g < h as text, of all pairs of the packed trees ``whole``; ``score(left, right)`` gives those of two lists of them as a matrix."""
    trees = checkpointed(whole.withColumn("hash", F.sha2(F.to_json(F.struct("parent", "label")), 256)))
    kinds = checkpointed(trees.groupBy("hash").agg(F.min("tree_id").alias("tree_id"), F.first(F.size("parent")).alias("size")).withColumn("kind", F.monotonically_increasing_id()))
    size = kinds.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("size"), F.lit(0)).alias("nodes")).collect()[0]
    cores = whole.sparkSession.sparkContext.defaultParallelism
    busy = min(-(-size["kinds"] // 32), int((8 * cores) ** 0.5) + 1)  # enough pairs of blocks for all cores, if there is much to do
    blocks = max(1, min(size["kinds"], max(busy, -(-size["kinds"] // block_trees), -(-size["nodes"] // block_nodes))))
    block = F.pmod(F.xxhash64("tree_id"), F.lit(blocks)).cast("int").alias("block")
    own = trees.join(kinds.select("tree_id", "kind"), "tree_id").select("kind", "parent", "label", block)
    scores = dealt_blocks(own, blocks).groupBy("x", "y").applyInArrow(_block_pairs(score), "a long, b long, score double")
    members = trees.select("tree_id", "hash").join(kinds.select("hash", "kind"), "hash").select("tree_id", "kind")
    return _named(scores, members, size["kinds"], block_members, spread_rows)


def all_pair_scores(nodes: DataFrame, weight: KeyedWeight | None = None, overlap: bool = False, **planned) -> DataFrame:
    """(g, h, score), g < h as text, of all pairs: the best nested chain of nodes with equal labels (or common tokens), or of what ``weight`` says. ``planned`` as in ``scored_pairs``.

    Trees that are equal in all nodes are one kind, and kinds are scored; pairs of trees then take their kinds' scores.
    """
    keyed = weight is not None
    if keyed:
        planned = {"block_trees": 64, **planned}  # tables of nodes and nodes, not words
    return scored_pairs(packed(weight.keyed_nodes(nodes) if keyed else nodes), lambda left, right: shared_scores(left, right, None, overlap, keyed), **planned)


def landmark_scores(nodes: DataFrame, landmarks: list[dict], weights: dict | None = None, at_once: int = 256) -> DataFrame:
    """(g, h, score) of every tree g and every landmark h (packed rows, a bounded number); a task turns ``at_once`` trees of a batch into objects."""
    sent = sorted(landmarks, key=lambda r: r["tree_id"])
    names = [r["tree_id"] for r in sent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                trees = unpacked(batch.slice(start, at_once))
                scores = np.empty((len(trees), len(sent)))
                rest = [i for i, r in enumerate(trees) if r["tree_id"] not in names]
                scores[rest] = shared_scores([trees[i] for i in rest], sent, weights)
                for i in set(range(len(trees))) - set(rest):  # a landmark shares all its nodes with itself only
                    at = names.index(trees[i]["tree_id"])
                    own = [trees[i]]
                    scores[i] = np.insert(shared_scores(own, sent[:at] + sent[at + 1 :], weights)[0], at, shared_scores(own, own, weights)[0, 0])
                ids = [r["tree_id"] for r in trees for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names * len(trees), pa.string()), pa.array(scores.ravel(), pa.float64())], names=["g", "h", "score"])

    return packed(nodes).mapInArrow(run, PAIRS)


def landmark_features(nodes: DataFrame, landmarks: DataFrame, mode: str = "cosine") -> DataFrame:
    """(g, h, similarity) of every tree g and every landmark h (``landmarks(tree_id)``, a bounded number): path scores scaled by the self-scores of both."""
    chosen = landmarks.select(F.col("tree_id").cast("string").alias("tree_id"))
    rows = packed(nodes.join(F.broadcast(chosen.withColumnRenamed("tree_id", "_landmark")), F.col("tree_id").cast("string") == F.col("_landmark"), "left_semi")).collect()
    scales = self_scores(nodes).withColumnRenamed("score", "scale")
    return normalised(landmark_scores(nodes, [r.asDict() for r in rows]), mode, scales)


def _forest_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The heaviest path from the root of each packed tree (tree_id, parent, w), some trees at a time as one forest; no node becomes an object."""
    for whole in batches:
        ends = np.cumsum(np.asarray(whole.column("parent").value_lengths(), np.int64))
        cuts = np.flatnonzero(np.diff(ends // FOREST_NODES, prepend=0))
        for start, end in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
            batch = whole.slice(start, end - start)
            sizes = np.asarray(batch.column("parent").value_lengths(), np.int64)
            own, first = np.asarray(batch.column("parent").flatten(), np.int64), np.cumsum(sizes) - sizes
            parent = np.where(own >= 0, own + np.repeat(first, sizes), -1)
            total = np.maximum(np.asarray(batch.column("w").flatten(), float), 0.0)
            for level in kernels.levels(parent)[1:]:
                total[level] += total[parent[level]]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("tree_id"), pa.array(np.maximum.reduceat(total, first))], names=["tree_id", "score"])


def self_scores(nodes: DataFrame, weight: KeyedWeight | None = None) -> DataFrame:
    """(tree_id, score): each tree's path score with itself, the heaviest path from its root; a node weighs what its heaviest key does."""
    weighed = (weight or KeyedWeight()).heaviest(nodes)
    return packed(weighed.withColumn("label", F.lit(None).cast("string")), "w").select("tree_id", "parent", "w").mapInArrow(_forest_scores, "tree_id string, score double")


def per_pair(pairs: DataFrame, nodes: DataFrame, kernel, schema: str = PAIRS) -> DataFrame:
    """``kernel(g_row, h_row) -> tuple`` for each row of ``pairs(g, h)``; rows have tree_id, parent, label."""
    trees = packed(nodes)
    left = trees.select(F.col("tree_id").alias("g"), F.struct("tree_id", "parent", "label").alias("tree_g"))
    right = trees.select(F.col("tree_id").alias("h"), F.struct("tree_id", "parent", "label").alias("tree_h"))

    def run(batches):
        for batch in batches:
            rows = [(r["g"], r["h"], *kernel(r["tree_g"], r["tree_h"])) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return pairs.select(F.col("g").cast("string").alias("g"), F.col("h").cast("string").alias("h")).join(left, "g").join(right, "h").mapInArrow(run, schema)


def template_scores(nodes: DataFrame, template: list, penalty: float = 0.0, mismatch: float = -100.0) -> DataFrame:
    """(tree_id, score) of every tree against one path whose nodes may repeat in order."""

    def run(batches):
        h = np.arange(-1, len(template) - 1)
        for batch in batches:
            rows = [(r["tree_id"], kernels.template_repeat(np.array(r["parent"]), h, np.array([[1.0 if a == b else mismatch for b in template] for a in r["label"]]), penalty)) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["tree_id", "score"])

    return packed(nodes).mapInArrow(run, "tree_id string, score double")
