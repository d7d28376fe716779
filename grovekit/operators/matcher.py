"""One collection of trees, matched in any way, with results in the nodes' own ids."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.operators import paths, sketches, subtrees, trees
from grovekit.operators.collections import meeting_pairs
from grovekit.operators.weights import KeyedWeight, node_matches
from grovekit.sources.storage import checkpointed

METHODS = ("exact", "sparse", "beam", "beam_symmetric", "ordered_subtree", "unordered_subtree")


class TreeMatcher:
    """Matches of the trees of ``nodes(tree_id, u, parent, label[, orig][, ts])`` under a weight.

    The tree index, the keys and the look-ahead sketches are made once, when a method first needs them, and written to the checkpoint folder. Results are rows (g, h, score, pairs), pairs an
    array of structs (u, v, orig_u, orig_v); without a column ``orig`` the nodes' numbers are their own ids.
    """

    def __init__(self, nodes: DataFrame, weight: KeyedWeight | None = None):
        self.nodes = nodes.withColumn("tree_id", F.col("tree_id").cast("string"))
        self.weight = weight or KeyedWeight()

    @cached_property
    def keys(self) -> DataFrame:
        return checkpointed(self.weight.keys(self.nodes))

    @cached_property
    def labelled(self) -> DataFrame:
        return checkpointed(sketches.labelled_index(trees.tree_index(self.nodes), self.nodes))

    def pairs(self) -> DataFrame:
        """(g, h), g < h: the trees that share a key; all others match with nothing."""
        return meeting_pairs(self.keys)

    def match(self, pairs: DataFrame | None = None, method: str = "exact", **options) -> DataFrame:
        """The matches of ``pairs(g, h)``, else of all pairs that share a key. ``method`` is one of METHODS.

        exact: ``prefer_match``, ``only_positive``. sparse: ``candidates(g, h, u, v)`` (else all nodes that share a key), ``stop``, ``most_per_u``, ``mode``. beam, beam_symmetric: ``beam`` and
        ``lookahead`` (a list of (settings of a sketch, share)). Subtrees: roots in ``pairs``, ``by_time``.
        """
        if method not in METHODS:
            raise ValueError(f"method is one of {METHODS}, not {method}")
        pairs = self.pairs() if pairs is None else pairs
        if method == "exact":
            found = paths.path_matches(pairs, self.nodes, self.weight, **options)
        elif method.endswith("subtree"):
            found = subtrees.subtree_matches(pairs, self.nodes, method.startswith("ordered"), self.weight, **options)
        else:
            matches = node_matches(self.keys, pairs, options.pop("stop", None))
            if method == "sparse":
                candidates = options.pop("candidates", None)
                some = matches if candidates is None else matches.join(candidates.select("g", "h", "u", "v"), ["g", "h", "u", "v"], "left_semi")
                found = paths.sparse_matches(some, self.labelled, **options)
            else:
                sketched = [(sketches.lookahead_sketches(self.labelled, **settings), share) for settings, share in options.pop("lookahead", [])]
                run = paths.beam_matches if method == "beam" else paths.beam_matches_symmetric
                found = run(matches, self.labelled, options.pop("beam", None), sketched, self.weight.values, **options)
        return self.with_ids(found)

    def template(self, template: list, **options) -> DataFrame:
        """Every tree against one path of labels whose places may be used again: (tree_id, score, pairs)."""
        return paths.template_matches(self.nodes, template, **options)

    def reference(self, reference: list, weights: list[float], **options) -> DataFrame:
        """Every tree against a weighted list of symbols: (tree_id, score, pairs)."""
        return paths.reference_matches(self.nodes, reference, weights, **options)

    def with_ids(self, matches: DataFrame) -> DataFrame:
        """``pairs`` with the nodes' own ids."""
        rest = [c for c in matches.columns if c not in ("g", "h", "pairs")]
        steps = matches.withColumn("_row", F.struct("g", "h", *rest)).select("_row", "g", "h", F.posexplode_outer("pairs").alias("place", "p"))
        steps = steps.select("_row", "g", "h", "place", F.col("p.u").alias("u"), F.col("p.v").alias("v"))
        own = self.nodes.select("tree_id", "u", (F.col("orig") if "orig" in self.nodes.columns else F.col("u")).alias("orig"))
        left = own.select(F.col("tree_id").alias("g"), "u", F.col("orig").alias("orig_u"))
        right = own.select(F.col("tree_id").alias("h"), F.col("u").alias("v"), F.col("orig").alias("orig_v"))
        named = steps.join(left, ["g", "u"], "left").join(right, ["h", "v"], "left")
        listed = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "u", "v", "orig_u", "orig_v"))))
        rows = named.groupBy("_row").agg(F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in ("u", "v", "orig_u", "orig_v")])).alias("pairs"))
        return rows.select("_row.*", "pairs")
