"""Weights of node pairs as keyed tables.

A weight is a keyer, which turns nodes into rows (tree_id, u, key), and a table (key, value). Two nodes weigh the largest value of a key that
both have, and nothing without one. The same rows drive the blocking join (trees meet if they share a key), the candidate pairs, the
dense kernels (a node's keys with their values) and the SQL that checks them. No weight is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keyer = Callable[[DataFrame], DataFrame]


def label_keys(nodes: DataFrame) -> DataFrame:
    """The label itself, written as text; a null label has no key."""
    return nodes.where("label IS NOT NULL").select("tree_id", "u", F.col("label").cast("string").alias("key"))


def stable_hash(column: Column) -> Column:
    return F.xxhash64(column.cast("string"))


def token_keys(column: str = "tokens", most: int | None = 50) -> Keyer:
    """The distinct tokens of an array column, at most ``most`` of them by their hash."""

    def keys(nodes: DataFrame) -> DataFrame:
        own = nodes.select("tree_id", "u", F.explode(F.array_distinct(F.col(column))).alias("key")).where("key IS NOT NULL")
        return capped(own, most)

    return keys


def capped(keys: DataFrame, most: int | None) -> DataFrame:
    """At most ``most`` keys a node, by the keys' hash, so that both sides keep the same ones."""
    if most is None:
        return keys
    place = F.row_number().over(W.partitionBy("tree_id", "u").orderBy(stable_hash(F.col("key")), "key"))
    return keys.withColumn("place", place).where(F.col("place") <= most).drop("place")


def combination_keys(k: int = 2, column: str = "tokens", most: int | None = 50) -> Keyer:
    """Sorted combinations of ``k`` distinct tokens, joined by a bar; a node with fewer tokens has no key."""

    def keys(nodes: DataFrame) -> DataFrame:
        tokens = F.array_sort(F.filter(F.array_distinct(F.col(column)), lambda t: t.isNotNull()))
        out = nodes.select("tree_id", "u", tokens.alias("t")).select("tree_id", "u", "t", F.lit("").alias("key"), F.lit(0).alias("from"))
        for _ in range(k):
            more = F.expr("transform(slice(t, from + 1, size(t)), (x, i) -> struct(x, from + i + 1 AS next))")
            out = out.select("tree_id", "u", "t", "key", F.explode(more).alias("m")).select("tree_id", "u", "t", F.concat_ws("|", F.nullif("key", F.lit("")), "m.x").alias("key"), F.col("m.next").alias("from"))
        return capped(out.select("tree_id", "u", "key"), most)

    return keys


def prefix_keys(depth: int = 5) -> Keyer:
    """A key for each prefix of up to ``depth`` parts of the label, cut at '/' if there is one, else at white space."""
    from grovekit.operators.collections import blocking_prefix_keys

    return lambda nodes: blocking_prefix_keys(nodes, depth)


@dataclass(frozen=True)
class KeyedWeight:
    """``values(key, value)``; a key without a row there weighs nothing. Without ``values`` every key weighs 1."""

    keyer: Keyer = label_keys
    values: DataFrame | None = None

    def keys(self, nodes: DataFrame) -> DataFrame:
        """tree_id, u, key, value of the nodes' keys that weigh more than nothing."""
        own = self.keyer(nodes).select(F.col("tree_id").cast("string").alias("tree_id"), "u", F.col("key").cast("string").alias("key")).distinct()
        if self.values is None:
            return own.withColumn("value", F.lit(1.0))
        return own.join(self.values.select(F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value")), "key").where("value > 0").select("tree_id", "u", "key", "value")

    def keyed_nodes(self, nodes: DataFrame) -> DataFrame:
        """The nodes with ``label`` as an array of structs (key, value), for the dense kernels."""
        own = self.keys(nodes).groupBy("tree_id", "u").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("label"))
        plain = nodes.drop("label").withColumn("tree_id", F.col("tree_id").cast("string"))
        return plain.join(own, ["tree_id", "u"], "left")

    def heaviest(self, nodes: DataFrame) -> DataFrame:
        """tree_id, u, parent and w, the value of a node's heaviest key (0 without one). Where the label is the key, the nodes are read once and not joined with themselves."""
        plain = nodes.select(F.col("tree_id").cast("string").alias("tree_id"), "u", "parent", F.col("label").cast("string").alias("label"))
        if self.keyer is not label_keys:
            own = self.keys(nodes).groupBy("tree_id", "u").agg(F.max("value").alias("w"))
            return plain.drop("label").join(own, ["tree_id", "u"], "left").fillna(0.0, ["w"])
        if self.values is None:
            return plain.select("tree_id", "u", "parent", F.col("label").isNotNull().cast("double").alias("w"))
        worth = self.values.groupBy(F.col("key").cast("string").alias("label")).agg(F.max(F.col("value").cast("double")).alias("w"))
        return plain.join(worth, "label", "left").select("tree_id", "u", "parent", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))


def node_matches(keys: DataFrame, pairs: DataFrame, stop: int | None = None) -> DataFrame:
    """(g, h, u, v, w) of the tree ``pairs(g, h)``: nodes with a key in common and the largest value of one. ``keys(tree_id, u, key, value)``.

    Only if ``stop`` is given, a key that more nodes of one of the two trees have is not used for that pair.
    """
    usable = keys
    if stop is not None:
        counted = keys.groupBy("tree_id", "key").agg(F.count("*").alias("n"))
        usable = keys.join(counted.where(F.col("n") <= stop).select("tree_id", "key"), ["tree_id", "key"], "left_semi")
    left = usable.select(F.col("tree_id").alias("g"), "u", "key", "value")
    right = usable.select(F.col("tree_id").alias("h"), F.col("u").alias("v"), "key")
    return pairs.select("g", "h").join(left, "g").join(right, ["h", "key"]).groupBy("g", "h", "u", "v").agg(F.max("value").alias("w"))
