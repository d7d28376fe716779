"""Features of trees, their nearest trees by an inverted index, and landmarks; no pair of trees is scored for any of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.operators.collections import dealt_blocks
from grovekit.sources.storage import checkpointed

#: Cosines are compared after rounding, so that equal ones are ties whatever the order of their sums.
DIGITS = 9
BLOCK = 8192


def tree_features(tokens: DataFrame, hash_dim: int | None = None, binary: bool = False, normalised: bool = True) -> DataFrame:
    """``tokens(tree_id, token)`` to (tree_id, dim, value): counts by token, or by the token's hash modulo ``hash_dim``; of length 1 if ``normalised``. Null tokens don't count."""
    dim = F.col("token").cast("string") if hash_dim is None else F.pmod(F.xxhash64(F.col("token").cast("string")), F.lit(hash_dim)).cast("string")
    value = F.lit(1.0) if binary else F.count("*").cast("double")
    counts = tokens.where("token IS NOT NULL").groupBy(F.col("tree_id").cast("string").alias("tree_id"), dim.alias("dim")).agg(value.alias("value") if not binary else F.first(value).alias("value"))
    if not normalised:
        return counts
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy("tree_id")))
    return counts.select("tree_id", "dim", (F.col("value") / length).alias("value"))


def _dot(a: Column, b: Column) -> Column:
    """Product of two maps (dim, value)."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(b[x["key"]], F.lit(0.0)))


def _block_neighbours(k: int, at_once: int = 512):
    """Of two blocks x <= y, each class's ``k`` best partners in the other block, by a product of their features."""

    def best(own: np.ndarray, other: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, len(own), at_once):
            cosine = own[start : start + at_once] @ other.T
            if same:
                cosine[np.arange(len(cosine)), start + np.arange(len(cosine))] = -1.0
            least = np.partition(cosine, -k, axis=1)[:, -k, None] if k < cosine.shape[1] else np.zeros((len(cosine), 1))
            i, j = np.nonzero((cosine > 0) & (cosine >= least - 2 * 10.0**-DIGITS))
            value = np.round(cosine[i, j], DIGITS)
            order = np.lexsort((j, -value, i))
            i, j, value = i[order], j[order], value[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield i[kept] + start, j[kept], value[kept]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("rep")  # ties go to the smaller id
        sides = [table.filter(pa.compute.equal(table["block"], side)) for side in key]
        names = pa.compute.unique(pa.concat_arrays([c.flatten() for s in sides for c in s["dim"].chunks]))
        features = []
        for side in sides:
            dims, values = (side[c].combine_chunks() for c in ("dim", "value"))
            dense = np.zeros((side.num_rows, len(names)))
            dense[np.repeat(np.arange(side.num_rows), np.asarray(dims.value_lengths())), pa.compute.index_in(dims.flatten(), names).to_numpy()] = values.flatten().to_numpy()
            features.append(dense)
        same = key[0] == key[1]
        for one, two in ((0, 1),) if same else ((0, 1), (1, 0)):
            if sides[0].num_rows and sides[1].num_rows:
                for i, j, value in best(features[one], features[two], same):
                    yield pa.RecordBatch.from_arrays([sides[one]["rep"].take(pa.array(i)).combine_chunks(), sides[two]["rep"].take(pa.array(j)).combine_chunks(), pa.array(value)], names=["a", "b", "cosine"])

    return run


def _dense_neighbours(classes: DataFrame, k: int, n: int, dims: int, cells: int) -> DataFrame:
    """(a, b, cosine): each class's ``k`` best of each block, by pairs of blocks of at most ``cells`` values a side."""
    spark = classes.sparkSession
    blocks = max(-(-n // max(1, min(BLOCK, cells // dims))), min(spark.sparkContext.defaultParallelism, -(-n // 512)))
    held = classes.select("rep", F.col("f.dim").alias("dim"), F.col("f.value").alias("value"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    return dealt_blocks(held, blocks).groupBy("x", "y").applyInArrow(_block_neighbours(k), "a string, b string, cosine double")


def nearest_trees(features: DataFrame, k: int = 10, probes: int = 8, dense_dims: int = 4096, cells: int = 4_000_000) -> DataFrame:
    """(g, h, cosine, rank): each tree's ``k`` nearest by the cosine of ``features(tree_id, dim, value)`` (normalised), among trees that share a token; ties to the smaller h.

    Trees with equal features are one class, and classes are compared; so a large group of equal trees costs no pairs. A class first meets a few others (``probes`` * k at most, in its
    rarest tokens), which gives a cosine that its k-th neighbour reaches at least. Then it is looked up in the index by its rarer tokens only: what shares nothing but the rest, whose
    length is below that cosine, can't be one of the k. The result is exact. Trees without tokens have no neighbours.

    Where there are ``dense_dims`` tokens or fewer and a pair of classes shares one or more on average, an index leaves nothing out: there all pairs of classes are compared by products of blocks of
    at most ``cells`` values and ``BLOCK`` classes a side, which give each class its best of each block. That is exact as well, and as quadratic as the index would be, in far less time a pair.
    """
    packed = features.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("f"))
    members = checkpointed(packed.withColumn("rep", F.min("tree_id").over(W.partitionBy(F.sha2(F.to_json("f"), 256)))))
    place = F.row_number().over(W.partitionBy("rep").orderBy("tree_id"))
    few = checkpointed(members.select("tree_id", "rep", place.alias("place")).where(F.col("place") <= k + 1))
    rows = members.where("tree_id = rep").select("rep", F.explode("f").alias("x")).select("rep", "x.dim", "x.value")
    rarity = checkpointed(rows.groupBy("dim").agg(F.count("*").alias("df"), F.min("value").alias("least")))
    met = rarity.agg(F.count("*"), F.sum(F.col("df").cast("double") * F.col("df")), F.min("least")).first()
    n = members.where("tree_id = rep").count()
    if 0 < met[0] <= dense_dims and met[1] >= float(n) * n and met[2] > 0:
        best = _dense_neighbours(members.where("tree_id = rep"), k, n, met[0], cells)
    else:
        best = _indexed_neighbours(members, rows, rarity.select("dim", "df"), k, probes)
    near = best.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= k).drop("r")
    own = few.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine")).distinct()
    classes = near.unionByName(own)
    g = members.select(F.col("tree_id").alias("g"), F.col("rep").alias("a"))
    h = few.select(F.col("tree_id").alias("h"), F.col("rep").alias("b"))
    pairs = g.join(classes, "a").join(h, "b").where("g <> h")
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("cosine"), "h"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("g", "h", "cosine", "rank")


def _indexed_neighbours(members: DataFrame, rows: DataFrame, rarity: DataFrame, k: int, probes: int) -> DataFrame:
    """(a, b, cosine) of pairs of classes among which are each one's ``k`` best, by the index and its bounds."""
    maps = members.where("tree_id = rep").select("rep", F.map_from_entries("f").alias("m"))
    ordered = W.partitionBy("rep").orderBy("df", "dim")
    index = rows.join(rarity, "dim")
    upto = F.sum(F.col("value") * F.col("value")).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    index = checkpointed(index.withColumn("left", F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(upto, F.lit(0.0))))).withColumn("nth", F.row_number().over(ordered)))

    def cosines(pairs: DataFrame) -> DataFrame:
        left, right = maps.select(F.col("rep").alias("a"), F.col("m").alias("ma")), maps.select(F.col("rep").alias("b"), F.col("m").alias("mb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", F.round(_dot(F.col("ma"), F.col("mb")), DIGITS).alias("cosine"))

    posting = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("rep"), "rep"))
    sampled = index.withColumn("posting", posting).where(F.col("posting") <= max(2, k)).select("dim", F.col("rep").alias("b"))
    tried = index.where(F.col("nth") <= probes).select(F.col("rep").alias("a"), "dim").join(sampled, "dim").where("a <> b").select("a", "b").distinct()
    best = cosines(tried).withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b")))
    reached = best.where(F.col("r") == k).select(F.col("a").alias("rep"), (F.col("cosine") - 10.0**-DIGITS).alias("reached"))
    looked = index.join(reached, "rep", "left").where((F.col("left") >= F.col("reached")) | F.col("reached").isNull()).select(F.col("rep").alias("a"), "dim")
    met = looked.join(index.select("dim", F.col("rep").alias("b")), "dim").where("a <> b").select("a", "b").distinct()
    return cosines(met)


def landmarks(features: DataFrame, n: int = 32, mode: str = "spread", seed: int | None = 0) -> DataFrame:
    """(tree_id, place): ``n`` trees (all, if fewer). ``random``: by a hash of the id and ``seed``. ``spread``: each one farthest from those before, ties to the smaller id.

    The first of a spread is the hash's first, or without ``seed`` the smallest id. A landmark costs one pass over the trees, which carry their distance to the nearest landmark so far.
    """
    if n < 1:
        raise ValueError("there must be a landmark")
    order = F.col("tree_id") if seed is None else F.xxhash64("tree_id", F.lit(seed))
    if mode == "random":
        chosen = features.select("tree_id").distinct().orderBy(order, "tree_id").limit(n)
        return chosen.select("tree_id", F.row_number().over(W.orderBy(order, "tree_id")).alias("place"))  # n rows
    if mode != "spread":
        raise ValueError("mode must be random or spread")
    spark, schema = features.sparkSession, "tree_id string, place int"
    trees = features.groupBy("tree_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"), F.sum(F.col("value") * F.col("value")).alias("sq"))
    now = checkpointed(trees.withColumn("far", F.lit(float("inf"))))
    found = []
    last = now.orderBy(order, "tree_id").limit(1).collect()
    while last and len(found) < n:
        found.append(last[0]["tree_id"])
        there = F.create_map(*[F.lit(x) for entry in last[0]["m"].items() for x in entry])
        apart = F.col("sq") + last[0]["sq"] - 2 * _dot(F.col("m"), there)
        gone = F.col("tree_id") == last[0]["tree_id"]
        now = now.where(~gone).withColumn("far", F.round(F.least("far", F.greatest(apart, F.lit(0.0))), DIGITS))
        if len(found) % 4 == 0:
            now = checkpointed(now)
        last = now.orderBy(F.desc("far"), "tree_id").limit(1).collect() if len(found) < n else []
    return spark.createDataFrame([(t, i) for i, t in enumerate(found, 1)], schema)
