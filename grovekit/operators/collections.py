"""What is made of pair scores, labels and label sequences; plain DataFrame operations but for the medoids' distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.functions.sequences import distance_sums

FLOOR = 1e-12


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("cnt"))


def inverse_frequency(nodes: DataFrame, power: float = 1.0) -> DataFrame:
    """label, weight: 1 / max((count / total)^power, 1e-8)."""
    counts = label_counts(nodes)
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.join(F.broadcast(total)).select("label", (1 / F.greatest(F.pow(F.col("cnt") / F.col("total"), F.lit(power)), F.lit(1e-8))).alias("weight"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, from 0 in the given order: sorted by ranges, each of which counts on from the ones before. No task gets all rows."""
    ranged = df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()).persist()  # ranges are drawn once
    ahead = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(W.orderBy("range")) - F.col("n"))  # one row a range
    own = F.row_number().over(W.partitionBy("range").orderBy(*order))
    return ranged.withColumn("own", own).join(F.broadcast(ahead.select("range", "ahead")), "range").withColumn("place", F.col("own") - 1 + F.col("ahead")).drop("range", "own", "ahead")


def token_dictionary(tokens: DataFrame, default: float = 1.0) -> DataFrame:
    """token, token_id (in order of the token), weight."""
    distinct = tokens.where("token IS NOT NULL").select("token").distinct()
    return numbered(distinct, F.col("token")).select("token", F.col("place").cast("int").alias("token_id"), F.lit(default).alias("weight"))


def token_vocabulary(tokens: DataFrame, specials: int = 4, min_freq: int = 1) -> DataFrame:
    """token, cnt, token_id: after the special ids, by falling count, then token."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_freq)
    return numbered(counts, F.desc("cnt"), F.col("token")).select("token", "cnt", (F.col("place") + specials).cast("int").alias("token_id"))


def blocking_prefix_keys(nodes: DataFrame, depth: int = 5) -> DataFrame:
    """A key for each prefix of up to ``depth`` tokens of the label, cut at '/' if there is one, else at white space."""
    parts = F.filter(F.when(F.instr("label", "/") > 0, F.split("label", "/")).otherwise(F.split("label", r"\s+")), lambda t: t != "")
    cut = nodes.select("tree_id", "u", parts.alias("t")).where("size(t) > 0")
    return cut.select("tree_id", "u", F.explode(F.expr(f"transform(sequence(1, least({depth}, size(t))), i -> array_join(slice(t, 1, i), '/'))")).alias("key"))


def meeting_pairs(keys: DataFrame) -> DataFrame:
    """(g, h), g < h: trees with a key in common; the keys decide which pairs are looked at, not the collection's size."""
    own = keys.select("tree_id", "key").distinct()
    return own.withColumnRenamed("tree_id", "g").join(own.withColumnRenamed("tree_id", "h"), "key").where("g < h").select("g", "h").distinct()


def rarest_keys(keys: DataFrame, pairs: DataFrame, most: int = 4) -> DataFrame:
    """For each pair (g, h) and node u of g: up to ``most`` of its keys that h has too, the rarest in both trees first."""
    counts = keys.groupBy("tree_id", "key").agg(F.count("*").alias("n"))
    left = keys.select(F.col("tree_id").alias("g"), "u", "key").join(counts.select(F.col("tree_id").alias("g"), "key", F.col("n").alias("n_g")), ["g", "key"])
    both = pairs.join(left, "g").join(counts.select(F.col("tree_id").alias("h"), "key", F.col("n").alias("n_h")), ["h", "key"])
    place = F.row_number().over(W.partitionBy("g", "h", "u").orderBy(F.col("n_g") + F.col("n_h"), "key"))
    return both.withColumn("place", place).where(F.col("place") <= most).select("g", "h", "u", "key", (F.col("n_g") + F.col("n_h")).alias("cnt"), F.col("place").cast("int").alias("place"))


def sparse_candidates(keys: DataFrame, pairs: DataFrame, most: int = 4, stop: int | None = None) -> DataFrame:
    """(g, h, u, v): nodes that share one of u's rarest keys; only if ``stop`` is given, a key with more nodes on a side is not used."""
    left = rarest_keys(keys, pairs, most)
    if stop is None:
        return left.join(keys.select(F.col("tree_id").alias("h"), F.col("u").alias("v"), "key"), ["h", "key"]).select("g", "h", "u", "v").distinct()
    big = keys.groupBy("tree_id", "key").agg(F.count("*").alias("n")).where(F.col("n") > stop)
    left = left.join(big.select(F.col("tree_id").alias("g"), "key"), ["g", "key"], "left_anti").join(big.select(F.col("tree_id").alias("h"), "key"), ["h", "key"], "left_anti")
    return left.join(keys.select(F.col("tree_id").alias("h"), F.col("u").alias("v"), "key"), ["h", "key"]).select("g", "h", "u", "v").distinct()


def both_ways(scores: DataFrame) -> DataFrame:
    return scores.select("g", "h", "score").unionByName(scores.select(F.col("h").alias("g"), F.col("g").alias("h"), "score"))


def row_scales(scores: DataFrame) -> DataFrame:
    """tree_id, scale: the largest score of each tree with another one."""
    return both_ways(scores).groupBy(F.col("g").alias("tree_id")).agg(F.greatest(F.max("score"), F.lit(FLOOR)).alias("scale"))


def similarity(s: Column, i: Column, j: Column, mode: str) -> Column:
    """cosine, jaccard, dice or overlap of a score and its two scales."""
    kinds = {"raw": lambda: s, "cosine": lambda: s / F.sqrt(i * j), "jaccard": lambda: s / F.greatest(i + j - s, F.lit(FLOOR)), "dice": lambda: 2 * s / (i + j), "overlap": lambda: s / F.least(i, j)}
    return kinds[mode]()


def normalised(scores: DataFrame, mode: str, scales: DataFrame | None = None) -> DataFrame:
    """(g, h, similarity), by the given scales or the row maxima."""
    scales = row_scales(scores) if scales is None else scales
    left, right = (scales.select(F.col("tree_id").alias(c), F.col("scale").alias(f"s_{c}")) for c in ("g", "h"))
    return scores.join(left, "g").join(right, "h").select("g", "h", similarity(F.col("score"), F.col("s_g"), F.col("s_h"), mode).alias("similarity"))


def distance(similarities: DataFrame, mode: str = "sqrt_one_minus") -> DataFrame:
    gap = F.greatest(F.lit(0.0), 1 - F.col("similarity"))
    return similarities.select("g", "h", (F.sqrt(gap) if mode == "sqrt_one_minus" else gap).alias("distance"))


def top_matches(scores: DataFrame, k: int) -> DataFrame:
    """Each tree's k best partners, ties to the smaller id."""
    ranked = both_ways(scores).withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("score"), "h")))
    return ranked.where(F.col("rank") <= k).select("g", "h", "score", F.col("rank").cast("int").alias("rank"))


def candidate_pairs(neighbours: DataFrame, rule: str = "union") -> DataFrame:
    """Pairs g < h of a neighbour table: named by one of the two (union) or by both (mutual)."""
    ordered = neighbours.groupBy(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).agg(F.count("*").alias("n"))
    return ordered.where("n >= 2" if rule == "mutual" else "n >= 1").select("g", "h")


def candidate_diagnostics(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """One row: trees, pairs, mean and largest degree, isolated trees."""
    ends = pairs.select(F.col("g").alias("tree_id")).union(pairs.select(F.col("h").alias("tree_id"))).groupBy("tree_id").agg(F.count("*").alias("degree"))
    degree = trees.select("tree_id").distinct().join(ends, "tree_id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return degree.agg(F.count("*").alias("n_trees"), (F.sum("degree") / 2).cast("long").alias("n_pairs"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.sum((F.col("degree") == 0).cast("long")).alias("isolated"))


def candidate_report(pairs: DataFrame, trees: DataFrame, classes: DataFrame | None = None, scores: DataFrame | None = None, k: int = 10) -> DataFrame:
    """One row on the candidate ``pairs(g, h)`` of ``trees(tree_id)``.

    n_points, n_candidate_pairs, avg_degree, min_degree, max_degree, isolated_fraction; with ``classes(tree_id, label)`` same_class_fraction (of the candidates) and same_class_pair_recall (of all pairs
    of one class); with the ``scores(g, h, score)`` of all pairs mean_exact_sim_all_pairs, mean_exact_sim_candidates and topk_recall: the mean share of a tree's ``k`` best partners (by
    score, ties to the smaller id) that are candidates. What has no pair to speak of is null, a recall of nothing 0.
    """
    own = pairs.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).where("g <> h").distinct()
    ids = trees.select(F.col("tree_id").cast("string").alias("tree_id")).distinct()
    ends = own.select(F.col("g").alias("tree_id"), F.col("h").alias("other")).unionByName(own.select(F.col("h").alias("tree_id"), F.col("g").alias("other")))
    degree = ids.join(ends.groupBy("tree_id").agg(F.count("*").alias("n")), "tree_id", "left").fillna(0, ["n"])
    row = degree.agg(
        F.count("*").alias("n_points"), (F.sum("n") / 2).cast("long").alias("n_candidate_pairs"), F.avg("n").alias("avg_degree"), F.min("n").alias("min_degree"), F.max("n").alias("max_degree"), F.avg((F.col("n") == 0).cast("double")).alias("isolated_fraction")
    )
    if classes is not None:
        named = classes.select(F.col("tree_id").cast("string").alias("tree_id"), "label")
        both = own.join(named.select(F.col("tree_id").alias("g"), F.col("label").alias("a")), "g").join(named.select(F.col("tree_id").alias("h"), F.col("label").alias("b")), "h")
        same = (F.col("a") == F.col("b")).cast("double")
        held = both.agg(F.avg(same).alias("same_class_fraction"), F.coalesce(F.sum(same), F.lit(0.0)).alias("held"))
        total = named.groupBy("label").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)).alias("total"))
        row = row.join(held).join(total).withColumn("same_class_pair_recall", F.col("held") / F.greatest("total", F.lit(1.0))).drop("held", "total")
    if scores is not None:
        known = scores.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), "score")
        row = row.join(known.agg(F.avg("score").alias("mean_exact_sim_all_pairs"))).join(known.join(own, ["g", "h"]).agg(F.avg("score").alias("mean_exact_sim_candidates")))
        best = top_matches(scores, k).select(F.col("g").alias("tree_id"), F.col("h").alias("other"))
        found = best.join(ends.withColumn("hit", F.lit(1.0)), ["tree_id", "other"], "left").groupBy("tree_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
        row = row.join(found.agg(F.avg("share").alias("topk_recall")))
    return row


def sequence_bags(sequences: DataFrame) -> DataFrame:
    """``sequences(cluster, source, seq)`` to cluster, seq, weight, cnt; an observation weighs 1 / (its source's observations in the cluster)."""
    per = F.count("*").over(W.partitionBy("cluster", "source"))
    return sequences.withColumn("w", 1 / per).groupBy("cluster", "seq").agg(F.sum("w").alias("weight"), F.count("*").alias("cnt"))


def bag_summary(bags: DataFrame) -> DataFrame:
    length = F.size(F.split("seq", " "))
    return bags.groupBy("cluster").agg(F.count("*").alias("n_unique"), F.sum("cnt").alias("n_observations"), F.sum("weight").alias("total_weight"), (F.sum(length * F.col("weight")) / F.sum("weight")).alias("mean_length"))


def dealt_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows(block, ...)``, each once for every pair (x, y), x <= y, of blocks that its own one is in."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = rows.select("*", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other")
    # a fixed number of partitions, because few bytes make much work here
    return dealt.repartition(max(1, min(blocks * (blocks + 1) // 2, 16 * rows.sparkSession.sparkContext.defaultParallelism)), "x", "y")


def _distance_sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks x <= y of a cluster: what each sequence's distances to those of the other block weigh."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    left, right = (sorted((r for r in rows if r["block"] == side.as_py()), key=lambda r: r["seq"]) for side in key[1:])
    if not left or not right:
        return
    own, other = distance_sums(*(x for side in (left, right) for x in ([r["seq"] for r in side], np.array([r["weight"] for r in side], float))))
    if key[1] == key[2]:  # a block with itself: its own sums are whole
        right, other = [], other[:0]
    seqs = [r["seq"] for r in [*left, *right]]
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(seqs), key[0].type), pa.array(seqs, pa.string()), pa.array(np.concatenate((own, other)))], names=["cluster", "seq", "part"])


def medoids(bags: DataFrame, block: int = 4096) -> DataFrame:
    """cluster, seq, objective: the sequence (one character a token) with the smallest weighted edit distance to its bag, ties to the smaller one.

    All pairs of a cluster are compared, by pairs of blocks of at most ``block`` sequences that follow each other in order and so share prefixes; a pair of blocks gives a row a sequence, not a row a pair.
    """
    sizes = bags.groupBy(F.col("cluster").alias("_cluster")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = bags.join(sizes, F.col("cluster").eqNullSafe(F.col("_cluster"))).select("cluster", "seq", F.col("weight").cast("double").alias("weight"), F.floor((F.row_number().over(W.partitionBy("cluster").orderBy("seq")) - 1) / block).cast("int").alias("block"), "blocks")
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("cluster", "seq", "weight", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    # a fixed number of partitions, because few bytes make much work here
    dealt = dealt.repartition(16 * bags.sparkSession.sparkContext.defaultParallelism, "cluster", "x", "y")
    parts = dealt.groupBy("cluster", "x", "y").applyInArrow(_distance_sums, f"cluster {bags.schema['cluster'].dataType.simpleString()}, seq string, part double")
    cost = parts.groupBy("cluster", "seq").agg(F.sum("part").alias("objective"))
    return cost.groupBy("cluster").agg(F.min(F.struct(F.round("objective", 6).alias("objective"), "seq")).alias("m")).select("cluster", "m.seq", "m.objective")


def positional_consensus(tokens: DataFrame) -> DataFrame:
    """``tokens(cluster, len, pos, token)``: the most frequent token of each place among sequences of one length, ties to the smaller one."""
    counts = tokens.groupBy("cluster", "len", "pos", "token").agg(F.count("*").alias("cnt"))
    place = F.row_number().over(W.partitionBy("cluster", "len", "pos").orderBy(F.desc("cnt"), "token"))
    return counts.withColumn("place", place).where("place = 1").select("cluster", "len", "pos", "token", "cnt")


def replication_counts(bags: DataFrame, target: int = 96) -> DataFrame:
    """cluster, seq, copies: ``target`` shared out by weight, the rest to the largest fractions (ties to the smaller sequence), at least one each."""
    w = W.partitionBy("cluster")
    shares = bags.withColumn("raw", F.round(F.lit(target) * F.col("weight") / F.sum("weight").over(w), 9)).withColumn("low", F.floor("raw"))
    ranked = shares.withColumn("spare", F.lit(target) - F.sum("low").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc(F.col("raw") - F.col("low")), "seq")))
    return ranked.select("cluster", "seq", F.greatest(F.lit(1), F.col("low") + (F.col("place") <= F.col("spare")).cast("int")).cast("long").alias("copies"))


def rand_and_information(pairs: DataFrame) -> DataFrame:
    """``pairs(truth, found)`` per item: adjusted Rand index and normalised mutual information (arithmetic mean)."""
    cells = pairs.groupBy("truth", "found").agg(F.count("*").alias("n"))
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("truth", "found"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    entropy = lambda c: -F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))
    total = cells.agg(F.sum("n").alias("total"), two("n").alias("same"))
    a = rows.join(F.broadcast(total.select("total"))).agg(two("n_truth").alias("a"), entropy("n_truth").alias("h_a"))
    b = columns.join(F.broadcast(total.select("total"))).agg(two("n_found").alias("b"), entropy("n_found").alias("h_b"))
    mutual = cells.join(rows, "truth").join(columns, "found").join(F.broadcast(total.select("total"))).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("n_truth") * F.col("n_found")))).alias("mi"))
    one = total.join(a).join(b).join(mutual)
    chance = F.col("a") * F.col("b") / (F.col("total") * (F.col("total") - 1) / 2)
    return one.select(F.round((F.col("same") - chance) / ((F.col("a") + F.col("b")) / 2 - chance), 6).alias("ari"), F.round(2 * F.col("mi") / (F.col("h_a") + F.col("h_b")), 6).alias("nmi"))
