"""Exemplars of sequence bags ``(cluster, seq, weight, cnt)``: medoid, consensus and likelihood per cluster, and how good an exemplar is. seq is an array of tokens.

Every sequence of a bag counts, and no task holds a bag: medoids come from pairs that are dealt out, consensus and likelihood from sums by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.operators.collections import medoids
from grovekit.operators.masters import fitted_masters


def sequences_by_cluster(pairs: DataFrame) -> DataFrame:
    """``pairs(g, h, cluster_g, cluster_h, seq_g, seq_h)`` to (cluster, source, seq): both sequences of each pair of one cluster."""
    both = F.explode(F.array(F.struct(F.col("g").alias("source"), F.col("seq_g").alias("seq")), F.struct(F.col("h").alias("source"), F.col("seq_h").alias("seq"))))
    return pairs.where("cluster_g = cluster_h").select(F.col("cluster_g").alias("cluster"), both.alias("x")).select("cluster", "x.*")


def matched_sequences(matches: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, source, seq) of ``matches(g, h, pairs)`` within ``clusters(tree_id, cluster)``: the labels of the matched nodes of each side, from the top down.

    A match without pairs gives no sequence; a null label is the text of none.
    """
    own = clusters.select(F.col("tree_id").cast("string").alias("tree_id"), "cluster")
    both = matches.where(F.size("pairs") > 0).join(own.select(F.col("tree_id").alias("g"), "cluster"), "g").join(own.select(F.col("tree_id").alias("h"), F.col("cluster").alias("other")), "h").where(F.col("cluster") == F.col("other"))
    steps = both.select("cluster", "g", "h", F.posexplode("pairs").alias("place", "p"))
    sides = F.explode(F.array(*[F.struct(F.col(t).alias("source"), F.col(f"p.{n}").alias("u"), F.lit(i).alias("side")) for i, (t, n) in enumerate((("g", "u"), ("h", "v")))])).alias("x")
    labels = nodes.select(F.col("tree_id").cast("string").alias("source"), "u", F.coalesce(F.col("label").cast("string"), F.lit("None")).alias("label"))
    named = steps.select("cluster", "g", "h", "place", sides).select("cluster", "g", "h", "place", "x.*").join(labels, ["source", "u"])
    rows = named.groupBy("cluster", "g", "h", "side", "source").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("s"))
    return rows.select("cluster", "source", F.col("s.label").alias("seq"))


def raw_sequences(bags: DataFrame) -> DataFrame:
    """Each sequence as often as it was observed."""
    return bags.select("cluster", "seq", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int")))).select("cluster", "seq")


def median_length(bags: DataFrame, length: Column) -> DataFrame:
    """cluster, median_length over observations: the mean of the two middle ones of an even number, by running counts instead of copies."""
    sized = bags.select("cluster", length.alias("len"), F.col("cnt").cast("long").alias("cnt")).groupBy("cluster", "len").agg(F.sum("cnt").alias("cnt"))
    w = W.partitionBy("cluster")
    run = sized.withColumn("upto", F.sum("cnt").over(w.orderBy("len"))).withColumn("all", F.sum("cnt").over(w))
    low, high = F.expr("(all + 1) DIV 2"), F.expr("all DIV 2 + 1")
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("len")))
    return run.groupBy("cluster").agg(((at(low) + at(high)) / 2).alias("median_length"))


def exemplar_distances(bags: DataFrame, exemplars: DataFrame, distance: Column, longest: Column) -> DataFrame:
    """cluster (of the exemplar), other (of the bag), mean_distance, mean_normalized: weighted means over the bag.

    ``exemplars(cluster, exemplar)`` is one row a cluster, so the join is with the number of clusters, not with bags; ``distance`` and
    ``longest`` are expressions of ``exemplar`` and ``seq``.
    """
    met = bags.select(F.col("cluster").alias("other"), "seq", "weight").crossJoin(F.broadcast(exemplars.select("cluster", "exemplar")))
    part = distance / F.greatest(longest, F.lit(1))
    return met.groupBy("cluster", "other").agg((F.sum(F.col("weight") * distance) / F.sum("weight")).alias("mean_distance"), (F.sum(F.col("weight") * part) / F.sum("weight")).alias("mean_normalized"))


def evaluated(bags: DataFrame, exemplars: DataFrame, distance: Column, longest: Column) -> DataFrame:
    """cluster, own, own_normalized, others (mean over the other bags), gap (others - own); null without other bags."""
    d = exemplar_distances(bags, exemplars, distance, longest)
    own = F.col("cluster") == F.col("other")
    return d.groupBy("cluster").agg(
        F.max(F.when(own, F.col("mean_distance"))).alias("own"), F.max(F.when(own, F.col("mean_normalized"))).alias("own_normalized"), F.avg(F.when(~own, F.col("mean_distance"))).alias("others")
    ).withColumn("gap", F.col("others") - F.col("own"))


def truth_diagnostics(bags: DataFrame, truths: DataFrame, distance: Column) -> DataFrame:
    """cluster, duplicates (share of observations that repeat another), present (the truth is in the bag), best_edit (the nearest to it)."""
    met = bags.join(F.broadcast(truths.select("cluster", F.col("seq").alias("exemplar"))), "cluster")
    return met.groupBy("cluster").agg((1 - F.count("*") / F.sum("cnt")).alias("duplicates"), F.max(F.col("seq") == F.col("exemplar")).alias("present"), F.min(distance).alias("best_edit"))


def bag_report(bags: DataFrame, truths: DataFrame | None = None) -> DataFrame:
    """Per cluster: n_unique, n_observations, total_weight, duplicate_fraction, mean_length (by weight), median_length, min_length, max_length (of ``seq`` as an array of tokens).

    With ``truths(cluster, truth)`` also truth_present, best_edit and best_normalized_edit: the nearest observed sequence; null without a truth.
    """
    length = F.size("seq")
    floor = F.greatest("weight", F.lit(1e-12))
    sums = bags.groupBy("cluster").agg(
        F.count("*").alias("n_unique"), F.sum("cnt").alias("n_observations"), F.sum("weight").alias("total_weight"), (1 - F.count("*") / F.sum("cnt")).alias("duplicate_fraction"),
        (F.sum(length * floor) / F.sum(floor)).alias("mean_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"),
    ).join(median_length(bags, length), "cluster")
    if truths is None:
        return sums
    both = as_text(bags.select("cluster", "seq", F.lit(False).alias("told")).unionByName(truths.select("cluster", F.col("truth").alias("seq"), F.lit(True).alias("told"))))
    told = both.where("told").select("cluster", F.col("text").alias("truth"), F.size("seq").alias("n"))
    edit = F.levenshtein("text", "truth")
    near = both.where("NOT told").join(told, "cluster").groupBy("cluster").agg(
        F.max(F.col("text") == F.col("truth")).alias("truth_present"), F.min(edit).alias("best_edit"), F.min(edit / F.greatest(F.size("seq"), "n", F.lit(1))).alias("best_normalized_edit")
    )
    return sums.join(near, "cluster", "left")


def exemplar_report(exemplars: DataFrame, bags: DataFrame, truths: DataFrame) -> DataFrame:
    """Per cluster of ``exemplars(cluster, seq)``: length, edit_to_truth, norm_edit_to_truth, length_ratio_to_truth (null without a truth), within_mean_edit, within_mean_norm_edit (null for an empty bag).

    Each cluster meets its own bag and truth only.
    """
    kinds = {0: exemplars.select("cluster", "seq", F.lit(1.0).alias("weight")), 1: truths.select("cluster", F.col("truth").alias("seq"), F.lit(1.0).alias("weight")), 2: bags.select("cluster", "seq", "weight")}
    rows = None
    for kind, frame in kinds.items():
        rows = frame.withColumn("kind", F.lit(kind)) if rows is None else rows.unionByName(frame.withColumn("kind", F.lit(kind)))
    spelled = as_text(rows).select("cluster", "kind", "weight", F.coalesce("text", F.lit("")).alias("text"), F.size("seq").alias("n"))
    own = spelled.where("kind = 0").select("cluster", F.col("text").alias("exemplar"), F.col("n").alias("length"))
    met = own.join(spelled.where("kind > 0"), "cluster", "left").withColumn("edit", F.levenshtein("text", "exemplar")).withColumn("norm", F.col("edit") / F.greatest("n", "length", F.lit(1)))
    truth, bag = F.col("kind") == 1, F.col("kind") == 2
    weight = F.sum(F.when(bag, F.col("weight")))
    return met.groupBy("cluster", "length").agg(
        F.max(F.when(truth, F.col("edit"))).alias("edit_to_truth"), F.max(F.when(truth, F.col("norm"))).alias("norm_edit_to_truth"), F.max(F.when(truth, F.col("length") / F.greatest("n", F.lit(1)))).alias("length_ratio_to_truth"),
        (F.sum(F.when(bag, F.col("weight") * F.col("edit"))) / weight).alias("within_mean_edit"), (F.sum(F.when(bag, F.col("weight") * F.col("norm"))) / weight).alias("within_mean_norm_edit"),
    )


def as_text(bags: DataFrame) -> DataFrame:
    """``bags`` with ``text``: each token of ``seq`` as one character, by the token's rank in its cluster, so that built-in distances of texts are those of the sequences."""
    tokens = bags.select("cluster", F.explode("seq").alias("token")).distinct()
    rank = F.dense_rank().over(W.partitionBy("cluster").orderBy("token"))
    letters = tokens.select("cluster", "token", F.decode(F.unhex(F.lpad(F.hex(rank + 0xFF), 4, "0")), "UTF-16BE").alias("letter"))  # from U+0100 on
    spelled = letters.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("token", "letter"))).alias("letters"))
    return bags.join(spelled, "cluster", "left").withColumn("text", F.array_join(F.transform("seq", lambda t: F.col("letters")[t]), "")).drop("letters")


def medoid_exemplars(bags: DataFrame) -> DataFrame:
    """(cluster, seq, value): the sequence of the least weighted edit distance to its bag, ties to the smaller one by its tokens."""
    spelled = as_text(bags.groupBy("cluster", "seq").agg(F.sum("weight").alias("weight")))
    found = medoids(spelled.select("cluster", F.col("text").alias("seq"), "weight"))
    return found.withColumnRenamed("seq", "text").join(spelled.select("cluster", "text", "seq"), ["cluster", "text"]).select(F.col("cluster").cast("string").alias("cluster"), "seq", F.col("objective").alias("value"))


def consensus_exemplars(bags: DataFrame, threshold: float = 1.0, rounds: int = 8) -> DataFrame:
    """(cluster, seq, value): the consensus of all sequences of a bag (see ``masters``); value is their weighted mean edit distance to it.

    A place stays if its emitted weight is at least ``threshold`` times the weight that leaves it out.
    """
    found = fitted_masters(bags, rounds=rounds, threshold=threshold).select("cluster", "seq")
    own = bags.select(F.col("cluster").cast("string").alias("cluster"), "seq", "weight")
    spelled = as_text(own.unionByName(found.withColumn("weight", F.lit(None).cast("double"))))
    texts = spelled.where("weight IS NULL").select("cluster", F.col("seq").alias("best"), F.col("text").alias("exemplar"))
    met = spelled.where("weight IS NOT NULL").join(texts, "cluster")
    mean = F.sum(F.col("weight") * F.levenshtein("text", "exemplar")) / F.sum("weight")
    return met.groupBy("cluster").agg(F.first("best").alias("seq"), mean.alias("value"))


def likelihood_exemplars(bags: DataFrame, rounds: int = 8, eps: float = 0.05) -> DataFrame:
    """(cluster, seq, value): the likeliest master of all sequences of a bag under the indel model; value is their weighted log probability. eps = 0: the simple model."""
    return fitted_masters(bags, rounds=rounds, eps=eps).select("cluster", "seq", "value")


def exemplars_frame(exemplars: DataFrame) -> DataFrame:
    return exemplars.select("cluster", F.array_join("seq", " ").alias("sequence"), F.size("seq").alias("length"))
