"""Exact top-k inner-product search over integer vectors by MaxScore.

A dimension is a term, a vector a document whose impact for a term is the product of the query's weight and the
vector's component. For a block of vectors every term has an upper bound, the weight times the block's largest
(for a negative weight: smallest) component. In each block the terms are split: terms whose bounds sum up
to no more than what is missing to the current k-th score are non-essential. A vector's
essential impacts are summed first; the other terms are probed, a group at a time, only for vectors
whose sum so far plus the bounds of the terms left can still reach the k-th score. A block whose bounds cannot
reach it is left out whole. Every shard keeps its own k best, and the shards' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.llm.common import partitions

PROBE_GROUP = 8
EXACT = 1 << 53


class Shard:
    """The postings of some vectors: components by dimension, in blocks with their extremes."""

    BLOCK = 1024

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        #: Vectors that are alike lie together, so that a block's extremes say something.
        order = np.lexsort((ids, vectors.argmax(axis=1))) if vectors.size else np.arange(len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        starts = range(0, len(ids), self.BLOCK)
        self.blocks = [(s, np.ascontiguousarray(self.vectors[s : s + self.BLOCK].T)) for s in starts]
        self.high = [b.max(axis=1) for _, b in self.blocks]
        self.low = [b.min(axis=1) for _, b in self.blocks]

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best of this shard but vec_id = query_id: higher scores, then smaller ids."""
        width = max([len(query), *(len(h) for h in self.high[:1])])
        if not self.blocks:
            return []
        wide = np.zeros(width, query.dtype)
        wide[: len(query)] = query
        wide = wide[: self.blocks[0][1].shape[0]]
        bounds = [np.maximum(wide * h, wide * lo) for h, lo in zip(self.high, self.low, strict=True)]
        ids, scores, floor = np.empty(0, np.int64), np.empty(0, wide.dtype), None
        for b in sorted(range(len(bounds)), key=lambda b: -bounds[b].sum()):
            if floor is not None and bounds[b].sum() < floor:
                break
            at, got = self._block(self.blocks[b][1], wide, bounds[b], floor)
            own = self.ids[self.blocks[b][0] + at]
            other = own != query_id
            ids, scores = np.concatenate((ids, own[other])), np.concatenate((scores, got[other]))
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                floor = scores[-1]
        return list(zip(ids.tolist(), scores.astype(np.int64).tolist(), strict=True))

    @staticmethod
    def _block(block: np.ndarray, query: np.ndarray, bound: np.ndarray, floor) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the block's vectors that may reach ``floor``."""
        everyone = np.arange(block.shape[1])
        if floor is None:
            return everyone, query @ block
        order = np.argsort(bound, kind="stable")
        reach = np.cumsum(bound[order])  # bounds may be negative; a prefix of terms stays under the floor or not
        aside = int(np.searchsorted(np.maximum.accumulate(reach), floor, side="left"))
        essential, others = order[aside:], order[:aside]
        if len(essential) == 0:
            return everyone[:0], query[:0]
        sums = query[essential] @ block[essential]
        for end in range(len(others), 0, -PROBE_GROUP):
            left = others[:end]
            competitive = sums + bound[left].sum() >= floor
            everyone, sums = everyone[competitive], sums[competitive]
            if not len(everyone):
                break
            group = left[-PROBE_GROUP:]
            sums = sums + query[group] @ block[np.ix_(group, everyone)]
        good = sums >= floor
        return everyone[good], sums[good]


def _matrix(rows: list, width: int, dtype) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _search(k: int):
    def run(batches):
        """A task's rows come by shard, a shard's vectors before its queries."""
        now, held, shard = None, [], None
        for batch in batches:
            shards, kinds, ids, values = (batch.column(c).to_pylist() for c in ("shard", "kind", "vec_id", "value"))
            out = []
            for s, kind, i, v in zip(shards, kinds, ids, values, strict=True):
                if s != now:
                    now, held, shard = s, [], None
                if kind == 0:
                    held.append((i, v))
                    continue
                if shard is None:
                    width = max([1, *(len(x) for _, x in held)])
                    most = max([0, *(max(map(abs, x), default=0) for _, x in held)])
                    dtype = np.float64 if most * max(most, 1 << 20) * width < EXACT else np.int64
                    shard, held = Shard(np.array([j for j, _ in held], np.int64), _matrix([x for _, x in held], width, dtype)), []
                query = np.array(v, np.int64)
                exact = len(query) == 0 or shard.vectors.dtype == np.int64 or int(np.abs(query).max()) <= 1 << 20
                searched = shard if exact else Shard(shard.ids, shard.vectors.astype(np.int64))
                out += [(i, j, score) for j, score in searched.top(i, query.astype(searched.vectors.dtype), k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vectors(vec_id, embedding)`` to vec_id, value: floor(scale * component) as longs; unusable rows leave."""
    numbers = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable).select("vec_id", F.transform(numbers, lambda x: F.floor(x * scale).cast("long")).alias("value"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best by integer inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those with the
    query's own vec_id. Rows with a null id, a null vector, or a null or non-finite component take no part.
    Shorter vectors count zero in missing places, an empty one everywhere. Repeated rows are candidates each.
    Components so large that a score may pass 2^63 raise ValueError. A shard holds about ``shard_rows`` vectors; every query is sent to every shard once, as a stated query set.
    """
    spark = vectors.sparkSession
    usable = integer_vectors(vectors, scale)
    # Components beyond the longs are cut off at their ends, which the check meets too.
    largest = F.array_max(F.transform("value", lambda x: F.abs(x.cast("double"))))
    facts = usable.agg(F.count("*").alias("n"), F.max(F.size("value")).alias("width"), F.max(largest).alias("most")).collect()[0]
    if (facts["width"] or 0) * ((facts["most"] or 0.0) + 1) ** 2 >= 2.0**63:
        raise ValueError("components are too large: scores would pass 2^63")
    shards = max(partitions(spark), -(-facts["n"] // shard_rows))
    places = F.pmod(F.xxhash64("vec_id", "value"), F.lit(shards)).cast("int")
    held = usable.select(places.alias("shard"), F.lit(0).alias("kind"), "vec_id", "value")
    asked = usable.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "value")
    dealt = held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
