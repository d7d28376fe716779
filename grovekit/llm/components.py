"""Connected components of a link table, without bringing links to the driver.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every step is two shuffles of the links, and the number of steps grows with the
logarithm of the largest component. Minima are aggregated before they are joined, so a node with very
many neighbours never meets them in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, component)`` for each node with a link; the component is its smallest node.

    Self-links and repeated links change nothing; rows with a null end are ignored; no links give no rows.
    """
    now = checkpointed(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    before = None
    for _ in range(max_steps):
        now = checkpointed(_small_star(_large_star(now)), free=True)
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
