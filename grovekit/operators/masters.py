"""The hidden master of each cluster's sequences, by expectation and maximisation over all of them.

A round is a map and two aggregates. Every observation of every bag meets its cluster's master and is aligned to it by the likeliest alignment (the indel
model of ``functions.likelihood``: inserts before each place, a place left out or emitted, sometimes as another token). What the alignments say is summed by
(cluster, place, token), already within a task, and from the sums follow the new master and its rates: a place keeps its heaviest token, goes if it is left out more than
it is emitted, and a gap gets a place of its own if most observations insert one token there. No task holds a bag; only sums by place meet.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.functions.likelihood import HIGHEST, LOWEST
from grovekit.sources.storage import checkpointed

EVIDENCE = "cluster string, kind string, place int, token string, weight double"
#: Masters that may be sent to every task; more of them are joined by a shuffle.
SENT = 10_000


def _log(x):
    with np.errstate(divide="ignore"):
        return np.log(x)


def aligned(master: list, seen: list[list], share: dict, unknown: float, p_ins: float, p_del: float, eps: float) -> tuple[np.ndarray, list[list[tuple[str, int, object]]]]:
    """Log probabilities of the likeliest alignments of all sequences ``seen``, and their steps from the front: ("M", place, token), ("D", place, None), ("I", gap, token).

    All sequences take a row of the table together; a run of inserts is a running maximum. Ties: emitted, then left out, then inserted.
    """
    width = max([len(s) for s in seen], default=0)
    codes: dict = {}
    own = np.array([codes.setdefault(t, len(codes)) for t in master], np.int64)
    table = np.array([[codes.setdefault(t, len(codes)) for t in s] + [-1] * (width - len(s)) for s in seen], np.int64).reshape(len(seen), width)
    background = np.array([*(share.get(t, unknown) for t in codes), 1.0])
    cost = _log(p_ins) + _log(background[table])
    runs = np.concatenate([np.zeros((len(seen), 1)), np.cumsum(cost, axis=1)], axis=1)
    row, how = runs.copy(), np.full((len(master) + 1, len(seen), width + 1), 2, np.int8)
    for i, token in enumerate(own, 1):
        emit = _log((1 - eps) * (table == token) + eps * background[table])
        match = np.concatenate([np.full((len(seen), 1), -np.inf), row[:, :-1] + _log(1 - p_ins) + _log(1 - p_del) + emit], axis=1)
        skip = row + _log(1 - p_ins) + _log(p_del)
        entered = np.maximum(match, skip)
        after = np.maximum.accumulate(entered - runs, axis=1) + runs
        inserted = after > entered + 1e-9
        how[i] = np.where(inserted, 2, np.where(match >= skip, 0, 1))
        row = np.where(inserted, after, entered)
    sizes = np.array([len(s) for s in seen], np.int64)
    number = np.arange(len(seen))
    value = row[number, sizes] + _log(1 - p_ins)
    steps: list[list] = [[] for _ in seen]
    i, j = np.full(len(seen), len(master)), sizes.copy()
    while True:
        on = np.flatnonzero((i > 0) | (j > 0))
        if not len(on):
            break
        kind = how[i[on], on, j[on]]
        for b, k in zip(on, kind, strict=True):
            if k == 2:
                steps[b].append(("I", int(i[b]), seen[b][j[b] - 1]))
            else:
                steps[b].append(("M", int(i[b]) - 1, seen[b][j[b] - 1]) if k == 0 else ("D", int(i[b]) - 1, None))
        i[on] -= kind != 2
        j[on] -= kind != 1
    return value, [s[::-1] for s in steps]


def _evidence(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_cluster: dict[str, list[dict]] = defaultdict(list)
            for r in batch.to_pylist():
                by_cluster[r["cluster"]].append(r)
            total: dict[tuple, float] = defaultdict(float)
            for cluster, rows in by_cluster.items():
                rows.sort(key=lambda r: len(r["seq"]))
                m = rows[0]
                while rows:
                    most = max(1, cells // ((len(m["master"]) + 1) * (len(rows[-1]["seq"]) + 1)))
                    some, rows = rows[-most:], rows[:-most]
                    values, steps = aligned(m["master"], [r["seq"] for r in some], dict(m["share"]), m["unknown"], m["p_ins"], m["p_del"], m["eps"])
                    for r, value, path in zip(some, values, steps, strict=True):
                        w = r["weight"]
                        total[cluster, "L", 0, ""] += w * float(value)
                        total[cluster, "W", 0, ""] += w
                        gap = None
                        for kind, place, token in path:
                            if kind == "I":
                                total[cluster, "I", 0, ""] += w
                                if gap != place:  # the first of a run stands for a place that may be missing here
                                    total[cluster, "G", place, token] += w
                                gap = place
                            else:
                                total[cluster, kind, place, token or ""] += w
            if total:
                columns = list(zip(*((*k, w) for k, w in total.items()), strict=True))
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "kind", "place", "token", "weight"])

    return run


def backgrounds(bags: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """cluster, share (map of token shares smoothed by ``pseudo`` counts), unknown."""
    counts = bags.select("cluster", "weight", F.explode("seq").alias("token")).groupBy("cluster", "token").agg(F.sum("weight").alias("n"))
    total = F.sum("n").over(W.partitionBy("cluster")) + pseudo * F.count("*").over(W.partitionBy("cluster"))
    shares = counts.withColumn("total", total).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("token", ((F.col("n") + pseudo) / F.col("total")).alias("s")))).alias("share"), (pseudo / F.max("total")).alias("unknown"))
    return shares


def heaviest_sequences(bags: DataFrame) -> DataFrame:
    """cluster, master: the sequence of the largest weight, ties to the smaller one."""
    own = bags.where(F.size("seq") > 0).groupBy("cluster", "seq").agg(F.round(F.sum("weight"), 9).alias("weight"))
    return own.groupBy("cluster").agg(F.min(F.struct((-F.col("weight")).alias("w"), "seq")).alias("x")).select("cluster", F.col("x.seq").alias("master"))


def _maximised(evidence: DataFrame, masters: DataFrame, threshold: float, fixed: bool, substitutions: bool) -> DataFrame:
    """The next masters and rates from the sums of a round."""
    total = lambda kind, name: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("weight"))), F.lit(0.0)).alias(name)
    whole = evidence.groupBy("cluster").agg(*[total(k, k) for k in "MDIW"])
    heavy = W.partitionBy("cluster", "kind", "place").orderBy(F.desc(F.round("weight", 9)), "token")
    tops = evidence.where("kind IN ('M', 'G')").withColumn("first", F.row_number().over(heavy)).where("first = 1").select("cluster", "kind", "place", "token", "weight")
    sums = evidence.where("kind IN ('M', 'D')").groupBy("cluster", "place").agg(total("M", "matched"), total("D", "deleted"))
    old = masters.select("cluster", F.posexplode("master").alias("place", "was"))
    places = old.join(sums, ["cluster", "place"], "left").join(tops.where("kind = 'M'").select("cluster", "place", "token"), ["cluster", "place"], "left")
    kept = places.select("cluster", (2 * F.col("place") + 1).alias("at"), F.coalesce("token", "was").alias("token"), (F.coalesce("matched", F.lit(0.0)) >= threshold * F.coalesce("deleted", F.lit(0.0))).alias("stays"))
    items = kept if fixed else kept.where("stays")
    if not fixed:
        new = tops.where("kind = 'G'").join(whole.select("cluster", "W"), "cluster").where(F.col("weight") > threshold * (F.col("W") - F.col("weight")))
        items = items.drop("stays").unionByName(new.select("cluster", (2 * F.col("place")).alias("at"), "token"))
    after = items.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("after"))
    clip = lambda c: F.least(F.greatest(c, F.lit(LOWEST)), F.lit(HIGHEST))
    length = F.size("master")
    rates = masters.join(whole, "cluster").select(
        "cluster", clip((F.col("D") + 0.5) / (F.col("D") + F.col("M") + 1)).alias("p_del"), clip((F.col("I") + 0.5) / (F.col("I") + F.col("W") * (length + 1) + 1)).alias("p_ins")
    )
    out = masters.select("cluster", "share", "unknown", "master", F.col("eps").alias("was_eps")).join(after, "cluster", "left").join(rates, "cluster")
    out = out.withColumn("master", F.coalesce("after", "master")).drop("after")
    if not substitutions:
        return out.withColumn("eps", F.col("was_eps")).drop("was_eps")
    emitted = evidence.where("kind = 'M'").join(tops.where("kind = 'M'").select("cluster", "place", F.col("token").alias("top")), ["cluster", "place"]).join(masters.select("cluster", "share", "unknown"), "cluster")
    grid = emitted.withColumn("e", F.explode(F.expr("transform(sequence(0, 200), i -> 0.3D * i / 200)")))
    chance = (1 - F.col("e")) * (F.col("token") == F.col("top")).cast("double") + F.col("e") * F.coalesce(F.col("share")[F.col("token")], "unknown")
    fits = grid.groupBy("cluster", "e").agg(F.sum(F.col("weight") * F.when(chance > 0, F.log(chance)).otherwise(F.lit(-1e300))).alias("fit"))
    best = fits.groupBy("cluster").agg(F.min(F.struct((-F.col("fit")).alias("f"), "e")).alias("x")).select("cluster", F.greatest(F.col("x.e"), F.lit(LOWEST)).alias("eps"))
    return out.join(best, "cluster", "left").withColumn("eps", F.coalesce("eps", "was_eps")).drop("was_eps")


def fitted_masters(bags: DataFrame, start: DataFrame | None = None, rounds: int = 8, threshold: float = 1.0, fixed: bool = False, p_ins: float = 0.1, p_del: float = 0.1, eps: float = 0.05, cells: int = 4_000_000) -> DataFrame:
    """(cluster, seq, value, p_ins, p_del, eps): the likeliest master that was seen in up to ``rounds`` rounds; value is the bag's weighted log probability by its likeliest alignments.

    ``bags(cluster, seq, weight, ...)``: arrays of tokens; empty sequences count as observations. It starts from ``start(cluster, master)``, else from each cluster's heaviest sequence.
    ``fixed`` keeps the start's length. With eps = 0 an emitted token must be the master's. Clusters without a token have no row. Ends when no master and rate changes.
    """
    observed = bags.select(F.col("cluster").cast("string").alias("cluster"), "seq", F.col("weight").cast("double").alias("weight"))
    begun = (start or heaviest_sequences(observed)).select(F.col("cluster").cast("string").alias("cluster"), "master")
    masters = checkpointed(begun.join(backgrounds(observed), "cluster").select("cluster", "share", "unknown", "master", F.lit(eps).alias("eps"), F.lit(p_del).alias("p_del"), F.lit(p_ins).alias("p_ins")))
    sent = masters.count() <= SENT
    history = None
    for turn in range(rounds + 1):
        side = F.broadcast(masters) if sent else masters
        evidence = observed.join(side, "cluster").mapInArrow(_evidence(cells), EVIDENCE).groupBy("cluster", "kind", "place", "token").agg(F.sum("weight").alias("weight"))
        evidence = checkpointed(evidence)
        value = evidence.where("kind = 'L'").select("cluster", F.col("weight").alias("value"))
        seen = masters.select("cluster", F.col("master").alias("seq"), "p_ins", "p_del", "eps", F.lit(turn).alias("turn")).join(value, "cluster")
        history = seen if history is None else history.unionByName(seen)
        if turn == rounds:
            break
        after = checkpointed(_maximised(evidence, masters, threshold, fixed, eps > 0).select(*masters.columns))
        same = after.join(masters.select("cluster", *[F.col(c).alias(f"o_{c}") for c in ("master", "eps", "p_del", "p_ins")]), "cluster")
        moved = same.where((F.col("master") != F.col("o_master")) | (F.abs(F.col("eps") - F.col("o_eps")) + F.abs(F.col("p_del") - F.col("o_p_del")) + F.abs(F.col("p_ins") - F.col("o_p_ins")) > 1e-6))
        if moved.isEmpty():
            break
        masters = after
    best = history.groupBy("cluster").agg(F.min(F.struct((-F.round("value", 6)).alias("v"), "turn", "seq", "value", "p_ins", "p_del", "eps")).alias("x"))
    return best.select("cluster", "x.seq", "x.value", "x.p_ins", "x.p_del", "x.eps")
