"""Hard negatives by product quantisation with stored residual norms.

A vector's components are cut into groups of a few; a codebook for each group, fitted on a bounded sample, gives the group's nearest centre. The index
holds, for every row, the centres' numbers, the length of what each centre leaves over, and the vector itself. Centres are whole
numbers, so the score of an anchor with a row's centres, a sum of entries of the anchor's lookup table, is a whole number too. What it misses is
the anchor times the residuals, and group by group that is no more than the product of the two lengths: the true score lies within a bound that is
known beforehand. Rows whose interval can't reach the best ones found so far, or a window of scores, are never scored; all others are scored exactly.

Rows are dealt to shards, and anchors, a stated part of the rows, go to each shard once to find their positives and once with the windows that
the positives set. A shard returns its best few a window, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.llm.common import checkpointed, partitions

INDEX = "vec_id long, label long, vector binary, codes binary, norms binary"
#: Scores up to here are whole numbers in doubles, with room for the bounds.
EXACT = 1 << 52
#: Anchors that are looked up together, and rows of a shard at a time.
ANCHORS, ROWS = 32, 4096


def usable_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vectors(vec_id, label, embedding)`` to vec_id, label, value: floor(scale * component) as doubles; rows with a null or a non-finite component leave."""
    numbers = F.col("embedding").cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(numbers, lambda x: F.floor(x * scale).cast("double")).alias("value"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; missing places count zero."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (points @ centres.T), axis=1)


def fitted_centres(points: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Whole-numbered centres of ``points`` (Lloyd's rounds from points drawn with a fixed seed)."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= centres:
        return distinct
    now = distinct[np.sort(np.random.default_rng(0).choice(len(distinct), centres, replace=False))]
    for _ in range(rounds):
        own = nearest(points, now)
        count = np.bincount(own, minlength=len(now))
        total = np.stack([np.bincount(own, weights=points[:, c], minlength=len(now)) for c in range(points.shape[1])], axis=1)
        now = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], now)
    return np.round(now)


def codebooks(usable: DataFrame, width: int, group: int, centres: int, share: float, sample: int) -> list[np.ndarray]:
    """The centres of each group of components, fitted on about ``sample`` rows that their hash chooses; each group is a task's work."""
    groups = -(-width // group)
    chosen = usable.where(F.pmod(F.xxhash64("vec_id", "value"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(2 * sample).select("value")
    padded = F.concat("value", F.array_repeat(F.lit(0.0), F.lit(groups * group) - F.size("value")))
    parts = chosen.select(padded.alias("v")).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.slice("v", g * group + 1, group))).alias("g", "part"))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        found = fitted_centres(_matrix(table.column("part").combine_chunks(), group), centres)
        return pa.table({"g": pa.array([key[0].as_py()] * len(found), pa.int32()), "centre": pa.array(list(found), pa.list_(pa.float64()))})

    rows = parts.groupBy("g").applyInArrow(fit, "g int, centre array<double>").collect()  # groups x centres
    out = [np.array([r["centre"] for r in rows if r["g"] == g]) for g in range(groups)]
    return [c if len(c) else np.zeros((1, group)) for c in out]


def _encode(books: list[np.ndarray], width: int, group: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.zeros((batch.num_rows, len(books) * group))
            vectors[:, :width] = _matrix(batch.column("value"), width)
            codes = np.empty((len(vectors), len(books)), np.uint8)
            norms = np.empty((len(vectors), len(books)), np.float32)
            for g, book in enumerate(books):
                part = vectors[:, g * group : (g + 1) * group]
                for at in range(0, len(part), ROWS):
                    codes[at : at + ROWS, g] = nearest(part[at : at + ROWS], book)
                left = np.sqrt(((part - book[codes[:, g]]) ** 2).sum(axis=1))
                norms[:, g] = np.nextafter(left.astype(np.float32), np.float32(np.inf))  # never less than the length
            held = [[r.tobytes() for r in table] for table in (vectors.astype(kind), codes, norms)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *(pa.array(h, pa.binary()) for h in held)], names=["vec_id", "label", "vector", "codes", "norms"])

    return run


def _table(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class Shard:
    """The index rows of a shard, in order of their labels."""

    def __init__(self, rows: list[pa.RecordBatch], books: list[np.ndarray], group: int, kind: str):
        table = pa.Table.from_batches(rows).select(["vec_id", "label", "vector", "codes", "norms"]).combine_chunks()
        columns = {c: table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type) for c in table.column_names}
        label = np.asarray(columns["label"], np.int64)
        order = np.argsort(label, kind="stable")
        self.label, self.ids = label[order], np.asarray(columns["vec_id"], np.int64)[order]
        width = len(books) * group
        self.vectors = _table(columns["vector"], kind, width)[order]
        self.codes = _table(columns["codes"], "u1", len(books))[order]
        self.norms = _table(columns["norms"], "<f4", len(books))[order].astype(np.float64)
        self.books, self.group = books, group

    def intervals(self, anchors: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Looked-up scores of rows start to end with the anchors, and how far the true ones may be off: (anchors, rows)."""
        count = len(anchors)
        scores = np.zeros((end - start, count))
        for g, book in enumerate(self.books):
            lookup = book @ anchors[:, g * self.group : (g + 1) * self.group].T  # (centres, anchors)
            for at in range(start, end, ROWS):
                to = min(at + ROWS, end)
                scores[at - start : to - start] += lookup[self.codes[at:to, g]]
        lengths = np.sqrt((anchors.reshape(count, len(self.books), self.group) ** 2).sum(axis=2))
        return np.ascontiguousarray(scores.T), (lengths @ self.norms[start:end].T) * (1 + 1e-9)

    def exact(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[at].astype(np.float64) @ anchor

    def own(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))

    def best(self, score: np.ndarray, off: np.ndarray, rows: np.ndarray, anchor: np.ndarray, low: float, high: float, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows with low <= score <= high: higher scores first, then smaller ids. ``rows`` are places in the shard."""
        possible = np.flatnonzero((score + off >= low) & (score - off <= high))
        if not len(possible):
            return []
        near = possible
        if len(possible) > 8 * k:  # what most likely lies just below ``high`` is scored first
            likely = np.where(score[possible] <= high, score[possible], 2 * min(high, float(EXACT)) - score[possible])
            near = possible[np.argpartition(-likely, 8 * k)[: 8 * k]]
        got = self.exact(rows[near], anchor)
        inside = np.sort(got[(got >= low) & (got <= high)])
        if len(near) < len(possible):
            floor = inside[-k] if len(inside) >= k else low
            rest = np.setdiff1d(possible[score[possible] + off[possible] >= floor], near, assume_unique=True)
            near, got = np.concatenate((near, rest)), np.concatenate((got, self.exact(rows[rest], anchor)))
        fits = (got >= low) & (got <= high)
        ids, got = self.ids[rows[near[fits]]], got[fits]
        first = np.lexsort((ids, -got))[:k]
        return [(int(i), int(s)) for i, s in zip(ids[first], got[first], strict=True)]

    def positives(self, anchors: list[tuple], vectors: np.ndarray, label: int, k: int) -> Iterator[tuple]:
        """The k best of the anchors' own label (all anchors here have it)."""
        start, end = self.own(label)
        rows = np.arange(start, end)
        for at in range(0, len(anchors) if end > start else 0, ANCHORS):
            scores, offs = self.intervals(vectors[at : at + ANCHORS], start, end)
            for (key, anchor_id), vector, score, off in zip(anchors[at : at + ANCHORS], vectors[at : at + ANCHORS], scores, offs, strict=True):
                other = self.ids[start:end] != anchor_id
                own = rows[other]
                floor = np.partition((score - off)[other], len(own) - k)[-k] if len(own) > k else -np.inf
                for i, s in self.best(score[other], off[other], own, vector, floor, np.inf, k):
                    yield key, anchor_id, i, s

    def negatives(self, anchors: list[tuple], vectors: np.ndarray, label: int, k: int, low: int, high: int) -> Iterator[tuple]:
        """The k best of other labels in the window of each positive (place, vec_id, score) of an anchor."""
        start, end = self.own(label)
        spans = [(a, b) for a, b in ((0, start), (end, len(self.ids))) if b > a]
        rows = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.empty(0, np.int64)
        for at in range(0, len(anchors) if spans else 0, ANCHORS):
            both = [self.intervals(vectors[at : at + ANCHORS], a, b) for a, b in spans]
            scores, offs = (np.concatenate([x[c] for x in both], axis=1) for c in (0, 1))
            for (key, anchor_id, positives), vector, score, off in zip(anchors[at : at + ANCHORS], vectors[at : at + ANCHORS], scores, offs, strict=True):
                other = self.ids[rows] != anchor_id
                own, score, off = (rows, score, off) if other.all() else (rows[other], score[other], off[other])
                windows: dict[int, list] = {}
                for place, positive_id, p in positives:
                    if p not in windows:  # whole scores s with low * p <= 100 s <= high * p
                        windows[p] = self.best(score, off, own, vector, -(-low * p // 100), high * p // 100, k) if low * p <= high * p else []
                    for i, s in windows[p]:
                        yield key, anchor_id, place, positive_id, p, i, s


def _dealt(index: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Index rows and a copy of each anchor by shard: rows (kind 0) before anchors (kind 1), anchors by label."""
    place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")
    asked = [f for f in anchors.schema.fields if f.name not in index.columns]
    held = index.select(place.alias("shard"), F.lit(0).alias("kind"), "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in asked])
    nothing = F.lit(None).cast("binary")
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "label", "vector", nothing.alias("codes"), nothing.alias("norms"), *[f.name for f in asked])
    return held.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "label")


def _search(books: list[np.ndarray], group: int, kind: str, find, schema: str, block: int = 1024):
    """Over a task's shards: builds each, then ``find(shard, anchor_rows, vectors, label)`` for anchors of one label, some at a time."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            numbers, roles = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            labels = np.asarray(batch.column("label"))
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (roles[1:] != roles[:-1]) | ((labels[1:] != labels[:-1]) & (roles[1:] == 1))) + 1
            for a, b in zip([0, *edges], [*edges, len(numbers)], strict=True):
                if b == a:
                    continue
                if numbers[a] != now:
                    now, held, shard = numbers[a], [], None
                part = batch.slice(a, b - a)
                if roles[a] == 0:
                    held.append(part)
                    continue
                if shard is None and held:
                    shard, held = Shard(held, books, group, kind), []
                for at in range(0, b - a if shard else 0, block):
                    some = part.slice(at, block)
                    vectors = _table(some.column("vector"), kind, len(books) * group).astype(np.float64)
                    rows = list(find(shard, some, vectors, int(labels[a])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256,
    group: int = 2, centres: int = 256, sample: int = 8192, shard_bytes: int = 32 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors(vec_id, label, embedding, ...)``.

    Scores are inner products of the components' floors at ``scale``. Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are the
    ``positives`` best rows of its label, its negatives for each of them the ``negatives`` best rows of another label with
    low_percent * p <= 100 * n <= high_percent * p; higher scores first, ties by smaller vec_id. Rows with the anchor's own vec_id are neither. Rows with a null id,
    label, vector or component or a non-finite component take no part. Shorter vectors count zero in missing places, an empty one everywhere. Repeated rows are
    candidates each; equal rows are one anchor, unlike ones with one id are an anchor each. A negative positive score has an empty window, the window of 0 is 0. An empty table
    gives no rows. Components so large that a score may pass 2^52 raise ValueError. Other columns are not read.

    Codebooks are fitted on about ``sample`` rows; the index holds all rows, and since the bounds are rigorous the result is exact whatever the sample.
    """
    spark = vectors.sparkSession
    usable = usable_vectors(vectors, scale)
    most = F.max(F.greatest(F.abs(F.array_max("value")), F.abs(F.array_min("value"))))
    facts = usable.agg(F.count("*").alias("n"), F.max(F.size("value")).alias("width"), most.alias("most")).collect()[0]
    width, largest = max(1, facts["width"] or 1), (facts["most"] or 0.0) + 1
    if width * largest * largest >= EXACT:
        raise ValueError("components are too large for exact scores")
    books = codebooks(usable, width, group, centres, min(1.0, sample / max(1, facts["n"])), sample)
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    index = checkpointed(usable.mapInArrow(_encode(books, width, group, kind), INDEX))
    row_bytes = len(books) * (group * np.dtype(kind).itemsize + 1 + 8)
    shards = max(partitions(spark), -(-facts["n"] * row_bytes // shard_bytes))
    anchors = index.where(F.col("vec_id") % every == 0).select("vec_id", "label", "vector").distinct().withColumn("key", F.xxhash64("vec_id", "label", "vector"))

    def find_positives(shard, rows, sent, label):
        return shard.positives(list(zip(rows.column("key").to_pylist(), rows.column("vec_id").to_pylist(), strict=True)), sent, label, positives)

    schema = "key long, anchor_id long, positive_id long, positive_score long"
    near = _dealt(index, anchors, shards).mapInArrow(_search(books, group, kind, find_positives, schema), schema)
    place = F.row_number().over(W.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = near.withColumn("place", place).where(F.col("place") <= positives)
    windows = chosen.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives"))

    def find_negatives(shard, rows, sent, label):
        asked = [(k, i, [(p["place"], p["positive_id"], p["positive_score"]) for p in ps]) for k, i, ps in zip(rows.column("key").to_pylist(), rows.column("vec_id").to_pylist(), rows.column("positives").to_pylist(), strict=True)]
        return shard.negatives(asked, sent, label, negatives, low_percent, high_percent)

    schema = "key long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _dealt(index, anchors.join(windows, ["vec_id", "key"]), shards).mapInArrow(_search(books, group, kind, find_negatives, schema), schema)
    rank = F.row_number().over(W.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
