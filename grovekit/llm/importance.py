"""Importance resampling towards a target distribution, by hashed n-grams that word-id suffix arrays find.

A task reads its documents in slices. The words of a slice are numbered, and the places of the slice are sorted by the ids of the words that
follow, up to the longest n-gram and not across a document's end: a suffix array cut off at that depth. Neighbours in it have a longest common
prefix (LCP); a run of places in which it never falls below n is one n-gram with all its occurrences. An n-gram is hashed once a run, from the CRCs of
its words, which combine without looking at the bytes again, and the bucket goes back to all places of the run.

One pass counts buckets, pre-summed by task, over all documents and all texts of the target. That gives each bucket's gain, a table of as many numbers as there
are buckets. A second pass sums the gains of a document's n-grams. Draws are exact: documents with noise of their own (Gumbel's) are sorted by ranges
and numbered from the top.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import checkpointed, partitions, released, small_batches

#: Words are digits, Latin letters (A-Z lower-cased) and everything beyond ASCII: all other bytes become spaces.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Longer words are hashed by zlib with the words before them, as their shifts are in no table.
TABLED = 64


@lru_cache(maxsize=1)
def shifts() -> np.ndarray:
    """[k, i, b]: what byte i of a CRC, if it is b, becomes when k zero bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    out = np.empty((TABLED + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * 8)
    for k in range(1, TABLED + 2):
        out[k] = table[out[k - 1] & 0xFF] ^ (out[k - 1] >> 8)
    return out


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of A followed by B from those of A and B, and B's length (at most TABLED + 1 bytes)."""
    moved = shifts()
    out = right.copy()
    for i in range(4):
        out ^= moved[length, i, (left >> np.uint32(8 * i)) & np.uint32(0xFF)]
    return out


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


class Numbers(dict):
    """Words to numbers, in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Slice:
    """The words of some documents: ids in order, and where each document's words begin."""

    def __init__(self, texts: list[str | None], depth: int):
        known, ids, sizes = Numbers(), [], []
        for text in texts:
            words = words_of(text)
            ids += map(known.__getitem__, words)
            sizes.append(len(words))
        self.depth, self.sizes = depth, np.array(sizes, np.int64)
        self.words = list(known)
        self.ids = np.array(ids, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        ends = np.cumsum(self.sizes)
        #: Words of the document from each place on, its own included.
        self.left = np.repeat(ends, self.sizes) - np.arange(len(self.ids))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array, cut off at ``depth`` words, and the LCP of each entry with the one before (-1 for the first)."""
        n = len(self.ids)
        ahead = np.zeros((self.depth, n), np.int64)  # ids from 1; 0 is a document's end
        for k in range(self.depth):
            inside = self.left > k
            ahead[k, inside] = self.ids[np.flatnonzero(inside) + k] + 1
        width = len(self.words) + 1
        order = places = np.arange(n)
        key, free = np.zeros(n, np.int64), 1
        for row in ahead[::-1]:  # from the last word on; keys are joined as long as they fit
            if free * width >= 1 << 62:
                order = order[np.argsort(key, kind="stable")]
                key, free = np.zeros(n, np.int64), 1
            key += row[order] * free
            free *= width
        order = order[np.argsort(key, kind="stable" if order is not places else None)]
        lcp = np.zeros(n, np.int64)
        alike = np.ones(max(n - 1, 0), bool)
        for row in ahead:
            sorted_row = row[order]
            alike &= (sorted_row[1:] == sorted_row[:-1]) & (sorted_row[1:] > 0)
            lcp[1:] += alike
        lcp[:1] = -1
        return order, lcp

    def buckets(self, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n of 1 to ``depth``: the places where an n-gram begins, and its bucket."""
        order, lcp = self.suffixes()
        crc = np.array([zlib.crc32(w) for w in self.words], np.uint32)
        spaced = np.array([zlib.crc32(b" " + w) for w in self.words], np.uint32)
        length = np.array([len(w) + 1 for w in self.words], np.int64)
        for n in range(1, self.depth + 1):
            whole = self.left[order] >= n
            places = order[whole]
            run = np.cumsum((lcp < n)[whole]) - 1  # a place that is too near its document's end shares fewer than n words with its neighbours
            first = places[np.flatnonzero((lcp < n)[whole])]
            value = crc[self.ids[first]] if len(first) else np.empty(0, np.uint32)
            long = np.zeros(len(first), bool)
            for k in range(1, n):
                word = self.ids[first + k]
                long |= length[word] > TABLED + 1
                value = joined_crc(value, spaced[word], np.minimum(length[word], TABLED + 1))
            for i in np.flatnonzero(long):
                value[i] = zlib.crc32(b" ".join(self.words[w] for w in self.ids[first[i] : first[i] + n]))
            yield places, (value % np.uint32(buckets)).astype(np.int64)[run]


def _slices(batches: Iterator[pa.RecordBatch], slice_chars: int, depth: int) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """Rows in slices of some characters; a document is never cut."""
    for batch in batches:
        texts, start, size = batch.column("text"), 0, 0
        held: list = []
        for i in range(batch.num_rows):
            held.append(texts[i].as_py())
            size += len(held[-1] or "")
            if size >= slice_chars or i + 1 == batch.num_rows:
                yield batch.slice(start, len(held)), Slice(held, depth)
                start, size, held = i + 1, 0, []


def _counting(buckets: int, depth: int, slice_chars: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, part in _slices(batches, slice_chars, depth):
            for _, bucket in part.buckets(buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return released(run)


def _weighing(gains: np.ndarray, depth: int, slice_chars: int):
    def run(batches):
        for rows, part in _slices(batches, slice_chars, depth):
            weight = np.zeros(rows.num_rows)  # whole numbers, far below 2^53
            for places, bucket in part.buckets(len(gains)):
                weight += np.bincount(part.doc[places], weights=gains[bucket], minlength=rows.num_rows)
            features = sum(np.maximum(part.sizes - n, 0) for n in range(depth))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in (part.sizes, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return released(run)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("text").cast("string").alias("text"))


def bucket_counts(rows: DataFrame, buckets: int = 10_000, depth: int = 3, slice_chars: int = 500_000) -> DataFrame:
    """bucket, n: the n-grams of 1 to ``depth`` words of all texts of ``rows(text)``, by hash bucket; buckets without one are left out."""
    small_batches(rows.sparkSession)
    found = _texts(rows).mapInArrow(_counting(buckets, depth, slice_chars), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of all B buckets, from the counts s (of S) and t (of T)."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    none = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = both.unionByName(none).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    b = F.lit(float(buckets))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + b)) / ((F.col("s") + 1) * (F.col("all_t") + b))
    return each.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = 42) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256('<seed>:<doc_id>'); a null id is an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, eligible: Column, share_percent: int) -> DataFrame:
    """``scored(doc_id, score, weight, n_features, ...)`` with ``rank`` (from 1) of the highest ``share_percent`` of 100 of the eligible rows, else null.

    Rows are sorted by ranges, eligible ones first, and numbered within a range; a range goes on where the ranges before it end. Only the
    ranges' sizes (one row each) meet in one place.
    """
    spark = scored.sparkSession
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    sorted_rows = scored.withColumn("eligible", eligible).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = checkpointed(sorted_rows.withColumn("at", F.monotonically_increasing_id()))  # the partition's number, then the place in it
    partition, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"], r["e"]) for r in placed.groupBy(partition.alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("eligible").cast("long")).alias("e")).collect())
    drawn = share_percent * sum(e for _, _, e in sizes) // 100
    before, ahead = 0, []
    for p, n, _ in sizes:
        ahead.append((p, before))
        before += n
    starts = spark.createDataFrame(ahead or [(0, 0)], "p long, ahead long")
    number = F.col("ahead") + place + 1
    rank = F.when(F.col("eligible") & (number <= drawn), number)
    return placed.withColumn("p", partition).join(F.broadcast(starts), "p").withColumn("rank", rank).drop("p", "ahead", "at", "eligible")


def importance_sample(docs: DataFrame, target: DataFrame, share_percent: int = 5, least_words: int = 20, buckets: int = 10_000, depth: int = 3, seed: int = 42, slice_chars: int = 500_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_features, weight, score, rank, n_words, towards the texts of ``target(text, ...)``.

    A null or empty text, or one without words, has no features and weight 0. Of the N rows with at least ``least_words`` words,
    floor(share_percent * N / 100) are drawn: the highest scores, ties to the smaller doc_id (null last), and among rows that agree in both
    to the one with fewer features, then the smaller weight; the rank is null for all others. Repeated rows are documents each. An empty target or an
    empty table gives gains from the other side alone. Other columns are not read. Whole texts count, however long: a slice ends with a document.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, depth, slice_chars), bucket_counts(target, buckets, depth, slice_chars), buckets)
    held = np.zeros(buckets, np.int64)
    for r in gains.collect():  # as many as buckets
        held[r["bucket"]] = r["gain"]
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = documents.mapInArrow(_weighing(held, depth, slice_chars), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    done = ranked(scored, F.col("n_words") >= least_words, share_percent)
    return done.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resampled(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ids have to be distinct and not null for that."""
    drawn = importance_sample(docs, target, **parameters).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn"))
    return docs.join(drawn, F.col("doc_id") == F.col("__drawn"), "left_semi")
