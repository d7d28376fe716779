"""Finds benchmark items inside documents: size-partitioned MinHash containment search.

An item with n distinct k-word shingles counts as contained when at least need = ceil(n * percent / 100) of them are
in the document. A document is far longer than an item, so their Jaccard similarity says little; the search goes by the containment
form of MinHash (Koslicki and Zabeti, 2019): of each of several hash functions an item keeps the shingle with the
smallest value, and what a document is asked is whether it holds that shingle. For one function the answer is yes with the
probability of the containment, however long the document is.

Items are partitioned by size, and each partition has its own number of functions m and threshold h (``sketch_plan``): an item is a
candidate in a document that holds the minima of h of its m functions. h is the largest for which a contained item is
lost with a probability of 1e-4 at most. Up to m shingles the sketch is the whole item and h is need: nothing is lost there.
Candidates are then verified by their shingles as words, not hashes.

The document side is never sketched; each of its shingles is looked up, through a bit table first. Items are the query set. They are
read in blocks of bounded size; a block's index is built once and sent to the tasks, and all documents are searched for it, so
the broadcast never grows with the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import WordHashes, mixed, released, rows_kept, shingle_hashes, small_batches, words_of

SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def _shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    width = min(k, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def sketch_plan(n: int, percent: int, functions: int = 32, lost: float = 1e-4) -> tuple[int, int]:
    """(m, h) for items of n shingles: hash functions, and how many of their minima a document must hold.

    Items of up to ``functions`` shingles have no functions (m = 0): the sketch is all shingles and h is the number needed. Larger ones
    belong to a partition that starts at a power of two; its m and h hold for all its sizes, as a contained item has each minimum with
    probability need / n >= percent / 100.
    """
    if n <= functions:
        return 0, -(-n * percent // 100)
    share, below, h = percent / 100, 0.0, 0
    while True:
        below += math.comb(functions, h) * share**h * (1 - share) ** (functions - h)
        if below > lost:
            return functions, max(1, h)
        h += 1


class ItemIndex:
    """The sketches of a block of items, by the hash of the shingle; items are numbered by place in ``items``."""

    TABLE_BITS = 20

    def __init__(self, items: list[tuple[int | None, str | None]], k: int, percent: int):
        hashes, keys, owners, votes = WordHashes(), [], [], []
        self.k, self.percent, self.items, self.needed, widths = k, percent, [], [], []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            shingles = np.unique(shingle_hashes(hashes.of(words), k))
            functions, hits = sketch_plan(len(shingles), percent)
            if functions:
                tags = mixed(np.arange(1, functions + 1, dtype=np.uint64))
                least = np.array([np.argmin(mixed(shingles ^ t)) for t in tags])
                own, vote = np.unique(least, return_counts=True)  # a shingle may be the minimum of several functions
                shingles = shingles[own]
            else:
                vote = np.ones(len(shingles), np.int64)
            keys.append(shingles)
            votes.append(vote)
            owners.append(np.full(len(shingles), len(self.items)))
            self.items.append((item_id, text))
            self.needed.append(hits)
            widths.append(min(k, len(words)))
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.hashes = key[order]
        self.owners = (np.concatenate(owners) if owners else np.empty(0, np.int64))[order]
        self.votes = (np.concatenate(votes) if votes else np.empty(0, np.int64))[order]
        self.needed = np.array(self.needed, np.int64)
        self.table = np.zeros(1 << self.TABLE_BITS, bool)
        self.table[self._slots(self.hashes)] = True
        #: Items of fewer than k words are shingles of their own width.
        self.widths = sorted(set(widths))
        self._verified: dict[int, tuple[set, int]] = {}

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.TABLE_BITS)).astype(np.int64)

    def candidates(self, words: list[bytes], hashed: np.ndarray) -> list[int]:
        """Numbers of the items of which the document holds enough minima."""
        met: list[np.ndarray] = []
        for width in self.widths:
            if len(words) >= width:
                seen = shingle_hashes(hashed, width)
                seen = np.unique(seen[self.table[self._slots(seen)]])
                lo, hi = np.searchsorted(self.hashes, seen, "left"), np.searchsorted(self.hashes, seen, "right")
                met += [np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)]
        if not met:
            return []
        at = np.concatenate(met)
        owners, place = np.unique(self.owners[at], return_inverse=True)
        held = np.bincount(place, weights=self.votes[at])
        return owners[held >= self.needed[owners]].tolist()

    def search(self, words: list[bytes], hashed: np.ndarray) -> Iterator[tuple[int | None, int, int]]:
        """(item_id, shingles of the item, how many of them are in the document) for each item contained."""
        in_document: dict[int, set] = {}
        for owner in self.candidates(words, hashed):
            if owner not in self._verified:
                own = words_of(self.items[owner][1])
                self._verified[owner] = _shingles(own, self.k), min(self.k, len(own))
            shingles, width = self._verified[owner]
            if width not in in_document:
                in_document[width] = _shingles(words, width)
            shared = len(shingles & in_document[width])
            if 100 * shared >= self.percent * len(shingles):
                yield self.items[owner][0], len(shingles), shared


def _search(index):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows = []
            for at in range(batch.num_rows):
                words = words_of(texts[at].as_py())
                if words:
                    rows += [(ids[at].as_py(), i, n, c, c / n) for i, n, c in index.value.search(words, hashes.of(words))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    return run


def _indexes(spark: SparkSession, items: DataFrame, k: int, percent: int, block_bytes: int):
    """The index of each block of items, as a broadcast variable; one without items if there are none."""
    block, size, any_sent = [], 0, False
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= block_bytes:
            yield spark.sparkContext.broadcast(ItemIndex(block, k, percent))
            block, size, any_sent = [], 0, True
    if block or not any_sent:
        yield spark.sparkContext.broadcast(ItemIndex(block, k, percent))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, block_bytes: int = 16_000_000) -> DataFrame:
    """One row per document row and item row (``items(item_id, text)``) where the document contains the item.

    Columns: doc_id, item_id, n_item_shingles, n_shared, containment (shared / item shingles, at least percent / 100).
    An item of fewer than k words is one shingle of that width; items and documents without words match
    nothing. Null ids are carried as they are. Repeated rows give repeated results. Documents are searched whole, however long; an
    item at exactly the threshold counts. Other columns are not read.
    ``block_bytes`` bounds the text of the items that are held, and sent to the tasks, at a time.
    """
    small_batches(docs.sparkSession)
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [documents.mapInArrow(released(_search(index)), SCHEMA) for index in _indexes(docs.sparkSession, items, k, percent, block_bytes)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; decided row by row in one pass, whatever the id."""

    def keeping(index):
        def keep(parts):
            hashes = WordHashes()
            for texts in parts:
                stays = []
                for text in texts:
                    words = words_of(text.as_py())
                    stays.append(not words or next(index.value.search(words, hashes.of(words)), None) is None)
                yield stays

        return keep

    for index in _indexes(docs.sparkSession, items, k, percent, block_bytes):
        docs = rows_kept(docs, keeping(index))
    return docs
