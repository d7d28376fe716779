"""Scores documents by a gated recurrent language model and by add-one unigrams.

1. Words of all training documents are counted: each task counts its own, the sums are a table.
2. The most frequent words are the listed tokens of the network (gated_network.py); every other word is known by a class for its
   ending, in which its share is its count plus one. A class keeps one count for words never seen.
3. The network starts at the counts' shares and is trained on every training document once (``train_one_in`` = n > 1: on one in n
   of them, by hash of the id). They are dealt over ``rounds``; in a round, learners work on parts of its share, each from the same
   weights, and their weights are averaged by the tokens read (summed per slice of the weights, not on the driver).
4. All documents are dealt into blocks. A block's distinct words, but for the frequent ones, are joined with the table of counts, and meet the
   block's documents in one task (a block is about ``block_chars`` of text); so no task holds the whole vocabulary, and none of it is broadcast. Each document runs through
   the network from its first word to its end.

What is sent to all tasks: the listed words, the counts of the most frequent ones (``FREQUENT`` at most), the classes' totals and the weights, all of fixed size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import checkpointed, partitions, shuffles_freed, split_words
from grovekit.llm.gated_network import F32, Shape, Trainer, start, text_scores

WEIGHT_SLICE = 4096
#: Words whose counts all tasks get, so that blocks don't ask for them.
FREQUENT = 1 << 17


def ending_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-3:]) % tails


_CRC = np.array([~zlib.crc32(bytes([b]), 0xFFFFFFFF) & 0xFFFFFFFF for b in range(256)], np.uint32)


def ending_classes(words: pa.Array, tails: int) -> np.ndarray:
    """The classes of many words, none of them empty: a CRC a byte at a time, over all words."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.int64)
    bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data, ends = np.frombuffer(words.buffers()[2], np.uint8), bounds[1:]
    at, crc = np.maximum(bounds[:-1], ends - 3), np.full(len(words), 0xFFFFFFFF, np.uint32)
    for _ in range(3):
        moved = (crc >> np.uint32(8)) ^ _CRC[(crc ^ data[np.minimum(at, ends - 1)]) & np.uint32(255)]
        crc = np.where(at < ends, moved, crc)
        at = at + 1
    return (~crc % np.uint32(tails)).astype(np.int64)


def held_out():
    """crc32 of the id as text, modulo 7, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _count(tails: int):
    def run(batches):
        tables: list[pa.Table] = []

        def out():
            words, n = tables[0].columns if len(tables) == 1 else pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).columns
            words = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], pa.large_binary())
            return pa.Table.from_arrays([words.cast(pa.binary()), n, pa.array(ending_classes(words, tails), pa.int32())], names=["word", "n", "tail"]).to_batches()

        for batch in batches:
            for part in slices(batch.column("text")):
                counted = split_words(part)[1].value_counts()
                tables.append(pa.table([counted.field(0), counted.field(1)], names=["word", "n"]))
                if sum(t.num_rows for t in tables) > 600_000:
                    yield from out()
                    tables.clear()
        if tables:
            yield from out()

    return run


#: Bytes of texts whose words are told apart at once, or one longer text.
SLICE_BYTES = 8 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """The texts by some ``most`` bytes at a time."""
    ends, start = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield texts.slice(start, end - start)
        start = end


def _distinct(sent):
    """The words of each block that are not among the frequent ones."""

    def run(batches):
        now, seen, frequent = None, [], sent.value[-1].column("word").combine_chunks()

        def out():
            words = pc.unique(pa.concat_arrays(seen))
            words = words.filter(pc.invert(pc.is_in(words, frequent))).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), now), pa.int32()), words], names=["block", "word"])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in pairwise(edges):
                if high == low:
                    continue
                if blocks[low] != now and seen:
                    yield out()
                    seen = []
                now = int(blocks[low])
                seen += [pc.unique(split_words(part)[1]) for part in slices(batch.column("text").slice(low, high - low))]
        if seen:
            yield out()

    return run


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out


class _Numbers(dict):
    """The numbers of words: the listed ones' places, all others' ending classes, of which up to ``most`` words are kept."""

    def __init__(self, listed: list[bytes], shape: Shape, most: int = 400_000):
        super().__init__(zip(listed, range(1, len(listed) + 1), strict=True))
        self.shape, self.most = shape, most

    def __missing__(self, word: bytes) -> int:
        number = self.shape.short + ending_class(word, self.shape.tails)
        if len(self) < self.most:
            self[word] = number
        return number


def _learn(weights, shape: Shape, tokens: int, rate: float):
    def run(batches):
        p, listed = weights.value
        number = _Numbers(listed, shape).__getitem__
        trainer, texts, size, read = Trainer(p, shape, rate), [], 0, 0
        for batch in batches:
            for part in slices(batch.column("text")):
                edges, words = split_words(part)
                told = words.dictionary_encode()
                numbers = np.fromiter(map(number, told.dictionary.to_pylist()), np.int64, len(told.dictionary))[told.indices.to_numpy()]
                for low, high in pairwise(edges.tolist()):
                    texts.append(np.append(numbers[low:high], 0))
                    size += len(texts[-1])
                    if size >= tokens:
                        read += trainer.run(texts)
                        texts, size = [], 0
        read += trainer.run(texts) if texts else 0
        if read:
            flat = _flat(trainer.p).astype(np.float64) * read
            parts = [flat[at : at + WEIGHT_SLICE] for at in range(0, len(flat), WEIGHT_SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([read] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], names=["slice", "tokens", "total"])

    return run


def _sum_slices(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums one slice over the rows of its group, batch by batch."""
    total, tokens = None, 0
    for batch in batches:
        for n, values in zip(batch.column("tokens").to_pylist(), batch.column("total"), strict=True):
            values = np.asarray(values.values)
            total = values.copy() if total is None else total + values
            tokens += n
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["slice", "tokens", "total"])


def train(documents: DataFrame, p: dict, listed: list[bytes], shape: Shape, train_one_in: int, rounds: int, learner_chars: int) -> dict:
    """The weights after ``rounds`` rounds over the training share; without such documents, ``p``."""
    spark, shape_of_sums = documents.sparkSession, "slice int, tokens long, total array<double>"
    turn = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id"), F.length("text")), F.lit(train_one_in * rounds))
    sizes = dict(documents.where(~F.col("held_out")).groupBy(turn.alias("turn")).agg(F.sum(F.length("text"))).where(F.col("turn") < rounds).collect())
    for r in range(rounds):
        part = documents.where(~F.col("held_out") & (turn == r)).select("doc_id", "text")
        chars = sizes.get(r) or 0
        learners = max(1, -(-chars // learner_chars))
        weights = spark.sparkContext.broadcast((p, listed))
        learnt = part.repartition(learners, F.xxhash64("doc_id", "text")).select("text").mapInArrow(_learn(weights, shape, 300_000, 0.1 / 2**r), "slice int, tokens long, total array<double>")
        # Two steps: groups of learners first, so no task gets a slice of all of them.
        turns = max(1, math.isqrt(learners))
        some = learnt.withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(turns))).groupBy("slice", "turn").applyInArrow(_sum_slices, shape_of_sums)
        sums = some.groupBy("slice").applyInArrow(_sum_slices, shape_of_sums).orderBy("slice").collect()
        if sums:
            p = _unflat(np.concatenate([np.array(m["total"]) / m["tokens"] for m in sums]), p)
    return p


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _score(sent, shape: Shape, chunk_tokens: int):
    def run(key: tuple[pa.Scalar, ...], documents: pa.Table, dictionary: pa.Table) -> pa.Table:
        """Scores a block's documents; ``dictionary`` has the block's words that have a count, but for the frequent ones, which are sent."""
        p, tail_logs, n_end, total, distinct, frequent = sent.value
        log_all = np.log10(total + distinct + 1)
        both = [frequent, dictionary.select(frequent.column_names).cast(frequent.schema)]
        known = pa.concat_arrays([c for t in both for c in t.column("word").chunks])
        numbers, counts = (np.concatenate([*(t.column(name).to_numpy() for t in both), [0]]) for name in ("number", "n"))
        n_tokens, n_known, base, score = [], [], [], []
        for part in (p for chunk in documents.column("text").chunks for p in slices(chunk, 8 * chunk_tokens)):
            edges, words = split_words(part)
            told = words.dictionary_encode()
            at = pc.fill_null(pc.index_in(told.dictionary, known), -1).to_numpy()
            # Of each distinct word, and at last of the end: its number, its count, and what it adds to a text's sums.
            number, count = np.append(numbers[at], 0), np.append(counts[at], n_end)
            number[:-1][at < 0] = shape.short + ending_classes(told.dictionary.filter(pa.array(at < 0)), shape.tails)
            fixed = np.where(number >= shape.short, np.log(count + 1.0) - tail_logs[np.maximum(number - shape.short, 0)], 0)
            # The words of the texts with an end behind each.
            lengths = np.diff(edges) + 1
            tokens = np.full(len(words) + len(part), len(number) - 1)
            starts = np.cumsum(lengths) - lengths
            tokens[np.arange(len(words)) + np.repeat(np.arange(len(part)), lengths - 1)] = told.indices.to_numpy()
            summed = lambda of: np.add.reduceat(of[tokens], starts)
            n_tokens.append(lengths)
            n_known.append(summed((count > 0).astype(np.int64)))
            base.append(summed(np.log10(count + 1.0)) - lengths * log_all)
            got = text_scores(p, shape, np.split(number[tokens], starts[1:]))
            score.append((got + summed(fixed)) / np.log(10))
        n_tokens, n_known, base, score = (np.concatenate(x) if x else [] for x in (n_tokens, n_known, base, score))
        train = pa.array([total] * len(n_tokens), pa.int64())
        columns = [documents.column("doc_id"), documents.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), train, pa.array(base, pa.float64()), pa.array(score, pa.float64())]
        return pa.table(columns, names=RESULT)

    return run


def _learnt(documents: DataFrame, shape: Shape, train_one_in: int, rounds: int, learner_chars: int) -> tuple:
    """The weights, the table of counts and what is known of all training documents; ``tail_n`` and ``tail_v`` are the tail classes' tokens and words without the listed ones."""
    counted = documents.where(~F.col("held_out")).select("text").mapInArrow(_count(shape.tails), "word binary, n long, tail int").groupBy("word").agg(F.sum("n").alias("n"), F.first("tail").alias("tail"))
    table = checkpointed(counted)
    sizes = documents.agg(F.sum(F.length("text")).alias("chars"), F.sum((~F.col("held_out")).cast("long")).alias("ends")).first()
    chars, n_end = sizes["chars"] or 0, sizes["ends"] or 0
    listed = [(bytes(r["word"]), r["n"], r["tail"]) for r in table.orderBy(F.desc("n"), "word").limit(shape.short - 1).collect()]
    tail_n, tail_v = np.zeros(shape.tails), np.zeros(shape.tails)
    for r in table.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tail_n[r["tail"]], tail_v[r["tail"]] = r["n"], r["v"]
    total, distinct = int(tail_n.sum()) + n_end, int(tail_v.sum()) + (n_end > 0)
    for _, n, tail in listed:
        tail_n[tail] -= n
        tail_v[tail] -= 1
    words = [w for w, _, _ in listed]
    p = start(shape, np.array([n_end, *(n for _, n, _ in listed)], float), tail_n)
    p = train(documents, p, words, shape, train_one_in, rounds, learner_chars)
    return p, table, chars, n_end, total, distinct, listed, tail_n, tail_v


def _frequent(table: DataFrame, listed: list[tuple[bytes, int, int]], shape: Shape) -> pa.Table:
    """Words with their numbers and counts that all tasks get: the listed ones, then all that occur so often that there are ``FREQUENT`` of them at most."""
    least, seen = None, 0
    for n, words in sorted(table.groupBy("n").count().collect(), reverse=True):
        seen += words
        if seen > FREQUENT:
            break
        least = n
    first, own = {w for w, _, _ in listed}, [(w, n, k) for k, (w, n, _) in enumerate(listed, 1)]
    if least is not None:
        own += [(bytes(r["word"]), r["n"], shape.short + r["tail"]) for r in table.where(F.col("n") >= least).collect() if bytes(r["word"]) not in first]
    words, counts, numbers = zip(*own, strict=True) if own else ((), (), ())
    return pa.table([pa.array(words, pa.large_binary()), pa.array(counts, pa.int64()), pa.array(numbers, pa.int64())], names=["word", "n", "number"])


def lm_scores(docs: DataFrame, shape: Shape | None = None, train_one_in: int = 1, rounds: int = 2, learner_chars: int = 3_000_000, block_chars: int = 8_000_000, chunk_tokens: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) modulo 7 is not 2 (a null id is the empty text). A text is its words, A-Z
    lower-cased, and then one end; a null or empty text is the end alone. base_score is the add-one unigram log10
    probability, score the model's. Very long texts are read whole; words with equal counts are listed in order of their bytes. Without training documents nothing is known, and the model is uniform over its classes.
    Rows equal in id and text are documents each. Other columns are not read.
    """
    spark, shape = docs.sparkSession, shape or Shape()
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out())
    with shuffles_freed(spark):
        p, table, chars, n_end, total, distinct, listed, tail_n, tail_v = _learnt(documents, shape, train_one_in, rounds, learner_chars)
        frequent = _frequent(table, listed, shape)

    blocks = max(partitions(spark), -(-chars // block_chars))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = documents.withColumn("block", block).repartition(blocks, "block")
    # Both uses of ``dealt`` take all its columns, so that the documents are dealt out once.
    sent = spark.sparkContext.broadcast((p, np.log(tail_n + tail_v + 1), n_end, total, distinct, frequent))
    distinct_words = dealt.sortWithinPartitions("block").mapInArrow(_distinct(sent), "block int, word binary")
    numbered = table.select("word", "n", (F.lit(shape.short) + F.col("tail")).alias("number"))
    known = distinct_words.join(numbered, "word").select("block", "word", "number", "n")
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score(sent, shape, chunk_tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
