"""Toxicity scores by weak supervision.

1. Voters. Each task lets out the distinct words of its documents as 32-bit hashes (two words of one hash are one feature); they meet
   the labels by id, and the toxic and the clean training documents of each are counted, over all labelled training
   rows. The words with the largest likelihood ratios are the lexicons of either side; each lexicon word
   is a voter ("this word is there"), and so are a few patterns that need no label (shouting, insults
   addressed to "you", runs of exclamation marks). A voter votes for its side or abstains.
2. Label model. A generative model of the votes, y -> votes, is fitted by expectation maximisation:
   each voter's rate of voting in either class, that is, its accuracy and coverage; it starts at the counts of 1. Voters that vote together more
   often than the classes explain are correlated: the residual correlation of every pair is estimated, and a voter's
   log-odds are divided by the sum of its correlations, so a clique of copies counts as one voter.
3. Classifier. A logistic regression on the presence of words (the ``features`` most telling ones) and the patterns is
   trained on the posterior labels of the sample, and scores every text, from its first word to its last however long it is.

Counting covers all labelled training rows. The label model and the classifier are fitted on a bounded sample of
labelled training rows: the ``sample`` ids that come first by hash, chosen from the labels alone; the driver holds one bit per feature of them.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import checkpointed, released, rows_kept, salted, small_batches, words_of

PATTERNS = (
    re.compile(rb"!{3,}"),
    re.compile(rb"\b[A-Z]{4,}(?:\s+[A-Z]{4,}){2,}\b"),
    re.compile(rb"(?i)\byou(?:'re| are)?\s+(?:an?\s+|such\s+an?\s+)?\w+\s*!"),
)
EDGES = b".,;:!?\"'()[]{}|*_-"


class WordFeatures(dict):
    """Word to the 32-bit hash of the word without punctuation around it (None: nothing is left), for up to ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int | None:
        bare = word.strip(EDGES)
        value = self[word] = xxhash.xxh32_intdigest(bare) - (1 << 31) if bare else None
        return value

    def of(self, text: str | None) -> set[int]:
        if len(self) > self.limit:
            self.clear()
        found = set(map(self.__getitem__, set(words_of(text))))
        found.discard(None)
        return found


def patterns_in(text: str | None) -> list[bool]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    called = b"!" in raw  # without it the first and the last can't match
    return [called and bool(PATTERNS[0].search(raw)), bool(PATTERNS[1].search(raw)), called and bool(PATTERNS[2].search(raw))]


def _features(batches):
    known = WordFeatures()
    for batch in batches:
        found = [np.fromiter(known.of(t.as_py()), np.int32) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "words"])


def _word_counts(batches):
    """Counts of clean and toxic documents by word; the row without a word counts the documents."""
    words, toxic, documents, size = [], [], [0, 0], 0

    def out(word, n, bad):
        return pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(n - bad, pa.int64()), pa.array(bad, pa.int64())], names=["word", "clean", "toxic"])

    def counted():
        word, place = np.unique(np.concatenate(words), return_inverse=True)
        return out(word, np.bincount(place, minlength=len(word)), np.bincount(place, weights=np.concatenate(toxic), minlength=len(word)).astype(np.int64))

    for batch in batches:
        lists = batch.column("words")
        is_toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        words.append(lists.flatten().to_numpy(zero_copy_only=False))
        toxic.append(np.repeat(is_toxic, lists.value_lengths().to_numpy(zero_copy_only=False)))
        documents[0] += int((~is_toxic).sum())
        documents[1] += int(is_toxic.sum())
        size += len(words[-1])
        if size > 1_000_000:
            yield counted()
            words, toxic, size = [], [], 0
    if words:
        yield counted()
    yield out([None], np.array([sum(documents)]), np.array([documents[1]]))


def fit_label_model(votes: np.ndarray, rate: np.ndarray, prior: float, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of 0/1 ``votes``, and the voters' weights for their correlations.

    ``rate`` has each voter's first estimate of P(vote | class 0) and P(vote | class 1). A voter that abstains says nothing.
    """
    n, m = votes.shape
    weight = np.ones(m)
    posterior = np.full(n, prior)
    for step in range(steps):
        each = (votes @ ((np.log(rate[:, 1]) - np.log(rate[:, 0])) * weight).astype(votes.dtype)).astype(float)
        posterior = 1 / (1 + np.exp(-np.clip(each + np.log(prior / (1 - prior)), -30, 30)))
        mass = np.array([n - posterior.sum(), posterior.sum()])
        counts = (votes.T @ np.stack([1 - posterior, posterior], axis=1).astype(votes.dtype)).astype(float)
        rate = np.clip((counts + 0.5) / (mass[None, :] + 1), 1e-4, 1 - 1e-4)
        if step == steps // 2:
            products = np.zeros((m, m))
            for at in range(0, n, 2000):  # by blocks, so that the driver holds no second matrix of the sample's size
                share = posterior[at : at + 2000]
                residual = votes[at : at + 2000] - (np.outer(1 - share, rate[:, 0]) + np.outer(share, rate[:, 1]))
                products += residual.T @ residual
            scale = np.sqrt(np.diag(products)) + 1e-9
            correlation = np.abs(products / np.outer(scale, scale))
            np.fill_diagonal(correlation, 0)
            weight = 1 / (1 + np.where(correlation > 0.5, correlation, 0).sum(axis=1))
    return posterior, weight


def fit_classifier(x: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on soft labels."""
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    for step in range(1, steps + 1):
        off = 1 / (1 + np.exp(-np.clip((x @ w[:-1].astype(x.dtype)).astype(float) + w[-1], -30, 30))) - target
        gradient = np.append((x.T @ off.astype(x.dtype)).astype(float), off.sum()) / len(x) + ridge * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _scorer(model):
    words, weights, patterns, intercept = model
    features, weight_of = WordFeatures(), {w: float(weights[i]) for w, i in words.items()}
    known = weight_of.keys()

    def score(text: str | None) -> float:
        # fsum: the order in which words are met makes no difference
        total = math.fsum([intercept, *map(weight_of.__getitem__, known & features.of(text)), *(float(c) for c, s in zip(patterns, patterns_in(text), strict=True) if s)])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    return score


def _score(model):
    def run(batches):
        score = _scorer(model)
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def held_out(folds: int = 5):
    """crc32 of the id as text, modulo ``folds``, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def _sampled(documents: DataFrame, truth: DataFrame, words: dict[int, int], sample: int) -> np.ndarray:
    """One row per id of the sample that has a text: 1 for each pattern and, after them, each word that is there."""
    width = len(words) + len(PATTERNS)
    ids = truth.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def packed(batches):
        features = WordFeatures()
        for batch in batches:
            bits = np.zeros((batch.num_rows, width), np.uint8)
            for i, t in enumerate(batch.column("text")):
                bits[i, : len(PATTERNS)] = patterns_in(t.as_py())
                bits[i, [len(PATTERNS) + words[w] for w in words.keys() & features.of(t.as_py())]] = 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], names=["doc_id", "key", "bits"])

    texts = documents.join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("key"))
    # An id with several texts counts once, so the driver gets ``sample`` rows at most.
    rows = texts.mapInArrow(released(packed), "doc_id long, key long, bits binary").groupBy("doc_id").agg(F.min(F.struct("key", "bits")).alias("x")).select("doc_id", "x.bits").toArrow().sort_by("doc_id")
    flat = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -(-width // 8))
    return np.unpackbits(flat, axis=1, count=width).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, lexicon: int = 512, features: int = 1024, sample: int = 20_000, folds: int = 5, least_docs: int = 5):
    """(words, weights, pattern weights, intercept) of the classifier; reads labels of training rows only."""
    small_batches(docs.sparkSession)
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(folds)).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").where(~held_out(folds))
    # Labels grow with the documents: never broadcast, the plan is the same at every size.
    given = salted(documents.mapInArrow(released(_features), "doc_id long, words array<int>"), 4, F.hash("words")).join(salted(truth, 4).hint("merge"), ["doc_id", "salt"])
    counted = given.select("words", "toxic").mapInArrow(released(_word_counts), "word int, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = checkpointed(counted.where(F.col("word").isNull() | (F.col("clean") + F.col("toxic") >= least_docs)))
    totals = counts.where("word IS NULL").first()
    n = np.array([totals["clean"], totals["toxic"]] if totals else [0, 0], float)
    if not n.all():
        return {}, np.zeros(0), np.zeros(len(PATTERNS)), -30.0 if n[0] or not n[1] else 30.0
    told = counts.where("word IS NOT NULL").withColumn("odds", F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1)))
    both, share = F.col("clean") + F.col("toxic"), n / n.sum()
    ratio = sum(2 * F.col(c) * F.log((F.col(c) + 1e-9) / (both * float(s))) for c, s in (("clean", share[0]), ("toxic", share[1])))
    rows = told.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "word").limit(features).collect()
    # Voters come first, so that the votes are the first columns of the sample's table and not a copy of it.
    sides = [[r for r in rows if r["ratio"] > 10.83 and side * r["odds"] > 1][:lexicon] for side in (1, -1)]
    lexicons = [*sides[0], *sides[1]]
    voting = {r["word"] for r in lexicons}
    ordered = [*lexicons, *[r for r in rows if r["word"] not in voting]]
    words = {r["word"]: i for i, r in enumerate(ordered)}
    x = _sampled(documents, truth, words, sample)
    first = np.array([[0.02, 0.04]] * len(PATTERNS) + [[(r["clean"] + 0.5) / (n[0] + 1), (r["toxic"] + 0.5) / (n[1] + 1)] for r in lexicons])
    posterior, _ = fit_label_model(x[:, : len(first)], first, float(np.clip(n[1] / n.sum(), 0.01, 0.99)))
    w = fit_classifier(x, posterior)
    return words, w[len(PATTERNS) : -1], w[: len(PATTERNS)], float(w[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, lexicon: int = 512, features: int = 1024, sample: int = 20_000, folds: int = 5, least_docs: int = 5) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Labels (``labels(doc_id, toxic, ...)``) are read only for ids whose crc32 modulo ``folds`` is not 0, and only to
    choose and count words; null labels and ids are ignored, of repeated labels the largest counts. Without labels of both kinds
    every score is that of the only class (0 without any). A null or empty text is scored as a text without words, a very long one
    whole. Words that fewer than ``least_docs`` labelled training documents hold say nothing. Of words with equal likelihood ratios those of the smaller hash come first. Ids may be null or repeated (each row is
    scored by its own text); other columns are not read.
    """
    model = train(docs, labels, lexicon, features, sample, folds, least_docs)
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", held_out(folds).alias("held_out"))
    return documents.mapInArrow(released(_score(model)), "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame, lexicon: int = 512, features: int = 1024, sample: int = 20_000, folds: int = 5, least_docs: int = 5) -> DataFrame:
    """The rows of ``docs`` that toxicity_scores does not predict to be toxic, with all their columns; decided row by row, whatever the id."""
    model = train(docs, labels, lexicon, features, sample, folds, least_docs)

    def keep(parts):
        score = _scorer(model)
        for texts in parts:
            yield [score(t.as_py()) < 0.5 for t in texts]

    return rows_kept(docs, keep)
