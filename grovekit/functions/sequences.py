"""Kernels on token sequences: distances, alignments, consensus. A sequence is a list of tokens; no kernel needs Spark."""

from __future__ import annotations

import random
from collections.abc import Hashable, Sequence

import numpy as np

Tokens = Sequence[Hashable]


def edit_distance(a: Tokens, b: Tokens) -> int:
    """Levenshtein distance of token sequences, a row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    codes = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[t] for t in b], np.int64)
    place = np.arange(len(b) + 1)
    row = place.copy()
    for i, t in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (y != codes[t]))
        row = np.minimum.accumulate(np.concatenate(([i], step)) - place) + place  # the running minimum is the insertions
    return int(row[-1])


class Texts:
    """Texts side by side, for their edit distances to one text after another: a machine word of each holds a column of its table (Myers, Hyyrö)."""

    def __init__(self, texts: list[str]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths, ordered = lengths[self.order], [texts[i] for i in self.order]
        self.letters = {c: i for i, c in enumerate(sorted(set().union(*texts)))}
        long_enough = [int((self.lengths > j).sum()) for j in range(int(lengths.max(initial=0)))]
        self.columns = [np.array([self.letters[t[j]] for t in ordered[:n]], np.int64) for j, n in enumerate(long_enough)]

    def distances(self, text: str) -> np.ndarray:
        """The distance of each of the texts to ``text``, of any length: words grow to Python's own where 64 bits don't hold it."""
        out = np.empty(len(self.lengths), np.int64)
        out[self.order] = self._ordered(text) if text else self.lengths
        return out

    def _ordered(self, text: str) -> np.ndarray:
        last = len(text) - 1
        word = next((w for bits, w in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if last < bits), object)
        marks = np.zeros(len(self.letters), word)
        for i, c in enumerate(text):
            if c in self.letters:
                marks[self.letters[c]] |= 1 << i
        score, down = np.full(len(self.lengths), len(text), np.int64), np.zeros(len(self.lengths), word)
        up = ~down
        for column in self.columns:
            n = len(column)
            u, d, same = up[:n], down[:n], marks[column]
            across = (((same & u) + u) ^ u) | same
            more, less = d | ~(across | u), u & across
            score[:n] += (more >> last & 1).astype(np.int64) - (less >> last & 1).astype(np.int64)
            more, held = more << 1 | 1, same | d
            up[:n], down[:n] = less << 1 | ~(held | more), more & held
        return score


class Prefixes:
    """The distinct prefixes of different texts in rising order, by length: each one's parent (the prefix a letter shorter) and last letter, and which texts end there."""

    def __init__(self, texts: list[str], letters: dict[str, int]):
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.full((len(texts), int(lengths.max(initial=0))), -1, np.int64)
        for i, t in enumerate(texts):
            codes[i, : len(t)] = [letters.setdefault(c, len(letters)) for c in t]
        same = np.cumprod(codes[1:] == codes[:-1], axis=1).sum(axis=1) if len(texts) > 1 else np.empty(0, np.int64)
        shared = np.concatenate(([-1], np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))))  # letters in common with the text before
        node = np.zeros(len(texts), np.int64)
        empty = np.flatnonzero(lengths == 0)
        self.levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), empty, np.zeros(len(empty), np.int64))]
        for depth in range(1, codes.shape[1] + 1):
            here = np.flatnonzero(lengths >= depth)
            new = shared[here] < depth
            parent, letter = node[here[new]], codes[here[new], depth - 1]
            node[here] = np.cumsum(new) - 1
            done = here[lengths[here] == depth]
            self.levels.append((parent, letter, done, node[done]))

    def __len__(self) -> int:
        return sum(len(parent) for parent, *_ in self.levels)


def distance_sums(left: list[str], left_weights: np.ndarray, right: list[str], right_weights: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """What the edit distances of each left text to the right ones weigh, and of each right text to the left ones; each side holds different texts in rising order.

    A cell of the usual table is a pair of prefixes, so texts that share prefixes share cells: all prefixes of one length of both sides are one step. Where few are shared, texts are
    compared by machine words instead.
    """
    letters: dict[str, int] = {}
    a, b = Prefixes(left, letters), Prefixes(right, letters)
    own, other = np.zeros(len(left)), np.zeros(len(right))
    if len(a) * len(b) > 24 * len(left) * len(right):
        texts = Texts(right)
        for i, (text, weight) in enumerate(zip(left, left_weights, strict=True)):
            distances = texts.distances(text)
            own[i] = distances @ right_weights
            other += weight * distances
        return own, other
    kind = np.uint8 if max(len(a.levels), len(b.levels)) < 255 else np.int64
    code = np.uint8 if len(letters) < 256 else np.int64
    before: list[np.ndarray] = []
    for i, (up, letter, ends, at) in enumerate(a.levels):
        now: list[np.ndarray] = []
        for j, (left_of, other_letter, ends_b, at_b) in enumerate(b.levels):
            if not i or not j:
                table = np.full((len(up), len(left_of)), max(i, j), kind)
            else:
                table = np.take(now[j - 1], left_of, axis=1)
                np.minimum(table, before[j][up], out=table)
                table += kind(1)
                both = np.take(before[j - 1], left_of, axis=1)[up]
                both += letter.astype(code)[:, None] != other_letter.astype(code)[None, :]
                np.minimum(table, both, out=table)
            now.append(table)
            for start in range(0, len(ends) if len(ends_b) else 0, rows):
                some = slice(start, start + rows)
                found = table[at[some]]
                found = (found if len(at_b) == table.shape[1] else np.take(found, at_b, axis=1)).astype(float)
                own[ends[some]] += found @ right_weights[ends_b]
                other[ends_b] += left_weights[ends[some]] @ found
        before = now
    return own, other


def normalized_edit_distance(a: Tokens, b: Tokens) -> float:
    return edit_distance(a, b) / max(len(a), len(b), 1)


def lcs_length(a: Tokens, b: Tokens) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int64)
    for t in a:
        same = np.concatenate(([0], np.where([t == x for x in b], row[:-1] + 1, 0))) if len(b) else row
        row = np.maximum.accumulate(np.maximum(row, same))
    return int(row[-1])


def _table(a: Tokens, b: Tokens, match: int, mismatch: int, gap: int) -> np.ndarray:
    score = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    score[:, 0], score[0] = gap * np.arange(len(a) + 1), gap * np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i, j] = max(score[i - 1, j - 1] + (match if x == y else mismatch), score[i - 1, j] + gap, score[i, j - 1] + gap)
    return score


def alignment(a: Tokens, b: Tokens, match: int = 2, mismatch: int = -1, gap: int = -1) -> list[tuple[int | None, int | None]]:
    """The global alignment as pairs of places (None: a gap). Ties: both, then a place of ``a`` alone, then one of ``b``."""
    score, i, j, out = _table(a, b, match, mismatch, gap), len(a), len(b), []
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and score[i, j] == score[i - 1, j] + gap:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def agreement(a: Tokens, b: Tokens) -> list:
    """What two sequences agree on: the tokens that an edit alignment keeps."""
    return [a[i] for i, j in alignment(a, b, 0, -1, -1) if i is not None and j is not None and a[i] == b[j]]


def denoise(sequences: list[Tokens], rounds: int = 1, seed: int = 0) -> list[list]:
    """``rounds`` times: pair the sequences at random and replace each pair by its agreement; an odd one stays. Round r is drawn from seed + r."""
    now = [list(s) for s in sequences]
    for r in range(rounds):
        if len(now) < 2:
            break
        order = list(range(len(now)))
        random.Random(seed + r).shuffle(order)
        pairs = [agreement(now[i], now[j]) for i, j in zip(order[::2], order[1::2], strict=False)]
        now = [p for p in [*pairs, *([now[order[-1]]] if len(order) % 2 else [])] if p] or now
    return now


def replicated(weights: Sequence[float], target: int = 96) -> list[int]:
    """Copies of each sequence by largest remainders, one at least (so more than ``target`` if there are more sequences); equal remainders go by place."""
    total = sum(weights) or 1.0
    raw = [target * w / total for w in weights]
    copies = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: (copies[i] - raw[i], i))[: max(0, target - sum(copies))]:
        copies[i] += 1
    return [max(1, c) for c in copies]


def medoid(sequences: list[Tokens], weights: Sequence[float], length_penalty: float = 0.0) -> tuple[int, float]:
    """(place, objective) of the sequence with the least weighted distance to all, plus a penalty for a length off the median; the first of equals."""
    middle = float(np.median([len(s) for s in sequences]))
    costs = [sum(w * edit_distance(s, t) for t, w in zip(sequences, weights, strict=True)) + length_penalty * abs(len(s) - middle) for s in sequences]
    best = int(np.argmin(costs))
    return best, float(costs[best])


def progressive_consensus(sequences: list[Tokens], weights: Sequence[float], seed: str = "medoid", order: str = "closest_first", threshold: float = 1.0) -> list:
    """Aligns each sequence to the columns made so far, votes, and keeps the columns in which a token outweighs the gaps.

    ``seed``: medoid, highest_weight or longest; ``order``: closest_first, heaviest_first or input.
    """
    if not sequences:
        return []
    n = range(len(sequences))
    first = {"medoid": lambda: medoid(sequences, weights)[0], "highest_weight": lambda: max(n, key=lambda i: weights[i]), "longest": lambda: max(n, key=lambda i: len(sequences[i]))}[seed]()
    ranks = {"closest_first": lambda i: (edit_distance(sequences[first], sequences[i]), -weights[i], i), "heaviest_first": lambda i: (-weights[i], i), "input": lambda i: i}[order]
    columns: list[dict] = [{t: weights[first]} for t in sequences[first]]
    gaps, seen = [0.0] * len(columns), weights[first]

    def heaviest(column: dict):
        return max(column, key=lambda t: (column[t], str(t)))

    for i in sorted((i for i in n if i != first), key=ranks):
        w, merged, merged_gaps = weights[i], [], []
        for c, j in alignment([heaviest(c) for c in columns], sequences[i]):
            column, gap = ({}, seen) if c is None else (columns[c], gaps[c])
            if j is None:
                gap += w
            else:
                column[sequences[i][j]] = column.get(sequences[i][j], 0.0) + w
            merged.append(column)
            merged_gaps.append(gap)
        columns, gaps, seen = merged, merged_gaps, seen + w
    return [heaviest(c) for c, g in zip(columns, gaps, strict=True) if c[heaviest(c)] >= threshold * g]
