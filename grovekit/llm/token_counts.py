"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens (see pieces.py). The pre-tokens of a batch that are not known yet are held as one flat
array of symbols, one row after another. In each step every row that still has a mergeable pair applies its pair of
the lowest rank, all rows at once; rows without such a pair leave the array. If no pair with the new symbol has a rank as low
(the rank is calm), the row applies all occurrences of the rank at once, from the left where they overlap, which is what one after the other
would give. Otherwise it applies them up to the first whose new symbol makes a pair of a rank as low with a neighbour, as that pair may merge before the next copy
does. So a row takes a few steps for each rank that it meets, however long it is. What survives is counted; a character outside the vocabulary counts its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import small_batches
from grovekit.llm.pieces import DEFAULT_MODEL, Vocabulary, model_path, vocabulary

NONE = np.int64(1 << 40)


class PairTable:
    """(left symbol, right symbol) to (rank, merged symbol), for all pairs whose concatenation is a piece."""

    def __init__(self, v: Vocabulary):
        symbols: dict[str, int] = {}
        for piece in v.ids:
            symbols.setdefault(piece, len(symbols))
        for piece in v.ids:
            for c in piece:
                symbols.setdefault(c, len(symbols))
        self.symbols, self.vocabulary, self.size = symbols, v, np.int64(len(symbols) + 1)
        self.unknown = len(symbols)
        rows = []
        for piece, rank in v.rank.items():
            for j in range(1, len(piece)):
                left, right = symbols.get(piece[:j]), symbols.get(piece[j:])
                if left is not None and right is not None:
                    rows.append((left * int(self.size) + right, rank, symbols[piece]))
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.int64)
        self.ranks = np.array([r[1] for r in rows] + [NONE], np.int64)
        self.merged = np.array([r[2] for r in rows] + [0], np.int64)
        #: Of each rank: do all pairs with one of its symbols have a higher rank?
        soonest = np.full(len(symbols), NONE)
        for side in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(soonest, side, self.ranks[:-1])
        self.calm = np.ones(int(self.ranks[:-1].max(initial=0)) + 1, bool)
        np.logical_and.at(self.calm, self.ranks[:-1], soonest[self.merged[:-1]] > self.ranks[:-1])
        #: Open addressing: a key's first slot, and the few that follow it.
        bits = max(4, int(np.ceil(np.log2(len(rows) + 1))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int64)
        waiting, step = np.arange(len(rows)), np.int64(0)
        while len(waiting):
            at = (self._home(self.keys[waiting]) + step) & self.mask
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]
            waiting = waiting[self.slots[at] != waiting]
            step += 1
        self.probes = int(step)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, the last row (rank NONE) if it isn't one."""
        keys = left * self.size + right
        out = np.full(len(keys), len(self.keys), np.int64)
        rest, at = np.arange(len(keys)), self._home(keys)
        for _ in range(self.probes):
            got = self.slots[at]
            some = got >= 0
            hit = some & (self.keys[got] == keys[rest])
            out[rest[hit]] = got[hit]
            go = some & ~hit
            if not go.any():
                break
            rest, at = rest[go], (at[go] + 1) & self.mask
        return out

    def counts(self, words: list[str], symbols: int = 400_000) -> list[int]:
        """Surviving symbols of each pre-token; some ``symbols`` of them are merged at a time, a pre-token is never cut."""
        out: list[int] = []
        held: list[str] = []
        size = 0
        for i, w in enumerate(words, 1):
            held.append(w)
            size += len(w)
            if size >= symbols or i == len(words):
                out += self._merge(held)
                held, size = [], 0
        return out

    def _merge(self, words: list[str]) -> list[int]:
        get, unknown = self.symbols.get, self.unknown
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = "".join(words)
        sym = np.fromiter((get(c, unknown) for c in text), np.int64, len(text))
        row = np.repeat(np.arange(len(words)), lengths)
        total = lengths.copy()
        for i in np.flatnonzero(sym == unknown):
            total[row[i]] += len(text[i].encode("utf-8", "surrogatepass")) - 1
        pair = np.full(len(sym), len(self.keys), np.int64)
        inner = np.flatnonzero(row[1:] == row[:-1])
        pair[inner] = self.find(sym[inner], sym[inner + 1])
        while len(sym):
            rank = self.ranks[pair]
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            widths = np.diff(np.append(first, len(row)))
            best = np.minimum.reduceat(rank, first)
            live = best < NONE
            if not live.any():
                break
            at = np.flatnonzero((rank == np.repeat(best, widths)) & (rank < NONE))
            number = np.arange(len(at))
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))  # a row's last symbol has no pair, so a run stays in its row
            alternate = (number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0
            at = at[alternate]
            stir = np.flatnonzero(~self.calm[rank[at]])
            if len(stir):
                before = np.cumsum(hot := self._stirs(sym, row, pair, rank, at, stir)) - hot  # occurrences on its left after which others come first
                opens = np.concatenate(([True], row[at[1:]] != row[at[:-1]]))
                at = at[before == np.maximum.accumulate(np.where(opens, before, 0))]
            sym[at] = self.merged[pair[at]]
            total -= np.bincount(row[at], minlength=len(total))
            keep = np.repeat(live, widths)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, row, pair = sym[keep], row[keep], pair[keep]
            at = moved[at]
            for left in (at, (at - 1)[at > 0]):
                pair[left] = len(self.keys)
                left = left[left + 1 < len(row)]
                left = left[row[left] == row[left + 1]]
                pair[left] = self.find(sym[left], sym[left + 1])
        return total.tolist()


    def _stirs(self, sym: np.ndarray, row: np.ndarray, pair: np.ndarray, rank: np.ndarray, at: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Of the merges ``at`` (those numbered ``some``; the others do not): would the new symbol make a pair of a rank as low with a neighbour, merged in this step or not?"""
        out = np.zeros(len(at), np.int64)
        here = at[some]
        new, low, end = self.merged[pair[here]], rank[here], len(sym) - 1
        left, right = np.maximum(here - 1, 0), np.minimum(here + 2, end)
        has_left, has_right = (here > 0) & (row[left] == row[here]), (here + 2 <= end) & (row[right] == row[here])
        beside = np.concatenate(([-9], at[:-1]))[some] == here - 2  # the pair on its left merges too
        joined = self.merged[pair[np.maximum(here - 2, 0)]]
        for fits, a, b in ((has_left, sym[left], new), (has_left & beside, joined, new), (has_right, new, sym[right])):
            out[some] |= fits & (self.ranks[self.find(a, b)] <= low)
        return out


_TABLES: dict[str, PairTable] = {}


def pair_table(path: str) -> PairTable:
    if path not in _TABLES:
        _TABLES[path] = PairTable(vocabulary(path))
    return _TABLES[path]


def _count(path: str, limit: int, known_limit: int, slice_chars: int):
    def run(batches):
        table = pair_table(path)
        words_of, known = table.vocabulary.words, {}
        for batch in batches:
            texts = batch.column("text")
            counts, sizes = [], []
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at < batch.num_rows and size < slice_chars:
                    part.append(texts[at].as_py() or "")
                    size += len(part[-1])
                    at += 1
                cut = [words_of(t) for t in part]
                new = list(dict.fromkeys(w for ws in cut for w in ws if w not in known))
                if len(known) + len(new) > known_limit:
                    known.clear()
                    new = list(dict.fromkeys(w for ws in cut for w in ws))
                known.update(zip(new, table.counts(new), strict=True))
                counts += [sum(map(known.__getitem__, ws)) for ws in cut]
                sizes += [len(t.encode("utf-8", "surrogatepass")) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, limit: int = 4096, known_limit: int = 300_000, slice_chars: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Ids may be null or repeated; other columns are not read.
    ``known_limit`` pre-tokens are remembered in a task; ``slice_chars`` characters of text are worked on at a time.
    """
    small_batches(docs.sparkSession)
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return documents.mapInArrow(_count(model_path(model), limit, known_limit, slice_chars), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
