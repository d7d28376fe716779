"""Packing of documents into training windows by the sum of squares.

A document becomes ids and an end id. What fills whole windows is cut off its front and leaves at once; the rest, shorter than
a window, is placed online: among all fill levels that have an open window with room (and the level 0, a new window), it goes where the sum of
the squared numbers of open windows by fill is the smallest afterwards. Few windows of one fill then wait for a size that never comes. A level array
holds the numbers, so a placement is one pass over at most as many levels as a window has ids, however many windows are open.

Each task packs the rows it reads; nothing is shuffled and no two tasks share a window. Windows that are still open when a task ends, and those of the most
frequent fill when more than ``most_open`` are open, are laid end to end and cut into full windows. The one rest of a task is cut into
windows whose sizes are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import released, small_batches

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the pattern of byte-level pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids are held as bytes, four to an id, little-endian and unsigned.
WIDTH = 4
#: Numbers of a task's sequences follow its partition's number.
SEQUENCE_BITS = 32


class Encoder:
    """Texts to ids, a slice at a time.

    The pre-tokens of the byte-level pattern never span a single space between two other characters: the space begins a
    pre-token of its own kind and word. So a long text may be cut before such a space, every slice encoded alone, and the ids joined.

    Slices go to a faster library that is given the file's vocabulary, if its ids are in the order of its merges (then rank and id are one), and
    if the slice has only characters that both libraries class alike and none of the file's special strings; all others go to the file's own library.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Latin blocks, whose classes are as old as Unicode itself.
    COMMON = re.compile("[\x00-\u024f]+")

    def __init__(self, path: str, slice_chars: int = 200_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.library, self.slice_chars = Tokenizer.from_file(path), slice_chars
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._fast(path)

    def _fast(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, before = held["model"], held["pre_tokenizer"] or {}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", ())]
        plain = held["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
            return None
        import tiktoken

        #: The byte that each character of the vocabulary stands for: printable Latin-1 characters are themselves, the others follow from U+0100.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(map(byte.__getitem__, piece)): i for piece, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("slices", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self.slice_chars and (cut := self.CUT.search(text, start + self.slice_chars)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _encode(self, part: str) -> bytes:
        if self.fast and len(part) <= 2 * self.slice_chars and self.COMMON.fullmatch(part) and not any(s in part for s in self.special):
            return np.array(self.fast.encode_ordinary(part), "<u4").tobytes()
        return np.array(self.library.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self._encode, self.slices(text))) if text else b""


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Levels:
    """Open windows by fill, and the choice of the fill at which an item is placed."""

    def __init__(self, size: int):
        self.size, self.n_open = size, 0
        self.windows: list[list] = [[] for _ in range(size)]
        #: What leaving a level saves and what reaching one costs, of the sum of squares. A level without a window can't be left.
        self.saved = np.full(size + 1, -(1 << 60), np.int64)
        self.cost = np.ones(size + 1, np.int64)
        self.saved[0] = self.cost[size] = 0

    def count(self, level: int) -> int:
        return len(self.windows[level])

    def choose(self, item: int) -> int:
        """The fill that ``item`` (shorter than a window) is put on; the fullest of equals."""
        change = self.cost[item:] - self.saved[: self.size - item + 1]
        return self.size - item - int(np.argmin(change[::-1]))

    def _counted(self, level: int) -> None:
        n = len(self.windows[level])
        self.saved[level] = 2 * n - 1 if n else -(1 << 60)
        self.cost[level] = 2 * n + 1

    def take(self, level: int) -> list:
        if not level:
            return []
        self.n_open -= 1
        window = self.windows[level].pop()
        self._counted(level)
        return window

    def put(self, level: int, window: list) -> None:
        self.n_open += 1
        self.windows[level].append(window)
        self._counted(level)


def _cut(pieces: list[tuple], sizes: Iterator[int]) -> Iterator[tuple[int, list[tuple]]]:
    """Pieces (doc_id, doc_tokens, start, ids) end to end, cut into windows of the given sizes; the last one may be short."""
    size = next(sizes)
    held, fill = [], 0
    for doc, tokens, start, ids in pieces:
        while ids:
            part = ids[: WIDTH * (size - fill)]
            held.append((doc, tokens, start, part))
            fill, start, ids = fill + len(part) // WIDTH, start + len(part) // WIDTH, ids[len(part) :]
            if fill == size:
                yield fill, held
                held, fill, size = [], 0, next(sizes)
    if held:
        yield fill, held


class Packer:
    """The windows of one task. ``add`` and ``close`` return the windows that are complete, as lists of pieces."""

    def __init__(self, size: int = 2048, most_open: int = 4096):
        if most_open <= size:
            raise ValueError("more windows than a window has ids must be allowed to be open")  # else each fill may have one only
        self.size, self.most_open, self.levels = size, most_open, Levels(size)

    def _full(self):
        while True:
            yield self.size

    def add(self, doc, ids: bytes) -> list[list[tuple]]:
        """The document's windows that are full already, and the one that its rest fills."""
        tokens, done = len(ids) // WIDTH, []
        whole = tokens // self.size * self.size
        for start in range(0, whole, self.size):
            done.append([(doc, tokens, start, ids[WIDTH * start : WIDTH * (start + self.size)])])
        rest = tokens - whole
        if rest:
            level = self.levels.choose(rest)
            window = self.levels.take(level)
            window.append((doc, tokens, whole, ids[WIDTH * whole :]))
            if level + rest == self.size:
                done.append(window)
            else:
                self.levels.put(level + rest, window)
                if self.levels.n_open > self.most_open:
                    done += self._join(max(range(1, self.size), key=self.levels.count))
        return done

    def _join(self, *levels: int) -> list[list[tuple]]:
        """The windows of these fills end to end, cut into full ones; the rest stays open."""
        pieces = [p for level in levels for _ in range(self.levels.count(level)) for p in self.levels.take(level)]
        done = []
        for fill, window in _cut(pieces, self._full()):
            if fill == self.size:
                done.append(window)
            else:
                self.levels.put(fill, window)
        return done

    def close(self) -> list[list[tuple]]:
        done = self._join(*range(self.size - 1, 0, -1))
        for fill in [f for f in range(1, self.size) if self.levels.count(f)]:  # one at most
            powers = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
            done += [window for _, window in _cut(self.levels.take(fill), iter([*powers, 1]))]
        return done


def _rows(windows: list[list[tuple]], first: int) -> pa.RecordBatch:
    rows = []
    for n, window in enumerate(windows):
        at = 0
        for doc, tokens, start, ids in window:
            rows.append((doc, start, len(ids) // WIDTH, ids, tokens, first + n, at))
            at += len(ids) // WIDTH
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def _pack(path: str, size: int, end_id: int, most_open: int, batch_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, Packer(size, most_open)
        number, done = TaskContext.get().partitionId() << SEQUENCE_BITS, []
        for batch in batches:
            texts = batch.column("text")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                done += packer.add(doc, encode(texts[i].as_py()) + end)
                if len(done) * size >= batch_tokens:
                    yield _rows(done, number)
                    number, done = number + len(done), []
        done += packer.close()
        if done:
            yield _rows(done, number)

    return released(run)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_pieces(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, size: int = 2048, end_id: int = 1, most_open: int = 4096, batch_tokens: int = 1_000_000) -> DataFrame:
    """One row per piece of a row of ``docs(doc_id, text, ...)``: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. ``start`` counts the document's ids before the piece, ``offset`` the
    ids of the sequence before it; a sequence has no gaps. A null or empty text is its end id alone. Ids may be null or repeated, equal rows are documents
    each, other columns are not read; an empty table has no pieces. Whole texts are encoded, however long, and cut where a window ends. Documents of up to
    ``size`` ids stay whole but where open windows are joined (see above). A sequence is full, or its length is a power of two.
    A task holds ``most_open`` open windows, one document and ``batch_tokens`` finished ids at most.
    """
    small_batches(docs.sparkSession)
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return documents.mapInArrow(_pack(tokenizer_path(tokenizer), size, end_id, most_open, batch_tokens), SCHEMA)


def sequences(pieces: DataFrame, pad_id: int = 0, size: int = 2048) -> DataFrame:
    """sequence_id, length, ids (array of long, padded to ``size`` unless the length is a power of two), doc_ids (of its pieces, in order)."""
    number = "cast(conv(concat(substr(h, 8 * i + 7, 2), substr(h, 8 * i + 5, 2), substr(h, 8 * i + 3, 2), substr(h, 8 * i + 1, 2)), 16, 10) as long)"
    numbers = F.expr(f"transform(sequence(0, cast(length as int) - 1), i -> {number})")
    own = pieces.withColumn("h", F.hex("ids")).select("sequence_id", F.struct("offset", "length", "doc_id", numbers.alias("ids")).alias("p"))
    rows = own.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))  # a sequence has ``size`` ids at most
    joined = rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids")).withColumn("length", F.size("ids").cast("long"))
    exact = F.expr("bit_count(length) = 1")
    padding = F.array_repeat(F.lit(pad_id).cast("long"), F.when(exact, 0).otherwise(F.lit(size) - F.col("length")).cast("int"))
    return joined.select("sequence_id", "length", F.concat("ids", padding).alias("ids"), "doc_ids")
