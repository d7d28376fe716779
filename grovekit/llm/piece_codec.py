"""SentencePiece encoding by backtracking, and decoding.

The encoding of a text is the one sequence of pieces in which every two neighbours are compatible, that is, encode as
themselves when joined (pieces that don't encode as themselves are left out). So it is searched for:
at each place the longest piece that an Aho-Corasick automaton of all pieces finds there, if it is
compatible with the piece before it; else the next shorter one; if none is left, the place is marked
as failed in a bitfield and the search goes back one piece. A place is never tried twice from the front, so the
search is linear in the text but for the length of a piece. Compatibility is checked by re-merging the
two pieces; of a piece and a longest one behind it, the longest compatible one is remembered. A character outside the vocabulary ends a stretch and is spelled in bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import released, small_batches
from grovekit.llm.pieces import DEFAULT_MODEL, SPACE, Vocabulary, model_path, vocabulary

NEVER = float("inf")
PAIRS = 1 << 18
#: Bytes of texts that are encoded at once, or one longer text.
TEXT_BYTES = 1 << 20


def joined(offsets, values: pa.Array, numbers, between: str | bytes) -> pa.Array:
    """The values of these numbers joined from offset to offset."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(numbers))), between)


class Codec:
    """Pieces are numbers: their places in ``texts``; a character outside the vocabulary is ``len(texts)`` plus its code point."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.texts = [p for p in v.ids if self.merge(list(p)) == [p]]
        self.ids = [v.ids[p] for p in self.texts]
        self.written = pa.array(map(str, self.ids), pa.string())
        self.decoded = pa.array([v.surface[i] for i in self.ids], pa.binary())
        self.sizes = [len(p) for p in self.texts]
        number = {p: k for k, p in enumerate(self.texts)}
        automaton = ahocorasick.Automaton()
        for p, k in number.items():
            automaton.add_word(p, k)
        automaton.make_automaton()
        #: How far the automaton follows a text from a place; and by the text that far, the longest piece on the way (-1: none).
        self.ahead, self.reach = automaton.longest_prefix, max(self.sizes)
        self.furthest = {"": -1}
        for way in sorted({p[:j] for p in self.texts for j in range(1, len(p) + 1)}, key=len):
            self.furthest[way] = number.get(way, self.furthest[way[:-1]])
        self.shorter = [self.furthest[p[:-1]] for p in self.texts]
        self.histories: dict[str, list[tuple[float, str, str]]] = {}
        #: By the left piece and one found behind it, the longest of its beginnings that is compatible (-1: none).
        self.following: dict[int, int] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """What the merges make of a sequence of characters; it is as long as two pieces at most."""
        rank = self.v.rank
        while len(parts) > 1:
            at, best = -1, None
            for j in range(len(parts) - 1):
                r = rank.get(parts[j] + parts[j + 1])
                if r is not None and (best is None or r < best):
                    at, best = j, r
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def history(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges that make a piece, in order: before each its rank, and the first and the last symbol at that time; at the end no rank."""
        found = self.histories.get(piece)
        if found is None:
            rank, parts, found = self.v.rank, list(piece), []
            while True:
                ranks = [rank.get(a + b, NEVER) for a, b in pairwise(parts)]
                best = min(ranks, default=NEVER)
                found.append((best, parts[0], parts[-1]))
                if best == NEVER:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.histories[piece] = found
        return found

    def compatible(self, left: str, right: str) -> bool:
        """No merge crosses the border of the two: re-merged side by side, they are the two again.

        Until a merge crosses it, each side merges as it does alone. So its history is followed, the lower rank first (the left one of equals), and at each
        moment the last symbol of the one and the first of the other must not merge before.
        """
        if (left[-1], right[0]) not in self.v.joined:
            return True
        rank, a, b, i, j = self.v.rank, self.history(left), self.history(right), 0, 0
        last, first = a[0][2], b[0][1]
        cross = rank.get(last + first, NEVER)
        while True:
            here, there = a[i][0], b[j][0]
            if here <= cross and here <= there:
                if here == NEVER:
                    return True
                i += 1
                if a[i][2] is not last:
                    last = a[i][2]
                    cross = rank.get(last + first, NEVER)
            elif cross <= there:
                return False
            else:
                j += 1
                if b[j][1] is not first:
                    first = b[j][1]
                    cross = rank.get(last + first, NEVER)

    def follow(self, left: int, longest: int) -> int:
        """Remembered, up to ``PAIRS`` answers; the left piece may be none (-1) or outside the vocabulary, with which nothing merges."""
        n = len(self.texts)
        if not 0 <= left < n or longest < 0:
            return longest
        right = self.following.get(left * n + longest)
        if right is None:
            if len(self.following) >= PAIRS:
                self.following.clear()
            right = longest
            while right >= 0 and not self.compatible(self.texts[left], self.texts[right]):
                right = self.shorter[right]
            self.following[left * n + longest] = right
        return right

    def pieces(self, word: str) -> list[int]:
        """The pieces of a word."""
        n, at, before, failed, out = len(word), 0, -1, None, []
        reach, ahead, furthest, following, sizes, others = self.reach, self.ahead, self.furthest, self.following, self.sizes, len(self.texts)
        while True:
            way = word[at : at + reach]
            piece = furthest[way[: ahead(way)]]
            if piece < 0:
                piece = others + ord(word[at])
            elif 0 <= before < others:
                found = following.get(before * others + piece)
                piece = self.follow(before, piece) if found is None else found
            if failed is not None or piece < 0:
                failed = failed or bytearray(n // 8 + 1)
                while True:
                    while piece >= 0:
                        end = at + (sizes[piece] if piece < others else 1)
                        if not failed[end >> 3] >> (end & 7) & 1:
                            break
                        piece = self.follow(before, self.shorter[piece]) if piece < others else -1
                    if piece >= 0:
                        break
                    failed[at >> 3] |= 1 << (at & 7)
                    if not out:
                        raise ValueError(f"no encoding of {word!r}")
                    last, before = out.pop(), out[-1] if out else -1
                    if last < others:
                        at, piece = at - sizes[last], self.follow(before, self.shorter[last])
                    else:
                        at -= 1
            out.append(piece)
            at += sizes[piece] if piece < others else 1
            if at == n:
                return out
            before = piece

    def packed(self, words: list[str]) -> list[bytes]:
        """The pieces of each word, four bytes a piece."""
        flat: list[int] = []
        ends = [0]
        for word in words:
            flat += self.pieces(word)
            ends.append(4 * len(flat))
        held = np.array(flat, np.int32).tobytes()
        return [held[a:b] for a, b in pairwise(ends)]

    def joined(self, rows: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """Of each row of packed pieces its ids as decimal text, and the bytes that they decode to."""
        n, written, decoded = len(self.texts), self.written, self.decoded
        numbers, offsets = np.frombuffer(b"".join(rows), np.int32), np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) >> 2 for r in rows], out=offsets[1:])
        outside = numbers >= n
        if outside.any():
            points, places = np.unique(numbers[outside], return_inverse=True)
            numbers = numbers.copy()
            numbers[outside] = n + places
            spelled = [self.v.spell(chr(c - n)) for c in points.tolist()]
            written = pa.concat_arrays([written, pa.array([",".join(map(str, i)) for i in spelled], pa.string())])
            decoded = pa.concat_arrays([decoded, pa.array(map(self.decode_bytes, spelled), pa.binary())])
        return joined(offsets, written, numbers, ","), joined(offsets, decoded, numbers, b"")

    def encode_word(self, word: str) -> list[int]:
        n, out = len(self.texts), []
        for k in self.pieces(word):
            out += [self.ids[k]] if k < n else self.v.spell(chr(k - n))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.v.words(text) for i in self.encode_word(w)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.surface.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for U+2581 without the one before the text, bytes that are no UTF-8 replaced."""
        out = self.decode_bytes(ids)
        return out.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(vocabulary(path))
    return _CODECS[path]


class Remembered:
    """Texts to (number of ids, ids as decimal text, decoded bytes); words that were seen before are looked up, each once for some texts.

    Of a word with its space are remembered its pieces, which are written and decoded once for some texts. A line's first word is one without a
    space, behind the line's break, which no piece holds (if one does, lines aren't told apart). Marks after a word are encoded apart where no
    piece holds the two characters at the border, as then no merge spans it. About ``limit`` words are remembered: when half of them are new
    ones, the older half goes, but for those that are met again.
    """

    MARKS = "!#$%&()*+,-./:;<=>?@[]^{|}~\"'"

    def __init__(self, c: Codec, limit: int):
        self.codec, self.limit = c, limit
        self.by_line = "\n" not in c.v.ids and not any("\n" in pair for pair in c.v.joined)
        #: What follows a space, or with its line break begins a line; and whole words of other texts, and marks.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.whole.get(word)
        if found is None:
            if len(self.whole) > self.limit:
                self.whole.clear()
            [found] = self.codec.packed([word])
            self.whole[word] = found
        return found

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Of distinct parts of texts between spaces."""
        if 2 * len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older, holds, words, marks, new = self.known, self.older, self.codec.v.joined, [], [], {}
        for part in parts:
            word, mark = part.rstrip(self.MARKS), ""
            if len(word) < len(part):
                if word and (word[-1], part[len(word)]) not in holds:
                    mark = part[len(word) :]
                else:
                    word = part
            words.append(word)
            marks.append(mark)
            if word not in known:
                found = older.get(word)
                if found is not None:
                    known[word] = found
                else:
                    new[word] = word if self.by_line and word[0] == "\n" else SPACE + word
        known.update(zip(new, self.codec.packed(list(new.values())), strict=True))
        return [known[w] + self._word(m) if m else known[w] for w, m in zip(words, marks, strict=True)]

    def _one(self, text: str | None) -> tuple[int, str, bytes]:
        if not text:
            return 0, "", b""
        words = list(map(self._word, self.codec.v.words(text)))
        ids, held = zip(*((i, d) for at in range(0, len(words), TEXT_BYTES) for i, d in zip(*(x.to_pylist() for x in self.codec.joined(words[at : at + TEXT_BYTES])), strict=True)), strict=True)
        joined_ids = ",".join(ids)
        return joined_ids.count(",") + 1, joined_ids, b"".join(held).removeprefix(b" ")

    def __call__(self, texts: list[str | None]) -> list[tuple[int, str, bytes]]:
        out: list[tuple[int, str, bytes] | None] = [None] * len(texts)
        places, plain = [], []
        for at, text in enumerate(texts):
            # Spaces that are no single ones between words, breaks that follow none, and what may be too long for one Arrow array.
            if not text or len(text) > TEXT_BYTES or text[0] in " \n" or text[-1] == " " or "  " in text or SPACE in text or (self.by_line and " \n" in text):
                out[at] = self._one(text)
            else:
                places.append(at)
                plain.append(text.replace("\n", " \n") if self.by_line else text)
        split = pc.split_pattern(pa.array(plain, pa.string()), " ")
        parts = split.flatten().dictionary_encode()
        ids, held = self.codec.joined(self._parts(parts.dictionary.to_pylist()))
        ids, held = joined(split.offsets, ids, parts.indices, ","), joined(split.offsets, held, parts.indices, b"")
        for at, i, d in zip(places, ids.to_pylist(), held.to_pylist(), strict=True):
            out[at] = i.count(",") + 1, i, d.removeprefix(b" ")
        return out


def _coded_rows(path: str, known_limit: int, batches) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, str, bytes]]]]:
    one = Remembered(codec(path), known_limit)
    for batch in batches:
        start, sizes = 0, np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TEXT_BYTES, side="right")))
            part = batch.slice(start, end - start)
            yield part, one(part.column("text").to_pylist())
            start = end


def _digests(path: str, known_limit: int):
    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch, rows in _coded_rows(path, known_limit, batches):
            counts, ids, decoded = pa.array([n for n, _, _ in rows], pa.int64()), [sha(i.encode()) for _, i, _ in rows], [sha(d.decode("utf-8", "replace").encode()) for _, _, d in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, known_limit: int):
    def run(batches):
        for batch, rows in _coded_rows(path, known_limit, batches):
            ids = [list(map(int, i.split(","))) if i else [] for _, i, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode("utf-8", "replace") for _, _, d in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _documents(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL, known_limit: int = 300_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, ids, decoded (the text that the ids decode to).

    A null or empty text has no ids and decodes to the empty text. Ids of documents may be null or repeated; other columns are not
    read. ``known_limit`` words are remembered in a task.
    """
    return _documents(docs).mapInArrow(released(_ids(model_path(model), known_limit)), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str = DEFAULT_MODEL, known_limit: int = 300_000) -> DataFrame:
    """As encode_documents, with digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _documents(docs).mapInArrow(released(_digests(model_path(model), known_limit)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
