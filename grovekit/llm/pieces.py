"""The vocabulary of a merge-type SentencePiece model, and what both encoders share.

The text a model sees is the text with each space written as U+2581 and one U+2581 before it. Two
neighbouring pieces may merge if their concatenation is a piece, the highest score first and then the leftmost. So
no merge spans two characters that are never neighbours inside a piece: the text may be cut there, and
every part encoded alone. Before a run of U+2581 that follows another character such a cut is usual; whether it is safe
is read from the vocabulary, not assumed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        if library.normalize("A ﬁ  ") != f"{SPACE}A{SPACE}ﬁ{SPACE}{SPACE}":
            raise ValueError("only models without normalisation, with a space before the text, are supported")
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.surface: dict[int, bytes] = {}
        scores = {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.ids[piece] = i
                self.surface[i] = piece.replace(SPACE, " ").encode()
                scores[piece] = library.get_score(i)
        #: Merge order: 0 is the best; equal scores share a rank and go by place.
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        self.joined = {(p[j], p[j + 1]) for p in self.ids for j in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.joined):
            raise ValueError("a piece goes on after a word's end")

    _WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def words(self, text: str | None) -> list[str]:
        """The text as the model sees it, cut where no merge can span: spaces and the word after them."""
        if not text:
            return []
        seen = SPACE + text.replace(" ", SPACE)
        return self._WORDS.findall(seen)

    def cut(self, word: str) -> list[str]:
        """A word cut at every pair of neighbours that no piece holds."""
        joined, parts, start = self.joined, [], 0
        for j in range(1, len(word)):
            if (word[j - 1], word[j]) not in joined:
                parts.append(word[start:j])
                start = j
        parts.append(word[start:])
        return parts

    def spell(self, character: str) -> list[int]:
        """The ids of a character that is no piece: its bytes in UTF-8."""
        return [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
