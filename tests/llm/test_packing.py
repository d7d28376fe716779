"""Packing against the tokenizer's own library: every id in one piece, no gaps, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.llm import packing

RNG = random.Random(3)


def library(text):
    return np.array(packing.encoder(packing.tokenizer_path()).library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def prose(n):
    return " ".join("".join(RNG.choice("abcdeé.\n") for _ in range(RNG.randint(1, 8))) for _ in range(n))


TEXTS = [*(prose(RNG.randint(1, 300)) for _ in range(60)), prose(9000), "x" * 5000, " " * 3000, "", None, None, "a <|endoftext|> b<|endoftext|>", "漢字 と 仮名", *["same text"] * 30, " lead and trail ", "a  b\n c \n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1, 2), (3, "a repeated id", "x", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, offset int, sequence_id int").repartition(3).cache()


@pytest.mark.parametrize("size", [64, 2048])
def test_every_id_is_in_one_piece(docs, size):
    pieces = packing.packed_pieces(docs, size=size, most_open=size + 1).collect()
    wanted = sorted(((r["doc_id"] is None, r["doc_id"] or 0), library(r["text"]).tobytes()) for r in docs.collect())
    held = defaultdict(list)
    for p in pieces:
        assert p["length"] * 4 == len(p["ids"]) and 0 < p["length"] <= size
        held[(p["doc_id"] is None, p["doc_id"] or 0, p["doc_tokens"])].append((p["start"], bytes(p["ids"])))
    got = []
    for (missing, doc, tokens), parts in held.items():
        text_ids = b"".join(ids for _, ids in sorted(parts))
        copies = len(text_ids) // 4 // tokens
        if copies == 1:
            at = 0
            for start, ids in sorted(parts):
                assert start == at
                at += len(ids) // 4
            got.append(((missing, doc), text_ids))
    assert sorted(got) == wanted
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    short = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and at & (at - 1) == 0  # full, or a power of two
        short += at < size
    assert short <= 3 * size.bit_length()


def test_encoder_equals_the_library_wherever_it_is_cut():
    characters = [chr(c) for c in range(0x250)] + [" "] * 150 + ["\n"] * 40 + list("'sltvemd") * 10 + ["<|endoftext|>", "中", " "]
    cut = packing.Encoder(packing.tokenizer_path(), slice_chars=20)
    for _ in range(300):
        text = "".join(RNG.choice(characters) for _ in range(RNG.randint(1, 200)))
        assert cut.encode(text) + b"\1\0\0\0" == library(text).tobytes()
    assert len(list(cut.slices(prose(500)))) > 20


def test_placement_is_the_sum_of_squares_choice():
    levels, size = packing.Levels(16), 16
    for step in range(400):
        item = RNG.randint(1, size - 1)
        counts = [levels.count(f) for f in range(size)]

        def squares(fill):
            after = counts[:]
            if fill:
                after[fill] -= 1
            if fill + item < size:
                after[fill + item] += 1
            return sum(n * n for n in after[1:])

        allowed = [f for f in range(size - item + 1) if f == 0 or counts[f]]
        best = min(allowed, key=lambda f: (squares(f), -f))
        assert levels.choose(item) == best, step
        window = levels.take(best)
        if best + item < size:
            levels.put(best + item, window)


def test_open_windows_stay_bounded():
    packer = packing.Packer(size=64, most_open=70)
    done = []
    for i in range(2000):  # no two of these fit into one window
        done += packer.add(i, b"\7\0\0\0" * 40)
        assert packer.levels.n_open <= 70
    done += packer.close()
    fills = [sum(len(p[3]) // 4 for p in w) for w in done]
    assert sum(fills) == 2000 * 40 and sum(f != 64 for f in fills) <= 6
    assert packer.levels.n_open == 0


def test_digest_and_sequences(docs, spark):
    pieces = packing.packed_pieces(docs.select("doc_id", "text"), size=128)
    digests = pieces.select("ids", F.crc32("ids").alias("c")).collect()
    assert all(r["c"] == zlib.crc32(r["ids"]) for r in digests)
    by_sequence = defaultdict(list)
    for p in pieces.collect():
        by_sequence[p["sequence_id"]].append((p["offset"], np.frombuffer(bytes(p["ids"]), "<u4").tolist()))
    for r in packing.sequences(pieces, pad_id=9, size=128).collect():
        want = [i for _, ids in sorted(by_sequence[r["sequence_id"]]) for i in ids]
        assert r["ids"][: r["length"]] == want and r["length"] == len(want)
        assert len(r["ids"]) == (r["length"] if r["length"].bit_count() == 1 else 128)


def test_empty_table(spark):
    assert packing.packed_pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []
