"""Importance resampling against a plain count of all n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from grovekit.llm import importance

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdeé9") for _ in range(RNG.randint(1, 6))) for _ in range(60)]


def prose(n):
    return "".join(RNG.choice(WORDS).title() + RNG.choice([" ", ", ", "_", "\n", "-"]) for _ in range(n))


TEXTS = [*(prose(RNG.randint(0, 80)) for _ in range(70)), prose(4000), "z" * 300 + " a " + "y" * 70 + " b " + "x" * 65, "a b", "!!", "", None, None, *["same words again " * 8] * 25, "漢字 仮名 漢字 仮名"]
TARGET = [prose(40), prose(30), None, "", "a b a b a b", "same words again"]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def expected(rows, target, share=5, least=20, buckets=10_000):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(bucket(f, buckets) for f in features(text)[1])
    for text in target:
        t.update(bucket(f, buckets) for f in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        words, found = features(text)
        weight = sum(gain[bucket(f, buckets)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(order[: share * len(order) // 100], 1):
        row[4] = rank
    return out


ROWS = [*enumerate(TEXTS), (None, "no id " * 20), (None, "no id " * 20), (3, "a repeated id " * 9)]
KEY = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in ROWS], "doc_id long, text string, n int, at int, bucket string").repartition(3).cache()
    return docs, spark.createDataFrame([(t,) for t in TARGET], "text string")


@pytest.mark.parametrize(("share", "slice_chars", "buckets"), [(5, 500_000, 10_000), (40, 50, 10_000), (40, 700, 7)])
def test_equals_a_plain_count(tables, share, slice_chars, buckets):
    got = importance.importance_sample(*tables, share_percent=share, slice_chars=slice_chars, buckets=buckets).collect()
    assert sorted(map(list, got), key=KEY) == sorted(expected(ROWS, TARGET, share, buckets=buckets), key=KEY)
    assert sum(r["rank"] is not None for r in got) > 0


def test_suffix_array_and_lcp():
    part = importance.Slice(["a b a b c", "b a b", "", "a b a"], 3)
    order, lcp = part.suffixes()
    ahead = [tuple((part.ids[p + k] + 1) if part.left[p] > k else 0 for k in range(3)) for p in range(len(part.ids))]
    assert [ahead[p] for p in order] == sorted(ahead)
    for i in range(1, len(order)):
        a, b = ahead[order[i - 1]], ahead[order[i]]
        assert lcp[i] == next((k for k in range(3) if a[k] != b[k] or a[k] == 0), 3)
    wide = importance.Slice(["a b a b c", "b a b"], 40)  # keys of 40 words don't fit one number
    order, lcp = wide.suffixes()
    assert [wide.ids[p] for p in order] == sorted(wide.ids) and lcp.max() == 2 + 1


def test_joined_crc():
    for _ in range(200):
        a, b = RNG.randbytes(RNG.randint(0, 90)), RNG.randbytes(RNG.randint(0, importance.TABLED + 1))
        got = importance.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)


def test_edges(spark, tables):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    docs, target = tables
    assert importance.importance_sample(nothing, target).collect() == []
    got = importance.importance_sample(docs, nothing.select("text")).collect()
    assert sorted(map(list, got), key=KEY) == sorted(expected(ROWS, [], 5), key=KEY)
    distinct = docs.where("doc_id > 3")
    drawn = importance.resampled(distinct, target, share_percent=30)
    assert drawn.columns == docs.columns and 0 < drawn.count() < distinct.count()
