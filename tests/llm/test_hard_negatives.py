"""Hard negatives against brute force, and the bounds that filter them."""

import math
import random

import numpy as np
import pytest

from grovekit.llm import hard_negatives as H

RNG = random.Random(9)


def vector(n, spread=1.0):
    return [RNG.gauss(0, 0.2) * spread for _ in range(n)]


CENTRES = [vector(6) for _ in range(4)]
ROWS = [(i, RNG.randrange(3), [c + x for c, x in zip(RNG.choice(CENTRES), vector(6, 0.3), strict=True)]) for i in range(160)]
ROWS += [(200, 1, None), (201, None, vector(6)), (None, 1, vector(6)), (202, 1, [0.5, None, 0.1, 0.1, 0.1, 0.1]), (203, 1, [math.nan] * 6), (204, 2, [math.inf] * 6)]
ROWS += [(210, 1, []), (220, 2, [0.7, 0.1]), (230, 0, [0.0] * 6), (240, 9, vector(6)), (20, 2, ROWS[20][2]), (20, 1, vector(6)), *[(250 + i, i % 2, CENTRES[0]) for i in range(12)]]
ROWS += [ROWS[40], ROWS[41]]


def brute(rows, every, positives, negatives, low, high, scale=256):
    def sound(r):
        return None not in r and all(x is not None and math.isfinite(x) for x in r[2])

    held = [(i, c, [math.floor(scale * x) for x in v]) for i, c, v in filter(sound, rows)]
    out = []
    for a, label, v in {(i, c, tuple(v)) for i, c, v in held if i % every == 0}:
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, c) for i, c, w in held if i != a]
        for p, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted((s, i) for s, i, c in scored if c != label and low * -p <= 100 * -s <= high * -p)
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("every", "group", "centres", "sample", "window", "shard_bytes"), [(10, 2, 256, 8192, (50, 95), 1 << 25), (5, 4, 3, 20, (20, 100), 2000), (20, 6, 1, 0, (90, 99), 1 << 25)])
def test_equals_brute_force(spark, every, group, centres, sample, window, shard_bytes):
    table = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "vec_id long, label int, embedding array<float>, key string, shard int").repartition(3)
    seen = [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]  # components as floats
    got = H.hard_negatives(table, every, 5, 3, *window, group=group, centres=centres, sample=sample, shard_bytes=shard_bytes).collect()
    assert sorted(map(tuple, got)) == brute(seen, every, 5, 3, *window)
    assert got


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 60, (3000, 8)))
    books = [H.fitted_centres(x[:, g * 2 : g * 2 + 2], 64) for g in range(4)]
    codes = np.stack([H.nearest(x[:, g * 2 : g * 2 + 2], books[g]) for g in range(4)], axis=1).astype(np.uint8)
    left = np.stack([np.sqrt(((x[:, g * 2 : g * 2 + 2] - books[g][codes[:, g]]) ** 2).sum(axis=1)) for g in range(4)], axis=1)
    shard = H.Shard.__new__(H.Shard)
    shard.books, shard.group, shard.codes, shard.vectors, shard.ids = books, 2, codes, x.astype("<i2"), np.arange(3000)
    shard.norms = np.nextafter(left.astype(np.float32), np.float32(np.inf)).astype(np.float64)
    anchors = x[:40]
    score, off = shard.intervals(anchors, 0, 3000)
    true = anchors @ x.T
    assert (np.abs(score - true) <= off).all() and (score == np.round(score)).all()
    exact = []
    plain = shard.exact
    shard.exact = lambda at, a: exact.append(len(at)) or plain(at, a)
    for a in range(40):
        got = shard.best(score[a], off[a], np.arange(3000), anchors[a], -np.inf, np.inf, 5)
        assert got == sorted(((i, int(s)) for i, s in enumerate(true[a])), key=lambda r: (-r[1], r[0]))[:5]
    assert sum(exact) < 40 * 3000 / 5  # most rows are never scored


def test_edges(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert H.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError):
        H.hard_negatives(spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0])], schema))
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], schema)  # no positive, so no window
    assert H.hard_negatives(alone).collect() == []
