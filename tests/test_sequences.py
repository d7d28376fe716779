"""Sequence kernels, likelihoods and exemplars against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from grovekit.functions import likelihood as L
from grovekit.functions import sequences as S
from grovekit.operators import collections as C
from grovekit.operators import exemplars as E


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_and_subsequences():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(0, 8))] for _ in "xy")
        assert S.edit_distance(a, b) == distance(a, b)
        longest = max(len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if all(any(t == x for x in it) for it in [iter(b)] for t in c))
        assert S.lcs_length(a, b) == longest
    assert S.normalized_edit_distance("", "") == 0 and S.normalized_edit_distance("ab", "") == 1


def test_consensus_and_denoising():
    noisy = [list(s) for s in ("abcdef", "abdef", "abcdef", "xabcdef", "abcdxef")]
    assert S.progressive_consensus(noisy, [1.0] * 5) == list("abcdef")
    assert S.progressive_consensus([], []) == []
    assert S.agreement("abcd", "axcd") == list("acd")
    assert all(set(s) <= set("abcdefx") for s in S.denoise(noisy, 2, seed=3)) and S.denoise([list("ab")], 3) == [["a", "b"]]
    assert S.replicated([3, 1, 1], 10) == [6, 2, 2] and S.replicated([1.0] * 300) == [1] * 300
    assert S.medoid([list("ab"), list("abc"), list("abcd")], [1, 1, 1]) == (1, 2.0)


def test_likelihood_sums_over_all_alignments():
    model = L.Indel(L.Background({"a": 0.6, "b": 0.4}), 0.2, 0.15, 0.1)
    # Summed over all observations the model's probability is one: what is longer than 9 tokens is rare.
    total = sum(math.exp(model.loglik("ab", s)) for n in range(9) for s in itertools.product("ab", repeat=n))
    assert total == pytest.approx(1, abs=2e-3)
    value, steps = model.best_alignment("ab", "ab")
    assert [x[0] for x in steps] == ["M", "M"] and value <= model.loglik("ab", "ab")
    assert L.Indel(model.background, 1e-9, 0.0, 0.0).loglik("ab", "ba") < -20
    assert L.Background.fit(["ab", "b"]).of("b") == pytest.approx(2.5 / 4)


def test_alignments_of_many_sequences_at_once():
    from grovekit.operators import masters as M

    draw, share = random.Random(2), {"a": 0.5, "b": 0.3, "c": 0.2}
    for _ in range(60):
        master = [draw.choice("abc") for _ in range(draw.randrange(0, 6))]
        seen = [[draw.choice("abcd") for _ in range(draw.randrange(0, 7))] for _ in range(4)]
        eps = draw.choice([0.0, 0.05])
        model = L.Indel(L.Background(share, 0.01), 0.1, 0.2, eps)
        for s, value, steps in zip(seen, *M.aligned(master, seen, share, 0.01, 0.1, 0.2, eps), strict=True):
            want = model.best_alignment(master, s)[0]
            assert value == want if math.isinf(want) else value == pytest.approx(want)
            assert [t for k, _, t in steps if k != "D"] == s and [i for k, i, _ in steps if k != "I"] == list(range(len(master)))


def test_masters_of_whole_bags(spark):
    from grovekit.operators import masters as M

    rows, planted = [], {"p": list("abcdebacd"), "q": list("ccabdd"), "one": list("ab")}
    for name, master in planted.items():
        model = L.Indel(L.Background({t: 0.2 for t in "abcde"}), 0.06, 0.1, 0.02)
        seen = [master] if name == "one" else L.simulated_set(master, model, 60, seed=3)
        rows += [(name, s, 1.0) for s in seen]
    rows += [("none", [], 1.0)]
    bags = spark.createDataFrame(rows, "cluster string, seq array<string>, weight double").repartition(3)
    found = {r.cluster: r for r in M.fitted_masters(bags).collect()}
    assert {c: r.seq for c, r in found.items()} == planted and 0 < found["p"].p_del < 0.3
    short = spark.createDataFrame([("p", list("abcd")), ("q", list("ccabddaa"))], "cluster string, master array<string>")
    grown = {r.cluster: r.seq for r in M.fitted_masters(bags, start=short).collect()}
    assert grown["q"] == planted["q"] and len(grown["p"]) > 6  # places go and come
    assert {r.cluster: len(r.seq) for r in M.fitted_masters(bags, start=short, fixed=True).collect()} == {"p": 4, "q": 8}
    # light sequences that come first by the alphabet don't outweigh heavy ones
    heavy = [("h", list("a" + "bc" * 3), 1.0)] * 32 + [("h", list("zzzz"), 1000.0)] * 6
    bag = spark.createDataFrame(heavy, "cluster string, seq array<string>, weight double")
    for exemplars in (E.consensus_exemplars(bag), E.likelihood_exemplars(bag), E.medoid_exemplars(bag)):
        assert [r.seq for r in exemplars.collect()] == [list("zzzz")]


def test_exemplars_of_bags(spark):
    rows = [(c, list(s), w, n) for c, s, w, n in (("x", "abcd", 2.0, 2), ("x", "abd", 1.0, 1), ("x", "abcd" + "e", 0.5, 3), ("y", "ee", 1.0, 1))]
    bags = spark.createDataFrame(rows, "cluster string, seq array<string>, weight double, cnt long")
    for found in (E.medoid_exemplars(bags), E.consensus_exemplars(bags), E.likelihood_exemplars(bags)):
        assert {r.cluster: "".join(r.seq) for r in found.collect()} == {"x": "abcd", "y": "ee"}
    from pyspark.sql import functions as F

    assert {r.cluster: r.median_length for r in E.median_length(bags, F.size("seq")).collect()} == {"x": 4.5, "y": 2.0}
    assert E.raw_sequences(bags).count() == 7


def test_distances_to_many_texts_at_once():
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcd") for _ in range(n)) for n in (0, 1, 3, 8, 8, 9, 17, 40, 70, 130)]
    side = S.Texts(texts)
    for t in [*texts, "xyz", "abcdabcd", "é" * 66]:
        assert side.distances(t).tolist() == [S.edit_distance(t, x) for x in texts]


def test_medoids_give_a_row_a_sequence_not_a_pair(spark, capsys):
    draw = random.Random(6)
    rows = [(c, "".join(draw.choice("abc") for _ in range(draw.randint(0, 8))), draw.random()) for c in ("p", "q") for _ in range(60)]
    rows = list({r[:2]: r for r in rows}.values())
    bags = spark.createDataFrame(rows, "cluster string, seq string, weight double")
    found = C.medoids(bags, block=16)
    for r in found.collect():
        own = [(s, w) for c, s, w in rows if c == r.cluster]
        best = min((round(sum(w * S.edit_distance(a, b) for b, w in own), 6), a) for a, _ in own)
        assert (r.seq, round(r.objective, 5)) == (best[1], round(best[0], 5))
    found.explain()
    assert "levenshtein" not in capsys.readouterr().out


def test_distances_of_texts_that_share_prefixes():
    """Sums over shared prefixes are those of each pair alone, with the empty text, texts within others and few shared prefixes."""
    rng = random.Random(23)
    for letters, most in (("ab", 5), ("abc", 7), ("abcdefgh", 12)):
        left, right = (sorted({"", *("".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(40))}) for _ in range(2))
        a, b = np.array([rng.random() for _ in left]), np.array([rng.random() for _ in right])
        own, other = S.distance_sums(left, a, right, b, rows=9)
        table = np.array([[S.edit_distance(x, y) for y in right] for x in left])
        assert np.allclose(own, table @ b) and np.allclose(other, a @ table)
    assert len(S.Prefixes(["", "a", "aa", "ab", "b"], {})) == 5
