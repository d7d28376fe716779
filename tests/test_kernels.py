"""Kernels against pinned cases and a plain chain search."""

import itertools
import random

import numpy as np
import pytest

from grovekit.functions import kernels as K


def chain(n):
    return np.arange(-1, n - 1)


def equal(a, b, other=0.0):
    return np.array([[1.0 if x == y else other for y in b] for x in a])


def brute(g, h, w):
    """The heaviest chain of pairs, each strictly below the one before on both sides."""
    below = lambda p, a, u: any(x == a for x in itertools.takewhile(lambda x: x >= 0, iter_up(p, u)))

    best = {}
    for u in range(len(g)):
        for v in range(len(h)):
            before = [s for (a, b), s in best.items() if below(g, a, u) and below(h, b, v)]
            best[u, v] = w[u, v] + max([0.0, *before])
    return max(0.0, *best.values())


def iter_up(p, u):
    while p[u] >= 0:
        u = p[u]
        yield u


def random_tree(rng, n):
    return np.array([-1, *(rng.randrange(i) for i in range(1, n))])


def test_pinned_chains():
    g, h = "xAxxxBxxCx", "yAyyyByyCy"
    score, pairs = K.path_pairs(chain(10), chain(10), equal(g, h), only_positive=True)
    assert (score, pairs) == (3.0, [(1, 1), (5, 5), (8, 8)])
    assert K.path_pairs(chain(10), chain(10), equal(g, h))[1] == [(i, i) for i in range(9)]
    assert K.path_pairs(chain(10), chain(10), equal(g, h), prefer_match=False) == (3.0, [(1, 1), (5, 5), (8, 8)])
    assert K.path_pairs(chain(6), chain(6), equal("abcdef", "uvwxyz"), only_positive=True) == (0.0, [])


def test_path_scores_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        g, hs = random_tree(rng, rng.randrange(1, 9)), [random_tree(rng, rng.randrange(1, 9)) for _ in range(3)]
        labels = [[rng.choice("ab") for _ in t] for t in (g, *hs)]
        forest, starts = K.forest(hs)
        w = equal(labels[0], sum(labels[1:], []), -0.25)
        got = K.path_scores(g, forest, starts, w)
        for i, h in enumerate(hs):
            own = equal(labels[0], labels[1 + i], -0.25)
            assert got[i] == brute(g, h, own) == pytest.approx(max(0.0, K.path_pairs(g, h, own)[0]))
            positive = np.maximum(own, 0)
            path, ordered, free = brute(g, h, positive), K.ordered_subtree(g, h, positive), K.unordered_subtree(g, h, positive)
            assert path <= ordered <= free


def test_template_repeat():
    def score(g, h, penalty=0.0):
        return K.template_repeat(chain(len(g)), chain(len(h)), equal(g, h, -100.0), penalty)

    assert score("112333", "123") == 6
    assert score("12123", "123") == 4
    assert [score("AAA", "A", p) for p in (0, 0.25, 1.25)] == [3, 2.5, 1]
    with pytest.raises(ValueError):
        K.template_repeat(chain(3), np.array([-1, 0, 0]), np.zeros((3, 3)))


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(1)
    for _ in range(30):
        w = rng.integers(0, 6, rng.integers(1, 5, 2)).astype(float)
        short = w if w.shape[0] <= w.shape[1] else w.T
        want = max(sum(short[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(short.shape[1]), short.shape[0]))
        assert K.assignment(w)[0] == want


def test_weighted_reference():
    assert K.weighted_reference(chain(3), [[("a", None)], [("x", None)], [("c", None)]], ["a", "b", "c"], [1.0, 1.0, 2.0]) == 3.0
    assert K.weighted_reference(chain(1), [[("a", 1.0)]], [], []) == 0.0


def test_shared_nodes_give_the_pairs_of_the_whole_table():
    """Path matches from shared nodes have the scores, pairs and ties of the table of all nodes; so have the scores of unordered subtrees and references."""
    from grovekit.functions import kernels
    from grovekit.operators import matching as M

    rng = np.random.default_rng(11)
    for _ in range(150):
        (g, a), (h, b) = (([-1, *(int(rng.integers(max(0, u - 4), u)) for u in range(1, n))], [f"{side}{x}" if x > 3 else f"s{x}" for x in rng.integers(0, 7, n)]) for side, n in (("g", 18), ("h", 15)))
        weight = M.label_weights(a, b, None)
        keys = [[(t,) for t in side] for side in (a, b)]
        for prefer in (True, False):
            whole = kernels.path_pairs(np.array(g), np.array(h), weight, prefer, only_positive=True)
            assert M.best_path(g, h, *keys, lambda us, vs: weight[np.ix_(us, vs)], prefer) == whole  # noqa: B023
        (p, us), (q, vs) = M.shared_nodes(g, h, *keys, closed=True)
        assert kernels.unordered_subtree(p, q, weight[np.ix_(us, vs)]) == kernels.unordered_subtree(np.array(g), np.array(h), weight)
        assert kernels.ordered_subtree(p, q, weight[np.ix_(us, vs)]) == kernels.ordered_subtree(np.array(g), np.array(h), weight)
        offers, ones = [[(t, 0.0)] for t in a], [1.0] * len(b)
        assert kernels.weighted_reference(np.array(g), offers, b, ones) == kernels.reference_matches(np.array(g), offers, b, ones)[0]
