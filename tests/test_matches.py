"""Matches with their pairs: pinned cases, brute force, and the options of beams, candidates, weights and subtrees."""

import functools
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.functions import kernels as K
from grovekit.operators import paths as P
from grovekit.operators import sketches as S
from grovekit.operators import subtrees as U
from grovekit.operators import trees as T
from grovekit.operators import weights as V

from test_kernels import brute, random_tree

NODES = "tree_id string, u int, parent int, label string"


def chain(n):
    return list(range(-1, n - 1))


def frame(spark, trees):
    """{name: (parents, labels)} as nodes."""
    return spark.createDataFrame([(name, u, int(p), t) for name, (parents, labels) in trees.items() for u, (p, t) in enumerate(zip(parents, labels, strict=True))], NODES)


def pairs_of(spark, *names):
    return spark.createDataFrame(list(names), "g string, h string")


def found(rows):
    return {(r["g"], r["h"]): (r["score"], [(p["u"], p["v"]) for p in r["pairs"]]) for r in rows.collect()}


FORK = ([-1, 0, 0, 2, 3], "AABC")
TREES = {
    "a": (chain(8), "xAxxBxxC"), "b": (chain(8), "yAyyBzzC"), "c": ([-1, 0, 0, 1, 1, 2, 5], "rAxBCAD"), "d": ([-1, 0, 0, 1, 2, 2], "zAABCD"),
    "e": (FORK[0], ["Groot", *FORK[1]]), "f": (FORK[0], ["Hroot", *FORK[1]]), "g": (chain(4), "AxxB"), "h": (chain(4), "AyyB"),
}
ASKED = [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")]


@pytest.fixture(scope="module")
def pinned(spark):
    nodes = frame(spark, TREES).cache()
    labelled = S.labelled_index(T.tree_index(nodes), nodes).cache()
    return nodes, labelled, V.node_matches(V.KeyedWeight().keys(nodes), pairs_of(spark, *ASKED)).cache()


def nested(name_g, name_h, pairs):
    below = lambda p, a, u: p[u] >= 0 and (p[u] == a or below(p, a, p[u]))
    return all(below(TREES[name_g][0], a, c) and below(TREES[name_h][0], b, d) for (a, b), (c, d) in itertools.pairwise(pairs))


def test_beam_defaults_and_exact(spark, pinned):
    nodes, labelled, matches = pinned
    got, exact = found(P.beam_matches(matches, labelled)), found(P.path_matches(pairs_of(spark, *ASKED), nodes))
    assert got["a", "b"] == (3.0, [(1, 1), (4, 4), (7, 7)]) == exact["a", "b"]
    assert got["g", "h"] == (2.0, [(0, 0), (3, 3)])
    wide = found(P.beam_matches(matches, labelled, P.Beam(width=10**6, expansion=None)))
    for pair in ASKED:
        assert wide[pair][0] == exact[pair][0] and nested(*pair, wide[pair][1])
    both = found(P.beam_matches_symmetric(matches, labelled))
    assert {p: s for p, (s, _) in both.items()} == {p: s for p, (s, _) in exact.items()}


NARROW = {"width": 1, "expansion": 1, "rarity": 0.0, "gap": 0.0, "balance": 0.0, "future": 0.0, "state_future": 0.0}


def test_lookahead_rescues_a_narrow_beam(spark, pinned):
    _, labelled, matches = pinned
    own = matches.where("g = 'e'")
    assert found(P.beam_matches(own, labelled, P.Beam(**NARROW)))["e", "f"][0] == 1.0
    sketch = S.lookahead_sketches(labelled, size=8, discount=1.0)
    assert found(P.beam_matches(own, labelled, P.Beam(**NARROW, look=2.0), [(sketch, 1.0)]))["e", "f"] == (3.0, [(2, 2), (3, 3), (4, 4)])
    runs = S.lookahead_sketches(labelled, size=8, discount=1.0, run_length=2)
    score, pairs = found(P.beam_matches(own, labelled, P.Beam(**NARROW, look=2.0), [(runs, 1.0)]))["e", "f"]
    assert score > 1.0 and pairs[0] == (2, 2)


def test_beam_hooks(spark, pinned):
    _, labelled, matches = pinned
    own = matches.where("g = 'g'")
    seen = []
    hooked = P.Beam(candidate_priority=lambda c: seen.append("c") or c + F.col("lookahead"), state_priority=lambda c: seen.append("s") or c)
    assert found(P.beam_matches(own, labelled, hooked))["g", "h"] == (2.0, [(0, 0), (3, 3)]) and {"c", "s"} <= set(seen)
    only_last = P.Beam(candidate_priority=lambda c: F.when(F.col("u") > 0, c))  # a null priority takes the pair out
    assert found(P.beam_matches(own, labelled, only_last))["g", "h"] == (1.0, [(3, 3)])
    outside = P.Beam(expand=lambda f: f.select("g", "h", "state", F.lit(999).alias("u"), F.lit(0).alias("v"), F.lit(1.0).alias("w")))
    with pytest.raises(ValueError, match="outside tree bounds"):
        P.beam_matches(own, labelled, outside)
    given = P.Beam(expand=lambda f: f.select("g", "h", "state", (F.coalesce("u", F.lit(-1)) + 1).alias("u"), (F.coalesce("v", F.lit(-1)) + 1).alias("v"), F.lit(0.5).alias("w")).where("u < 4"))
    assert found(P.beam_matches(own, labelled, given))["g", "h"] == (2.0, [(i, i) for i in range(4)])
    assert found(P.beam_matches(own, labelled, P.Beam(layers=1)))["g", "h"][0] == 1.0
    for wrong in ({"width": 0}, {"expansion": 0}, {"layers": -1}):
        with pytest.raises(ValueError):
            P.Beam(**wrong)
    assert P.beam_matches(own.where("false"), labelled).collect() == []


def test_sparse_and_dense_equal_brute_force(spark):
    rng = random.Random(8)
    trees = {f"t{i}": (random_tree(rng, rng.randrange(1, 12)), None) for i in range(8)}
    trees = {name: (p, [rng.choice(["a", "b", "c", None]) for _ in p]) for name, (p, _) in trees.items()}
    nodes, asked = frame(spark, trees), pairs_of(spark, *itertools.combinations(sorted(trees), 2))
    value = {"a": 1.0, "b": 2.5}
    weight = V.KeyedWeight(V.label_keys, spark.createDataFrame(list(value.items()), "key string, value double"))
    dense = found(P.path_matches(asked, nodes, weight))
    matches, index = V.node_matches(weight.keys(nodes), asked), T.tree_index(nodes)
    sparse = found(P.sparse_matches(matches, index))
    assert {(r["g"], r["h"]): (r["score"], r["nested"]) for r in P.checked(P.path_matches(asked, nodes, weight), nodes, index, weight).collect()} == {p: (s, True) for p, (s, _) in dense.items()}
    for (g, h), (score, pairs) in dense.items():
        w = np.array([[value.get(x, 0.0) if x == y else 0.0 for y in trees[h][1]] for x in trees[g][1]])
        assert score == brute(trees[g][0], trees[h][0], w) == sum(w[u, v] for u, v in pairs)
        assert sparse.get((g, h), (0.0,))[0] == score
    capped = found(P.sparse_matches(matches, index, most_per_u=1, mode="last"))
    assert set(capped) == set(sparse) and all(capped[p][0] <= sparse[p][0] for p in sparse)


def test_keyers(spark):
    nodes = spark.createDataFrame([("g", 0, -1, "x/y/z", ["b", "a", "a", None]), ("h", 0, -1, None, ["a", "b", "c"]), ("h", 1, 0, "x y", [])], NODES + ", tokens array<string>")
    key = lambda keyer: sorted((r["tree_id"], r["u"], r["key"]) for r in keyer(nodes).collect())
    assert key(V.label_keys) == [("g", 0, "x/y/z"), ("h", 1, "x y")]
    assert key(V.token_keys(most=None)) == [("g", 0, "a"), ("g", 0, "b"), ("h", 0, "a"), ("h", 0, "b"), ("h", 0, "c")]
    assert key(V.combination_keys(2)) == [("g", 0, "a|b"), ("h", 0, "a|b"), ("h", 0, "a|c"), ("h", 0, "b|c")]
    assert key(V.prefix_keys(2)) == [("g", 0, "x"), ("g", 0, "x/y"), ("h", 1, "x"), ("h", 1, "x/y")]
    assert len(key(V.token_keys(most=1))) == 2
    values = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "key string, value double")
    asked = spark.createDataFrame([("g", "h")], "g string, h string")
    row = V.node_matches(V.KeyedWeight(V.token_keys(), values).keys(nodes), asked).collect()
    assert [tuple(r) for r in row] == [("g", "h", 0, 0, 3.0)]
    assert V.node_matches(V.KeyedWeight(V.token_keys(), values).keys(nodes), asked, stop=0).collect() == []


def embedded(g, h, w, ordered, ranks):
    """Plain recursion over subtrees and all matchings of children."""
    kids = [[sorted((c for c in range(1, len(p)) if p[c] == u), key=lambda c, r=r: (r[c], c)) for u in range(len(p))] for p, r in zip((g, h), ranks, strict=True)]

    @functools.lru_cache(None)
    def best(u, v):
        a, b = kids[0][u], kids[1][v]

        def match(i, used):
            if i == len(a):
                return 0.0
            free = [j for j in range(len(b)) if j not in used and not (ordered and j < max(used, default=-1))]
            return max([match(i + 1, used), *(best(a[i], b[j]) + match(i + 1, used | {j}) for j in free)])

        return max([w[u, v] + match(0, frozenset()), *(best(c, v) for c in a), *(best(u, d) for d in b)])

    return best


@pytest.mark.parametrize("ordered", [True, False])
def test_subtrees_equal_brute_force(ordered):
    rng = random.Random(4)
    for turn in range(60):
        g, h = random_tree(rng, rng.randrange(1, 8)), random_tree(rng, rng.randrange(1, 8))
        w = np.array([[rng.choice([0, 0, 1, 2, 0.5, 3]) for _ in h] for _ in g])
        ranks = [np.arange(len(p)) if turn % 2 else np.array([rng.randrange(3) for _ in p]) for p in (g, h)]
        best = embedded(g, h, w, ordered, ranks)
        roots = [(u, v) for u in range(len(g)) for v in range(len(h))]
        for (u, v), (score, pairs) in zip(roots, K.subtree_matches(g, h, w, roots, ordered, tuple(ranks)), strict=True):
            assert score == pytest.approx(best(u, v)) == pytest.approx(sum(w[p] for p in pairs))
            assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
    wide = np.array([[rng.choice([0.0, 1, 2, 5]) for _ in range(9)] for _ in range(10)])
    star = [np.array([-1] + [0] * (n - 1)) for n in wide.shape]
    assert K.subtree_table(*star, wide, False)[0, 0] == pytest.approx(max(K.assignment(wide[1:, 1:])[0] + wide[0, 0], wide[0].max(), wide[:, 0].max()))


def test_subtree_operator(spark):
    rows = [("g", 0, -1, "r", 1), ("g", 1, 0, "a", 5), ("g", 2, 0, "b", 3), ("g", 3, 2, "c", 4), ("h", 0, -1, "r", 1), ("h", 1, 0, "b", 1), ("h", 2, 0, "a", 2), ("h", 3, 1, "c", None)]
    nodes = spark.createDataFrame(rows, NODES + ", ts int")
    asked = spark.createDataFrame([("g", "h", 0, 0), ("g", "h", 2, 1)], "g string, h string, root_u int, root_v int")
    got = {(r["root_u"], r["root_v"]): (r["score"], [(p["u"], p["v"]) for p in r["pairs"]]) for r in U.subtree_matches(asked, nodes).collect()}
    assert got[0, 0][0] == 3.0 and got[2, 1] == (2.0, [(2, 1), (3, 3)])  # a and b are in another order
    free = found(U.subtree_matches(asked.select("g", "h").distinct(), nodes, ordered=False))
    assert free["g", "h"] == (4.0, [(0, 0), (1, 2), (2, 1), (3, 3)])
    timed = U.subtree_matches(asked.select("g", "h").distinct(), nodes, by_time=True)
    assert found(timed)["g", "h"] == (4.0, [(0, 0), (2, 1), (3, 3), (1, 2)])  # by time both have b first; pairs in g's time
    assert [(r["place"], r["label"]) for r in U.annotated(timed, nodes).orderBy("place").collect()] == [(1, "r"), (2, "b"), (3, "c"), (4, "a")]
    with pytest.raises(Exception, match="outside tree bounds"):
        U.subtree_matches(asked.withColumn("root_u", F.lit(9)), nodes).collect()


def test_template_and_reference_pairs(spark):
    nodes = frame(spark, {"p": (chain(6), "112333"), "q": (chain(5), "12123"), "s": (chain(3), "AAA"), "none": (chain(2), "xy")})
    got = {r["tree_id"]: (r["score"], [(p["u"], p["v"]) for p in r["pairs"]]) for r in P.template_matches(nodes, ["1", "2", "3"]).collect()}
    assert got["p"] == (6.0, [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 2)])
    assert got["q"][0] == 4.0 and len(got["q"][1]) == 4 and [v for _, v in got["q"][1]] == sorted(v for _, v in got["q"][1]) and got["none"] == (0.0, [])
    for penalty, score, n in ((0.0, 3.0, 3), (0.25, 2.5, 3), (1.25, 1.0, 1)):
        row = {r["tree_id"]: r for r in P.template_matches(nodes, ["A"], penalty).collect()}["s"]
        assert row["score"] == score and len(row["pairs"]) == n
    took = {r["tree_id"]: (r["score"], [(p["u"], p["v"]) for p in r["pairs"]]) for r in P.reference_matches(nodes, ["1", "3", "2", "3"], [1.0, 1.0, 5.0, 2.0]).collect()}
    assert took["q"] == (8.0, [(2, 0), (3, 2), (4, 3)]) and took["none"] == (0.0, [])
    # the first fitting place of a 3 is 1; only with every place can it be 3
    score, path = K.reference_matches(np.array([-1]), [[("3", None)]], ["1", "3", "2", "3"], [1.0, 1.0, 5.0, 2.0])
    assert (score, path) == (1.0, [(0, 1, 0)])
    assert K.reference_matches(np.array([-1]), [[("3", None)]], ["1", "3", "2", "3"], [1.0, 1.0, 5.0, 2.0], every_place=True) == (2.0, [(0, 3, 0)])
    assert K.weighted_reference(np.array([-1]), [[("3", 0.5)]], ["3"], [2.0], combine=lambda r, w: r - w) == 1.5


def test_template_pairs_are_worth_their_score():
    rng = random.Random(6)
    for _ in range(150):
        g, k, c = random_tree(rng, rng.randrange(1, 9)), rng.randrange(1, 5), rng.choice([0.0, 0.3, 1.0])
        w = np.array([[rng.choice([-100.0, 1.0, 2.0]) for _ in range(k)] for _ in g])
        score, pairs = K.template_matches(g, np.arange(-1, k - 1), w, c)
        again = sum(b == d for (_, b), (_, d) in itertools.pairwise(pairs))
        assert score == pytest.approx(sum(w[p] for p in pairs) - c * again)
        assert all(b <= d for (_, b), (_, d) in itertools.pairwise(pairs))


def test_nearest_trees_equal_all_pairs(spark):
    from grovekit.operators import neighbours as N

    rng = random.Random(3)
    tokens = {f"t{i:02}": [rng.choice("abcdefghij"[: 3 + i % 8]) for _ in range(rng.randrange(1, 9))] for i in range(40)}
    tokens |= {f"same{i:02}": list("common") for i in range(25)} | {"alone": ["z"]}
    rows = [(t, x) for t, xs in tokens.items() for x in xs] + [("t00", None), ("empty", None)]
    features = N.tree_features(spark.createDataFrame(rows, "tree_id string, token string"))
    vectors = {}
    for r in features.collect():
        vectors.setdefault(r["tree_id"], {})[r["dim"]] = r["value"]
    want = set()
    for g, a in vectors.items():
        near = sorted((-round(sum(x * b.get(d, 0.0) for d, x in a.items()), 9), h) for h, b in vectors.items() if h != g and a.keys() & b.keys())
        want |= {(g, h, -c, rank) for rank, (c, h) in enumerate(near[:4], 1)}
    for probes in (1, 8):
        got = {(r["g"], r["h"], r["cosine"], r["rank"]) for r in N.nearest_trees(features, k=4, probes=probes).collect()}
        assert {(g, h, r) for g, h, _, r in got} == {(g, h, r) for g, h, _, r in want} and not any(g in ("alone", "empty") for g, *_ in got)
    hashed = N.tree_features(spark.createDataFrame(rows, "tree_id string, token string"), hash_dim=4, binary=True, normalised=False)
    assert {r["value"] for r in hashed.collect()} == {1.0} and hashed.select("dim").distinct().count() <= 4
    chosen = [r["tree_id"] for r in N.landmarks(features, 5, seed=None).orderBy("place").collect()]
    apart = lambda a, b: round(max(0.0, sum(x * x for x in a.values()) + sum(x * x for x in b.values()) - 2 * sum(x * b.get(d, 0.0) for d, x in a.items())), 9)
    plain = [min(vectors)]
    while len(plain) < 5:
        plain.append(min((t for t in vectors if t not in plain), key=lambda t: (-min(apart(vectors[t], vectors[p]) for p in plain), t)))
    assert chosen == plain
    assert N.landmarks(features, 3, "random").count() == 3 and N.landmarks(features, 500).count() == len(vectors)
    with pytest.raises(ValueError):
        N.landmarks(features, 0)


def test_edge_lists(spark):
    from grovekit.sources import edges as G

    trees = {
        "ok": ([0, 1, 2, 3], [(0, 1), (0, 2), (1, 3)]), "mixed": ([7, 5, 9, 1], [(9, 5), (9, 1), (1, 7)]), "deep": (list(range(40)), [(i + 1, i) for i in range(39)]), "one": ([3], []),
        "loop": ([0, 1], [(0, 1), (1, 1)]), "two": ([0, 1, 2], [(0, 2), (1, 2)]), "cycle": ([0, 1, 2, 3], [(1, 2), (2, 3), (3, 1)]), "ring": ([0, 1], [(0, 1), (1, 0)]), "lost": ([0, 1], [(0, 1), (0, 8)]),
    }
    nodes = spark.createDataFrame([(t, i, f"{t}{i}", 100 - i if i != 2 else None) for t, (ids, _) in trees.items() for i in ids], "tree_id string, id int, label string, ts int")
    edges = spark.createDataFrame([(t, a, b) for t, (_, es) in trees.items() for a, b in es], "tree_id string, src int, dst int")
    found = {r["tree_id"]: tuple(r)[1:] for r in G.edge_issues(nodes, edges).collect()}  # n, unknown, loops, many parents, roots, unreachable
    assert found["ok"] == (4, 0, 0, 0, 1, 0) and found["deep"] == (40, 0, 0, 0, 1, 0) and found["one"] == (1, 0, 0, 0, 1, 0)
    assert found["loop"] == (2, 0, 1, 0, 1, 0) and found["two"] == (3, 0, 0, 1, 2, 0) and found["cycle"] == (4, 0, 0, 0, 1, 3) and found["ring"] == (2, 0, 0, 0, 0, 2) and found["lost"] == (2, 1, 0, 0, 1, 0)
    with pytest.raises(ValueError, match="not a rooted tree"):
        G.trees_from_edges(nodes, edges)
    got = {}
    for r in G.trees_from_edges(nodes, edges, strict=False).collect():
        got.setdefault(r["tree_id"], {})[r["u"]] = (r["orig"], r["parent"], r["label"])
    assert set(got) == {"ok", "mixed", "deep", "one"}
    assert got["ok"] == {i: (i, p, f"ok{i}") for i, p in enumerate([-1, 0, 0, 1])}  # already in order
    assert got["mixed"] == {0: (9, -1, "mixed9"), 1: (1, 0, "mixed1"), 2: (7, 1, "mixed7"), 3: (5, 0, "mixed5")}
    assert [got["deep"][u][0] for u in range(40)] == list(range(39, -1, -1))
    own = nodes.where("tree_id IN ('ok', 'mixed')"), edges.where("tree_id IN ('ok', 'mixed')")
    timed = {(r["tree_id"], r["u"]): r["orig"] for r in G.trees_from_edges(*own, "time").collect()}
    assert [timed["mixed", u] for u in range(4)] == [9, 5, 1, 7] and [timed["ok", u] for u in range(4)] == [0, 2, 1, 3]
    with pytest.raises(ValueError, match="parents first"):
        G.trees_from_edges(*own, "given")
    given = G.trees_from_edges(own[0].where("tree_id = 'ok'"), own[1].where("tree_id = 'ok'"), "given")
    again = {r["u"]: r["orig"] for r in G.timed_trees(given, own[0].select("tree_id", F.col("id").alias("orig"), F.col("id").alias("ts"))).collect()}
    assert again == {0: 0, 1: 1, 2: 2, 3: 3}
    assert G.edge_issues(nodes.limit(0), edges).collect() == []


def test_matcher_gives_the_nodes_own_ids(spark):
    from grovekit.operators.matcher import METHODS, TreeMatcher

    nodes = frame(spark, {k: TREES[k] for k in "abcd"}).withColumn("orig", F.concat("tree_id", F.lit("-"), F.col("u") * 10))
    matcher = TreeMatcher(nodes)
    asked = pairs_of(spark, ("a", "b"), ("c", "d"))
    for method in METHODS:
        rows = {(r["g"], r["h"]): r for r in matcher.match(asked, method).collect()}
        assert rows["a", "b"]["score"] == 3.0
        named = [(p["orig_u"], p["orig_v"]) for p in rows["a", "b"]["pairs"] if (p["u"], p["v"]) in ((1, 1), (4, 4), (7, 7))]
        assert named == [("a-10", "b-10"), ("a-40", "b-40"), ("a-70", "b-70")]
    assert matcher.match(asked, "beam", lookahead=[({"size": 8}, 1.0)]).count() == 2
    one = spark.createDataFrame([("a", "b", 4, 4)], "g string, h string, u int, v int")
    assert [r["score"] for r in matcher.match(asked, "sparse", candidates=one).collect()] == [1.0]
    assert matcher.pairs().count() == 6 and TreeMatcher(nodes.where("u < 1")).match().collect() == []
    assert {r["tree_id"]: r["score"] for r in matcher.template(["A", "B"]).collect()}["a"] == 2.0
    assert {r["tree_id"]: r["score"] for r in matcher.reference(["x", "A"], [1.0, 4.0]).collect()}["a"] == 5.0
    with pytest.raises(ValueError):
        matcher.match(asked, "guess")


def test_spanning_tree_and_density_cuts(spark):
    from grovekit.operators import density as D

    rng = random.Random(12)
    names = [f"n{i:02}" for i in range(30)]
    edges = [(a, b, float(rng.choice([1, 2, 2, 3, 5, 8]))) for a, b in itertools.combinations(names, 2) if rng.random() < 0.2] + [("n00", "n00", 0.5), ("p", "q", 1.0)]
    rows = spark.createDataFrame(edges, "g string, h string, w double")

    def kruskal(some):
        root, out = {}, []
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in some if a != b):
            if find(a) != find(b):
                root[find(a)] = find(b)
                out.append((a, b, w))
        return sorted(out), find

    tree = D.spanning_tree(rows).cache()
    assert sorted(map(tuple, tree.collect())) == kruskal(edges)[0]
    trees = spark.createDataFrame([(t,) for t in [*names, "p", "q", "alone"]], "tree_id string")
    for at in (0.0, 1.0, 2.0, 100.0):
        find = kruskal([e for e in edges if e[2] <= at])[1]
        groups = {}
        for t in [*names, "p", "q", "alone"]:
            groups.setdefault(find(t), []).append(t)
        want = {t: (min(g) if len(g) >= 3 else None) for g in groups.values() for t in g}
        assert {r.tree_id: r.cluster for r in D.density_clusters(trees, tree, at, 3).collect()} == want
    reach = {(r.g, r.h): r.w for r in D.mutual_reachability(spark.createDataFrame([("a", "b", 1.0), ("c", "a", 3.0), ("b", "c", 2.0), ("d", "a", 9.0)], "g string, h string, distance double"), 2).collect()}
    assert reach == {("a", "b"): 3.0, ("a", "c"): 3.0, ("b", "c"): 3.0}
    assert D.spanning_tree(rows.limit(0)).collect() == []


def test_sketches_without_a_bound_hold_all_tokens(spark):
    """A root with more children than any bound of before: every run of two labels has a row."""
    nodes = spark.createDataFrame([("t", 0, -1, "r"), *(("t", u, 0, f"x{u}") for u in range(1, 1203))], "tree_id string, u int, parent int, label string")
    labelled = S.labelled_index(T.tree_index(nodes), nodes)
    assert S.lookahead_sketches(labelled, size=None, run_length=2).count() == 1202
    assert S.lookahead_sketches(labelled, size=1000, run_length=2).count() == 1000


def test_nearest_trees_by_blocks_equal_the_index(spark, monkeypatch):
    """Where an index leaves nothing out, no pair of classes is a row of a join; trees with ties across blocks."""
    from grovekit.operators import neighbours as N

    rng = random.Random(8)
    rows = [(f"t{i:03}", rng.choice("abcde")) for i in range(150) for _ in range(rng.randrange(4, 12))]
    features = N.tree_features(spark.createDataFrame(rows, "tree_id string, token string"))
    known = {tuple(r) for r in N.nearest_trees(features, k=5, dense_dims=0).collect()}
    monkeypatch.setattr(N, "_indexed_neighbours", lambda *_: pytest.fail("an index of what all trees share"))
    for cells in (100, 4_000_000):
        got = {tuple(r) for r in N.nearest_trees(features, k=5, cells=cells).collect()}
        assert {r[:2] + r[3:] for r in got} == {r[:2] + r[3:] for r in known} and len(got) == 750


def test_self_scores_read_the_nodes_once_and_make_no_objects(spark, monkeypatch, capsys):
    from grovekit.operators import matching as M
    from grovekit.operators.weights import KeyedWeight

    rng = random.Random(9)
    rows = [(f"t{i}", u, rng.randrange(u) if u else -1, rng.choice(["a", "bb", "ccc", None])) for i in range(30) for u in range(rng.randrange(1, 20))]
    nodes, values = spark.createDataFrame(rows, "tree_id string, u int, parent int, label string"), {"a": 2.0, "bb": 0.5}
    weight = KeyedWeight(values=spark.createDataFrame(list(values.items()), "key string, value double"))
    monkeypatch.setattr(M, "FOREST_NODES", 50)
    for weigh, found in ((lambda t: float(t is not None), M.self_scores(nodes)), (lambda t: values.get(t, 0.0), M.self_scores(nodes, weight))):
        best = {}
        for t, u, p, label in rows:
            best[t, u] = weigh(label) + best.get((t, p), 0.0)
        want = {t: max(s for (g, _), s in best.items() if g == t) for t, *_ in rows}
        assert {r.tree_id: r.score for r in found.collect()} == want
    M.self_scores(nodes).explain()
    assert "Join" not in capsys.readouterr().out


def test_sketches_shuffle_nodes_once_and_equal_brute_force(spark, monkeypatch, capsys):
    """Random trees with null labels and letters beyond ASCII, bounds with ties, runs, and parts of one tree or of many."""
    rng = random.Random(12)
    trees = {f"t{i}": (p, [rng.choice(["a", "b", "ß", "𝔞", None]) for _ in p]) for i, p in enumerate(random_tree(rng, rng.randrange(1, 25)) for _ in range(20))}
    nodes = frame(spark, trees).repartition(2).cache()

    def kept(masses, size):
        best = sorted(masses.items(), key=lambda x: (x[1], [t.encode() for t in x[0]]), reverse=True)
        return dict(best[:size])

    def want(parents, labels, size, discount, length):
        children = {u: [c for c, p in enumerate(parents) if p == u] for u in range(-1, len(parents))}

        def runs(u, n):
            masses = {}
            for c in children[u] if n > 1 else ():
                for token, m in runs(c, n - 1).items():
                    masses[labels[u], *token] = masses.get((labels[u], *token), 0) + m
            return {} if labels[u] is None else {(labels[u],): 1.0} if n == 1 else kept(masses, size)

        out = {}

        def below(u):
            masses = {}
            for c in children[u]:
                for part, share in ((runs(c, length), 1.0), (below(c), discount)):
                    for token, m in part.items():
                        masses[token] = masses.get(token, 0) + share * m
            out[u] = kept(masses, size)
            return out[u]

        below(-1)
        return {(u, token): m for u, masses in out.items() for token, m in masses.items()}

    for part, size, discount, length in ((30, None, 0.5, None), (200_000, 2, 0.5, None), (1, 3, 1.0, 2), (30, 1, 0.25, 3), (200_000, None, 0.5, 2)):
        monkeypatch.setattr(S, "FOREST_NODES", part)
        got = {(r.tree_id, r.u, tuple(r.token)): r.mass for r in S.lookahead_sketches(nodes, size, discount, length).collect()}
        assert got == {(t, u, token): m for t, own in trees.items() for (u, token), m in want(*own, size, discount, length or 1).items()}
    assert S.lookahead_sketches(nodes.where("label IS NULL AND parent = -1")).collect() == [] == S.lookahead_sketches(nodes.limit(0)).collect()
    S.lookahead_sketches(frame(spark, trees)).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_sparse_matches_drop_no_candidate(spark):
    """The best chain goes through the last of more than 2000 nodes with one label."""
    n = 2002
    many = ([-1, *[0] * n, n], ["r", *"a" * n, "b"])
    nodes = frame(spark, {"g": (chain(3), "rab"), "h": many})
    found_ = found(P.sparse_matches(V.node_matches(V.KeyedWeight().keys(nodes), pairs_of(spark, ("g", "h"))), T.tree_index(nodes)))
    assert found_ == {("g", "h"): (3.0, [(0, 0), (1, n), (2, n + 1)])}


def test_subtrees_of_all_pairs(spark):
    """All pairs of trees are scored, as forests with a table for many, and as each pair alone."""
    rng = random.Random(17)
    trees = {str(i): random_tree(rng, rng.randrange(1, 9)) for i in range(9)} | {str(i): chain(i - 8) for i in range(9, 13)}
    trees = {name: (p, [rng.choice(["a", "b", None]) for _ in p]) for name, p in trees.items()}
    asked = list(itertools.combinations(sorted(trees), 2))
    for ordered in (True, False):
        one = {(r["g"], r["h"]): r["score"] for r in U.subtree_matches(pairs_of(spark, *asked), frame(spark, trees), ordered).collect()}
        rows = U.all_pair_subtrees(frame(spark, trees), ordered, block_trees=3).collect()
        assert len(rows) == len(asked) and {(r["g"], r["h"]): r["score"] for r in rows} == one
    packed = [{"parent": p, "label": t} for p, t in trees.values()]
    assert (U.shared_subtrees(packed, packed[:4], cells=100) == U.shared_subtrees(packed, packed[:4])).all()


def test_subtree_chains_cover_all_pairs():
    """Neither the query nor its SQL leaves out pairs by their ids."""
    import __spark_entry__

    assert "%" not in __spark_entry__.oracle_sql()["subtree_chains"]
