"""Tree tables in Spark: checks, indexes, pair scores."""

import tracemalloc

import numpy as np

import __spark_entry__
from grovekit.functions import kernels
from grovekit.operators import matching, trees


def nodes(spark, *given):
    return spark.createDataFrame([(t, u, p, x) for t, parents, labels in given for u, (p, x) in enumerate(zip(parents, labels, strict=True))], "tree_id string, u int, parent int, label string")


def test_index_and_counts(spark):
    got = {r.u: r for r in trees.tree_index(nodes(spark, ("t", [-1, 0, 0, 1, 2], "abcde"))).collect()}
    assert [(got[u].depth, got[u].height, got[u].size, got[u].tin, got[u].tout) for u in range(5)] == [(0, 2, 5, 0, 5), (1, 1, 2, 1, 3), (1, 1, 2, 3, 5), (2, 0, 1, 2, 3), (2, 0, 1, 4, 5)]
    mass = {(r.u, r.label): r.mass for r in trees.exponential_count(nodes(spark, ("t", [-1, 0, 1], "aba"))).collect()}
    assert mass == {(0, "a"): 5.0, (0, "b"): 2.0, (1, "b"): 1.0, (1, "a"): 2.0, (2, "a"): 1.0}


def test_validation(spark):
    bad = nodes(spark, ("ok", [-1, 0], "ab"), ("two", [-1, -1], "ab"), ("lost", [-1, 7], "ab"))
    got = {r.tree_id: (r.roots, r.late_parents, r.lost_parents, r.repeated) for r in trees.validate(bad).collect()}
    assert got == {"ok": (1, 0, 0, 0), "two": (2, 0, 0, 0), "lost": (1, 1, 1, 0)}


def test_validation_joins_nothing(spark, capsys):
    """Odd rows are counted as before, and no join holds the numbers of a collection."""
    rows = [("t", 0, -1), ("t", 0, -1), ("t", 1, 5), ("t", 2, 1), ("t", None, 1), ("t", 3, 3), ("s", 0, None)]
    found = trees.validate(spark.createDataFrame(rows, "tree_id string, u int, parent int"))
    found.explain()
    assert "Join" not in capsys.readouterr().out
    assert {r.tree_id: tuple(r)[1:] for r in found.collect()} == {"t": (6, 2, 2, 1, 1), "s": (1, None, None, 0, 0)}


def test_timestamp_order():
    assert trees.timestamp_order([-1, 0, 0, 1], [0, 5, 1, 6]) == [0, 2, 1, 3]


def test_all_pairs_by_blocks_equal_single_pairs(spark):
    rng = np.random.default_rng(3)
    given = [(f"t{i}", [-1, *(int(rng.integers(0, u)) for u in range(1, 7))], rng.choice(list("abc"), 7).tolist()) for i in range(9)]
    got = {(r.g, r.h): r.score for r in matching.all_pair_scores(nodes(spark, *given), block_trees=2).collect()}
    assert len(got) == 36
    for i, (a, p, x) in enumerate(given):
        for b, q, y in given[i + 1 :]:
            assert got[a, b] == kernels.path_pairs(np.array(p), np.array(q), matching.label_weights(x, y, None))[0]


def test_scores_hold_only_what_trees_have_in_common(spark):
    """Two large trees with few labels in common, copies of one tree, and a walk in parts: no table of all nodes, and the same scores."""
    rng, n = np.random.default_rng(5), 30_000
    wide = [("wide", 0, -1, "r"), *(("wide", u, int(u > 9) * (1 + u % 9), f"w{u}") for u in range(1, n))]
    other = [("other", 0, -1, "r"), *(("other", u, 0 if u < 10 else u % 9 + 1, f"w{u}" if u in (3, 11, 13) else f"o{u}") for u in range(1, n))]
    copies = [(f"c{i}", u, u - 1, label) for i in range(3) for u, label in enumerate("rab")]
    given = spark.createDataFrame([*wide, *other, *copies], "tree_id string, u int, parent int, label string")
    tracemalloc.start()
    lists = [{"parent": [r[2] for r in t], "label": [r[3] for r in t]} for t in (wide, other)]
    assert matching.shared_scores(lists[:1], lists[1:])[0, 0] == 3.0  # r, w3, w11
    assert tracemalloc.get_traced_memory()[1] < 1 << 28  # the whole table has 7 GB
    tracemalloc.stop()
    got = {(r.g, r.h): r.score for r in matching.all_pair_scores(given, block_members=2).collect()}
    assert got == {("c0", "c1"): 3.0, ("c0", "c2"): 3.0, ("c1", "c2"): 3.0, **{(f"c{i}", t): 1.0 for i in range(3) for t in ("other", "wide")}, ("other", "wide"): 3.0}
    for _ in range(20):
        g, hs = np.array([-1, *(int(rng.integers(0, u)) for u in range(1, 30))]), [np.array([-1, *(int(rng.integers(0, u)) for u in range(1, m))]) for m in (7, 20)]
        labels, own = [int(x) for x in rng.integers(0, 4, 27)], [int(x) for x in rng.integers(0, 4, 30)]
        columns = kernels.Columns(hs)
        weigh = matching.weigher([labels[i] for i in columns.order], None)
        assert (kernels.forest_scores([(g, own)], columns, weigh, cells=60) == kernels.forest_scores([(g, own)], columns, weigh)).all()


def test_empty_collection(spark):
    assert matching.all_pair_scores(spark.createDataFrame([], "tree_id string, u int, parent int, label string")).collect() == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scores_by_words_equal_tables():
    """Where every key weighs 1, paths of up to 64 nodes are words of bits (longer ones tables), with the same scores."""
    rng = np.random.default_rng(11)
    for step, size, overlap in ((1, 130, False), (1, 64, True), (4, 60, True), (9, 40, False)):
        def tree(n, step=step, overlap=overlap):
            labels = [None if rng.random() < 0.1 else [f"k{x}" for x in {*rng.integers(0, 4, 2).tolist()}] if overlap else f"k{rng.integers(0, 4)}" for _ in range(n)]
            return {"parent": [-1, *(max(0, u - 1 - int(rng.integers(0, step))) for u in range(1, n))], "label": labels}

        left, right = ([tree(int(rng.integers(1, size + 1))) for _ in range(4)] + [tree(size)] for _ in range(2))
        for other in (right, left):
            assert (matching.shared_scores(left, other, None, overlap) == matching._table_scores(left, list(other), None, overlap, False)).all()
    g, h = np.array([-1, 0, 1]), np.array([-1, 0, 0])
    one = [np.array([0])]
    assert kernels.unit_scores(g, np.zeros(3, int), np.zeros(3, int), one, h, np.zeros(3, int), np.arange(3), np.zeros(3, int), 1, (1, 1)).tolist() == [[2.0]]


def test_pairs_of_equal_trees_are_listed_once(spark):
    """Many trees of few kinds, their names in parts: every pair once, without a shuffle of pairs."""
    given = nodes(spark, *((f"t{i}", [-1, 0, 1][: 1 + i % 3], "aba"[: 1 + i % 3]) for i in range(40)))
    for rows in (5_000_000, 0):
        got = [(r.g, r.h, r.score) for r in matching.all_pair_scores(given, block_members=3, spread_rows=rows).collect()]
        assert sorted(got) == sorted((*sorted((f"t{i}", f"t{j}")), float(1 + min(i % 3, j % 3))) for i in range(40) for j in range(i))
