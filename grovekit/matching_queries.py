"""Queries of matches with their pairs, over the views of the provided tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovekit.operators import collections as C
from grovekit.operators import density as D
from grovekit.operators import exemplars as E
from grovekit.operators import matching as M
from grovekit.operators import neighbours as N
from grovekit.operators import paths as P
from grovekit.operators import sketches as S
from grovekit.operators import subtrees as U
from grovekit.operators import trees as T
from grovekit.operators.weights import KeyedWeight, label_keys, node_matches
from grovekit.registry import _ANC, _BAGS, _CHAIN, _HEAVIEST, _KEYS, _SCALED, _TOP, _URL, _heaviest, _neighbours, _pairs_sql, _tokens, _url_keys, _url_scores, _walk, query
from grovekit.sources import edges as G
from grovekit.sources.views import sql, view


def _index(spark, d, name):
    return T.tree_index(view(spark, d, name))


@query(_TOP + ", p AS (SELECT DISTINCT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 5) SELECT p.g, p.h, scores.score, true AS nested FROM p JOIN scores USING (g, h)")
def path_matches(spark, d):
    """The pairs' own weights add up to the best score, and each pair is below the one before."""
    nodes = view(spark, d, "url_tree")
    return P.checked(P.path_matches(_neighbours(spark, d), nodes), nodes, _index(spark, d, "url_tree"))


_SPARSE = f"""WITH RECURSIVE {_walk('url_tree')}, {_ANC}, {_KEYS}, q AS (SELECT DISTINCT r.g, r.h, r.u, k.u AS v FROM r JOIN k ON k.tree_id = r.h AND k.key = r.key),
m AS (SELECT q.g, q.h, q.u, q.v, CAST(1 + length(k.key) % 3 AS DOUBLE) AS w FROM q JOIN k ON k.tree_id = q.g AND k.u = q.u),
{_CHAIN} SELECT g, h, max(s) AS score, true AS nested FROM c GROUP BY g, h"""


def _lengths(spark, d):
    """A label's weight: 1 + its length modulo 3."""
    nodes = view(spark, d, "url_tree")
    return KeyedWeight(label_keys, nodes.select(F.col("label").alias("key"), (1.0 + F.length("label") % 3).alias("value")).distinct())


@query(_SPARSE)
def sparse_path_matches(spark, d):
    """All nodes that share a label are candidates."""
    nodes, weight = view(spark, d, "url_tree"), _lengths(spark, d)
    _, pairs = _url_keys(spark, d)
    found = P.sparse_matches(node_matches(weight.keys(nodes), pairs), _index(spark, d, "url_tree"))
    return P.checked(found, nodes, _index(spark, d, "url_tree"), weight)


@query(_SPARSE.replace("AND k.key = r.key)", "AND k.key = r.key WHERE place <= 4)"))
def beam_path_matches(spark, d):
    """A beam that is wide enough finds the best score of all pairs of trees that share a label, and its pairs are worth it."""
    nodes, weight = view(spark, d, "url_tree"), _lengths(spark, d)
    keys, pairs = _url_keys(spark, d)
    labelled = S.labelled_index(_index(spark, d, "url_tree"), nodes)
    sketches = [(S.lookahead_sketches(labelled), 1.0)]
    beam = P.Beam(width=10_000, expansion=None)
    found = P.beam_matches(node_matches(weight.keys(nodes), pairs), labelled, beam, sketches, weight.values)
    return P.checked(found, nodes, _index(spark, d, "url_tree"), weight)


@query("WITH RECURSIVE " + _walk("trade_tree") + ", " + _ANC + """, l AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, label FROM {trade_tree}),
 x AS (SELECT anc.tree_id, anc.anc AS u, l.label, pow(0.85, anc.dist - 1) AS m FROM anc JOIN l ON l.tree_id = anc.tree_id AND l.u = anc.u
  UNION ALL SELECT w.tree_id, -1, l.label, pow(0.85, w.depth) FROM w JOIN l ON l.tree_id = w.tree_id AND l.u = w.u)
 SELECT tree_id, CAST(u AS INT) AS u, label, round(sum(m), 6) AS mass FROM x GROUP BY ALL""")
def lookahead_sketches(spark, d):
    """With room for all labels a sketch is the discounted number of each label below a node."""
    sketches = S.lookahead_sketches(view(spark, d, "trade_tree"), size=1000)
    return sketches.select("tree_id", "u", F.col("token")[0].alias("label"), F.round("mass", 6).alias("mass"))


@query("WITH RECURSIVE " + _walk("url_tree") + ", " + _ANC + """, l AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, parent, label FROM {url_tree}),
 r AS (SELECT b.tree_id, a.u AS first, a.label || '>' || b.label AS run FROM l b JOIN l a ON a.tree_id = b.tree_id AND a.u = b.parent),
 x AS (SELECT anc.tree_id, anc.anc AS u, r.run, pow(0.5, anc.dist - 1) AS m FROM anc JOIN r ON r.tree_id = anc.tree_id AND r.first = anc.u
  UNION ALL SELECT w.tree_id, -1, r.run, pow(0.5, w.depth) FROM w JOIN r ON r.tree_id = w.tree_id AND r.first = w.u)
 SELECT tree_id, CAST(u AS INT) AS u, run, round(sum(m), 6) AS mass FROM x GROUP BY ALL""")
def lookahead_runs(spark, d):
    """The same of downward runs of two labels."""
    sketches = S.lookahead_sketches(view(spark, d, "url_tree"), size=None, discount=0.5, run_length=2)
    return sketches.select("tree_id", "u", F.array_join("token", ">").alias("run"), F.round("mass", 6).alias("mass"))


_FLAT = "f AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, label FROM {url_tree} WHERE parent < 1), "
_BEST = _TOP + ", p AS (SELECT DISTINCT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 5), " + _FLAT
#: What a root may weigh on its own: equal labels of the two roots, or of a root and a child of the other one.
_ALONE = """alone AS (SELECT p.g, p.h, CAST(max(CASE WHEN a.label = b.label AND (a.u = 0 OR b.u = 0) THEN 1 ELSE 0 END) AS DOUBLE) AS one,
  CAST(max(CASE WHEN a.label = b.label AND a.u = 0 AND b.u = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS roots FROM p JOIN f a ON a.tree_id = p.g JOIN f b ON b.tree_id = p.h GROUP BY ALL)"""


def _flat(spark, d):
    """Hosts and the first parts of their paths: trees of height 1."""
    return view(spark, d, "url_tree").where("parent < 1")


@query(_BEST + _ALONE + """, eq AS (SELECT p.g, p.h, a.u, b.u AS v FROM p JOIN f a ON a.tree_id = p.g JOIN f b ON b.tree_id = p.h AND b.label = a.label WHERE a.u > 0 AND b.u > 0),
 runs(g, h, u, v, len) AS (SELECT g, h, u, v, 1 FROM eq UNION SELECT eq.g, eq.h, eq.u, eq.v, runs.len + 1 FROM runs JOIN eq ON eq.g = runs.g AND eq.h = runs.h AND eq.u > runs.u AND eq.v > runs.v),
 longest AS (SELECT g, h, max(len) AS len FROM runs GROUP BY g, h)
 SELECT alone.g, alone.h, CAST(greatest(one, roots + coalesce(len, 0)) AS DOUBLE) AS score FROM alone LEFT JOIN longest USING (g, h)""")
def subtree_ordered_flat(spark, d):
    """On trees of height 1 an ordered match is a common subsequence of the children."""
    return U.subtree_matches(_neighbours(spark, d), _flat(spark, d)).select("g", "h", "score")


@query(_BEST + _ALONE + """, kinds AS (SELECT tree_id, label, count(*) AS cnt FROM f WHERE u > 0 GROUP BY ALL),
 common AS (SELECT p.g, p.h, sum(least(a.cnt, b.cnt)) AS cnt FROM p JOIN kinds a ON a.tree_id = p.g JOIN kinds b ON b.tree_id = p.h AND b.label = a.label GROUP BY ALL)
 SELECT alone.g, alone.h, CAST(greatest(one, roots + coalesce(cnt, 0)) AS DOUBLE) AS score FROM alone LEFT JOIN common USING (g, h)""")
def subtree_unordered_flat(spark, d):
    """On trees of height 1 an unordered match is what the children's labels have in common, with their numbers."""
    return U.subtree_matches(_neighbours(spark, d), _flat(spark, d), ordered=False).select("g", "h", "score")


@query(_pairs_sql("conv_chain", "1").replace("k AS (", "k AS MATERIALIZED (") + "SELECT g, h, score FROM scores")
def subtree_chains(spark, d):
    """On chains a subtree match is a path match."""
    return U.all_pair_subtrees(view(spark, d, "conv_chain"))


@query(_TOP + """, p AS (SELECT DISTINCT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 5) SELECT p.g, p.h, true AS worth, true AS kept FROM p""")
def subtree_pairs(spark, d):
    """The pairs of a match add up to its score, and what lies below on one side lies below on the other."""
    nodes = view(spark, d, "url_tree")
    found = U.subtree_matches(_neighbours(spark, d), nodes, ordered=False)
    steps = found.select("g", "h", "score", F.explode_outer("pairs").alias("p")).select("g", "h", "score", F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    labels = nodes.select(F.col("tree_id").cast("string").alias("t"), F.col("u").alias("n"), "label")
    worth = P.placed(steps, _index(spark, d, "url_tree")).join(labels.select(F.col("t").alias("g"), F.col("n").alias("u"), F.col("label").alias("a")), ["g", "u"]).join(labels.select(F.col("t").alias("h"), F.col("n").alias("v"), F.col("label").alias("b")), ["h", "v"])
    other = worth.select("g", "h", *[F.col(c).alias(f"o_{c}") for c in ("tin_u", "tout_u", "tin_v", "tout_v")])
    below = lambda s: (F.col(f"o_tin_{s}") > F.col(f"tin_{s}")) & (F.col(f"o_tin_{s}") < F.col(f"tout_{s}"))
    nests = worth.join(other, ["g", "h"]).groupBy("g", "h").agg(F.min(below("u") == below("v")).alias("kept"))
    sums = worth.groupBy("g", "h").agg((F.sum((F.col("a") == F.col("b")).cast("double")) == F.first("score")).alias("worth"))
    return found.select("g", "h", "score").join(sums, ["g", "h"], "left").join(nests, ["g", "h"], "left").select("g", "h", F.coalesce("worth", F.col("score") == 0).alias("worth"), F.coalesce("kept", F.lit(True)).alias("kept"))


#: Token shares of event trees, their cosines, and a recursive choice of the farthest tree, unrolled.
_COSINES = """f AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, token, CAST(count(*) AS DOUBLE) AS value FROM {event_tokens} GROUP BY ALL),
 l AS (SELECT tree_id, sqrt(sum(value * value)) AS len FROM f GROUP BY tree_id), x AS (SELECT tree_id, token, value / len AS value FROM f JOIN l USING (tree_id))"""


def _event_features(spark, d):
    return N.tree_features(view(spark, d, "event_tokens"))


@query(f"WITH {_COSINES}, c AS (SELECT a.tree_id AS g, b.tree_id AS h, round(sum(a.value * b.value), 9) AS cosine FROM x a JOIN x b USING (token) WHERE a.tree_id <> b.tree_id GROUP BY ALL), "
       "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY cosine DESC, h) AS INT) AS rank FROM c) SELECT g, h, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 10")  # fmt: skip
def nearest_trees(spark, d):
    return N.nearest_trees(_event_features(spark, d), k=10).withColumn("cosine", F.round("cosine", 6))


@query("SELECT CAST(tree_id AS VARCHAR) AS tree_id, token AS dim, CAST(1.0 AS DOUBLE) AS value FROM {event_tokens} GROUP BY ALL")
def tree_features(spark, d):
    return N.tree_features(view(spark, d, "event_tokens"), binary=True, normalised=False)


def _spread_sql(n: int) -> str:
    steps = ["p1 AS (SELECT min(tree_id) AS tree_id FROM l)", "d1 AS (SELECT l.tree_id, round(2 - 2 * coalesce(sum(a.value * b.value), 0), 9) AS far FROM l LEFT JOIN x a ON a.tree_id = l.tree_id LEFT JOIN x b ON b.token = a.token AND b.tree_id = (SELECT tree_id FROM p1) GROUP BY l.tree_id)"]
    for i in range(2, n + 1):
        gone = " UNION ALL ".join(f"SELECT tree_id FROM p{j}" for j in range(1, i))
        steps.append(f"p{i} AS (SELECT tree_id FROM d{i - 1} WHERE tree_id NOT IN ({gone}) ORDER BY far DESC, tree_id LIMIT 1)")
        steps.append(f"e{i} AS (SELECT l.tree_id, round(2 - 2 * coalesce(sum(a.value * b.value), 0), 9) AS far FROM l LEFT JOIN x a ON a.tree_id = l.tree_id LEFT JOIN x b ON b.token = a.token AND b.tree_id = (SELECT tree_id FROM p{i}) GROUP BY l.tree_id)")
        steps.append(f"d{i} AS (SELECT tree_id, least(d{i - 1}.far, e{i}.far) AS far FROM d{i - 1} JOIN e{i} USING (tree_id))")
    return f"WITH {_COSINES}, " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT tree_id, {i} AS place FROM p{i}" for i in range(1, n + 1))


@query(_spread_sql(6))
def landmarks_spread(spark, d):
    return N.landmarks(_event_features(spark, d), n=6, seed=None)


_SELF = "best AS (SELECT tree_id, max(s) AS s FROM (SELECT w.tree_id, w.u, sum(1 + length(t.label) % 3) AS s FROM w JOIN t ON t.tree_id = w.tree_id AND list_contains(w.p, t.u) GROUP BY ALL) GROUP BY tree_id)"


@query("WITH RECURSIVE " + _walk("url_tree") + ", t AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, label FROM {url_tree}), " + _SELF + " SELECT tree_id, CAST(s AS DOUBLE) AS score FROM best")
def self_scores_weighted(spark, d):
    return M.self_scores(view(spark, d, "url_tree"), _lengths(spark, d))


@query(_URL + ", own AS (SELECT tree_id, CAST(max(depth) + 1 AS DOUBLE) AS s FROM w GROUP BY tree_id), two AS (SELECT g, h, score FROM scores UNION ALL SELECT h, g, score FROM scores UNION ALL SELECT tree_id, tree_id, s FROM own), "
       "chosen AS (SELECT tree_id FROM own ORDER BY tree_id LIMIT 8) SELECT two.g, two.h, round(score / sqrt(a.s * b.s), 6) AS similarity FROM two JOIN chosen c ON c.tree_id = two.h JOIN own a ON a.tree_id = two.g JOIN own b ON b.tree_id = two.h")  # fmt: skip
def landmark_features(spark, d):
    """Path scores with landmarks, scaled by the self-scores of both."""
    nodes = view(spark, d, "url_tree")
    ids = nodes.select(F.col("tree_id").cast("string").alias("tree_id")).distinct().orderBy("tree_id").limit(8)
    return M.landmark_features(nodes, ids).withColumn("similarity", F.round("similarity", 6))


# --- edge lists: the trees of hosts with their nodes numbered backwards, and faults in some of them -------------------
_EDGES = "SELECT tree_id, 100 - parent AS src, 100 - u AS dst FROM {url_tree} WHERE parent >= 0"
_FAULTY = """SELECT tree_id, 100 - parent AS src, 100 - u AS dst FROM {url_tree} WHERE parent >= 0 AND NOT (length(tree_id) % 7 = 4 AND u = 1)
 UNION ALL SELECT tree_id, 100 AS src, 100 AS dst FROM {url_tree} WHERE u = 0 AND length(tree_id) % 7 = 1
 UNION ALL SELECT tree_id, 99 AS src, 98 AS dst FROM {url_tree} WHERE u = 2 AND length(tree_id) % 7 = 2
 UNION ALL SELECT tree_id, 99 AS src, 100 AS dst FROM {url_tree} WHERE u = 1 AND length(tree_id) % 7 = 3
 UNION ALL SELECT tree_id, 100 AS src, 999 AS dst FROM {url_tree} WHERE u = 0 AND length(tree_id) % 7 = 5"""
_NODES = "SELECT tree_id, 100 - u AS id, label FROM {url_tree}"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), n AS ({_NODES}),
 w AS (SELECT tree_id, id, [id] AS p, 0 AS depth FROM n WHERE id = 100 UNION ALL SELECT e.tree_id, e.dst, list_append(w.p, e.dst), w.depth + 1 FROM w JOIN e ON e.tree_id = w.tree_id AND e.src = w.id),
 x AS (SELECT tree_id, id, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY p) - 1 AS INT) AS u FROM w)
 SELECT n.tree_id, CAST(n.id AS INT) AS orig, x.u, coalesce(y.u, -1) AS parent, n.label FROM n JOIN x USING (tree_id, id) LEFT JOIN e ON e.tree_id = n.tree_id AND e.dst = n.id LEFT JOIN x y ON y.tree_id = e.tree_id AND y.id = e.src""")
def edge_list_trees(spark, d):
    found = G.trees_from_edges(sql(spark, d, _NODES), sql(spark, d, _EDGES))
    return found.select("tree_id", F.col("orig").cast("int").alias("orig"), "u", "parent", "label")


@query(f"""WITH RECURSIVE raw AS ({_FAULTY}), n AS ({_NODES}), k AS (SELECT raw.*, a.id IS NOT NULL AND b.id IS NOT NULL AS known FROM raw LEFT JOIN n a ON a.tree_id = raw.tree_id AND a.id = src LEFT JOIN n b ON b.tree_id = raw.tree_id AND b.id = dst),
 up AS (SELECT tree_id, dst AS id, min(src) AS parent, count(DISTINCT src) AS c FROM k WHERE known AND src <> dst GROUP BY ALL),
 r AS (SELECT n.tree_id, n.id FROM n LEFT JOIN up USING (tree_id, id) WHERE parent IS NULL), w AS (SELECT * FROM r UNION SELECT up.tree_id, up.id FROM w JOIN up ON up.tree_id = w.tree_id AND up.parent = w.id),
 c AS (SELECT tree_id, count(*) AS n, (SELECT count(*) FROM r WHERE r.tree_id = n.tree_id) AS roots, count(*) - (SELECT count(*) FROM w WHERE w.tree_id = n.tree_id) AS unreachable,
   (SELECT count(*) FROM up WHERE up.tree_id = n.tree_id AND c > 1) AS many_parents, (SELECT count(*) FROM k WHERE k.tree_id = n.tree_id AND NOT known) AS unknown_nodes, (SELECT count(*) FROM k WHERE k.tree_id = n.tree_id AND known AND src = dst) AS self_loops FROM n GROUP BY tree_id)
 SELECT tree_id, n, unknown_nodes, self_loops, many_parents, roots, unreachable FROM c""")
def edge_issues(spark, d):
    return G.edge_issues(sql(spark, d, _NODES), sql(spark, d, _FAULTY))


# --- bags of what matched ----------------------------------------------------------------------------------------------
@query(_TOP + """, p AS (SELECT DISTINCT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 5), size AS (SELECT tree_id, count(*) % 2 AS cluster FROM t GROUP BY tree_id),
 ms AS (SELECT p.g, p.h, a.cluster, scores.score FROM p JOIN scores USING (g, h) JOIN size a ON a.tree_id = p.g JOIN size b ON b.tree_id = p.h WHERE a.cluster = b.cluster AND scores.score > 0),
 obs AS (SELECT cluster, g AS source, score FROM ms UNION ALL SELECT cluster, h, score FROM ms), ow AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY cluster, source) AS weight FROM obs)
 SELECT cluster, count(*) AS n_observations, count(DISTINCT source) AS n_sources, round(sum(weight), 5) AS total_weight, round(sum(score * weight) / sum(weight), 5) AS mean_length FROM ow GROUP BY cluster""")
def matched_bags(spark, d):
    """Trees with as many nodes modulo 2 are a cluster; what two of them have in common is a sequence of labels from each."""
    nodes = view(spark, d, "url_tree")
    clusters = nodes.groupBy(F.col("tree_id").cast("string").alias("tree_id")).agg((F.count("*") % 2).alias("cluster"))
    observed = E.matched_sequences(P.path_matches(_neighbours(spark, d), nodes), nodes, clusters)
    bags = C.sequence_bags(observed)
    sources = observed.groupBy("cluster").agg(F.countDistinct("source").alias("n_sources"))
    sums = bags.groupBy("cluster").agg(F.sum("cnt").alias("n_observations"), F.round(F.sum("weight"), 5).alias("total_weight"), F.round(F.sum(F.size("seq") * F.col("weight")) / F.sum("weight"), 5).alias("mean_length"))
    return sums.join(sources, "cluster").select("cluster", "n_observations", "n_sources", "total_weight", "mean_length")


# --- clusters by density -----------------------------------------------------------------------------------------------
_REACH = _SCALED + """, dist AS (SELECT g, h, round(sqrt(greatest(0.0, 1 - s / sqrt(i * j))), 6) AS distance FROM n), sides AS (SELECT g AS tree_id, h AS other, distance FROM dist UNION ALL SELECT h, g, distance FROM dist),
 core AS (SELECT tree_id, distance AS core FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY distance, other) AS place FROM sides) WHERE place = 4),
 reach AS (SELECT dist.g, dist.h, greatest(distance, x.core, y.core) AS w FROM dist JOIN core x ON x.tree_id = dist.g JOIN core y ON y.tree_id = dist.h)"""


def _reach(spark, d):
    similar = C.normalised(_url_scores(spark, d), "cosine")
    return D.mutual_reachability(C.distance(similar).withColumn("distance", F.round("distance", 6)), 4)


@query(_REACH + " SELECT g, h, w FROM reach")
def mutual_reachability(spark, d):
    return _reach(spark, d)


@query(_REACH + """, short AS (SELECT g AS a, h AS b FROM reach WHERE w <= 0.6 UNION ALL SELECT h, g FROM reach WHERE w <= 0.6),
 walked AS (SELECT tree_id, tree_id AS c FROM own_ids UNION SELECT short.b, walked.c FROM walked JOIN short ON short.a = walked.tree_id),
 named AS (SELECT tree_id, min(c) AS name FROM walked GROUP BY tree_id), sized AS (SELECT name, count(*) AS cnt FROM named GROUP BY name)
 SELECT tree_id, CASE WHEN cnt >= 3 THEN name END AS cluster FROM named JOIN sized USING (name)""".replace("FROM own_ids", "FROM (SELECT DISTINCT tree_id FROM t)"))
def density_clusters(spark, d):
    """Cutting the spanning tree gives the components of the whole graph of short reachabilities."""
    trees = view(spark, d, "url_tree").select(F.col("tree_id").cast("string").alias("tree_id"))
    return D.density_clusters(trees, D.spanning_tree(_reach(spark, d)), at=0.6, least=3)


# --- reports -------------------------------------------------------------------------------------------------------------
@query(_TOP + """, p AS (SELECT DISTINCT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 2), cls AS (SELECT tree_id, count(*) % 3 AS label FROM t GROUP BY tree_id), ends AS (SELECT g AS tree_id, h AS other FROM p UNION ALL SELECT h, g FROM p),
 deg AS (SELECT cls.tree_id, count(ends.other) AS d FROM cls LEFT JOIN ends USING (tree_id) GROUP BY cls.tree_id), cl AS (SELECT avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS same, sum(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS held FROM p JOIN cls a ON a.tree_id = p.g JOIN cls b ON b.tree_id = p.h),
 tot AS (SELECT sum(cnt * (cnt - 1) / 2) AS total FROM (SELECT count(*) AS cnt FROM cls GROUP BY label)), hit AS (SELECT r.g, avg(CASE WHEN ends.other IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM r LEFT JOIN ends ON ends.tree_id = r.g AND ends.other = r.h WHERE r.rank <= 5 GROUP BY r.g)
 SELECT count(*) AS n_points, CAST(sum(d) / 2 AS BIGINT) AS n_candidate_pairs, round(avg(d), 6) AS avg_degree, min(d) AS min_degree, max(d) AS max_degree, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS isolated_fraction,
  round((SELECT same FROM cl), 6) AS same_class_fraction, round((SELECT held FROM cl) / (SELECT total FROM tot), 6) AS same_class_pair_recall, round((SELECT avg(score) FROM scores), 6) AS mean_exact_sim_all_pairs,
  round((SELECT avg(score) FROM scores JOIN p USING (g, h)), 6) AS mean_exact_sim_candidates, round((SELECT avg(share) FROM hit), 6) AS topk_recall FROM deg""")
def candidate_report(spark, d):
    nodes, scores = view(spark, d, "url_tree"), _url_scores(spark, d)
    classes = nodes.groupBy("tree_id").agg((F.count("*") % 3).alias("label"))
    row = C.candidate_report(C.candidate_pairs(C.top_matches(scores, 2)), nodes, classes, scores, k=5)
    return row.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes])


_TRUTHS = ", tr AS (SELECT cluster, min(seq) || 'X' AS truth FROM b GROUP BY cluster)"


def _truths(bags):
    """No observation is the truth: the smallest sequence and a letter that none has."""
    return bags.groupBy("cluster").agg(F.concat(F.min("seq"), F.array(F.lit("X"))).alias("truth"))


@query(_BAGS + _TRUTHS + """, raws AS (SELECT cluster, median(length(seq)) AS m FROM s GROUP BY cluster)
 SELECT cluster, count(*) AS n_unique, CAST(sum(cnt) AS BIGINT) AS n_observations, round(sum(weight), 5) AS total_weight, round(1 - count(*) / sum(cnt), 6) AS duplicate_fraction, round(sum(length(seq) * weight) / sum(weight), 5) AS mean_length,
  CAST(min(length(seq)) AS INT) AS min_length, CAST(max(length(seq)) AS INT) AS max_length, CAST(max(m) AS DOUBLE) AS median_length, bool_or(seq = truth) AS truth_present, CAST(min(levenshtein(seq, truth)) AS INT) AS best_edit,
  round(min(levenshtein(seq, truth) / greatest(length(seq), length(truth))), 6) AS best_normalized_edit FROM b JOIN tr USING (cluster) JOIN raws USING (cluster) GROUP BY cluster""")
def bag_report(spark, d):
    bags = _tokens(spark, d)
    found = E.bag_report(bags, _truths(bags))
    return found.select("cluster", *[F.round(c, 5 if c in ("total_weight", "mean_length") else 6).alias(c) if kind == "double" and c != "median_length" else F.col(c) for c, kind in found.dtypes if c != "cluster"])


@query(_HEAVIEST + _TRUTHS + """ SELECT cluster, CAST(length(exemplar) AS INT) AS length, CAST(max(levenshtein(exemplar, truth)) AS INT) AS edit_to_truth, round(max(levenshtein(exemplar, truth) / greatest(length(exemplar), length(truth))), 6) AS norm_edit_to_truth,
  round(max(length(exemplar) / length(truth)), 6) AS length_ratio_to_truth, round(sum(weight * levenshtein(seq, exemplar)) / sum(weight), 5) AS within_mean_edit,
  round(sum(weight * levenshtein(seq, exemplar) / greatest(length(seq), length(exemplar))) / sum(weight), 5) AS within_mean_norm_edit FROM x JOIN tr USING (cluster) JOIN b USING (cluster) GROUP BY cluster, exemplar""")
def exemplar_report(spark, d):
    bags = _tokens(spark, d)
    found = E.exemplar_report(_heaviest(bags).select("cluster", F.col("exemplar").alias("seq")), bags, _truths(bags))
    return found.select("cluster", "length", "edit_to_truth", *[F.round(c, 6).alias(c) for c in ("norm_edit_to_truth", "length_ratio_to_truth")], *[F.round(c, 5).alias(c) for c in ("within_mean_edit", "within_mean_norm_edit")])
