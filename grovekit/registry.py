"""The engine's queries over the provided tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import kernels
from grovekit.operators import collections as C
from grovekit.operators import exemplars as E
from grovekit.operators import matching as M
from grovekit.operators import trees as T
from grovekit.operators.weights import KeyedWeight
from grovekit.sources.views import VIEWS, duckdb_sql, read, sql, view

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = duckdb_sql(oracle)
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


for _name, _text in VIEWS.items():
    if _name != "trade_tree":
        _QUERIES[f"view_{_name}"] = lambda s, d, n=_name: view(s, d, n)
        _SQL[f"view_{_name}"] = duckdb_sql(_text)

# --- SQL parts that several oracles share -------------------------------------------------------
#: depth and root path (as text that sorts like the path) of every node of a view.
_WALK = """w AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, parent, 0 AS depth, [u] AS p FROM {V} WHERE parent = -1
  UNION ALL SELECT CAST(t.tree_id AS VARCHAR), t.u, t.parent, w.depth + 1, list_append(w.p, t.u) FROM {V} t JOIN w ON w.tree_id = CAST(t.tree_id AS VARCHAR) AND t.parent = w.u)"""
_ANC = "anc AS (SELECT a.tree_id, a.u AS anc, b.u AS u, b.depth - a.depth AS dist FROM w a JOIN w b ON a.tree_id = b.tree_id AND a.depth < b.depth AND b.p[a.depth + 1] = a.u)"
#: all chains of matched pairs m(g, h, u, v, w): the largest total is the score.
_CHAIN = """c AS (SELECT g, h, u, v, w AS s FROM m UNION
  SELECT m.g, m.h, m.u, m.v, c.s + m.w FROM c JOIN anc x ON x.tree_id = c.g AND x.anc = c.u JOIN m ON m.g = c.g AND m.h = c.h AND m.u = x.u JOIN anc y ON y.tree_id = c.h AND y.anc = c.v AND y.u = m.v)"""


def _walk(name: str) -> str:
    return _WALK.replace("{V}", f"{{{name}}}")


def _pairs_sql(name: str, weight: str) -> str:
    return f"""WITH RECURSIVE {_walk(name)}, {_ANC},
t AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, label FROM {{{name}}}),
k AS (SELECT label, {weight} AS w FROM t GROUP BY label),
m AS (SELECT a.tree_id AS g, b.tree_id AS h, a.u AS u, b.u AS v, CAST(k.w AS DOUBLE) AS w FROM t a JOIN t b ON a.label = b.label AND a.tree_id < b.tree_id JOIN k ON k.label = a.label),
{_CHAIN}, s AS (SELECT g, h, max(s) AS score FROM c GROUP BY g, h), i AS (SELECT DISTINCT tree_id FROM t),
scores AS (SELECT a.tree_id AS g, b.tree_id AS h, coalesce(s.score, 0.0) AS score FROM i a JOIN i b ON a.tree_id < b.tree_id LEFT JOIN s ON s.g = a.tree_id AND s.h = b.tree_id)
"""


_URL = _pairs_sql("url_tree", "1")
_SCALED = _URL + """, two AS (SELECT g, h, score FROM scores UNION ALL SELECT h, g, score FROM scores),
z AS (SELECT g AS tree_id, greatest(max(score), 1e-12) AS scale FROM two GROUP BY g), n AS (SELECT s.g, s.h, s.score AS s, a.scale AS i, b.scale AS j FROM scores s JOIN z a ON a.tree_id = s.g JOIN z b ON b.tree_id = s.h)
"""


def _url_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.all_pair_scores(view(spark, d, "url_tree"))


# --- trees -------------------------------------------------------------------------------------
@query("""SELECT t.tree_id, count(*) AS n, count(*) FILTER (WHERE t.parent = -1) AS roots, count(*) FILTER (WHERE t.parent >= t.u) AS late_parents,
  count(*) FILTER (WHERE t.parent >= 0 AND p.u IS NULL) AS lost_parents, count(t.u) - count(DISTINCT t.u) AS repeated
  FROM {trade_tree} t LEFT JOIN (SELECT DISTINCT tree_id, u FROM {trade_tree}) p ON p.tree_id = t.tree_id AND p.u = t.parent GROUP BY t.tree_id""")
def tree_validate(spark, d):
    return T.validate(view(spark, d, "trade_tree"))


@query("WITH RECURSIVE " + _walk("trade_tree") + """, z AS (SELECT tree_id, u, parent, depth, p FROM w),
 i AS (SELECT a.tree_id, a.u, a.parent, a.depth, a.p, max(b.depth) - a.depth AS height, count(*) AS size FROM z a JOIN z b ON a.tree_id = b.tree_id AND b.depth >= a.depth AND b.p[a.depth + 1] = a.u GROUP BY a.tree_id, a.u, a.parent, a.depth, a.p)
 SELECT tree_id, CAST(u AS INT) AS u, CAST(parent AS INT) AS parent, CAST(depth AS INT) AS depth, CAST(height AS INT) AS height, CAST(size AS INT) AS size,
  CAST(row_number() OVER (PARTITION BY tree_id ORDER BY p) - 1 AS INT) AS tin, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY p) - 1 + size AS INT) AS tout FROM i""")
def tree_index(spark, d):
    return T.tree_index(view(spark, d, "trade_tree"))


@query("WITH RECURSIVE " + _walk("url_tree") + ", " + _ANC + " SELECT tree_id, CAST(anc AS INT) AS anc, CAST(u AS INT) AS u, CAST(dist AS INT) AS dist FROM anc")
def tree_ancestors(spark, d):
    return T.ancestors(T.tree_index(view(spark, d, "url_tree")))


@query("WITH RECURSIVE " + _walk("event_tree") + ", " + _ANC + """ , l AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, label FROM {event_tree}),
 q AS (SELECT tree_id, anc, u, dist FROM anc UNION ALL SELECT tree_id, u, u, 0 FROM w)
 SELECT q.tree_id, CAST(q.anc AS INT) AS u, l.label, round(sum(pow(2.0, q.dist)), 3) AS mass FROM q JOIN l ON l.tree_id = q.tree_id AND l.u = q.u GROUP BY ALL""")
def exponential_count(spark, d):
    return T.exponential_count(view(spark, d, "event_tree")).withColumn("mass", F.round("mass", 3))


@query("""SELECT t.tree_id, coalesce(bool_and(p.ts <= t.ts) FILTER (WHERE t.parent >= 0), true) AS consistent FROM {trade_tree} t LEFT JOIN {trade_tree} p ON p.tree_id = t.tree_id AND p.u = t.parent GROUP BY t.tree_id""")
def timestamps_consistent(spark, d):
    return T.timestamps_consistent(view(spark, d, "trade_tree"))


# --- labels and keys ---------------------------------------------------------------------------
@query("SELECT label, count(*) AS cnt FROM {trade_tree} GROUP BY label")
def label_counts(spark, d):
    return C.label_counts(view(spark, d, "trade_tree"))


@query("SELECT label, round(1 / greatest(count(*) / sum(count(*)) OVER (), 1e-8), 6) AS weight FROM {trade_tree} GROUP BY label")
def inverse_frequency_weights(spark, d):
    return C.inverse_frequency(view(spark, d, "trade_tree")).withColumn("weight", F.round("weight", 6))


@query("SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS token_id, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT DISTINCT token FROM {event_tokens})")
def token_dictionary(spark, d):
    return C.token_dictionary(view(spark, d, "event_tokens"))


@query("SELECT token, count(*) AS cnt, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS INT) AS token_id FROM {event_tokens} GROUP BY token")
def token_vocabulary(spark, d):
    return C.token_vocabulary(view(spark, d, "event_tokens"))


@query("""WITH x AS (SELECT tree_id, u, list_filter(CASE WHEN instr(label, '/') > 0 THEN string_split(label, '/') ELSE regexp_split_to_array(label, '\\s+') END, lambda t: t <> '') AS t FROM {url_tree})
  SELECT tree_id, u, unnest(list_transform(range(1, least(5, len(t)) + 1), lambda i: array_to_string(t[1:i], '/'))) AS key FROM x""")
def blocking_prefix_keys(spark, d):
    return C.blocking_prefix_keys(view(spark, d, "url_tree"))


_KEYS = """k AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, label AS key FROM {url_tree}), n AS (SELECT tree_id, key, count(*) AS n FROM k GROUP BY ALL),
 i AS (SELECT DISTINCT tree_id FROM k), pr AS (SELECT a.tree_id AS g, b.tree_id AS h FROM i a JOIN i b ON a.tree_id < b.tree_id),
 r AS (SELECT pr.g, pr.h, k.u, k.key, x.n + y.n AS cnt, CAST(row_number() OVER (PARTITION BY pr.g, pr.h, k.u ORDER BY x.n + y.n, k.key) AS INT) AS place
  FROM pr JOIN k ON k.tree_id = pr.g JOIN n x ON x.tree_id = pr.g AND x.key = k.key JOIN n y ON y.tree_id = pr.h AND y.key = k.key)"""


def _url_keys(spark, d):
    keys = view(spark, d, "url_tree").select("tree_id", "u", F.col("label").alias("key"))
    return keys, C.meeting_pairs(keys)


@query(f"WITH {_KEYS} SELECT g, h, u, key, cnt, place FROM r WHERE place <= 4")
def rarest_keys(spark, d):
    return C.rarest_keys(*_url_keys(spark, d))


@query(f"WITH {_KEYS} SELECT DISTINCT r.g, r.h, r.u, k.u AS v FROM r JOIN k ON k.tree_id = r.h AND k.key = r.key WHERE place <= 4")
def sparse_candidates(spark, d):
    return C.sparse_candidates(*_url_keys(spark, d))


# --- matching ----------------------------------------------------------------------------------
@query(_URL + "SELECT g, h, score FROM scores")
def path_score_equality(spark, d):
    return _url_scores(spark, d)


@query(_pairs_sql("url_tree", "1 + length(label) % 3") + "SELECT g, h, score FROM scores")
def path_score_weighted(spark, d):
    nodes = view(spark, d, "url_tree")
    values = nodes.select(F.col("label").alias("key"), (1.0 + F.length("label") % 3).alias("value")).distinct()
    return M.all_pair_scores(nodes, KeyedWeight(values=values))


@query(_pairs_sql("conv_chain", "1").replace("k AS (", "k AS MATERIALIZED (") + "SELECT g, h, score FROM scores")
def path_score_chains(spark, d):
    return M.all_pair_scores(view(spark, d, "conv_chain"))


@query()
def path_score_overlap(spark, d):
    nodes = view(spark, d, "event_tree")
    tokens = view(spark, d, "event_tokens").groupBy("tree_id", "u").agg(F.array_sort(F.collect_set("token")).alias("label"))
    return M.all_pair_scores(nodes.drop("label").join(tokens, ["tree_id", "u"]), overlap=True)


@query("WITH RECURSIVE w AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, 1 AS s FROM {trade_tree} WHERE parent = -1 UNION ALL SELECT w.tree_id, t.u, w.s + 1 FROM {trade_tree} t JOIN w ON w.tree_id = CAST(t.tree_id AS VARCHAR) AND t.parent = w.u) SELECT tree_id, CAST(max(s) AS DOUBLE) AS score FROM w GROUP BY tree_id")
def self_scores(spark, d):
    return M.self_scores(view(spark, d, "trade_tree"))


def _landmarks(spark, d, n=32):
    """The largest trees, by their numbers of nodes; only they are packed and sent."""
    nodes = view(spark, d, "event_tree")
    chosen = [r["tree_id"] for r in nodes.groupBy("tree_id").count().orderBy(F.desc("count"), F.col("tree_id").cast("string")).limit(n).collect()]
    return T.packed(nodes.where(F.col("tree_id").isin(chosen))).collect()


@query()
def landmark_scores(spark, d):
    return M.landmark_scores(view(spark, d, "event_tree"), [r.asDict() for r in _landmarks(spark, d)])


@query("""WITH t AS (SELECT CAST(tree_id AS VARCHAR) AS tree_id, u, label, CASE WHEN label = 'user' THEN 0 WHEN label = 'assistant' THEN 1 END AS j FROM {conv_chain}),
 s AS (SELECT a.tree_id, a.cut, count(*) AS n FROM (SELECT tree_id, u AS cut FROM t UNION ALL SELECT DISTINCT tree_id, -1 FROM t) a LEFT JOIN t ON t.tree_id = a.tree_id AND ((t.u <= a.cut AND t.j = 0) OR (t.u > a.cut AND t.j = 1)) WHERE t.u IS NOT NULL GROUP BY ALL)
 SELECT i.tree_id, CAST(coalesce(max(s.n), 0) AS DOUBLE) AS score FROM (SELECT DISTINCT tree_id FROM t) i LEFT JOIN s USING (tree_id) GROUP BY i.tree_id""")
def template_repeat_score(spark, d):
    return M.template_scores(view(spark, d, "conv_chain"), ["user", "assistant"])


def _neighbours(spark, d):
    return C.candidate_pairs(C.top_matches(_url_scores(spark, d), 5))


@query()
def path_pairs(spark, d):
    def best(g, h):
        a, b = g["label"], h["label"]
        keys = ([() if t is None else (t,) for t in side] for side in (a, b))
        score, pairs = M.best_path(g["parent"], h["parent"], *keys, lambda us, vs: M.label_weights([a[u] for u in us], [b[v] for v in vs], None))
        return score, ",".join(f"{u}:{v}" for u, v in pairs)

    return M.per_pair(_neighbours(spark, d), view(spark, d, "url_tree"), best, "g string, h string, score double, path string")


def _subtree(kernel):
    def score(g, h):
        keys = ([() if t is None else (t,) for t in side["label"]] for side in (g, h))
        (p, us), (q, vs) = M.shared_nodes(g["parent"], h["parent"], *keys, closed=True)  # what has nothing in common below it adds nothing
        return (kernel(p, q, M.label_weights([g["label"][u] for u in us], [h["label"][v] for v in vs], None)),)

    return score


@query()
def subtree_ordered(spark, d):
    return M.per_pair(_neighbours(spark, d), view(spark, d, "url_tree"), _subtree(kernels.ordered_subtree))


@query()
def subtree_unordered(spark, d):
    return M.per_pair(_neighbours(spark, d), view(spark, d, "url_tree"), _subtree(kernels.unordered_subtree))


@query()
def reference_match(spark, d):
    def score(g, h):
        import numpy as np

        reference = [t for t in h["label"]]
        return (kernels.weighted_reference(np.array(g["parent"]), [[(t, 0.0)] for t in g["label"]], reference, [1.0] * len(reference)),)

    return M.per_pair(_neighbours(spark, d), view(spark, d, "url_tree"), score)


# --- similarities ------------------------------------------------------------------------------
for _mode, _expr in (("cosine", "s / sqrt(i * j)"), ("jaccard", "s / greatest(i + j - s, 1e-12)"), ("dice", "2 * s / (i + j)"), ("overlap", "s / least(i, j)")):
    _QUERIES[f"similarity_{_mode}"] = lambda s, d, m=_mode: C.normalised(_url_scores(s, d), m).withColumn("similarity", F.round("similarity", 6))
    _SQL[f"similarity_{_mode}"] = duckdb_sql(_SCALED + f"SELECT g, h, round({_expr}, 6) AS similarity FROM n")


@query(_SCALED + "SELECT g, h, round(sqrt(greatest(0.0, 1 - s / greatest(i + j - s, 1e-12))), 6) AS distance FROM n")
def distance_sqrt(spark, d):
    return C.distance(C.normalised(_url_scores(spark, d), "jaccard")).withColumn("distance", F.round("distance", 6))


_TOP = _SCALED + ", r AS (SELECT g, h, score, CAST(row_number() OVER (PARTITION BY g ORDER BY score DESC, h) AS INT) AS rank FROM two)"


#: The labels of h in order are the reference; per node only its first fitting place from j on is tried.
_SQL["reference_match"] = duckdb_sql(_TOP + """, p AS (SELECT DISTINCT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 5),
 nxt AS (SELECT p.g, p.h, a.u, js.u AS j, min(ref.u) AS place FROM p JOIN t a ON a.tree_id = p.g JOIN t ref ON ref.tree_id = p.h AND (a.label = ref.label OR left(a.label, 1) = ref.label) JOIN t js ON js.tree_id = p.h AND ref.u >= js.u GROUP BY ALL),
 st AS (SELECT g, h, 0 AS u, 0 AS j, 0 AS got FROM p UNION
  SELECT st.g, st.h, below.u, CASE WHEN way.k = 0 THEN st.j ELSE nxt.place + 1 END, st.got + way.k FROM st CROSS JOIN (VALUES (0), (1)) way(k) JOIN w below ON below.tree_id = st.g AND below.parent = st.u
   LEFT JOIN nxt ON nxt.g = st.g AND nxt.h = st.h AND nxt.u = st.u AND nxt.j = st.j WHERE way.k = 0 OR nxt.place IS NOT NULL)
 SELECT st.g, st.h, CAST(max(got + CASE WHEN nxt.place IS NULL THEN 0 ELSE 1 END) AS DOUBLE) AS score FROM st LEFT JOIN nxt ON nxt.g = st.g AND nxt.h = st.h AND nxt.u = st.u AND nxt.j = st.j GROUP BY st.g, st.h""")


@query(_TOP + "SELECT g, h, score, rank FROM r WHERE rank <= 5")
def top_matches(spark, d):
    return C.top_matches(_url_scores(spark, d), 5)


@query(_TOP + "SELECT DISTINCT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 5")
def knn_candidates_union(spark, d):
    return C.candidate_pairs(C.top_matches(_url_scores(spark, d), 5))


@query(_TOP + "SELECT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 5 GROUP BY ALL HAVING count(*) = 2")
def knn_candidates_mutual(spark, d):
    return C.candidate_pairs(C.top_matches(_url_scores(spark, d), 5), "mutual")


@query(_TOP + """, p AS (SELECT DISTINCT least(g, h) AS g, greatest(g, h) AS h FROM r WHERE rank <= 5), e AS (SELECT g AS t FROM p UNION ALL SELECT h FROM p),
 q AS (SELECT i.tree_id, count(e.t) AS degree FROM i LEFT JOIN e ON e.t = i.tree_id GROUP BY i.tree_id)
 SELECT count(*) AS n_trees, CAST(sum(degree) / 2 AS BIGINT) AS n_pairs, avg(degree) AS mean_degree, max(degree) AS max_degree, count(*) FILTER (WHERE degree = 0) AS isolated FROM q""")
def candidate_diagnostics(spark, d):
    trees = view(spark, d, "url_tree").select(F.col("tree_id").cast("string").alias("tree_id"))
    return C.candidate_diagnostics(C.candidate_pairs(C.top_matches(_url_scores(spark, d), 5)), trees)


# --- sequences: the label letters of a user's events, by the user's most frequent type ------------
_SEQ = """e AS (SELECT user_id, upper(substr(event_type, 1, 1)) AS t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS n FROM {events}),
 top AS (SELECT user_id, t AS cluster FROM (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, t) AS r FROM e GROUP BY user_id, t) WHERE r = 1),
 s AS (SELECT e.user_id AS source, top.cluster, CAST((n - 1) / 8 AS INT) AS part, {agg} AS seq FROM e JOIN top ON top.user_id = e.user_id GROUP BY ALL)"""
_SEQ_DUCK = "WITH " + _SEQ.replace("CAST((n - 1) / 8 AS INT)", "(n - 1) // 8").replace("{agg}", "string_agg(t, '' ORDER BY n)")
_SEQ_SPARK = "WITH " + _SEQ.replace("CAST((n - 1) / 8 AS INT)", "(n - 1) DIV 8").replace("{agg}", "array_join(transform(array_sort(collect_list(struct(n, t))), x -> x.t), '')")
_BAGS = _SEQ_DUCK + ", b AS (SELECT cluster, seq, sum(w) AS weight, count(*) AS cnt FROM (SELECT cluster, seq, 1.0 / count(*) OVER (PARTITION BY cluster, source) AS w FROM s) GROUP BY ALL) "


def _bags(spark, d):
    return C.sequence_bags(sql(spark, d, _SEQ_SPARK + " SELECT cluster, source, seq FROM s"))


@query(_BAGS + "SELECT cluster, seq, round(weight, 6) AS weight, cnt FROM b")
def sequence_bags(spark, d):
    return _bags(spark, d).withColumn("weight", F.round("weight", 6))


@query(_BAGS + "SELECT cluster, count(*) AS n_unique, CAST(sum(cnt) AS BIGINT) AS n_observations, round(sum(weight), 5) AS total_weight, round(sum(length(seq) * weight) / sum(weight), 5) AS mean_length FROM b GROUP BY cluster")
def bag_summary(spark, d):
    bags = _bags(spark, d).withColumn("seq", F.array_join(F.filter(F.split("seq", ""), lambda c: c != ""), " "))
    return C.bag_summary(bags).withColumn("total_weight", F.round("total_weight", 5)).withColumn("mean_length", F.round("mean_length", 5))


@query(_BAGS + """, o AS (SELECT a.cluster, a.seq, round(sum(b.weight * levenshtein(a.seq, b.seq)), 6) AS objective FROM b a JOIN b ON a.cluster = b.cluster GROUP BY ALL)
 SELECT cluster, seq, round(objective, 3) AS objective FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY objective, seq) AS r FROM o) WHERE r = 1""")
def medoid_exemplar(spark, d):
    return C.medoids(_bags(spark, d)).withColumn("objective", F.round("objective", 3))


@query(_SEQ_DUCK + """, x AS (SELECT cluster, length(seq) AS len, unnest(range(length(seq))) AS pos, seq FROM s),
 c AS (SELECT cluster, CAST(len AS INT) AS len, CAST(pos AS INT) AS pos, substr(seq, CAST(pos + 1 AS BIGINT), 1) AS token, count(*) AS cnt FROM x GROUP BY ALL)
 SELECT cluster, len, pos, token, cnt FROM (SELECT *, row_number() OVER (PARTITION BY cluster, len, pos ORDER BY cnt DESC, token) AS r FROM c) WHERE r = 1""")
def positional_consensus(spark, d):
    tokens = sql(spark, d, _SEQ_SPARK + " SELECT cluster, CAST(length(seq) AS INT) AS len, CAST(x.pos AS INT) AS pos, x.token FROM s LATERAL VIEW posexplode(filter(split(seq, ''), c -> c <> '')) x AS pos, token")
    return C.positional_consensus(tokens)


@query(_BAGS + """, y AS (SELECT cluster, seq, round(96 * weight / sum(weight) OVER (PARTITION BY cluster), 9) AS raw FROM b),
 z AS (SELECT *, floor(raw) AS low, 96 - sum(floor(raw)) OVER (PARTITION BY cluster) AS spare, row_number() OVER (PARTITION BY cluster ORDER BY raw - floor(raw) DESC, seq) AS place FROM y)
 SELECT cluster, seq, CAST(greatest(1, low + CASE WHEN place <= spare THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM z""")
def replication_counts(spark, d):
    return C.replication_counts(_bags(spark, d))


# --- exemplars of bags: the heaviest sequence of a cluster, and what alignments and likelihoods make of it -------------
_HEAVIEST = _BAGS + ", x AS (SELECT cluster, seq AS exemplar FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, seq) AS r FROM b) WHERE r = 1)"
_DISTANCE, _LONGEST = "levenshtein(seq, exemplar)", "greatest(length(seq), length(exemplar))"


def _heaviest(bags: DataFrame) -> DataFrame:
    return bags.groupBy("cluster").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "seq")).alias("x")).select("cluster", F.col("x.seq").alias("exemplar"))


def _tokens(spark, d) -> DataFrame:
    return _bags(spark, d).withColumn("seq", F.filter(F.split("seq", ""), lambda c: c != ""))


@query(_SEQ_DUCK + " SELECT cluster, CAST(median(length(seq)) AS DOUBLE) AS median_length FROM s GROUP BY cluster")
def bag_median_length(spark, d):
    return E.median_length(_bags(spark, d), F.length("seq"))


@query(_HEAVIEST + """, y AS (SELECT x.cluster, b.cluster AS other, sum(weight * levenshtein(seq, exemplar)) / sum(weight) AS mean_distance,
  sum(weight * levenshtein(seq, exemplar) / greatest(length(seq), length(exemplar), 1)) / sum(weight) AS mean_normalized FROM b, x GROUP BY ALL)
  SELECT cluster, other, round(mean_distance, 6) AS mean_distance, round(mean_normalized, 6) AS mean_normalized FROM y""")
def exemplar_distances(spark, d):
    bags = _bags(spark, d)
    found = E.exemplar_distances(bags, _heaviest(bags), F.expr(_DISTANCE), F.expr(_LONGEST))
    return found.withColumn("mean_distance", F.round("mean_distance", 6)).withColumn("mean_normalized", F.round("mean_normalized", 6))


@query(_HEAVIEST + """, y AS (SELECT x.cluster, b.cluster AS other, sum(weight * levenshtein(seq, exemplar)) / sum(weight) AS m,
  sum(weight * levenshtein(seq, exemplar) / greatest(length(seq), length(exemplar), 1)) / sum(weight) AS n FROM b, x GROUP BY ALL),
  z AS (SELECT cluster, max(m) FILTER (WHERE cluster = other) AS own, max(n) FILTER (WHERE cluster = other) AS own_n, avg(m) FILTER (WHERE cluster <> other) AS others FROM y GROUP BY cluster)
  SELECT cluster, round(own, 5) AS own, round(own_n, 5) AS own_normalized, round(others, 5) AS others, round(others - own, 5) AS gap FROM z""")
def exemplar_separation(spark, d):
    bags = _bags(spark, d)
    found = E.evaluated(bags, _heaviest(bags), F.expr(_DISTANCE), F.expr(_LONGEST))
    return found.select("cluster", *[F.round(c, 5).alias(c) for c in ("own", "own_normalized", "others", "gap")])


@query(_BAGS + """, t AS (SELECT cluster, min(seq) || 'X' AS truth FROM b GROUP BY cluster)
  SELECT cluster, round(1 - count(*) / sum(cnt), 6) AS duplicates, bool_or(seq = truth) AS present, CAST(min(levenshtein(seq, truth)) AS INT) AS best_edit FROM b JOIN t USING (cluster) GROUP BY cluster""")
def bag_truth_diagnostics(spark, d):
    bags = _bags(spark, d)
    truths = bags.groupBy("cluster").agg(F.concat(F.min("seq"), F.lit("X")).alias("seq"))
    return E.truth_diagnostics(bags, truths, F.expr(_DISTANCE)).withColumn("duplicates", F.round("duplicates", 6))


@query(_BAGS + " SELECT cluster, seq, CAST(sum(cnt) AS BIGINT) AS copies FROM b GROUP BY ALL")
def bag_raw_sequences(spark, d):
    return E.raw_sequences(_bags(spark, d)).groupBy("cluster", "seq").agg(F.count("*").alias("copies"))


@query()
def consensus_exemplars(spark, d):
    return E.consensus_exemplars(_tokens(spark, d))


@query()
def likelihood_exemplars(spark, d):
    return E.likelihood_exemplars(_tokens(spark, d))


@query("""WITH p AS (SELECT label AS truth, CAST(vec_id % 7 AS INT) AS found FROM embeddings), c AS (SELECT truth, found, count(*) AS n FROM p GROUP BY ALL),
 a AS (SELECT truth, sum(n) AS n FROM c GROUP BY truth), b AS (SELECT found, sum(n) AS n FROM c GROUP BY found), t AS (SELECT sum(n) AS t FROM c),
 x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS same, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa, (SELECT sum(n * (n - 1) / 2) FROM b) AS sb, t,
   (SELECT -sum(n / t * ln(n / t)) FROM a, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS hb,
   (SELECT sum(c.n / t * ln(c.n * t / (a.n * b.n))) FROM c JOIN a USING (truth) JOIN b USING (found), t) AS mi FROM t)
 SELECT round((same - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi FROM x""")
def ari_nmi(spark, d):
    return C.rand_and_information(read(spark, d, "embeddings").select(F.col("label").alias("truth"), (F.col("vec_id") % 7).cast("int").alias("found")))
