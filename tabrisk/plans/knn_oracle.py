"""DuckDB SQL for the KNN queries: brute force (every test row against every
training row), which is what the cell-pruned Spark plan must reproduce."""

from __future__ import annotations

from tabrisk.contract import EMBED_FEATURES
from tabrisk.plans.knn_queries import ABLATION_MODELS, DEFAULT_K, KNN_K, N_REPEATS
from tabrisk.plans.oracle import _quotas

FEATS = list(EMBED_FEATURES)
KLIST = "[" + ", ".join(str(k) for k in KNN_K) + "]"


def _d(a: str, b: str, cols, metric="euclidean") -> str:
    if metric == "euclidean":
        return "sqrt(0.0 + " + " + ".join(f"(({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c}))" for c in cols) + ")"
    return "(0.0 + " + " + ".join(f"abs({a}.{c} - {b}.{c})" for c in cols) + ")"


def _scaled(c: str, s: str = "s") -> str:
    return (f"greatest(0.0, least(1.0, (coalesce({c}, {s}.med_{c}) - {s}.lo_{c}) / "
            f"(CASE WHEN {s}.hi_{c} > {s}.lo_{c} THEN {s}.hi_{c} - {s}.lo_{c} ELSE 1.0 END)))")


EM = ("em AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(FEATS))
      + ", CAST(label < 5 AS INTEGER) AS label, md5(concat_ws('-', '42', vec_id)) AS h FROM embeddings)")
STATS_ALL = ", ".join(f"median({c}) AS med_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATS)

SPLIT = f"""{EM},
q AS {_quotas('em')},
r AS (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY h) AS rk FROM em e),
sp AS (SELECT r.*, q.quota, CASE WHEN rk <= q.quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (label)),
st AS (SELECT {STATS_ALL} FROM sp WHERE split = 'train'),
x AS (SELECT vec_id, label, split, {", ".join(f"{_scaled(c)} AS {c}" for c in FEATS)} FROM sp, st s)"""

# --- knn_predict: 64 dims -----------------------------------------------------
_D64 = "sqrt(0.0 + " + " + ".join(f"((te.v[{i}] - tr.v[{i}]) * (te.v[{i}] - tr.v[{i}]))" for i in range(1, 65)) + ")"
KNN_PREDICT = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label < 5 AS INTEGER) AS label,
                  md5(concat_ws('-', '42', vec_id)) AS h FROM embeddings),
q AS {_quotas('e')},
r AS (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY h) AS rk FROM e),
sp AS (SELECT r.*, CASE WHEN rk <= q.quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (label)),
tr AS (SELECT vec_id AS tid, v, label FROM sp WHERE split = 'train'),
te AS (SELECT vec_id AS qid, v, label AS actual FROM sp WHERE split = 'test'),
d AS (SELECT qid, actual, tid, tr.label AS t_label, {_D64} AS dist FROM te, tr),
nb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rank FROM d)
SELECT qid AS vec_id, actual, CASE WHEN avg(t_label) > 0.5 THEN 1 ELSE 0 END AS prediction,
       round(avg(t_label), 9) AS probability
FROM nb WHERE rank <= {DEFAULT_K} GROUP BY qid, actual"""

# --- knn_grid / best_params ------------------------------------------------------
KNN_GRID = f"""WITH {EM},
q AS {_quotas('em')},
r AS (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY h) AS rk FROM em e),
sp AS (SELECT r.*, (rk - q.quota - 1) % 5 AS fold FROM r JOIN q USING (label) WHERE rk > q.quota),
sf AS (SELECT DISTINCT fold AS stat_fold FROM sp),
st AS (SELECT stat_fold, {STATS_ALL} FROM sf JOIN sp ON sp.fold <> sf.stat_fold GROUP BY stat_fold),
x AS (SELECT sp.vec_id, sp.label, sp.fold, s.stat_fold, {", ".join(f"{_scaled(c)} AS {c}" for c in FEATS)}
      FROM sp, st s),
pairs AS (SELECT qq.stat_fold, qq.vec_id AS qid, qq.label AS q_label, t.vec_id AS tid, t.label AS t_label,
                 {_d('qq', 't', FEATS)} AS de, {_d('qq', 't', FEATS, 'manhattan')} AS dm
          FROM x qq JOIN x t ON qq.stat_fold = t.stat_fold AND qq.fold = qq.stat_fold AND t.fold <> qq.stat_fold),
nb AS (SELECT stat_fold, qid, q_label, tid, t_label, 'euclidean' AS metric, de AS dist,
              row_number() OVER (PARTITION BY stat_fold, qid ORDER BY de, tid) AS rank FROM pairs
       UNION ALL
       SELECT stat_fold, qid, q_label, tid, t_label, 'manhattan', dm,
              row_number() OVER (PARTITION BY stat_fold, qid ORDER BY dm, tid) FROM pairs),
ex AS (SELECT *, unnest(list_filter({KLIST}, lambda kk: kk >= rank)) AS k FROM nb WHERE rank <= {max(KNN_K)}),
g AS (SELECT stat_fold, qid, q_label, metric, k, count(*) AS n, sum(t_label) AS n1,
             sum(CASE WHEN dist = 0 THEN 1 ELSE 0 END) AS z, sum(CASE WHEN dist = 0 THEN t_label ELSE 0 END) AS z1,
             sum(CASE WHEN dist > 0 THEN 1.0 / dist ELSE 0.0 END) AS w,
             sum(CASE WHEN dist > 0 THEN t_label / dist ELSE 0.0 END) AS w1
      FROM ex GROUP BY stat_fold, qid, q_label, metric, k),
v AS (SELECT stat_fold, qid, q_label, metric, k, 'uniform' AS weights, n1 / n AS p FROM g
      UNION ALL
      SELECT stat_fold, qid, q_label, metric, k, 'distance', CASE WHEN z > 0 THEN z1 / z ELSE w1 / w END FROM g),
acc AS (SELECT metric, k, weights, stat_fold,
               avg(CASE WHEN (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) = q_label THEN 1.0 ELSE 0.0 END) AS acc
        FROM v GROUP BY metric, k, weights, stat_fold),
res AS (SELECT metric, k, weights, round(avg(acc), 12) AS m, round(stddev_pop(acc), 12) AS s
        FROM acc GROUP BY metric, k, weights)
SELECT metric, CAST(k AS INTEGER) AS n_neighbors, weights,
       CAST((CASE WHEN metric = 'euclidean' THEN 0 ELSE 1 END) * {2 * len(KNN_K)}
            + (list_position({KLIST}, k) - 1) * 2 + (CASE WHEN weights = 'uniform' THEN 0 ELSE 1 END) AS INTEGER)
         AS grid_index,
       round(m, 9) AS cv_accuracy_mean, round(s, 9) AS cv_accuracy_std,
       CAST(rank() OVER (ORDER BY m DESC) AS INTEGER) AS rank_test_score
FROM res"""

BEST_PARAMS = f"""WITH g AS ({KNN_GRID}),
b AS (SELECT *, row_number() OVER (ORDER BY cv_accuracy_mean DESC, grid_index) AS r FROM g)
SELECT 'KNN' AS model,
       CAST(json_object('metric', metric, 'n_neighbors', CAST(n_neighbors AS VARCHAR), 'weights', weights) AS VARCHAR)
         AS best_params,
       grid_index, cv_accuracy_mean, cv_accuracy_std FROM b WHERE r = 1"""

# --- ablation ------------------------------------------------------------------------
_VARIANTS = " UNION ALL ".join(
    [f"SELECT vec_id, label, split, 'None' AS removed, {', '.join(FEATS)} FROM x"]
    + [f"SELECT vec_id, label, split, '{n}', {', '.join('0.0' if c == n else c for c in FEATS)} FROM x"
       for n in FEATS])


def _ablation_acc(ks) -> str:
    return f"""WITH {SPLIT},
v AS ({_VARIANTS}),
pairs AS (SELECT qq.removed, qq.vec_id AS qid, qq.label AS q_label, t.vec_id AS tid, t.label AS t_label,
                 {_d('qq', 't', FEATS)} AS dist
          FROM v qq JOIN v t ON qq.removed = t.removed AND qq.split = 'test' AND t.split = 'train'),
nb AS (SELECT *, row_number() OVER (PARTITION BY removed, qid ORDER BY dist, tid) AS rank FROM pairs),
ks AS (SELECT unnest([{", ".join(str(k) for k in ks)}]) AS k),
pred AS (SELECT k, removed, qid, q_label, CASE WHEN avg(t_label) > 0.5 THEN 1 ELSE 0 END AS p
         FROM nb JOIN ks ON nb.rank <= ks.k GROUP BY k, removed, qid, q_label),
acc AS (SELECT k, removed, avg(CASE WHEN p = q_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY k, removed),
ch AS (SELECT *, accuracy - max(CASE WHEN removed = 'None' THEN accuracy END) OVER (PARTITION BY k) AS accuracy_change
       FROM acc)"""


KNN_ABLATION = _ablation_acc([DEFAULT_K]) + """
SELECT 'KNN' AS model, removed AS removed_feature, round(accuracy, 9) AS accuracy,
       round(accuracy_change, 9) AS accuracy_change FROM ch"""

ABLATION_OUTER_JOIN = _ablation_acc(list(ABLATION_MODELS.values())) + "\nSELECT removed AS removed_feature, " + ", ".join(
    f"max(CASE WHEN k = {k} THEN round(accuracy, 9) END) AS {name}_accuracy, "
    f"max(CASE WHEN k = {k} THEN round(accuracy_change, 9) END) AS {name}_change"
    for name, k in ABLATION_MODELS.items()) + " FROM ch GROUP BY removed"

# --- permutation importance -------------------------------------------------------------
# every (row pair, feature) once with the distance less that feature's term; a shuffled value's term comes on top
_LISTED = ", ".join(FEATS)
_NAMES = ", ".join(f"'{c}'" for c in FEATS)
PERMUTATION_IMPORTANCE = f"""WITH {SPLIT},
te AS (SELECT vec_id, label, [{_LISTED}] AS v, row_number() OVER (ORDER BY vec_id) AS pos FROM x WHERE split = 'test'),
tr AS (SELECT vec_id AS tid, label AS t_label, [{_LISTED}] AS v FROM x WHERE split = 'train'),
names AS (SELECT unnest([{_NAMES}]) AS feature, unnest(range(1, {len(FEATS) + 1})) AS f),
orders AS (SELECT f, rep, vec_id AS donor,
                  row_number() OVER (PARTITION BY f, rep ORDER BY md5(concat_ws('-', '42', feature, rep, vec_id))) AS pos
           FROM te, names, range(0, {N_REPEATS}) r(rep)),
donors AS (SELECT o.f, rep, a.vec_id AS qid, b.v[o.f] AS donor
           FROM orders o JOIN te a USING (pos) JOIN te b ON b.vec_id = o.donor),
pairs AS (SELECT te.vec_id AS qid, te.label AS q_label, tid, t_label, te.v AS q, tr.v AS t,
                 list_sum(list_transform(list_zip(te.v, tr.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM te, tr),
base AS (SELECT qid, q_label, t_label, f, t[f] AS tv, greatest(d - (q[f] - t[f]) * (q[f] - t[f]), 0.0) AS d FROM pairs, names),
shuffled AS (SELECT f, rep, qid, q_label, arg_min(t_label, d + (donor - tv) * (donor - tv), {DEFAULT_K}) AS near
             FROM base JOIN donors USING (qid, f) GROUP BY f, rep, qid, q_label),
acc AS (SELECT f, rep, avg(CASE WHEN (list_avg(near) > 0.5) = (q_label = 1) THEN 1.0 ELSE 0.0 END) AS acc FROM shuffled GROUP BY f, rep),
plain AS (SELECT avg(CASE WHEN (list_avg(near) > 0.5) = (q_label = 1) THEN 1.0 ELSE 0.0 END) AS acc
          FROM (SELECT qid, q_label, arg_min(t_label, d, {DEFAULT_K}) AS near FROM pairs GROUP BY qid, q_label))
SELECT 'KNN' AS model, feature, round(avg(plain.acc - acc.acc), 9) AS importance_mean,
       round(stddev_pop(plain.acc - acc.acc), 9) AS importance_std
FROM acc JOIN names USING (f), plain GROUP BY feature"""

KNN_ORACLE = {
    "knn_predict": KNN_PREDICT,
    "knn_grid": KNN_GRID,
    "best_params": BEST_PARAMS,
    "knn_ablation": KNN_ABLATION,
    "ablation_outer_join": ABLATION_OUTER_JOIN,
    "permutation_importance": PERMUTATION_IMPORTANCE,
}
