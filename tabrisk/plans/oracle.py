"""DuckDB SQL equal to each registered query (same column names).

The SQL states the rule directly (one window per class, a plain median),
which is what the distributed Spark plans must reproduce.
"""

from __future__ import annotations

# --- shared fragments -------------------------------------------------------

def _quotas(src: str, label: str = "label", pct: int = 20) -> str:
    """Largest-remainder test quota per class of ``src``."""
    return f"""
    (SELECT {label}, n_class, base_q + CASE WHEN row_number() OVER (ORDER BY rem DESC, {label})
                                  <= n_test - sum(base_q) OVER () THEN 1 ELSE 0 END AS quota
     FROM (SELECT {label}, n_class, n_test,
                  (n_test * n_class) // n AS base_q, (n_test * n_class) % n AS rem
           FROM (SELECT {label}, n_class::HUGEINT AS n_class,
                        sum(n_class) OVER ()::HUGEINT AS n,
                        ((sum(n_class) OVER ())::HUGEINT * {pct} + 99) // 100 AS n_test
                 FROM (SELECT {label}, count(*) AS n_class FROM {src} GROUP BY {label}))))"""


LINEITEM_BASE = """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax,
         CAST(l_returnflag = 'R' AS INTEGER) AS label,
         md5(concat_ws('-', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS h
  FROM lineitem"""

LINEITEM_SPLIT = f"""
  WITH base AS ({LINEITEM_BASE}),
  q AS {_quotas('base')},
  ranked AS (SELECT b.*, row_number() OVER (PARTITION BY label ORDER BY h, l_quantity,
                    l_extendedprice, l_discount, l_tax) AS rk FROM base b)
  SELECT r.*, CASE WHEN rk <= q.quota THEN 'test' ELSE 'train' END AS split
  FROM ranked r JOIN q USING (label)"""


def _scaled(c: str, zero: bool) -> str:
    x = f"NULLIF({c}, 0)" if zero else c
    return (f"greatest(0.0, least(1.0, (coalesce({x}, s.med_{c}) - s.lo_{c}) / "
            f"(CASE WHEN s.hi_{c} > s.lo_{c} THEN s.hi_{c} - s.lo_{c} ELSE 1.0 END)))")


def _stats(cols_zero: list[tuple[str, bool]], src: str, where: str) -> str:
    parts = []
    for c, z in cols_zero:
        x = f"NULLIF({c}, 0)" if z else c
        parts += [f"median({x}) AS med_{c}", f"min({x}) AS lo_{c}", f"max({x}) AS hi_{c}"]
    return f"(SELECT {', '.join(parts)} FROM {src} WHERE {where})"


LI_FEATS = [("l_quantity", False), ("l_extendedprice", False), ("l_discount", True), ("l_tax", True)]

PREP_SCALED_BY_SPLIT = f"""
WITH sp AS ({LINEITEM_SPLIT}),
s AS {_stats(LI_FEATS, 'sp', "split = 'train'")}
SELECT split, label, count(*) AS n_rows,
       {', '.join(f'round(avg({_scaled(c, z)}), 9) AS avg_{c}' for c, z in LI_FEATS)}
FROM sp, s
GROUP BY split, label
"""

from tabrisk.plans.datasets import predictions_folds_sql, predictions_sql  # noqa: E402

PRED = f"pred AS ({predictions_sql()})"
COUNTS = f"""{PRED},
counts AS (SELECT model,
  CAST(sum(CASE WHEN actual = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN actual = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN actual = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN actual = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM pred GROUP BY model)"""

CONFUSION_LONG = f"""WITH {COUNTS},
long AS (SELECT model, 0 AS predicted, 0 AS actual, tn AS n FROM counts
   UNION ALL SELECT model, 1, 0, fp FROM counts
   UNION ALL SELECT model, 0, 1, fn FROM counts
   UNION ALL SELECT model, 1, 1, tp FROM counts)"""

CONFUSION_MATRIX = CONFUSION_LONG + "\nSELECT * FROM long"

CONFUSION_PERCENT = CONFUSION_LONG + """,
pc AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY model, actual) > 0
          THEN n * 100.0 / sum(n) OVER (PARTITION BY model, actual) END AS percent FROM long)
SELECT model, predicted, actual, n, round(percent, 9) AS percent,
       CASE WHEN percent IS NOT NULL THEN printf('%.1f%%\n%d', percent, n) END AS cell_text
FROM pc"""


def _r(num: str, den: str, zero: str = "0.0") -> str:
    return f"CASE WHEN ({den}) = 0 THEN {zero} ELSE CAST({num} AS DOUBLE) / ({den}) END"


CLASSIFICATION_METRICS = f"""WITH {COUNTS}
SELECT model, tn + fp + fn + tp AS support,
  round({_r('tp + tn', 'tn + fp + fn + tp', 'NULL')}, 9) AS accuracy,
  round({_r('tp', 'tp + fp')}, 9) AS precision,
  round({_r('tp', 'tp + fn')}, 9) AS recall,
  round({_r('2 * tp', '2 * tp + fp + fn')}, 9) AS f1
FROM counts"""

CLASSIFICATION_REPORT = f"""WITH {COUNTS},
per AS (SELECT model, tn + fp + fn + tp AS n,
  {_r('tn', 'tn + fn')} AS p0, {_r('tn', 'tn + fp')} AS r0, {_r('2 * tn', '2 * tn + fn + fp')} AS f0,
  tn + fp AS s0,
  {_r('tp', 'tp + fp')} AS p1, {_r('tp', 'tp + fn')} AS r1, {_r('2 * tp', '2 * tp + fp + fn')} AS f1,
  tp + fn AS s1, {_r('tp + tn', 'tn + fp + fn + tp', 'NULL')} AS acc FROM counts),
rows AS (
  SELECT model, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM per
  UNION ALL SELECT model, '1', p1, r1, f1, s1 FROM per
  UNION ALL SELECT model, 'accuracy', NULL, NULL, acc, n FROM per
  UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM per
  UNION ALL SELECT model, 'weighted avg', {_r('p0 * s0 + p1 * s1', 'n', 'NULL')},
     {_r('r0 * s0 + r1 * s1', 'n', 'NULL')}, {_r('f0 * s0 + f1 * s1', 'n', 'NULL')}, n FROM per)
SELECT model, label, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1, support FROM rows"""

SCORES = f"""{PRED},
d AS (SELECT model, probability, CAST(sum(actual) AS BIGINT) AS pos, CAST(sum(1 - actual) AS BIGINT) AS neg
      FROM pred WHERE probability IS NOT NULL GROUP BY model, probability),
st AS (SELECT *, sum(pos) OVER w AS pos_cum, sum(neg) OVER w AS neg_cum,
              sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
       FROM d WINDOW w AS (PARTITION BY model ORDER BY probability DESC
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

ROC_POINTS = f"""WITH {SCORES}
SELECT model, probability AS threshold,
       round(CASE WHEN N > 0 THEN neg_cum / N END, 9) AS fpr,
       round(CASE WHEN P > 0 THEN pos_cum / P END, 9) AS tpr FROM st
UNION ALL
SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM st"""

AUC_BAND_SQL = """CASE WHEN auc IS NULL THEN NULL WHEN auc >= 0.9 THEN 'Excellent'
  WHEN auc >= 0.8 THEN 'Good' WHEN auc >= 0.7 THEN 'Fair' ELSE 'Poor' END"""

ROC_AUC_CORE = f"""{SCORES},
a AS (SELECT model,
   CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * ((N - neg_cum) + neg / 2.0)) / (max(P) * max(N)) END AS auc,
   CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * (2 * pos_cum - pos)) / (2.0 * max(P) * max(N)) END AS auc_trapezoid
   FROM st GROUP BY model)"""

ROC_AUC = f"""WITH {ROC_AUC_CORE}
SELECT model, round(auc, 9) AS auc, round(auc_trapezoid, 9) AS auc_trapezoid, {AUC_BAND_SQL} AS band FROM a"""

MODEL_COMPARISON = f"""WITH {ROC_AUC_CORE},
{COUNTS.replace(PRED + ",", "")}
SELECT c.model,
  round({_r('tp + tn', 'tn + fp + fn + tp', 'NULL')}, 9) AS accuracy,
  round({_r('tp', 'tp + fp')}, 9) AS precision,
  round({_r('tp', 'tp + fn')}, 9) AS recall,
  round({_r('2 * tp', '2 * tp + fp + fn')}, 9) AS f1,
  round(a.auc, 9) AS roc_auc, tn, fp, fn, tp, tn + fp + fn + tp AS test_rows
FROM counts c LEFT JOIN a USING (model)"""

THRESHOLD_TUNING = f"""WITH p AS ({predictions_folds_sql()}),
d AS (SELECT * FROM p WHERE probability IS NOT NULL AND fold IS NOT NULL),
rng AS (SELECT model, min(probability) AS lo, max(probability) AS hi FROM d GROUP BY model),
c AS (SELECT d.model, fold,
        CASE WHEN hi > lo THEN least(99, greatest(0, CAST(floor((probability - lo) / ((hi - lo) / 99)) AS INTEGER)))
             ELSE 99 END AS j,
        CAST(sum(actual) AS BIGINT) AS pos, CAST(sum(1 - actual) AS BIGINT) AS neg
      FROM d JOIN rng USING (model) GROUP BY ALL),
grid AS (SELECT DISTINCT model, fold, unnest(range(0, 100)) AS j FROM c),
dense AS (SELECT g.model, g.fold, g.j, coalesce(c.pos, 0) AS pos, coalesce(c.neg, 0) AS neg
          FROM grid g LEFT JOIN c USING (model, fold, j)),
acc AS (SELECT model, fold, j,
   (sum(pos) OVER (PARTITION BY model, fold) - coalesce(sum(pos) OVER w, 0) + coalesce(sum(neg) OVER w, 0))
     / sum(pos + neg) OVER (PARTITION BY model, fold) AS acc
   FROM dense WINDOW w AS (PARTITION BY model, fold ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per_j AS (SELECT model, j, round(avg(acc), 12) AS m, round(stddev_pop(acc), 12) AS s FROM acc GROUP BY model, j),
best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY m DESC, j) AS r FROM per_j)
SELECT b.model, CAST(b.j AS INTEGER) AS best_index, round(lo + b.j * ((hi - lo) / 99), 9) AS best_threshold,
       round(m, 9) AS cv_accuracy_mean, round(s, 9) AS cv_accuracy_std
FROM best b JOIN rng USING (model) WHERE r = 1"""

from tabrisk.contract import CUSTOMER, PART  # noqa: E402
from tabrisk.functions.expressions import NUMERIC_TEXT  # noqa: E402
from tabrisk.plans.datasets import history_sql  # noqa: E402


def _viol_sql(tbl: str, rid: str, contract) -> str:
    parts = []
    for r in contract.features:
        x = f"(CASE WHEN isnan(CAST({r.name} AS DOUBLE)) THEN NULL ELSE CAST({r.name} AS DOUBLE) END)"
        if r.low is not None or r.high is not None:
            conds = []
            if r.low is not None:
                conds.append(f"{x} < {float(r.low)}")
            if r.high is not None:
                conds.append(f"{x} > {float(r.high)}")
            parts.append(f"SELECT '{tbl}' AS table_name, '{r.name}' AS column_name, 'range' AS rule, "
                         f"{rid} AS row_id FROM {tbl} WHERE {x} IS NOT NULL AND ({' OR '.join(conds)})")
        if r.whole_number:
            parts.append(f"SELECT '{tbl}', '{r.name}', 'whole_number', {rid} FROM {tbl} "
                         f"WHERE {x} IS NOT NULL AND {x} % 1 <> 0")
    return "\n UNION ALL ".join(parts)


VIOL = f"""v AS ({_viol_sql('customer', 'c_custkey', CUSTOMER)}
  UNION ALL {_viol_sql('part', 'p_partkey', PART)})"""

CONTRACT_VIOLATIONS = f"""WITH {VIOL},
r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name, rule ORDER BY row_id) AS rn FROM v)
SELECT table_name, column_name, rule, count(*) AS n_bad,
       string_agg(CASE WHEN rn <= 10 THEN CAST(row_id AS VARCHAR) END, ',' ORDER BY row_id) AS first_rows
FROM r GROUP BY table_name, column_name, rule"""

CLEAN_ROWS = f"""WITH {VIOL}
SELECT 'customer' AS table_name,
       CASE WHEN c_custkey IN (SELECT row_id FROM v WHERE table_name = 'customer') THEN 0 ELSE 1 END AS valid,
       count(*) AS n_rows FROM customer GROUP BY ALL
UNION ALL
SELECT 'part', CASE WHEN p_partkey IN (SELECT row_id FROM v WHERE table_name = 'part') THEN 0 ELSE 1 END,
       count(*) FROM part GROUP BY ALL"""

_TEXT_COLS = {
    "size_text": "CAST(p_size AS VARCHAR)",
    "brand_number": "split_part(p_brand, '#', 2)",
    "brand": "p_brand",
    "type_word": "p_type",
    "retail_text": "CAST(p_retailprice AS VARCHAR)",
}
_NUM = f"(CASE WHEN regexp_matches(txt, '{NUMERIC_TEXT}') THEN TRY_CAST(txt AS DOUBLE) END)"
NUMERIC_COERCION = f"""WITH t AS ({" UNION ALL ".join(
    f"SELECT '{n}' AS column_name, p_partkey AS row_id, {e} AS txt FROM part" for n, e in _TEXT_COLS.items())}),
c AS (SELECT *, CASE WHEN isnan({_NUM}) THEN NULL ELSE {_NUM} END AS num,
             txt IS NOT NULL AND NOT regexp_matches(txt, '{NUMERIC_TEXT}') AS bad FROM t),
r AS (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY column_name, bad ORDER BY row_id) END AS rn FROM c)
SELECT column_name, count(txt) AS n_values, count(num) AS n_numeric,
       CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
       round(sum(num), 6) AS sum_numeric,
       string_agg(CASE WHEN bad AND rn <= 10 THEN CAST(row_id AS VARCHAR) END, ',' ORDER BY row_id) AS first_rows
FROM r GROUP BY column_name"""

LABEL_DOMAIN_AND_EMPTY = """WITH a AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys,
   count(quality) AS nn_quality, CAST(sum(CASE WHEN quality IS NULL OR quality NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS bad_quality,
   count(toxic) AS nn_toxic, CAST(sum(CASE WHEN toxic IS NULL OR toxic NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS bad_toxic
   FROM labels),
r AS (SELECT 'row_count' AS rule, 'doc_id' AS column_name, n AS n_checked, abs(n - n_keys) AS n_bad FROM a
  UNION ALL SELECT 'not_empty', 'quality', n, CASE WHEN nn_quality = 0 THEN n ELSE 0 END FROM a
  UNION ALL SELECT 'label_domain', 'quality', n, bad_quality FROM a
  UNION ALL SELECT 'not_empty', 'toxic', n, CASE WHEN nn_toxic = 0 THEN n ELSE 0 END FROM a
  UNION ALL SELECT 'label_domain', 'toxic', n, bad_toxic FROM a)
SELECT rule, column_name, n_checked, CAST(n_bad AS BIGINT) AS n_bad, CAST(n_bad = 0 AS INTEGER) AS passed FROM r"""

PROVENANCE_AUDIT = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus,
        row_number() OVER (ORDER BY o_orderkey) AS position, count(*) OVER () AS n FROM orders),
b AS (SELECT *, n * 768 // 10000 AS e1, n * 1000 // 10000 AS e2 FROM o),
orig AS (SELECT o_custkey, o_orderstatus FROM b WHERE position <= e1),
dup AS (SELECT o_custkey, o_orderstatus FROM b WHERE position > e1 AND position <= e2),
r AS (
  SELECT 'row_count' AS rule, count(*) AS value, count(DISTINCT o_orderkey) AS expected FROM orders
  UNION ALL SELECT 'original_unique', coalesce(sum(c - 1), 0), 0 FROM (SELECT count(*) AS c FROM orig GROUP BY o_custkey, o_orderstatus)
  UNION ALL SELECT 'duplicate_block_in_original', count(*), 0 FROM dup d WHERE NOT EXISTS (
      SELECT 1 FROM orig o WHERE o.o_custkey = d.o_custkey AND o.o_orderstatus = d.o_orderstatus))
SELECT rule, CAST(value AS BIGINT) AS value, CAST(expected AS BIGINT) AS expected,
       CAST(value = expected AS INTEGER) AS passed FROM r"""


def _dup_stats(tbl: str, cols: str) -> str:
    return f"""SELECT '{tbl}' AS table_name, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct,
      CAST(sum(c - 1) AS BIGINT) AS n_repeats, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_groups_with_copies,
      CAST(max(c) AS BIGINT) AS max_copies FROM (SELECT count(*) AS c FROM {tbl} GROUP BY {cols})"""


DUPLICATE_ROWS = (_dup_stats("lineitem", "l_orderkey, l_linenumber") + "\nUNION ALL\n"
                  + _dup_stats("orders", "o_custkey, o_orderstatus"))

DEDUPE_KEEP_FIRST = """SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey,
  arg_min(o_totalprice, o_orderkey) AS o_totalprice, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority,
  count(*) AS copies FROM orders GROUP BY o_custkey, o_orderstatus"""

ORDERS_RANKED = f"""base AS (SELECT o_orderkey, o_orderstatus, md5(concat_ws('-', '42', o_orderkey)) AS h FROM orders),
q AS {_quotas('base', 'o_orderstatus')},
r AS (SELECT b.*, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h) AS rk FROM base b)"""

STRATIFIED_SPLIT_COUNTS = f"""WITH {ORDERS_RANKED}
SELECT CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split, o_orderstatus, count(*) AS n_rows
FROM r JOIN q USING (o_orderstatus) GROUP BY ALL"""

STRATIFIED_FOLDS = f"""WITH {ORDERS_RANKED}
SELECT o_orderkey, o_orderstatus, CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split,
       CASE WHEN rk > quota THEN CAST((rk - quota - 1) % 5 AS INTEGER) END AS fold
FROM r JOIN q USING (o_orderstatus)"""

CLASS_WEIGHTS_GAMMA = f"""WITH sp AS ({LINEITEM_SPLIT}),
s AS {_stats(LI_FEATS, 'sp', "split = 'train'")},
x AS (SELECT label, {', '.join(f'{_scaled(c, z)} AS {c}' for c, z in LI_FEATS)} FROM sp, s WHERE split = 'train'),
v AS (SELECT var_pop(v) AS var FROM (SELECT unnest([{', '.join(c for c, _ in LI_FEATS)}]) AS v FROM x)),
c AS (SELECT label, count(*) AS n_class FROM x GROUP BY label)
SELECT label, n_class, round(sum(n_class) OVER () / (2.0 * n_class), 9) AS class_weight,
       round(1.0 / ({len(LI_FEATS)} * var), 9) AS gamma_scale, CAST(1 AS DOUBLE) / {len(LI_FEATS)} AS gamma_auto
FROM c, v"""

HISTORY_REPORT = f"""WITH h AS ({history_sql()})
SELECT model, prediction, count(*) AS n, round(avg(probability), 6) AS avg_probability,
       min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM h WHERE model IN ('ANN', 'SVM') GROUP BY model, prediction"""

HISTORY_LATEST = f"""WITH h AS ({history_sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY timestamp DESC, row_id DESC) AS recency FROM h)
SELECT model, CAST(recency AS INTEGER) AS recency, row_id, timestamp, probability, prediction FROM r WHERE recency <= 10"""

HISTORY_FULL = f"""WITH h AS ({history_sql()})
SELECT model, row_id, timestamp, probability, prediction FROM h ORDER BY timestamp DESC, row_id DESC, model"""

RESCORE_PENDING = """WITH docs AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
scored AS (SELECT DISTINCT d.content_hash, m.model, 'v1' AS version
           FROM docs d JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id),
                (VALUES ('ANN'), ('KNN'), ('SVM')) m(model)),
wanted AS (SELECT d.doc_id, d.content_hash, r.model, r.version
           FROM docs d, (VALUES ('ANN', 'v1'), ('KNN', 'v1'), ('SVM', 'v2')) r(model, version))
SELECT doc_id, model, version, content_hash FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.content_hash = w.content_hash
                  AND s.model = w.model AND s.version = w.version)"""

from tabrisk.plans.datasets import ACTUAL_SQL, RULE_MODELS  # noqa: E402

SCORE_BATCH_LONG = f"""WITH p AS ({predictions_sql()}),
pos AS (SELECT event_id AS row_id, row_number() OVER (ORDER BY event_id) AS row_number FROM events)
SELECT row_number, row_id, model, prediction,
       CASE WHEN prediction = 1 THEN 'High Risk' ELSE 'Low Risk' END AS risk,
       round(probability, 9) AS probability, round(probability * 100, 2) AS percent
FROM p JOIN pos USING (row_id)"""

SCORE_BATCH_WIDE = "SELECT row_number() OVER (ORDER BY event_id) AS row_number, event_id, user_id, value, " + ", ".join(
    f"CASE WHEN {pred} = 1 THEN 'High Risk' ELSE 'Low Risk' END AS {name.lower()}_risk, "
    + (f"round(CAST({prob} AS DOUBLE) * 100, 2)" if prob else "CAST(NULL AS DOUBLE)") + f" AS {name.lower()}_percent"
    for name, (prob, pred) in RULE_MODELS.items()) + " FROM events"

_THREE = [n for n, (prob, _) in RULE_MODELS.items() if prob]
IMPORTANCE_RULES = f"""WITH e AS (SELECT event_id, user_id, value, {ACTUAL_SQL} AS label,
                  row_number() OVER (ORDER BY event_id) AS pos FROM events),
reps AS (SELECT f.feature, r.rep FROM (VALUES ('user_id'), ('value')) f(feature), range(0, 30) r(rep)),
d AS (SELECT feature, rep, user_id AS donor_user, value AS donor_value,
             row_number() OVER (PARTITION BY feature, rep ORDER BY md5(concat_ws('-', '42', feature, rep, event_id))) AS pos
      FROM e, reps),
s AS (SELECT feature, rep, label, CASE WHEN feature = 'user_id' THEN donor_user ELSE user_id END AS user_id,
             CASE WHEN feature = 'value' THEN donor_value ELSE value END AS value FROM d JOIN e USING (pos)
      UNION ALL SELECT 'None', -1, label, user_id, value FROM e),
acc AS (SELECT feature, rep, {", ".join(f"avg(CASE WHEN ({RULE_MODELS[n][1]}) = label THEN 1.0 ELSE 0.0 END) AS {n}" for n in _THREE)}
        FROM s GROUP BY feature, rep),
dr AS (SELECT feature, {", ".join(f"round(max(CASE WHEN feature = 'None' THEN {n} END) OVER () - {n}, 9) AS {n}" for n in _THREE)} FROM acc),
t AS (SELECT feature, {", ".join(f"round(avg({n}), 9) AS {n}" for n in _THREE)} FROM dr WHERE feature <> 'None' GROUP BY feature),
w AS (SELECT *, round(({" + ".join(_THREE)}) / 3, 9) AS team_average FROM t),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY team_average DESC, feature) AS INTEGER) AS overall_rank,
      {", ".join(f"CAST(row_number() OVER (ORDER BY {n} DESC, feature) AS INTEGER) AS {n.lower()}_rank" for n in _THREE)} FROM w)
SELECT *, CAST(overall_rank = 1 AS INTEGER) AS is_top FROM k"""

# A saved model must score every test row as the fitted one does.
SAVED_MODEL_CHECK = f"""WITH e AS (SELECT CAST(label < 5 AS INTEGER) AS label FROM embeddings),
q AS {_quotas('e')},
n AS (SELECT CAST(sum(quota) AS BIGINT) AS n FROM q)
SELECT m.model, n AS rows_scored, n AS same_predictions, CAST(1 AS INTEGER) AS passed
FROM n, (VALUES ('ANN'), ('KNN'), ('SVM')) m(model)"""

BATCH_APPEND_HISTORY = """WITH c AS (SELECT *, value < 0 OR value > 250 OR user_id < 0 AS bad FROM events),
t AS (SELECT count(*) AS rows_in, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS rows_refused
      FROM (SELECT coalesce(bad, FALSE) AS bad FROM c)),
h AS (""" + "\n UNION ALL ".join(
    f"SELECT '{name}' AS model, " + (f"round(CAST({prob} AS DOUBLE) * 100, 2)" if prob else "CAST(NULL AS DOUBLE)")
    + f" AS probability, CASE WHEN {pred} = 1 THEN 'High Risk' ELSE 'Low Risk' END AS prediction, user_id, value"
    " FROM c WHERE NOT coalesce(bad, FALSE)" for name, (prob, pred) in RULE_MODELS.items()) + """)
SELECT model, prediction, count(*) AS n, round(avg(probability), 6) AS avg_probability,
       round(sum(value), 4) AS sum_value, count(DISTINCT user_id) AS n_users, rows_in, rows_refused
FROM h, t GROUP BY model, prediction, rows_in, rows_refused"""

ORACLE = {
    "prep_scaled_by_split": PREP_SCALED_BY_SPLIT,
    "confusion_matrix": CONFUSION_MATRIX,
    "confusion_percent": CONFUSION_PERCENT,
    "classification_metrics": CLASSIFICATION_METRICS,
    "classification_report": CLASSIFICATION_REPORT,
    "roc_points": ROC_POINTS,
    "roc_auc": ROC_AUC,
    "model_comparison": MODEL_COMPARISON,
    "threshold_tuning": THRESHOLD_TUNING,
    "contract_violations": CONTRACT_VIOLATIONS,
    "clean_rows": CLEAN_ROWS,
    "numeric_coercion": NUMERIC_COERCION,
    "label_domain_and_empty": LABEL_DOMAIN_AND_EMPTY,
    "provenance_audit": PROVENANCE_AUDIT,
    "duplicate_rows": DUPLICATE_ROWS,
    "dedupe_keep_first": DEDUPE_KEEP_FIRST,
    "stratified_split_counts": STRATIFIED_SPLIT_COUNTS,
    "stratified_folds": STRATIFIED_FOLDS,
    "class_weights_gamma": CLASS_WEIGHTS_GAMMA,
    "history_report": HISTORY_REPORT,
    "history_latest": HISTORY_LATEST,
    "history_full": HISTORY_FULL,
    "importance_rules": IMPORTANCE_RULES,
    "saved_model_check": SAVED_MODEL_CHECK,
    "batch_append_history": BATCH_APPEND_HISTORY,
    "rescore_pending": RESCORE_PENDING,
    "score_batch_long": SCORE_BATCH_LONG,
    "score_batch_wide": SCORE_BATCH_WIDE,
}

from tabrisk.plans.knn_oracle import KNN_ORACLE  # noqa: E402

ORACLE.update(KNN_ORACLE)
