"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads whole driver tables (or tables Spark derives from them);
columns are aliased to the names used by the matching SQL in ``oracle.py``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabrisk.contract import CUSTOMER, EVENT_BATCH, HISTORY_TIME_FORMAT, LINEITEM, MODEL_NAMES, PART, ColumnRule, TableContract
from tabrisk.functions.expressions import to_number
from tabrisk.operators import audit as AU
from tabrisk.operators import validate as V
from tabrisk.operators.ranking import bottom_k, position_by_key
from tabrisk.operators.split import split_and_folds
from tabrisk.plans.datasets import ACTUAL_SQL, RULE_MODELS, event_history
from tabrisk.session import checkpoint_dir, files_released
from tabrisk.sources.history import append_history, clear_history, load_history
from tabrisk.sources.tables import table
from tabrisk.operators import metrics as M
from tabrisk.operators.threshold import best_threshold, threshold_curve
from tabrisk.plans.datasets import event_predictions, event_predictions_folds
from tabrisk.operators.prep import RiskPreprocessor, pooled_variance
from tabrisk.operators.split import stratified_split
from tabrisk.sources.tables import LINEITEM_KEYS, LINEITEM_TIEBREAK, lineitem_patients

R = 9  # decimals kept for float aggregates (summation order differs by engine)


def prep_scaled_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: P9 -> E1 split -> fit A1/A2 on train -> F1/F2 everywhere ->
    average scaled feature per split and label."""
    pts = lineitem_patients(spark, sf_dir)
    split = stratified_split(pts, "label", LINEITEM_KEYS, tiebreak=LINEITEM_TIEBREAK)
    feats = LINEITEM.feature_names
    prep = RiskPreprocessor(inputCols=feats, zeroMissingCols=LINEITEM.zero_missing)
    model = prep.fit(split.where(F.col("split") == "train"))
    scaled = model.transform(split)
    return (scaled.groupBy("split", "label")
                  .agg(F.count(F.lit(1)).alias("n_rows"),
                       *[F.round(F.avg(c), R).alias(f"avg_{c}") for c in feats]))


def confusion_matrix(spark, sf_dir):
    """A3 long form over the stored predictions."""
    return M.confusion_long(M.confusion_counts(event_predictions(spark, sf_dir)))


def confusion_percent(spark, sf_dir):
    """A8 W9 F4 F5 F16 F17."""
    return M.confusion_percent(M.confusion_counts(event_predictions(spark, sf_dir)))


def classification_metrics(spark, sf_dir):
    """A4 A5."""
    m = M.classification_metrics(M.confusion_counts(event_predictions(spark, sf_dir)))
    return m.select("model", "support", *[F.round(c, 9).alias(c)
                                          for c in ("accuracy", "precision", "recall", "f1")])


def classification_report(spark, sf_dir):
    """A9."""
    return M.classification_report(M.confusion_counts(event_predictions(spark, sf_dir)))


def roc_points(spark, sf_dir):
    """A7 W2."""
    return M.roc_points(event_predictions(spark, sf_dir))


def roc_auc(spark, sf_dir):
    """A6 A20 W7 F11."""
    return M.roc_auc(event_predictions(spark, sf_dir))


def model_comparison(spark, sf_dir):
    """A21 over every model of the predictions table."""
    return M.model_comparison(event_predictions(spark, sf_dir))


def threshold_tuning(spark, sf_dir):
    """Best of 100 thresholds by 5-fold mean accuracy, per model."""
    curve = threshold_curve(event_predictions_folds(spark, sf_dir))
    return best_threshold(curve).select("model", F.col("j").alias("best_index"),
                                        F.round("threshold", 9).alias("best_threshold"),
                                        F.round("cv_accuracy_mean", 9).alias("cv_accuracy_mean"),
                                        F.round("cv_accuracy_std", 9).alias("cv_accuracy_std"))


# --- validation ---------------------------------------------------------------

def contract_violations(spark, sf_dir):
    """Per table, column and rule the bad-row count and the
    first 10 row numbers (customer: negative balances; part: sizes, prices)."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    parts = []
    for name, df, contract, rid in (("customer", cu, CUSTOMER, "c_custkey"),
                                    ("part", pa, PART, "p_partkey")):
        rep = V.violation_report(V.violations(df, contract, rid))
        parts.append(rep.select(F.lit(name).alias("table_name"), F.col("column").alias("column_name"),
                                "rule", "n_bad", "first_rows"))
    return parts[0].unionByName(parts[1])


def clean_rows(spark, sf_dir):
    """Rows with and without a violation, per table (anti / semi join)."""
    out = []
    for name, contract, rid, cols in (("customer", CUSTOMER, "c_custkey", ["c_acctbal", "c_nationkey"]),
                                      ("part", PART, "p_partkey", ["p_size", "p_retailprice"])):
        df = table(spark, sf_dir, name).select(rid, *cols)
        good, bad = V.split_valid(df, V.violations(df, contract, rid), rid)
        out.append(good.select(F.lit(name).alias("table_name"), F.lit(1).alias("valid"))
                   .unionByName(bad.select(F.lit(name).alias("table_name"), F.lit(0).alias("valid")))
                   .groupBy("table_name", "valid").agg(F.count(F.lit(1)).alias("n_rows")))
    return out[0].unionByName(out[1])


NUMERIC_TEXT_COLS = {
    "size_text": "CAST(p_size AS STRING)",
    "brand_number": "split_part(p_brand, '#', 2)",
    "brand": "p_brand",
    "type_word": "p_type",
    "retail_text": "CAST(p_retailprice AS STRING)",
}


def numeric_coercion(spark, sf_dir):
    """Text columns made numeric; per column the values that
    parse, the bad ones (with first row numbers) and the parsed sum."""
    pa = table(spark, sf_dir, "part").select(
        "p_partkey", *[F.expr(e).alias(n) for n, e in NUMERIC_TEXT_COLS.items()])
    contract = TableContract(tuple(ColumnRule(n) for n in NUMERIC_TEXT_COLS), row_id="p_partkey")
    rep = V.violation_report(V.violations(pa, contract, "p_partkey", text=True))
    stats = pa.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col(n).alias("txt"), to_number(n).alias("num"))
        for n in NUMERIC_TEXT_COLS]))).groupBy("column_name").agg(
        F.count("txt").alias("n_values"), F.count("num").alias("n_numeric"),
        F.round(F.sum("num"), 6).alias("sum_numeric"))
    return (stats.join(rep.select(F.col("column").alias("column_name"), "n_bad", "first_rows"),
                       "column_name", "left")
                 .select("column_name", "n_values", "n_numeric",
                         F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"),
                         "sum_numeric", "first_rows"))


def label_domain_and_empty(spark, sf_dir):
    """P7 P8 P11 P18 on labels: empty columns, label domain, row count =
    distinct keys; one row per rule and column with passed 0/1."""
    lb = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    aggs = [F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_keys")]
    for c in ("quality", "toxic"):
        aggs += [F.count(c).alias(f"nn_{c}"),
                 F.sum(F.when(F.coalesce(~F.col(c).isin(0, 1), F.lit(True)), 1).otherwise(0))
                  .cast("long").alias(f"bad_{c}")]
    a = lb.agg(*aggs)
    def rule(name, col, bad):
        return F.struct(F.lit(name).alias("rule"), F.lit(col).alias("column_name"),
                        F.col("n").cast("long").alias("n_checked"), bad.cast("long").alias("n_bad"))

    rows = [rule("row_count", "doc_id", F.abs(F.col("n") - F.col("n_keys")))]
    for c in ("quality", "toxic"):
        rows.append(rule("not_empty", c, F.when(F.col(f"nn_{c}") == 0, F.col("n")).otherwise(F.lit(0))))
        rows.append(rule("label_domain", c, F.col(f"bad_{c}")))
    return (a.select(F.inline(F.array(*rows)))
             .withColumn("passed", (F.col("n_bad") == 0).cast("int")))


# --- provenance and duplicates -----------------------------------------------------

AUDIT_COLS = ("o_custkey", "o_orderstatus")


def provenance_audit(spark, sf_dir):
    """E17 P10 J2 U3 A13 on orders in key order: original block = first
    7.68 % of rows, copy block = up to 10 % (the reference's 768 / 1000 of
    10000); expected rows = distinct keys."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", *AUDIT_COLS)
    n, n_keys = od.agg(F.count(F.lit(1)), F.countDistinct("o_orderkey")).first()
    pos = position_by_key(od, "o_orderkey")
    return AU.provenance_audit(pos, "position", list(AUDIT_COLS),
                               n * 768 // 10000, n * 1000 // 10000, n_keys)


def duplicate_rows(spark, sf_dir):
    """Repeats on a column subset, per table."""
    li = AU.duplicate_stats(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    od = AU.duplicate_stats(table(spark, sf_dir, "orders"), list(AUDIT_COLS))
    return (li.select(F.lit("lineitem").alias("table_name"), "*")
              .unionByName(od.select(F.lit("orders").alias("table_name"), "*")))


def dedupe_keep_first(spark, sf_dir):
    """U4: first order (smallest key) of every (customer, status)."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", *AUDIT_COLS)
    return AU.keep_first(od, list(AUDIT_COLS), "o_orderkey")


# --- split and folds ----------------------------------------------------------------

def stratified_split_counts(spark, sf_dir):
    """Test / train rows per order status."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sp = stratified_split(od, "o_orderstatus", ["o_orderkey"])
    return sp.groupBy("split", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


def stratified_folds(spark, sf_dir):
    """Split and 5 folds for every order."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split_and_folds(od, "o_orderstatus", ["o_orderkey"])


def class_weights_gamma(spark, sf_dir):
    """A23 A24 on the scaled lineitem training rows: balanced class weights
    n / (2 n_c); gamma 'scale' = 1 / (p var(X)) and 'auto' = 1 / p."""
    pts = lineitem_patients(spark, sf_dir)
    split = stratified_split(pts, "label", LINEITEM_KEYS, tiebreak=LINEITEM_TIEBREAK)
    train = split.where(F.col("split") == "train")
    feats = LINEITEM.feature_names
    model = RiskPreprocessor(inputCols=feats, zeroMissingCols=LINEITEM.zero_missing).fit(train)
    x = model.transform(train).select("label", *feats)
    p = len(feats)
    # the variance of every scaled value: p means and variances of one aggregate
    var = pooled_variance(x, feats)
    cls = x.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    tot = F.sum("n_class").over(Window.partitionBy())     # over one row per class
    return (cls.withColumn("class_weight", F.round(tot / (2.0 * F.col("n_class")), 9))
               .select("label", "n_class", "class_weight",
                       F.round(F.lit(1.0) / (F.lit(float(p)) * F.lit(var)), 9).alias("gamma_scale"),
                       F.lit(1.0 / p).alias("gamma_auto")))


# --- history --------------------------------------------------------------------------

HISTORY_MODELS = ("ANN", "SVM")


def history_report(spark, sf_dir):
    """History of the selected models, counts by model and
    risk label with mean percent and first / last time."""
    h = event_history(spark, sf_dir).where(F.col("model").isin(*HISTORY_MODELS))
    return h.groupBy("model", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("avg_probability"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def history_latest(spark, sf_dir):
    """The 10 newest predictions of each model (newest first,
    ties by row id) -- a top-k report, salted so a hot model is split."""
    h = event_history(spark, sf_dir)
    top = bottom_k(h, ["model"], [F.col("timestamp").desc(), F.col("row_id").desc()], 10,
                   salt_by=["row_id"], out="recency")
    return top.select("model", "recency", "row_id", "timestamp", "probability", "prediction")


def history_full(spark, sf_dir):
    """The whole history, newest first (ties by row id)."""
    h = event_history(spark, sf_dir).select("model", "row_id", "timestamp", "probability", "prediction")
    return h.orderBy(F.col("timestamp").desc(), F.col("row_id").desc(), "model")


def batch_append_history(spark, sf_dir):
    """An upload of events is validated,
    its good rows are scored by every rule model and appended to a history
    in two batches (first and second half of the ids), each batch twice, which
    counts once, and the history is read back:
    rows, mean percent and the distinct inputs per model and risk label, beside
    the rows in and the rows refused."""
    from tabrisk.functions.expressions import risk_label
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    V.check_schema(ev.columns, EVENT_BATCH)
    checked = ev.withColumn("_ok", V.is_valid_row(EVENT_BATCH))
    seen = checked.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(~F.col("_ok")).alias("rows_refused"))
    feats = EVENT_BATCH.feature_names
    scored = checked.where("_ok").select("event_id", *feats, F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.expr(pred).cast("int").alias("_pred"),
                 (F.round(F.expr(prob).cast("double") * 100, 2) if prob else F.lit(None).cast("double")).alias("probability"))
        for name, (prob, pred) in RULE_MODELS.items()])))
    # the time of a stored row is the time it was appended; no report below reads it
    stored = scored.select("event_id", F.date_format(F.current_timestamp(), HISTORY_TIME_FORMAT).alias("timestamp"),
                           "model", "probability", risk_label("_pred").alias("prediction"),
                           *[F.col(c).cast("double").alias(c) for c in feats])
    path = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    clear_history(spark, path, feats)
    for part in (0, 1, 1, 0):
        append_history(stored.where(F.col("event_id") % 2 == part).drop("event_id"), path, batch=f"half-{part}")
    history = load_history(spark, path, feats)
    report = history.groupBy("model", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("avg_probability"),
        F.round(F.sum("value"), 4).alias("sum_value"), F.countDistinct("user_id").alias("n_users"))
    counts = seen.first()
    return report.select("*", F.lit(counts["rows_in"]).cast("long").alias("rows_in"),
                         F.lit(counts["rows_refused"]).cast("long").alias("rows_refused"))


#: Permuted rows that are shuffled at once, about.
PERMUTED_ROWS = 1 << 24


def importance_rules(spark, sf_dir):
    """E11 A15 A16 E18 T2 T3 T4 W10 on the rule models: accuracy drop over 30
    shuffles of each input of ``events``, one column per model, the team's mean,
    ranks per model and overall, and the top feature."""
    from tabrisk.plans.knn_queries import N_REPEATS, permuted_repeats, positions
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.expr(ACTUAL_SQL).cast("int").alias("label"),
        F.array(F.col("user_id").cast("double"), F.col("value").cast("double")).alias("vec"))
    names = ["user_id", "value"]

    def accuracy(rows):
        one = rows.select("feature", "rep", "label", F.col("vec")[0].cast("long").alias("user_id"), F.col("vec")[1].alias("value"))
        return one.groupBy("feature", "rep").agg(*[
            F.avg((F.expr(RULE_MODELS[m][1]) == F.col("label")).cast("double")).alias(m) for m in MODEL_NAMES])

    pos = positions(ev, "event_id")
    # a permuted row is shuffled twice: some repeats at a time, their files gone before the next ones
    at_once = max(1, PERMUTED_ROWS // max(1, pos.count() * len(names)))
    found = []                                                                                     # features x repeats rows
    with files_released(spark):
        plain = accuracy(ev.select("label", F.lit("None").alias("feature"), F.lit(-1).alias("rep"), "vec"))
        found += plain.collect()
        for r in range(0, N_REPEATS, at_once):
            found += accuracy(permuted_repeats(ev, pos, names, "event_id", range(r, min(r + at_once, N_REPEATS)))).collect()
    acc = spark.createDataFrame(found, plain.schema)
    base = [F.max(F.when(F.col("feature") == "None", F.col(m))).over(Window.partitionBy()) for m in MODEL_NAMES]
    drops = (acc.select("feature", *[F.round(b - F.col(m), 9).alias(m) for b, m in zip(base, MODEL_NAMES)])   # features x repeats
             .where("feature <> 'None'").groupBy("feature").agg(*[F.round(F.avg(m), 9).alias(m) for m in MODEL_NAMES]))
    team = drops.withColumn("team_average", F.round(sum(F.col(m) for m in MODEL_NAMES) / len(MODEL_NAMES), 9))

    def place(by):
        return F.row_number().over(Window.orderBy(F.col(by).desc(), "feature"))

    return team.select("*", place("team_average").alias("overall_rank"),
                       *[place(m).alias(f"{m.lower()}_rank") for m in MODEL_NAMES]).withColumn(
        "is_top", (F.col("overall_rank") == 1).cast("int"))


def rescore_pending(spark, sf_dir):
    """(document, model) pairs whose content hash was not scored
    by the model's current version.  Labeled documents were scored by every
    model at v1; SVM is now v2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    labeled = table(spark, sf_dir, "labels").select("doc_id")
    reg = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("version"))
                    for m, v in MODEL_VERSIONS.items()])
    scored = (docs.join(labeled, "doc_id", "left_semi")
                  .select("content_hash", F.inline(F.array(*[
                      F.struct(F.lit(m).alias("model"), F.lit("v1").alias("version"))
                      for m in MODEL_VERSIONS])))
                  .distinct())
    wanted = docs.select("doc_id", "content_hash", F.inline(reg))
    return wanted.join(scored, ["content_hash", "model", "version"], "left_anti") \
                 .select("doc_id", "model", "version", "content_hash")


MODEL_VERSIONS = {"ANN": "v1", "KNN": "v1", "SVM": "v2"}


def score_batch_long(spark, sf_dir):
    """Every event scored by every model, long form:
    display number in upload (key) order, class, risk label, probability
    (null for a model without one) and percent."""
    from tabrisk.functions.expressions import risk_label
    p = event_predictions(spark, sf_dir)
    pos = position_by_key(table(spark, sf_dir, "events").select("event_id"), "event_id", out="row_number")
    return (p.join(pos.withColumnRenamed("event_id", "row_id"), "row_id")
             .select("row_number", "row_id", "model", "prediction", risk_label("prediction").alias("risk"),
                     F.round("probability", 9).alias("probability"),
                     F.round(F.col("probability") * 100, 2).alias("percent")))


def score_batch_wide(spark, sf_dir):
    """E13 wide form: one row per event with its inputs and, per model, the
    risk label and percent (columns, no pivot shuffle: the models are
    column expressions on the same scan)."""
    from tabrisk.functions.expressions import risk_label
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    cols = []
    for name, (prob, pred) in RULE_MODELS.items():
        n = name.lower()
        cols.append(risk_label(F.expr(pred)).alias(f"{n}_risk"))
        pe = F.round(F.expr(prob).cast("double") * 100, 2) if prob else F.lit(None).cast("double")
        cols.append(pe.alias(f"{n}_percent"))
    pos = position_by_key(ev, "event_id", out="row_number")
    return pos.select("row_number", "event_id", "user_id", "value", *cols)


QUERIES = {
    "prep_scaled_by_split": prep_scaled_by_split,
    "confusion_matrix": confusion_matrix,
    "confusion_percent": confusion_percent,
    "classification_metrics": classification_metrics,
    "classification_report": classification_report,
    "roc_points": roc_points,
    "roc_auc": roc_auc,
    "model_comparison": model_comparison,
    "threshold_tuning": threshold_tuning,
    "contract_violations": contract_violations,
    "clean_rows": clean_rows,
    "numeric_coercion": numeric_coercion,
    "label_domain_and_empty": label_domain_and_empty,
    "provenance_audit": provenance_audit,
    "duplicate_rows": duplicate_rows,
    "dedupe_keep_first": dedupe_keep_first,
    "stratified_split_counts": stratified_split_counts,
    "stratified_folds": stratified_folds,
    "class_weights_gamma": class_weights_gamma,
    "history_report": history_report,
    "history_latest": history_latest,
    "history_full": history_full,
    "importance_rules": importance_rules,
    "batch_append_history": batch_append_history,
    "rescore_pending": rescore_pending,
    "score_batch_long": score_batch_long,
    "score_batch_wide": score_batch_wide,
}

from tabrisk.plans.knn_queries import KNN_QUERIES  # noqa: E402

QUERIES.update(KNN_QUERIES)

from tabrisk.plans.model_queries import MODEL_QUERIES  # noqa: E402

QUERIES.update(MODEL_QUERIES)

from tabrisk.plans.training_queries import TRAINING_QUERIES  # noqa: E402

QUERIES.update(TRAINING_QUERIES)

from tabrisk.plans.report_queries import REPORT_QUERIES  # noqa: E402

QUERIES.update(REPORT_QUERIES)
