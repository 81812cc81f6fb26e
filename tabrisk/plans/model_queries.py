"""Queries over fitted models (no SQL oracle: iterative, seeded fits).

The embeddings table (every dimension a feature) plays the patient table: stratified split,
folds, preprocessing fitted on training rows only, then the three model
families.  Outputs are checked by invariant tests (probabilities in [0, 1],
accuracy above the majority class, saved = loaded, ...).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabrisk.contract import EMBED_FEATURES, MODEL_NAMES, N_FOLDS
from tabrisk.functions.expressions import risk_label
from tabrisk.operators import metrics as M
from tabrisk.operators.crossfit import cross_fit_svm
from tabrisk.operators.mlp import persist_rows
from tabrisk.operators.models import KnnRiskModel, fit_mlp, fit_svm, kernel_error, load_models
from tabrisk.operators.prep import RiskPreprocessor, pooled_variance
from tabrisk.operators.ranking import position_by_key
from tabrisk.operators.split import split_and_folds
from tabrisk.operators.svm import SVMSet, train_svms
from tabrisk.operators.threshold import best_threshold, threshold_curve
from tabrisk.operators.tune import expand_grid
from tabrisk.operators.variants import variant_accuracy
from tabrisk.plans.knn_queries import DEFAULT_K, N_REPEATS, with_donors
from tabrisk.session import checkpoint_dir, cut_lineage
from tabrisk.sources.tables import embed_rows

FEATS = list(EMBED_FEATURES)


def prepared(spark: SparkSession, sf_dir: str):
    """(prep model, scaled train with folds, scaled test, scaled all rows)."""
    em = embed_rows(spark, sf_dir)
    sp = cut_lineage(split_and_folds(em, "label", ["vec_id"]))
    prep = RiskPreprocessor(inputCols=FEATS).fit(sp.where(F.col("split") == "train"))
    x = cut_lineage(prep.transform(sp))
    return prep, x.where(F.col("split") == "train"), x.where(F.col("split") == "test"), x


def gamma_scale(train: DataFrame, cols) -> float:
    """1 / (n_features * variance of every value), in one aggregate."""
    var = pooled_variance(train, cols)
    return 1.0 / (len(cols) * var) if var else 1.0 / len(cols)


def _predictions(model, test: DataFrame) -> DataFrame:
    n = model.name.lower()
    out = model.score(test)
    return out.select("vec_id", F.col("label").alias("actual"),
                      F.col(f"{n}_prediction").alias("prediction"),
                      F.round(f"{n}_probability", 9).alias("probability"))


def svm_linear_predict(spark, sf_dir):
    """E7 linear + E8 + E10: balanced linear SVM, calibrated by the folds left
    out, threshold tuned on probabilities whose models and sigmoids have not
    seen the row's fold (``operators.crossfit``)."""
    _, train, test, _ = prepared(spark, sf_dir)
    train = train.persist()
    m = cross_fit_svm(train, SVMSet(1.0, None, True), FEATS, N_FOLDS)
    best = best_threshold(threshold_curve(m.oof.withColumn("model", F.lit("SVM")), actual="label")).first()
    m.threshold = float(best["threshold"])
    train.unpersist()
    return m.score(test, ["vec_id", "label"]).select(
        "vec_id", F.col("label").alias("actual"), "prediction", F.round("probability", 9).alias("probability"),
        F.lit(m.threshold).alias("threshold"))


def svm_rbf_predict(spark, sf_dir):
    """E7 rbf (Nystroem landmarks, gamma = 'scale') + E8, with the map's error
    against exact kernels of a sample of rows."""
    _, train, test, _ = prepared(spark, sf_dir)
    m = fit_svm(train, FEATS, kernel="rbf", C=1.0, gamma=gamma_scale(train, FEATS))
    return _predictions(m, test).withColumn("kernel_error", F.lit(round(kernel_error(train, m.pipeline.stages[0]), 9)))


def platt_calibration(spark, sf_dir):
    """The sigmoid's A and B, and how well the calibrated test
    probabilities score (Brier, log loss, accuracy at 0.5)."""
    _, train, test, _ = prepared(spark, sf_dir)
    m = fit_svm(train, FEATS, kernel="linear", C=1.0)
    p = m.score(test)
    pr = F.col("svm_probability")
    y = F.col("label")
    return p.agg(
        F.avg((pr - y) * (pr - y)).alias("brier"),
        F.avg(-(y * F.log(F.greatest(pr, F.lit(1e-15)))
                + (1 - y) * F.log(F.greatest(1 - pr, F.lit(1e-15))))).alias("log_loss"),
        F.avg((F.col("svm_prediction") == y).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("test_rows")).select(
        F.lit("SVM").alias("model"),
        F.lit(m.platt.getOrDefault(m.platt.a)).alias("a"), F.lit(m.platt.getOrDefault(m.platt.b)).alias("b"),
        "brier", "log_loss", "accuracy", "test_rows")


def mlp_predict(spark, sf_dir):
    """E5: multilayer perceptron (16, 8) on the scaled features."""
    _, train, test, _ = prepared(spark, sf_dir)
    return _predictions(fit_mlp(train, FEATS), test)


def _three_models(train: DataFrame, calibrate: bool = True):
    return {
        "ANN": fit_mlp(train, FEATS, "ANN"),
        "KNN": KnnRiskModel("KNN", train, FEATS, k=DEFAULT_K),
        "SVM": fit_svm(train, FEATS, "SVM", kernel="rbf", C=1.0, gamma=gamma_scale(train, FEATS),
                       calibrate=calibrate),
    }


def score_all(models: dict, df: DataFrame) -> DataFrame:
    """Every model on the same frame, one after the other (each adds two
    columns; only KNN needs a join)."""
    out = df
    for m in models.values():
        out = m.score(out)
    return out


def model_comparison_fitted(spark, sf_dir):
    """Accuracy, precision, recall, F1, AUC and the confusion
    counts of the three fitted models on the held-out rows."""
    _, train, test, _ = prepared(spark, sf_dir)
    scored = score_all(_three_models(train), test)
    long = scored.select("vec_id", F.col("label").alias("actual"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"{n.lower()}_prediction").alias("prediction"),
                 F.col(f"{n.lower()}_probability").alias("probability")) for n in MODEL_NAMES])))
    return M.model_comparison(long)


def score_fitted_wide(spark, sf_dir):
    """A batch (all rows) scored by every model; display number (W4),
    inputs, and per model the risk label (P15) and percent probability (F3)."""
    _, train, _, allx = prepared(spark, sf_dir)
    raw = embed_rows(spark, sf_dir)
    scored = score_all(_three_models(train), allx.select("vec_id", "label", *FEATS))
    numbered = position_by_key(raw, "vec_id", out="row_number")
    cols = []
    for n in MODEL_NAMES:
        c = n.lower()
        cols += [risk_label(f"{c}_prediction").alias(f"{c}_risk"),
                 F.round(F.col(f"{c}_probability") * 100, 2).alias(f"{c}_percent")]
    return numbered.join(scored.select("vec_id", *cols), "vec_id")


def importance_ranked(spark, sf_dir):
    """Permutation importance of the three
    default models, one column per model, team average, rank per model and
    overall (every permutation is scored in one pass per model)."""
    _, train, test, _ = prepared(spark, sf_dir)
    models = _three_models(train, calibrate=False)
    as_rows = lambda df: df.select("vec_id", "label", F.array(*FEATS).alias("vec"))
    asked = cut_lineage(with_donors(as_rows(test), FEATS))
    names = F.array(*[F.lit(f) for f in FEATS])
    drops = None
    for name, m in models.items():
        # the rows are not copied: what one feature adds to a distance or a sum is exchanged
        if name == "KNN":
            right = variant_accuracy(as_rows(train), asked, [DEFAULT_K], N_REPEATS)
        else:
            right = m.score_variants(asked, N_REPEATS)
        acc = right.select(F.coalesce(F.get(names, F.col("feature")), F.lit("None")).alias("feature"), "rep", (F.col("correct") / F.col("n")).alias("acc"))
        base = F.max(F.when(F.col("feature") == "None", F.col("acc"))).over(Window.partitionBy())
        d = (acc.withColumn("drop", base - F.col("acc")).where(F.col("feature") != "None")
                .groupBy("feature").agg(F.avg("drop").alias(name)))
        drops = d if drops is None else drops.join(d, "feature")
    team = sum(F.col(n) for n in MODEL_NAMES) / len(MODEL_NAMES)
    out = drops.withColumn("team_average", team)
    out = out.withColumn("overall_rank", F.row_number().over(
        Window.orderBy(F.col("team_average").desc(), F.col("feature"))))          # one row per feature
    for n in MODEL_NAMES:
        out = out.withColumn(f"{n.lower()}_rank", F.row_number().over(
            Window.orderBy(F.col(n).desc(), F.col("feature"))))
    return out.select("feature", *[F.round(n, 4).alias(n) for n in MODEL_NAMES],
                      F.round("team_average", 4).alias("team_average"), "overall_rank",
                      *[f"{n.lower()}_rank" for n in MODEL_NAMES],
                      (F.col("overall_rank") == 1).cast("int").alias("is_top"))


def saved_model_check(spark, sf_dir):
    """Save the preprocessing and the three models (the SVM with
    its calibration and a threshold), load what the registry finds, score the
    raw test rows with both and compare classes and probabilities."""
    from tabrisk.operators.prep import RiskPreprocessorModel
    prep, train, test, _ = prepared(spark, sf_dir)
    models = _three_models(train)
    models["SVM"].threshold = 0.45
    root = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    prep.write().overwrite().save(f"{root}/preprocessor")
    for name, m in models.items():
        m.save(spark, f"{root}/{name}")
    loaded, prep2 = load_models(spark, root), RiskPreprocessorModel.load(f"{root}/preprocessor")
    raw = cut_lineage(embed_rows(spark, sf_dir).join(test.select("vec_id"), "vec_id", "left_semi"))
    a, b = (score_all(ms, p.transform(raw)).select("vec_id", *[
        F.struct(f"{n.lower()}_prediction", F.round(f"{n.lower()}_probability", 9)).alias(f"{n}_{side}") for n in MODEL_NAMES])
        for ms, p, side in ((models, prep, "a"), (loaded, prep2, "b")))
    both = a.join(b, "vec_id").select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"{n}_a").eqNullSafe(F.col(f"{n}_b")).alias("same")) for n in MODEL_NAMES])))
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("rows_scored"),
                                     F.count_if("same").alias("same_predictions")).select(
        "model", "rows_scored", "same_predictions",
        (F.col("rows_scored") == F.col("same_predictions")).cast("int").alias("passed"))


# --- Fixed values: the search grid of the SVM ---
SVM_GRID = [{"kernel": ["rbf"],
             "C": [0.05, 0.1, 0.3, 0.5, 1, 2, 3, 5, 10, 30, 100],
             "gamma": ["scale", "auto", 0.001, 0.003, 0.005, 0.01, 0.03, 0.05, 0.1, 0.3],
             "class_weight": [None, "balanced"]},
            {"kernel": ["linear"],
             "C": [0.001, 0.003, 0.01, 0.03, 0.05, 0.1, 0.3, 0.5, 1, 3, 10],
             "class_weight": [None, "balanced"]}]
# ---------------------------------------------------------------------------


def _svm_set(p: dict) -> SVMSet:
    return SVMSet(float(p["C"]), p.get("gamma"), p["class_weight"] == "balanced")


def svm_results(spark, sf_dir, grid=SVM_GRID):
    """5-fold CV accuracy of every set of the SVM's grid (linear: C x class
    weight; rbf: C x gamma x class weight), preprocessing refit per fold, all
    fits in the same passes (``operators.svm``)."""
    from tabrisk.plans.mlp_queries import REFIT, cv_long_table
    sets = expand_grid(grid)
    long, _ = cv_long_table(spark, sf_dir)
    long = persist_rows(long.where(F.col("group") != REFIT))
    fitted = train_svms(long, FEATS, [_svm_set(p) for p in sets])
    long.unpersist()
    rows = [(i, fold, f["correct"] / f["n"], int(f["converged"]), f["n_iter"])
            for (fold, i), f in fitted.items() if f["n"]]
    acc = spark.createDataFrame(rows, "grid_index int, fold int, acc double, converged int, n_iter int")
    params = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(sets)], "grid_index int, params string")
    agg = acc.groupBy("grid_index").agg(
        F.round(F.avg("acc"), 12).alias("cv_accuracy_mean"), F.round(F.stddev_pop("acc"), 12).alias("cv_accuracy_std"),
        F.sum("converged").alias("folds_converged"), F.max("n_iter").alias("max_iterations"))
    return agg.join(params, "grid_index").select(
        "grid_index", "params", "cv_accuracy_mean", "cv_accuracy_std", "folds_converged", "max_iterations")


MODEL_QUERIES = {
    "svm_linear_predict": svm_linear_predict,
    "svm_rbf_predict": svm_rbf_predict,
    "platt_calibration": platt_calibration,
    "mlp_predict": mlp_predict,
    "model_comparison_fitted": model_comparison_fitted,
    "score_fitted_wide": score_fitted_wide,
    "importance_ranked": importance_ranked,
    "saved_model_check": saved_model_check,
}
