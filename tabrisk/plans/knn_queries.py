"""KNN queries: prediction, grid search, ablation, permutation importance.

Inputs are the ``embeddings`` table with every dimension as a feature
(class = label < 5).  Folds are join keys of one neighbour run a metric
(``operators.knn.neighbours``); ablation and permutation take one feature at a
time, all of them in one pass of updated distances (``operators.variants``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabrisk.contract import EMBED_FEATURES, N_FOLDS, RANDOM_STATE
from tabrisk.functions.expressions import hash_key, strip_param_prefix
from tabrisk.operators.knn import grid_votes, neighbours, vote
from tabrisk.operators.permute import handed_over
from tabrisk.operators.prep import RiskPreprocessor
from tabrisk.operators.ranking import ROWS_PER_BUCKET, bucketed_row_number
from tabrisk.operators.split import bucket_digits, split_and_folds, stratified_split
from tabrisk.operators.variants import variant_accuracy
from tabrisk.session import cut_lineage, run_parallel
from tabrisk.sources.tables import embed_full

# --- Fixed values: the KNN search grid (order is the grid order) -------------
KNN_K = (3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 25, 31)
KNN_WEIGHTS = ("uniform", "distance")
KNN_METRICS = ("euclidean", "manhattan")
DEFAULT_K = 15          # the quick default model of the importance report
N_REPEATS = 30          # permutation repeats per feature
# ---------------------------------------------------------------------------

FEATS = list(EMBED_FEATURES)


def _statistics(train: DataFrame) -> tuple[list[float], list[float], list[float]]:
    """Median, minimum and span of every dimension of ``vec``."""
    cols = train.select(*[F.col("vec")[i].alias(c) for i, c in enumerate(FEATS)])
    fitted = RiskPreprocessor(inputCols=FEATS).fit(cols).stats()
    stats = [fitted[c] for c in FEATS]
    return [m for m, _, _ in stats], [lo for _, lo, _ in stats], [hi - lo if hi > lo else 1.0 for _, lo, hi in stats]


def _scaled(vec: str, med: Column, lo: Column, span: Column) -> Column:
    """Impute, scale and clip the whole vector (arrays of statistics)."""
    return F.transform(vec, lambda v, i: F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), (F.coalesce(F.nanvl(v, F.lit(None).cast("double")), med[i]) - lo[i]) / span[i])))


def _scaled_split(spark: SparkSession, sf_dir: str):
    """Embeddings -> stratified split -> preprocessing fitted on train ->
    (train, test) with ``vec`` = the scaled features."""
    sp = cut_lineage(stratified_split(embed_full(spark, sf_dir), "label", ["vec_id"]))
    med, lo, span = _statistics(sp.where(F.col("split") == "train"))
    x = sp.withColumn("vec", _scaled("vec", F.lit(med), F.lit(lo), F.lit(span)))
    return x.where(F.col("split") == "train"), x.where(F.col("split") == "test")


def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 nearest training vectors (64 dims, Euclidean) of every
    test vector; class by uniform vote, probability = share of class 1."""
    sp = stratified_split(embed_full(spark, sf_dir), "label", ["vec_id"])
    train = sp.where(F.col("split") == "train").withColumnRenamed("vec_id", "tid")
    test = sp.where(F.col("split") == "test").select(F.col("vec_id").alias("qid"), F.col("label").alias("actual"), "vec")
    nb = neighbours(train, test, DEFAULT_K, "euclidean", qkeys=("qid", "actual"))
    v = vote(nb, DEFAULT_K, "uniform", keys=("qid", "actual"))
    return v.select(F.col("qid").alias("vec_id"), "actual", "prediction",
                    F.round("probability", 9).alias("probability"))


def _cv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with a fold, scaled once per fold with the statistics of
    the other folds (no leakage), as one long table keyed by ``stat_fold``."""
    sp = split_and_folds(embed_full(spark, sf_dir), "label", ["vec_id"])
    train = cut_lineage(sp.where(F.col("split") == "train").select("vec_id", "label", "fold", "vec"))
    fits = run_parallel(lambda f: _statistics(train.where(F.col("fold") != f)), list(range(N_FOLDS)), N_FOLDS)
    scales = F.array(*[F.struct(F.lit(f).alias("stat_fold"), F.lit(med).alias("_med"), F.lit(lo).alias("_lo"),
                                F.lit(span).alias("_span")) for f, (med, lo, span) in enumerate(fits)])
    long = train.select("*", F.inline(scales))
    return long.select("vec_id", "label", "fold", "stat_fold",
                       _scaled("vec", F.col("_med"), F.col("_lo"), F.col("_span")).alias("vec"))


def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 parameter sets x 5 folds from two neighbour runs (one
    per metric, 31 nearest): every k and weighting is read off the same
    neighbour table.  Mean and population std of fold accuracy, rank."""
    cv = _cv_table(spark, sf_dir)
    q = cv.where(F.col("fold") == F.col("stat_fold")).select(
        F.col("vec_id").alias("qid"), F.col("label").alias("q_label"), "stat_fold", "vec")
    t = cv.where(F.col("fold") != F.col("stat_fold")).select(
        F.col("vec_id").alias("tid"), "label", "stat_fold", "vec")
    kmax = max(KNN_K)
    q, t = cut_lineage(q), cut_lineage(t)
    # one run a metric, submitted together
    runs = run_parallel(lambda m: neighbours(t, q, kmax, m, qkeys=("qid", "q_label"), same_on=("stat_fold",)).withColumn(
        "metric", F.lit(m)), KNN_METRICS)
    nbs = runs[0].unionByName(runs[1])
    votes = grid_votes(nbs, list(KNN_K), keys=("qid", "q_label", "stat_fold", "metric"))
    acc = (votes.groupBy("metric", "k", "weights", "stat_fold")
                .agg(F.avg((F.col("prediction") == F.col("q_label")).cast("double")).alias("acc")))
    res = acc.groupBy("metric", "k", "weights").agg(
        F.round(F.avg("acc"), 12).alias("cv_accuracy_mean"),
        F.round(F.stddev_pop("acc"), 12).alias("cv_accuracy_std"))
    m_idx = F.when(F.col("metric") == KNN_METRICS[0], 0).otherwise(1)
    k_idx = F.array_position(F.array(*[F.lit(x) for x in KNN_K]), F.col("k")).cast("int") - 1
    w_idx = F.when(F.col("weights") == KNN_WEIGHTS[0], 0).otherwise(1)
    res = res.withColumn("grid_index", (m_idx * (len(KNN_K) * 2) + k_idx * 2 + w_idx).cast("int"))
    w = Window.orderBy(F.col("cv_accuracy_mean").desc())           # 48 rows
    return res.select(
        "metric", F.col("k").cast("int").alias("n_neighbors"), "weights", "grid_index",
        F.round("cv_accuracy_mean", 9).alias("cv_accuracy_mean"),
        F.round("cv_accuracy_std", 9).alias("cv_accuracy_std"),
        F.rank().over(w).alias("rank_test_score"))


def best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parameter set (first in grid order on ties) as
    a JSON object without the pipeline prefix."""
    g = knn_grid(spark, sf_dir)
    w = Window.orderBy(F.col("cv_accuracy_mean").desc(), F.col("grid_index"))
    best = g.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    params = F.create_map(F.lit("model__metric"), F.col("metric"),
                          F.lit("model__n_neighbors"), F.col("n_neighbors").cast("string"),
                          F.lit("model__weights"), F.col("weights"))
    return best.select(F.lit("KNN").alias("model"), F.to_json(strip_param_prefix(params)).alias("best_params"),
                       "grid_index", "cv_accuracy_mean", "cv_accuracy_std")


def _knn_ablation(spark, sf_dir, ks=(DEFAULT_K,)) -> DataFrame:
    train, test = _scaled_split(spark, sf_dir)
    votes = variant_accuracy(train, test, list(ks))
    acc = votes.select("k", F.coalesce(F.get(F.array(*[F.lit(c) for c in FEATS]), F.col("feature")), F.lit("None")).alias("removed"),
                       (F.col("correct") / F.col("n")).alias("accuracy"))
    base = F.max(F.when(F.col("removed") == "None", F.col("accuracy"))).over(Window.partitionBy("k"))
    return acc.withColumn("accuracy_change", F.col("accuracy") - base)


def knn_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with every feature and with each one left out,
    and the change against the full set (one pass, updated distances)."""
    a = _knn_ablation(spark, sf_dir)
    return a.select(F.lit("KNN").alias("model"), F.col("removed").alias("removed_feature"),
                    F.round("accuracy", 9).alias("accuracy"),
                    F.round("accuracy_change", 9).alias("accuracy_change"))


ABLATION_MODELS = {"KNN5": 5, "KNN15": 15, "KNN31": 31}


def ablation_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablation reports of three models side by side on
    the removed feature (one pivot instead of two outer joins)."""
    a = _knn_ablation(spark, sf_dir, ks=tuple(ABLATION_MODELS.values()))
    names = {v: k for k, v in ABLATION_MODELS.items()}
    a = a.withColumn("model", F.element_at(F.create_map(*[x for kk, nn in names.items()
                                                          for x in (F.lit(kk), F.lit(nn))]), F.col("k")))
    wide = a.groupBy(F.col("removed").alias("removed_feature")).pivot("model", list(ABLATION_MODELS)).agg(
        F.first(F.round("accuracy", 9)).alias("accuracy"), F.first(F.round("accuracy_change", 9)).alias("change"))
    return wide


def positions(test: DataFrame, row_id: str = "vec_id") -> DataFrame:
    """(row_id, vec, ``_pos``), the position by id, from which permutations are dealt."""
    from tabrisk.operators.ranking import position_by_key
    return cut_lineage(position_by_key(test.select(row_id, "vec"), row_id, out="_pos"))


def permutation_donors(pos: DataFrame, features: list[str], row_id: str = "vec_id",
                       repeats: list[int] = range(N_REPEATS), seed: int = RANDOM_STATE) -> DataFrame:
    """E11 input: (row_id, feature number, rep, donor) for every (feature, repeat).

    Row i (position by id, ``positions``) takes the value of the row whose position in
    md5('seed-feature-repeat-id') order is i, handed over by an equi-join on
    the position.  Up to ``ROWS_PER_BUCKET`` rows a (feature, repeat) is ranked
    by itself; larger tables are ranked by buckets of the hash (ranking.py), so
    no task ever ranks a whole test set."""
    return _donors(pos, pos, features, row_id, repeats, seed, [])


def _donors(pos: DataFrame, test: DataFrame, features: list[str], row_id: str, repeats, seed: int, keep: list[str]) -> DataFrame:
    """``permutation_donors`` with the columns ``keep`` of the row that receives
    (rows of equal ids: each of them), joined before the rows are repeated."""
    n = pos.count()
    names = F.array(*[F.lit(f) for f in features])
    reps = F.explode(F.array(*[F.lit(r) for r in repeats])).alias("rep")
    long = (pos.select(row_id, F.posexplode("vec").alias("feature", "donor"))
               .select("*", F.get(names, F.col("feature")).alias("_name"), reps))
    # half the bytes of the hexadecimal text, in the same order
    donors = long.select("feature", "rep", "donor", F.unhex(hash_key(seed, "_name", "rep", row_id)).alias("_h"))
    if n <= ROWS_PER_BUCKET:
        rank = F.row_number().over(Window.partitionBy("feature", "rep").orderBy("_h")).cast("long")
        donors = donors.withColumn("_pos", rank)
    else:
        digits = bucket_digits(n)
        donors = donors.withColumn("_b", F.substring(F.hex("_h"), 1, digits))
        donors = bucketed_row_number(donors, ["feature", "rep"], "_b", ["_h"], out="_pos")
    rows = pos.select("_pos", row_id)
    if keep:
        rows = rows.join(test.select(row_id, *keep).hint("shuffle_hash"), row_id)
    # hashed by the executors: neither side is sorted, sent to the driver or broadcast
    return donors.select("feature", "rep", "_pos", "donor").join(rows.hint("shuffle_hash"), "_pos").select(
        row_id, *keep, "feature", "rep", "donor")


def with_donors(test: DataFrame, features: list[str], row_id: str = "vec_id", repeats: int = N_REPEATS) -> DataFrame:
    """Test rows with ``donors``: features x repeats values, in that order
    (an array of fixed length, set by the features and repeats).

    Up to ``ROWS_PER_BUCKET`` rows, a task ranks the repeats of a feature in
    turn (``operators.permute``), so only the values that are handed over are
    ever written; beyond that they are ranked as rows (``permutation_donors``)."""
    pos = positions(test, row_id)
    n, ids = pos.agg(F.count(F.lit(1)), F.countDistinct(row_id)).first()
    if n <= ROWS_PER_BUCKET:
        if n == ids:
            return handed_over(pos, test.join(pos.select(row_id, "_pos"), row_id), features, row_id, repeats, RANDOM_STATE)
        # rows of one id: each has what all of them get
        rows = handed_over(pos, pos.select(row_id, "_pos"), features, row_id, repeats, RANDOM_STATE).groupBy(row_id).agg(
            F.collect_list("donors").alias("_d"))
        rows = rows.select(row_id, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(features) * repeats - 1)), lambda i: F.array_sort(
            F.transform("_d", lambda d: F.get(d, i))))).alias("donors"))
        return test.join(rows.hint("merge"), row_id)
    rows = permutation_donors(pos, features, row_id, range(repeats)).groupBy(row_id).agg(
        F.sort_array(F.collect_list(F.struct("feature", "rep", "donor"))).alias("_d"))
    return test.join(rows.select(row_id, F.col("_d.donor").alias("donors")).hint("merge"), row_id)


def permuted_rows(test: DataFrame, features: list[str], row_id: str = "vec_id", repeats: int = N_REPEATS) -> DataFrame:
    """For models that score whole rows: every test row once for each
    (feature, repeat) with that feature's value taken from its donor, and
    unchanged as feature 'None'."""
    shuffled = permuted_repeats(test, positions(test, row_id), features, row_id, range(repeats))
    plain = test.select(row_id, "label", F.lit("None").alias("feature"), F.lit(-1).alias("rep"), "vec")
    return shuffled.unionByName(plain)


def permuted_repeats(test: DataFrame, pos: DataFrame, features: list[str], row_id: str, repeats) -> DataFrame:
    """The rows of ``permuted_rows`` for some of the repeats, without the unchanged ones."""
    rows = test.select(row_id, "label", "vec")
    return _donors(pos, rows, features, row_id, repeats, RANDOM_STATE, ["label", "vec"]).withColumnRenamed("feature", "_f").select(
        row_id, "label", F.get(F.array(*[F.lit(f) for f in features]), F.col("_f")).alias("feature"), "rep",
        F.transform("vec", lambda v, i: F.when(i == F.col("_f"), F.col("donor")).otherwise(v)).alias("vec"))


def importance_of(accuracy: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean drop, std of the drop) from (feature, rep, acc); the
    unchanged rows have feature -1."""
    base = F.max(F.when(F.col("feature") == -1, F.col("acc"))).over(Window.partitionBy())   # features x repeats rows
    drops = accuracy.withColumn("drop", base - F.col("acc")).where(F.col("feature") >= 0)
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std")).select(
        F.get(F.array(*[F.lit(f) for f in features]), F.col("feature")).alias("feature"), "mean", "std")


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and std of the accuracy drop of the 15-NN model over
    30 shuffles of each of the 64 features on the test rows; all variants and
    the baseline in one pass of updated distances."""
    train, test = _scaled_split(spark, sf_dir)
    votes = variant_accuracy(train, with_donors(test, FEATS), [DEFAULT_K], N_REPEATS)
    acc = votes.select("feature", "rep", (F.col("correct") / F.col("n")).alias("acc"))
    return importance_of(acc, FEATS).select(
        F.lit("KNN").alias("model"), "feature", F.round("mean", 9).alias("importance_mean"),
        F.round("std", 9).alias("importance_std"))


KNN_QUERIES = {
    "knn_predict": knn_predict,
    "knn_grid": knn_grid,
    "best_params": best_params,
    "knn_ablation": knn_ablation,
    "ablation_outer_join": ablation_outer_join,
    "permutation_importance": permutation_importance,
}
