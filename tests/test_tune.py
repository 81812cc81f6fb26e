"""Grid helpers and the driver-side quota rule."""

from tabrisk.operators.split import class_quotas, quota_table
from tabrisk.operators.tune import best_of, cv_grid, expand_grid


def test_expand_grid_order():
    g = expand_grid([{"b": [1, 2], "a": ["x", "y"]}, {"a": ["z"]}])
    assert g == [{"a": "x", "b": 1}, {"a": "x", "b": 2}, {"a": "y", "b": 1}, {"a": "y", "b": 2}, {"a": "z"}]


def test_quota_table_equals_dataframe_rule(spark):
    for counts in ({0: 500, 1: 268}, {"F": 4933, "O": 4979, "P": 5088}, {0: 3, 1: 3, 2: 1}, {0: 7}):
        rows = [(str(k), v) for k, v in counts.items()]
        df = spark.createDataFrame(rows, "c string, n_class long")
        q = {r["c"]: r["quota"] for r in class_quotas(df, "c").collect()}
        assert q == {str(k): v for k, v in quota_table(counts).items()}


def test_cv_grid_mean_std_and_best(spark):
    fit = spark.createDataFrame([(1,)], "x int")
    folds = {0: (fit, fit), 1: (fit, fit)}
    grid = [{"p": 1}, {"p": 2}, {"p": 3}]
    scores = {(1, 0): 0.5, (1, 1): 0.7, (2, 0): 0.8, (2, 1): 0.6, (3, 0): 0.1, (3, 1): 0.2}
    calls = []

    def fit_score(fit_rows, held, p):
        calls.append(p["p"])
        f = 0 if len([c for c in calls if c == p["p"]]) == 1 else 1
        return scores[(p["p"], f)]

    res = {r["grid_index"]: r for r in cv_grid(folds, grid, fit_score, parallelism=1).collect()}
    assert abs(res[0]["cv_accuracy_mean"] - 0.6) < 1e-12 and abs(res[1]["cv_accuracy_mean"] - 0.7) < 1e-12
    assert abs(res[0]["cv_accuracy_std"] - 0.1) < 1e-12
    assert best_of(cv_grid(folds, grid, lambda a, b, p: 0.5, parallelism=1)).first()["grid_index"] == 0
