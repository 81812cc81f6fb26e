"""Contract checks (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from tabrisk.contract import PATIENT
from tabrisk.operators import validate as V

FEATS = PATIENT.feature_names


def _text_frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(["row_id long"] + [f"{c} string" for c in FEATS]))


GOOD = ["2", "120", "70", "20", "80", "30.5", "0.5", "33"]


def test_non_numeric_rows_reported(spark):
    rows = [(i + 2, *([GOOD[0], bad] + GOOD[2:])) for i, bad in enumerate(["abc", "5d", "1,000"])]
    rep = V.violation_report(V.violations(_text_frame(spark, rows), PATIENT, "row_id", text=True)).collect()
    assert len(rep) == 1
    r = rep[0]
    assert (r["column"], r["rule"], r["n_bad"], r["first_rows"]) == ("Glucose", "non_numeric", 3, "2,3,4")


@pytest.mark.parametrize("col", FEATS)
def test_range_edges(spark, col):
    rule = PATIENT.rule(col)
    vals = [rule.low, rule.high, rule.low - 1, rule.high + 1, None]
    rows = []
    for i, v in enumerate(vals):
        row = list(GOOD)
        row[FEATS.index(col)] = None if v is None else str(v)
        rows.append((i + 2, *row))
    viol = V.violations(_text_frame(spark, rows), PATIENT, "row_id", text=True).where(F.col("rule") == "range")
    assert sorted(r["row_id"] for r in viol.collect()) == [4, 5]


def test_whole_number_rule(spark):
    row = list(GOOD)
    row[FEATS.index("Age")] = "35.5"
    v = V.violations(_text_frame(spark, [(2, *row)]), PATIENT, "row_id", text=True).collect()
    assert [(r["column"], r["rule"]) for r in v] == [("Age", "whole_number")]


def test_first_ten_rows_only(spark):
    rows = []
    for i in range(12):
        row = list(GOOD)
        row[FEATS.index("BMI")] = "99"
        rows.append((i + 2, *row))
    r = V.violation_report(V.violations(_text_frame(spark, rows), PATIENT, "row_id", text=True)).first()
    assert r["n_bad"] == 12 and r["first_rows"] == ",".join(str(i) for i in range(2, 12))


def test_missing_column_named_and_extra_reported():
    with pytest.raises(V.ContractError, match="Glucose, BMI"):
        V.check_schema([c for c in FEATS if c not in ("Glucose", "BMI")], PATIENT)
    assert V.check_schema(FEATS + ["Notes"], PATIENT) == ["Notes"]


def test_empty_and_all_zero_feature(spark):
    from tabrisk.operators.prep import RiskPreprocessor
    df = spark.createDataFrame([(None, 0.0), (None, 0.0), (None, 0.0), (None, 0.0)], "a double, b double")
    assert V.empty_columns(df, ["a", "b"]) == ["a"]
    with pytest.raises(ValueError, match="b"):
        RiskPreprocessor(inputCols=["b"], zeroMissingCols=["b"]).fit(df.select("b"))


def test_label_domain(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "Outcome int")
    assert V.label_domain_bad(df, "Outcome").count() == 2


def test_raise_on_violations(spark):
    row = list(GOOD)
    row[FEATS.index("Insulin")] = "1000"
    with pytest.raises(V.ContractError, match="Insulin"):
        V.raise_on_violations(V.violations(_text_frame(spark, [(2, *row)]), PATIENT, "row_id", text=True))


def test_split_valid(spark):
    rows = [(2, *GOOD), (3, *(["99"] + GOOD[1:]))]
    df = _text_frame(spark, rows)
    good, bad = V.split_valid(df, V.violations(df, PATIENT, "row_id", text=True), "row_id")
    assert [r["row_id"] for r in good.collect()] == [2] and [r["row_id"] for r in bad.collect()] == [3]
