"""The streaming scoring job appends scored rows to the history."""

import os

import pytest
from pyspark.errors import StreamingQueryException

from tabrisk.contract import PATIENT
from tabrisk.operators.models import fit_svm
from tabrisk.operators.prep import RiskPreprocessor
from tabrisk.sources.history import load_history
from tabrisk.streaming.scoring import start_scoring_stream

FEATS = PATIENT.feature_names


def test_stream_scores_good_rows_only(spark, tmp_dir):
    import random
    rnd = random.Random(2)
    rows = [(float(rnd.randint(0, 10)), float(rnd.randint(60, 200)), 70.0, 20.0, 80.0,
             float(rnd.randint(20, 45)), 0.5, float(rnd.randint(21, 70)), rnd.randint(0, 1)) for _ in range(60)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATS) + ", label int")
    prep = RiskPreprocessor(inputCols=FEATS, zeroMissingCols=PATIENT.zero_missing).fit(train)
    svm = fit_svm(prep.transform(train), FEATS, calibrate=False)
    inbox = os.path.join(tmp_dir, "in")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "batch1.csv"), "w") as f:
        f.write(",".join(FEATS) + "\n")
        f.write("2,120,70,20,80,30.5,0.5,33\n")
        f.write("2,abc,70,20,80,30.5,0.5,33\n")          # bad: non-numeric
        f.write("1,0,0,0,0,0,0.2,40\n")                  # zeros -> imputed
        f.write("1,NA,null,20,80,30.5,0.5,33\n")         # NA words -> imputed
    hist = os.path.join(tmp_dir, "history")
    q = start_scoring_stream(spark, inbox, hist, os.path.join(tmp_dir, "ckpt"), PATIENT, prep, [svm],
                             trigger_once=True)
    q.awaitTermination(120)
    h = load_history(spark, hist)
    assert h.count() == 3
    bad = spark.read.parquet(hist + "-violations")
    assert bad.count() == 1 and bad.first()["violations"][0]["rule"] == "non_numeric"  # rows in = good + bad
    assert {r["prediction"] for r in h.collect()} <= {"High Risk", "Low Risk"}


def test_stream_refuses_a_reordered_header(spark, tmp_dir):
    from tabrisk.streaming.scoring import text_stream
    with open(os.path.join(tmp_dir, "a.csv"), "w") as f:
        f.write("y,x\n20,2\n")
    q = (text_stream(spark, tmp_dir, ["x", "y"]).writeStream.format("noop")
         .option("checkpointLocation", os.path.join(tmp_dir, "_ckpt")).trigger(availableNow=True).start())
    with pytest.raises(StreamingQueryException):
        q.awaitTermination(120)
