import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from tabrisk.llm import mixing
from tabrisk.llm.queries import ORACLE, QUERIES
from tabrisk.plans import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, topic string, p string, weight int"


def rows(seed=5, n=300):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice(["word", "WORD%", "a|b", "x#"]) for _ in range(rng.choice([1, 30, 200]))), rng.choice(["en", "de", None]),
            rng.choice(["hot"] * 6 + ["a", "b", None]), 1, "clash", "p", 2) for i in range(n)]
    return out + [(900, None, "en", "hot", None, "", "", 0), (901, "", "xx", "only", 0, "", "", 0), (0, *out[0][1:]), (None, "word " * 20, "en", "a", 0, "", "", 0),
                  (902, "long " * 40000, "en", "b", 0, "", "", 0)]


def topic(text):
    text = text or ""
    n = len(text)
    if not n:
        return "prose"
    if 20 * len(re.findall(r"[#*$%&]", text)) >= n:
        return "symbols"
    if 3 * len(re.findall("[A-Z]", text)) >= n:
        return "caps"
    return "table" if 50 * text.count("|") >= n else "prose"


def uniform(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:13], 16) / 16 ** 13


def test_rake_meets_the_marginals():
    rng = np.random.default_rng(0)
    w = rng.random(60) * 100
    codes = [np.arange(60) % 5, np.arange(60) // 5 % 3, np.arange(60) // 15]
    targets = [rng.dirichlet(np.ones(k)) * 1000 for k in (5, 3, 4)]
    out = mixing.rake(w, codes, targets, 200)
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, out), target, rtol=1e-6)


def test_calibrate():
    rng = np.random.default_rng(1)
    for _ in range(50):
        tokens = rng.integers(0, 50, 12)
        weight = rng.random(12) * tokens
        p = mixing.calibrate(tokens, weight, 0.6)
        assert ((p >= 0) & (p <= 1)).all() and (p[tokens == 0] == 1).all()
        if (weight > 0).all() or tokens[weight > 0].sum() > 0.6 * tokens.sum():
            assert np.isclose(p @ tokens, 0.6 * tokens.sum())
            free = (p < 1) & (tokens > 0)
            s = p[free] * tokens[free] / np.maximum(weight[free], 1e-12)
            assert np.allclose(s, s.mean()) if free.any() else True
    assert (mixing.calibrate(np.zeros(3, int), np.zeros(3)) == 1).all()


def test_given_targets():
    cells = pd.DataFrame({"source": ["a", "a", "b", "b"], "lang": ["x", "y"] * 2, "topic": ["t"] * 4, "tokens": [400, 400, 100, 100]})
    done = mixing.probabilities(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 1.0}}, budget=0.4)
    assert np.allclose(done["p"], [0.25, 0.25, 1, 1])


def test_mix_against_brute_force(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    cells = pd.DataFrame([(str(r[3]), str(r[2]), topic(r[1]), len((r[1] or "").split())) for r in data], columns=["source", "lang", "topic", "tokens"])
    table = mixing.probabilities(cells.groupby(["source", "lang", "topic"], as_index=False).sum())
    p = {(r.source, r.lang, r.topic): r.p for r in table.itertuples()}
    want = sorted((str(r[0]), t, n, round(p[(str(r[3]), str(r[2]), t)], 9), uniform(r[0]) < p[(str(r[3]), str(r[2]), t)])
                  for r in data for t, n in [(topic(r[1]), len((r[1] or "").split()))])
    assert sorted((str(r["doc_id"]), r["topic"], r["tokens"], round(r["p"], 9), r["kept"]) for r in got) == want
    assert 0 < sum(r["kept"] for r in got) < len(got)


def test_sample_keeps_the_mixed_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = mixing.sample(df)
    assert kept.columns == df.columns
    want = sorted(str(r["doc_id"]) for r in mixing.mix(df).collect() if r["kept"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


@pytest.mark.parametrize("targets", [None, {"_source": {"=hot": 0.2, "=a": 0.5}, "_topic": {"prose": 0.9, "caps": 0.1}}])
def test_large_cell_tables_stay_in_spark(spark, targets):
    """Grouped sums and exact steps give what the driver's arrays give."""
    celled = mixing.with_cells(spark.createDataFrame(rows(), SCHEMA).select("text", "source", "lang"), "text", False)
    sums = celled.groupBy("_source", "_lang", "_topic").agg(mixing.F.sum("_tokens").alias("tokens"))
    targets = {k[1:]: v for k, v in targets.items()} if targets else None
    want = mixing.probabilities(sums.toPandas().rename(columns=lambda c: c.lstrip("_")), targets, sweeps=3)
    got = mixing.large_cell_probabilities(sums, targets, mixing.BUDGET, mixing.POWER, sweeps=3).toPandas()
    both = want.merge(got, left_on=["source", "lang", "topic"], right_on=["_source", "_lang", "_topic"])
    assert len(both) == len(want) == len(got)
    assert np.allclose(both["weight_x"], both["weight_y"]) and np.allclose(both["p_x"], both["p_y"])


def test_mix_does_not_depend_on_where_cells_are(spark, monkeypatch):
    df = spark.createDataFrame(rows(n=40), SCHEMA)
    want = sorted((str(r["doc_id"]), round(r["p"], 9), r["kept"]) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    assert sorted((str(r["doc_id"]), round(r["p"], 9), r["kept"]) for r in mixing.mix(df).collect()) == want


def test_calibrated_against_the_arrays(spark):
    rng = np.random.default_rng(2)
    for k in range(6):
        tokens = rng.integers(0, 50, 15)
        weight = rng.random(15) * tokens * rng.integers(0, 2, 15) ** (k % 2)
        weight = weight * (k != 5)
        df = spark.createDataFrame([(i, int(t), float(w)) for i, (t, w) in enumerate(zip(tokens, weight))], "i int, tokens long, weight double")
        for budget in (0.3, 0.9):
            got = [r["p"] for r in sorted(mixing.calibrated(df, budget).collect())]
            assert np.allclose(got, mixing.calibrate(tokens, weight, budget)), (k, budget)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).collect() == [] and mixing.sample(df).collect() == []


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    ok, said = check.compare(QUERIES["op4_mixing"](spark, sf), ORACLE["op4_mixing"], sf)
    assert ok, said
